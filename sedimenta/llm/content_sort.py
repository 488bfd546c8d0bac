"""Exact duplicates by content sort, in DataFrame operations only.

Sampled splitters range-partition the normalised texts, each range is sorted
externally, and every row is compared in full with the row before it.  The
order over which ranges are cut is (leading bytes, digest of the text, hash of
the row's id): its last part lets splitters cut through a large group of equal
texts, so such a group is dealt over many ranges.  Runs of equal texts in
different ranges are then joined by digest, which moves one row per run.

Null texts count as empty, and all empty texts are one group.  Of rows with
equal text the smallest id is kept; null ids come last; of repeated rows with
the same id and text one is kept.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, staged, table

#: Bound of the splitter sample: rows per range.
SAMPLE_PER_RANGE = 40
MAX_RANGES = 20_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _order_key(norm: Column, sha: Column, doc_id: Column) -> Column:
    lead = F.rpad(F.hex(F.substring(norm.cast("binary"), 1, 16)), 32, "0")
    tie = F.lpad(F.hex(F.xxhash64(doc_id)), 16, "0")
    return F.concat(lead, sha, tie)


def splitters(rows: DataFrame, ranges: int, per_range: int = SAMPLE_PER_RANGE) -> list[str]:
    """At most ``ranges - 1`` keys that cut a sample of about ``ranges * per_range`` rows evenly."""
    total = rows.count()
    if ranges < 2 or not total:
        return []
    share = min(1.0, ranges * per_range / total)
    sample = rows.sample(share, seed=7) if share < 1 else rows
    norm, sha = normalised(F.col("text")), F.sha2(normalised(F.col("text")), 256)
    keys = sorted(r[0] for r in sample.select(_order_key(norm, sha, F.col("doc_id"))).collect())
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def range_of(key: Column, cuts: list[str]) -> Column:
    """How many of the sorted ``cuts`` are at most ``key``: a binary search over a constant array."""
    if not cuts:
        return F.lit(0)
    depth = len(cuts).bit_length()
    padded = cuts + ["~"] * ((1 << depth) - 1 - len(cuts))
    array = F.split(F.lit(",".join(padded)), ",")
    steps = F.array(*[F.lit(1 << d) for d in reversed(range(depth))])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(array, at + step - 1) <= key, at + step).otherwise(at)
    )


def exact_duplicates(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``."""
    spark = docs.sparkSession
    ranges = min(MAX_RANGES, ranges or partitions(spark))
    rows = docs.select("doc_id", "text")
    cuts = splitters(rows, ranges)
    keyed = (
        rows.select("doc_id", normalised(F.col("text")).alias("norm"))
        .withColumn("text_sha256", F.sha2("norm", 256))
        .withColumn("range", range_of(_order_key(F.col("norm"), F.col("text_sha256"), F.col("doc_id")), cuts))
    )
    here = Window.partitionBy("range").orderBy("norm", F.col("doc_id").asc_nulls_last())
    before = F.lag(F.struct("norm", "doc_id")).over(here)
    neighbours = keyed.repartitionById(ranges, "range").select(
        "doc_id",
        "range",
        "text_sha256",
        (before.isNull() | (before["norm"] != F.col("norm"))).alias("head"),
        (before.isNull() | (before["norm"] != F.col("norm")) | ~before["doc_id"].eqNullSafe(F.col("doc_id"))).alias(
            "first_of_id"
        ),
        F.row_number().over(here).alias("at"),
    )
    to_here = Window.partitionBy("range").orderBy("at")
    runs = staged(
        neighbours.withColumn("run", F.sum(F.col("head").cast("long")).over(to_here)).drop("head", "at"), "runs"
    )
    totals = runs.groupBy("range", "run", "text_sha256").agg(
        F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows")
    )
    same = Window.partitionBy("text_sha256")
    groups = totals.select(
        "range",
        "run",
        F.min("low").over(same).alias("keep_id"),
        F.sum("rows").over(same).alias("group_size"),
    )
    return runs.join(groups, ["range", "run"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("first_of_id")).alias("kept"),
        "text_sha256",
    )


def op9_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
