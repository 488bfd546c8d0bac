r"""Repeated lines across documents, in DataFrame operations only.

Lines are known by a hash of their key.  Sampled splitters range-partition the
hashes; they cut behind the hash by document, so a line that a third of all
documents share is dealt over many ranges.  Each range is sorted by hash, then
document (the largest first), then position; a stream over that order sees the
first occurrence of a line and its number of documents.  Runs of one hash in
different ranges are joined by one row per run.  What comes back per document is
a compressed bitmap of its dropped lines, and no text: words of 64 lines, of
which only those with a dropped line are held.

A line's key is the line without white space ``[\x20\x09-\x0D]`` at both ends,
with A-Z in lower case.  Keys of fewer than ``least_chars`` code points never
count.  Keys in at least ``least_docs`` documents lose all their lines except
those in the document with the largest id.  Null and empty texts are one empty
line.  Rows that share an id, or have none, are one document when documents are
counted, and each is answered by its own text; no id is smaller than any id.
Hashes are 128 bits of SHA-256.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, staged, table, text_digest
from .content_sort import MAX_RANGES, SAMPLE_PER_RANGE, range_of

LEAST_CHARS, LEAST_DOCS = 20, 3
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANK))
    plain = F.octet_length(bare) == F.char_length(bare)  # only ASCII: both ways give the same, this one is faster
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _place(h: Column, doc_id: Column) -> Column:
    return F.concat(h, F.lpad(F.hex(F.xxhash64(doc_id)), 16, "0"))


def splitters(lines: DataFrame, ranges: int) -> list[str]:
    """At most ``ranges - 1`` places that cut a sample of about 40 lines a range evenly."""
    total = lines.count()
    if ranges < 2 or not total:
        return []
    share = min(1.0, ranges * SAMPLE_PER_RANGE / total)
    sample = lines.sample(share, seed=7) if share < 1 else lines
    keys = sorted(r[0] for r in sample.select(_place(F.col("h"), F.col("doc_id"))).collect())
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, ranges: int | None = None) -> DataFrame:
    """``(doc_id, digest, bitmap, n_dropped)`` for each distinct (id, text) that loses lines.

    ``bitmap``: array of (word, dropped) in order, bit b of ``dropped`` being
    line ``64 * word + b``; words without a dropped line are left out.
    """
    ranges = min(MAX_RANGES, ranges or partitions(docs.sparkSession))
    split = docs.select("doc_id", text_digest(F.col("text")).alias("digest"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    long = split.where(F.char_length(F.btrim("line", F.lit(BLANK))) >= least_chars)
    lines = staged(long.select("doc_id", "digest", "pos", F.substring(F.sha2(line_key(F.col("line")), 256), 1, 32).alias("h")), "lines")

    keyed = lines.withColumn("range", range_of(_place(F.col("h"), F.col("doc_id")), splitters(lines, ranges)))
    here = Window.partitionBy("range").orderBy("h", F.col("doc_id").desc_nulls_last(), "digest", "pos")
    before = F.lag(F.struct("h", "doc_id")).over(here)
    head = before.isNull() | (before["h"] != F.col("h"))
    streamed = keyed.repartitionById(ranges, "range").select(
        "*", head.alias("head"), (head | ~before["doc_id"].eqNullSafe(F.col("doc_id"))).alias("first_of_doc")
    )
    run = F.sum(F.col("head").cast("long")).over(here.rowsBetween(Window.unboundedPreceding, 0))
    runs = staged(streamed.select("range", run.alias("run"), "h", "doc_id", "digest", "pos", "first_of_doc"), "runs")

    totals = runs.groupBy("range", "run", "h").agg(F.count_if("first_of_doc").alias("docs"), F.max("doc_id").alias("top"))
    same = Window.partitionBy("h")
    repeated = totals.select("range", "run", F.sum("docs").over(same).alias("docs"), F.max("top").over(same).alias("top")).where(F.col("docs") >= least_docs)
    drops = runs.join(staged(repeated.drop("docs"), "repeated"), ["range", "run"]).where(~F.col("doc_id").eqNullSafe(F.col("top")))
    words = drops.groupBy("doc_id", "digest", F.expr("pos div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("dropped"))
    return words.groupBy("doc_id", "digest").agg(
        F.array_sort(F.collect_list(F.struct("word", "dropped"))).alias("bitmap"), F.sum(F.bit_count("dropped").cast("long")).alias("n_dropped")
    )


def kept_text(text: Column, bitmap: Column) -> Column:
    """``text`` without the lines that ``bitmap`` drops, in one pass over both."""
    gap = lambda w, i: w["word"] - F.when(i > 0, F.get(bitmap, i - 1)["word"] + 1).otherwise(0)
    words = F.flatten(F.transform(bitmap, lambda w, i: F.concat(F.array_repeat(F.lit(0).cast("long"), gap(w, i).cast("int")), F.array(w["dropped"]))))
    # Lines and words are bound once, as the one element of an array, and not once per line.
    both = F.array(F.struct(lines_of(text).alias("lines"), words.alias("words")))
    bit = lambda words, i: F.call_function("shiftright", F.get(words, F.floor(i / 64).cast("int")), i % 64).bitwiseAND(F.lit(1).cast("long"))
    kept = F.transform(both, lambda x: F.array_join(F.filter(x["lines"], lambda line, i: F.coalesce(bit(x["words"], i), F.lit(0).cast("long")) == 0), "\n"))
    return kept[0]


def deduplicated(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept)``, one row per row of ``docs``; ``kept`` is the text that stays."""
    bitmaps = staged(dropped_lines(docs, least_chars, least_docs), "bitmaps").alias("m")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", text_digest(F.col("text"))).alias("d")
    same = (F.col("d.digest") == F.col("m.digest")) & F.col("d.doc_id").eqNullSafe(F.col("m.doc_id"))
    kept = F.when(F.col("m.bitmap").isNull(), F.col("d.text")).otherwise(kept_text(F.col("d.text"), F.col("m.bitmap")))
    return rows.join(bitmaps, same, "left").select(
        "d.doc_id", F.size(lines_of(F.col("d.text"))).cast("long").alias("n_lines"), F.coalesce("m.n_dropped", F.lit(0).cast("long")).alias("n_dropped"), kept.alias("kept")
    )


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM s),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.doc_id, k.line, k.pos, top IS NOT NULL AND top <> k.doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
