"""Detectors of failures in loads, and retrieval of text for diagnosis."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def volume_anomaly(df: DataFrame, day: str, first: str, last: str, drop: float = 0.30, days: int = 7) -> DataFrame:
    """Daily counts, days without rows included, against the mean of the ``days`` before: ``alert`` below 1 - drop."""
    counts = df.groupBy(F.to_date(day).alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    calendar = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    dense = calendar.join(counts, "day", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    w = Window.orderBy(F.unix_date("day")).rangeBetween(-days, -1)  # one row per day
    before = dense.withColumns({"total": F.sum("rows").over(w), "n": F.count(F.lit(1)).over(w)})
    return before.select(
        "day",
        "rows",
        F.round(F.col("total") / F.col("n"), 4).alias("baseline"),
        F.coalesce(F.col("rows") * F.col("n") < F.lit(1 - drop) * F.col("total"), F.lit(False)).alias("alert"),
    )


def reject_alert(runs: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Runs that rejected rows, with their reasons."""
    reasons = quarantine.groupBy(F.col("pipeline_run_id").alias("run_id")).agg(
        F.array_sort(F.collect_set("rejection_reason")).alias("reasons")
    )
    return runs.where("rows_rejected > 0").join(reasons, "run_id", "left")


def duration_anomaly(runs: DataFrame, entity: str, start: str, seconds: str, factor: float = 5.0, period: str | None = None, k: int = 200) -> DataFrame:
    """Runs that took ``factor`` times the median of the entity's runs in earlier periods, with that ``baseline``.

    An earlier spike hardly moves a median.  Each (entity, period) is one
    mergeable quantile sketch (exact up to about ``k`` runs), and sketches are
    merged over the periods before, so what is ordered is periods and not runs.
    Without a ``period`` ("day", "month") each value of ``start`` is one.
    """
    rows = runs.withColumn("_period", F.date_trunc(period, F.col(start).cast("timestamp")) if period else F.col(start))
    sketches = rows.groupBy(entity, "_period").agg(F.kll_sketch_agg_double(F.col(seconds).cast("double"), k).alias("_sketch"))
    before = Window.partitionBy(entity).orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    merged = sketches.select(F.col(entity).alias("_entity"), F.col("_period").alias("_of"), F.kll_merge_agg_double("_sketch", k).over(before).alias("_merged"), F.lag("_period").over(Window.partitionBy(entity).orderBy("_period")).alias("_earlier"))
    told = merged.where("_earlier is not null").select("_entity", "_of", F.kll_sketch_get_quantile_double("_merged", F.lit(0.5)).alias("baseline"))
    joined = rows.join(told, F.col(entity).eqNullSafe(F.col("_entity")) & (F.col("_period") == F.col("_of")))
    return joined.where(F.col(seconds) >= factor * F.col("baseline")).select(*runs.columns, "baseline")


def null_key_rate(fact: DataFrame, load: str, key: str) -> DataFrame:
    return fact.groupBy(load).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(key).isNull()).alias("null_keys")).withColumn(
        "null_rate", F.round(F.col("null_keys") / F.col("rows"), 6)
    )


def schema_drift(expected: T.StructType, actual: DataFrame) -> DataFrame:
    """Columns ADDED, REMOVED or RETYPED in a load: ``(column, expected_type, actual_type, change)``."""
    spark = actual.sparkSession
    rows = lambda s, name: spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in s], f"column string, {name} string")
    return changed(rows(expected, "expected_type").join(rows(actual.schema, "actual_type"), "column", "full"))


def changed(both: DataFrame) -> DataFrame:
    """Rows of ``(expected_type, actual_type)`` that differ, with their ``change``."""
    change = (
        F.when(F.col("expected_type").isNull(), "ADDED")
        .when(F.col("actual_type").isNull(), "REMOVED")
        .when(F.col("expected_type") != F.col("actual_type"), "RETYPED")
    )
    return both.withColumn("change", change).where("change is not null")


def late_dimension(facts: DataFrame, dim: DataFrame, key: str, dim_key: str, day: str) -> DataFrame:
    """Facts dated before their key first appears in the dimension."""
    first = dim.groupBy(F.col(dim_key).alias("_key")).agg(F.min("valid_from").alias("first_seen"))
    return facts.join(first, facts[key] == first["_key"]).where(F.col(day) < F.col("first_seen")).drop("_key")


def clock_skew(df: DataFrame, updated: str, ingested: str, run: str, entity: str | None = None) -> DataFrame:
    """Per run (of an entity, so that runs are ordered within each): rows dated after they came in, and whether the run's latest date went back."""
    of = [entity] if entity else []
    runs = df.groupBy(*of, run).agg(F.count_if(F.col(updated) > F.col(ingested)).alias("ahead"), F.max(updated).alias("latest"))
    before = F.max("latest").over(Window.partitionBy(*of).orderBy(run).rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("went_back", F.coalesce(F.col("latest") < before, F.lit(False)))


def recurring_cause(found: DataFrame, component: str, cause: str, at: str, least: int = 2) -> DataFrame:
    """Causes that came back: how often, first, last and the longest gap in days."""
    w = Window.partitionBy(component, cause).orderBy(at)
    gap = F.datediff(at, F.lag(at).over(w))
    return (
        found.withColumn("_gap", gap)
        .groupBy(component, cause)
        .agg(F.count(F.lit(1)).alias("times"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.max("_gap").alias("longest_gap"))
        .where(F.col("times") >= least)
    )


def text_chunks(df: DataFrame, row_id: str, text: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """Overlapping chunks of ``size`` white-space-separated tokens: ``(row_id, chunk, tokens, chunk_text)``."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - overlap - 1, F.lit(0)), F.lit(step))
    parts = df.select(row_id, words.alias("_w")).where(F.size("_w") > 0).select(row_id, "_w", F.posexplode(starts).alias("chunk", "_at"))
    part = F.slice("_w", F.col("_at") + 1, F.lit(size))
    return parts.select(row_id, "chunk", F.size(part).alias("tokens"), F.array_join(part, " ").alias("chunk_text"))


def unit_vectors(df: DataFrame, row_id: str, vector: str, name: str) -> DataFrame:
    """``(row_id, name)``: vectors over their lengths, in doubles; those without a length are left out."""
    wide = df.select(row_id, F.transform(vector, lambda x: x.cast("double")).alias("_w"))
    length = F.sqrt(F.aggregate("_w", F.lit(0.0), lambda s, x: s + x * x))
    return wide.withColumn("_n", length).where("_n > 0").select(row_id, F.transform("_w", lambda x: x / F.col("_n")).alias(name))


#: Bound of a block of queries, which is broadcast.
BLOCK_BYTES = 16 << 20
#: Products at once in a task, and the margin within which a product of matrices may differ from a sum in order.
PRODUCTS, ROUNDING = 1 << 21, 1e-9


def query_blocks(queries: DataFrame, vector: str, block: int | None = None) -> Iterator[DataFrame]:
    """``queries`` (with ``query_id``) in parts of about ``block`` rows, by default as many as ``BLOCK_BYTES`` hold of the longest vector."""
    rows, longest = queries.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    blocks = max(1, -(-rows // (block or max(1, BLOCK_BYTES // (8 * max(1, longest or 1))))))
    for b in range(blocks):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)


def _in_order(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row products, summed from the first component on, so equal pairs of vectors have equal sums wherever they lie."""
    s = np.zeros(len(v))
    for j in range(v.shape[1]):
        s += v[:, j] * q[:, j]
    return s


def _best(ids: np.ndarray, v: np.ndarray, qids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of rows and queries, and the products, of each query's ``k`` best rows; ``floor`` (what a query's best must reach) is raised to the ``k``-th.

    Candidates come from a product of matrices; they are summed again in order
    before they are compared, nan above all, ties by id.
    """
    _, codes = np.unique(np.concatenate([ids, qids]), return_inverse=True)
    at, of, found = [], [], []
    step = max(1, PRODUCTS // len(ids))
    for a in range(0, len(q), step):
        part = slice(a, a + step)
        near = q[part] @ v.T
        near[np.isnan(near)] = np.inf
        near[codes[None, : len(ids)] == codes[len(ids) + np.arange(len(q))[part], None]] = -np.inf
        bound = floor[part]
        if len(ids) > k:
            bound = np.maximum(bound, np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k])
        y, x = np.nonzero(near >= (bound - ROUNDING)[:, None])
        y += a
        exact = _in_order(v[x], q[y])
        keep = np.isnan(exact) | (exact > least)
        y, x, exact = y[keep], x[keep], exact[keep]
        none = np.isnan(exact)
        order = np.lexsort((codes[x], -np.where(none, np.inf, exact), ~none, y))
        y, x, exact = y[order], x[order], exact[order]
        rank = np.arange(len(y)) - np.searchsorted(y, y)
        keep = rank < k
        last = rank == k - 1
        floor[y[last]] = np.maximum(floor[y[last]], np.where(np.isnan(exact[last]), np.inf, exact[last]))
        at.append(x[keep]), of.append(y[keep]), found.append(exact[keep])
    return np.concatenate(at), np.concatenate(of), np.concatenate(found)


def best_rows(rows: DataFrame, queries: DataFrame, row_id: str, k: int, least: float, block: int | None = None, cells: bool = False) -> DataFrame:
    """The ``k`` best of ``rows`` (``_v``) for each of ``queries`` (``query_id``, ``_q``) above ``least``: ``(query_id, row_id, similarity, rank)``.

    Queries are broadcast in blocks of bounded bytes; a task multiplies its rows
    with a block as matrices and keeps its own best before rows are dealt by
    query.  With ``cells`` a query meets only rows whose ``cell`` is in its
    array ``cells``.
    """
    spark = rows.sparkSession
    schema = T.StructType([queries.schema["query_id"], rows.schema[row_id], T.StructField("similarity", T.DoubleType())])
    columns = [row_id, "_v", *(["cell"] if cells else [])]
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), row_id)
    found = []
    for part in query_blocks(queries.where("query_id is not null"), "_q", block):
        held = part.select("query_id", "_q", *(["cells"] if cells else [])).toArrow()  # a block of bounded bytes
        sent = spark.sparkContext.broadcast((held["query_id"].to_numpy(), _matrices(held["_q"]), held["cells"].to_pylist() if cells else None))

        def score(batches, sent=sent):
            qids, by_width, looks = sent.value
            meets = {}  # (cell, width): the queries that look there, and what their best must reach
            for batch in batches:
                ids, mine = batch.column(row_id).to_numpy(zero_copy_only=False), batch.column("cell").to_numpy() if cells else np.zeros(len(batch), int)
                for width, (places, v) in _matrices(batch.column("_v")).items():
                    if width not in by_width:
                        continue
                    of, q = by_width[width]
                    for cell in np.unique(mine[places]):
                        if (cell, width) not in meets:
                            some = np.array([i for i, n in enumerate(of) if not cells or cell in looks[n]], int)
                            meets[cell, width] = some, np.full(len(some), float(least))
                        (some, floor), here = meets[cell, width], np.flatnonzero(mine[places] == cell)
                        if not len(some):
                            continue
                        x, y, near = _best(ids[places][here], v[here], qids[of][some], q[some], floor, k, least)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(qids[of][some][y], held_type), pa.array(ids[places][here][x], batch.schema.field(row_id).type), pa.array(near)], names=schema.names
                        )

        held_type = held.schema.field("query_id").type
        scored = rows.where(F.col(row_id).isNotNull()).select(*columns).mapInArrow(score, schema)
        found.append(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    return reduce(DataFrame.unionByName, found)


def _matrices(column: pa.Array | pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by their width: places and matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    widths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = {}
    for width in np.unique(widths):
        places = np.flatnonzero(widths == width)
        out[int(width)] = places, column.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).reshape(len(places), int(width))
    return out


def cosine_topk(corpus: DataFrame, queries: DataFrame, row_id: str, vector: str, k: int = 5, least: float = 0.7, block: int | None = None) -> DataFrame:
    """The ``k`` nearest rows of each query above ``least``: ``(query_id, row_id, similarity, rank)``.

    ``queries`` is a stated set, compared with every row.  It is broadcast in
    blocks of bounded bytes (or of about ``block`` rows).  Lengths are taken out
    once per row, so a comparison is a dot product.
    """
    rows = unit_vectors(corpus, row_id, vector, "_v")
    every = unit_vectors(queries, row_id, vector, "_q").withColumnRenamed(row_id, "query_id")
    return best_rows(rows, every, row_id, k, least, block)
