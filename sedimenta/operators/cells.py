"""Nearest rows by cosine through an index of cells, exact when it is asked for.

Cells are fitted on a bounded sample and every row is put into its nearest one.
A query looks into its nearest cells first.  A cell's rows lie within an angle
(its radius) of its centre, so no row of a cell is nearer to a query than their
angle less the radius: in exact mode all cells that could still hold a better
row than those found are looked into as well.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .detect import best_rows, unit_vectors

#: Rows of the sample that cells are fitted on, at most, and the bound on cells; the centres are broadcast.
SAMPLE_ROWS, MOST_CELLS = 50_000, 1_024
#: Angles are compared with this margin, far above the rounding of a dot product.
MARGIN = 1e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _angle(similarity: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), similarity)))


def fit_cells(corpus: DataFrame, row_id: str, vector: str, cells: int, seed: int = 7) -> list[list[float]]:
    """Unit-length centres of at most ``cells`` cells, from a sample of at most about ``SAMPLE_ROWS`` rows."""
    rows = unit_vectors(corpus, row_id, vector, "_v")
    total = rows.count()
    if not total:
        return []
    sample = rows.sample(min(1.0, SAMPLE_ROWS / total), seed=seed) if total > SAMPLE_ROWS else rows
    k = max(2, min(cells, MOST_CELLS, total))
    model = KMeans(k=k, seed=seed, maxIter=10, featuresCol="_f").fit(sample.select(array_to_vector("_v").alias("_f")))
    centres = [[float(x) for x in c] for c in model.clusterCenters()]
    lengths = [sum(x * x for x in c) ** 0.5 for c in centres]
    return [[x / n for x in c] for c, n in zip(centres, lengths, strict=True) if n > 0]


def _with_nearness(rows: DataFrame, centres: list[list[float]], vector: str) -> DataFrame:
    """``rows`` with ``_near``: ``(similarity, cell)`` of every centre."""
    table = rows.sparkSession.createDataFrame([(centres,)], "_centres array<array<double>>")
    near = F.transform("_centres", lambda c, i: F.struct(dot(F.col(vector), c).alias("similarity"), i.alias("cell")))
    return rows.crossJoin(F.broadcast(table)).withColumn("_near", near).drop("_centres")


def index_rows(corpus: DataFrame, centres: list[list[float]], row_id: str, vector: str) -> DataFrame:
    """``(row_id, _v, cell, angle)``: every row with a length, in the cell of its nearest centre, at that angle."""
    placed = _with_nearness(unit_vectors(corpus, row_id, vector, "_v"), centres, "_v")
    best = F.array_max("_near")
    return placed.select(row_id, "_v", best["cell"].alias("cell"), _angle(best["similarity"]).alias("angle"))


def cell_topk(
    index: DataFrame, centres: list[list[float]], queries: DataFrame, row_id: str, vector: str, k: int = 5, least: float = 0.7, probes: int = 8, exact: bool = False
) -> DataFrame:
    """The ``k`` nearest indexed rows of each query above ``least``: ``(query_id, row_id, similarity, rank)``.

    Each query is compared with the rows of its ``probes`` nearest cells; with
    ``exact`` also with those of all cells that may hold a better row.
    ``queries`` is a stated set, broadcast in blocks of bounded bytes; rows of
    the index stay where they are.  Give a stored index.
    """
    every = unit_vectors(queries, row_id, vector, "_q").withColumnRenamed(row_id, "query_id")
    near = _with_nearness(every, centres, "_q").withColumn("_near", F.sort_array("_near", asc=False))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), row_id)
    first = near.select("query_id", "_q", F.transform(F.slice("_near", 1, probes), lambda n: n["cell"]).alias("cells"))
    best = best_rows(index, first, row_id, k, least, cells=True)
    if not exact or probes >= len(centres):
        return best
    radius = index.groupBy("cell").agg(F.max("angle").alias("radius")).agg(F.map_from_entries(F.collect_list(F.struct("cell", "radius"))).alias("_radius"))  # at most MOST_CELLS
    bound = best.where(F.col("rank") == k).select("query_id", F.col("similarity").alias("kth"))
    others = near.join(bound, "query_id", "left").crossJoin(F.broadcast(radius))
    needed = F.greatest(F.coalesce("kth", F.lit(least)), F.lit(least))
    could = lambda n: F.cos(F.greatest(_angle(n["similarity"]) - F.try_element_at(F.col("_radius"), n["cell"]) - MARGIN, F.lit(0.0))) >= needed
    rest = F.slice("_near", F.lit(probes + 1), F.greatest(F.size("_near") - probes, F.lit(1)))
    more = others.select("query_id", "_q", F.transform(F.filter(rest, could), lambda n: n["cell"]).alias("cells")).where(F.size("cells") > 0)
    second = best_rows(index, more, row_id, k, least, cells=True)
    both = best.drop("rank").unionByName(second.drop("rank"))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
