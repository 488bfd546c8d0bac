"""Product-quantised codes of vectors, exact in integers by limb-split matrix products.

Components become integers floor(1024 x); a vector is cut into four parts, each
with a codebook of up to 256 entries that four rounds of nearest-entry means
improve.  The nearest entry needs all products of parts and entries.  They come
from float64 BLAS without an error: integers are broken into limbs so narrow
that a whole dot product of two limbs stays at or below 2^53, and the dot
products of limbs are shifted and added in int64.  Ties go to the first entry.

A round is one scan: tasks send sums and counts of their parts by entry, so what
is shuffled and what reaches the driver has the size of the codebooks (256 times
the dimensions), whatever the number of vectors.

Rows whose vector is null, or holds null or non-finite components, are left out.
All other vectors must have one length, a multiple of four; anything else
raises, and so do components so large that a squared distance does not fit a
long.  Rows that repeat an id are vectors of their own; the first codebook takes
them by id (null last), then by components.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, staged, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that are compared with a codebook at once.
BLOCK = 4096


def limbs(x: np.ndarray, width: int) -> list[np.ndarray]:
    """``x`` as float64 limbs, the lowest first: their sum, each shifted ``width`` bits on, is ``x``; the last one has the sign."""
    out = []
    while len(x) and (x.min() < -(1 << width) or x.max() >= 1 << width):
        out.append((x & ((1 << width) - 1)).astype(np.float64))
        x = x >> width
    return [*out, x.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All dot products of the rows of two int64 matrices, exact wherever they fit an int64."""
    width = (53 - max(1, a.shape[1]).bit_length()) // 2
    out = np.zeros((len(a), len(b)), np.int64)
    right = limbs(b, width)
    for i, x in enumerate(limbs(a, width)):
        for j, y in enumerate(right):
            if width * (i + j) < 64:
                out += (x @ y.T).astype(np.int64) << np.int64(width * (i + j))
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(entry, squared distance)`` of each row; of equally near entries the first."""
    far = (x * x).sum(1)[:, None] - 2 * exact_products(x, entries) + (entries * entries).sum(1)
    at = far.argmin(1)
    return at, far[np.arange(len(x)), at]


def _integers(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for b in batches:
            vectors = b.column("embedding")
            b, vectors = b.filter(vectors.is_valid()), vectors.filter(vectors.is_valid())
            at = vectors.offsets.to_numpy().astype(np.int64)
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null is not a number
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            at -= at[0]
            good = bad[at[1:]] == bad[at[:-1]]
            scaled = np.floor(np.where(np.isfinite(values), values, 0) * SCALE)
            sizes = np.diff(at)
            kept = scaled[np.repeat(good, sizes)]
            if len(kept) and np.abs(kept).max() >= 2.0**62:
                raise OverflowError("a component is too large for squared distances in 64 bits")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[good])]), pa.int32()), pa.array(kept.astype(np.int64)))
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(mask), b.column("label").filter(mask), lists], schema=schema)

    return run


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, v)`` of the vectors that are kept."""
    kinds = {f.name: f.dataType for f in vectors.schema}
    out = f"vec_id {kinds['vec_id'].simpleString()}, label {kinds['label'].simpleString()}, v array<bigint>"

    def run(batches):
        for b in batches:
            schema = pa.schema([b.schema.field("vec_id"), b.schema.field("label"), pa.field("v", pa.list_(pa.int64()))])
            yield from _integers(schema)([b])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, out)


def _blocks(column: pa.Array, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    values = column.flatten().to_numpy().reshape(-1, dims) if dims else np.zeros((len(column), 0), np.int64)
    for row in range(0, len(values), BLOCK):
        yield row, values[row : row + BLOCK]


def _parts(x: np.ndarray) -> list[np.ndarray]:
    return np.split(x, PARTS, axis=1)


def entry_sums(books: list[np.ndarray], dims: int):
    """A ``mapInArrow`` function: a task's vectors to ``(part, entry, place, total, n)``, at most one row per component of the codebooks."""

    def run(batches):
        totals = [np.zeros(book.shape, np.int64) for book in books]
        counts = [np.zeros(len(book), np.int64) for book in books]
        for b in batches:
            for _, x in _blocks(b.column("v"), dims):
                for p, part in enumerate(_parts(x)):
                    at, _ = nearest(part, books[p])
                    np.add.at(totals[p], at, part)
                    counts[p] += np.bincount(at, minlength=len(books[p]))
        for p, (total, n) in enumerate(zip(totals, counts, strict=True)):
            e, place = np.nonzero(np.broadcast_to(n[:, None] > 0, total.shape))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(e), p, np.int32)), pa.array(e.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[e, place]), pa.array(n[e])],
                ["part", "entry", "place", "total", "n"],
            )

    return run


def code_rows(books: list[np.ndarray], dims: int):
    """A ``mapInArrow`` function: vectors to ``(vec_id, label, code, error)``."""

    def run(batches):
        for b in batches:
            for row, x in _blocks(b.column("v"), dims):
                found = [nearest(part, books[p]) for p, part in enumerate(_parts(x))]
                codes = np.stack([at for at, _ in found], 1).astype(np.uint8)
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(c).slice(row, len(x)) for c in ("vec_id", "label")),
                        pa.array([text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string()),
                        pa.array(sum(far for _, far in found)),
                    ],
                    ["vec_id", "label", "code", "error"],
                )

    return run


def codebooks(rows: DataFrame, dims: int) -> list[np.ndarray]:
    """The codebooks of integer vectors ``(vec_id, v)`` after all rounds, one int64 matrix per part."""
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    books = _parts(np.array([r.v for r in first], np.int64).reshape(len(first), dims))
    for _ in range(ROUNDS):
        sums = rows.select("v").mapInArrow(entry_sums(books, dims), "part int, entry int, place int, total long, n long")
        books = [book.copy() for book in books]
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # the codebooks' size
            books[r.part][r.entry, r.place] = r.total // r.n
    return books


def vector_codes(vectors: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """``(vec_id, label, code, error)`` of the vectors ``(vec_id, embedding, label)`` that are kept, and the codebooks."""
    bound_batches(vectors.sparkSession)
    rows = staged(integer_vectors(vectors), "integers")
    low, high, top = rows.agg(F.min(F.size("v")), F.max(F.size("v")), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
    dims = low or 0
    if low != high or dims % PARTS:
        raise ValueError(f"vectors have {low} to {high} components; one length, a multiple of {PARTS}, is needed")
    if top is not None and dims * (2 * top + 1) ** 2 >= 1 << 63:
        raise OverflowError("a component is too large for squared distances in 64 bits")
    books = codebooks(rows, dims)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "v")
    return rows.mapInArrow(code_rows(books, dims), f"{kinds}, code string, error long"), books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel()).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes(table(spark, sf_dir, "embeddings"))
    codes = staged(codes, "codes")
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return codes.join(sums, codes["label"].eqNullSafe(sums["of"])).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )


def _round_sql(r: int) -> str:
    return f"""d{r} AS MATERIALIZED (SELECT p.rid, p.part, min({{'d': list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': b.e}}) AS m
  FROM p JOIN b{r} b ON b.part = p.part GROUP BY p.rid, p.part),
t{r} AS (SELECT d.part, d.m.e AS e, unnest(range(1, len(p.x) + 1)) AS pos, unnest(p.x) AS x FROM d{r} d JOIN p ON p.rid = d.rid AND p.part = d.part),
m{r} AS (SELECT part, e, list(v ORDER BY pos) AS x FROM (SELECT part, e, pos, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM t{r} GROUP BY part, e, pos) GROUP BY part, e),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.e = b.e)"""


OP13_SQL = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
q AS (SELECT *, unnest(range(0, {PARTS})) AS part FROM k),
p AS MATERIALIZED (SELECT rid, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS x FROM q),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS e, x FROM p WHERE rid <= {ENTRIES}),
{", ".join(_round_sql(r) for r in range(ROUNDS))},
f AS MATERIALIZED (SELECT p.rid, p.part, min({{'d': list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': b.e}}) AS m
  FROM p JOIN b{ROUNDS} b ON b.part = p.part GROUP BY p.rid, p.part),
c AS (SELECT rid, string_agg(lpad(lower(to_hex(m.e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM f GROUP BY rid),
s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c USING (rid), s
"""
