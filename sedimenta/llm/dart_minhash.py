"""Near-duplicate classes by DartMinHash signatures, banded joins and exact checks.

A text is the set of its five-word shingles (fewer words, but not none: one
shingle), each of a weight.  Hashed darts fall into the plane of weight and
rank of every shingle, which is cut into regions: weights [0, 1), [1, 2),
[2, 4), ... by ranks that double as well.  The darts of a region depend on the
shingle and the region alone, so equal shingles get equal darts in every text.
A dart has a coordinate, a weight and a rank; a text sees the darts below its
own weight of the shingle, in the regions that this weight reaches, and per
coordinate the earliest of them is its signature: two texts agree in a
coordinate with the probability of their weighted Jaccard similarity.  How far
in rank a text must look falls with its total weight, so a long text throws few
darts per shingle.  Weights are one (plain Jaccard) in production;
``weighted=True`` takes the number of times that a text has the shingle.

Texts with equal word sequences are joined first and go on as one
representative.  Representatives that share a band are candidates.  In each
bucket they are checked against one head, the text that shares most, and joined
classes are found.  What is then left in buckets of several classes goes
through an exact filter before its pairs are made: with shingles in one order,
rare ones first, two texts of that similarity share one of their first few, at
places that still leave enough behind (prefix, length and position bounds).
So every candidate pair is joined already, checked in full, or ruled out by a
bound, and a group of copies costs its size, not its square.  The candidates
are the same by either way and at every size: pairs that share a band.  With 25 bands of
5 coordinates a pair of similarity 0.8 has no band in common with probability
5e-5.  Checks compute the similarity from the full shingle sets.

One row per row of the input: the class is named by its smallest doc_id.  Null
and empty texts (no words) and rows with null ids are their own class, the
latter with a null class id.  A document is an id with a text: rows that repeat
both are one document, and different texts of one id are different documents,
of which the class of each is found.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import ALNUM, Words, apart_hashes, chunks, mix, words_of
from .common import bound_batches, staged, table, text_digest
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, PER_BAND = 25, 5
#: All coordinates of a text are filled with probability 1 - exp(-MARGIN) at the first look.
MARGIN = 4.0
#: Bound of the darts that a task holds at once.
DARTS_AT_ONCE = 250_000
#: Rounds of checks against one head per bucket before what is left is filtered.
HEAD_ROUNDS = 2
#: Pairs per document up to which the pairs that are left are checked at once.
PAIRS_PER_DOC = 1
#: Parts of a key in joins that a large group of copies could make uneven.
KEY_SALTS, BUCKET_SALTS = 32, 4
#: Bound of the list of frequent shingles that the filter puts last; it bears on speed alone.
FREQUENT = 100_000


def shingles(w: Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, text)`` of every shingle, repeated ones too."""
    place = np.arange(len(w.hashes))
    last = w.first[1:][w.doc] if len(w.doc) else place
    begin = w.first[:-1][w.doc] if len(w.doc) else place
    size = np.minimum(width, last - begin)
    at = place[(place + size <= last) & ((size == width) | (place == begin))]
    h = np.zeros(len(at), np.uint64)
    for i in range(width):
        fits = i < size[at]
        h[fits] = mix(h[fits] ^ w.hashes[at[fits] + i] + np.uint64(i))
    return h, w.doc[at]


def counted(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, text, times)`` of the distinct shingles of each text, in order of text and hash."""
    e, t = shingles(w)
    order = np.lexsort((e, t))
    e, t = e[order], t[order]
    head = np.flatnonzero(np.concatenate([[True], (e[1:] != e[:-1]) | (t[1:] != t[:-1])])) if len(e) else np.zeros(0, np.int64)
    return e[head], t[head], np.diff(np.append(head, len(e))).astype(np.float64)


def elements(w: Words, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements of each text, in order of text and hash; repeats are elements of their own if weighted."""
    e, t = shingles(w)
    order = np.lexsort((e, t))
    e, t = e[order], t[order]
    if not len(e):
        return e, t
    same = np.concatenate([[False], (e[1:] == e[:-1]) & (t[1:] == t[:-1])])
    if not weighted:
        return e[~same], t[~same]
    place = np.arange(len(e))
    nth = place - np.maximum.accumulate(np.where(same, 0, place))
    return mix(e + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), t


def _poisson(uniform: np.ndarray, rate: float) -> np.ndarray:
    """Counts with the given mean, one for each uniform number."""
    k = np.arange(int(rate + 12 * np.sqrt(rate) + 12))
    logs = -rate + k * np.log(rate) - np.concatenate([[0.0], np.cumsum(np.log(np.maximum(k[1:], 1)))])
    return np.searchsorted(np.cumsum(np.exp(logs)), uniform, "right")


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _seed(number: int) -> np.uint64:
    return np.uint64((number * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)


def _throw(best: np.ndarray, e: np.ndarray, t: np.ndarray, weight: np.ndarray | None, size: int, ranks: tuple[float, float], weights: tuple[float, float]) -> None:
    """Lower ``best`` by the darts of one region of every element: ``ranks`` and ``weights`` are (low, width)."""
    rate = ranks[1] * weights[1] * size
    parts = max(1, int(np.ceil(rate / 512)))  # a region of many darts is thrown in parts
    for part in range(parts):
        own = mix(e + np.uint64(part * 0x51ED27 + 1))
        block = max(1, int(DARTS_AT_ONCE / (1 + rate / parts)))
        for at in range(0, len(e), block):
            s = own[at : at + block]
            many = _poisson(_unit(s), rate / parts)
            of = np.repeat(np.arange(len(s)), many)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            dart = mix(s[of] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
            if weight is not None:
                seen = weights[0] + weights[1] * _unit(mix(dart ^ np.uint64(0x3C3C3C3C3C3C3C3C))) < weight[at : at + block][of]
                dart, of = dart[seen], of[seen]
            place = mix(dart ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            rank = (ranks[0] + ranks[1] * _unit(place)).astype(np.float32).view(np.uint32).astype(np.uint64)
            where = t[at : at + len(s)][of] * size + ((dart >> np.uint64(32)) % np.uint64(size)).astype(np.int64)
            np.minimum.at(best, where, (rank << np.uint64(32)) | (dart & np.uint64(0xFFFFFFFF)))


def signatures(elements: np.ndarray, text: np.ndarray, texts: int, size: int, weights: np.ndarray | None = None) -> np.ndarray:
    """The earliest dart of each coordinate, ``texts`` x ``size`` numbers; texts without elements get zeros.

    Rank bands are [0, r), [r, 2r), [2r, 4r), ... with r = 1 / (8 size), weight
    bands [0, 1), [1, 2), [2, 4), ...; a region's darts are drawn from the hash
    of the element and of both bands.  Without ``weights`` all are one.
    """
    best = np.full(texts * size, np.iinfo(np.uint64).max, np.uint64)
    total = np.bincount(text, weights, minlength=texts)
    need = np.where(total > 0, (np.log(size) + MARGIN) / np.maximum(total, 1e-9), 0.0)
    first = 1.0 / (8 * size)
    level, todo = 0, total > 0
    while todo.any():
        low = 0.0 if level == 0 else first * 2.0 ** (level - 1)
        width = first if level == 0 else low
        chosen = np.flatnonzero(todo[text])
        e, t = elements[chosen], text[chosen]
        w = None if weights is None else weights[chosen]
        band = 0
        while len(e):
            over = 0.0 if band == 0 else 2.0 ** (band - 1)
            _throw(best, mix(e ^ _seed(level + (band << 20))), t, w, size, (low, width), (over, max(over, 1.0)))
            band += 1
            if w is None:
                break
            reach = w > 2.0 ** (band - 1)
            e, t, w = e[reach], t[reach], w[reach]
        level += 1
        if first * 2.0 ** (level - 1) >= need.min(where=todo, initial=np.inf):
            filled = (best.reshape(texts, size) != np.iinfo(np.uint64).max).all(axis=1)
            todo &= ~(filled & (first * 2.0 ** (level - 1) >= need))
    best[np.repeat(total == 0, size)] = 0
    return best.reshape(texts, size)


def bucket_keys(signature: np.ndarray, bands: int = BANDS, per_band: int = PER_BAND) -> np.ndarray:
    rows = signature.reshape(len(signature), bands, per_band)
    h = np.zeros(rows.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
    for i in range(per_band):
        h = mix(h ^ rows[:, :, i])
    return h.view(np.int64)


def sketch(weighted: bool = False, bands: int = BANDS, per_band: int = PER_BAND):
    """A ``mapInArrow`` function: texts to ``(doc_id, n_words, key_a, key_b, buckets)``."""

    def run(batches):
        for b in batches:
            for row, nxt, data, at in chunks(b.column("text")):
                w = words_of(data, at, ALNUM)
                found = counted(w) if weighted else (*shingles(w), None)  # without weights repeats throw the same darts
                keys = bucket_keys(signatures(*found[:2], nxt - row, bands * per_band, found[2]), bands, per_band)
                first, last = w.first[:-1], w.first[1:]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(row, nxt - row),
                        pa.array(np.diff(w.first), pa.int64()),
                        pa.array(apart_hashes(w.hashes, first, last).view(np.int64)),
                        pa.array(apart_hashes(mix(w.hashes + np.uint64(77)), first, last).view(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(nxt - row + 1, dtype=np.int32) * bands), pa.array(keys.ravel())
                        ),
                    ],
                    ["doc_id", "n_words", "key_a", "key_b", "buckets"],
                )

    return run


def similarities(weighted: bool = False):
    """A ``mapInArrow`` function: ``(a, b, text_a, text_b)`` to ``(a, b, similarity)`` from the full shingle sets."""

    def sets(column) -> list[np.ndarray]:
        out = []
        for row, nxt, data, at in chunks(column):
            e, t = elements(words_of(data, at, ALNUM), weighted)
            cuts = np.searchsorted(t, np.arange(nxt - row + 1))
            out += [e[cuts[i] : cuts[i + 1]] for i in range(nxt - row)]
        return out

    def one(u: np.ndarray, v: np.ndarray) -> float:
        joined = np.sort(np.concatenate([u, v]))
        both = int(np.count_nonzero(joined[1:] == joined[:-1]))
        return both / max(1, len(u) + len(v) - both)

    def run(batches):
        for b in batches:
            found = [one(x, y) for x, y in zip(sets(b.column("text_a")), sets(b.column("text_b")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    return run


def count_elements(weighted: bool):
    """A ``mapInArrow`` function: texts to shingles that a block of texts holds several times."""

    def run(batches):
        for b in batches:
            for _, _, data, at in chunks(b.column("text")):
                own, times = np.unique(elements(words_of(data, at, ALNUM), weighted)[0], return_counts=True)
                some = times > 1
                yield pa.RecordBatch.from_arrays([pa.array(own[some].view(np.int64)), pa.array(times[some], pa.int64())], ["token", "n"])

    return run


def prefixes(frequent: np.ndarray, least: float, weighted: bool):
    """A ``mapInArrow`` function: ``(doc_id, label, text)`` to the first shingles of each text, rare ones first.

    ``frequent`` are the shingles that come last, the most frequent at the end.
    """
    order = np.argsort(frequent)
    known, rank = frequent[order], np.arange(1, len(frequent) + 1)[order]

    def run(batches):
        for b in batches:
            for row, nxt, data, at in chunks(b.column("text")):
                e, t = elements(words_of(data, at, ALNUM), weighted)
                late = np.zeros(len(e), np.int64)
                if len(known) and len(e):
                    i = np.minimum(np.searchsorted(known, e), len(known) - 1)
                    late = np.where(known[i] == e, rank[i], 0)
                o = np.lexsort((e, late, t))
                e, t = e[o], t[o]
                size = np.bincount(t, minlength=nxt - row)
                place = np.arange(len(e)) - np.repeat(np.cumsum(size) - size, size)
                first = place <= size[t] - np.ceil(least * size[t] - 1e-9)
                e, t, place = e[first], t[first], place[first]
                rows = pa.array(t + row)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(rows), b.column("label").take(rows), pa.array(e.view(np.int64)), pa.array(place), pa.array(size[t])],
                    ["doc_id", "label", "token", "place", "size"],
                )

    return run


def filtered_pairs(texts: DataFrame, least: float, weighted: bool) -> DataFrame:
    """``(a, b)``: a superset of the pairs of at least that similarity and different labels.

    Of two texts the smaller one's prefix can be shorter; a shared shingle
    counts only if the shingles behind it can still make up the overlap.
    """
    counts = texts.mapInArrow(count_elements(weighted), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    frequent = np.array([r["token"] for r in reversed(top)], np.int64).view(np.uint64)
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = staged(
        texts.select("doc_id", "label", "text").mapInArrow(
            prefixes(frequent, least, weighted), f"doc_id {kind}, label {kind}, token long, place long, size long"
        ),
        "prefixes",
    )
    p = rows.alias("p")
    q = rows.where(F.col("place") <= F.col("size") - F.ceil(2 * least / (1 + least) * F.col("size") - 1e-9)).alias("q")
    need = F.ceil(least / (1 + least) * (F.col("p.size") + F.col("q.size")) - 1e-9)
    behind = F.least(F.col("p.size") - F.col("p.place"), F.col("q.size") - F.col("q.place"))
    smaller = (F.col("q.size") < F.col("p.size")) | ((F.col("q.size") == F.col("p.size")) & (F.col("q.doc_id") < F.col("p.doc_id")))
    fits = (F.col("q.size") >= least * F.col("p.size") - 1e-9) & (behind >= need) & smaller & (F.col("p.label") != F.col("q.label"))
    return (
        p.join(q, (F.col("p.token") == F.col("q.token")) & fits)
        .select(F.least("p.doc_id", "q.doc_id").alias("a"), F.greatest("p.doc_id", "q.doc_id").alias("b"))
        .distinct()
    )


def _checked(pairs: DataFrame, texts: DataFrame, least: float, weighted: bool) -> DataFrame:
    """The pairs of at least that similarity."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(similarities(weighted), f"a {kind}, b {kind}, similarity double").where(F.col("similarity") >= least)


def salted_join(left: DataFrame, right: DataFrame, key: list[str], salts: int, how: str = "inner") -> DataFrame:
    """A join whose left side may have very many rows of one key: they are dealt by ``doc_id`` over ``salts`` parts."""
    parts = F.explode(F.array(*[F.lit(i).cast("long") for i in range(salts)]))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts).cast("long"))
    return left.withColumn("_salt", salt).join(right.withColumn("_salt", parts), [*key, "_salt"], how).drop("_salt")


def sharing_a_bucket(pairs: DataFrame, at: DataFrame) -> DataFrame:
    """The pairs of which both have some bucket of ``at``.

    The sets are staged before they are joined: only then can adaptive execution split a head that is in very many pairs.
    """
    own = staged(at.groupBy("doc_id").agg(F.collect_set("bucket").alias("own")), "own")
    a, b = (own.select(F.col("doc_id").alias(x), F.col("own").alias(f"of_{x}")) for x in ("a", "b"))
    return pairs.join(a, "a").join(b, "b").where(F.arrays_overlap("of_a", "of_b")).select("a", "b")


def _labelled(placed: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return placed.withColumn("label", F.col("doc_id"))
    return placed.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))


def _document() -> Column:
    """What a document is known by: its id, which orders documents, and a digest of its text."""
    return F.struct(F.col("doc_id").alias("id"), text_digest(F.col("text")).alias("digest"))


def documents(docs: DataFrame) -> DataFrame:
    return docs.select(_document().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _classes(docs: DataFrame, least: float, weighted: bool) -> DataFrame:
    """``(doc_id, n_words, class_of)``: both are documents, the second null for one that is alone."""
    spark = docs.sparkSession
    bound_batches(spark)
    given = documents(docs)
    kind = given.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, key_a long, key_b long, buckets array<long>"
    sketches = staged(given.mapInArrow(sketch(weighted), schema), "sketches")
    worded = sketches.where("n_words > 0 and doc_id.id is not null")
    heads = worded.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    told = salted_join(worded.select("doc_id", "key_a", "key_b"), heads, ["key_a", "key_b"], KEY_SALTS, "left")
    members = staged(told.select("doc_id", F.coalesce("head", "doc_id").alias("head")).distinct(), "members")
    chosen = worded.join(members.where("doc_id = head").select("doc_id"), "doc_id", "left_semi")
    placed = chosen.select("doc_id", F.explode("buckets").alias("bucket")).distinct()
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    placed = salted_join(placed, shared, ["bucket"], BUCKET_SALTS)
    sharing = placed.groupBy("doc_id").agg(F.sum("n").alias("sharing"))
    placed = staged(placed.drop("n").join(sharing, "doc_id"), "buckets")
    texts = staged(
        given.where("doc_id.id is not null").join(sharing.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]),
        "texts",
    )
    total = texts.count()
    tested = links = labels = None
    for turn in range(HEAD_ROUNDS + 1):
        at = _labelled(placed, labels)
        sizes = at.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
        mixed = (
            sizes.groupBy("bucket")
            .agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
            .where("labels > 1")
        )
        at = staged(salted_join(at, mixed.select("bucket", "n", "squares"), ["bucket"], BUCKET_SALTS), "open")
        left = at.agg(F.sum((F.col("n") - F.col("squares") / F.col("n")) / 2)).first()[0]
        if not left:
            break
        few = left <= PAIRS_PER_DOC * total
        other = at.select("bucket", F.col("doc_id").alias("other"), F.col("label").alias("other_label"), "sharing")
        if few or turn < HEAD_ROUNDS:
            if not few:
                order = F.struct("sharing", F.xxhash64("other")) if turn == 0 else F.struct(F.xxhash64(F.lit(turn), "other"))
                other = other.groupBy("bucket").agg(F.max_by(F.struct("other", "other_label"), order).alias("h")).select("bucket", "h.*")
            pairs = (
                salted_join(at, other.drop("sharing"), ["bucket"], BUCKET_SALTS)
                .where((F.col("doc_id") < F.col("other")) if few else (F.col("doc_id") != F.col("other")))
                .where("label != other_label")
                .select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b"))
                .distinct()
            )
        else:
            pairs = filtered_pairs(texts.join(at.select("doc_id", "label").distinct(), "doc_id"), least, weighted)
            pairs = sharing_a_bucket(pairs, at)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = staged(pairs, "pairs")
        fresh = staged(_checked(pairs, texts, least, weighted).select("a", "b"), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = fresh if links is None else links.unionByName(fresh)
        labels = components(links)
        if few:
            break
    named = members if labels is None else members.join(labels, members["head"] == labels["node"], "left").select(
        "doc_id", F.coalesce("label", "head").alias("head")
    )
    return sketches.select("doc_id", "n_words").join(named.select("doc_id", F.col("head").alias("class_of")), "doc_id", "left")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """``(doc_id, class_id, n_words)``, one row per row of ``docs``."""
    return _classes(docs, least, weighted).select("doc_id.id", F.coalesce("class_of.id", "doc_id.id").alias("class_id"), "n_words").withColumnRenamed("id", "doc_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of ``docs`` that names its class (one, if it is repeated), and all rows without an id.

    Columns travel as one struct, so no name of theirs can clash.
    """
    found = _classes(docs, SIMILARITY, False).where("doc_id.id is not null and (class_of is null or class_of = doc_id)")
    names = staged(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies")), "names")
    rows = docs.select(F.struct(*docs.columns).alias("row"), _document().alias("doc_id"))
    kept = rows.join(names, "doc_id")
    once, again = kept.where("copies = 1"), kept.where("copies > 1").dropDuplicates(["doc_id"])
    named = once.select("row").unionByName(again.select("row"))
    return named.unionByName(rows.where("doc_id.id is null").select("row")).select("row.*")


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
