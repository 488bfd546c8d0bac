"""Benchmark decontamination with suffix arrays over the training texts.

Distinct benchmark items are read in blocks of bounded size, and one block's
word windows at a time are built and broadcast.  A benchmark of up to one block
is found in one pass over the corpus; between blocks the texts with what was
found go to the shared folder.  Every task takes its texts a shard at a time,
keeps the word suffixes that start like some window (their first words are a run
that the benchmark holds), sorts them into a suffix array and finds every
benchmark suffix that starts like one of them in it by binary search: the range
of training suffixes with that prefix gives all places where it occurs.
Neighbouring windows on one diagonal are joined into longest verbatim matches.
A shard costs what its own suffixes need, however large the block is.

A window is 13 consecutive words of an item; an item of fewer words, but not
none, is one window.  Words are runs of ASCII letters and digits, in lower
case, and of characters beyond ASCII.  A word inside an occurrence is hit; a
document is contaminated if words are hit and they are at least a twentieth of
its words.  Null and empty texts have no words and are clean.  Repeated rows
each get a row; items with null ids count under the empty id; without items
nothing is hit.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import ALNUM, Words, chunks, mix, words_of
from .common import bound_batches, staged, table, whole_rows, with_id

WINDOW = 13
LEADING = 5
#: Bound of the benchmark texts of a block, which is broadcast in a form of about twice that size; one pass over the corpus for each.
BLOCK_BYTES = 128 << 20
#: Benchmark bytes of which words are cut at once, and windows searched at once in a shard's suffix array.
BUILD_BYTES = 4 << 20
SEARCHED = 1 << 16

SPANS = "array<struct<item_id:string,start:long,item_start:long,words:long>>"
_SPAN = pa.list_(
    pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("item_start", pa.int64()), ("words", pa.int64())])
)


def _lead(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """32 bits of a hash of the ``n`` words at each place."""
    h = np.zeros(len(at), np.uint64)
    for i in range(n):
        h = mix(h ^ ids[at + i].astype(np.uint64))
    return (h >> np.uint64(32)).astype(np.uint32)


def _keys(ids: np.ndarray, at: np.ndarray, limit: np.ndarray, pad: int = 0) -> np.ndarray:
    """The next words' numbers of each place, as fixed-width strings that compare in word order."""
    out = np.full((len(at), WINDOW), pad, ">u4")
    for i in range(WINDOW):
        fits = at + i < limit
        out[fits, i] = ids[(at + i)[fits]]
    return out.view(f"S{4 * WINDOW}").ravel()


class Block:
    """The windows of some benchmark items, ready for search.

    Per benchmark word it holds a number and, for the window that begins there,
    its place and a hash of its leading words, in the order of those hashes.
    """

    def __init__(self, items: list[tuple[str, bytes]]):
        self.items = [x[0] for x in items]
        texts = pa.array([x[1] for x in items], pa.large_binary())
        parts = [words_of(data, at) for _, _, data, at in chunks(texts, BUILD_BYTES)]
        hashes = np.concatenate([np.zeros(0, np.uint64), *[w.hashes for w in parts]])
        counts = np.concatenate([np.zeros(1, np.int64), *[np.diff(w.first) for w in parts]])
        self.first = np.cumsum(counts)  # of each item, the index of its first word; one more at the end
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        self.ids = (ids + 1).astype(np.uint32)
        words = counts[1:]
        self.windows: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for n in np.unique(np.minimum(words[words > 0], WINDOW)).tolist():
            many = np.where(words >= WINDOW, words - WINDOW + 1, 0) if n == WINDOW else (words == n).astype(np.int64)
            begin = np.repeat(self.first[:-1] - (np.cumsum(many) - many), many)
            place = (begin + np.arange(len(begin))).astype(np.uint32)
            lead = _lead(self.ids, place, min(n, LEADING))
            order = np.argsort(lead, kind="stable")
            self.windows[n] = (min(n, LEADING), lead[order], place[order])

    def nbytes(self) -> int:
        return self.vocabulary.nbytes + self.ids.nbytes + self.first.nbytes + sum(a.nbytes + b.nbytes for _, a, b in self.windows.values())

    def matches(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(word, place of the window in the block, its words)`` of every occurrence of a window in a shard of texts."""
        none = np.zeros(0, np.int64)
        if not len(w.hashes) or not len(self.vocabulary):
            return none, none, none
        at = np.minimum(np.searchsorted(self.vocabulary, w.hashes), len(self.vocabulary) - 1)
        ids = np.where(self.vocabulary[at] == w.hashes, at + 1, 0)
        ids = np.concatenate([ids, np.zeros(WINDOW, np.int64)])
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        last = w.first[1:][w.doc]
        place, starts = np.arange(len(w.hashes)), np.zeros(len(w.hashes), bool)
        wanted: list[tuple[int, np.ndarray]] = []
        for n, (k, leads, windows) in self.windows.items():
            p = place[(place + n <= last) & (known[place + n] - known[place] == n)]
            lead = _lead(ids, p, k)
            here = leads[np.minimum(np.searchsorted(leads, lead), len(leads) - 1)] == lead
            starts[p[here]] = True
            lead = np.unique(lead[here])
            low, high = np.searchsorted(leads, lead, "left"), np.searchsorted(leads, lead, "right")
            wanted.append((n, windows[_ranges(low, high - low)]))
        p = np.flatnonzero(starts)
        if not len(p):
            return none, none, none
        keys = _keys(ids, p, last[p])
        suffixes = np.argsort(keys, kind="stable")  # the shard's suffix array
        keys = keys[suffixes]
        found = [(none, none, none)]
        for n, windows in wanted:
            for i in range(0, len(windows), SEARCHED):
                at = windows[i : i + SEARCHED].astype(np.int64)
                low = np.searchsorted(keys, _keys(self.ids, at, at + n), "left")
                high = np.searchsorted(keys, _keys(self.ids, at, at + n, 0xFFFFFFFF), "right")
                many = np.maximum(high - low, 0)
                found.append((p[suffixes[_ranges(low, many)]], np.repeat(at, many), np.full(int(many.sum()), n)))
        word, window, size = (np.concatenate(x) for x in zip(*found, strict=True))
        return word, window, size


def _ranges(low: np.ndarray, many: np.ndarray) -> np.ndarray:
    """``low``, ``low + 1`` and so on, ``many`` numbers of each."""
    return np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


def _joined(block: Block, w: Words, word: np.ndarray, window: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """Longest matches ``(text, item, first word in text, in item, words)``."""
    if not len(word):
        return
    text, item = w.doc[word], np.searchsorted(block.first, window, "right") - 1
    start, item_at = word - w.first[text], window - block.first[item]
    order = np.lexsort((start, start - item_at, item, text))
    text, item, start, item_at, size = (x[order] for x in (text, item, start, item_at, size))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(start - item_at) != 0) | (np.diff(start) > 1)
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(order)) - 1
    for h, t in zip(heads, tails, strict=True):
        yield int(text[h]), int(item[h]), int(start[h]), int(item_at[h]), int(start[t] + size[t] - start[h])


def search(block: Block, last: bool):
    """A ``mapInArrow`` function: adds the block's matches to ``spans``; at last counts words."""

    def run(batches):
        for b in batches:
            texts, before = b.column("text"), b.column("spans")
            for row, nxt, data, at in chunks(texts):
                w = words_of(data, at, ALNUM)
                found: dict[int, list] = {}
                for text, item, start, item_at, n in _joined(block, w, *block.matches(w)):
                    found.setdefault(text, []).append(
                        {"item_id": block.items[item], "start": start, "item_start": item_at, "words": n}
                    )
                earlier = before.slice(row, nxt - row).to_pylist()
                spans = [[*(e or []), *found.get(i, [])] for i, e in enumerate(earlier)]
                out = {"doc_id": b.column("doc_id").slice(row, nxt - row), "spans": pa.array(spans, _SPAN)}
                if last:
                    out["n_words"] = pa.array(np.diff(w.first), pa.int64())
                    out["n_hit"] = pa.array([_covered(s) for s in spans], pa.int64())
                else:
                    out["text"] = texts.slice(row, nxt - row)
                yield pa.RecordBatch.from_pydict(out)

    return run


def _covered(spans: list[dict]) -> int:
    total, done = 0, 0
    for s in sorted((s["start"], s["start"] + s["words"]) for s in spans):
        total += max(0, s[1] - max(s[0], done))
        done = max(done, s[1])
    return total


def blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """How many blocks of about ``block_bytes`` bytes of distinct items there are, and the blocks, read one at a time."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    total = items.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    n = max(1, math.ceil(total / block_bytes))
    parts = (items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n))
    return n, ([(r.item_id, r.text.encode()) for r in part.collect()] for part in parts)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, spans, n_words, n_hit)`` for each row of ``docs``."""
    bound_batches(docs.sparkSession)
    at = docs.select("doc_id", "text", F.array().cast(SPANS).alias("spans"))
    many, found = blocks(benchmark, BLOCK_BYTES)
    for i, items in enumerate(found):
        last = i + 1 == many
        schema = with_id(docs, f"spans {SPANS}, " + ("n_words long, n_hit long" if last else "text string"))
        at = at.mapInArrow(search(Block(items), last), schema)
        if not last:
            at = staged(at, "searched")
    return at


def contaminated(share: int = 20):
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    return contamination(whole_rows(docs), benchmark).where(~contaminated()).select("doc_id.*")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"])))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
         lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
         lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(list_slice(w, p, p + least(13, len(w)) - 1), ' ') AS k
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, p, places.n, item FROM places JOIN wins USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
