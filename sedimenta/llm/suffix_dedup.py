"""Removal of repeated byte strings with suffix arrays built by two-stage sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts
earlier: in a document of smaller id, or earlier in the same document.

Each window of ``LENGTH`` bytes is filed under its anchor, the short string in
it with the smallest hash; a run of windows with one anchor is a segment.
Equal windows have equal anchors, so a segment whose anchor occurs once in the
corpus holds no repeat and is dropped.  Copies of whole segments are
aggregated before anything moves: all but the earliest go, and one of each
content is left.  These are dealt by anchor into shards of bounded size; a
shard sorts its suffixes in two stages (suffixes smaller than their successor
directly, all others induced from them bucket by bucket), computes common
prefixes of neighbours, and in every interval of windows with ``LENGTH`` equal
bytes all but the earliest go.

An anchor with very many contents is cut finer first.  Its windows are filed
by the anchor's place in them, ``STEP`` neighbouring places together, and by
the bytes that all windows of such a file share: equal windows have equal
anchors at equal places, so they still meet, while different surroundings part.
Equal pieces are aggregated like segments.  Where even that leaves more than a
shard's bound, which takes as many texts that agree in all but a few bytes, the
pieces are dealt over several shards, and the earliest windows of these are
compared once more by their content's digest.

Null and empty texts, and texts under ``LENGTH`` bytes, keep all they have.
A document is an id with a text (its 64-bit hash): rows with equal ids and
texts are copies of one document at one place, and their strings do not count
as earlier than each other.  Documents with equal ids and different texts
follow each other by the texts' hashes.  A null id sorts last.  Other columns
are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import operator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import chunks, mix, powers, span_hashes
from .common import bound_batches, staged, table

LENGTH = 100
GRAM = 24
_PLACE = 26  # bits of a place in a block
BLOCK = 2 << 20
#: Bound of the contents of one anchor that a shard sorts; an anchor with more is cut finer.
SHARD_SEGMENTS = 25_000
#: Places of an anchor that are filed together when it is cut finer.
STEP = 10
LAST = (1 << 63) - 1
DOCUMENT = ["doc_id", "text_id"]


def segments_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """``(anchor, segment hash, text, start, windows, anchor's place from start)`` of every run of windows with one anchor."""
    none = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4]
    n = len(data)
    if n < length:
        return none
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    grams = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    low = (grams >> np.uint64(_PLACE)) << np.uint64(_PLACE) | np.arange(len(grams), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    inside = np.zeros(n - length + 1, bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= length:
            inside[a : b - length + 1] = True
    at = np.flatnonzero(inside)
    if not len(at):
        return none
    place = (low[at] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(fresh)
    windows = np.diff(np.append(head, len(at)))
    start = at[head]
    text = np.searchsorted(offsets, start, "right") - 1
    hashes = span_hashes(data, start, start + windows + length - 1)
    return [grams[place[head]], hashes, text, start - offsets[text], windows, place[head] - start]


def finer(parts: list[bytes], length: int = LENGTH, step: int = STEP):
    """``(key, hash, segment, begin, end)`` of the pieces of segments, cut where the anchor's place passes a multiple of ``step``."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    anchor, _, seg, at, windows, place = segments_of(data, offsets, length)
    at = offsets[seg] + at
    lowest, highest = (place - windows + 1) // step, place // step
    many = highest - lowest + 1
    of = np.repeat(np.arange(len(seg)), many)
    group = lowest[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    first = np.maximum(place[of] - (group + 1) * step + 1, 0)  # windows whose anchor's place is in the group
    last = np.minimum(place[of] - group * step, windows[of] - 1)
    begin, end = at[of] + first, at[of] + last + length
    core = at[of] + place[of] - group * step
    shared = span_hashes(data, core, core + length - step + 1)
    key = mix(mix(anchor[of] ^ mix(group.astype(np.uint64) + np.uint64(1))) ^ shared)
    return key, span_hashes(data, begin, end), seg[of], begin - offsets[seg[of]], end - offsets[seg[of]]


def _blocks(data: np.ndarray, offsets: np.ndarray, length: int):
    """Blocks of a chunk; one very long text is cut into blocks that overlap by a window less a byte."""
    if len(offsets) > 2 or len(data) <= BLOCK:
        yield data, offsets, 0
        return
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK + length - 1]
        yield part, np.array([0, len(part)]), at


def anchors(length: int = LENGTH, only_anchor: bool = False):
    """A ``mapInArrow`` function: ``(doc_id, text_id, text)`` to segments."""

    def run(batches):
        for b in batches:
            for row, nxt, data, at in chunks(b.column("text")):
                ids, texts = (b.column(c).slice(row, nxt - row) for c in ("doc_id", "text_id"))
                for part, offsets, shift in _blocks(data, at, length):
                    anchor, seg, text, start, windows, _ = segments_of(part, offsets, length)
                    if only_anchor:
                        yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64))], ["anchor"])
                        continue
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(anchor.view(np.int64)),
                            pa.array(seg.view(np.int64)),
                            ids.take(pa.array(text)),
                            texts.take(pa.array(text)),
                            pa.array(start + shift),
                            pa.array(windows.astype(np.int32)),
                        ],
                        ["anchor", "seg", "doc_id", "text_id", "start", "windows"],
                    )

    return run


def two_stage_order(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """``places`` in the order of the ``length`` bytes that follow each.

    A suffix is smaller than its successor if the first byte that differs from
    its own first is larger; in the last run of ``data`` all count as smaller.
    Only smaller ones are sorted directly.  A larger one stands before these in
    the bucket of its first byte: shorter runs of that byte first, and equal
    runs in the order of the successors, which are placed already.  Successors
    that are no ``places`` are sorted along, up to the first smaller one.
    """
    head = np.concatenate([[0], np.flatnonzero(data[1:] != data[:-1]) + 1])
    runs = np.diff(np.append(head, len(data)))
    rising = np.append(data[head[1:]] > data[head[:-1]], True)
    smaller, left = np.repeat(rising, runs), np.repeat(head + runs, runs) - np.arange(len(data))
    larger = places[~smaller[places]]
    ends = np.flatnonzero(smaller)
    steps = np.bincount(larger, minlength=len(data) + 1) - np.bincount(ends[np.searchsorted(ends, larger)] + 1, minlength=len(data) + 1)
    along = np.cumsum(steps)[:-1] > 0
    along[places] = True
    own, induced = np.flatnonzero(along & smaller), np.flatnonzero(along & ~smaller)
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    own = own[np.argsort(np.ascontiguousarray(view[own]).view(f"S{length}").ravel(), kind="stable")]
    induced = induced[np.lexsort((left[induced], data[induced]))]
    layer = data[induced].astype(np.int64) * (len(data) + 1) + left[induced]
    rank = np.zeros(len(data), np.int32)
    out, done = [], 0
    edges = np.searchsorted(data[own].astype(np.int64), np.arange(257))
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(layer)) + 1, [len(layer)]])
    byte_of = np.searchsorted(cuts[:-1], np.searchsorted(layer, np.arange(257) * (len(data) + 1)))
    for byte in range(256):
        for k in range(byte_of[byte], byte_of[byte + 1]):
            mine = induced[cuts[k] : cuts[k + 1]]
            mine = mine[np.argsort(rank[mine + 1], kind="stable")]
            rank[mine] = np.arange(done, done + len(mine))
            done += len(mine)
            out.append(mine)
        mine = own[edges[byte] : edges[byte + 1]]
        rank[mine] = np.arange(done, done + len(mine))
        done += len(mine)
        out.append(mine)
    order = np.concatenate(out)
    asked = np.zeros(len(data), bool)
    asked[places] = True
    return order[asked[order]]


def common_prefixes(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Equal leading bytes, up to ``length``, of each place and the one before it."""
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    out = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 50_000):
        end = min(at + 50_000, len(order))
        differ = view[order[at:end]] != view[order[at - 1 : end - 1]]
        out[at:end] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    return out


def repeats(parts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int = LENGTH):
    """``(segment, offset, earliest)`` of every window, and its class.

    ``parts`` are segments: each has a window at every offset that leaves
    ``length`` bytes.  Returns arrays (segment, offset, class, is_earliest).
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts) + bytes(2 * length), np.uint8)
    base = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    seg = np.repeat(np.arange(len(parts)), windows)
    offset = np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows)
    places = base[seg] + offset
    owner, shift = np.zeros(len(data), np.int32), np.zeros(len(data), np.int32)
    owner[places], shift[places] = seg, offset
    order = two_stage_order(data, places, length)
    group = np.cumsum(common_prefixes(data, order, length) < length)
    s, o = owner[order], shift[order]
    by = np.lexsort((start[s] + o, doc[s], group))
    first = np.ones(len(by), bool)
    first[1:] = group[by][1:] != group[by][:-1]
    return s[by], o[by], group[by], first


def _runs(seg: np.ndarray, offset: np.ndarray, length: int):
    order = np.lexsort((offset, seg))
    seg, offset = seg[order], offset[order]
    fresh = np.ones(len(seg), bool)
    fresh[1:] = (seg[1:] != seg[:-1]) | (offset[1:] > offset[:-1] + length)
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(seg)) - 1
    return seg[head], offset[head], offset[tail] + length


def sort_shard(length: int = LENGTH):
    """An ``applyInArrow`` function over one shard: removed spans, and earliest windows of split anchors."""

    def run(t: pa.Table) -> pa.Table:
        parts = t.column("bytes").to_pylist()
        ids, texts, start = (t.column(c).to_numpy() for c in ("doc_id", "text_id", "start"))
        doc = np.unique(np.stack([ids, texts], axis=1), axis=0, return_inverse=True)[1].ravel()  # in order of both
        split = t.column("split").to_numpy(zero_copy_only=False).astype(bool)
        s, o, _, first = repeats(parts, doc, start, length)
        rs, ra, rb = _runs(s[~first], o[~first], length) if (~first).any() else (np.zeros(0, np.int64),) * 3
        again = first & split[s]
        es, eo = s[again], o[again]
        digests = [hashlib.blake2b(parts[i][j : j + length], digest_size=16).digest() for i, j in zip(es, eo, strict=True)]
        return pa.table(
            {
                "doc_id": pa.array(np.concatenate([ids[rs], ids[es]]), pa.int64()),
                "text_id": pa.array(np.concatenate([texts[rs], texts[es]]), pa.int64()),
                "begin": pa.array(np.concatenate([start[rs] + ra, start[es] + eo]), pa.int64()),
                "end": pa.array(np.concatenate([start[rs] + rb, start[es] + eo + length]), pa.int64()),
                "content": pa.array([None] * len(rs) + digests, pa.binary()),
            }
        )

    return run


def squeezed(batches):
    for b in batches:
        press = zstandard.ZstdCompressor(level=3)
        texts = [press.compress((x or "").encode()) for x in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("text_id"), pa.array(texts, pa.binary())], ["doc_id", "text_id", "packed"]
        )


def cut_segments(length: int, most: int):
    """A ``mapInArrow`` function: packed texts and their segments' places to the segments' bytes.

    Segments of an anchor with more than ``most`` contents come as finer pieces, with a hash ``piece``.
    """

    def run(batches):
        for b in batches:
            press = zstandard.ZstdDecompressor()
            for i, (packed, wanted) in enumerate(zip(b.column("packed"), b.column("wanted"), strict=True)):
                text, wanted = press.decompress(packed.as_py()), wanted.values
                start, windows, segs = (wanted.field(c).to_numpy() for c in ("start", "windows", "segs"))
                parts = [text[s : s + w + length - 1] for s, w in zip(start.tolist(), windows.tolist(), strict=True)]
                plain, many = np.flatnonzero(segs <= most), np.flatnonzero(segs > most)
                anchor, begin, piece = wanted.field("anchor").to_numpy()[plain], start[plain], [None] * len(plain)
                cut = [parts[k] for k in plain]
                if len(many):
                    key, own, seg, a, e = finer([parts[k] for k in many], length)
                    anchor = np.concatenate([anchor, key.view(np.int64)])
                    begin = np.concatenate([begin, start[many][seg] + a])
                    piece += own.view(np.int64).tolist()
                    cut += [parts[many[k]][x:y] for k, x, y in zip(seg.tolist(), a.tolist(), e.tolist(), strict=True)]
                segs = np.concatenate([segs[plain], np.zeros(len(cut) - len(plain), np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor, pa.int64()),
                        *(pa.array([b.column(c)[i].as_py()] * len(cut), pa.int64()) for c in ("doc_id", "text_id")),
                        pa.array(begin, pa.int64()),
                        pa.array(segs, pa.int64()),
                        pa.array(piece, pa.int64()),
                        pa.array(cut, pa.binary()),
                    ],
                    ["anchor", "doc_id", "text_id", "start", "segs", "piece", "bytes"],
                )

    return run


def without_spans(batches):
    """A ``mapInArrow`` function: packed texts and removed spans to what is kept."""
    for b in batches:
        press = zstandard.ZstdDecompressor()
        rows = []
        for packed, spans in zip(b.column("packed"), b.column("spans").to_pylist(), strict=True):
            text = press.decompress(packed.as_py())
            kept, at, removed, runs = [], 0, 0, 0
            for s, e in sorted((x["begin"], x["end"]) for x in spans or []):
                if e <= at:
                    continue
                if s > at or not runs:
                    runs += 1
                kept.append(text[at : max(s, at)])
                removed += e - max(s, at)
                at = e
            kept = b"".join(kept) + text[at:]
            rows.append((len(text), removed, runs, kept))
        n, removed, runs, kept = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def _elsewhere(at: str):
    """Whether a place is another than its ``lead``."""
    return functools.reduce(operator.or_, (F.col(c) != F.col(f"lead.{c}") for c in (*DOCUMENT, at)))


def removed_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, text_id, begin, end)``: spans to remove; they may touch and overlap.

    ``docs``: doc_id long, text_id long, text, no nulls.
    """
    every = docs.mapInArrow(anchors(length, only_anchor=True), "anchor long")
    # Counts are staged before they are joined: only then can adaptive execution split an anchor that very many rows have.
    shared = staged(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "shared")
    schema = "anchor long, seg long, doc_id long, text_id long, start long, windows int"
    found = staged(docs.mapInArrow(anchors(length), schema).join(shared, "anchor", "left_semi"), "segments")
    lead = F.min(F.struct(*DOCUMENT, "start", "windows")).alias("lead")
    contents = staged(found.groupBy("anchor", "seg").agg(lead, F.count(F.lit(1)).alias("n")), "contents")
    copies = (
        found.join(contents.where("n > 1").select("anchor", "seg", "lead"), ["anchor", "seg"])
        .where(_elsewhere("start"))
        .select(*DOCUMENT, F.col("start").alias("begin"), (F.col("start") + F.col("windows") + (length - 1)).alias("end"))
    )
    several = staged(contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("segs")).where("segs > 1"), "several")
    leads = contents.join(several, "anchor").select("anchor", "lead.*", "segs")
    wanted = leads.groupBy(DOCUMENT).agg(F.collect_list(F.struct("anchor", "start", "windows", "segs")).alias("wanted"))
    packed = docs.mapInArrow(squeezed, "doc_id long, text_id long, packed binary").dropDuplicates(DOCUMENT)
    cut = staged(
        packed.join(wanted, DOCUMENT).mapInArrow(
            cut_segments(length, SHARD_SEGMENTS), "anchor long, doc_id long, text_id long, start long, segs long, piece long, bytes binary"
        ),
        "suffixes",
    )
    finer_cut = cut.where("piece is not null").drop("segs")
    lead = F.min(F.struct(*DOCUMENT, "start", "bytes")).alias("lead")
    pieces = staged(finer_cut.groupBy("anchor", "piece").agg(lead, F.count(F.lit(1)).alias("n")), "pieces")
    piece_copies = (
        finer_cut.join(pieces.where("n > 1").select("anchor", "piece", "lead"), ["anchor", "piece"])
        .where(_elsewhere("start"))
        .select(*DOCUMENT, F.col("start").alias("begin"), (F.col("start") + F.length("bytes")).alias("end"))
    )
    several = staged(pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("segs")).where("segs > 1"), "several")
    columns = ["anchor", *DOCUMENT, "start", "segs", "bytes"]
    cut = cut.where("piece is null").select(columns).unionByName(pieces.join(several, "anchor").select("anchor", "segs", "lead.*").select(columns))
    shards = max(1, math.ceil(2 * cut.count() / SHARD_SEGMENTS))  # half full, with room for a large anchor
    salts = F.ceil(F.col("segs") / SHARD_SEGMENTS)
    dealt = cut.withColumn("split", salts > 1).withColumn(
        "shard", F.pmod(F.xxhash64("anchor", F.pmod(F.xxhash64(*DOCUMENT, "start"), salts)), F.lit(shards))
    )
    sorted_ = staged(
        dealt.groupBy("shard").applyInArrow(
            sort_shard(length), "doc_id long, text_id long, begin long, end long, content binary"
        ),
        "sorted",
    )
    early = sorted_.where("content is not null")
    firsts = early.groupBy("content").agg(F.min(F.struct(*DOCUMENT, "begin")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = (
        early.join(firsts, "content")
        .where(_elsewhere("begin"))
        .select(*DOCUMENT, "begin", "end")
    )
    return copies.unionByName(piece_copies).unionByName(sorted_.where("content is null").drop("content")).unionByName(later)


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` for each row of ``docs``; ``kept`` is what stays of the text."""
    bound_batches(docs.sparkSession)
    given = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("text_id", F.xxhash64("text"))
    spans = removed_spans(given, length).groupBy(DOCUMENT).agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    packed = given.mapInArrow(squeezed, "doc_id long, text_id long, packed binary")
    kept = packed.join(spans, DOCUMENT, "left").mapInArrow(
        without_spans, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
    return kept.withColumn("doc_id", F.when(F.col("doc_id") != LAST, F.col("doc_id")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
