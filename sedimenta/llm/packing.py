"""Best-fit packing of token sequences, improved by swap-based local search.

Texts become token ids; a text of more than ``size`` ids is cut into pieces of
``size``.  Pieces are dealt at random into shards of bounded size.  In a shard,
best fit in decreasing order opens the sequences, and local search then takes
pieces from the emptiest ones: moves, one-for-one and two-for-one exchanges
that raise the sum of squared fills, until sequences come empty.  Sequences
that stay underfull give their pieces back, and these are dealt again into
fewer shards of the same bound.  When a round hardly lowers their number, or
one shard holds all that are left, every shard closes what it has, underfull
sequences too.  So no task ever sees more than about a shard's bound.

A tokenizer with the settings that ``_SETTINGS`` states never joins characters
across white space, so a text is the concatenation of its white-space-separated
chunks; chunks are encoded once per task and kept in a cache of bounded size.
With any other tokenizer file, whole texts are encoded as they are.  A chunk of printable
ASCII and Latin-1 letters is cut and mapped to byte symbols here, and only its
new pieces go through the tokenizer's model; any other chunk is encoded by the
tokenizer.  Texts with control characters on which Unicode and the tokenizer
differ are encoded whole.

Null and empty texts have the end id alone.  Repeated rows are packed each.
Other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import math
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, staged, table

SIZE = 4096
END_ID = 1
SHARD_PIECES = 20_000
CACHE_WORDS = 200_000
#: Characters of texts that are encoded at once.
SLICE_CHARS = 1 << 18
#: A sequence with more free places than this gives its pieces back between rounds.
LOOSE = 64
#: How many of the emptiest sequences local search looks at for each underfull one.
DONORS = 24
PASSES = 6
#: A round that leaves more than this share of its shards is followed by the last.
SHRINK = 0.9

# The tokenizer's word pattern and byte symbols, over the characters of plain chunks.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SYMBOLS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}

# The settings of a tokenizer file for which texts may be cut into chunks.
_SETTINGS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

_tokenizers: dict[str, tuple] = {}


def cuts_at_spaces(settings: dict) -> bool:
    """Whether a tokenizer file has the settings for which texts may be cut, and no added token that a plain chunk can hold."""
    added = [t["content"] for t in settings.get("added_tokens", [])]
    return all(settings.get(k) == v for k, v in _SETTINGS.items()) and all("<|" in x for x in added)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _worker(path: str) -> tuple:
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            cut = cuts_at_spaces(json.load(f))
        _tokenizers[path] = (tokenizer, tokenizer.model if cut else None, {}, {})
    return _tokenizers[path]


def release() -> None:
    """Forget the tokenizers and caches of this worker: Spark keeps it for other stages, which have no use for them."""
    _tokenizers.clear()


def slices(texts: Iterable[str], most: int | None = None) -> Iterator[list[str]]:
    """Runs of texts that end with the one that brings them to ``most`` characters."""
    part, size, most = [], 0, most or SLICE_CHARS
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def encode(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian 32-bit numbers."""
    tokenizer, model, cache, known = _worker(path)
    if model is None:
        return [_bytes(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    split, whole = [], []
    for i, text in enumerate(texts):
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        split.append([] if odd else text.split())
        if odd:
            whole.append(i)
    if len(cache) > CACHE_WORDS:
        cache.clear()
        known.clear()
    rest = []
    for chunk in set().union(*split):
        if chunk in cache:
            continue
        if "<|" in chunk or not _PLAIN.fullmatch(chunk):
            rest.append(chunk)
            continue
        ids = b""
        for piece in _PIECES.findall(chunk.lower()):
            if piece not in known:
                symbols = piece if piece.isascii() else "".join(map(_SYMBOLS.__getitem__, piece.encode()))
                known[piece] = _bytes([t.id for t in model.tokenize(symbols)])
            ids += known[piece]
        cache[chunk] = ids
    for at in range(0, len(rest), 4096):
        part = rest[at : at + 4096]
        for chunk, found in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
            cache[chunk] = _bytes(found.ids)
    out = [b"".join(map(cache.__getitem__, words)) for words in split]
    for i in whole:
        out[i] = _bytes(tokenizer.encode(texts[i], add_special_tokens=False).ids)
    return out


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every text with its end id."""
    bound_batches(docs.sparkSession)
    end = _bytes([end_id])

    def piece_rows(texts):
        row = 0
        for part in slices(t.as_py() or "" for t in texts):
            for row, ids in enumerate(encode(part, path), row):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * size)):
                    piece = ids[at : at + 4 * size]
                    yield row, n, at // 4, len(piece) // 4, zlib.crc32(piece)
            row += 1

    def run(batches):
        try:
            for b in batches:
                rows = list(piece_rows(b.column("text")))
                row, n, start, length, crc = zip(*rows, strict=True) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(pa.array(row, pa.int64())),
                        pa.array(n, pa.int32()),
                        *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        finally:
            release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Sequences of piece numbers: each piece, longest first, goes where it leaves least room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if some sequence has r free places
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at = size, len(bins)
            bins.append([])
        bins[at].append(i)
        left = room - n
        if left:
            if not by_room.get(left):
                by_room[left] = []
                rooms |= 1 << left
            by_room[left].append(at)
    return bins


def _best_exchange(full: list[int], spare: list[int], lengths: list[int], room: int) -> tuple[int, list[int], list[int]] | None:
    """``(gain, out of full, out of spare)`` with the largest gain of at most ``room``.

    Pieces of one length are interchangeable, so distinct lengths are searched,
    and for a piece given and one of two taken the best other one is found by
    bisection.
    """
    by_length: dict[int, list[int]] = {}
    for i in spare:
        by_length.setdefault(lengths[i], []).append(i)
    ordered, best, chosen = sorted(by_length), 0, None
    for off, a in {0: None, **{lengths[i]: i for i in full}}.items():
        most = room + off
        if best == room or not ordered:
            break
        at = bisect.bisect_right(ordered, most) - 1
        if at >= 0 and ordered[at] - off > best:
            best, chosen = ordered[at] - off, (a, ordered[at], 0)
        for one in ordered:
            other = min(one, most - one)  # the second is not the longer one
            if one + other - off <= best and one + other < most:
                continue
            at = bisect.bisect_right(ordered, other) - 1
            if at >= 0 and ordered[at] == one and len(by_length[one]) == 1:
                at -= 1
            if at >= 0 and one + ordered[at] - off > best:
                best, chosen = one + ordered[at] - off, (a, one, ordered[at])
                if best == room:
                    break
    if chosen is None:
        return None
    a, one, two = chosen
    into = [by_length[one][0]] + ([by_length[two][-1]] if two else [])
    return best, [] if a is None else [a], into


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int, passes: int = PASSES) -> list[list[int]]:
    """Exchanges between underfull sequences that raise the sum of squared fills; emptied ones go."""
    sizes = lengths.tolist()
    fill = [sum(sizes[i] for i in b) for b in bins]
    for _ in range(passes):
        loose = sorted((k for k in range(len(bins)) if 0 < fill[k] < size), key=fill.__getitem__)
        if len(loose) < 2 or sum(fill[k] for k in loose) > (len(loose) - 1) * size:
            break  # no sequence can come empty
        changed = False
        low = 0
        for at in range(len(loose) - 1, 0, -1):
            a = loose[at]
            while fill[a] < size:
                while low < at and not fill[loose[low]]:
                    low += 1
                best = None
                for b in loose[low : min(at, low + DONORS)]:
                    if fill[b] > fill[a] or not fill[b]:
                        continue
                    found = _best_exchange(bins[a], bins[b], sizes, size - fill[a])
                    if found and (best is None or found[0] > best[1][0]):
                        best = (b, found)
                    if best and best[1][0] == size - fill[a]:
                        break
                if best is None:
                    break
                b, (gain, out, into) = best
                gone, come = set(out), set(into)
                bins[a] = [i for i in bins[a] if i not in gone] + into
                bins[b] = [i for i in bins[b] if i not in come] + out
                fill[a] += gain
                fill[b] -= gain
                changed = True
        if not changed:
            break
    return [b for b in bins if b]


def _pack_shard(size: int, level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy(np.int64)
        bins = local_search(best_fit(lengths, size), lengths, size)
        name, offset = np.full(len(pdf), -1, np.int64), np.zeros(len(pdf), np.int64)
        first = (level << 56) | (int(pdf["shard"].iloc[0]) << 24)
        for k, b in enumerate(bins):
            if not last and lengths[b].sum() < size - LOOSE:
                continue
            name[b] = first + k
            offset[b] = np.cumsum(lengths[b]) - lengths[b]
        return pdf.assign(sequence_id=name, offset=offset).drop(columns="shard")

    return run


def pack(found: DataFrame, size: int = SIZE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``found`` (with ``length``) with ``sequence_id`` and ``offset``."""
    left, done, level = staged(found, "pieces"), None, 0
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields)
    shards = max(1, math.ceil(left.count() / shard_pieces))
    last = shards == 1
    while True:
        dealt = left.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
        packed = staged(
            dealt.groupBy("shard").applyInPandas(
                _pack_shard(size, level, last), schema + ", sequence_id long, offset long"
            ),
            "packed",
        )
        placed = packed.where("sequence_id >= 0")
        done = placed if done is None else done.unionByName(placed)
        if last:
            return done
        left = packed.where("sequence_id < 0").drop("sequence_id", "offset")
        fewer = max(1, math.ceil(left.count() / shard_pieces))
        last = fewer == 1 or fewer > SHRINK * shards
        shards, level = fewer, level + 1


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces(table(spark, sf_dir, "documents"), tokenizer_path())
    return pack(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
