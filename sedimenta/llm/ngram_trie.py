"""Language-model scores from an Elias-Fano n-gram trie of words, three levels deep.

Level one holds the training words, as the sorted sequence of their hashes,
with exact counts (the contract's base needs them) and quantised
probabilities; a word's number is its place.  Level two holds, for every
context word in order, the numbers of the words seen after it, level three the
same for every pair of level two.  Numbers are relative to their context: each
range begins where the one before ended, so a level is one monotone sequence
whose universe grows with what was seen, with monotone pointers to each
context's range and a quantised discounted probability for each entry.  An
entry's number, its place in its level, is its context number one level down.
Levels are cut into shards of bounded size that are files in the shared folder;
scoring maps those that it needs into memory, reads a context's two pointers,
and finds the word by successor search between them.  A context that very many
words follow is split over shards.

    p(w | u v) = discounted(u v, w) + left(u v) * p(w | v)
    p(w | v) = discounted(v, w) + left(v) * p(w)
    discounted = (count - D) / count(context),  left = D * successors / count(context)
    p(w) = (count + 1) / (N + V + 1)

which sums to one over all training words and one unknown word.  The first
word of a text has the start as its only context.  All training texts are
counted: every task counts its own entries first and sends sorted, delta-coded
blocks by shard.

Null and empty texts are the end token alone.  Without training texts every
probability is one.  A null id counts as training.  Repeated rows each get a
row.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import SOLID, chunks, words_of
from .common import bound_batches, crc_mod, new_folder, table
from .elias_fano import EliasFano, saved

DISCOUNT = 0.75
SHARD_TOKENS = 4_000_000
#: Bytes of text that are looked up at once: each shard that they hit costs the same again.
LOOKUP_BYTES = 4 << 20
BUFFER_TOKENS = 4_000_000
#: Shards are cut at keys of a sample: of so many texts, or of so many tokens for each shard if that is more; one key in 16 is taken.
SAMPLE_TEXTS, SAMPLE_TOKENS = 1_000, 256
#: Steps of a quantised probability or count to a factor of ten.
STEPS = 4096
END = np.uint64(0x2545F4914F6CDD1D)


def _block(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted numbers and their counts, delta-coded."""
    steps = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(len(values).to_bytes(8, "little") + steps.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype(np.uint32).tobytes())


def _unblock(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n = int.from_bytes(raw[:8], "little")
    steps = np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n).T.copy().view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64), np.frombuffer(raw, np.uint32, n, 8 + 8 * n)


def _summed(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(values, return_counts=True)
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    head = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[head], np.add.reduceat(counts.astype(np.int64), head) if len(head) else np.zeros(0, np.int64)


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, text)`` of every token: the words of each text, then its end."""
    w = words_of(data, offsets, SOLID)
    texts = len(offsets) - 1
    where = w.first[1:] + np.arange(texts)
    out = np.empty(len(w.hashes) + texts, np.uint64)
    ends = np.zeros(len(out), bool)
    ends[where] = True
    out[ends], out[~ends] = END, w.hashes
    return out, np.repeat(np.arange(texts), np.diff(w.first) + 1)


def _runs(shard: np.ndarray):
    """``(shard, first, last)`` of each run in a sorted array of shard numbers."""
    if len(shard):
        head = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        yield from zip(shard[head].tolist(), head.tolist(), [*head[1:].tolist(), len(shard)], strict=True)


def _code(x: np.ndarray, up: bool = False) -> np.ndarray:
    """Logarithms in steps, of counts or of inverse probabilities."""
    steps = np.log10(x) * STEPS
    return np.minimum(np.ceil(steps) if up else np.rint(steps), 65535).astype(np.uint16)


def _value(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (code.astype(np.float64) / STEPS)


class Level:
    """The word level: shards by the leading bits of the hash."""

    def __init__(self, folder: str, sizes: list[int]):
        self.folder, self.shards = folder, len(sizes)
        self.bits = self.shards.bit_length() - 1
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.files: dict[int, tuple[EliasFano, np.ndarray, np.ndarray]] = {}

    def part(self, s: int) -> tuple[EliasFano, np.ndarray, np.ndarray]:
        if s not in self.files:
            path = f"{self.folder}/words-{s}"
            self.files[s] = EliasFano.load(path), *(np.load(f"{path}.{x}.npy", mmap_mode="r") for x in ("counts", "codes"))
        return self.files[s]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number (or -1), count, and quantised count plus one of each word."""
        own, back = np.unique(hashes, return_inverse=True)
        number, count, code = np.full(len(own), -1, np.int64), np.zeros(len(own), np.int64), np.zeros(len(own), np.uint16)
        for s, a, b in _runs(_word_shard(own, self.bits)):
            if self.first[s] == self.first[s + 1]:
                continue
            ef, counts, codes = self.part(s)
            at = ef.find(own[a:b] & np.uint64((1 << (64 - self.bits)) - 1))
            number[a:b] = np.where(at >= 0, at + self.first[s], -1)
            count[a:b] = np.where(at >= 0, counts[np.maximum(at, 0)], 0)
            code[a:b] = np.where(at >= 0, codes[np.maximum(at, 0)], 0)
        return number[back], count[back], _value(code)[back]

    def totals(self, numbers: np.ndarray) -> np.ndarray:
        """The counts of sorted word numbers."""
        out = np.zeros(len(numbers), np.float64)
        for s, a, b in _runs(np.searchsorted(self.first, numbers, "right") - 1):
            out[a:b] = self.part(s)[1][numbers[a:b] - self.first[s]]
        return out


def _word_shard(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def counter(keys_of: Callable, shard_of: Callable):
    """A ``mapInArrow`` function: texts to blocks of counted keys by shard."""

    def out(parts: list[np.ndarray]):
        keys, counts = _summed(np.concatenate(parts))
        runs = list(_runs(shard_of(keys)))
        blocks = [_block(keys[a:b], counts[a:b]) for _, a, b in runs]
        return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in runs], pa.int32()), pa.array(blocks, pa.binary())], ["shard", "block"])

    def run(batches):
        parts, held = [], 0
        for b in batches:
            for _, _, data, at in chunks(b.column("text"), LOOKUP_BYTES):
                parts.append(keys_of(token_hashes(data, at)[0]))
                held += len(parts[-1])
                if held > BUFFER_TOKENS:
                    yield out(parts)
                    parts, held = [], 0
        if parts:
            yield out(parts)

    return run


def sampler(keys_of: Callable):
    """A ``mapInArrow`` function: texts to bare keys."""

    def run(batches):
        for b in batches:
            for _, _, data, at in chunks(b.column("text"), LOOKUP_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(keys_of(token_hashes(data, at)[0]).view(np.int64))], ["key"])

    return run


def one_shard_a_task(blocks: DataFrame, shards: int) -> DataFrame:
    """Blocks placed by the number of their shard: its hash would put several shards into some tasks and none into others."""
    return blocks.repartitionById(shards, "shard")


def _gathered(t: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    parts = [_unblock(x) for x in t.column("block").to_pylist()]
    return t.column("shard")[0].as_py(), *_summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def build_words(folder: str, bits: int):
    """An ``applyInArrow`` function: one shard's blocks to its files."""

    def run(t: pa.Table) -> pa.Table:
        s, words, counts = _gathered(t)
        path = f"{folder}/words-{s}"
        EliasFano.build(words & np.uint64((1 << (64 - bits)) - 1), 1 << (64 - bits)).save(path)
        saved(f"{path}.counts.npy", counts)
        saved(f"{path}.codes.npy", _code(counts + 1.0))
        return pa.table({"shard": pa.array([s], pa.int32()), "n": [len(words)], "tokens": [int(counts.sum())]})

    return run


class Grams:
    """A level of entries ``context * width + word`` in shards by ranges of these.

    ``built``: of each shard its first and last context, its entries, and how
    many of them are of the first and of the last context.
    """

    def __init__(self, folder: str, name: str, width: int, cuts: list[int], built: dict[int, tuple[int, int, int, int, int]]):
        self.path, self.width, self.cuts, self.built = f"{folder}/{name}", width, np.array(cuts, np.uint64), built
        order = sorted(built)
        self.numbers = np.concatenate([[0], np.cumsum([built[s][2] for s in order])]).astype(np.int64)
        self.order, self.first = order, dict(zip(order, self.numbers[:-1].tolist(), strict=True))
        edges: dict[int, int] = {}
        for low, high, _, at_low, at_high in built.values():
            edges[low] = edges.get(low, 0) + at_low
            if high != low:
                edges[high] = edges.get(high, 0) + at_high
        self.edges = np.array(sorted(edges), np.int64)  # contexts that may be split, with all their successors
        self.at_edges = np.array([edges[c] for c in sorted(edges)], np.int64)
        self.files: dict[int, tuple] = {}

    def part(self, s: int) -> tuple[EliasFano, EliasFano, np.ndarray, np.ndarray]:
        if s not in self.files:
            path = f"{self.path}-{s}"
            arrays = (np.load(f"{path}.{x}.npy", mmap_mode="r") for x in ("codes", "totals"))
            self.files[s] = EliasFano.load(path), EliasFano.load(f"{path}.pointers"), *arrays
        return self.files[s]

    def shard_of(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, keys, "right")

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number (or -1), discounted probability (or 0) and quantised count of each of the sorted ``keys``."""
        number, p, total = np.full(len(keys), -1, np.int64), np.zeros(len(keys)), np.zeros(len(keys))
        for s, a, b in _runs(self.shard_of(keys)):
            if s not in self.built:
                continue
            ef, pointers, codes, totals = self.part(s)
            low, high = self.built[s][:2]
            context = (keys[a:b] // np.uint64(self.width)).astype(np.int64)
            here = np.flatnonzero((context >= low) & (context <= high))
            if not len(here):
                continue
            begin, end = (pointers.access(context[here] - low + i).astype(np.int64) for i in (0, 1))
            here, begin, end = here[begin < end], begin[begin < end], end[begin < end]
            if not len(here):
                continue
            base = np.where(begin > 0, ef.access(np.maximum(begin - 1, 0)), np.uint64(0))
            wanted = base + keys[a:b][here] % np.uint64(self.width)
            found = ef.find_between(np.minimum(wanted, ef.last), begin, end)
            seen = (found >= 0) & (wanted <= ef.last)
            at = found[seen]
            number[a + here[seen]] = self.first[s] + at
            p[a + here[seen]] = 1.0 / _value(codes[at])
            total[a + here[seen]] = _value(totals[at])
        return number, p, total

    def totals(self, numbers: np.ndarray) -> np.ndarray:
        """The quantised counts of sorted entry numbers."""
        out = np.zeros(len(numbers))
        for k, a, b in _runs(np.searchsorted(self.numbers, numbers, "right") - 1):
            s = self.order[k]
            out[a:b] = _value(self.part(s)[3][numbers[a:b] - self.first[s]])
        return out

    def successors(self, contexts: np.ndarray) -> np.ndarray:
        """How many different words follow each of the sorted ``contexts``."""
        out = np.zeros(len(contexts), np.int64)
        for s, a, b in _runs(self.shard_of(contexts.astype(np.uint64) * np.uint64(self.width))):
            if s not in self.built:
                continue
            low, high = self.built[s][:2]
            here = a + np.flatnonzero((contexts[a:b] >= low) & (contexts[a:b] <= high))
            pointers, at = self.part(s)[1], contexts[here] - low
            out[here] = (pointers.access(at + 1) - pointers.access(at)).astype(np.int64)
        if len(self.edges) and len(contexts):
            at = np.minimum(np.searchsorted(self.edges, contexts), len(self.edges) - 1)
            out = np.where(self.edges[at] == contexts, self.at_edges[at], out)
        return out


def build_grams(grams: Grams, totals_of: Callable, discount: float):
    """An ``applyInArrow`` function: one shard's blocks to its files; ``totals_of`` gives the counts of contexts."""
    width = grams.width

    def run(t: pa.Table) -> pa.Table:
        s, keys, counts = _gathered(t)
        context = (keys // np.uint64(width)).astype(np.int64)
        low, high = int(context[0]), int(context[-1])
        path = f"{grams.path}-{s}"
        own, begin, many = np.unique(context, return_index=True, return_counts=True)
        words = keys % np.uint64(width)
        ends = np.cumsum(words[begin + many - 1], dtype=np.uint64)  # each context's last number is the next one's base
        relative = words + np.repeat(np.concatenate([np.zeros(1, np.uint64), ends[:-1]]), many)
        EliasFano.build(relative, int(relative[-1]) + 1).save(path)
        pointers = np.zeros(high - low + 2, np.uint64)
        pointers[own - low + 1] = many
        EliasFano.build(np.cumsum(pointers, dtype=np.uint64), len(keys) + 1).save(f"{path}.pointers")
        of = np.repeat(np.arange(len(own)), many)
        saved(f"{path}.codes.npy", _code(totals_of(own)[of] / (counts - discount), up=True))
        saved(f"{path}.totals.npy", _code(counts.astype(np.float64)))
        told = {"low": low, "high": high, "n": len(keys), "at_low": int(many[0]), "at_high": int(many[-1])}
        return pa.table({"shard": pa.array([s], pa.int32()), **{k: [v] for k, v in told.items()}})

    return run


class Trie:
    """The three levels; ``texts`` is the count of the context before a first word, whose number is the last one."""

    def __init__(self, level: Level, width: int, texts: int):
        self.level, self.width, self.texts = level, width, texts
        self.pairs: Grams | None = None
        self.triples: Grams | None = None

    def pair_keys(self, number: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key of each token behind its predecessor, the predecessor's number (or -1), and whether both are known."""
        before = np.empty(len(number), np.int64)
        before[1:] = number[:-1]
        before[np.concatenate([[True], ends[:-1]])] = self.width - 1
        known = (number >= 0) & (before >= 0)
        return np.where(known, before, 0).astype(np.uint64) * np.uint64(self.width) + np.where(known, number, 0).astype(np.uint64), before, known

    def contexts(self, pair: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of the pair before each token, or -1."""
        out = np.full(len(pair), -1, np.int64)
        out[1:] = np.where(ends[:-1], -1, pair[:-1])
        return out

    def of_pairs(self, tokens: np.ndarray) -> np.ndarray:
        return self.pair_keys(self.level.find(tokens)[0], tokens == END)[0]

    def of_triples(self, tokens: np.ndarray) -> np.ndarray:
        number, ends = self.level.find(tokens)[0], tokens == END
        own, back = np.unique(self.pair_keys(number, ends)[0], return_inverse=True)
        context = self.contexts(self.pairs.lookup(own)[0][back], ends)
        some = context >= 0
        return context[some].astype(np.uint64) * np.uint64(self.width) + number[some].astype(np.uint64)

    def context_totals(self, contexts: np.ndarray) -> np.ndarray:
        """The counts of sorted contexts of one word, of which the start is the last."""
        words = contexts[contexts < self.width - 1]
        return np.append(self.level.totals(words), np.full(len(contexts) - len(words), float(self.texts)))


def _level(texts: DataFrame, trie: Trie, name: str, contexts: int, keys_of: Callable, totals_of: Callable, total: int, tokens: int, discount: float) -> Grams:
    """One level over the whole of ``texts``; its shards are cut at keys of a sample of them."""
    folder, width = trie.level.folder, trie.width
    if contexts * width >= 1 << 64:
        raise OverflowError(f"{contexts} contexts of {width} words do not fit 64-bit keys")
    parts = max(1, tokens // SHARD_TOKENS)
    share = max(SAMPLE_TEXTS / total, SAMPLE_TOKENS * parts / tokens)
    some = texts.sample(share, seed=7) if share < 1 else texts
    drawn = some.mapInArrow(sampler(keys_of), "key long").where(F.pmod(F.xxhash64("key"), F.lit(16)) == 0)
    keys = np.sort(np.array([r[0] for r in drawn.collect()], np.int64).view(np.uint64)) if parts > 1 else []
    cuts = sorted({int(keys[i * len(keys) // parts]) for i in range(1, parts)}) if len(keys) else []
    grams = Grams(folder, name, width, cuts, {})
    blocks = texts.mapInArrow(counter(keys_of, grams.shard_of), "shard int, block binary")
    done = one_shard_a_task(blocks, len(cuts) + 1).groupBy("shard").applyInArrow(
        build_grams(grams, totals_of, discount), "shard int, low long, high long, n long, at_low long, at_high long"
    )
    return Grams(folder, name, width, cuts, {r["shard"]: tuple(r)[1:] for r in done.collect()})


def train(texts: DataFrame, discount: float = DISCOUNT) -> dict:
    """The model's place and measures; ``texts`` has a column text without nulls."""
    spark = texts.sparkSession
    bound_batches(spark)
    folder = new_folder(spark, "ngrams")
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    bits = max(0, int((size["bytes"] or 0) // (32 * SHARD_TOKENS)).bit_length())
    counted = texts.mapInArrow(counter(lambda tokens: tokens, lambda words: _word_shard(words, bits)), "shard int, block binary")
    built = one_shard_a_task(counted, 1 << bits).groupBy("shard").applyInArrow(build_words(folder, bits), "shard int, n long, tokens long").collect()
    sizes, tokens = [0] * (1 << bits), 0
    for r in built:
        sizes[r["shard"]] = r["n"]
        tokens += r["tokens"]
    words = sum(sizes)
    trie = Trie(Level(folder, sizes), words + 1, size["n"])
    if size["n"]:
        about = (size["n"], tokens, discount)
        trie.pairs = _level(texts, trie, "pairs", words + 1, trie.of_pairs, trie.context_totals, *about)
        pairs = int(trie.pairs.numbers[-1])
        trie.triples = _level(texts, trie, "triples", pairs, trie.of_triples, trie.pairs.totals, *about)
    else:
        trie.pairs, trie.triples = (Grams(folder, x, 1, [], {}) for x in ("pairs", "triples"))
    return {"trie": trie, "tokens": tokens, "words": words, "discount": discount}


def _left(grams: Grams, contexts: np.ndarray, total: np.ndarray, discount: float) -> np.ndarray:
    """What a context leaves to the shorter one; all where the context is unknown or nothing followed it."""
    own, back = np.unique(contexts, return_inverse=True)
    known = own >= 0
    follow = np.zeros(len(own), np.int64)
    follow[known] = grams.successors(own[known])
    follow = follow[back]
    return np.where((follow > 0) & (total > 0), discount * follow / np.maximum(total, 1e-9), 1.0)


def probabilities(model: dict, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's probability behind those before it in its text, and its count in training."""
    trie, discount = model["trie"], model["discount"]
    ends = tokens == END
    number, count, more = trie.level.find(tokens)
    p = more / (model["tokens"] + model["words"] + 1)
    keys, before, known = trie.pair_keys(number, ends)
    own, back = np.unique(keys, return_inverse=True)
    pair, seen, total = (np.where(known, x[back], none) for x, none in zip(trie.pairs.lookup(own), (-1, 0.0, 0.0), strict=True))
    counts = np.where(before == trie.width - 1, trie.texts, np.concatenate([[0], count[:-1]]))
    p = seen + _left(trie.pairs, before, counts, discount) * p
    context = trie.contexts(pair, ends)
    known = (context >= 0) & (number >= 0)
    keys = np.where(known, context, 0).astype(np.uint64) * np.uint64(trie.width) + np.where(known, number, 0).astype(np.uint64)
    own, back = np.unique(keys, return_inverse=True)
    seen = np.where(known, trie.triples.lookup(own)[1][back], 0.0)
    p = seen + _left(trie.triples, context, np.concatenate([[0.0], total[:-1]]), discount) * p
    return np.minimum(p, 1.0), count


def score_batches(model: dict):
    """A ``mapInArrow`` function: ``(doc_id, text)`` to scores."""
    n, v = model["tokens"], model["words"]

    def run(batches):
        for b in batches:
            for row, nxt, data, at in chunks(b.column("text"), LOOKUP_BYTES):
                tokens, text = token_hashes(data, at)
                p, count = probabilities(model, tokens)
                base = np.log10((count + 1) / (n + 1 * (v + 1)))
                rows = nxt - row
                add = lambda x: np.bincount(text, x, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(row, rows),
                        pa.array(np.bincount(text, minlength=rows), pa.int64()),
                        pa.array(add(count > 0).astype(np.int64)),
                        pa.array(add(base)),
                        pa.array(add(np.log10(p))),
                    ],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, n_tokens, n_known, base_score, score)`` for each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(score_batches(model), schema)


def op4_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    model = train(docs.where(~held_out).select(F.coalesce("text", F.lit("")).alias("text")))
    return scores(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score"
    )
