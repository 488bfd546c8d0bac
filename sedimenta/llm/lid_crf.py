"""Language identification by a linear-chain conditional random field over words.

Every word gets emission scores from its affixes, character n-grams and an
entry in a lexicon; learned start and transition scores tie the labels of
neighbouring words, and forward-backward gives each word a probability for
every language, also where a text switches language.  A text's language has
the largest mean probability over its words, and that mean is the score.

A text is one chain, however long: it is worked on in blocks of ``CHAIN``
words, whose transfer matrices carry the forward and backward scores over every
block's edges, so the result is that of the whole chain.  The model is fitted
on about ``PER_LANGUAGE`` labelled texts of each language, and at most
``TRAINING_WORDS`` of their words, spliced into chains that switch between
languages, by stochastic gradient steps on the chain likelihood.

Null and empty texts, and texts without a letter, are ``und`` with score 0;
so is everything if no text has a label.  Repeated rows each get a row.  Other
columns are ignored.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import byte_class, chunks, mix, span_hashes
from .common import bound_batches, crc_mod, table, with_id

CHAIN = 64
#: Bound of the training sample: texts of each language, and words in all.
PER_LANGUAGE = 150
TRAINING_WORDS = 400_000
EPOCHS = 4
RATE = 0.4
UNKNOWN = "und"

LETTERS = byte_class(lambda b: 97 <= b <= 122 or b >= 128)
_BITS = 16
_GRAMS = 1 << 16  # two-byte and hashed three-byte n-grams
_ROWS = 2 * _GRAMS + 2 * (1 << _BITS)


class Words:
    """Words of a chunk of texts with the feature rows that they sum up."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        wide = np.full(len(data) + n + 3, 32, np.uint8)  # a space before each text keeps texts apart
        shift = np.repeat(np.arange(1, n + 1), np.diff(offsets))
        wide[np.arange(len(data)) + shift] = np.where(LETTERS[data], data, 32)
        at = offsets + np.arange(n + 1)
        inside = wide != 32
        self.starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        self.ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        self.doc = np.searchsorted(at, self.starts, "right") - 1
        self.hashes = span_hashes(wide, self.starts, self.ends)
        self.wide, self.n = wide, n
        b = wide.astype(np.uint32)
        two = b[:-2] | (b[1:-1] << 8)
        three = ((two | (b[2:] << 16)) * np.uint32(2654435761)) >> np.uint32(32 - _BITS)
        size = self.ends - self.starts + 1  # n-grams from the space before to the last letter
        self.cuts = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(self.cuts - self.starts + 1, size)
        self.grams2, self.grams3 = two[place].astype(np.int64), three[place].astype(np.int64) + _GRAMS
        longer = np.minimum(self.ends - self.starts, 4)
        self.prefix = (span_hashes(wide, self.starts, self.starts + longer) >> np.uint64(64 - _BITS)).astype(np.int64) + 2 * _GRAMS
        self.suffix = (span_hashes(wide, self.ends - longer, self.ends) >> np.uint64(64 - _BITS)).astype(np.int64) + 2 * _GRAMS + (1 << _BITS)


def _entries(lexicon: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Row of each word in the lexicon; the row after the last for words that are not in it."""
    if not len(lexicon):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    return np.where(lexicon[at] == hashes, at, len(lexicon))


def emissions(w: Words, model: dict) -> np.ndarray:
    weights, words = model["weights"], model["words"]
    out = np.zeros((len(w.starts), weights.shape[1]), np.float32)
    if len(out):
        for grams in (w.grams2, w.grams3):
            out += np.add.reduceat(weights[grams], w.cuts, axis=0)
        out += weights[w.prefix] + weights[w.suffix] + words[_entries(model["lexicon"], w.hashes)]
    return out


def chain_layout(doc: np.ndarray, texts: int, most: int = CHAIN) -> tuple[np.ndarray, np.ndarray, int]:
    """Chain and place of every word."""
    count = np.bincount(doc, minlength=texts)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    per = -(-count // most)
    return (np.cumsum(per) - per)[doc] + within // most, within % most, int(per.sum())


def forward_backward(
    scores: np.ndarray, valid: np.ndarray, start: np.ndarray, moves: np.ndarray, leave: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities (place, chain, label), expected transitions and log-normalisers.

    ``start`` holds the log scores of the first label, of all chains or of each;
    ``leave`` the backward scores of each chain's last label, one if not given.
    """
    steps, chains, k = scores.shape
    top = scores.max(axis=2, keepdims=True)
    e, a = np.exp(scores - top), np.exp(moves)
    alpha, scale = np.empty_like(e), np.ones((steps, chains), e.dtype)
    alpha[0] = np.exp(start) * e[0]
    for t in range(steps):
        if t:
            alpha[t] = np.where(valid[t][:, None], (alpha[t - 1] @ a) * e[t], alpha[t - 1])
        scale[t] = alpha[t].sum(axis=1)
        alpha[t] /= scale[t][:, None]
    after = np.ones_like(e[0]) if leave is None else leave
    beta = np.empty_like(e)
    beta[-1] = after
    pairs = np.zeros((k, k))
    for t in range(steps - 2, -1, -1):
        ahead = e[t + 1] * beta[t + 1] / scale[t + 1][:, None]
        live = valid[t + 1]
        pairs += np.einsum("ci,cj->ij", alpha[t][live], ahead[live]) * a
        beta[t] = np.where(live[:, None], ahead @ a.T, after)
    probability = alpha * beta * valid[:, :, None]
    norm = (np.log(scale) * valid + top[:, :, 0] * valid).sum(axis=0)
    return probability / np.maximum(probability.sum(axis=2, keepdims=True), 1e-30), pairs, norm


def _laid(w: Words, scores: np.ndarray, texts: int):
    chain, place, chains = chain_layout(w.doc, texts)
    laid = np.zeros((CHAIN, max(chains, 1), scores.shape[1]), np.float32)
    valid = np.zeros((CHAIN, max(chains, 1)), bool)
    laid[place, chain], valid[place, chain] = scores, True
    return chain, place, laid, valid


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.max(axis=tuple(range(1, x.ndim)), keepdims=True)


def marginals(laid: np.ndarray, valid: np.ndarray, per: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Label probabilities (place, block, label) of texts of ``per`` blocks each, every text one chain.

    A block's transfer matrix turns the forward scores before it into those
    after it, and the backward scores after it into those before it.
    """
    _, blocks, k = laid.shape
    base = np.cumsum(per) - per
    enter, leave = np.zeros((blocks, k), np.float32), np.ones((blocks, k), np.float32)
    enter[:] = start
    long = np.flatnonzero(per > 1)
    if len(long):
        a = np.exp(moves).astype(np.float32)
        mine = np.repeat(base[long], per[long]) + np.arange(per[long].sum()) - np.repeat(np.cumsum(per[long]) - per[long], per[long])
        head = np.isin(mine, base)
        e = np.exp(laid[:, mine] - laid[:, mine].max(axis=2, keepdims=True))
        m = np.where(head[:, None, None], np.eye(k, dtype=np.float32), a) * e[0][:, None, :]
        for t in range(1, len(e)):
            m = _scaled(np.where(valid[t, mine][:, None, None], (m @ a) * e[t][:, None, :], m))
        spot = np.empty(blocks, np.int64)
        spot[mine] = np.arange(len(mine))
        before = np.broadcast_to(np.exp(start - start.max()).astype(np.float32), (len(long), k)).copy()
        after = np.ones((len(long), k), np.float32)
        for j in range(int(per[long].max()) - 1):
            go = per[long] > j + 1
            at = base[long][go] + j
            before[go] = _scaled(np.einsum("ci,cij->cj", before[go], m[spot[at]]))
            enter[at + 1] = np.log(before[go] @ a + 1e-30)
            at = base[long][go] + per[long][go] - 1 - j
            after[go] = _scaled(np.einsum("cij,cj->ci", m[spot[at]], after[go]))
            leave[at - 1] = after[go]
    return forward_backward(laid, valid, enter, moves, leave)[0]


def spliced(texts: list[str], labels: list[int], words: int, rng: random.Random) -> tuple[list[str], list[np.ndarray]]:
    """Chains made of runs of 4 to 32 words from texts in random order, and each word's label."""
    runs = []
    for text, label in zip(texts, labels, strict=True):
        own = bytes(np.where(LETTERS[raw := np.frombuffer(text.lower().encode(), np.uint8)], raw, 32)).split()
        at = 0
        while at < len(own):
            n = rng.randint(4, 32)
            runs.append((own[at : at + n], label))
            at += n
    rng.shuffle(runs)
    flat = [(x, label) for run, label in runs for x in run][:words]
    parts = [flat[i : i + CHAIN] for i in range(0, len(flat), CHAIN)]
    return [b" ".join(x for x, _ in p) for p in parts], [np.array([y for _, y in p]) for p in parts]


def fit(texts: list[str], labels: list[str], epochs: int = EPOCHS, seed: int = 7) -> dict:
    """The model from labelled texts."""
    names = sorted(set(labels))
    rng = random.Random(seed)
    chains, truth = spliced(texts, [names.index(x) for x in labels], TRAINING_WORDS, rng)
    k = max(1, len(names))
    model = {
        "labels": names,
        "weights": np.zeros((_ROWS, k), np.float32),
        "start": np.zeros(k, np.float32),
        "moves": np.zeros((k, k), np.float32),
    }
    parts = []
    for at in range(0, len(chains), 256):
        column = pa.array(chains[at : at + 256], pa.binary())
        data, offsets = next((d, o) for _, _, d, o in chunks(column, 1 << 40))
        parts.append((Words(data, offsets), np.concatenate(truth[at : at + 256])))
    seen, times = np.unique(np.concatenate([w.hashes for w, _ in parts]), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0))
    model["lexicon"] = seen[times > 1]
    model["words"] = np.zeros((len(model["lexicon"]) + 1, k), np.float32)
    squares = {n: np.full(model[n].shape, 1e-3, np.float32) for n in ("weights", "words", "start", "moves")}
    for _ in range(epochs):
        rng.shuffle(parts)
        for w, y in parts:
            chain, place, laid, valid = _laid(w, emissions(w, model), w.n)
            p, pairs, _ = forward_backward(laid, valid, model["start"], model["moves"])
            wrong = -p[place, chain].astype(np.float32)
            wrong[np.arange(len(y)), y] += 1
            wrong /= len(y)
            step = {n: np.zeros_like(model[n]) for n in squares}
            size = np.diff(np.append(w.cuts, len(w.grams2)))
            spread = np.repeat(wrong, size, axis=0)
            for label in range(k):
                for rows, value in ((w.grams2, spread), (w.grams3, spread), (w.prefix, wrong), (w.suffix, wrong)):
                    step["weights"][:, label] += np.bincount(rows, value[:, label], _ROWS).astype(np.float32)
                step["words"][:, label] += np.bincount(_entries(model["lexicon"], w.hashes), wrong[:, label], len(step["words"])).astype(np.float32)
            step["words"][-1] = 0
            same = (chain[1:] == chain[:-1])
            counted = np.zeros((k, k))
            np.add.at(counted, (y[:-1][same], y[1:][same]), 1)
            step["moves"] = ((counted - pairs) / len(y)).astype(np.float32)
            head = place == 0
            step["start"] = wrong[head].sum(axis=0)
            for n, g in step.items():
                squares[n] += g * g
                model[n] += RATE * g / np.sqrt(squares[n])
    return model


def label_batches(model: dict):
    """A ``mapInArrow`` function: ``(doc_id, text, ...)`` to predictions."""
    names = model["labels"]

    def run(batches):
        for b in batches:
            texts = pc.utf8_lower(b.column("text"))
            for row, nxt, data, at in chunks(texts):
                n = nxt - row
                w = Words(data, at)
                mean, words, switches = np.zeros((n, max(1, len(names)))), np.bincount(w.doc, minlength=n), np.zeros(n, np.int64)
                if len(w.starts) and names:
                    chain, place, laid, valid = _laid(w, emissions(w, model), n)
                    p = marginals(laid, valid, -(-words // CHAIN), model["start"], model["moves"])[place, chain]
                    for j in range(len(names)):
                        mean[:, j] = np.bincount(w.doc, p[:, j], n) / np.maximum(words, 1)
                    label = p.argmax(axis=1)
                    changed = (label[1:] != label[:-1]) & (w.doc[1:] == w.doc[:-1])
                    switches = np.bincount(w.doc[1:][changed], minlength=n)
                letters = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
                plain = letters[at[1:]] > letters[at[:-1]]
                known = [
                    bool(names) and words[i] > 0 and bool(plain[i] or any(map(str.isalpha, texts[row + i].as_py()))) for i in range(n)
                ]
                best = mean.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(row, n),
                        pa.array([names[j] if ok else UNKNOWN for j, ok in zip(best, known, strict=True)], pa.string()),
                        pa.array([min(1.0, float(mean[i, j])) if ok else 0.0 for i, (j, ok) in enumerate(zip(best, known, strict=True))], pa.float64()),
                        pa.array(words, pa.int64()),
                        pa.array(switches, pa.int64()),
                    ],
                    ["doc_id", "lang_pred", "score", "n_words", "n_switches"],
                )

    return run


def labelled_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """About ``per_language`` labelled texts of each language, chosen by a hash of their ids."""
    usable = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1_000_003)) / 1_000_003.0
    rows = usable.where(drawn < F.element_at(share, F.col("lang"))).select("text", "lang", "doc_id").collect()
    rows.sort(key=lambda r: (r["lang"], str(r["doc_id"]), r["text"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, lang_pred, score, n_words, n_switches)`` for each row of ``docs``."""
    bound_batches(docs.sparkSession)
    schema = with_id(docs, "lang_pred string, score double, n_words long, n_switches long")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(label_batches(model), schema)


def learn(docs: DataFrame) -> dict:
    return fit(*labelled_sample(docs.where(~F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)))))


def op1_lid_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
