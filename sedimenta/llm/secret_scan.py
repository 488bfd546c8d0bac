"""Secret scans in DataFrame operations only: fixed patterns, then character Markov models.

Base kinds, leftmost matches without overlap per kind: ``assign`` (a keyword
given a value), ``access`` (access-key ids) and ``hex`` (long digests).  The
added kind ``markov``: two first-order character models, one of random strings
and one of ordinary identifiers, are trained by counting transitions in
labelled samples; a run of key characters outside every base span is a secret
if the mean log-likelihood ratio of its transitions is above a threshold.

Positions are code points, end exclusive.  A match's place follows from the
lengths of the pieces that ``split`` leaves between matches: lengths are summed
within blocks of about the square root of the number of matches and then over
blocks, so a text with very many matches costs little more than its length.
Candidates look up the base span before their end by binary search.  Every step
is a built-in expression over one scan without a shuffle.

Null and empty texts have no spans.  Repeated rows each get a row.  With no
labelled samples at all every ratio is zero and nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Fixed patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 6, "access": 20, "hex": 24}

CANDIDATE = r"[A-Za-z0-9+/_]{20,}"
WORD = r"[A-Za-z_][A-Za-z0-9_]{5,}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_"

#: Bound of the training sample, in documents.
SAMPLE_DOCS = 2_000
#: Least mean log-likelihood ratio (nats a transition) of a secret.
THRESHOLD = 1.0

SPAN = "array<struct<start:int,end:int,found:string>>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _summed(parts: Column) -> Column:
    """The spans of ``parts`` (gap before, size, found), each one placed behind the one before it."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        one = F.struct(begin.alias("start"), (begin + p["size"]).alias("end"), p["found"].alias("found"))
        return F.struct((begin + p["size"]).alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    def block_of(parts: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(parts))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(parts), size), lambda at: F.aggregate(F.slice(parts, at, size), none, step))

    def placed(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        moved = lambda b, by: F.transform(
            b["spans"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["found"].alias("found"))
        )
        return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), moved))

    return F.when(F.size(parts) == 0, F.array().cast(SPAN)).otherwise(_let(block_of(parts), placed))


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches as ``(start, end, found)``, where ``found`` is the given group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    parts = F.zip_with(
        F.arrays_zip(whole.alias("whole"), found.alias("found")),
        gaps,
        lambda m, gap: F.struct(
            F.char_length(gap).alias("gap"), F.char_length(m["whole"]).alias("size"), m["found"].alias("found")
        ),
    )
    return _let(F.filter(parts, lambda p: p["size"].isNotNull()), _summed)


def met(known: Column, c: Column) -> Column:
    """Whether a span of ``known``, which are in order and apart, overlaps ``c``: binary search for the last that begins before its end."""
    before = F.aggregate(
        F.array(*[F.lit(1 << k) for k in reversed(range(30))]),
        F.lit(0),
        lambda at, step: F.when((at + step <= F.size(known)) & (F.get(known, at + step - 1)["start"] < c["end"]), at + step).otherwise(at),
    )
    return F.when(F.size(known) == 0, False).otherwise(F.coalesce(F.get(known, before - 1)["end"] > c["start"], F.lit(False)))


def _where(test: Column, value: Column) -> Column:
    return F.when(test, value).otherwise(F.array().cast(SPAN))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns ``assign``, ``access`` and ``hex``; cheap tests come before full matching."""
    t = F.col(text)

    def least(kind: str, found: Column) -> Column:
        return F.filter(found, lambda s: F.char_length(s["found"]) >= LEAST[kind])

    return docs.withColumns(
        {
            "assign": _where(
                t.rlike(r"(?i:passw|secret|token|api_?key)"), least("assign", spans(t, ASSIGN, 2))
            ),
            "access": _where(F.contains(t, F.lit("AKIA")), least("access", spans(t, ACCESS))),
            "hex": _where(t.rlike(r"[0-9a-f]{24}"), spans(t, r"[0-9a-f]{24,}")),
        }
    )


def labelled_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``(random, sample)``: values of base matches and digests against words of about ``sample_docs`` documents, drawn by a hash of their ids."""
    total = docs.count()
    share = min(1.0, sample_docs / total) if total else 0.0
    drawn_ids = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    chosen = base_spans(docs.where(drawn_ids).select("doc_id", "text"))
    values = F.transform(F.concat("assign", "access", "hex"), lambda s: s["found"])
    digest = F.sha2(F.col("doc_id").cast("string"), 256)
    drawn = F.array(digest, F.upper(digest), F.base64(F.unhex(digest)), F.translate(F.base64(F.unhex(F.sha1(digest))), "+/=", ""))
    rest = F.regexp_replace("text", ASSIGN + "|" + ACCESS + "|[0-9a-f]{24,}", " ")
    return chosen.select(F.lit(True).alias("random"), F.explode(F.concat(values, drawn)).alias("sample")).unionByName(
        chosen.select(F.lit(False).alias("random"), F.explode(F.regexp_extract_all(rest, F.lit(WORD), F.lit(0))).alias("sample"))
    )


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of each transition, a table of ``len(ALPHABET) ** 2`` entries."""
    n = len(ALPHABET)
    pairs = (
        samples.select("random", F.regexp_replace("sample", f"[^{ALPHABET}]", "").alias("s"))
        .where(F.char_length("s") > 1)
        .select(
            "random",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.char_length("s") - 1), lambda i: F.col("s").substr(i, F.lit(2))
                )
            ).alias("pair"),
        )
        .groupBy("random", "pair")
        .count()
    )
    counts = {(r[0], r[1]): r[2] for r in pairs.collect()}  # at most 2 n^2 rows

    def logs(kind: bool) -> list[float]:
        out = []
        for a in ALPHABET:
            row = [counts.get((kind, a + b), 0) + 0.5 for b in ALPHABET]
            total = sum(row)
            out += [math.log(x / total) for x in row]
        return out

    return [round(x - y, 6) for x, y in zip(logs(True), logs(False), strict=True)] if counts else [0.0] * (n * n)


def mean_ratio(token: Column, ratios: list[float]) -> Column:
    n = len(ALPHABET)
    weights = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    total = F.aggregate(
        F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: a * n + b),
        F.lit(0.0),
        lambda acc, at: acc + F.get(weights, at),
    )
    return total / F.greatest(F.char_length(token) - 1, F.lit(1))


def scan(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, assign, access, hex, markov)``: arrays of ``(start, end, found)``."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    based = base_spans(texts)
    t = F.col("text")
    free = F.filter(
        spans(t, CANDIDATE),
        lambda c: ~(met(F.col("assign"), c) | met(F.col("access"), c) | met(F.col("hex"), c)) & (mean_ratio(c["found"], ratios) > threshold),
    )
    return based.withColumn("markov", _where(t.rlike(CANDIDATE), free)).drop("text")


def listed(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` by start, then kind in the order given, joined by commas."""
    def ranked(rank: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("kind"), s["end"].alias("end")))

    tagged = F.concat(*[ranked(i, k) for i, k in enumerate(kinds)])
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(
            F.array_sort(tagged),
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(labelled_samples(docs)))
    return found.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(listed(KINDS[:3]), 256).alias("base_sha256"),
        listed(KINDS).alias("spans"),
        F.size("markov").cast("long").alias("n_markov"),
    )
