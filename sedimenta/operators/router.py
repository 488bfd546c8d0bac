"""Error texts to components by a manifest of regular expressions, for manifests of any length.

A text that a pattern matches holds the pattern's required literal.  Every
pattern is indexed by one piece of four characters of its literal, the one that
fewest patterns have; texts meet patterns by an equi-join on their own pieces,
and only then are patterns run.  Patterns without such a literal are tried on
every text.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 4


def required_literals(pattern: str) -> list[str]:
    """Runs of characters that every match of ``pattern`` holds, found outside groups, sets and alternatives; none where that is not sure."""
    runs, run, depth, i = [], "", 0, 0
    if "(?" in pattern or "\\Q" in pattern:
        return []  # flags and special groups may change what a literal means

    def width(at: int) -> int:
        """Characters of the quantifier at ``at``; negative if it allows no occurrence."""
        if at < len(pattern) and pattern[at] in "?*":
            return -1
        if at < len(pattern) and pattern[at] == "{":
            end = pattern.find("}", at)
            return end - at + 1 if pattern[at + 1 : at + 2] not in ("0", "") else -1
        return 1 if at < len(pattern) and pattern[at] == "+" else 0

    while i < len(pattern):
        c, literal = pattern[i], None
        if c == "\\":
            follows = pattern[i + 1 : i + 2]
            literal, step = (follows if follows and not follows.isalnum() else None), 2
            if follows in ("x", "u", "c", "p", "P", "0", "N", "k"):
                return []
        elif c == "[":
            end, step = i + 1, 0
            end += pattern[end : end + 1] == "^"
            end += pattern[end : end + 1] == "]"
            while end < len(pattern) and pattern[end] != "]":
                if pattern[end] == "[":
                    return []
                end += 2 if pattern[end] == "\\" else 1
            step = end - i + 1
        elif c in "()|":
            if c == "|" and not depth:
                return []
            depth += (c == "(") - (c == ")")
            step = 1
        else:
            literal, step = (None if c in ".^$*+?{}" else c), 1
        q = width(i + step)
        if literal is not None and not depth and q >= 0:
            run += literal
            if q:  # repeated: what follows need not be next to the first
                runs.append(run)
                run = ""
        else:
            runs.append(run)
            run = ""
        i += step
        if q < 0 and i < len(pattern) and pattern[i] in "?*":
            i += 1
        elif q < 0:
            i = pattern.find("}", i) + 1 or len(pattern)
        else:
            i += q
    return [r for r in [*runs, run] if r]


def index(manifest: list[tuple[str, str]]) -> tuple[list[tuple[str, int]], list[int]]:
    """``(piece, pattern number)`` for indexed patterns, and the numbers of the others."""
    pieces = [[r[i : i + GRAM] for r in required_literals(p) for i in range(len(r) - GRAM + 1)] for p, _ in manifest]
    often = Counter(g for own in pieces for g in set(own))
    keyed = [(min(own, key=lambda g: (often[g], g)), n) for n, own in enumerate(pieces) if own]
    return keyed, [n for n, own in enumerate(pieces) if not own]


def error_router(errors: DataFrame, text: str, row_id: str, manifest: list[tuple[str, str]]) -> DataFrame:
    """``(row_id, component, pattern)``, one row per ``row_id``: of the patterns that match, the longest is the most specific; nulls where none does.

    The manifest is the caller's list and is broadcast.  Ties go to the smaller
    pattern, then component.
    """
    ranked = sorted(manifest, key=lambda m: (-len(m[0]), m[0], m[1]))
    keyed, others = index(ranked)
    spark = errors.sparkSession
    rules = F.broadcast(spark.createDataFrame(keyed, "piece string, number int"))
    names = F.broadcast(spark.createDataFrame([(n, c, p) for n, (p, c) in enumerate(ranked)], "number int, component string, pattern string"))
    rows = errors.select(row_id, F.col(text).alias("_text"))
    size = F.char_length("_text") - GRAM
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(0), size), lambda i: F.substring(F.col("_text"), i + 1, F.lit(GRAM))))
    # Pieces travel without their text, which may be long; it comes back to the few patterns that share one with it.
    split = rows.where(size >= 0).select(F.col(row_id).alias("_id"), F.explode(pieces).alias("piece"))
    met = split.join(rules, "piece").groupBy("_id").agg(F.collect_set("number").alias("numbers"))
    able = rows.join(met, F.col(row_id).eqNullSafe(F.col("_id"))).select(row_id, "_text", F.explode("numbers").alias("number"))
    found = [able.join(names, "number").where(F.expr("_text rlike pattern")).select(row_id, "number")]
    if others:
        tried = F.coalesce(*[F.when(F.col("_text").rlike(ranked[n][0]), n) for n in others])
        found.append(rows.select(row_id, tried.alias("number")).where("number is not null"))
    # Every row once more without a number, so that rows without a match stay.
    every = reduce(DataFrame.unionByName, [*found, rows.select(row_id, F.lit(None).cast("int").alias("number"))])
    best = every.groupBy(row_id).agg(F.min("number").alias("number"))
    return best.join(names, "number", "left").select(row_id, "component", "pattern")
