"""A corpus pipeline of five stages over ``documents``.

Each stage takes the documents that its predecessor kept.  All but the last
return the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import content_sort, dart_minhash, decontaminate, lid_crf, packing
from sedimenta.llm.common import staged, table, whole_rows

#: A text whose words agree less than this on any language is rejected.
LEAST_LANGUAGE_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts of no clear language, each row by its own text."""
    found = lid_crf.identify(whole_rows(docs), lid_crf.learn(docs))
    sure = (F.col("lang_pred") != lid_crf.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return found.where(sure).select("doc_id.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, the one with the smallest id stays, one without an id only among such.

    Columns travel as one struct, so no name of theirs can clash.
    """
    row = F.struct(*docs.columns).alias("row")
    rows = docs.select(row, F.col("doc_id").alias("id"), F.sha2(content_sort.normalised(F.col("text")), 256).alias("sha")).alias("r")
    found = content_sort.exact_duplicates(docs).groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    counts = found.agg(F.count(F.lit(1)).alias("copies"), F.bool_or("kept").alias("kept")).where("kept").alias("c")
    same = (F.col("r.sha") == F.col("c.sha")) & F.col("r.id").eqNullSafe(F.col("c.id"))
    kept = rows.join(counts, same).select("r.row", "r.id", "r.sha", "c.copies")
    once, again = kept.where("copies = 1"), kept.where("copies > 1").dropDuplicates(["id", "sha"])
    return once.unionByName(again).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that with the smallest id."""
    return dart_minhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth of the words is verbatim benchmark text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their place in a packed sequence."""
    return packing.pack(packing.pieces(docs, packing.tokenizer_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: The language model, similarity classes and the tokenizer are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
