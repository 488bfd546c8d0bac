"""Deduplication, reference checks and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``; give a total order, or the choice among ties is open."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def fk_flag(df: DataFrame, reference: DataFrame, column: str, key: str, flag: str) -> DataFrame:
    """``flag``: the key is known.  Null keys are unknown, and are spread over all tasks."""
    known = reference.select(F.col(key).alias("_key")).where(F.col("_key").isNotNull()).distinct().withColumn("_known", F.lit(True))
    return join_spread(df, known, column).withColumn(flag, F.coalesce("_known", F.lit(False))).drop("_known")


def join_spread(df: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """``df`` left-joined to the unique keys ``_key`` of ``side``.

    Rows with a null key match nothing; where both sides are shuffled they
    would all go to one task, so they are dealt by a hash of the row instead.
    """
    spread = F.when(F.col(key).isNull(), F.xxhash64(*df.columns)).otherwise(F.lit(0).cast("long"))
    keyed = side.where(F.col("_key").isNotNull()).withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(1).cast("long")))
    left = df.withColumn("_spread", spread)
    return left.join(keyed, (left[key] == keyed["_key"]) & (left["_spread"] == keyed["_part"]), "left").drop("_key", "_part", "_spread")


def surrogate_key(*columns: str | Column) -> Column:
    """60 bits of the digest of columns that must not be null (nulls are skipped, so two keys could meet).

    Any engine can compute it again, so keys survive a change of tools.
    """
    given = [F.col(c) if isinstance(c, str) else c for c in columns]
    missing = F.exists(F.array(*[c.isNull() for c in given]), lambda x: x)
    key = F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in given])), 1, 15), 16, 10).cast("long")
    return F.when(missing, F.raise_error(F.lit("null in key columns")).cast("long")).otherwise(key)


def date_key(day: Column) -> Column:
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)
