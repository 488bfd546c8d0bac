"""Merges without a table format: pure functions from (target, source) to the new target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _checked(source: DataFrame, keys: list[str]) -> DataFrame:
    """``source``; a duplicate key raises when the rows are read, like a merge that matches twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    fail = F.raise_error(F.concat(F.lit("duplicate merge key "), F.to_json(F.struct(*keys))))
    counted = source.withColumn("_n", n)
    return counted.where(F.when(F.col("_n") > 1, fail.cast("boolean")).otherwise(F.lit(True))).drop("_n")


def _on(keys: list[str], null_safe: bool) -> Column:
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) if null_safe else F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    return reduce(lambda a, b: a & b, same)


def merge(target: DataFrame, source: DataFrame, keys: list[str], guard: str | None = None, null_safe: bool = False) -> DataFrame:
    """Update all columns where keys match, insert the rest, in one full join.

    With ``guard`` a source row replaces a target row only if its guard value
    is not smaller.  Without ``null_safe`` null keys never match.

    Without ``guard`` every source row stays as it is, so only the target's rows
    and the source's keys meet; the source is read three times: give a stored one.
    """
    columns = target.columns
    if not guard:
        counted = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        # Spark may ask a filter on the result before that on the count, so the raise has its own condition.
        fail = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate merge key "), F.to_json(F.struct(*keys)))))
        twice = counted.where("_n > 1").select(*[fail.cast(source.schema[c].dataType).alias(c) for c in columns])
        old = target.alias("t").join(counted.where("_n > 0").alias("s"), _on(keys, null_safe), "left_anti")
        return old.unionByName(source.select(columns)).unionByName(twice)
    s, t = _checked(source.select(columns), keys), target
    both = t.withColumn("_t", F.lit(True)).alias("t").join(
        s.withColumn("_s", F.lit(True)).alias("s"), _on(keys, null_safe), "full"
    )
    take = F.col("s._s").isNotNull()
    if guard:
        take = take & (F.col("t._t").isNull() | F.coalesce(F.col(f"s.{guard}") >= F.col(f"t.{guard}"), F.lit(False)))
    return both.select([F.when(take, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in columns])


def merge_partitions(target: DataFrame, source: DataFrame, keys: list[str], partition: str, guard: str | None = None) -> DataFrame:
    """The new rows of every affected partition, those of the source and those its rows moved from."""
    old = target.join(source.select(*keys).distinct(), keys, "left_semi").select(partition)
    affected = old.unionByName(source.select(partition)).distinct()
    return merge(target.join(affected, partition, "left_semi").select(target.columns), source, keys, guard)
