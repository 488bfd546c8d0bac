"""Slowly changing dimensions as pure functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import dedup_latest, join_spread, surrogate_key


def _differs(columns: list[str], a: str, b: str) -> Column:
    """Any column differs; null against a value is a change."""
    return reduce(lambda x, y: x | y, [~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns], F.lit(False))


def change_tracking(incoming: DataFrame, current: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``incoming`` with ``_prev_<column>`` and ``_scd_changed`` (false at first sight); rows without a key are spread over all tasks."""
    both = join_spread(incoming, current.select(F.col(key).alias("_key"), F.struct(*columns).alias("_old")), key)
    differs = reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(F.col(f"_old.{c}")) for c in columns], F.lit(False))
    return both.select(
        *incoming.columns,
        *[F.col(f"_old.{c}").alias(f"_prev_{c}") for c in columns],
        (F.col("_old").isNotNull() & differs).alias("_scd_changed"),
    )


def scd2_classify(snapshot: DataFrame, dim: DataFrame, key: str, tracked: list[str], overwrite: list[str]) -> DataFrame:
    """``snapshot`` with ``action``: NEW, SCD2_CHANGE, SCD1_OVERWRITE or UNCHANGED; the first that fits."""
    current = dim.where("is_current").select(key, *tracked, *overwrite, F.lit(True).alias("_seen"))
    return snapshot.alias("n").join(current.alias("o"), key, "left").select(
        "n.*",
        F.when(F.col("o._seen").isNull(), "NEW")
        .when(_differs(tracked, "n", "o"), "SCD2_CHANGE")
        .when(_differs(overwrite, "n", "o"), "SCD1_OVERWRITE")
        .otherwise("UNCHANGED")
        .alias("action"),
    )


def first_activity(facts: DataFrame, key: str, day: str) -> DataFrame:
    return facts.groupBy(key).agg(F.min(day).alias("first_date"))


def scd2_apply(
    snapshot: DataFrame, dim: DataFrame, key: str, tracked: list[str], overwrite: list[str], run_date: str, activity: DataFrame | None = None
) -> DataFrame:
    """The new dimension: changed versions closed, current rows overwritten, new versions opened.

    ``dim`` has key, tracked, overwrite, valid_from, valid_to, is_current.  New
    keys are valid from their first activity, else from the run date; changed
    ones from the run date.  A second change on the day on which the current
    version opened goes into that version, so a repeated run changes nothing.
    """
    day = F.lit(run_date).cast("date")
    acted = scd2_classify(snapshot, dim, key, tracked, overwrite).select(key, *tracked, *overwrite, "action")
    columns = [key, *tracked, *overwrite, "valid_from", "valid_to", "is_current"]
    old = dim.alias("d").join(acted.alias("a"), key, "left")
    same_day = F.col("d.valid_from") >= day
    hit = F.col("d.is_current") & (F.col("a.action") == "SCD2_CHANGE")
    close, refresh = F.coalesce(hit & ~same_day, F.lit(False)), F.coalesce(hit & same_day, F.lit(False))
    rewrite = F.coalesce(F.col("d.is_current") & (F.col("a.action") == "SCD1_OVERWRITE"), F.lit(False)) | refresh
    kept = old.select(
        key,
        *[F.when(refresh, F.col(f"a.{c}")).otherwise(F.col(f"d.{c}")).alias(c) for c in tracked],
        *[F.when(rewrite, F.col(f"a.{c}")).otherwise(F.col(f"d.{c}")).alias(c) for c in overwrite],
        "d.valid_from",
        F.when(close, F.date_sub(day, 1)).otherwise(F.col("d.valid_to")).alias("valid_to"),
        (F.col("d.is_current") & ~close).alias("is_current"),
    )
    opened_today = dim.where(F.col("is_current") & (F.col("valid_from") >= day)).select(key).distinct()
    opened = acted.where("action = 'NEW'").unionByName(
        acted.where("action = 'SCD2_CHANGE'").join(opened_today, key, "left_anti")
    )
    if activity is not None:
        opened = opened.join(activity, key, "left")
        start = F.when(F.col("action") == "NEW", F.coalesce("first_date", day)).otherwise(day)
    else:
        start = day
    fresh = opened.select(
        key, *tracked, *overwrite, start.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current")
    )
    return kept.select(columns).unionByName(fresh.select(columns))


def scd2_from_timeline(
    timeline: DataFrame, key: str, effective: str, columns: list[str], attributes: DataFrame | None = None, order: list[Column] | None = None
) -> DataFrame:
    """Versions from a change log; of several rows on one (key, effective date) the first by ``order`` counts.

    Without ``order``, the largest values of ``columns`` count, which is total:
    rows that tie are equal.
    """
    one = dedup_latest(timeline, [key, effective], [*(order or []), *[F.desc_nulls_last(c) for c in columns]])
    w = Window.partitionBy(key).orderBy(effective)
    until = F.date_sub(F.lead(effective).over(w), 1)
    versions = one.select(key, *columns, F.col(effective).alias("valid_from"), until.alias("valid_to")).withColumn(
        "is_current", F.col("valid_to").isNull()
    )
    return versions if attributes is None else versions.join(attributes, key)


def timeline_orphans(timeline: DataFrame, attributes: DataFrame, key: str) -> DataFrame:
    """Versions without a row of attributes."""
    return timeline.join(attributes.select(key), key, "left_anti")


def with_surrogate(dim: DataFrame, key: str, name: str = "surrogate_key") -> DataFrame:
    return dim.withColumn(name, surrogate_key(key, "valid_from"))
