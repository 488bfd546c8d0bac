"""Run metadata as tables: watermarks, file registry, run log, incidents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import read_if_exists, write_observed
from .merge import merge


def watermark_upsert(marks: DataFrame, loaded: DataFrame, entity: str, ts: str, environment: str) -> DataFrame:
    """New high-water marks per entity, merged so that a mark never goes back."""
    new = loaded.groupBy(F.col(entity).alias("entity_name")).agg(F.max(ts).alias("last_successful_load"))
    new = new.select("entity_name", F.lit(environment).alias("environment"), "last_successful_load")
    return merge(marks.select(new.columns), new, ["entity_name", "environment"], guard="last_successful_load")


def file_registry(files: DataFrame) -> DataFrame:
    """One record per landed file: path, rows, modification time."""
    return files.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_modification_time").alias("landed_at")
    )


def unprocessed(registry: DataFrame, bronze: DataFrame) -> DataFrame:
    return registry.join(bronze.select(F.col("_source_file").alias("path")), "path", "left_anti")


def run_log(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Runs from their events: the first end closes a run, open runs keep a null end."""
    w = Window.partitionBy("run_id").orderBy("end_time", "status")
    first = ends.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    seconds = F.col("end_time").cast("timestamp").cast("long") - F.col("start_time").cast("timestamp").cast("long")
    return starts.join(first, "run_id", "left").withColumn("seconds", seconds)


CONTENT = ["component", "cause", "started", "ended", "alerts", "evidence"]


def merged_alerts(found: list[DataFrame], gap_days: int = 1) -> DataFrame:
    """Alerts ``(component, failed_at, cause, detail, confidence)`` as incidents: alerts of one component and cause at most ``gap_days`` apart are one.

    ``(incident_id, component, cause, started, ended, alerts, evidence,
    confidence)``; the id is a digest of the content.  Days are gathered before
    they are ordered, so what is ordered has one row per day.
    """
    every = reduce(DataFrame.unionByName, found)
    days = every.groupBy("component", "cause", F.to_date("failed_at").alias("day")).agg(
        F.count(F.lit(1)).alias("alerts"), F.collect_set("detail").alias("details"), F.max("confidence").alias("confidence")
    )
    w = Window.partitionBy("component", "cause").orderBy("day")
    opens = F.coalesce(F.datediff("day", F.lag("day").over(w)) > gap_days, F.lit(True))
    islands = days.withColumn("opens", opens.cast("int")).withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    told = islands.groupBy("component", "cause", "island").agg(
        F.min("day").alias("started"),
        F.max("day").alias("ended"),
        F.sum("alerts").alias("alerts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("details")))).alias("evidence"),
        F.max("confidence").alias("confidence"),
    )
    content = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in CONTENT])
    return told.select(F.sha2(content, 256).alias("incident_id"), *CONTENT, "confidence")


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows of ``df`` whose key the table does not have yet, once each, and return their number: a repeated run adds nothing."""
    held = read_if_exists(df.sparkSession, path)
    fresh = df.dropDuplicates([key])
    if held is not None:
        fresh = fresh.join(held.select(key), key, "left_anti").select(held.columns)
    return write_observed(fresh, path, "append")["rows"]


def incidents(found: list[DataFrame]) -> DataFrame:
    """Detector outputs ``(component, failed_at, cause, detail, confidence)`` as one row per component, time and cause."""
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    return every.groupBy("component", "failed_at", "cause").agg(
        F.array_sort(F.collect_set("detail")).alias("evidence"), F.max("confidence").alias("confidence")
    )
