"""Calendar, literal, type-1 and synthesised dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .keys import date_key, dedup_latest
from .merge import merge

# Public holidays by month and day.
HOLIDAYS = {
    "01-01": "New Year's Day",
    "01-26": "Republic Day",
    "08-15": "Independence Day",
    "10-02": "Gandhi Jayanti",
    "12-25": "Christmas Day",
}

# Channels, and order statuses with category and sort order.
CHANNELS = [
    ("D2C", "Direct to Consumer", "D2C", "Online direct-to-consumer ecommerce orders"),
    ("B2B", "Business to Business", "B2B", "Sales-rep-driven B2B orders"),
    ("STORE", "Physical Store", "STORE", "In-store retail purchases"),
]
STATUSES = [
    ("PENDING", "Pending", "ACTIVE", 1),
    ("PROCESSING", "Processing", "ACTIVE", 2),
    ("SHIPPED", "Shipped", "ACTIVE", 3),
    ("DELIVERED", "Delivered", "CLOSED", 4),
    ("CANCELLED", "Cancelled", "EXCEPTION", 5),
    ("RETURN_INITIATED", "Return Initiated", "EXCEPTION", 6),
    ("RETURNED", "Returned", "EXCEPTION", 7),
]


def dim_date(spark: SparkSession, first: str = "2020-01-01", last: str = "2030-12-31") -> DataFrame:
    """One row per day, with a fiscal year from April to March named by the year in which it begins."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("full_date"))
    d = F.col("full_date")
    holidays = F.create_map(*[F.lit(x) for pair in HOLIDAYS.items() for x in pair])
    holiday = F.try_element_at(holidays, F.date_format(d, "MM-dd"))
    return days.select(
        date_key(d).alias("date_id"),
        "full_date",
        F.date_format(d, "EEEE").alias("day_of_week"),
        F.dayofmonth(d).alias("day_number"),
        F.weekofyear(d).alias("week_number"),
        F.month(d).alias("month_number"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.quarter(d).alias("quarter"),
        F.year(d).alias("year"),
        (F.year(d) - F.when(F.month(d) >= 4, 0).otherwise(1)).alias("fiscal_year"),
        (F.floor(F.pmod(F.month(d) + 8, F.lit(12)) / 3) + 1).cast("int").alias("fiscal_quarter"),
        (F.weekday(d) >= 5).alias("is_weekend"),
        holiday.isNotNull().alias("is_public_holiday"),
        holiday.alias("holiday_name"),
    )


def lookup_dims(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return (
        spark.createDataFrame(CHANNELS, "channel_id string, channel_name string, channel_type string, description string"),
        spark.createDataFrame(STATUSES, "status_id string, status_name string, status_category string, sort_order int"),
    )


def dim_from_bronze(bronze: DataFrame, key: str, order: list[Column], columns: list[str], dim: DataFrame | None = None) -> DataFrame:
    """The latest row per key as a type-1 dimension, merged into ``dim``."""
    latest = dedup_latest(bronze, [key], order).select(key, *columns)
    return latest if dim is None else dim_upsert(dim, latest, [key])


def dim_synthesized(sources: list[DataFrame], key: str, lookup: DataFrame, columns: list[str], status: str, sentinel: str | None = None) -> DataFrame:
    """All ids that any source names, enriched by ``lookup``; unknown ids get nulls and ``status`` UNKNOWN."""
    ids = sources[0].select(key)
    for other in sources[1:]:
        ids = ids.union(other.select(key))
    ids = ids.where(F.col(key).isNotNull())
    if sentinel is not None:
        ids = ids.union(ids.sparkSession.range(1).select(F.lit(sentinel).cast(ids.schema[key].dataType).alias(key)))
    known = lookup.select(key, *columns, F.lit("KNOWN").alias(status))
    return ids.distinct().join(known, key, "left").withColumn(status, F.coalesce(status, F.lit("UNKNOWN")))


def dim_upsert(dim: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return merge(dim, source, keys)
