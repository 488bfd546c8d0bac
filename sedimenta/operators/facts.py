"""Fact measures, rollups and calendar windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
SUM = "decimal(14,2)"
#: Totals over any number of rows: what a sum of ``SUM`` columns has in Spark, so a large table does not overflow it.
TOTAL = "decimal(24,2)"


def money(column: str | Column) -> Column:
    """To two decimal places before any arithmetic, so sums do not depend on their order."""
    return (F.col(column) if isinstance(column, str) else column).cast(MONEY)


def territory_derive(channel: Column, by_channel: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for name, value in by_channel.items():
        out = F.when(channel == name, value).otherwise(out)
    return out


def line_measures(df: DataFrame, price: str, quantity: str, discount: str, rate: str = "0.18") -> DataFrame:
    """Gross, discount, line total, tax at a decimal rate rounded half up, and net revenue."""
    total = (money(price) * F.col(quantity).cast("decimal(10,0)") * (F.lit(1).cast("decimal(3,2)") - F.col(discount).cast("decimal(3,2)"))).cast(SUM)
    gross = (money(price) * F.col(quantity).cast("decimal(10,0)")).cast(SUM)
    return df.withColumns({"unit_price": money(price), "gross_revenue": gross, "line_total": total}).withColumns(
        {
            "discount_amount": (F.col("gross_revenue") - F.col("line_total")).cast(SUM),
            "tax_amount": F.round(F.col("line_total") * F.lit(rate).cast("decimal(4,2)"), 2).cast(SUM),
            "net_revenue": F.col("line_total"),
        }
    )


def channel_revenue(lines: DataFrame, grain: list[str], order: str, returned: Column) -> DataFrame:
    """Rollup of measured lines: distinct orders, lines, units, gross, discount, net, tax, average order value and return rate."""
    grouped = lines.groupBy(*grain).agg(
        F.count_distinct(order).alias("total_orders"),
        F.count(F.lit(1)).alias("total_lines"),
        F.sum(F.col("quantity").cast("long")).alias("total_units"),
        F.sum("gross_revenue").cast(TOTAL).alias("gross_revenue"),
        F.sum("discount_amount").cast(TOTAL).alias("total_discount"),
        F.sum("net_revenue").cast(TOTAL).alias("net_revenue"),
        F.sum("tax_amount").cast(TOTAL).alias("total_tax"),
        F.count_if(returned).alias("returned_lines"),
    )
    return grouped.select(
        "*",
        F.round(F.try_divide(F.col("net_revenue"), F.col("total_orders")), 2).cast(TOTAL).alias("avg_order_value"),
        F.round(F.try_divide(F.col("returned_lines") * 100, F.col("total_lines")), 2).cast("decimal(5,2)").alias("return_rate_pct"),
    )


def rolling_days(df: DataFrame, keys: list[str], day: str, measure: str, days: int = 7) -> DataFrame:
    """Mean and count over the last ``days`` calendar days, the row's own included."""
    w = Window.partitionBy(*keys).orderBy(F.unix_date(day)).rangeBetween(-(days - 1), 0)
    return df.withColumns({"rolling_avg": F.avg(measure).over(w), "rolling_days": F.count(F.lit(1)).over(w)})


def days_of_stock(stock: Column, average: Column, days: Column, full: int = 7) -> Column:
    """Whole days that the stock lasts; null with fewer than ``full`` days or nothing sold."""
    return F.when((days >= full) & (average > 0), F.floor(stock / average).cast("int"))


def fact_summary(lines: DataFrame, channel: str) -> DataFrame:
    """Lines and grand totals by channel, and over all as channel ALL."""
    sums = [F.count(F.lit(1)).alias("rows"), F.sum(F.col("quantity").cast("long")).alias("units"), F.sum("line_total").cast(TOTAL).alias("total"), F.sum("tax_amount").cast(TOTAL).alias("tax")]
    return lines.groupBy(F.col(channel).alias("channel")).agg(*sums).unionByName(
        lines.agg(*sums).withColumn("channel", F.lit("ALL"))
    )


def inventory_profile(df: DataFrame, day: str, product: str, store: str, stock: str, derived: str) -> DataFrame:
    return df.groupBy(day).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(product).alias("products"),
        F.count_distinct(store).alias("stores"),
        F.sum(stock).alias("stock"),
        F.count_if(F.col(stock) == 0).alias("stockouts"),
        F.count(derived).alias("with_derived"),
    )
