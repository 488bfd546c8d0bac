"""The retail entities as views of the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts, keys, scd

LINE_KEYS = ["l_orderkey", "l_linenumber"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def line_order() -> list:
    return [
        F.desc("l_shipdate"),
        F.desc("l_extendedprice"),
        *[F.asc(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")],
    ]


def silver_lines(spark: SparkSession, d: str) -> DataFrame:
    """Deduplicated lines, dealt by order alone, so a join with orders moves them no second time."""
    return keys.dedup_latest(table(spark, d, "lineitem").repartition("l_orderkey"), LINE_KEYS, line_order())


def orders(spark: SparkSession, d: str) -> DataFrame:
    lead = F.substring("o_orderpriority", 1, 1)
    channel = F.when(lead.isin("1", "2"), "B2B").when(lead == "3", "STORE").otherwise("D2C")
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("order_date"), "o_orderpriority", channel.alias("channel"), "o_totalprice"
    )


def priced_lines(spark: SparkSession, d: str, of: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Deduplicated lines with their order and category, from which the measures follow.  ``of``: orders with further columns; ``how``: "left" keeps lines without an order."""
    lines = silver_lines(spark, d).join(orders(spark, d) if of is None else of, F.col("l_orderkey") == F.col("o_orderkey"), how)
    lines = lines.join(table(spark, d, "part").select("p_partkey", F.col("p_type").alias("category")), F.col("l_partkey") == F.col("p_partkey"), "left")
    return lines.withColumn("quantity", F.col("l_quantity").cast("int"))


def measures(lines: DataFrame) -> DataFrame:
    """Priced lines with their measures, which are told again where they are needed and not moved or stored."""
    return facts.line_measures(lines, "l_extendedprice", "quantity", "l_discount")


def measured_lines(spark: SparkSession, d: str) -> DataFrame:
    """Deduplicated lines with their order, category and measures."""
    return measures(priced_lines(spark, d))


def orders_of_nations(spark: SparkSession, d: str) -> DataFrame:
    """Orders with whether their customer is known, and the customer's nation (the largest, should a customer be listed twice)."""
    customers = table(spark, d, "customer").groupBy(F.col("c_custkey").alias("_key")).agg(F.max("c_nationkey").alias("nation"))
    return keys.join_spread(orders(spark, d), customers.withColumn("customer_known", F.lit(True)), "o_custkey")


def customer_timeline(spark: SparkSession, d: str) -> DataFrame:
    """One row per customer and order day: the day's highest priority."""
    return orders(spark, d).groupBy("o_custkey", "order_date").agg(F.max("o_orderpriority").alias("priority"))


def customer_dim(spark: SparkSession, d: str) -> DataFrame:
    return scd.scd2_from_timeline(customer_timeline(spark, d), "o_custkey", "order_date", ["priority"])


def customers_of_nations(spark: SparkSession, d: str) -> DataFrame:
    """The customer dimension with whether the customer is known, and the nation as in ``orders_of_nations``; dealt by customer as the timeline was."""
    listed = table(spark, d, "customer").groupBy(F.col("c_custkey").alias("_key")).agg(F.max("c_nationkey").alias("nation")).withColumn("customer_known", F.lit(True))
    return customer_dim(spark, d).join(listed, F.col("o_custkey") == F.col("_key"), "left").drop("_key")


def product_dim(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    """Versions of parts by the days on which they shipped: the day's largest return flag.  ``lines``: silver lines built before."""
    days = (silver_lines(spark, d) if lines is None else lines).select("l_partkey", F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("product_class"))
    return scd.scd2_from_timeline(days, "l_partkey", "day", ["product_class"])


def rep_dim(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    """Versions of suppliers, as sales reps, by order day: the largest nation of the day's customers is their territory.  ``lines``: lines of ``orders_of_nations`` built before."""
    if lines is None:
        lines = silver_lines(spark, d).join(orders_of_nations(spark, d), F.col("l_orderkey") == F.col("o_orderkey"))
    days = lines.where("customer_known").select("l_suppkey", "order_date", F.col("nation").alias("rep_nation"))
    return scd.scd2_from_timeline(days, "l_suppkey", "order_date", ["rep_nation"])


def stock(spark: SparkSession, d: str) -> DataFrame:
    """Events by type and one of 25 groups of users, as a daily snapshot of (product, store, day)."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("product"), F.pmod("user_id", F.lit(25)).alias("store"), F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("units"), F.sum(F.col("value").cast("decimal(12,2)")).cast("decimal(14,2)").alias("stock")
    )


def stock_dim(spark: SparkSession, d: str) -> DataFrame:
    """Versions of event types by day: the number of users that day, at most nine."""
    users = table(spark, d, "events").groupBy(F.col("event_type").alias("product"), F.to_date("ts").alias("day")).agg(
        F.least(F.count_distinct("user_id"), F.lit(9)).alias("reach")
    )
    return scd.scd2_from_timeline(users, "product", "day", ["reach"])


def inventory(spark: SparkSession, d: str) -> DataFrame:
    """Events by user, type and day, as a daily snapshot of (product, store, day)."""
    return table(spark, d, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("units"), F.sum(F.col("value").cast("decimal(12,2)")).cast("decimal(14,2)").alias("stock")
    )


# The same views in SQL.
LINES = """lines AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS rn
  FROM lineitem) WHERE rn = 1)"""
ORDERS = """ord AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS order_date, o_orderpriority,
  CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN 'B2B' WHEN left(o_orderpriority, 1) = '3' THEN 'STORE' ELSE 'D2C' END AS channel,
  o_totalprice FROM orders)"""
MEASURED = f"""{LINES}, {ORDERS}, priced AS (SELECT lines.*, ord.*, p_type AS category, CAST(l_quantity AS INTEGER) AS quantity,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(CAST(l_quantity AS INTEGER) AS DECIMAL(10,0)) * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(3,2))) AS DECIMAL(14,2)) AS line_total
  FROM lines JOIN ord ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey),
m AS (SELECT *, CAST(round(line_total * CAST(0.18 AS DECIMAL(4,2)), 2) AS DECIMAL(14,2)) AS tax_amount, line_total AS net_revenue,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS unit_price, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(quantity AS DECIMAL(10,0)) AS DECIMAL(14,2)) AS gross_revenue,
  CAST(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(quantity AS DECIMAL(10,0)) AS DECIMAL(14,2)) - line_total AS DECIMAL(14,2)) AS discount_amount FROM priced)"""
TIMELINE = f"{ORDERS}, timeline AS (SELECT o_custkey, order_date, max(o_orderpriority) AS priority FROM ord GROUP BY 1, 2)"
DIM = f"""{TIMELINE}, dim AS (SELECT o_custkey, priority, order_date AS valid_from,
  CAST(lead(order_date) OVER (PARTITION BY o_custkey ORDER BY order_date) - INTERVAL 1 DAY AS DATE) AS valid_to FROM timeline)"""
INVENTORY = """inv AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(*) AS units,
  CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(14,2)) AS stock FROM events GROUP BY 1, 2, 3)"""


def versions_sql(name: str, key: str, column: str, day: str, source: str) -> str:
    """A gap-free timeline in SQL: the largest value of a day counts; the first version reaches back to all days before it."""
    return f"""{name}_days AS (SELECT {key}, {day} AS valid_from, max({column}) AS {column} FROM {source} GROUP BY 1, 2),
  {name} AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN DATE '0001-01-01' ELSE valid_from END AS lo,
    coalesce(CAST(lead(valid_from) OVER w - INTERVAL 1 DAY AS DATE), DATE '9999-12-31') AS hi FROM {name}_days WINDOW w AS (PARTITION BY {key} ORDER BY valid_from))"""


def key_sql(key: str, day: str = "valid_from") -> str:
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '|' || strftime({day}, '%Y-%m-%d')), 1, 15) AS BIGINT)"


STOCK = """stk AS (SELECT event_type AS product, user_id % 25 AS store, CAST(ts AS DATE) AS day, count(*) AS units,
  CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(14,2)) AS stock FROM events GROUP BY 1, 2, 3)"""
STOCK_DIM = versions_sql("sdim", "product", "reach", "day", "(SELECT event_type AS product, CAST(ts AS DATE) AS day, least(count(DISTINCT user_id), 9) AS reach FROM events GROUP BY 1, 2)")
