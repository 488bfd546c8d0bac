"""Dimension builds over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dims, scd
from .retail import DIM, ORDERS, TIMELINE, customer_dim, customer_timeline, key_sql, orders, table
from .silver import AFTER, STATES, _customers

T0, T1 = "1998-01-01", AFTER


def _snapshot(spark: SparkSession, d: str, until: str) -> DataFrame:
    return _customers(spark, d, until).select("o_custkey", "priority", "status")


def _first_dim(spark: SparkSession, d: str) -> DataFrame:
    """The dimension as the first load left it: one open version per customer."""
    return _snapshot(spark, d, T0).select(
        "*", F.lit("1995-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current")
    )


def scd2_classify(spark: SparkSession, d: str) -> DataFrame:
    found = scd.scd2_classify(_snapshot(spark, d, T1), _first_dim(spark, d), "o_custkey", ["priority"], ["status"])
    return found.select("o_custkey", "action")


def scd2_apply(spark: SparkSession, d: str) -> DataFrame:
    """Two loads of the same snapshot; the second changes nothing."""
    snapshot = _snapshot(spark, d, T1)
    activity = scd.first_activity(orders(spark, d), "o_custkey", "order_date")
    once = scd.scd2_apply(snapshot, _first_dim(spark, d), "o_custkey", ["priority"], ["status"], T1, activity)
    return scd.scd2_apply(snapshot, once, "o_custkey", ["priority"], ["status"], T1, activity)


def first_activity(spark: SparkSession, d: str) -> DataFrame:
    return scd.first_activity(orders(spark, d), "o_custkey", "order_date")


def scd2_from_timeline(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    log = orders(spark, d).select("o_custkey", "order_date", F.col("o_orderpriority").alias("priority"))  # several rows a day
    return scd.scd2_from_timeline(log, "o_custkey", "order_date", ["priority"], names)


def timeline_orphans(spark: SparkSession, d: str) -> DataFrame:
    some = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return scd.timeline_orphans(customer_timeline(spark, d), some, "o_custkey")


def surrogate_key(spark: SparkSession, d: str) -> DataFrame:
    """The key of every version."""
    return scd.with_surrogate(customer_dim(spark, d), "o_custkey").select("o_custkey", "valid_from", "surrogate_key")


def dim_date(spark: SparkSession, d: str) -> DataFrame:
    """The calendar with the number of orders on each day."""
    n = orders(spark, d).groupBy("order_date").agg(F.count(F.lit(1)).alias("orders"))
    days = dims.dim_date(spark, "1995-01-01", "2030-12-31")
    return days.join(n, days["full_date"] == n["order_date"], "left").drop("order_date").withColumn("orders", F.coalesce("orders", F.lit(0)))


def lookup_dims(spark: SparkSession, d: str) -> DataFrame:
    """Both literal lookups with the number of their orders: finished orders are delivered, open ones shipped, others pending."""
    channels, statuses = dims.lookup_dims(spark)
    status = F.when(F.col("o_orderstatus") == "F", "DELIVERED").when(F.col("o_orderstatus") == "O", "SHIPPED").otherwise("PENDING")
    every = channels.select(F.lit("channel").alias("lookup"), F.col("channel_id").alias("id"), F.col("channel_name").alias("name"), F.col("channel_type").alias("category"), F.lit(0).alias("sort_order"))
    every = every.unionByName(statuses.select(F.lit("status").alias("lookup"), F.col("status_id").alias("id"), F.col("status_name").alias("name"), F.col("status_category").alias("category"), "sort_order"))
    used = orders(spark, d).select(F.explode(F.array(F.struct(F.lit("channel").alias("lookup"), F.col("channel").alias("id")), F.struct(F.lit("status").alias("lookup"), status.alias("id")))).alias("x"))
    n = used.groupBy("x.lookup", "x.id").agg(F.count(F.lit(1)).alias("orders"))
    return every.join(n, ["lookup", "id"], "left").withColumn("orders", F.coalesce("orders", F.lit(0)))


def _latest(spark: SparkSession, d: str, until: str, dim: DataFrame | None = None) -> DataFrame:
    bronze = orders(spark, d).where(F.col("order_date") < until)
    return dims.dim_from_bronze(bronze, "o_custkey", [F.desc("order_date"), F.desc("o_orderkey")], ["o_orderstatus", "order_date"], dim)


def dim_from_bronze(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d, T1)


def dim_synthesized(spark: SparkSession, d: str) -> DataFrame:
    """Nations named by customers or suppliers; those of region 0 are unknown, with a sentinel for direct sales."""
    ids = [table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))]
    lookup = table(spark, d, "nation").where("n_regionkey > 0")
    return dims.dim_synthesized(ids, "n_nationkey", lookup, ["n_name", "n_regionkey"], "status", sentinel="-1")


def dim_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The customers of the last year into the earlier dimension."""
    later = _latest(spark, d, T1).where(F.col("order_date") >= "1999-01-01")
    return dims.dim_upsert(_latest(spark, d, T0), later, ["o_custkey"])


QUERIES = {f.__name__: f for f in (scd2_classify, scd2_apply, first_activity, scd2_from_timeline, timeline_orphans, surrogate_key, dim_date, lookup_dims, dim_from_bronze, dim_synthesized, dim_upsert)}

ACTION = """CASE WHEN old.o_custkey IS NULL THEN 'NEW' WHEN new.priority <> old.priority THEN 'SCD2_CHANGE'
  WHEN new.status <> old.status THEN 'SCD1_OVERWRITE' ELSE 'UNCHANGED' END"""
LATEST = "SELECT o_custkey, o_orderstatus, order_date FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY order_date DESC, o_orderkey DESC) AS rn FROM ord WHERE order_date < DATE '{}') WHERE rn = 1"

ORACLE_SQL = {
    "scd2_classify": f"WITH {STATES} SELECT new.o_custkey, {ACTION} AS action FROM new LEFT JOIN old USING (o_custkey)",
    "scd2_apply": f"""WITH {STATES}, act AS (SELECT new.*, {ACTION} AS action FROM new LEFT JOIN old USING (o_custkey)),
        firsts AS (SELECT o_custkey, min(order_date) AS f FROM ord GROUP BY 1)
        SELECT old.o_custkey, old.priority, CASE WHEN action = 'SCD1_OVERWRITE' THEN act.status ELSE old.status END AS status, DATE '1995-01-01' AS valid_from,
        CASE WHEN action = 'SCD2_CHANGE' THEN CAST(DATE '{T1}' - INTERVAL 1 DAY AS DATE) END AS valid_to, coalesce(action, '') <> 'SCD2_CHANGE' AS is_current
        FROM old LEFT JOIN act USING (o_custkey)
        UNION ALL SELECT o_custkey, priority, status, CASE WHEN action = 'NEW' THEN f ELSE DATE '{T1}' END, NULL, TRUE
        FROM act LEFT JOIN firsts USING (o_custkey) WHERE action IN ('NEW', 'SCD2_CHANGE')""",
    "first_activity": f"WITH {ORDERS} SELECT o_custkey, min(order_date) AS first_date FROM ord GROUP BY 1",
    "scd2_from_timeline": f"WITH {DIM} SELECT o_custkey, priority, valid_from, valid_to, valid_to IS NULL AS is_current, c_mktsegment FROM dim JOIN customer ON c_custkey = o_custkey",
    "timeline_orphans": f"WITH {TIMELINE} SELECT * FROM timeline WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')",
    "surrogate_key": f"WITH {TIMELINE} SELECT o_custkey, order_date AS valid_from, {key_sql('o_custkey', 'order_date')} AS surrogate_key FROM timeline",
    "dim_date": f"""WITH {ORDERS}, days AS (SELECT CAST(x AS DATE) AS d FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2030-12-31', INTERVAL 1 DAY)) AS x)),
        hol AS (SELECT * FROM (VALUES ('01-01', 'New Year''s Day'), ('01-26', 'Republic Day'), ('08-15', 'Independence Day'), ('10-02', 'Gandhi Jayanti'), ('12-25', 'Christmas Day')) AS h(md, name)),
        n AS (SELECT order_date, count(*) AS orders FROM ord GROUP BY 1)
        SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_id, d AS full_date, dayname(d) AS day_of_week, CAST(day(d) AS INTEGER) AS day_number,
        CAST(weekofyear(d) AS INTEGER) AS week_number, CAST(month(d) AS INTEGER) AS month_number, monthname(d) AS month_name, CAST(quarter(d) AS INTEGER) AS quarter,
        CAST(year(d) AS INTEGER) AS year, CAST(year(d) - CASE WHEN month(d) >= 4 THEN 0 ELSE 1 END AS INTEGER) AS fiscal_year,
        CAST((month(d) + 8) % 12 // 3 + 1 AS INTEGER) AS fiscal_quarter, isodow(d) >= 6 AS is_weekend, name IS NOT NULL AS is_public_holiday, name AS holiday_name,
        coalesce(orders, 0) AS orders FROM days LEFT JOIN hol ON md = strftime(d, '%m-%d') LEFT JOIN n ON order_date = d""",
    "lookup_dims": f"""WITH {ORDERS}, l AS (SELECT * FROM (VALUES ('channel', 'D2C', 'Direct to Consumer', 'D2C', 0), ('channel', 'B2B', 'Business to Business', 'B2B', 0), ('channel', 'STORE', 'Physical Store', 'STORE', 0),
        ('status', 'PENDING', 'Pending', 'ACTIVE', 1), ('status', 'PROCESSING', 'Processing', 'ACTIVE', 2), ('status', 'SHIPPED', 'Shipped', 'ACTIVE', 3), ('status', 'DELIVERED', 'Delivered', 'CLOSED', 4),
        ('status', 'CANCELLED', 'Cancelled', 'EXCEPTION', 5), ('status', 'RETURN_INITIATED', 'Return Initiated', 'EXCEPTION', 6), ('status', 'RETURNED', 'Returned', 'EXCEPTION', 7)) AS v(lookup, id, name, category, sort_order)),
        n AS (SELECT 'channel' AS lookup, channel AS id, count(*) AS orders FROM ord GROUP BY 2
        UNION ALL SELECT 'status', CASE o_orderstatus WHEN 'F' THEN 'DELIVERED' WHEN 'O' THEN 'SHIPPED' ELSE 'PENDING' END, count(*) FROM ord GROUP BY 2)
        SELECT lookup, id, name, category, CAST(sort_order AS INTEGER) AS sort_order, coalesce(orders, 0) AS orders FROM l LEFT JOIN n USING (lookup, id)""",
    "dim_from_bronze": f"WITH {ORDERS} {LATEST.format(T1)}",
    "dim_synthesized": """SELECT id AS n_nationkey, n_name, n_regionkey, CASE WHEN n_nationkey IS NULL THEN 'UNKNOWN' ELSE 'KNOWN' END AS status FROM
        (SELECT c_nationkey AS id FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT -1) LEFT JOIN nation ON n_nationkey = id AND n_regionkey > 0""",
    "dim_upsert": f"""WITH {ORDERS}, a AS ({LATEST.format(T0)}), b AS (SELECT * FROM ({LATEST.format(T1)}) WHERE order_date >= DATE '1999-01-01')
        SELECT * FROM b UNION ALL SELECT * FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM b)""",
}
