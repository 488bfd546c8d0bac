"""Deduplication, rules, quarantine and merges over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keys, merge, rules, scd
from ..operators.meta import append_new
from ..sources import storage
from .retail import LINES, ORDERS, orders, silver_lines, table

RUN, RUN_TS = "run-1", "2024-02-01 06:00:00"
#: A day after the last order.
AFTER = "2010-01-01"


def dedup_latest(spark: SparkSession, d: str) -> DataFrame:
    return silver_lines(spark, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("ship_date"), F.col("l_extendedprice").cast("decimal(12,2)").alias("price")
    )


def dedup_latest_composite(spark: SparkSession, d: str) -> DataFrame:
    """Latest event per (user, type, day), whatever its id."""
    events = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return keys.dedup_latest(events, ["user_id", "event_type", "day"], [F.desc("ts"), F.desc("event_id")]).select(
        "user_id", "event_type", "day", "event_id"
    )


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    """Lines against the parts in stock (not of brand 7) and suppliers of even nations."""
    parts = table(spark, d, "part").where("p_brand <> 'Brand#7'")
    suppliers = table(spark, d, "supplier").where("s_nationkey % 2 = 0")
    lines = silver_lines(spark, d)
    lines = keys.fk_flag(lines, parts, "l_partkey", "p_partkey", "part_known")
    return keys.fk_flag(lines, suppliers, "l_suppkey", "s_suppkey", "supplier_known")


def fk_flag(spark: SparkSession, d: str) -> DataFrame:
    return _flagged(spark, d).select("l_orderkey", "l_linenumber", "part_known", "supplier_known")


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """A third of the lines have no discount recorded; flag N counts as unknown status."""
    lines = _flagged(spark, d).withColumns(
        {
            "discount": F.when(F.col("l_orderkey") % 3 != 0, F.col("l_discount")),
            "quantity": F.col("l_quantity") - 2,
            "status": F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")),
        }
    )
    return rules.dq_tag(
        lines,
        [
            rules.not_null("NULL_DISCOUNT", "discount"),
            rules.positive("INVALID_QUANTITY", "quantity"),
            rules.in_set("INVALID_STATUS", "status", ["R"]),
            rules.known("UNKNOWN_PART", "part_known"),
            rules.known("UNKNOWN_SUPPLIER", "supplier_known"),
            rules.required_when("DISCOUNT_REQUIRED", "discount", F.col("l_linestatus") == "F"),
        ],
    )


def dq_tag(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).select("l_orderkey", "l_linenumber", "dq_passed", "dq_rejection_reason")


def dq_split(spark: SparkSession, d: str) -> DataFrame:
    return rules.dq_counts(_tagged(spark, d))


def dq_store(spark: SparkSession, d: str) -> DataFrame:
    """Both sides as stored, with the numbers observed while they were written."""
    passed, rejected, counts = rules.dq_store(_tagged(spark, d).select("l_orderkey", "l_linenumber", "dq_rejection_reason", "dq_passed"), storage.scratch(spark, "tagged"))
    sides = [df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("rows"), F.sum("l_orderkey").alias("keys")).withColumn("observed", F.lit(counts[side])) for side, df in (("passed", passed), ("rejected", rejected))]
    return sides[0].unionByName(sides[1])


def quarantine_append(spark: SparkSession, d: str) -> DataFrame:
    """The append-only table after the same run wrote twice and a second run once."""
    path, stored = storage.scratch(spark, "quarantine"), storage.scratch(spark, "rejected")
    _, rejected = rules.dq_split(_tagged(spark, d))
    rejected.select("l_orderkey", "l_linenumber", "l_partkey", "dq_rejection_reason").write.parquet(stored)
    rejected = spark.read.parquet(stored)  # lines are tagged once for the three runs
    rows = rules.quarantine_envelope(rejected, ["l_orderkey", "l_linenumber", "l_partkey"], RUN, RUN_TS, "lines")
    added = [append_new(rows, path, "quarantine_id") for _ in range(2)]
    rejected = rejected.where("l_linenumber = 1")
    added.append(append_new(rules.quarantine_envelope(rejected, ["l_orderkey", "l_linenumber", "l_partkey"], "run-2", RUN_TS, "lines"), path, "quarantine_id"))
    held = spark.read.parquet(path).groupBy("pipeline_run_id", "rejection_reason").agg(F.count(F.lit(1)).alias("rows"))
    return held.withColumn("added_again", F.lit(added[1]))


def _quarantined(spark: SparkSession, d: str) -> DataFrame:
    _, rejected = rules.dq_split(_tagged(spark, d))
    return rules.quarantine_envelope(rejected, ["l_orderkey", "l_linenumber", "l_partkey"], RUN, RUN_TS, "lines")


def quarantine_envelope(spark: SparkSession, d: str) -> DataFrame:
    return _quarantined(spark, d).select("quarantine_id", "rejection_reason", "pipeline_run_id", "raw_record", "source_table")


def _customers(spark: SparkSession, d: str, until: str) -> DataFrame:
    """Each customer as of a day: priority and status of the latest order before it."""
    latest = keys.dedup_latest(orders(spark, d).where(F.col("order_date") < until), ["o_custkey"], [F.desc("order_date"), F.desc("o_orderkey")])
    return latest.select("o_custkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.col("order_date").alias("updated"))


def change_tracking(spark: SparkSession, d: str) -> DataFrame:
    return scd.change_tracking(_customers(spark, d, AFTER), _customers(spark, d, "1998-01-01"), "o_custkey", ["priority", "status"])


def upsert_guarded(spark: SparkSession, d: str) -> DataFrame:
    """New rows into the older state; a third of them are dated back and must not win."""
    source = _customers(spark, d, AFTER).withColumn(
        "updated", F.when(F.col("o_custkey") % 3 == 0, F.lit("1990-01-01").cast("date")).otherwise(F.col("updated"))
    )
    return merge.merge(_customers(spark, d, "1998-01-01"), source, ["o_custkey"], guard="updated")


def reject_breakdown(spark: SparkSession, d: str) -> DataFrame:
    tagged = _tagged(spark, d)
    whole = rules.reject_breakdown(tagged).withColumn("kind", F.lit("reason"))
    return whole.unionByName(rules.reject_breakdown(tagged, per_code=True).withColumn("kind", F.lit("code")))


def layer_counts(spark: SparkSession, d: str) -> DataFrame:
    tagged = _tagged(spark, d)
    passed, rejected = rules.dq_split(tagged)
    return rules.layer_counts("lines", table(spark, d, "lineitem"), passed, rejected, _quarantined(spark, d))


def transition_counts(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.funnel import status_transitions

    moves = status_transitions(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")
    return rules.transition_counts(moves, "from_status", "to_status")


def _bronze(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Bronze rows of orders, lines, customers and products, with faults in them."""
    o = orders(spark, d)
    status = F.when(F.col("o_orderstatus") == "F", "DELIVERED").when(F.col("o_orderstatus") == "O", "SHIPPED")
    return {
        "customers": table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("customer_id")),
        "products": table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("product_id")),
        "orders": o.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.when(F.col("channel") == "D2C", F.when(F.col("o_orderpriority") == "5-LOW", "WEB").otherwise("D2C")).otherwise(F.col("channel")).alias("channel_type"),
            "order_date",
            status.alias("status"),
            (F.col("o_totalprice") - 50_000).alias("total_amount"),
            F.when(F.col("o_totalprice") < 300_000, F.col("o_custkey")).alias("store_id"),
            F.when(F.col("o_totalprice") > 100_000, F.col("o_custkey")).alias("rep_id"),
            F.to_timestamp("order_date").alias("_bronze_timestamp"),
        ),
        "order_lines": table(spark, d, "lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            (F.col("l_quantity").cast("int") - 3).alias("quantity"),
            (F.col("l_extendedprice") - 5_000).alias("unit_price"),
            F.col("l_shipdate").alias("_bronze_timestamp"),
            "l_suppkey",
        ),
    }


def entity_orders(spark: SparkSession, d: str) -> DataFrame:
    from .entities import entities

    bronze = _bronze(spark, d)
    return entities()["orders"].tag(bronze["orders"], bronze, [F.col("order_id")]).select("order_id", "dq_passed", "dq_rejection_reason")


def entity_order_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines against orders that passed and products that are known."""
    from .entities import entities

    bronze = _bronze(spark, d)
    passed = entities()["orders"].tag(bronze["orders"], bronze, [F.col("order_id")]).where("dq_passed")
    ties = [F.desc("unit_price"), F.col("product_id"), F.col("l_suppkey"), F.col("quantity")]
    found = entities()["order_lines"].tag(bronze["order_lines"], bronze | {"orders": passed}, ties)
    return found.select("line_id", "dq_passed", "dq_rejection_reason")


QUERIES = {f.__name__: f for f in (entity_orders, entity_order_lines, dedup_latest, dedup_latest_composite, fk_flag, dq_tag, dq_split, dq_store, quarantine_envelope, quarantine_append, change_tracking, upsert_guarded, reject_breakdown, layer_counts, transition_counts)}

FLAGGED = f"""{LINES}, fl AS (SELECT *, EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_brand <> 'Brand#7') AS part_known,
  EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_nationkey % 2 = 0) AS supplier_known FROM lines)"""
TAGGED = f"""{FLAGGED}, codes AS (SELECT *, list_filter([
  CASE WHEN l_orderkey % 3 = 0 THEN 'NULL_DISCOUNT' END, CASE WHEN l_quantity - 2 <= 0 THEN 'INVALID_QUANTITY' END,
  CASE WHEN l_returnflag NOT IN ('N', 'R') THEN 'INVALID_STATUS' END, CASE WHEN NOT part_known THEN 'UNKNOWN_PART' END,
  CASE WHEN NOT supplier_known THEN 'UNKNOWN_SUPPLIER' END, CASE WHEN l_linestatus = 'F' AND l_orderkey % 3 = 0 THEN 'DISCOUNT_REQUIRED' END],
  lambda x: x IS NOT NULL) AS c FROM fl),
tagged AS (SELECT *, len(c) = 0 AS dq_passed, nullif(array_to_string(c, ';'), '') AS dq_rejection_reason FROM codes)"""
STATE = """SELECT o_custkey, o_orderpriority AS priority, o_orderstatus AS status, order_date AS updated FROM
  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY order_date DESC, o_orderkey DESC) AS rn FROM ord WHERE order_date < DATE '{}') WHERE rn = 1"""
STATES = f"{ORDERS}, old AS ({STATE.format('1998-01-01')}), new AS ({STATE.format(AFTER)})"
RAW = """'{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || '}'"""

ENTITY = f"""{ORDERS}, ent AS (SELECT *, list_filter([
  CASE WHEN NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'BUILDING') THEN 'UNKNOWN_CUSTOMER_ID' END,
  CASE WHEN channel = 'D2C' AND o_orderpriority = '5-LOW' THEN 'INVALID_CHANNEL_TYPE' END,
  CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'NULL_STATUS' END, CASE WHEN o_totalprice - 50000 <= 0 THEN 'INVALID_TOTAL_AMOUNT' END,
  CASE WHEN channel = 'STORE' AND o_totalprice >= 300000 THEN 'STORE_MISSING_STORE_ID' END, CASE WHEN channel = 'B2B' AND o_totalprice <= 100000 THEN 'B2B_MISSING_REP_ID' END],
  lambda x: x IS NOT NULL) AS c FROM ord)"""

ORACLE_SQL = {
    "entity_orders": f"WITH {ENTITY} SELECT o_orderkey AS order_id, len(c) = 0 AS dq_passed, nullif(array_to_string(c, ';'), '') AS dq_rejection_reason FROM ent",
    "entity_order_lines": f"""WITH {ENTITY}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1),
        t AS (SELECT *, list_filter([CASE WHEN NOT EXISTS (SELECT 1 FROM ent WHERE o_orderkey = l_orderkey AND len(c) = 0) THEN 'UNKNOWN_ORDER_ID' END,
        CASE WHEN NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 5) THEN 'UNKNOWN_PRODUCT_ID' END,
        CASE WHEN CAST(l_quantity AS INTEGER) - 3 <= 0 THEN 'INVALID_QUANTITY' END, CASE WHEN l_extendedprice - 5000 <= 0 THEN 'INVALID_UNIT_PRICE' END], lambda x: x IS NOT NULL) AS c FROM l)
        SELECT l_orderkey * 10 + l_linenumber AS line_id, len(c) = 0 AS dq_passed, nullif(array_to_string(c, ';'), '') AS dq_rejection_reason FROM t""",
    "dedup_latest": f"WITH {LINES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS ship_date, CAST(l_extendedprice AS DECIMAL(12,2)) AS price FROM lines",
    "dedup_latest_composite": """SELECT user_id, event_type, day, event_id FROM (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER
        (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "fk_flag": f"WITH {FLAGGED} SELECT l_orderkey, l_linenumber, part_known, supplier_known FROM fl",
    "dq_tag": f"WITH {TAGGED} SELECT l_orderkey, l_linenumber, dq_passed, dq_rejection_reason FROM tagged",
    "dq_split": f"WITH {TAGGED} SELECT count(*) FILTER (dq_passed) AS passed, count(*) FILTER (NOT dq_passed) AS rejected, count(*) AS total FROM tagged",
    "dq_store": f"""WITH {TAGGED} SELECT CASE WHEN dq_passed THEN 'passed' ELSE 'rejected' END AS side, count(*) AS rows, CAST(sum(l_orderkey) AS BIGINT) AS keys, count(*) AS observed FROM tagged GROUP BY 1""",
    "quarantine_append": f"""WITH {TAGGED} SELECT 'run-1' AS pipeline_run_id, dq_rejection_reason AS rejection_reason, count(*) AS rows, 0 AS added_again FROM tagged WHERE NOT dq_passed GROUP BY 2
        UNION ALL SELECT 'run-2', dq_rejection_reason, count(*), 0 FROM tagged WHERE NOT dq_passed AND l_linenumber = 1 GROUP BY 2""",
    "quarantine_envelope": f"""WITH {TAGGED} SELECT sha256('run-1|lines|' || {RAW}) AS quarantine_id, dq_rejection_reason AS rejection_reason,
        'run-1' AS pipeline_run_id, {RAW} AS raw_record, 'lines' AS source_table FROM tagged WHERE NOT dq_passed""",
    "change_tracking": f"""WITH {STATES} SELECT new.*, old.priority AS _prev_priority, old.status AS _prev_status,
        old.o_custkey IS NOT NULL AND (new.priority IS DISTINCT FROM old.priority OR new.status IS DISTINCT FROM old.status) AS _scd_changed
        FROM new LEFT JOIN old USING (o_custkey)""",
    "upsert_guarded": f"""WITH {STATES}, src AS (SELECT o_custkey, priority, status, CASE WHEN o_custkey % 3 = 0 THEN DATE '1990-01-01' ELSE updated END AS updated FROM new)
        SELECT coalesce(o.o_custkey, s.o_custkey) AS o_custkey, CASE WHEN o.o_custkey IS NULL OR s.updated >= o.updated THEN s.priority ELSE o.priority END AS priority,
        CASE WHEN o.o_custkey IS NULL OR s.updated >= o.updated THEN s.status ELSE o.status END AS status,
        CASE WHEN o.o_custkey IS NULL OR s.updated >= o.updated THEN s.updated ELSE o.updated END AS updated
        FROM old o FULL JOIN src s ON o.o_custkey = s.o_custkey""",
    "reject_breakdown": f"""WITH {TAGGED} SELECT dq_rejection_reason AS reason, count(*) AS rows, 'reason' AS kind FROM tagged WHERE NOT dq_passed GROUP BY 1
        UNION ALL SELECT code, count(*), 'code' FROM (SELECT unnest(c) AS code FROM tagged) GROUP BY 1""",
    "layer_counts": f"""WITH {TAGGED} SELECT 'lines' AS entity, 'bronze' AS layer, (SELECT count(*) FROM lineitem) AS rows
        UNION ALL SELECT 'lines', 'silver', count(*) FILTER (dq_passed) FROM tagged UNION ALL SELECT 'lines', 'dq_failed', count(*) FILTER (NOT dq_passed) FROM tagged
        UNION ALL SELECT 'lines', 'quarantine', count(*) FILTER (NOT dq_passed) FROM tagged""",
    "transition_counts": """SELECT from_status, to_status, count(*) AS rows FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_status,
        event_type AS to_status FROM events) WHERE from_status IS NOT NULL GROUP BY 1, 2 ORDER BY rows DESC, 1, 2 LIMIT 10""",
}
