"""Run metadata and detectors over the test tables.

Loads are taken from the events: each (type, day) is a run of that type's load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cells, detect, funnel, joins, meta, router
from ..sources import landing, storage
from .retail import MEASURED, customer_dim, measured_lines, orders, silver_lines, table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("day", F.to_date("ts"))


def watermark_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Marks of the first half of the month without one type, moved on by a load of the rest of the month; an old load comes late."""
    events = _events(spark, d)
    marks = events.where("day < date'2024-01-15'").groupBy(F.col("event_type").alias("entity_name")).agg(F.max("ts").alias("last_successful_load"))
    marks = marks.where("entity_name <> 'view'").select("entity_name", F.lit("prod").alias("environment"), "last_successful_load")
    later = meta.watermark_upsert(marks, events.where("day >= date'2024-01-15'"), "event_type", "ts", "prod")
    found = meta.watermark_upsert(later, events.where("day < date'2024-01-05'"), "event_type", "ts", "prod")
    return found.select("entity_name", "environment", F.date_format("last_successful_load", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("mark"))


def file_registry(spark: SparkSession, d: str) -> DataFrame:
    """Landed days with their rows, and which of them bronze has not read yet."""
    root = storage.scratch(spark, "landing")
    landing.by_date_extract(table(spark, d, "events"), "ts", root)
    files = spark.read.parquet(root)
    registry = meta.file_registry(files)
    bronze = files.where("date < date'2024-01-20'").select(F.col("_metadata.file_path").alias("_source_file")).distinct()
    new = meta.unprocessed(registry, bronze).select("path", F.lit(True).alias("is_new"))
    per = registry.join(new, "path", "left").withColumn("day", landing.load_date(F.col("path")))
    return per.groupBy("day").agg(F.sum("rows").alias("rows"), F.coalesce(F.bool_and("is_new"), F.lit(False)).alias("is_new"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Starts and ends of runs: the first event of a type on a day, and its purchases-sized rest."""
    return _events(spark, d).groupBy(F.col("event_type").alias("entity"), "day").agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("rows_read"), F.count_if(F.col("value") < 1).alias("rows_rejected")
    ).withColumn("run_id", F.concat_ws("/", "entity", F.col("day").cast("string")))


def run_log(spark: SparkSession, d: str) -> DataFrame:
    """Every run's end is reported twice, the second time later; runs with few rows stay open."""
    runs = _runs(spark, d)
    ends = runs.where("rows_read > 8").select("run_id", F.col("last").alias("end_time"), F.lit("ok").alias("status"))
    again = ends.select("run_id", (F.col("end_time") + F.expr("interval 1 hour")).alias("end_time"), F.lit("failed").alias("status"))
    log = meta.run_log(runs.select("run_id", "entity", "start_time"), ends.unionByName(again))
    return log.select("run_id", "entity", "status", F.col("end_time").isNull().alias("is_open"), "seconds")


def volume_anomaly(spark: SparkSession, d: str) -> DataFrame:
    """Days with a fiftieth less than the week before; the last day has no events."""
    return detect.volume_anomaly(_events(spark, d), "ts", "2024-01-01", "2024-01-31", drop=0.02)


def _quarantine(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).where("value < 1").select(
        F.concat_ws("/", "event_type", F.col("day").cast("string")).alias("pipeline_run_id"),
        F.when(F.col("value") < 0.5, "TINY_VALUE").otherwise("SMALL_VALUE").alias("rejection_reason"),
    )


def reject_alert(spark: SparkSession, d: str) -> DataFrame:
    found = detect.reject_alert(_runs(spark, d).select("run_id", "rows_rejected"), _quarantine(spark, d))
    return found.select("run_id", "rows_rejected", F.array_join("reasons", ",").alias("reasons"))


def duration_anomaly(spark: SparkSession, d: str) -> DataFrame:
    """Runs as long as they have rows; one day in ten takes eight times as long."""
    runs = _runs(spark, d).withColumn("seconds", F.col("rows_read") * F.when(F.day("day") % 10 == 0, 8).otherwise(1))
    return detect.duration_anomaly(runs, "entity", "day", "seconds").select("entity", "day", "seconds", F.round("baseline", 6).alias("baseline"))


def null_key_rate(spark: SparkSession, d: str) -> DataFrame:
    """Lines by flag against a dimension that lacks the parts of one size class."""
    parts = table(spark, d, "part").where("p_type <> 'PROMO'").select("p_partkey", F.col("p_partkey").alias("part_sk"))
    fact = joins.lookup_attach(silver_lines(spark, d), parts, "l_partkey", "p_partkey", ["part_sk"])
    return detect.null_key_rate(fact, "l_returnflag", "part_sk")


# The columns that the events source is agreed to have.
EXPECTED = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.IntegerType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def schema_drift(spark: SparkSession, d: str) -> DataFrame:
    """The events as landed by two writers, file by file, against the agreed columns, with the rows of each writer."""
    root, found = storage.scratch(spark, "landing"), None
    events = table(spark, d, "events").drop("ts")
    for writer, rows in (("main", events), ("late", events.withColumn("value", F.col("value").cast("string")).drop("props"))):
        rows.write.parquet(f"{root}/{writer}")
        one = landing.unite_files(spark, landing.landed_files(spark, f"{root}/{writer}"), root)
        n = one.agg(F.count(F.lit(1)).alias("rows"))
        told = detect.schema_drift(EXPECTED, one).crossJoin(n).withColumn("writer", F.lit(writer))
        found = told if found is None else found.unionByName(told)
    return found


def late_dimension(spark: SparkSession, d: str) -> DataFrame:
    lines = silver_lines(spark, d).join(orders(spark, d), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("ship_date", F.to_date("l_shipdate"))
    found = detect.late_dimension(lines, customer_dim(spark, d).withColumnRenamed("o_custkey", "dim_key"), "o_custkey", "dim_key", "ship_date")
    return found.select("l_orderkey", "l_linenumber", "o_custkey", "ship_date", "first_seen")


def clock_skew(spark: SparkSession, d: str) -> DataFrame:
    """Loads by ship year: rows ordered after they shipped count as dated ahead."""
    lines = silver_lines(spark, d).join(orders(spark, d), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.select(F.to_date("l_shipdate").alias("ingested"), "order_date", F.pmod(F.year("l_shipdate") * 7, F.lit(10)).alias("run"), "channel")
    return detect.clock_skew(rows, "order_date", "ingested", "run", "channel")


def recurring_cause(spark: SparkSession, d: str) -> DataFrame:
    """Users whose errors of one kind came back."""
    errors = _events(spark, d).where("event_type = 'error'").select("user_id", F.floor("value").alias("kind"), "day").distinct()
    return detect.recurring_cause(errors, "user_id", "kind", "day")


def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    moves = funnel.status_transitions(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")
    return moves.groupBy("from_status").pivot("to_status", ["click", "error", "purchase", "signup", "view"]).agg(F.count(F.lit(1)))


def status_dwell(spark: SparkSession, d: str) -> DataFrame:
    """How long a user stays between two types of events."""
    return funnel.dwell_times(funnel.status_transitions(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id"))


STAGES, CANCELLED = ["view", "click", "signup", "purchase"], "error"


def status_funnel(spark: SparkSession, d: str) -> DataFrame:
    """How many users come through the stages in order before their first error, and after which stage that error comes."""
    found = funnel.funnel(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id", STAGES, CANCELLED)
    return funnel.funnel_summary(found, STAGES)


def status_furthest(spark: SparkSession, d: str) -> DataFrame:
    """Each user's furthest stage, and when the first and the last stage were reached."""
    found = funnel.funnel(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id", STAGES, CANCELLED)
    at = [F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(n) for n, x in (("first_at", F.get("reached", F.lit(0))), ("last_at", F.get("reached", F.size("reached") - 1)), ("cancelled_at", F.col("cancelled_at")))]
    return found.select("user_id", "furthest", *at)


MANIFEST = [("#0000000(0|1)", "east"), ("Customer", "crm"), ("#00000000\\d", "archive")]


def error_router(spark: SparkSession, d: str) -> DataFrame:
    return router.error_router(table(spark, d, "customer"), "c_name", "c_custkey", MANIFEST)


def error_router_large(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of ten thousand patterns, one for each customer number, and one for the tens."""
    rules = [(f"#{n:09d}$", f"team{n % 7}") for n in range(1, 10_001)] + [("#\\d{8}0", "tens"), ("r#\\d+", "any")]
    return router.error_router(table(spark, d, "customer"), "c_name", "c_custkey", rules)


def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    found = detect.text_chunks(table(spark, d, "documents"), "doc_id", "text", 500, 50)
    return found.select("doc_id", "chunk", "tokens", F.md5("chunk_text").alias("digest"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The nearest five of every vector whose id is divisible by 50."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    found = detect.cosine_topk(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", 5, 0.2)
    return found.select("query_id", "vec_id", "rank", F.round("similarity", 4).alias("similarity"))


def cosine_cells(spark: SparkSession, d: str) -> DataFrame:
    """The same as ``cosine_topk``, through an index of 32 cells that holds every vector, in exact mode."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    centres, path = cells.fit_cells(vectors, "vec_id", "embedding", 32), storage.scratch(spark, "cells")
    cells.index_rows(vectors, centres, "vec_id", "embedding").write.parquet(path)
    found = cells.cell_topk(spark.read.parquet(path), centres, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", 5, 0.2, 4, exact=True)
    return found.select("query_id", "vec_id", "rank", F.round("similarity", 4).alias("similarity"))


def schema_drift_files(spark: SparkSession, d: str) -> DataFrame:
    """Two writers' files against the agreed columns, told file by file: how many files of each writer have which change."""
    root, events = storage.scratch(spark, "landing"), table(spark, d, "events").drop("ts")
    for writer, rows in (("main", events), ("late", events.withColumn("value", F.col("value").cast("string")).drop("props"))):
        rows.repartition(3).write.parquet(f"{root}/{writer}")
    told = landing.drift_by_file(spark, root, EXPECTED).withColumn("writer", F.regexp_extract("path", "/(main|late)/", 1))
    return told.groupBy("writer", "column", "expected_type", "actual_type", "change").agg(F.count_distinct("path").alias("files"))


def incidents(spark: SparkSession, d: str) -> DataFrame:
    """Volume alerts, slow runs and rejects in one table."""
    return meta.incidents(_alerts(spark, d)).withColumn("evidence", F.array_join("evidence", ","))


def incident_log(spark: SparkSession, d: str) -> DataFrame:
    """Alerts on consecutive days as incidents, appended to a table by two runs of which the second adds nothing."""
    path, found = storage.scratch(spark, "incidents"), meta.merged_alerts(_alerts(spark, d))
    added = [meta.append_new(found, path, "incident_id") for _ in range(2)]
    return spark.read.parquet(path).select(*meta.CONTENT[:-1], F.array_join("evidence", ",").alias("evidence"), "confidence", F.lit(added[1]).alias("added_again"))


def _alerts(spark: SparkSession, d: str) -> list[DataFrame]:
    volume = volume_anomaly(spark, d).where("alert").select(
        F.lit("events").alias("component"), F.col("day").alias("failed_at"), F.lit("VOLUME").alias("cause"), F.col("rows").cast("string").alias("detail"), F.lit(0.9).alias("confidence")
    )
    slow = duration_anomaly(spark, d).select(
        F.col("entity").alias("component"), F.col("day").alias("failed_at"), F.lit("DURATION").alias("cause"), F.col("seconds").cast("string").alias("detail"), F.lit(0.7).alias("confidence")
    )
    reject = _quarantine(spark, d).select(
        F.split_part("pipeline_run_id", F.lit("/"), F.lit(1)).alias("component"), F.split_part("pipeline_run_id", F.lit("/"), F.lit(2)).cast("date").alias("failed_at"),
        F.lit("REJECTS").alias("cause"), F.col("rejection_reason").alias("detail"), F.lit(0.5).alias("confidence"),
    )
    return [volume, slow, reject]


QUERIES = {f.__name__: f for f in (watermark_upsert, file_registry, run_log, incidents, incident_log, status_dwell, status_funnel, status_furthest, error_router_large, volume_anomaly, reject_alert, duration_anomaly, null_key_rate, schema_drift, late_dimension, clock_skew, recurring_cause, status_transitions, error_router, text_chunks, cosine_topk, cosine_cells, schema_drift_files)}

EV = "ev AS (SELECT *, CAST(ts AS DATE) AS day FROM events)"
RUNS = f"{EV}, runs AS (SELECT event_type AS entity, day, min(ts) AS start_time, max(ts) AS last, count(*) AS rows_read, count(*) FILTER (value < 1) AS rows_rejected, event_type || '/' || strftime(day, '%Y-%m-%d') AS run_id FROM ev GROUP BY event_type, day)"
VOLUME = """v0 AS (SELECT CAST(x AS DATE) AS day FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS x)),
  v1 AS (SELECT day, count(*) AS n FROM ev GROUP BY day),
  v2 AS (SELECT v0.day, coalesce(n, 0) AS rows FROM v0 LEFT JOIN v1 ON v0.day = v1.day),
  v3 AS (SELECT *, sum(rows) OVER w AS total, count(*) OVER w AS k FROM v2 WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)),
  vol AS (SELECT day, rows, round(total / k, 4) AS baseline, coalesce(rows * k * 100 < 98 * total, FALSE) AS alert FROM v3)"""
SLOW = """s0 AS (SELECT entity, day, rows_read * CASE WHEN day(day) % 10 = 0 THEN 8 ELSE 1 END AS seconds FROM runs),
  s1 AS (SELECT *, CAST(quantile_disc(seconds, 0.5) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) AS baseline FROM s0),
  slow AS (SELECT entity, day, seconds, round(baseline, 6) AS baseline FROM s1 WHERE seconds >= 5 * baseline)"""
_STEPS = ", ".join(
    f"s{i} AS (SELECT n.user_id, min(n.rn) AS rn, min_by(n.ts, n.rn) AS ts FROM n JOIN s{i - 1} p ON p.user_id = n.user_id AND n.rn > p.rn LEFT JOIN c ON c.user_id = n.user_id WHERE n.event_type = '{x}' AND n.rn < coalesce(c.rn, 1e18) GROUP BY 1)"
    for i, x in enumerate(STAGES, 1)
)
FUNNEL = f"""WITH n AS MATERIALIZED (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  c AS (SELECT user_id, min(rn) AS rn, min_by(ts, rn) AS ct FROM n WHERE event_type = '{CANCELLED}' GROUP BY 1), s0 AS (SELECT DISTINCT user_id, 0 AS rn FROM n), {_STEPS},
  far AS (SELECT s0.user_id, CAST((s1.rn IS NOT NULL)::INT + (s2.rn IS NOT NULL)::INT + (s3.rn IS NOT NULL)::INT + (s4.rn IS NOT NULL)::INT AS INTEGER) AS furthest, [s1.ts, s2.ts, s3.ts, s4.ts] AS t, c.rn AS c, ct
  FROM s0 LEFT JOIN s1 USING (user_id) LEFT JOIN s2 USING (user_id) LEFT JOIN s3 USING (user_id) LEFT JOIN s4 USING (user_id) LEFT JOIN c USING (user_id))"""
REASON = "CASE WHEN value < 0.5 THEN 'TINY_VALUE' ELSE 'SMALL_VALUE' END"

COSINE = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS sim FROM v JOIN v q ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s WHERE sim > 0.2) SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(sim, 4) AS similarity FROM r WHERE rank <= 5"""

ORACLE_SQL = {
    "watermark_upsert": """SELECT event_type AS entity_name, 'prod' AS environment, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS mark FROM events GROUP BY 1""",
    "file_registry": "SELECT CAST(ts AS DATE) AS day, count(*) AS rows, CAST(ts AS DATE) >= DATE '2024-01-20' AS is_new FROM events GROUP BY 1",
    "run_log": f"WITH {RUNS} SELECT run_id, entity, CASE WHEN rows_read > 8 THEN 'ok' END AS status, rows_read <= 8 AS is_open, CASE WHEN rows_read > 8 THEN CAST(floor(epoch(last)) - floor(epoch(start_time)) AS BIGINT) END AS seconds FROM runs",
    "incidents": f"""WITH {RUNS}, {VOLUME}, {SLOW}, every AS (SELECT 'events' AS component, day AS failed_at, 'VOLUME' AS cause, CAST(rows AS VARCHAR) AS detail, 0.9 AS confidence FROM vol WHERE alert
        UNION ALL SELECT entity, day, 'DURATION', CAST(seconds AS VARCHAR), 0.7 FROM slow UNION ALL SELECT event_type, day, 'REJECTS', {REASON}, 0.5 FROM ev WHERE value < 1)
        SELECT component, failed_at, cause, string_agg(DISTINCT detail, ',' ORDER BY detail) AS evidence, CAST(max(confidence) AS DOUBLE) AS confidence FROM every GROUP BY 1, 2, 3""",
    "incident_log": f"""WITH {RUNS}, {VOLUME}, {SLOW}, every AS (SELECT 'events' AS component, day, 'VOLUME' AS cause, CAST(rows AS VARCHAR) AS detail, 0.9 AS confidence FROM vol WHERE alert
        UNION ALL SELECT entity, day, 'DURATION', CAST(seconds AS VARCHAR), 0.7 FROM slow UNION ALL SELECT event_type, day, 'REJECTS', {REASON}, 0.5 FROM ev WHERE value < 1),
        days AS (SELECT component, cause, day, day - INTERVAL 1 DAY * dense_rank() OVER (PARTITION BY component, cause ORDER BY day) AS island, detail, confidence FROM every)
        SELECT component, cause, min(day) AS started, max(day) AS ended, count(*) AS alerts, string_agg(DISTINCT detail, ',' ORDER BY detail) AS evidence, CAST(max(confidence) AS DOUBLE) AS confidence, 0 AS added_again
        FROM days GROUP BY component, cause, island""",
    "status_dwell": """WITH m AS (SELECT lag(event_type) OVER w AS from_status, event_type AS to_status, CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) AS BIGINT) AS s
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT from_status, to_status, count(*) AS moves, min(s) AS shortest, quantile_disc(s, 0.5) AS median, quantile_disc(s, 0.9) AS p90, max(s) AS longest FROM m WHERE from_status IS NOT NULL GROUP BY 1, 2""",
    "status_funnel": f"""{FUNNEL}, r AS (SELECT *, unnest(range(0, 5)) AS stage FROM far),
        g AS (SELECT stage, count(*) AS entities, count(*) FILTER (stage = furthest AND c IS NOT NULL) AS cancelled,
        quantile_disc(CAST(floor(epoch(t[CAST(stage AS INTEGER)])) - floor(epoch(t[CAST(stage - 1 AS INTEGER)])) AS BIGINT), 0.5) FILTER (stage > 1) AS median_seconds FROM r WHERE stage <= furthest GROUP BY stage)
        SELECT CAST(stage AS INTEGER) AS stage, ['(start)', 'view', 'click', 'signup', 'purchase'][CAST(stage + 1 AS INTEGER)] AS status, entities,
        CAST((entities * 20000 + p) // (2 * p) / 100 AS DECIMAL(6,2)) AS of_stage_before_pct, cancelled, CAST((cancelled * 20000 + entities) // (2 * entities) / 100 AS DECIMAL(6,2)) AS cancelled_pct, median_seconds
        FROM (SELECT *, lag(entities) OVER (ORDER BY stage) AS p FROM g)""",
    "status_furthest": f"""{FUNNEL} SELECT user_id, furthest, strftime(t[1], '%Y-%m-%d %H:%M:%S.%f') AS first_at, strftime(t[furthest], '%Y-%m-%d %H:%M:%S.%f') AS last_at, strftime(ct, '%Y-%m-%d %H:%M:%S.%f') AS cancelled_at FROM far""",
    "error_router_large": r"""SELECT c_custkey, CASE WHEN c_custkey BETWEEN 1 AND 10000 THEN 'team' || (c_custkey % 7) WHEN c_custkey % 10 = 0 THEN 'tens' ELSE 'any' END AS component,
        CASE WHEN c_custkey BETWEEN 1 AND 10000 THEN '#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '$' WHEN c_custkey % 10 = 0 THEN '#\d{8}0' ELSE 'r#\d+' END AS pattern FROM customer""",
    "volume_anomaly": f"WITH {EV}, {VOLUME} SELECT * FROM vol",
    "reject_alert": f"""WITH {RUNS} SELECT run_id, rows_rejected, (SELECT string_agg(DISTINCT {REASON}, ',' ORDER BY {REASON}) FROM ev WHERE value < 1 AND ev.event_type = runs.entity AND ev.day = runs.day) AS reasons
        FROM runs WHERE rows_rejected > 0""",
    "duration_anomaly": f"WITH {RUNS}, {SLOW} SELECT * FROM slow",
    "null_key_rate": f"""WITH {MEASURED} SELECT l_returnflag, count(*) AS rows, count(*) FILTER (category = 'PROMO') AS null_keys, round(count(*) FILTER (category = 'PROMO') / count(*), 6) AS null_rate FROM m GROUP BY 1""",
    "schema_drift": """SELECT c AS "column", e AS expected_type, a AS actual_type, ch AS change, (SELECT count(*) FROM events) AS rows, w AS writer FROM
        (VALUES ('user_id', 'int', 'bigint', 'RETYPED', 'main'), ('session_id', 'string', NULL, 'REMOVED', 'main'), ('props', NULL, 'string', 'ADDED', 'main'),
        ('user_id', 'int', 'bigint', 'RETYPED', 'late'), ('session_id', 'string', NULL, 'REMOVED', 'late'), ('value', 'double', 'string', 'RETYPED', 'late')) AS v(c, e, a, ch, w)""",
    "late_dimension": f"""WITH {MEASURED}, f AS (SELECT o_custkey, min(order_date) AS first_seen FROM ord GROUP BY 1)
        SELECT l_orderkey, l_linenumber, m.o_custkey, CAST(l_shipdate AS DATE) AS ship_date, first_seen FROM m JOIN f ON m.o_custkey = f.o_custkey WHERE CAST(l_shipdate AS DATE) < first_seen""",
    "clock_skew": f"""WITH {MEASURED}, r AS (SELECT channel, CAST((year(l_shipdate) * 7) % 10 AS INTEGER) AS run, count(*) FILTER (order_date > CAST(l_shipdate AS DATE)) AS ahead, max(order_date) AS latest FROM m GROUP BY 1, 2)
        SELECT *, coalesce(latest < max(latest) OVER (PARTITION BY channel ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS went_back FROM r""",
    "recurring_cause": f"""WITH {EV}, e AS (SELECT DISTINCT user_id, CAST(floor(value) AS BIGINT) AS kind, day FROM ev WHERE event_type = 'error'),
        g AS (SELECT *, datediff('day', lag(day) OVER (PARTITION BY user_id, kind ORDER BY day), day) AS gap FROM e)
        SELECT user_id, kind, count(*) AS times, min(day) AS first_at, max(day) AS last_at, max(gap) AS longest_gap FROM g GROUP BY 1, 2 HAVING count(*) >= 2""",
    "status_transitions": """WITH m AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_status, event_type AS t FROM events)
        SELECT from_status, nullif(count(*) FILTER (t = 'click'), 0) AS click, nullif(count(*) FILTER (t = 'error'), 0) AS error, nullif(count(*) FILTER (t = 'purchase'), 0) AS purchase,
        nullif(count(*) FILTER (t = 'signup'), 0) AS signup, nullif(count(*) FILTER (t = 'view'), 0) AS view FROM m WHERE from_status IS NOT NULL GROUP BY 1""",
    "error_router": r"""SELECT c_custkey, CASE WHEN regexp_matches(c_name, '#0000000(0|1)') THEN 'east' WHEN regexp_matches(c_name, '#00000000\d') THEN 'archive' WHEN regexp_matches(c_name, 'Customer') THEN 'crm' END AS component,
        CASE WHEN regexp_matches(c_name, '#0000000(0|1)') THEN '#0000000(0|1)' WHEN regexp_matches(c_name, '#00000000\d') THEN '#00000000\d' WHEN regexp_matches(c_name, 'Customer') THEN 'Customer' END AS pattern FROM customer""",
    "text_chunks": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        c AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 50, 1), 450)) AS a FROM w WHERE len(w) > 0)
        SELECT doc_id, CAST(a // 450 AS INTEGER) AS chunk, CAST(len(list_slice(w, a + 1, a + 500)) AS INTEGER) AS tokens, md5(array_to_string(list_slice(w, a + 1, a + 500), ' ')) AS digest FROM c""",
    "cosine_topk": COSINE,
    "cosine_cells": COSINE,
    "schema_drift_files": """SELECT c AS "column", e AS expected_type, a AS actual_type, ch AS change, w AS writer, 3 AS files FROM
        (VALUES ('user_id', 'int', 'bigint', 'RETYPED', 'main'), ('session_id', 'string', NULL, 'REMOVED', 'main'), ('props', NULL, 'string', 'ADDED', 'main'),
        ('user_id', 'int', 'bigint', 'RETYPED', 'late'), ('session_id', 'string', NULL, 'REMOVED', 'late'), ('value', 'double', 'string', 'RETYPED', 'late')) AS v(c, e, a, ch, w)""",
}
