"""Hand-written frames for the cases that the test tables do not hold."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sedimenta.operators import checks, detect, dims, facts, joins, keys, merge, meta, rules, scd
from sedimenta.sources import landing, storage

D = dt.date


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_dedup_latest_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", None, 3), ("b", 0, 4), (None, 5, 5), (None, 6, 6)], "k string, t int, id int")
    found = keys.dedup_latest(df, ["k"], [F.desc_nulls_last("t"), F.desc("id")])
    assert rows(found.select("k", "id")) == [("a", 2), ("b", 4), (None, 6)]


def test_fk_flag_null_key(spark):
    ref = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert rows(keys.fk_flag(df, ref, "x", "id", "known")) == [(1, True), (2, False), (None, False)]


def test_surrogate_key_refuses_null(spark):
    df = spark.createDataFrame([(1, None)], "a int, b int")
    with pytest.raises(Exception, match="null in key"):
        df.select(keys.surrogate_key("a", "b")).collect()


def test_rule_shapes(spark):
    df = spark.createDataFrame(
        [(1, "HOME", 5, 1, "560001", "a@b", "x", True), (2, None, None, -1, "060001", "ab", None, False), (3, "SHOP", 0, 1, None, None, "y", None)],
        "id int, kind string, n int, m int, pin string, mail string, ref string, known boolean",
    )
    tagged = rules.dq_tag(
        df,
        [
            rules.not_null("NO_REF", "ref"),
            rules.in_set("KIND", "kind", ["HOME", "WORK"]),
            rules.in_set("KIND_STRICT", "kind", ["HOME", "WORK"], nulls_fail=True),
            rules.positive("N", "n"),
            rules.none_negative("NEG", "n", "m"),
            rules.required_when("REQ", "ref", F.col("id") == 2),
            rules.contains("MAIL", "mail", "@"),
            rules.matches("PIN", "pin", "^[1-9][0-9]{5}$"),
            rules.known("FK", "known"),
        ],
    )
    reasons = {r.id: r.dq_rejection_reason for r in tagged.collect()}
    assert reasons == {1: None, 2: "NO_REF;KIND_STRICT;N;NEG;REQ;MAIL;PIN;FK", 3: "KIND;KIND_STRICT;N;MAIL;PIN;FK"}
    passed, rejected = rules.dq_split(tagged)
    assert passed.count() + rejected.count() == df.count()


def test_two_columns_one_code(spark):
    df = spark.createDataFrame([(None, "NEW"), ("BAD", "WORSE"), ("NEW", "BAD")], "a string, b string")
    tagged = rules.dq_tag(df, [rules.both_in_set("STATUS", "a", "b", ["NEW"])])
    assert [r.dq_passed for r in tagged.orderBy(F.asc_nulls_first("a")).collect()] == [True, False, False]


def test_merge_guard_and_idempotence(spark):
    schema = "k int, t int, v string"
    target = spark.createDataFrame([(1, 5, "old"), (2, 5, "old"), (3, 5, "old"), (4, 5, "only")], schema)
    source = spark.createDataFrame([(1, 6, "new"), (2, 4, "late"), (3, 5, "same time"), (9, 1, "insert")], schema)
    once = merge.merge(target, source, ["k"], guard="t")
    expected = [(1, 6, "new"), (2, 5, "old"), (3, 5, "same time"), (4, 5, "only"), (9, 1, "insert")]
    assert rows(once) == expected
    assert rows(merge.merge(once, source, ["k"], guard="t")) == expected


def test_merge_null_keys(spark):
    t, s = spark.createDataFrame([(1, None, 1)], "a int, b int, v int"), spark.createDataFrame([(1, None, 2)], "a int, b int, v int")
    assert rows(merge.merge(t, s, ["a", "b"], null_safe=True)) == [(1, None, 2)]
    assert merge.merge(t, s, ["a", "b"]).count() == 2


def test_merge_duplicate_source_key_raises(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    with pytest.raises(Exception, match="duplicate merge key"):
        merge.merge(df.limit(0), df, ["k"]).collect()


def test_merge_moves_between_partitions(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 1), (4, "c", 1)], "k int, p string, v int")
    source = spark.createDataFrame([(1, "b", 2)], "k int, p string, v int")
    assert rows(merge.merge_partitions(target, source, ["k"], "p")) == [(1, "b", 2), (2, "a", 1), (3, "b", 1)]


def dim_of(spark, *versions):
    return spark.createDataFrame(list(versions), "k string, t string, o string, valid_from date, valid_to date, is_current boolean")


def test_scd2_apply_cases(spark):
    dim = dim_of(
        spark,
        ("both", "1", "1", D(2020, 1, 1), None, True),
        ("null", None, "1", D(2020, 1, 1), None, True),
        ("over", "1", "1", D(2019, 1, 1), D(2019, 12, 31), False),
        ("over", "1", "1", D(2020, 1, 1), None, True),
        ("same", "1", "1", D(2020, 1, 1), None, True),
        ("today", "1", "1", D(2021, 5, 5), None, True),
    )
    snapshot = spark.createDataFrame(
        [("both", "2", "2"), ("null", "x", "1"), ("over", "1", "2"), ("same", "1", "1"), ("today", "2", "1"), ("new", "1", "1"), ("seen", "1", "1")],
        "k string, t string, o string",
    )
    activity = spark.createDataFrame([("seen", D(2018, 3, 3))], "k string, first_date date")
    apply = lambda d: scd.scd2_apply(snapshot, d, "k", ["t"], ["o"], "2021-05-05", activity)
    once = apply(dim)
    expected = sorted(
        [
            ("both", "1", "1", D(2020, 1, 1), D(2021, 5, 4), False),
            ("both", "2", "2", D(2021, 5, 5), None, True),
            ("new", "1", "1", D(2021, 5, 5), None, True),
            ("null", "x", "1", D(2021, 5, 5), None, True),
            ("null", None, "1", D(2020, 1, 1), D(2021, 5, 4), False),
            ("over", "1", "1", D(2019, 1, 1), D(2019, 12, 31), False),
            ("over", "1", "2", D(2020, 1, 1), None, True),
            ("same", "1", "1", D(2020, 1, 1), None, True),
            ("seen", "1", "1", D(2018, 3, 3), None, True),
            ("today", "2", "1", D(2021, 5, 5), None, True),
        ],
        key=str,
    )
    assert rows(once) == expected
    assert rows(apply(once)) == expected
    assert checks.check_intervals(once, "k").count() == 0


def test_scd2_800_changes(spark):
    dim = spark.range(1000).select(
        F.col("id").cast("string").alias("k"), F.lit("a").alias("t"), F.lit("o").alias("o"),
        F.lit("2020-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current"),
    )
    snapshot = dim.select("k", F.when(F.col("k").cast("int") < 800, "b").otherwise("a").alias("t"), "o")
    out = scd.scd2_apply(snapshot, dim, "k", ["t"], ["o"], "2021-01-01")
    assert (out.count(), out.where("not is_current").count()) == (1800, 800)


def test_change_tracking_first_sight_and_null(spark):
    new = spark.createDataFrame([("a", "x"), ("b", None), ("c", "x")], "k string, v string")
    old = spark.createDataFrame([("b", "y"), ("c", "x")], "k string, v string")
    assert rows(scd.change_tracking(new, old, "k", ["v"])) == [("a", "x", None, False), ("b", None, "y", True), ("c", "x", "x", False)]


def facts_frame(spark):
    days = [(1, "k", D(2019, 1, 1)), (2, "k", D(2020, 1, 1)), (3, "k", D(2020, 1, 31)), (4, "k", D(2020, 2, 15)), (5, "k", D(2030, 1, 1)), (6, "x", D(2020, 1, 1)), (7, None, D(2020, 1, 1)), (8, "closed", D(2025, 1, 1))]
    return spark.createDataFrame(days, "id int, key string, day date")


def test_asof_floor_gap_and_missing(spark):
    dim = spark.createDataFrame(
        [("k", "v1", D(2020, 1, 1), D(2020, 1, 31)), ("k", "v2", D(2020, 3, 1), None), ("closed", "c", D(2020, 1, 1), D(2020, 2, 1))],
        "nk string, v string, valid_from date, valid_to date",
    )
    found = joins.asof_attach(facts_frame(spark), dim, "key", "nk", "day", ["v"])
    expected = {1: "v1", 2: "v1", 3: "v1", 4: "v1", 5: "v2", 6: None, 7: None, 8: "c"}
    assert {r.id: r.v for r in found.collect()} == expected
    other = joins.asof_attach_overlapping(facts_frame(spark), dim, "id", "key", "nk", "day", ["v"])
    assert {r.id: r.v for r in other.collect()} == expected


def test_asof_overlap_takes_latest(spark):
    dim = spark.createDataFrame([("k", "v1", D(2020, 1, 1), D(2020, 12, 31)), ("k", "v2", D(2020, 2, 1), None)], "nk string, v string, valid_from date, valid_to date")
    found = joins.asof_attach_overlapping(facts_frame(spark), dim, "id", "key", "nk", "day", ["v"])
    assert {r.id: r.v for r in found.where("key = 'k'").collect()} == {1: "v1", 2: "v1", 3: "v1", 4: "v2", 5: "v2"}
    assert [r.problem for r in checks.check_intervals(dim, "nk").collect()] == ["OVERLAP"]


def test_asof_overlap_by_hand_reads_facts_once(spark):
    rng, day = random.Random(4), lambda n: D(2020, 1, 1) + dt.timedelta(n)
    versions = []
    for key in ("a", "b", "c"):
        for at in rng.sample(range(300), 25):
            versions.append((key, f"{key}{at}", day(at), rng.choice([None] + [day(at + rng.randrange(-2, 90))] * 9)))
    versions.append((None, "none", day(0), None))
    given = [(i // 2, rng.choice(["a", "b", "c", "unknown", None]), None if i % 60 == 0 else day(rng.randrange(-20, 450))) for i in range(900)]
    dim = spark.createDataFrame(versions, "nk string, v string, valid_from date, valid_to date")
    facts = spark.createDataFrame(given, "id int, key string, day date")

    def hand(key, at):
        own = [v for v in versions if v[0] == key and key is not None]
        hit = [v for v in own if at is not None and v[2] <= at <= (v[3] or D(9999, 12, 31))]
        return max(hit, key=lambda v: v[2])[1] if hit else min(own, key=lambda v: v[2])[1] if own else None

    found = joins.asof_attach_overlapping(facts, dim, "id", "key", "nk", "day", ["v"])
    assert sorted(map(str, found.collect())) == sorted(str(Row(id=i, key=k, day=d, v=hand(k, d))) for i, k, d in given)
    many = spark.range(10).select("id", F.lit("a").alias("key"), F.lit(day(3)).alias("day"))
    plan = joins.asof_attach_overlapping(many, dim, "id", "key", "nk", "day", ["v"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1


def test_asof_moves_no_facts(spark):
    dim = spark.createDataFrame([("k", "v1", D(2020, 1, 1), None)], "nk string, v string, valid_from date, valid_to date")
    found = joins.asof_attach(facts_frame(spark), dim, "key", "nk", "day", ["v"])
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2


def test_rolling_window_with_missing_day(spark):
    df = spark.createDataFrame([("p", D(2024, 1, n), n) for n in range(1, 11) if n != 5], "p string, day date, sold int")
    got = {r.day.day: (r.rolling_avg, r.rolling_days) for r in facts.rolling_days(df, ["p"], "day", "sold").collect()}
    assert got[1] == (1.0, 1) and got[4] == (2.5, 4) and got[8][1] == 6 and got[10] == (sum([4, 6, 7, 8, 9, 10]) / 6, 6)


def test_days_of_stock_edges(spark):
    df = spark.createDataFrame([(10, 3.0, 7), (10, 3.0, 6), (10, 0.0, 7), (10, None, 7)], "stock int, a double, n int")
    assert [r[0] for r in df.select(facts.days_of_stock(F.col("stock"), F.col("a"), F.col("n"))).collect()] == [3, None, None, None]


def test_tax_is_decimal(spark):
    df = spark.createDataFrame([(0.25, 1, 0.0)], "p double, quantity int, d double")
    row = facts.line_measures(df, "p", "quantity", "d").first()
    assert str(row.tax_amount) == "0.05" and str(row.line_total) == "0.25"


def test_calendar(spark):
    days = {str(r.full_date): r for r in dims.dim_date(spark).collect()}
    assert len(days) == 4018 and days["2020-02-29"].date_id == 20200229
    assert days["2021-01-01"].week_number == 53
    assert (days["2021-03-31"].fiscal_year, days["2021-03-31"].fiscal_quarter) == (2020, 4)
    assert (days["2021-04-01"].fiscal_year, days["2021-04-01"].fiscal_quarter) == (2021, 1)
    assert days["2021-08-15"].is_weekend and days["2021-08-15"].is_public_holiday


def test_align_and_union_types(spark):
    a = spark.sql("select 1 as id, cast(1.5 as decimal(12,2)) as price, timestamp'2024-01-01 00:00:00' as at, cast(null as date) as d")
    b = spark.sql("select 2L as id, cast(2.5 as decimal(10,2)) as price, timestamp_ntz'2024-01-02 00:00:00' as at, 7 as d, 'x' as extra")
    c = spark.sql("select 3 as id, null as price")
    out = landing.align_and_union([a, b, c])
    assert dict(out.dtypes) == {"id": "bigint", "price": "decimal(12,2)", "at": "timestamp", "d": "date"}
    assert [(r.id, r.d) for r in out.orderBy("id").collect()] == [(1, None), (2, None), (3, None)]


def test_landing_layouts(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 3))], "id int, ts timestamp")
    landing.by_date_extract(df, "ts", f"{tmp_path}/by_date")
    landing.full_extract(df, f"{tmp_path}/whole")
    df.write.parquet(f"{tmp_path}/flat")
    assert landing.landing_scan(spark, f"{tmp_path}/by_date", "2024-01-03").count() == 1
    assert landing.landing_scan(spark, f"{tmp_path}/by_date", "2024-01-02") is None
    assert [landing.landing_scan(spark, f"{tmp_path}/{x}").count() for x in ("by_date", "whole", "flat")] == [2, 2, 2]


def test_landing_by_date_comes_before_full_and_full_is_one_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1 + i % 3)) for i in range(30)], "id int, ts timestamp")
    df.limit(7).write.parquet(f"{tmp_path}/full")
    df.repartition(4).write.mode("append").parquet(f"{tmp_path}/full")
    assert landing.landing_scan(spark, str(tmp_path)).count() == 30  # the newest write, all of its files
    landing.by_date_extract(df.where("id < 12"), "ts", f"{tmp_path}/days")
    assert landing.landing_scan(spark, str(tmp_path)).count() == 12
    assert landing.latest_snapshot(spark, f"{tmp_path}/full").count() == 30


def test_landing_writers_in_one_folder(spark, tmp_path):
    spark.sql("select 1 as id, date'2024-01-01' as day, 1.5 as x").write.parquet(f"{tmp_path}/main")
    spark.sql("select 2L as id, 0 as day, 'z' as extra").write.parquet(f"{tmp_path}/other")
    found = landing.landing_scan(spark, str(tmp_path), preferred="/main/")
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint", "date", "decimal(2,1)"]
    assert sorted((r.id, str(r.day), str(r.x)) for r in found.collect()) == [(1, "2024-01-01", "1.5"), (2, "None", "None")]
    assert landing.landing_scan(spark, str(tmp_path)).columns == ["id", "day", "extra"]  # the newest of any


def test_timeline_with_two_rows_on_a_day(spark):
    log = spark.createDataFrame([("k", D(2024, 1, 1), "a"), ("k", D(2024, 1, 1), "b"), ("k", D(2024, 2, 1), "a")], "k string, day date, v string")
    found = scd.scd2_from_timeline(log, "k", "day", ["v"])
    assert rows(found.select("v", "valid_from", "valid_to")) == [("a", D(2024, 2, 1), None), ("b", D(2024, 1, 1), D(2024, 1, 31))]
    assert checks.check_intervals(found, "k").count() == 0


def test_asof_refuses_overlaps_and_spreads_facts_without_a_key(spark):
    dim = spark.createDataFrame([("k", "v1", D(2020, 1, 1), D(2020, 12, 31)), ("k", "v2", D(2020, 2, 1), None)], "nk string, v string, valid_from date, valid_to date")
    with pytest.raises(Exception, match="overlapping versions of k"):
        joins.asof_attach(facts_frame(spark), dim, "key", "nk", "day", ["v"]).collect()
    many = spark.range(400).select(F.col("id").cast("int").alias("id"), F.lit(None).cast("string").alias("key"), F.lit("2020-05-01").cast("date").alias("day"))
    found = joins.asof_attach(many, dim.where("v = 'v2'").hint("merge"), "key", "nk", "day", ["v"], gap_free=True)
    assert found.where("v is null").count() == 400 and found.columns == ["id", "key", "day", "v"]


def test_cosine_topk_in_blocks(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(90, [0.0, 0.0, 0.0]), (91, None)], "vec_id long, v array<float>")
    one, many = (rows(detect.cosine_topk(vectors, vectors.where("vec_id < 20"), "vec_id", "v", 3, 0.5, block=b)) for b in (1000, 6))
    assert one == many and len(one) == 60


def test_guarded_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string")
    path = f"{tmp_path}/t"
    assert storage.guarded_write(df, path, "p", "a") == 1
    with pytest.raises(storage.PartitionExists):
        storage.guarded_write(df, path, "p", "a")
    with pytest.raises(storage.EmptyInput):
        storage.guarded_write(df, path, "p", "zzz")
    assert storage.guarded_write(df.unionAll(df), path, "p", "a", force=True) == 2


def test_publish_self_read_and_rollback(spark, tmp_path):
    root = f"{tmp_path}/t"
    storage.publish(spark.range(3), root)
    storage.publish(storage.published(spark, root).where("id > 0"), root)
    assert storage.current_version(spark, root) == 1
    assert storage.published(spark, root).count() == 2 and storage.published(spark, root, 0).count() == 3


def test_grid_and_unique(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), 1, 1), (D(2024, 1, 1), 1, 2), (D(2024, 1, 1), 2, 1), (D(2024, 1, 2), 1, 1), (D(2024, 1, 2), 1, 1), (D(2024, 1, 3), 1, 1)], "d date, a int, b int")
    out = {str(r.d): r.status for r in checks.grid_completeness(df, "d", "a", "b", "2024-01-01", "2024-01-04").collect()}
    assert out == {"2024-01-01": "PARTIAL", "2024-01-02": "DUPES", "2024-01-03": "ok", "2024-01-04": "MISSING"}
    nulls = spark.createDataFrame([(1, None), (1, None), (2, 1)], "a int, b int")
    assert checks.check_unique(nulls, ["a", "b"]).first().distinct_keys == 2


def test_scorecard_tells_error_from_failure(spark):
    class Broken:
        def agg(self, *_):
            spark.sql("select nothing from nowhere")

    out = {r.check: r.status for r in checks.scorecard(spark, {"good": (spark.range(0), 0), "bad": (spark.range(1), 0), "broken": (Broken(), 0)}).collect()}
    assert out == {"good": "PASS", "bad": "FAIL", "broken": "ERROR"}


def test_run_log_first_end_wins(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    starts = spark.createDataFrame([("a", at(1)), ("b", at(1))], "run_id string, start_time timestamp")
    ends = spark.createDataFrame([("a", at(3), "failed"), ("a", at(2), "ok")], "run_id string, end_time timestamp, status string")
    assert {r.run_id: (r.status, r.seconds) for r in meta.run_log(starts, ends).collect()} == {"a": ("ok", 3600), "b": (None, None)}


def test_failure_classes(spark):
    """Each class of failure trips its detector, and its clean twin none."""
    base = spark.createDataFrame([(i, dt.datetime(2024, 1, 1 + i % 10)) for i in range(1000)], "id int, ts timestamp")
    cut = base.where("not (ts = timestamp'2024-01-09 00:00:00' and id > 100)")
    alerts = lambda df: [str(r.day) for r in detect.volume_anomaly(df, "ts", "2024-01-01", "2024-01-10").where("alert").collect()]
    assert alerts(base) == [] and alerts(cut) == ["2024-01-09"]
    assert detect.schema_drift(base.schema, base).count() == 0
    assert [(r.column, r.change) for r in detect.schema_drift(base.schema, base.withColumn("x", F.lit(1))).collect()] == [("x", "ADDED")]
    keyed = base.withColumn("sk", F.lit(None).cast("long"))
    assert detect.null_key_rate(keyed.withColumn("load", F.lit(1)), "load", "sk").first().null_rate == 1.0
    runs = spark.createDataFrame([("e", d, 10 if d < 8 else 50) for d in range(1, 9)], "entity string, day int, seconds int")
    assert [r.day for r in detect.duration_anomaly(runs, "entity", "day", "seconds").collect()] == [8]
    assert detect.duration_anomaly(runs.where("day < 8"), "entity", "day", "seconds").count() == 0
    skew = spark.createDataFrame([(1, D(2024, 1, 2), D(2024, 1, 1)), (2, D(2024, 1, 1), D(2024, 1, 1))], "run int, updated date, came date")
    assert rows(detect.clock_skew(skew, "updated", "came", "run").select("run", "ahead", "went_back")) == [(1, 1, False), (2, 0, True)]


def test_entity_rules(spark):
    from sedimenta.plans.entities import entities

    every = entities()
    assert sorted(len(e.rules) for e in every.values()) == sorted([9, 7, 5, 5, 6, 4, 6, 7, 4, 5])
    ties = [F.col("line_id")]
    lines = spark.createDataFrame(
        [("l1", "o1", "p1", 1, 2.0, 1), ("l1", "o1", "p1", 1, 3.0, 2), ("l2", "o9", "p9", 0, None, 1), ("l3", None, None, None, 1.0, 1)],
        "line_id string, order_id string, product_id string, quantity int, unit_price double, _bronze_timestamp int",
    )
    tables = {"orders": spark.createDataFrame([("o1",)], "order_id string"), "products": spark.createDataFrame([("p1",)], "product_id string")}
    got = {r.line_id: (r.unit_price, r.dq_rejection_reason) for r in every["order_lines"].tag(lines, tables, ties).collect()}
    assert got["l1"] == (3.0, None)
    assert got["l2"][1] == "UNKNOWN_ORDER_ID;UNKNOWN_PRODUCT_ID;INVALID_QUANTITY;INVALID_UNIT_PRICE"
    assert got["l3"][1] == "NULL_ORDER_ID;NULL_PRODUCT_ID;INVALID_QUANTITY"
    log = spark.createDataFrame([("a", "o1", None, "SHIPPED", 1), ("b", "o1", "LOST", "SHIPPED", 1), ("c", "o1", "PENDING", None, 1)], "log_id string, order_id string, from_status string, to_status string, _bronze_timestamp int")
    got = {r.log_id: r.dq_rejection_reason for r in every["order_status_log"].tag(log, tables, [F.col("log_id")]).collect()}
    assert got == {"a": None, "b": "INVALID_STATUS", "c": "NULL_TO_STATUS"}
