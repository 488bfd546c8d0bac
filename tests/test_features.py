"""Funnels, isolated checks, sorted as-of joins, routers, incident logs, replaced partitions, observed writes, cells."""

import datetime as dt
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sedimenta.operators import cells, checks, detect, funnel, joins, keys, meta, router, rules
from sedimenta.sources import landing, storage

D = dt.date


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def log_rows(n=600, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        user = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
        at = None if rng.random() < 0.01 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 12), seconds=rng.randrange(2))
        out.append((user, rng.choice(["new", "paid", "sent", "done", "other", None, "void"][: 6 if rng.random() < 0.97 else 7]), at, i))
    return out


LOG = "user string, status string, at timestamp, id int"


def in_order(log):
    by_user = {}
    for user, status, at, i in log:
        by_user.setdefault(user, []).append((at is not None, at or dt.datetime.min, i, status, at))
    return {u: sorted(x) for u, x in by_user.items()}


@pytest.mark.parametrize("period", ["hour", "day", "year"])
def test_transitions_over_periods(spark, period):
    log = log_rows()
    want = []
    for user, events in in_order(log).items():
        for (*_, s0, t0), (*_, s1, t1) in zip(events, events[1:], strict=False):
            if s0 is not None:
                want.append((user, s0, s1, t1, int((t1 - t0).total_seconds()) if t0 and t1 else None))
    found = funnel.status_transitions(spark.createDataFrame(log, LOG), "user", "status", "at", "id", period)
    assert rows(found) == sorted(want, key=str)


@pytest.mark.parametrize("period", ["hour", "day", "year"])
def test_funnel_against_a_state_machine(spark, period):
    stages, log = ["new", "paid", "sent", "done"], log_rows(seed=2)
    want = {}
    for user, events in in_order(log).items():
        reached, gone = [], None
        for *_, status, at in events:
            if status == "void":
                gone = (at,)
                break
            if len(reached) < 4 and status == stages[len(reached)]:
                reached.append(at)
        want[user] = (len(reached), reached, gone[0] if gone else None)
    log.append(("quiet", "other", dt.datetime(2024, 1, 1), 9999))
    found = funnel.funnel(spark.createDataFrame(log, LOG), "user", "status", "at", "id", stages, "void", period)
    assert {r.user: (r.furthest, r.reached, r.cancelled_at) for r in found.collect()} == want | {"quiet": (0, [], None)}
    told = {r.status: (r.entities, r.cancelled) for r in funnel.funnel_summary(found, stages).collect()}
    assert told["(start)"] == (len(want) + 1, sum(f == 0 and g is not None for f, _, g in want.values()))
    assert funnel.funnel(spark.createDataFrame([], LOG), "user", "status", "at", "id", stages, "void").count() == 0


def test_dwell_times_are_exact(spark):
    """Fifteen thousand different times of a pair, more than a sketch holds exactly."""
    rng = random.Random(4)
    took = [rng.randrange(1 << 40) for _ in range(15_000)]
    moves = spark.createDataFrame([("a", "b", s) for s in took] + [("a", None, 7), ("a", None, None)], "from_status string, to_status string, seconds long")
    took.sort()
    want = [("a", "b", 15_000, took[0], took[7_499], took[13_499], took[-1]), ("a", None, 2, 7, 7, 7, 7)]
    assert sorted((tuple(r) for r in funnel.dwell_times(moves).collect()), key=str) == sorted(want, key=str)


def test_funnel_median_is_exact(spark):
    rng, start = random.Random(5), dt.datetime(2024, 1, 1)
    took = [rng.randrange(10**9) for _ in range(25_000)]
    rows_in = [(n, 2, [start, start + dt.timedelta(seconds=s)], None) for n, s in enumerate(took)]
    entities = spark.createDataFrame(rows_in, "user long, furthest int, reached array<timestamp>, cancelled_at timestamp")
    told = {r.stage: (r.entities, r.cancelled, r.median_seconds) for r in funnel.funnel_summary(entities, ["new", "paid"]).collect()}
    assert told == {0: (25_000, 0, None), 1: (25_000, 0, None), 2: (25_000, 0, sorted(took)[12_499])}


def test_scorecard_survives_failing_and_slow_checks(spark):
    broken = spark.range(100).where(F.when(F.col("id") == 50, F.raise_error(F.lit("in a task")).cast("boolean")).otherwise(F.lit(False)))
    slow = spark.range(10**13).where("cast(sqrt(id) as string) = 'x'")
    began = time.monotonic()
    card = checks.scorecard(
        spark, {"slow": (slow, 0), "raises": (broken, 0), "good": (spark.range(0), 0), "bad": (spark.range(3), 0), "plan": (lambda: spark.range(1).where("nothing"), 0)}, seconds=8, attempts=2
    )
    out = {r.check: (r.value, r.status, r.attempts) for r in card.collect()}
    assert out == {"slow": (None, "TIMEOUT", 2), "raises": (None, "ERROR", 1), "good": (0, "PASS", 1), "bad": (3, "FAIL", 1), "plan": (None, "ERROR", 1)}
    assert "in a task" in card.where("check = 'raises'").first().error and time.monotonic() - began < 90
    assert spark.range(5).count() == 5 and not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_fk_card_in_one_pass(spark):
    fact = spark.createDataFrame([(1, "a"), (2, None), (None, "b"), (9, "z")], "x int, y string")
    dim = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    names = spark.createDataFrame([("a",), ("b",)], "k string")
    card = checks.fk_card(fact, [("x", "x", dim, "k", True), ("y", "y", names, "k", False)])
    assert rows(card) == [("x", 4, 1, 2), ("y", 4, 1, 1)]


def test_null_keys_are_spread_in_shuffled_joins(spark):
    many = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).alias("k"))
    known = spark.range(0, 300, 2).hint("merge")
    found = keys.fk_flag(many, known, "k", "id", "known")
    assert found.columns == ["id", "k", "known"] and found.count() == 300 and found.where("known").count() == 50
    side = spark.range(300).select("id", F.lit("v").alias("v")).hint("merge")
    joined = joins.lookup_attach(many, side.withColumnRenamed("id", "key"), "k", "key", ["v"])
    assert joined.count() == 300 and joined.where("v is null").count() == 200


@pytest.mark.parametrize(("bucket", "salts"), [(32, 4), (1, 1), (1000, 3)])
def test_sorted_asof_is_the_same_asof(spark, bucket, salts):
    rng, versions = random.Random(bucket), []
    for key in ("hot", "a", "b"):
        at = D(2020, 1, 1) + dt.timedelta(rng.randrange(50))
        for n in range(400 if key == "hot" else 5):
            until = at + dt.timedelta(rng.randrange(4))
            versions.append((key, f"{key}{n}", at, None if n == 399 else until))
            at = until + dt.timedelta(1 + rng.choice([0, 0, 3]))
    dim = spark.createDataFrame([*versions, (None, "none", D(2020, 1, 1), None)], "nk string, v string, valid_from date, valid_to date")
    given = [(i, rng.choice(["hot", "hot", "a", "b", "unknown", None]), None if i % 50 == 0 else D(2019, 12, 1) + dt.timedelta(rng.randrange(1500)), i % 7) for i in range(2000)]
    facts = spark.createDataFrame(given, "id int, key string, day date, _at int")
    one = joins.asof_attach(facts, dim, "key", "nk", "day", ["v"])
    two = joins.asof_attach_sorted(facts, dim, "key", "nk", "day", ["v"], bucket, salts)
    assert two.columns == one.columns and rows(one) == rows(two)


def test_sorted_asof_makes_no_facts_times_versions(spark):
    dim = spark.range(3000).select(F.lit("k").alias("nk"), "id", F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("valid_from")).withColumn("valid_to", F.col("valid_from"))
    facts = spark.range(3000).select("id", F.lit("k").alias("key"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    found = joins.asof_attach_sorted(facts, dim.withColumnRenamed("id", "v"), "key", "nk", "day", ["v"])
    assert found.where("id = v").count() == 3000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join", plan)) == 1 and "Join Inner" in plan  # the floor of each bucket; facts are in no join


def test_sorted_asof_deals_versions_only_where_facts_are(spark):
    day = lambda n: F.date_add(F.lit("2000-01-01").cast("date"), n.cast("int"))
    dim = spark.range(1000).select(F.lit("k").alias("nk"), F.col("id").alias("v"), day(F.col("id") * 32).alias("valid_from")).withColumn("valid_to", F.lit(None).cast("date"))
    facts = spark.range(100).select("id", F.lit("k").alias("key"), day(F.col("id") * 32 + 7).alias("day"))
    steps = joins._steps(facts, dim, "key", "nk", "day", ["v"], 32, 4)
    assert steps.where("_kind = 1").count() == 100 and steps.where("_kind = 0").count() <= 201  # with every part of every bucket: 4400


def test_required_literals_are_in_every_match():
    samples = {"colou?r tab": ["color tab", "colour tab"], r"a\.b+c": ["a.bc", "a.bbbc"], "x(yz|q)w{2}end": ["xyzwwend", "xqwwend"], "[ab]cdef$": ["acdef", "bcdef"], "a{0,2}late": ["late", "aalate"]}
    for pattern, texts in samples.items():
        found = router.required_literals(pattern)
        assert found and all(re.search(pattern, t) and all(x in t for x in found) for t in texts)
    for pattern in ("a|b", "(?i)abc", r"\x41bcd", "x*", ".", "", "[a[bc]]dddd"):
        assert router.required_literals(pattern) == []


def test_router_with_long_texts_and_odd_ids(spark):
    manifest = [("disk full on node", "storage"), ("timeout", "network"), ("x{3}", "odd"), ("never said", "none")]
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(20_000))
    rows = [(1, f"{long} timeout {long} disk full on node {long}"), (2, None), (2, "a timeout"), (None, "xxx"), (3, ""), (4, "tim")]
    found = router.error_router(spark.createDataFrame(rows, "id int, text string"), "text", "id", manifest)
    got = {r.id: (r.component, r.pattern) for r in found.collect()}
    assert got == {1: manifest[0][::-1], 2: manifest[1][::-1], None: manifest[2][::-1], 3: (None, None), 4: (None, None)}
    assert found.count() == 5


def test_partitions_are_replaced_from_one_evaluation(spark, tmp_path):
    path, seen = str(tmp_path / "t"), spark.sparkContext.accumulator(0)
    spark.createDataFrame([(1, "a b"), (2, "c:d"), (3, "e")], "v int, p string").write.partitionBy("p").parquet(path)
    new = spark.sparkContext.parallelize([(4, "a b"), (5, "a b")], 2).map(lambda r: (seen.add(1), r)[1])
    storage.replace_partitions(spark.createDataFrame(new, "v int, p string"), path, "p", ["a b", "c:d"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(3, "e"), (4, "a b"), (5, "a b")]
    assert seen.value == 2


def test_router_with_ten_thousand_patterns_is_the_case(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(3, 9))) for _ in range(12_000)]
    manifest = [(rng.choice(["{0}", "^{0}", "{0}$", "{0}.*x", "(?i){0}", "{0}|{1}", "{0}?{1}"][: 4 if n % 500 else 7]).format(words[n], words[n + 1]), f"c{n % 9}") for n in range(10_000)]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(4)))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "zzz"), (1003, "abc" * 3000)]
    ranked = [(re.compile(p), p, c) for p, c in sorted(manifest, key=lambda m: (-len(m[0]), m[0], m[1]))]
    want = [(i, *next(((c, p) for r, p, c in ranked if t and r.search(t)), (None, None))) for i, t in texts]
    found = router.error_router(spark.createDataFrame(texts, "id int, text string"), "text", "id", manifest)
    assert rows(found) == sorted(want, key=str)


def test_incidents_are_merged_and_appended_once(spark, tmp_path):
    at = lambda *days: spark.createDataFrame([("c", D(2024, 1, d), "LATE", f"d{d}", 0.1 * d) for d in days], "component string, failed_at date, cause string, detail string, confidence double")
    found = meta.merged_alerts([at(1, 2, 2, 3), at(5, 9)], gap_days=1)
    assert rows(found.select("started", "ended", "alerts", F.array_join("evidence", ","))) == [(D(2024, 1, 1), D(2024, 1, 3), 4, "d1,d2,d3"), (D(2024, 1, 5), D(2024, 1, 5), 1, "d5"), (D(2024, 1, 9), D(2024, 1, 9), 1, "d9")]
    assert meta.merged_alerts([at(1, 3, 5)], gap_days=2).count() == 1
    path = f"{tmp_path}/incidents"
    assert [meta.append_new(found, path, "incident_id") for _ in range(3)] == [3, 0, 0]
    assert meta.append_new(meta.merged_alerts([at(1, 2, 2, 3), at(5, 9, 20)]), path, "incident_id") == 1 and spark.read.parquet(path).count() == 4


def test_replaced_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "v int, p string").write.partitionBy("p").parquet(path)
    kept = sorted(str(f) for f in (tmp_path / "t" / "p=a").glob("*.parquet"))
    storage.replace_partitions(spark.createDataFrame([(9, "b"), (8, "a")], "v int, p string"), path, "p", ["b", "c", "d"])
    assert rows(spark.read.parquet(path)) == [(1, "a"), (9, "b")] and sorted(str(f) for f in (tmp_path / "t" / "p=a").glob("*.parquet")) == kept


def test_writes_evaluate_their_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def note(v):
        seen.add(1)
        return v

    once = F.udf(note, "int").asNondeterministic()
    df = spark.createDataFrame([(n, "p") for n in range(50)], "v int, p string").withColumn("v", once("v"))
    assert storage.guarded_write(df, f"{tmp_path}/g", "p", "p") == 50 and seen.value == 50
    tagged = rules.dq_tag(df, [rules.positive("LOW", "v")])
    passed, rejected, counts = rules.dq_store(tagged, f"{tmp_path}/s")
    assert seen.value == 100 and counts == {"rows": 50, "passed": 49, "rejected": 1} and (passed.count(), rejected.count()) == (49, 1)
    assert passed.columns == tagged.columns


def test_a_second_spike_after_a_first_is_found(spark):
    took = [8, 9, 8, 45, 8, 9, 46, 8, 9, 300]
    runs = spark.createDataFrame([("e", D(2024, 1, n + 1), s) for n, s in enumerate(took)] + [("once", D(2024, 1, 1), 9), (None, D(2024, 1, 1), 1), (None, D(2024, 1, 2), 9)], "entity string, day date, seconds int")
    assert sorted(str((r.entity, r.seconds)) for r in detect.duration_anomaly(runs, "entity", "day", "seconds").collect()) == ["('e', 300)", "('e', 45)", "('e', 46)", "(None, 9)"]
    by_month = detect.duration_anomaly(runs.unionByName(spark.createDataFrame([("e", D(2024, 2, 3), 60)], runs.schema)), "entity", "day", "seconds", period="month")
    assert [(r.seconds, r.baseline) for r in by_month.collect()] == [(60, 9.0)]


def jobs_of(spark, run):
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    run()
    return len(set(tracker.getJobIdsForGroup(None)) - before)


def test_schemas_cost_jobs_by_write_and_not_by_file(spark, tmp_path):
    for files in (2, 30):
        spark.range(300).repartition(files).write.parquet(f"{tmp_path}/{files}")
    few, many = (landing.landed_files(spark, f"{tmp_path}/{n}") for n in (2, 30))
    assert (len(few), len(many)) == (2, 30)
    assert jobs_of(spark, lambda: landing.write_schemas(spark, few)) == jobs_of(spark, lambda: landing.write_schemas(spark, many)) <= 1
    spark.range(5).selectExpr("cast(id as string) as id", "1 as more").write.mode("append").parquet(f"{tmp_path}/30")
    drift = landing.drift_by_file(spark, f"{tmp_path}/30", spark.range(1).schema)
    assert {(r.column, r.change) for r in drift.collect()} == {("id", "RETYPED"), ("more", "ADDED")} and drift.select("path").distinct().count() < 6


def test_cells_recall_and_exactness(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    vectors = vectors.unionByName(spark.createDataFrame([(10**6, [0.0] * 64), (10**6 + 1, None)], vectors.schema)).cache()
    queries = vectors.where("vec_id % 50 = 0")
    centres = cells.fit_cells(vectors, "vec_id", "embedding", 16)
    index = cells.index_rows(vectors, centres, "vec_id", "embedding").cache()
    assert index.count() == vectors.count() - 2 and index.select("cell").distinct().count() > 8
    want = rows(detect.cosine_topk(vectors, queries, "vec_id", "embedding", 5, 0.1).select("query_id", "vec_id", "rank"))
    near = rows(cells.cell_topk(index, centres, queries, "vec_id", "embedding", 5, 0.1, probes=10).select("query_id", "vec_id"))
    assert len({x[:2] for x in want} & set(near)) >= 0.9 * len(want)
    exact = cells.cell_topk(index, centres, queries, "vec_id", "embedding", 5, 0.1, probes=2, exact=True)
    assert rows(exact.select("query_id", "vec_id", "rank")) == want
    assert cells.fit_cells(vectors.limit(0), "vec_id", "embedding", 4) == []


def test_copies_of_a_vector_tie_by_id(spark):
    """Equal vectors among others, in several batches and blocks: equal similarities, so the smallest ids lead."""
    rng = random.Random(6)
    one = [rng.gauss(0, 1) for _ in range(33)]
    vectors = [(n, one if n % 3 else [rng.gauss(0, 1) for _ in range(33)]) for n in range(4000)] + [(4001, [1.0, 2.0]), (4002, [2.0, 4.0]), (4003, [float("nan")] * 5), (None, one)]
    df = spark.createDataFrame(vectors, "id long, v array<float>").repartition(7)
    queries = df.where("id in (1, 3000, 4001, 100)")
    got = rows(detect.cosine_topk(df, queries, "id", "v", 3, 0.9, block=2).select("query_id", "id", "rank"))
    assert got == sorted([(1, 2, 1), (1, 4, 2), (1, 5, 3), (100, 1, 1), (100, 2, 2), (100, 4, 3), (4001, 4002, 1)], key=str)


def test_search_multiplies_matrices(spark):
    """2,000 queries against 40,000 rows: eighty million products, some minutes if each is summed by expressions."""
    df = spark.range(40_000).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(F.col("id") * i)).alias("v"))
    began = time.monotonic()
    assert detect.cosine_topk(df, df.where("id % 20 = 0"), "id", "v", 1, 0.0).count() == 1_999  # the row 0 has no length
    assert time.monotonic() - began < 60
