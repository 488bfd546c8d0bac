"""Verification and reconciliation of built tables; each check is a DataFrame."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .keys import fk_flag


def _rows() -> Column:
    return F.count(F.lit(1))


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and distinct keys; keys with nulls count as keys."""
    return df.agg(_rows().alias("rows"), F.count_distinct(F.struct(*keys)).alias("distinct_keys")).withColumn(
        "is_unique", F.col("rows") == F.col("distinct_keys")
    )


def check_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(_rows().alias("rows")).where("rows > 1")


def check_no_current(dim: DataFrame, key: str) -> DataFrame:
    """Keys without a current version."""
    return dim.groupBy(key).agg(F.count_if("is_current").alias("current_versions")).where("current_versions = 0").select(key)


def check_intervals(dim: DataFrame, key: str) -> DataFrame:
    """Versions that end before they begin, overlap the next one, or leave a gap before it."""
    w = Window.partitionBy(key).orderBy("valid_from", "valid_to")
    following = F.lead("valid_from").over(w)
    end = F.coalesce("valid_to", F.lit("9999-12-31").cast("date"))
    problem = (
        F.when(F.col("valid_to") < F.col("valid_from"), "REVERSED")
        .when(following <= end, "OVERLAP")
        .when(following > F.date_add(end, 1), "GAP")
    )
    return dim.select(key, "valid_from", "valid_to", problem.alias("problem")).where("problem is not null")


def fk_orphans(fact: DataFrame, dim: DataFrame, column: str, key: str) -> DataFrame:
    """Fact rows whose key is set and missing in ``dim``."""
    return fact.where(F.col(column).isNotNull()).join(dim.select(F.col(key).alias(column)), column, "left_anti")


def distinct_fk_orphans(left: DataFrame, column: str, right: DataFrame, key: str) -> DataFrame:
    return fk_orphans(left.select(column).distinct(), right, column, key)


def invariants(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """How many rows break each predicate, all in one pass: ``(check, broken)``."""
    one = df.agg(*[F.count_if(p).alias(n) for n, p in predicates.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("broken")) for n in predicates])
    return one.select(F.explode(pairs).alias("x")).select("x.*")


def reconcile_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = left.agg(_rows().alias("left_rows")), right.agg(_rows().alias("right_rows"))
    return a.crossJoin(b).withColumn("equal", F.col("left_rows") == F.col("right_rows"))


def reconcile_sums(left: DataFrame, right: DataFrame, measures: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Both sums of each measure: ``(measure, left_sum, right_sum, equal)``."""
    a = left.agg(*[F.sum(x).cast("decimal(20,2)").alias(f"a_{n}") for n, (x, _) in measures.items()])
    b = right.agg(*[F.sum(y).cast("decimal(20,2)").alias(f"b_{n}") for n, (_, y) in measures.items()])
    rows = F.array(
        *[F.struct(F.lit(n).alias("measure"), F.col(f"a_{n}").alias("left_sum"), F.col(f"b_{n}").alias("right_sum")) for n in measures]
    )
    return a.crossJoin(b).select(F.explode(rows).alias("x")).select("x.*", F.col("x.left_sum").eqNullSafe(F.col("x.right_sum")).alias("equal"))


def grid_completeness(df: DataFrame, day: str, left: str, right: str, first: str, last: str) -> DataFrame:
    """Per expected date: rows against the distinct x distinct grid, as MISSING, DUPES, PARTIAL or ok."""
    spark = df.sparkSession
    expected = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(day))
    pairs = df.groupBy(day, left, right).agg(_rows().alias("n"))
    found = pairs.groupBy(day).agg(
        F.sum("n").alias("rows"), _rows().alias("pairs"), (F.count_distinct(left) * F.count_distinct(right)).alias("grid")
    )
    status = (
        F.when(F.col("rows").isNull(), "MISSING").when(F.col("rows") > F.col("pairs"), "DUPES").when(F.col("pairs") < F.col("grid"), "PARTIAL").otherwise("ok")
    )
    return expected.join(found, day, "left").select(
        day, F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("grid", F.lit(0)).alias("grid"), status.alias("status")
    )


def daily_audit(df: DataFrame, day: Column, ts: str) -> DataFrame:
    """Rows per day with the first and last time."""
    return df.groupBy(day.alias("day")).agg(_rows().alias("rows"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))


def lines_per_day(lines: DataFrame, orders: DataFrame, line_key: str, order_key: str, day: str) -> DataFrame:
    """Lines per day of their order."""
    dated = orders.select(F.col(order_key).alias("_key"), F.col(day).alias("day"))
    return lines.select(line_key).join(dated, F.col(line_key) == F.col("_key")).groupBy("day").agg(_rows().alias("rows"))


def last_rows(df: DataFrame, ts: str, ties: list[str], k: int = 3) -> DataFrame:
    return df.orderBy(F.desc(ts), *[F.desc(c) for c in ties]).limit(k)


def cardinality_histogram(df: DataFrame, key: str) -> DataFrame:
    """How many keys have how many rows."""
    return df.groupBy(key).agg(_rows().alias("size")).groupBy("size").agg(_rows().alias("keys"))


def null_profile(df: DataFrame, group: str, measure: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.count_if(F.col(measure).isNull()).alias("nulls"),
        F.count(measure).alias("non_nulls"),
        _rows().alias("rows"),
        F.count_if(F.col(measure) < 0).alias("negatives"),
    )


def rate_by_date(df: DataFrame, day: str, flag: Column) -> DataFrame:
    return df.groupBy(day).agg(F.count_if(flag).alias("hits"), _rows().alias("rows")).withColumn(
        "rate_pct", F.round(F.col("hits") * 100 / F.col("rows"), 2)
    )


def breakdowns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Value counts of several columns in one pass: ``(column, value, rows)``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("x")).groupBy("x.column", "x.value").agg(_rows().alias("rows"))


def top_grain(df: DataFrame, measure: str, ties: list[str], k: int = 5) -> DataFrame:
    return df.orderBy(F.desc(measure), *ties).limit(k)


def fk_card(fact: DataFrame | Mapping[str, DataFrame], keys: list[tuple[str, str, DataFrame, str, bool]]) -> DataFrame:
    """All foreign keys of a fact: ``(check, rows, nulls, orphans)``.

    ``keys``: name, fact column, dimension, its key, and whether a null is an
    orphan too.  A column's values are counted together with the keys of their
    dimension, so no fact row is moved and a value once.  Give a stored fact, each
    of whose columns is read once, or the DataFrame of every column.
    """
    found = None
    for name, column, dim, key, required in keys:
        values = (fact if isinstance(fact, DataFrame) else fact[column]).select(F.col(column).alias("_value"), F.lit(1).cast("long").alias("_n"), F.lit(False).alias("_held"))
        known = dim.where(F.col(key).isNotNull()).select(F.col(key).alias("_value"), F.lit(0).cast("long").alias("_n"), F.lit(True).alias("_held"))
        counts = values.unionByName(known).groupBy("_value").agg(F.sum("_n").alias("_n"), F.max("_held").alias("_held"))
        missing = ~F.col("_held") if required else ~F.col("_held") & F.col("_value").isNotNull()
        total = lambda of: F.coalesce(F.sum(F.when(of, F.col("_n"))), F.lit(0).cast("long"))
        one = counts.agg(F.lit(name).alias("check"), total(F.lit(True)).alias("rows"), total(F.col("_value").isNull()).alias("nulls"), total(missing).alias("orphans"))
        found = one if found is None else found.unionByName(one)
    return found


def scorecard(
    spark: SparkSession, checks: Mapping[str, tuple[DataFrame | Callable[[], DataFrame], int]], seconds: float = 300.0, workers: int = 4, attempts: int = 1
) -> DataFrame:
    """``(check, value, expected, status, attempts, error)``: the rows of each check's DataFrame against what they must be.

    Every check is a job group of its own, ``workers`` side by side.  One that
    raises, while planned or in a task, is an ERROR; one whose tasks run for
    longer than ``seconds`` is cancelled by its group and is a TIMEOUT, tried up
    to ``attempts`` times: a check that waits behind the tasks of another is not
    late.  Neither touches the others, and neither is a FAIL.
    Checks run when this is called; the card has one row for each.
    """
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()

    def run(group: str, name: str, made: DataFrame | Callable[[], DataFrame]) -> int:
        sc.setJobGroup(group, f"check {name}")
        return (made() if callable(made) else made).count()

    def at_work(group: str) -> bool:
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
        stages = [tracker.getStageInfo(s) for j in jobs if j for s in j.stageIds]
        return any(s and s.numActiveTasks for s in stages)

    def watched(name: str, made: DataFrame | Callable[[], DataFrame]) -> tuple[int | None, str | None, int, str | None]:
        for attempt in range(1, attempts + 1):
            group, busy, seen, late = f"check-{uuid.uuid4().hex}", 0.0, time.monotonic(), False
            with ThreadPoolExecutor(1) as one:
                job = one.submit(inheritable_thread_target(spark)(run), group, name, made)
                while not wait([job], timeout=0.2).done:
                    now = time.monotonic()
                    busy, seen = busy + (now - seen if at_work(group) else 0), now
                    if busy >= seconds:
                        late = True
                        sc.cancelJobGroup(group)
            if not job.exception():
                return job.result(), None, attempt, None
            if not late:
                return None, "ERROR", attempt, str(job.exception()).strip().splitlines()[0][:300]
        return None, "TIMEOUT", attempts, f"cancelled after {seconds:g} seconds"

    with ThreadPoolExecutor(workers) as pool:
        jobs = {name: pool.submit(watched, name, made) for name, (made, _) in checks.items()}
    rows = []
    for name, job in jobs.items():
        value, status, tried, error = job.result()
        expected = checks[name][1]
        rows.append((name, value, expected, status or ("PASS" if value == expected else "FAIL"), tried, error))
    return spark.createDataFrame(rows, "check string, value long, expected long, status string, attempts int, error string")
