"""Status logs as facts: transitions with the time between, ordered funnels, cancellation.

An entity's log is ordered within periods, and periods are then put together, so
an entity with very many rows is worked on by as many tasks as it has periods.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Quantiles of a dwell time, as decimals.
QUANTILES = {"median": "0.5", "p90": "0.9"}
#: Seconds that are counted together before a quantile is looked for among them.
SPAN = 3_600


def _period(ts: Column, period: str) -> Column:
    return F.coalesce(F.date_trunc(period, ts), F.lit("0001-01-01").cast("timestamp"))


def status_transitions(log: DataFrame, entity: str, status: str, ts: str, tie: str, period: str = "day") -> DataFrame:
    """Each status change with the status before it, its time and the seconds between: ``(entity, from_status, to_status, changed_at, seconds)``.

    Rows are ordered by (``ts``, ``tie``), nulls first.  The first row of a
    period takes its predecessor from the last row of the entity's period
    before, of which there is one row per period.
    """
    rows = log.select(F.col(entity).alias("entity"), F.col(status).alias("status"), F.col(ts).cast("timestamp").alias("at"), F.col(tie).alias("tie"))
    rows = rows.withColumn("period", _period(F.col("at"), period))
    last = rows.groupBy("entity", "period").agg(F.max_by(F.struct("status", "at"), F.struct("at", "tie")).alias("last"))
    before = last.select("entity", "period", F.lag("last").over(Window.partitionBy("entity").orderBy("period")).alias("before")).where("before is not null")
    here = Window.partitionBy("entity", "period").orderBy("at", "tie")
    led = rows.withColumn("prev", F.lag(F.struct("status", "at")).over(here)).alias("r")
    same = F.col("r.entity").eqNullSafe(F.col("b.entity")) & (F.col("r.period") == F.col("b.period"))
    prev = F.coalesce("r.prev", "b.before")
    return (
        led.join(before.alias("b"), same, "left")
        .where(prev["status"].isNotNull())
        .select(
            F.col("r.entity").alias(entity),
            prev["status"].alias("from_status"),
            F.col("r.status").alias("to_status"),
            F.col("r.at").alias("changed_at"),
            (F.col("r.at").cast("long") - prev["at"].cast("long")).alias("seconds"),
        )
    )


def exact_quantiles(counts: DataFrame, group: str, value: str, rows: str, quantiles: dict[str, str], span: int = SPAN) -> DataFrame:
    """Per ``group`` the values at the given quantiles, ``(_group, *names)``: of n values that are not null, the one at rank ``ceil(q * n)``.

    ``counts`` tells how many ``rows`` have which whole ``value``.  The span of
    values that holds a rank is found from the spans' counts, and only its
    values are ordered, so no group is sorted by one task.
    """
    counts = counts.where(F.col(value).isNotNull()).select(F.col(group).alias("_in"), F.col(value).alias("_at"), F.col(rows).alias("_n"), F.floor(F.col(value) / span).alias("_span"))
    spans = counts.groupBy(F.col("_in").alias("_group"), F.col("_span").alias("_of")).agg(F.sum("_n").alias("_all"))
    by = Window.partitionBy("_group")
    spans = spans.withColumn("_total", F.sum("_all").over(by)).withColumn("_upto", F.sum("_all").over(by.orderBy("_of").rowsBetween(Window.unboundedPreceding, 0)))
    rank = {n: F.ceil(F.col("_total") * F.lit(q).cast("decimal(6,5)")) for n, q in quantiles.items()}
    before = F.col("_upto") - F.col("_all")
    held = reduce(lambda a, b: a | b, [(before < r) & (r <= F.col("_upto")) for r in rank.values()])
    wanted = spans.where(held).select("_group", "_of", before.alias("_before"), *[r.alias(f"_{n}") for n, r in rank.items()])
    inside = counts.join(wanted, F.col("_in").eqNullSafe(F.col("_group")) & (F.col("_span") == F.col("_of")))
    here = Window.partitionBy("_group", "_span").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    led = inside.withColumn("_last", F.col("_before") + F.sum("_n").over(here))
    first = lambda n: F.min(F.when((F.col("_last") - F.col("_n") < F.col(f"_{n}")) & (F.col(f"_{n}") <= F.col("_last")), F.col("_at")))
    return led.groupBy("_group").agg(*[first(n).alias(n) for n in quantiles])


def dwell_times(moves: DataFrame) -> DataFrame:
    """Per pair of states: moves, shortest, median, 90th percentile and longest seconds between, all exact."""
    counts = moves.groupBy(F.struct("from_status", "to_status").alias("pair"), "seconds").agg(F.count(F.lit(1)).alias("n"))
    told = counts.groupBy("pair").agg(F.sum("n").alias("moves"), F.min("seconds").alias("shortest"), F.max("seconds").alias("longest"))
    found = exact_quantiles(counts, "pair", "seconds", "n", QUANTILES)
    return told.join(found, F.col("pair").eqNullSafe(F.col("_group")), "left").select("pair.*", "moves", "shortest", *QUANTILES, "longest")


_STATE = T.StructType([T.StructField("reached", T.ArrayType(T.TimestampType())), T.StructField("cancelled_at", T.TimestampType())])


def _state(reached: Column, cancelled_at: Column) -> Column:
    return F.struct(reached.alias("reached"), cancelled_at.alias("cancelled_at")).cast(_STATE)


def funnel(log: DataFrame, entity: str, status: str, ts: str, tie: str, stages: list[str], cancelled: str, period: str = "day") -> DataFrame:
    """How far each entity came through ``stages`` in this order: ``(entity, furthest, reached, cancelled_at)``.

    A stage counts once all before it are reached; other states between do not
    matter.  ``reached`` holds the time of each stage that was reached, and
    nothing counts after ``cancelled``.  Entities with no row of these states
    have furthest 0.

    A state machine runs over the sorted rows of a period, once from every
    stage in which the period could begin; what it gives is small, and an
    entity's periods are then chained.
    """
    number = F.lit(None).cast("int")
    for i, name in enumerate(stages):
        number = F.when(F.col(status) == name, i).otherwise(number)
    number = F.when(F.col(status) == cancelled, -1).otherwise(number)
    rows = log.select(F.col(entity).alias("entity"), F.col(ts).cast("timestamp").alias("at"), F.col(tie).alias("tie"), number.alias("stage"))
    some = rows.where("stage is not null").withColumn("period", _period(F.col("at"), period))
    sorted_rows = some.groupBy("entity", "period").agg(F.array_sort(F.collect_list(F.struct("at", "tie", "stage"))).alias("rows"))
    none = _state(F.array(), F.lit(None).cast("timestamp"))

    def step(start: Column):
        def run(state: Column, row: Column) -> Column:
            on = row["stage"] == start + F.size(state["reached"])
            return (
                F.when(state["cancelled_at"].isNotNull(), state)
                .when(row["stage"] == -1, _state(state["reached"], row["at"]))
                .when(on, _state(F.concat(state["reached"], F.array(row["at"])), state["cancelled_at"]))
                .otherwise(state)
            )

        return run

    starts = F.array(*[F.lit(i) for i in range(len(stages) + 1)])
    by_start = sorted_rows.select("entity", "period", F.transform(starts, lambda s: F.aggregate("rows", none, step(s))).alias("by_start"))
    periods = by_start.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("period", "by_start"))).alias("periods"))

    def chain(state: Column, p: Column) -> Column:
        then = F.get(p["by_start"], F.size(state["reached"]))
        return F.when(state["cancelled_at"].isNotNull(), state).otherwise(_state(F.concat(state["reached"], then["reached"]), then["cancelled_at"]))

    found = periods.select("entity", F.aggregate("periods", none, chain).alias("state")).alias("f")
    every = log.select(F.col(entity).alias("entity")).distinct().alias("e")
    state = F.coalesce(F.col("f.state"), none)
    return every.join(found, F.col("e.entity").eqNullSafe(F.col("f.entity")), "left").select(
        F.col("e.entity").alias(entity), F.size(state["reached"]).alias("furthest"), state["reached"].alias("reached"), state["cancelled_at"].alias("cancelled_at")
    )


def funnel_summary(entities: DataFrame, stages: list[str]) -> DataFrame:
    """Per stage: entities that reached it, their share of the stage before, those cancelled there, that share, and the median seconds since the stage before.

    Stage 0 stands for entities before the first stage.
    """
    at = F.array(*[F.lit(i) for i in range(len(stages) + 1)])
    since = F.when(F.col("stage") > 1, F.get("reached", F.col("stage") - 1).cast("long") - F.get("reached", F.col("stage") - 2).cast("long"))
    rows = entities.select("furthest", "reached", "cancelled_at", F.explode(at).alias("stage")).where("stage <= furthest")
    lost = (F.col("stage") == F.col("furthest")) & F.col("cancelled_at").isNotNull()
    counts = rows.groupBy("stage", since.alias("seconds"), lost.alias("lost")).agg(F.count(F.lit(1)).alias("n"))
    told = counts.groupBy("stage").agg(F.sum("n").alias("entities"), F.sum(F.when(F.col("lost"), F.col("n")).otherwise(0)).alias("cancelled"))
    medians = exact_quantiles(counts, "stage", "seconds", "n", {"median_seconds": "0.5"})
    told = told.join(medians, F.col("stage") == F.col("_group"), "left")
    names = F.element_at(F.array(F.lit("(start)"), *[F.lit(s) for s in stages]), F.col("stage") + 1)
    share = lambda a, b: F.round(F.try_divide(a * 100, b), 2).cast("decimal(6,2)")
    before = F.lag("entities").over(Window.orderBy("stage"))  # one row per stage
    return told.select(
        "stage", names.alias("status"), "entities", share(F.col("entities"), before).alias("of_stage_before_pct"), "cancelled",
        share(F.col("cancelled"), F.col("entities")).alias("cancelled_pct"), "median_seconds",
    )
