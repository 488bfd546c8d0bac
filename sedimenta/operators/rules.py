"""Declarative data-quality rules: tagging, splitting, quarantine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import write_observed


@dataclass(frozen=True)
class Rule:
    """``code`` is given to rows for which ``broken`` is true.

    A null predicate does not break a rule unless ``nulls_fail``: a null slips
    through a set test, as in plain SQL.
    """

    code: str
    broken: Column
    nulls_fail: bool = False


def not_null(code: str, column: str) -> Rule:
    return Rule(code, F.col(column).isNull())


def in_set(code: str, column: str, allowed: list, nulls_fail: bool = False) -> Rule:
    return Rule(code, ~F.col(column).isin(allowed), nulls_fail)


def positive(code: str, column: str) -> Rule:
    return Rule(code, F.col(column).isNull() | (F.col(column) <= 0))


def none_negative(code: str, *columns: str) -> Rule:
    broken = F.lit(False)
    for c in columns:
        broken = broken | F.coalesce(F.col(c) < 0, F.lit(False))
    return Rule(code, broken)


def required_when(code: str, column: str, condition: Column) -> Rule:
    return Rule(code, condition & F.col(column).isNull())


def contains(code: str, column: str, part: str) -> Rule:
    return Rule(code, ~F.col(column).contains(part), True)


def matches(code: str, column: str, pattern: str) -> Rule:
    return Rule(code, ~F.col(column).rlike(pattern), True)


def known(code: str, flag: str) -> Rule:
    return Rule(code, ~F.col(flag), True)


def unknown(code: str, column: str, flag: str | None = None) -> Rule:
    """The key is set, and the flag of its reference check (``_<column>_known``) is false."""
    return Rule(code, F.col(column).isNotNull() & ~F.col(flag or f"_{column}_known"))


def both_in_set(code: str, first: str, second: str, allowed: list) -> Rule:
    """One code for two columns; a null in the first is allowed."""
    return Rule(code, (F.col(first).isNotNull() & ~F.col(first).isin(allowed)) | ~F.col(second).isin(allowed))


def dq_tag(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """All rules in one projection: ``dq_rejection_reason`` (codes joined by ;) and ``dq_passed``."""
    codes = F.array_compact(
        F.array(*[F.when(F.coalesce(r.broken, F.lit(True)) if r.nulls_fail else r.broken, F.lit(r.code)) for r in rules])
    )
    return df.withColumn("_codes", codes).withColumns(
        {"dq_passed": F.size("_codes") == 0, "dq_rejection_reason": F.nullif(F.concat_ws(";", "_codes"), F.lit(""))}
    ).drop("_codes")


def dq_split(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tagged.where("dq_passed"), tagged.where("not dq_passed")


def dq_store(tagged: DataFrame, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Passed and rejected rows written side by side in one pass, with their numbers observed on the way."""
    counts = write_observed(
        tagged, path, "overwrite", "dq_passed", passed=F.count_if("dq_passed"), rejected=F.count_if(~F.col("dq_passed"))
    )
    stored = tagged.sparkSession.read.schema(tagged.schema).parquet(path).select(tagged.columns)
    return *dq_split(stored), counts


def dq_counts(tagged: DataFrame) -> DataFrame:
    return tagged.agg(
        F.count_if("dq_passed").alias("passed"), F.count_if(~F.col("dq_passed")).alias("rejected"), F.count(F.lit(1)).alias("total")
    )


def quarantine_envelope(rejected: DataFrame, columns: list[str], run_id: str, at: str, source: str) -> DataFrame:
    """Rejected rows in one fixed shape; the id is a digest of run, table and record, so a repeated run repeats it."""
    raw = F.to_json(F.struct(*columns))
    return rejected.select(
        F.sha2(F.concat_ws("|", F.lit(run_id), F.lit(source), raw), 256).alias("quarantine_id"),
        F.col("dq_rejection_reason").alias("rejection_reason"),
        F.lit(run_id).alias("pipeline_run_id"),
        F.lit(at).cast("timestamp").alias("rejected_at"),
        raw.alias("raw_record"),
        F.lit(source).alias("source_table"),
    )


def reject_breakdown(tagged: DataFrame, per_code: bool = False) -> DataFrame:
    rejected = tagged.where("not dq_passed")
    reason = F.explode(F.split("dq_rejection_reason", ";")) if per_code else F.col("dq_rejection_reason")
    return rejected.select(reason.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def layer_counts(entity: str, bronze: DataFrame, silver: DataFrame, failed: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Rows of an entity in each layer."""
    layers = [("bronze", bronze), ("silver", silver), ("dq_failed", failed), ("quarantine", quarantine)]
    out = None
    for name, df in layers:
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(entity).alias("entity"), F.lit(name).alias("layer"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def transition_counts(df: DataFrame, before: str, after: str, top: int = 10) -> DataFrame:
    return (
        df.groupBy(before, after).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.asc_nulls_first(before), after).limit(top)
    )
