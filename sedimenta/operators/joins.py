"""As-of, lookup and grid joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import join_spread

OPEN_END = "9999-12-31"


def asof_attach(facts: DataFrame, dim: DataFrame, key: str, dim_key: str, day: str, columns: list[str], gap_free: bool = False, apart: bool = False, stored: bool = False, reach: str | None = None) -> DataFrame:
    """Each fact with the version of ``dim`` that covers its day, else the key's earliest version.

    ``columns`` of the version are added, null where the key is null or has
    no version; facts keep their number.  Versions of a key must not overlap:
    overlapping ones raise, and ``asof_attach_overlapping`` takes them; a caller
    whose timeline cannot overlap, as those of ``scd2_from_timeline``, says
    ``apart`` and saves the check.  Facts with a null key are spread over all
    tasks.  No fact is ranked: an equi-join with the interval as residual finds
    the one covering version, and one first version per key fills in.  With ``gap_free``
    timelines the first version reaches back to all earlier days instead, and
    the second join falls away.  Facts that are ``stored`` may be read twice, so
    those without a key are not moved at all.  ``reach`` names the column that
    ``reaching_back`` added to a gap-free ``dim`` before it was stored: its
    versions then move once and not twice.
    """
    if stored:
        kinds = {c: dim.schema[c].dataType for c in columns}
        keyless = facts.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
        return asof_attach(facts.where(F.col(key).isNotNull()), dim, key, dim_key, day, columns, gap_free, apart, reach=reach).unionByName(keyless)
    versions = dim.where(F.col(dim_key).isNotNull()).select(
        F.col(dim_key).alias("_key"),
        F.col(reach or "valid_from").alias("_from"),
        F.coalesce("valid_to", F.lit(OPEN_END).cast("date")).alias("_to"),
        F.struct(*columns).alias("_version"),
    )
    versions = _apart(versions, apart)
    if gap_free:
        given, facts = [f"f.{c}" for c in facts.columns], _dealt(facts, key)
        versions = versions if reach else reaching_back(versions, "_key", "_from", "_from")
        found = facts.alias("f").join(versions.alias("v"), _covers(key, day), "left")
        return found.select(*given, *[F.col(f"v._version.{c}").alias(c) for c in columns])
    first = versions.groupBy("_key", "_part").agg(F.min_by("_version", "_from").alias("_first"))
    return _floored(facts, versions, first, key, day, columns)


def reaching_back(dim: DataFrame, key: str, begin: str = "valid_from", name: str = "reach") -> DataFrame:
    """``dim`` with ``name``: where a version begins, and of a key's first version the calendar's first day.  A timeline dealt by key is not moved."""
    start = F.min(begin).over(Window.partitionBy(key))
    return dim.withColumn(name, F.when(F.col(begin) == start, F.lit("0001-01-01").cast("date")).otherwise(F.col(begin)))


def _dealt(facts: DataFrame, key: str) -> DataFrame:
    """``facts`` with ``_spread``: 0, or a hash of the row where the key is null."""
    return facts.withColumn("_spread", F.when(F.col(key).isNull(), F.xxhash64(*facts.columns)).otherwise(F.lit(0).cast("long")))


def _floored(facts: DataFrame, versions: DataFrame, first: DataFrame, key: str, day: str, columns: list[str]) -> DataFrame:
    """Facts with the one of ``versions`` that covers their day, else with their key's ``first``."""
    found = _dealt(facts, key).alias("f").join(versions.alias("v"), _covers(key, day), "left")
    floored = found.join(first.alias("w"), (F.col(f"f.{key}") == F.col("w._key")) & (F.col("f._spread") == F.col("w._part")), "left")
    return floored.select(*[f"f.{c}" for c in facts.columns], *[_pick(c) for c in columns])


def _apart(versions: DataFrame, known: bool) -> DataFrame:
    """``versions`` with ``_part`` = 0, against which facts without a key are spread; a version that begins before its predecessor ends raises, unless it is ``known`` that none does."""
    none = F.pmod(F.xxhash64("_key"), F.lit(1).cast("long"))
    if known:
        return versions.withColumn("_part", none)
    w = Window.partitionBy("_key").orderBy("_from", "_to")
    meets = F.coalesce(F.lag("_to").over(w) >= F.col("_from"), F.lit(False))
    fail = F.raise_error(F.concat(F.lit("overlapping versions of "), F.col("_key").cast("string"))).cast("long")
    return versions.withColumn("_part", F.when(meets, fail).otherwise(none))


def _covers(key: str, day: str) -> Column:
    return (F.col(f"f.{key}") == F.col("v._key")) & (F.col("f._spread") == F.col("v._part")) & F.col(f"f.{day}").between(F.col("v._from"), F.col("v._to"))


def _pick(column: str) -> Column:
    return F.when(F.col("v._key").isNotNull(), F.col(f"v._version.{column}")).otherwise(F.col(f"w._first.{column}")).alias(column)


def asof_attach_overlapping(facts: DataFrame, dim: DataFrame, row_id: str | list[str], key: str, dim_key: str, day: str, columns: list[str]) -> DataFrame:
    """As ``asof_attach`` where versions may overlap: the latest covering version wins; of those with one begin the longest.

    Versions are cut into stretches of days that do not overlap, each with its
    latest version, so facts move as in ``asof_attach`` and are not told apart by
    ``row_id``, which callers still name.
    """
    versions = dim.where(F.col(dim_key).isNotNull()).select(
        F.col(dim_key).alias("_key"),
        F.col("valid_from").alias("_from"),
        F.coalesce("valid_to", F.lit(OPEN_END).cast("date")).alias("_to"),
        F.struct(*columns).alias("_version"),
    )
    part = F.pmod(F.xxhash64("_key"), F.lit(1).cast("long")).alias("_part")
    first = versions.groupBy("_key").agg(F.min_by("_version", "_from").alias("_first")).select("*", part)
    return _floored(facts, stretches(versions).select("*", part), first, key, day, columns)


def stretches(versions: DataFrame) -> DataFrame:
    """``versions`` (``_key, _from, _to, _version``) as stretches of days without overlap, each with the latest version that covers it.

    A stretch begins where a version does, which is then the latest, or on the
    day after one ends, for which the latest is looked up.
    """
    valid = versions.where("_from <= _to").groupBy("_key", "_from").agg(F.max_by("_version", "_to").alias("_version"), F.max("_to").alias("_to"))
    ends = valid.select("_key", F.date_add("_to", 1).alias("_at")).distinct()
    found = ends.alias("e").join(valid.alias("v"), (F.col("e._key") == F.col("v._key")) & F.col("e._at").between(F.col("v._from"), F.col("v._to")), "left")
    after = found.groupBy("e._key", "e._at").agg(F.max_by(F.struct("v._from", "v._version"), "v._from").alias("_told"))
    points = valid.select("_key", F.col("_from").alias("_at"), F.struct("_from", "_version").alias("_told")).unionByName(after)
    once = points.groupBy("_key", "_at").agg(F.max_by("_told", "_told._from").alias("_told"))
    w = Window.partitionBy("_key").orderBy("_at")
    changed = once.withColumn("_same", F.lag("_told._from").over(w).eqNullSafe(F.col("_told._from"))).where("not _same")
    until = F.coalesce(F.date_sub(F.lead("_at").over(w), 1), F.lit(OPEN_END).cast("date"))
    return changed.select("_key", F.col("_at").alias("_from"), until.alias("_to"), "_told").where("_told is not null").select("_key", "_from", "_to", "_told._version")


def asof_attach_sorted(
    facts: DataFrame, dim: DataFrame, key: str, dim_key: str, day: str, columns: list[str], bucket_days: int = 32, salts: int = 4
) -> DataFrame:
    """As ``asof_attach``, in work linear in facts plus versions, for keys with very many versions.

    Facts and versions are sorted together and each fact takes the last version
    before it, so no fact meets all versions of its key.  Keys are cut into
    buckets of days: of every bucket that has facts, the version in force at its
    begin is carried in (found over buckets and versions alone), so a key with
    very many facts is dealt over its buckets, and within one over ``salts``
    parts.  Versions go only to buckets and parts that have facts.  Facts without
    a key are dealt by a hash.  Versions of a key must not overlap.
    """
    steps = _steps(facts, dim, key, dim_key, day, columns, bucket_days, salts)
    here = Window.partitionBy("_key", "_bucket", "_salt").orderBy(F.col("_at").asc_nulls_last(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    led = steps.select("_row", "_at", "_kind", F.last("_told", ignorenulls=True).over(here).alias("_told"), F.last("_first", ignorenulls=True).over(here).alias("_first"))
    covers = F.coalesce(F.col("_at") <= F.col("_told._to"), F.lit(False))
    return led.where("_kind = 1").select("_row.*", *[F.when(covers, F.col(f"_told._version.{c}")).otherwise(F.col(f"_first.{c}")).alias(c) for c in columns])


def _steps(facts: DataFrame, dim: DataFrame, key: str, dim_key: str, day: str, columns: list[str], bucket_days: int, salts: int) -> DataFrame:
    """Facts (``_kind`` 1) and, for every bucket and part that has some, the version in force at its begin and those that begin in it (``_kind`` 0)."""
    versions = dim.where(F.col(dim_key).isNotNull()).select(
        F.col(dim_key).alias("_key"), F.unix_date("valid_from").alias("_at"), F.unix_date(F.coalesce("valid_to", F.lit(OPEN_END).cast("date"))).alias("_to"), F.struct(*columns).alias("_version")
    )
    bucket = lambda at: F.floor(at / bucket_days)
    keyless = F.col(key).isNull()
    rows = facts.select(
        F.col(key).alias("_key"),
        F.unix_date(day).alias("_at"),
        F.when(keyless, F.xxhash64(*facts.columns)).when(F.col(day).isNull(), F.lit(-(1 << 40))).otherwise(bucket(F.unix_date(day))).alias("_bucket"),
        F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).alias("_salt"),
        F.struct(*facts.columns).alias("_row"),
    )
    told = F.struct("_to", "_version").alias("_told")
    first = versions.groupBy("_key").agg(F.min_by("_version", "_at").alias("_first"))
    present = F.array(*[F.when(F.max(F.col("_salt") == s), F.lit(s).cast("long")) for s in range(salts)])
    held = rows.where("_key is not null").groupBy("_key", "_bucket").agg(F.array_compact(present).alias("_salts"))
    begin = F.greatest(F.col("_bucket") * bucket_days, F.lit(-(1 << 30)).cast("long")).cast("int")
    begins = held.join(first, "_key").select("_key", begin.alias("_at"), F.lit(1).alias("_kind"), "_bucket", "_salts", "_first")
    both = begins.unionByName(versions.select("_key", "_at", F.lit(0).alias("_kind"), bucket(F.col("_at")).alias("_bucket"), told), allowMissingColumns=True)
    so_far = Window.partitionBy("_key").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    told_by = both.withColumn("_sofar", F.last("_told", ignorenulls=True).over(so_far))
    there = told_by.withColumn("_salts", F.max("_salts").over(Window.partitionBy("_key", "_bucket")))  # none where the bucket has no facts
    parts = ["_key", "_bucket", "_salt", "_at", "_kind"]
    begun = F.col("_kind") == 1
    return there.select(
        "_key", "_bucket", F.explode("_salts").alias("_salt"), F.when(begun, F.col("_at") - 1).otherwise(F.col("_at")).alias("_at"), F.lit(0).alias("_kind"), F.when(begun, F.col("_sofar")).otherwise(F.col("_told")).alias("_told"), "_first"
    ).unionByName(rows.select(*parts[:4], F.lit(1).alias("_kind"), "_row"), allowMissingColumns=True)


def lookup_attach(df: DataFrame, lookup: DataFrame, key: str, lookup_key: str, columns: list[str]) -> DataFrame:
    """``df`` with columns of the one lookup row of its key; facts without one get nulls, and those without a key are spread over all tasks."""
    return join_spread(df, lookup.select(F.col(lookup_key).alias("_key"), *columns), key)


def line_order_join(lines: DataFrame, orders: DataFrame, line_key: str, order_key: str) -> tuple[DataFrame, DataFrame]:
    """Lines with their order, and the lines that have none."""
    joined = lines.join(orders, lines[line_key] == orders[order_key]).drop(orders[order_key])
    return joined, lines.join(orders.select(F.col(order_key).alias(line_key)), line_key, "left_anti")


def dense_grid(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of two key lists: the grid that a full snapshot must fill."""
    return left.crossJoin(right)
