"""Fact builds over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts, joins, keys, merge, scd
from ..sources import storage
from .retail import DIM, INVENTORY, MEASURED, STOCK, STOCK_DIM, customer_dim, inventory, key_sql, measured_lines, measures, orders, orders_of_nations, priced_lines, product_dim, rep_dim, silver_lines, stock, stock_dim, table, versions_sql

GRAIN = ["order_date", "channel", "category", "territory"]
#: What the rollup needs of a line besides.
TOLD = ["l_orderkey", "quantity", "l_extendedprice", "l_discount", "l_returnflag"]


def line_order_join(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders not finished joined to them, and how many lines found none."""
    some = orders(spark, d).where("o_orderstatus <> 'F'").select("o_orderkey", "channel")
    joined, orphans = joins.line_order_join(silver_lines(spark, d), some, "l_orderkey", "o_orderkey")
    per = joined.groupBy("channel").agg(F.count(F.lit(1)).alias("rows"))
    return per.unionByName(orphans.agg(F.count(F.lit(1)).alias("rows")).withColumn("channel", F.lit("none")))


def _dated(spark: SparkSession, d: str) -> DataFrame:
    """Lines by customer and ship date; a tenth have no customer."""
    lines = silver_lines(spark, d).join(orders(spark, d), F.col("l_orderkey") == F.col("o_orderkey"))
    customer = F.when(F.col("l_orderkey") % 10 != 0, F.col("o_custkey"))
    return lines.select("l_orderkey", "l_linenumber", customer.alias("customer"), F.to_date("l_shipdate").alias("ship_date"))


def _dim(spark: SparkSession, d: str) -> DataFrame:
    """The customer timeline with gaps: versions of low priority are missing."""
    return customer_dim(spark, d).where("priority <> '5-LOW'")


def asof_attach(spark: SparkSession, d: str) -> DataFrame:
    return joins.asof_attach(_dated(spark, d), _dim(spark, d), "customer", "o_custkey", "ship_date", ["priority", "valid_from"])


def asof_attach_branch(spark: SparkSession, d: str) -> DataFrame:
    """As-of over the gap-free timeline; rows without a customer keep null columns without a branch of their own."""
    return joins.asof_attach(_dated(spark, d), customer_dim(spark, d), "customer", "o_custkey", "ship_date", ["priority", "valid_from"], gap_free=True, apart=True)


def lookup_attach(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").where("n_regionkey <> 2")
    return joins.lookup_attach(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), nations, "s_nationkey", "n_nationkey", ["n_name", "n_regionkey"])


def asof_attach_overlapping(spark: SparkSession, d: str) -> DataFrame:
    """As-of over versions that each stay valid ten days longer than their successor's start."""
    dim = customer_dim(spark, d).withColumn("valid_to", F.date_add("valid_to", 10))
    return joins.asof_attach_overlapping(
        _dated(spark, d), dim, ["l_orderkey", "l_linenumber"], "customer", "o_custkey", "ship_date", ["priority", "valid_from"]
    )


#: What the fact builds need of a line; its measures follow from it.
PRICED = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_custkey", "order_date", "channel", "o_orderstatus", "category", "quantity", "l_extendedprice", "l_discount", "l_returnflag", "nation", "customer_known"]


def stored_lines(spark: SparkSession, d: str, customers: DataFrame | None = None) -> DataFrame:
    """Priced lines written once, for builds that read them several times.

    ``customers``: versions, whose surrogate key as of the order's day comes
    along; an order has one customer, so orders are attached and not lines.
    Lines without an order (not ``ordered``) then stay too: they are no facts but
    count for the versions of parts.
    """
    of, more, how = orders_of_nations(spark, d), [], "inner"
    if customers is not None:
        of = joins.asof_attach(of, customers, "o_custkey", "dim_customer", "order_date", ["customer_surrogate_key"], gap_free=True, apart=True)
        more, how = ["customer_surrogate_key", F.col("o_orderkey").isNotNull().alias("ordered")], "left"
    return _stored(priced_lines(spark, d, of, how).select(*PRICED, F.to_date("l_shipdate").alias("l_shipdate"), *more), "priced_lines")


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return scd.with_surrogate(customer_dim(spark, d), "o_custkey", "customer_surrogate_key").withColumnRenamed("o_custkey", "dim_customer")


def _keyed_as_of(lines: DataFrame, dim: DataFrame, key: str, dim_key: str, name: str, columns: list[str], stored: bool = False) -> DataFrame:
    """Lines with the surrogate key, as ``name``, and ``columns`` of the version of their order date; the key is told where a version is found and not moved."""
    versions = dim.withColumnRenamed(dim_key, "_dim").withColumn("_version_from", F.col("valid_from"))
    lines = joins.asof_attach(lines, versions, key, "_dim", "order_date", ["_version_from", *columns], gap_free=True, apart=True, stored=stored, reach="reach" if "reach" in dim.columns else None)
    return lines.withColumn(name, F.when(F.col("_version_from").isNotNull(), keys.surrogate_key(key, "_version_from"))).drop("_version_from")


def _territories(spark: SparkSession, d: str, lines: DataFrame, reps: DataFrame | None = None) -> DataFrame:
    """Stored lines with the rep of B2B orders as of the order date, whose territory comes along, and the store's nation.  ``reps``: versions built before."""
    reps = rep_dim(spark, d, lines) if reps is None else reps
    lines = lines.withColumn("rep", F.when(F.col("channel") == "B2B", F.col("l_suppkey")))
    lines = _keyed_as_of(lines, reps, "rep", "l_suppkey", "rep_surrogate_key", ["rep_nation"], stored=True)
    if "s_nationkey" not in lines.columns:
        lines = joins.lookup_attach(lines, table(spark, d, "supplier"), "l_suppkey", "s_suppkey", ["s_nationkey"])
    territory = facts.territory_derive(
        F.col("channel"), {"STORE": F.col("s_nationkey").cast("string"), "B2B": F.col("rep_nation").cast("string"), "D2C": F.lit("ONLINE")}
    )
    return lines.withColumn("territory", territory)


def territory_derive(spark: SparkSession, d: str) -> DataFrame:
    return _territories(spark, d, stored_lines(spark, d)).groupBy("channel", "territory").agg(F.count(F.lit(1)).alias("rows"))


def date_key(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("o_orderkey", keys.date_key(F.col("order_date")).alias("date_id"))


def line_measures(spark: SparkSession, d: str) -> DataFrame:
    return measured_lines(spark, d).select("l_orderkey", "l_linenumber", "quantity", "gross_revenue", "discount_amount", "line_total", "tax_amount", "net_revenue")


def _fact_lines(spark: SparkSession, d: str) -> DataFrame:
    """The line fact."""
    silver = stored_lines(spark, d, _customers(spark, d))
    lines = _territories(spark, d, silver.where("ordered"))
    kept = ["l_orderkey", "l_linenumber", "l_partkey", "order_date", "channel", "territory", "category", "o_orderstatus", "customer_surrogate_key", "rep_surrogate_key", "quantity", "l_extendedprice", "l_discount"]
    lines = _keyed_as_of(lines.select(kept), product_dim(spark, d, silver), "l_partkey", "l_partkey", "product_surrogate_key", [])
    return measures(lines).select(
        "l_orderkey", "l_linenumber", keys.date_key(F.col("order_date")).alias("order_date_id"), "channel", "territory", "category",
        F.col("o_orderstatus").alias("status"), "customer_surrogate_key", "product_surrogate_key", "rep_surrogate_key",
        "quantity", "unit_price", "gross_revenue", "discount_amount", "tax_amount", "net_revenue",
    )


def _stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once, for builds that are read several times."""
    path = storage.scratch(df.sparkSession, tag)
    storage.write_and_clear(df, path)
    return df.sparkSession.read.parquet(path)


def stored_versions(dim: DataFrame, key: str, tag: str) -> DataFrame:
    """A gap-free dimension written once, with what ``_keyed_as_of`` needs to move it once."""
    return _stored(joins.reaching_back(dim, key), tag)


def _repeated(df: DataFrame, key: str) -> DataFrame:
    """The rows of keys that several rows have, as ``_key``: a left join with them alone repeats what one with all rows repeats."""
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return _stored(counts.select("_key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_nth")), "repeated")


def stored_key_lines(spark: SparkSession, d: str, customers: DataFrame) -> DataFrame:
    """What the foreign keys of the line fact and the dimensions of lines follow from, written once.

    ``customers``: ``stored_versions`` with their nation, attached to orders, which
    are fewer than lines.  Lines without an order (not ``ordered``) are no facts
    but count for the versions of parts.
    """
    of = orders(spark, d).select("o_orderkey", "o_custkey", "order_date", "channel", "o_orderstatus")
    of = _stored(_keyed_as_of(of, customers, "o_custkey", "o_custkey", "customer_surrogate_key", ["nation", "customer_known"]).drop("o_custkey"), "keyed_orders")
    lines = silver_lines(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("l_shipdate"), "l_returnflag")
    lines = lines.join(of.withColumn("ordered", F.lit(True)), F.col("l_orderkey") == F.col("o_orderkey"), "left").drop("l_orderkey", "o_orderkey")
    lines = lines.join(_repeated(table(spark, d, "part"), "p_partkey"), F.col("l_partkey") == F.col("_key"), "left").drop("_key", "_nth")
    return _stored(joins.lookup_attach(lines, table(spark, d, "supplier"), "l_suppkey", "s_suppkey", ["s_nationkey"]), "key_lines")


def fact_keys(spark: SparkSession, d: str, lines: DataFrame, reps: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    """The foreign keys of the line fact, of every one a DataFrame with a row per line: a line moves with what one key follows from, not with the whole fact.

    ``lines``: those of ``stored_key_lines``; ``reps``, ``products``: ``stored_versions``.
    """
    known = lines.where("ordered").select(
        keys.date_key(F.col("order_date")).alias("order_date_id"), "channel", F.col("o_orderstatus").alias("status"), "customer_surrogate_key"
    )
    parts = _keyed_as_of(lines.where("ordered").select("l_partkey", "order_date"), products, "l_partkey", "l_partkey", "product_surrogate_key", [])
    where = _territories(spark, d, lines.where("ordered").select("l_suppkey", "order_date", "channel", "s_nationkey"), reps)
    told = [known, _stored(parts.select("product_surrogate_key"), "product_keys"), _stored(where.select("rep_surrogate_key", "territory"), "rep_keys")]
    return {column: df for df in told for column in df.columns}


def fact_order_line(spark: SparkSession, d: str) -> DataFrame:
    """The full build, merged by line into a fact that holds the lines of the first years without quantities, and lines of orders that the load no longer has."""
    built = _stored(_fact_lines(spark, d), "fact_order_line")
    gone = built.where("order_date_id < 19960101").withColumn("l_orderkey", -F.col("l_orderkey") - 1)
    held = built.where("order_date_id < 19980101").withColumn("quantity", F.lit(0)).unionByName(gone)
    return merge.merge(held, built, ["l_orderkey", "l_linenumber"])


def merge_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Orders by month, of which a load of two months changes totals and moves some orders: the new rows of every month it touches."""
    held = orders(spark, d).select("o_orderkey", "o_totalprice", F.date_format("order_date", "yyyy-MM").alias("month"))
    load = held.where("month in ('1997-03', '1997-04')").select(
        "o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.when(F.col("o_totalprice") > 250_000, "1997-05").otherwise(F.col("month")).alias("month")
    )
    found = merge.merge_partitions(held, load, ["o_orderkey"], "month")
    return found.select("o_orderkey", "month", F.col("o_totalprice").cast("decimal(14,2)").alias("total"))


def _revenue(lines: DataFrame) -> DataFrame:
    """The rollup of lines with their territory; they are dealt by grain and order before their measures are told."""
    lines = measures(lines.select(*GRAIN, *TOLD).repartition(*GRAIN, "l_orderkey"))
    return facts.channel_revenue(lines, GRAIN, "l_orderkey", F.col("l_returnflag") == "R")


def channel_revenue(spark: SparkSession, d: str) -> DataFrame:
    return _revenue(_territories(spark, d, stored_lines(spark, d)))


#: What a later load of the rollup has.
LATER = "not (channel = 'STORE' and year(order_date) = 1997) and not (year(order_date) = 1999 and month(order_date) = 3)"


def rollup_replace(spark: SparkSession, d: str) -> DataFrame:
    """The rollup after a load that lacks a year's store lines and a whole month: the months it touches are built again, and grains and months without lines are gone."""
    lines = _stored(_territories(spark, d, stored_lines(spark, d)).select(*GRAIN, *TOLD), "territories").withColumn("month", F.date_format("order_date", "yyyy-MM"))
    path, month = storage.scratch(spark, "rollup"), F.date_format("order_date", "yyyy-MM")
    _revenue(lines).withColumn("month", month).repartition(8, "month").write.partitionBy("month").parquet(path)
    touched = [r[0] for r in lines.where(f"not ({LATER})").select("month").distinct().collect()]
    again = _revenue(lines.where(F.col("month").isin(touched)).where(LATER)).withColumn("month", month).repartition(8, "month")
    storage.replace_partitions(again, path, "month", touched)
    return spark.read.parquet(path).drop("month")


def asof_attach_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The same as ``asof_attach``, by sorting lines and versions together."""
    return joins.asof_attach_sorted(_dated(spark, d), _dim(spark, d), "customer", "o_custkey", "ship_date", ["priority", "valid_from"])


def upsert_null_safe(spark: SparkSession, d: str) -> DataFrame:
    """A grain with a nullable column merged twice keeps one row per grain."""
    grain = measured_lines(spark, d).withColumn("category", F.when(F.col("category") != "PROMO", F.col("category")))
    summed = grain.groupBy("channel", "category").agg(F.count(F.lit(1)).alias("rows"), F.sum("line_total").cast(facts.TOTAL).alias("total"))
    half = summed.where("channel <> 'STORE'").withColumn("rows", F.lit(0).cast("long"))
    once = merge.merge(half, summed, ["channel", "category"], null_safe=True)
    return merge.merge(once, summed, ["channel", "category"], null_safe=True)


def _rolled(spark: SparkSession, d: str) -> DataFrame:
    return facts.rolling_days(inventory(spark, d), ["user_id", "event_type"], "day", "units")


def rolling_7d(spark: SparkSession, d: str) -> DataFrame:
    return _rolled(spark, d).select("user_id", "event_type", "day", "rolling_days", F.round("rolling_avg", 6).alias("rolling_avg"))


def _with_stock(spark: SparkSession, d: str) -> DataFrame:
    rolled = facts.rolling_days(stock(spark, d), ["product", "store"], "day", "units")
    total = (F.col("rolling_avg") * F.col("rolling_days")).cast("decimal(14,0)")
    average = (total / F.col("rolling_days")).cast("decimal(14,6)")
    return rolled.withColumn("days_of_stock", facts.days_of_stock(F.col("stock"), average, F.col("rolling_days")))


def days_of_stock(spark: SparkSession, d: str) -> DataFrame:
    return _with_stock(spark, d).select("product", "store", "day", "days_of_stock")


def fact_inventory_daily(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot with the product's version as of its day, the store checked against the known ones, window measures and
    date key, merged null-safe by its composite key; stores 20 and above are not known."""
    products = scd.with_surrogate(stock_dim(spark, d), "product", "product_surrogate_key").withColumnRenamed("product", "dim_product")
    rows = joins.asof_attach(_with_stock(spark, d), products, "product", "dim_product", "day", ["product_surrogate_key"], gap_free=True, apart=True)
    rows = keys.fk_flag(rows, spark.range(20).withColumnRenamed("id", "known_store"), "store", "known_store", "store_known")
    built = _stored(
        rows.select(keys.date_key(F.col("day")).alias("date_id"), "product", "store", "product_surrogate_key", "store_known", "units", "stock", "days_of_stock"),
        "fact_inventory_daily",
    )
    gone = built.where("date_id < 20240104").withColumn("store", F.col("store") + 100)
    held = built.where("date_id < 20240110").withColumn("units", F.lit(0).cast("long")).unionByName(gone)
    return merge.merge(held, built, ["date_id", "product", "store"], null_safe=True)


def fact_summary(spark: SparkSession, d: str) -> DataFrame:
    return facts.fact_summary(measured_lines(spark, d), "channel")


def inventory_profile(spark: SparkSession, d: str) -> DataFrame:
    return facts.inventory_profile(_with_stock(spark, d), "day", "product", "store", "units", "days_of_stock")


def dense_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every user with every event type, and the events that the pair has."""
    events = table(spark, d, "events")
    grid = joins.dense_grid(events.select("user_id").distinct(), events.select("event_type").distinct())
    n = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("events"))
    return grid.join(n, ["user_id", "event_type"], "left").withColumn("events", F.coalesce("events", F.lit(0)))


QUERIES = {f.__name__: f for f in (line_order_join, asof_attach, asof_attach_sorted, rollup_replace, asof_attach_branch, asof_attach_overlapping, merge_partitions, lookup_attach, territory_derive, date_key, line_measures, fact_order_line, channel_revenue, upsert_null_safe, rolling_7d, days_of_stock, fact_inventory_daily, fact_summary, inventory_profile, dense_grid)}

DATED = """dated AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 10 <> 0 THEN o_custkey END AS customer, CAST(l_shipdate AS DATE) AS ship_date
  FROM m)"""


def _asof(source: str) -> str:
    return f"""floors AS (SELECT o_custkey, priority, valid_from FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY valid_from) AS rn FROM {source}) WHERE rn = 1)
      SELECT f.l_orderkey, f.l_linenumber, f.customer, f.ship_date,
      CASE WHEN v.o_custkey IS NOT NULL THEN v.priority ELSE w.priority END AS priority, CASE WHEN v.o_custkey IS NOT NULL THEN v.valid_from ELSE w.valid_from END AS valid_from
      FROM dated f LEFT JOIN {source} v ON f.customer = v.o_custkey AND f.ship_date BETWEEN v.valid_from AND coalesce(v.valid_to, DATE '9999-12-31')
      LEFT JOIN floors w ON f.customer = w.o_custkey"""


_DIM = DIM.partition("FROM orders), ")[2]  # the orders view is part of MEASURED
REPS = versions_sql("rdim", "l_suppkey", "rep_nation", "order_date", "(SELECT l_suppkey, order_date, c_nationkey AS rep_nation FROM m JOIN customer ON c_custkey = o_custkey)")
CUSTOMERS = versions_sql("cdim", "o_custkey", "o_orderpriority", "order_date", "ord")
PRODUCTS = versions_sql("pdim", "l_partkey", "l_returnflag", "CAST(l_shipdate AS DATE)", "lines")
TERR = f"""{REPS}, t AS (SELECT m.*, rdim.valid_from AS rep_from, CASE channel WHEN 'STORE' THEN CAST(s_nationkey AS VARCHAR) WHEN 'B2B' THEN CAST(rep_nation AS VARCHAR) WHEN 'D2C' THEN 'ONLINE' END AS territory
  FROM m LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN rdim ON channel = 'B2B' AND rdim.l_suppkey = m.l_suppkey AND order_date BETWEEN lo AND hi)"""
ROLLED = f"""{INVENTORY}, r AS (SELECT *, sum(units) OVER w AS total, count(*) OVER w AS rolling_days FROM inv
  WINDOW w AS (PARTITION BY user_id, event_type ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW))"""
STOCKED = f"""{STOCK}, r AS (SELECT *, sum(units) OVER w AS total, count(*) OVER w AS rolling_days FROM stk
  WINDOW w AS (PARTITION BY product, store ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)),
  k AS (SELECT *, CASE WHEN rolling_days >= 7 AND total > 0 THEN CAST(floor(stock / CAST(round(CAST(total AS DECIMAL(20,8)) / rolling_days, 6) AS DECIMAL(14,6))) AS INTEGER) END AS days_of_stock FROM r)"""
SUMS = "count(*) AS rows, sum(quantity) AS units, CAST(sum(line_total) AS DECIMAL(14,2)) AS total, CAST(sum(tax_amount) AS DECIMAL(14,2)) AS tax"

FACT = f"""WITH {MEASURED}, {TERR}, {CUSTOMERS}, {PRODUCTS}, fact AS (SELECT l_orderkey, l_linenumber, CAST(strftime(t.order_date, '%Y%m%d') AS INTEGER) AS order_date_id, channel, territory, category,
  o_orderstatus AS status, {key_sql('t.o_custkey', 'cdim.valid_from')} AS customer_surrogate_key, {key_sql('t.l_partkey', 'pdim.valid_from')} AS product_surrogate_key,
  {key_sql('t.l_suppkey', 'rep_from')} AS rep_surrogate_key, quantity, unit_price, gross_revenue, discount_amount, tax_amount, net_revenue
  FROM t LEFT JOIN cdim ON cdim.o_custkey = t.o_custkey AND t.order_date BETWEEN cdim.lo AND cdim.hi
  LEFT JOIN pdim ON pdim.l_partkey = t.l_partkey AND t.order_date BETWEEN pdim.lo AND pdim.hi)"""


def _revenue_sql(where: str) -> str:
    return f"""WITH {MEASURED}, {TERR}, g AS (SELECT order_date, channel, category, territory, count(DISTINCT l_orderkey) AS total_orders, count(*) AS total_lines, CAST(sum(quantity) AS BIGINT) AS total_units,
        CAST(sum(gross_revenue) AS DECIMAL(14,2)) AS gross_revenue, CAST(sum(discount_amount) AS DECIMAL(14,2)) AS total_discount,
        CAST(sum(line_total) AS DECIMAL(14,2)) AS net_revenue, CAST(sum(tax_amount) AS DECIMAL(14,2)) AS total_tax, count(*) FILTER (l_returnflag = 'R') AS returned_lines FROM t WHERE {where} GROUP BY 1, 2, 3, 4)
        SELECT *, CAST(floor((CAST(net_revenue * 100 AS HUGEINT) * 2 + total_orders) / (2 * total_orders)) / 100 AS DECIMAL(14,2)) AS avg_order_value,
        CAST(floor((returned_lines * 20000 + total_lines) // (2 * total_lines)) / 100 AS DECIMAL(5,2)) AS return_rate_pct FROM g"""


ORACLE_SQL = {
    "line_order_join": f"WITH {MEASURED} SELECT channel, count(*) AS rows FROM m WHERE o_orderstatus <> 'F' GROUP BY 1 UNION ALL SELECT 'none', count(*) FROM m WHERE o_orderstatus = 'F'",
    "asof_attach": f"WITH {MEASURED}, {_DIM}, {DATED}, gaps AS (SELECT * FROM dim WHERE priority <> '5-LOW'), {_asof('gaps')}",
    "asof_attach_sorted": f"WITH {MEASURED}, {_DIM}, {DATED}, gaps AS (SELECT * FROM dim WHERE priority <> '5-LOW'), {_asof('gaps')}",
    "asof_attach_branch": f"WITH {MEASURED}, {_DIM}, {DATED}, {_asof('dim')}",
    "lookup_attach": "SELECT s_suppkey, s_nationkey, n_name, n_regionkey FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey <> 2",
    "territory_derive": f"WITH {MEASURED}, {TERR} SELECT channel, territory, count(*) AS rows FROM t GROUP BY 1, 2",
    "date_key": "SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_id FROM orders",
    "line_measures": f"WITH {MEASURED} SELECT l_orderkey, l_linenumber, quantity, line_total, tax_amount, net_revenue, gross_revenue, discount_amount FROM m",
    "fact_order_line": f"{FACT} SELECT * FROM fact UNION ALL SELECT * REPLACE (-l_orderkey - 1 AS l_orderkey) FROM fact WHERE order_date_id < 19960101",
    "asof_attach_overlapping": f"""WITH {MEASURED}, {_DIM}, {DATED}, longer AS (SELECT o_custkey, priority, valid_from, CAST(valid_to + INTERVAL 10 DAY AS DATE) AS valid_to FROM dim),
        floors AS (SELECT o_custkey, min(valid_from) AS f FROM longer GROUP BY 1),
        hit AS (SELECT l_orderkey, l_linenumber, max(valid_from) AS f FROM dated JOIN longer ON customer = o_custkey AND ship_date BETWEEN valid_from AND coalesce(valid_to, DATE '9999-12-31') GROUP BY 1, 2)
        SELECT d.l_orderkey, d.l_linenumber, customer, ship_date, priority, valid_from FROM dated d LEFT JOIN hit ON hit.l_orderkey = d.l_orderkey AND hit.l_linenumber = d.l_linenumber
        LEFT JOIN floors ON floors.o_custkey = customer LEFT JOIN longer ON longer.o_custkey = customer AND valid_from = coalesce(hit.f, floors.f)""",
    "merge_partitions": """WITH h AS (SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m') AS month FROM orders),
        moved AS (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, CASE WHEN o_totalprice > 250000 THEN '1997-05' ELSE month END AS month FROM h WHERE month IN ('1997-03', '1997-04')),
        months AS (SELECT month FROM moved UNION SELECT month FROM h WHERE o_orderkey IN (SELECT o_orderkey FROM moved))
        SELECT o_orderkey, month, CAST(o_totalprice AS DECIMAL(14,2)) AS total FROM moved
        UNION ALL SELECT o_orderkey, month, CAST(o_totalprice AS DECIMAL(14,2)) FROM h WHERE month IN (SELECT month FROM months) AND o_orderkey NOT IN (SELECT o_orderkey FROM moved)""",
    "channel_revenue": _revenue_sql("TRUE"),
    "rollup_replace": _revenue_sql(LATER),
    "upsert_null_safe": f"""WITH {MEASURED} SELECT channel, nullif(category, 'PROMO') AS category, count(*) AS rows, CAST(sum(line_total) AS DECIMAL(14,2)) AS total FROM m GROUP BY 1, 2""",
    "rolling_7d": f"WITH {ROLLED} SELECT user_id, event_type, day, rolling_days, round(total / rolling_days, 6) AS rolling_avg FROM r",
    "days_of_stock": f"WITH {STOCKED} SELECT product, store, day, days_of_stock FROM k",
    "fact_inventory_daily": f"""WITH {STOCKED}, {STOCK_DIM}, fact AS (SELECT CAST(strftime(day, '%Y%m%d') AS INTEGER) AS date_id, k.product, store, {key_sql('k.product')} AS product_surrogate_key, store < 20 AS store_known,
        units, stock, days_of_stock FROM k LEFT JOIN sdim ON sdim.product = k.product AND day BETWEEN lo AND hi)
        SELECT * FROM fact UNION ALL SELECT * REPLACE (store + 100 AS store) FROM fact WHERE date_id < 20240104""",
    "fact_summary": f"WITH {MEASURED} SELECT channel, {SUMS} FROM m GROUP BY 1 UNION ALL SELECT 'ALL', {SUMS} FROM m",
    "inventory_profile": f"""WITH {STOCKED} SELECT day, count(*) AS rows, count(DISTINCT product) AS products, count(DISTINCT store) AS stores, CAST(sum(units) AS BIGINT) AS stock,
        count(*) FILTER (units = 0) AS stockouts, count(days_of_stock) AS with_derived FROM k GROUP BY 1""",
    "dense_grid": """SELECT user_id, event_type, count(event_id) AS events FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (SELECT DISTINCT event_type FROM events)
        LEFT JOIN events USING (user_id, event_type) GROUP BY 1, 2""",
}
