"""The foreign keys of the line fact, told column by column: the same counts as SQL on odd tables, with fewer bytes moved and kept."""

import time

import duckdb
import pytest
from oracle import SF, oracle_rows, spark_rows
from pyspark.sql import functions as F

from sedimenta.operators import checks
from sedimenta.plans import bindings
from sedimenta.sources import storage


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Lines of orders, parts and suppliers that are missing, and parts, suppliers, orders and customers that are listed twice."""
    d, c = str(tmp_path_factory.mktemp("odd")), duckdb.connect()
    twice = "SELECT * FROM t UNION ALL SELECT * FROM t WHERE {0} % 5 = 1"
    tables = {
        "lineitem": "SELECT * FROM t",
        "orders": f"SELECT * FROM ({twice}) WHERE {{0}} % 3 <> 2".format("o_orderkey"),
        "part": f"SELECT * FROM ({twice} UNION ALL SELECT * FROM t WHERE {{0}} % 10 = 1) WHERE {{0}} % 4 <> 3".format("p_partkey"),
        "supplier": f"SELECT * FROM ({twice}) WHERE {{0}} % 4 <> 3".format("s_suppkey"),
        "customer": f"SELECT * FROM ({twice}) WHERE {{0}} % 4 <> 3".format("c_custkey"),
        "nation": "SELECT * FROM t",
        "events": "SELECT * FROM t",
    }
    for name, sql in tables.items():
        c.execute(f"COPY (WITH t AS (SELECT * FROM '{SF}/{name}.parquet') {sql}) TO '{d}/{name}.parquet' (FORMAT parquet)")
    return d


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_counts_are_those_of_sql_on_odd_tables(spark, odd, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = spark_rows(bindings.QUERIES["fact_fk_card"](spark, odd))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == oracle_rows(bindings.ORACLE_SQL["fact_fk_card"], odd)


def test_line_fact_takes_versions_from_lines_without_an_order(spark, tmp_path):
    for name in ("lineitem", "orders", "part", "supplier", "customer"):
        where = "WHERE o_orderkey % 3 <> 2" if name == "orders" else ""
        duckdb.connect().execute(f"COPY (SELECT * FROM '{SF}/{name}.parquet' {where}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    assert spark_rows(bindings.QUERIES["fact_order_line"](spark, str(tmp_path))) == oracle_rows(bindings.ORACLE_SQL["fact_order_line"], tmp_path)


def test_lines_move_narrow(spark):
    """Every line once as it is and then with what one key follows from, also where no table is broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    executors = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False)
    written = lambda: sum(x.apply(i).totalShuffleWrite() for x in [executors()] for i in range(x.size()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        began = written()
        assert bindings.QUERIES["fact_fk_card"](spark, SF.replace("0.001", "0.01")).count() == 10
        moved = written() - began
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moved < 13_000_000


def shuffled_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum(blocks.apply(i).toString().startswith("shuffle_") for i in range(blocks.size()))


def test_a_stored_step_leaves_no_shuffle_files(spark, tmp_path):
    before = shuffled_files(spark)
    rows = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    storage.write_and_clear(rows, f"{tmp_path}/rows")
    until = time.time() + 20
    while shuffled_files(spark) > before and time.time() < until:
        time.sleep(0.2)
    assert shuffled_files(spark) <= before
    assert spark.conf.get(storage.CLEAR) == "false"
    assert spark.read.parquet(f"{tmp_path}/rows").agg(F.sum("n")).first()[0] == 1000
    assert rows.count() == 100


def test_foreign_keys_of_columns_of_their_own(spark):
    columns = {"a": spark.sql("select explode(array(1, 1, 2, null, 9)) as a"), "b": spark.sql("select explode(array('x', 'x', 'z', null, null)) as b")}
    dims = spark.sql("select explode(array(1, 2, 2, 7, null)) as id"), spark.sql("select explode(array('x', 'y', null)) as id")
    found = checks.fk_card(columns, [("a", "a", dims[0], "id", True), ("b", "b", dims[1], "id", False), ("c", "b", dims[1].limit(0), "id", True)])
    assert {(r.check, r.rows, r.nulls, r.orphans) for r in found.collect()} == {("a", 5, 1, 2), ("b", 5, 2, 1), ("c", 5, 2, 5)}
