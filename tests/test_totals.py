"""Totals beyond twelve digits: prices large enough that a few lines exceed decimal(14,2)."""

import datetime as dt
from decimal import Decimal

import pytest

from sedimenta.plans import bindings

TOTAL = Decimal("1800000000000.00")


@pytest.fixture(scope="module")
def dear(spark, tmp_path_factory):
    """Four lines of one order of 450 thousand million each."""
    d, day = str(tmp_path_factory.mktemp("dear")), dt.datetime(1997, 3, 1)
    lines = [(1, 1, 1, n, 50.0, 9e9, 0.0, 0.0, "R", "O", day) for n in range(4)]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
        "orders": ([(1, 1, "O", 1.0, day, "3-MEDIUM")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "part": ([(1, "PROMO")], "p_partkey long, p_type string"),
        "customer": ([(1, 3)], "c_custkey long, c_nationkey int"),
        "supplier": ([(1, 4)], "s_suppkey long, s_nationkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def test_fact_summary(spark, dear):
    assert {(r.channel, r.rows, r.total) for r in bindings.QUERIES["fact_summary"](spark, dear).collect()} == {("STORE", 4, TOTAL), ("ALL", 4, TOTAL)}


def test_channel_revenue(spark, dear):
    (r,) = bindings.QUERIES["channel_revenue"](spark, dear).collect()
    assert (r.total_orders, r.total_lines, r.net_revenue, r.avg_order_value) == (1, 4, TOTAL, TOTAL)


def test_upsert_null_safe(spark, dear):
    (r,) = bindings.QUERIES["upsert_null_safe"](spark, dear).collect()
    assert (r.channel, r.category, r.rows, r.total) == ("STORE", None, 4, TOTAL)
