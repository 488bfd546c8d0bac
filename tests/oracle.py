"""Rows of Spark and of DuckDB in one form."""

from pathlib import Path

SF = "/root/testdata/sf0.001"


def plain(value):
    """A value in a form that Spark's and DuckDB's results share."""
    import datetime
    import decimal

    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime) and value.time() == datetime.time(0):
        return str(value.date())
    return str(value)


def oracle_rows(sql, folder=SF):
    import duckdb

    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = c.sql(sql)
    columns = sorted(found.columns)
    at = [found.columns.index(x) for x in columns]
    return columns, sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
