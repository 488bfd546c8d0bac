"""Tables as Parquet folders: scratch space, versioned publishing, idempotent and guarded writes."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class EmptyInput(ValueError):
    """The upstream data for a run is empty."""


class PartitionExists(ValueError):
    """The partition already has rows and ``force`` was not given."""


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """The names directly in a folder, without looking further down."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return sorted(s.getPath().getName() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p))


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


#: Spark's setting by which a run's shuffle files go as soon as it has ended.
CLEAR = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_and_clear(df: DataFrame, path: str) -> None:
    """Write ``df``; its shuffle files, which nothing reads again, are removed when it is written, not when the driver collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAR, None)
    conf.set(CLEAR, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEAR) if before is None else conf.set(CLEAR, before)


def partition_replace(df: DataFrame, path: str, partition: str) -> None:
    """Replace the partitions that ``df`` holds and leave the others: a repeated load changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def snapshot_overwrite(df: DataFrame, path: str) -> None:
    """Replace the whole table, schema included."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def write_observed(df: DataFrame, path: str, mode: str = "overwrite", partition: str | None = None, **metrics: Column) -> dict[str, object]:
    """Write ``df`` and return what is observed on the way, ``rows`` and the given aggregates, in the one pass of the write.

    With a ``partition`` only the partitions that ``df`` holds are replaced.
    """
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(n) for n, m in metrics.items()])
    writer = rows.write.mode(mode)
    if partition:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition)
    writer.parquet(path)
    return seen.get


def replace_partitions(df: DataFrame, path: str, partition: str, affected: list[str]) -> None:
    """Replace the ``affected`` partitions of a table by their rows in ``df``; one of which no row is left is removed.

    ``df`` is evaluated once: the partitions that get rows are told while they
    are written.  Partitions that are not affected are neither read nor written.
    """
    spark = df.sparkSession
    value = F.col(partition).cast("string")
    written = write_observed(df.where(value.isin(affected)), path, partition=partition, held=F.collect_set(value))["held"]
    gone = set(affected) - set(written or [])
    jvm = spark.sparkContext._jvm
    for name in folder_names(spark, path):
        if name.startswith(f"{partition}=") and unquote(name.partition("=")[2]) in gone:
            old = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def guarded_write(df: DataFrame, path: str, partition: str, value: str, force: bool = False) -> int:
    """Write one partition once.

    Refuses if it already has rows, unless ``force``; refuses empty input, of
    which nothing is written.  ``df`` is evaluated once: its rows are counted
    while they are written, and compared with what the table then has (told by
    its files' footers).  Returns that number.
    """
    spark = df.sparkSession
    there = read_if_exists(spark, path)
    if there is not None and not force and not there.where(F.col(partition) == value).isEmpty():
        raise PartitionExists(f"{partition}={value}")
    expected = write_observed(df.where(F.col(partition) == value), path, partition=partition)["rows"]
    if not expected:
        raise EmptyInput(f"{partition}={value}")
    written = spark.read.parquet(path).where(F.col(partition) == value).count()
    if written != expected:
        raise RuntimeError(f"{partition}={value}: {written} rows written, {expected} expected")
    return written


def publish(df: DataFrame, root: str) -> int:
    """Write ``df`` as the table's next version and move the pointer to it.

    Readers resolve the pointer, so a table can be rewritten from itself and an
    older version read again.  Returns the version.
    """
    spark = df.sparkSession
    version = current_version(spark, root) + 1
    df.write.mode("overwrite").parquet(f"{root}/v={version}")
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return version


def current_version(spark: SparkSession, root: str) -> int:
    pointer = read_if_exists(spark, f"{root}/pointer")
    return -1 if pointer is None else pointer.agg(F.max("version")).first()[0]


def published(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{root}/v={current_version(spark, root) if version is None else version}")


def source_file() -> Column:
    return F.col("_metadata.file_path")
