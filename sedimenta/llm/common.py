"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests,
    notebooks) a temporary folder is made and set as the session's checkpoint
    folder; on a cluster that raises, since executors do not share such folders.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new shared folder as a plain path, for files that tasks map into memory.

    The shared folder must be mounted on every machine (``file:`` scheme).
    """
    path = new_path(spark, tag)
    if "://" in path or path.startswith("file:"):
        scheme, _, rest = path.partition(":")
        if scheme != "file":
            raise ValueError(f"memory-mapped files need a mounted shared folder, not {path}")
        path = "/" + rest.lstrip("/")
    os.makedirs(path)
    return path


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    settle(spark)
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(col: str, n: int) -> Column:
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def whole_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with each row's columns as its ``doc_id``, so that what is found for a row comes back with it."""
    return docs.select(F.struct(*docs.columns).alias("doc_id"), "text")


def text_digest(text: Column) -> Column:
    """60 bits of SHA-256, to tell texts of one id apart; a null text counts as empty."""
    return F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 15), 16, 10).cast("long")


def with_id(docs: DataFrame, columns: str) -> StructType:
    """A schema of the ``doc_id`` of ``docs`` and more columns."""
    return StructType([docs.schema["doc_id"], *StructType.fromDDL(columns).fields])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bound of an Arrow batch; one value for all operators.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, whatever the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
