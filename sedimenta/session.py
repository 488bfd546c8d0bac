"""A local session for tests, benchmarks and examples; the package for executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": memory,
        "spark.sql.adaptive.enabled": "true",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName("sedimenta").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    settle(spark)
    return spark


def settle(spark: SparkSession) -> None:
    """Session settings that results rely on.

    Spark 4.1 keeps the partitioning of a union's inputs; with adaptive
    execution the inputs can end with different numbers of partitions, and the
    union then fails ("Can't zip RDDs").
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Settle the session, and send this package to the executors unless their Python path has it already."""
    settle(spark)
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = Path(tempfile.mkdtemp(prefix="spark-")) / "sedimenta.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.glob("sedimenta/**/*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
