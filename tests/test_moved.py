"""What is shuffled: rows that a step need not move stay where they are."""

import pytest
from pyspark.sql import functions as F

from sedimenta.operators import checks, joins, merge


@pytest.fixture
def moved(spark):
    """Bytes that a DataFrame's run shuffles, without broadcasts."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def written():
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    def run(df):
        before = written()
        df.write.format("noop").mode("overwrite").save()
        return written() - before

    yield run
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def wide(spark, n):
    """Rows with a kilobyte each that does not compress."""
    return spark.range(n).select("id", F.concat(*[F.sha2(F.concat_ws("/", "id", F.lit(i)), 512) for i in range(16)]).alias("payload"))


def test_merge_moves_the_target_and_keys_only(spark, moved, tmp_path):
    wide(spark, 3000).write.parquet(f"{tmp_path}/source")
    source = spark.read.parquet(f"{tmp_path}/source")
    target = source.where("id < 300").withColumn("payload", F.lit("old")).unionByName(source.where("id = 0").withColumn("id", F.lit(-1).cast("long")))
    merged = merge.merge(target, source, ["id"])
    assert moved(merged) < 500_000
    assert merged.count() == 3001 and merged.where("payload = 'old'").count() == 0
    with pytest.raises(Exception, match="duplicate merge key"):
        merge.merge(target.limit(0), source.unionByName(source.limit(1)), ["id"]).collect()


def test_foreign_keys_move_counts_only(spark, moved):
    fact = wide(spark, 20_000).select((F.col("id") % 50).alias("a"), (F.col("id") % 20).alias("b"), F.lit("x").alias("c"))
    keys = [(n, n, spark.range(10), "id", True) for n in ("a", "b")]
    assert moved(checks.fk_card(fact, keys)) < 50_000


def test_stored_facts_without_a_key_stay(spark, moved):
    facts = wide(spark, 3000).select(F.when(F.col("id") < 300, F.col("id")).alias("key"), "payload", F.lit("2024-01-05").cast("date").alias("day"))
    dim = spark.range(300).select(F.col("id").alias("k"), F.lit("2024-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(1).alias("v"))
    found = joins.asof_attach(facts, dim, "key", "k", "day", ["v"], gap_free=True, apart=True, stored=True)
    assert moved(found) < 900_000
    assert found.count() == 3000 and found.where("v = 1").count() == 300
