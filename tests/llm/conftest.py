import pytest
from pyspark.sql import functions as F

LONG = "the quick brown fox jumps over " * 20_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns with clashing names."""
    near = " ".join(f"word{i}" for i in range(200))
    rows = [
        (1, "Same text here.", "en", "a"),
        (2, "Same  text\there.", "en", "a"),
        (2, "Same  text\there.", "en", "a"),
        (3, None, None, None),
        (4, "", "en", "a"),
        (5, " \n\t ", "en", "a"),
        (6, LONG, "en", "a"),
        (7, LONG + "tail", None, "b"),
        (8, near, "de", "b"),
        (9, near.replace("word100 ", "other "), "de", "b"),
        (10, "12345 67890 ---", "de", None),
        (None, "a text without an id", "fr", "c"),
        (None, "another text that has no id, and nothing else that tells it from the first", "en", None),
        (None, None, "fr", "c"),
        (11, "Überall 東京 naïve «été» \x1c\x00 end", "fr", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = {c: F.lit(7) for c in ("n", "range", "run", "bucket", "label", "seg", "shard", "piece", "anchor", "spans", "score", "html", "packed", "kept", "text_sha256", "_id", "row", "id", "sha", "copies", "doc", "window", "word")}
    return df.withColumns(extra).withColumn("n_chars", F.char_length("text"))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
