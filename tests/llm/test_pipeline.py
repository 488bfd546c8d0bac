"""The pipeline's stages on odd rows, empty tables and the smallest test tables."""

import math
import os
import re
from collections import Counter

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import classes_by_hand

from sedimenta.llm import packing


def test_stages_keep_columns_and_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    total, columns = docs.count(), docs.columns
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[0] == total and kept[-1] > 0.8 * total
    assert docs.groupBy(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")).count().where("count > 1").count() == 0


def test_run_packs_what_is_kept(spark, sf):
    found = corpus_pipeline.run(spark, sf)
    sums = found.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert sums.where("n > 4096").count() == 0 and found.count() > 0


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, sf, odd, none, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    assert run(spark, none, sf).count() == 0
    assert run(spark, odd.limit(0), sf).count() == 0
    found = run(spark, odd, sf)
    rows = Counter((str(r.doc_id), r.text) for r in odd.collect())
    if stage == "packing":
        assert Counter(str(r.doc_id) for r in found.where("piece = 0").collect()) == Counter(k for k, _ in rows.elements())
        return
    assert found.columns == odd.columns and found.where("kept <> 7 or text_sha256 <> 7 or _id <> 7 or n <> 7").count() == 0
    gone = {"language": {"3", "4", "5", "10"}, "exact_dedup": {"2", "4"}, "near_dedup": {"2", "7", "9"}}.get(stage, set())
    expected = Counter({k: n for k, n in rows.items() if k[0] not in gone and not (k == ("None", None) and stage in ("language", "exact_dedup"))})
    assert Counter((str(r.doc_id), r.text) for r in found.collect()) == expected


def test_rows_that_share_an_id_are_judged_one_by_one(spark, sf, none):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 200").first().text
    clear = {r.lang: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and n_chars > 300").collect()}
    one, two = [clear[k] for k in sorted(clear)[:2]]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(none.columns)
    rows = lambda bad: spark.createDataFrame([(i, t, "en", s, len(t)) for i in (None, -7) for t, s in ((bad, "bad"), (one, "one"), (two, "two"))], none.schema)
    stages = dict(corpus_pipeline.STAGES)
    for stage, bad in (("language", "12345 67890 ---"), ("decontamination", item)):
        given = rows(bad).unionByName(docs) if stage == "language" else rows(bad)
        found = stages[stage](spark, given, sf).where("doc_id is null or doc_id = -7")
        assert sorted((str(r.doc_id), r.source, r.text) for r in found.collect()) == sorted((i, s, t) for i in ("None", "-7") for t, s in ((one, "one"), (two, "two")))


def test_stages_against_brute_force(spark, sf):
    """What each stage after the language keeps, told in plain Python from what its predecessor kept, and the packing of the rest."""
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{sf}/documents.parquet")
    kept = lambda name, docs: {r.doc_id: r.text or "" for r in stages[name](spark, docs, sf).collect()}
    given = lambda texts: docs.where(F.col("doc_id").isin(list(texts)))

    texts = kept("language", docs)
    groups = {}
    for k, t in texts.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t), []).append(k)
    want = {min(g) for g in groups.values()}
    found = kept("exact_dedup", given(texts))
    assert set(found) == want

    texts, classes = found, classes_by_hand(found)
    found = kept("near_dedup", given(texts))
    assert set(found) == {k for k, c in classes.items() if k == c}

    words = lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text or "")
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    sizes, clean = {len(w) for w in windows}, set()
    for k, t in found.items():
        w, hit = words(t), set()
        for n in sizes:
            hit |= {j for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
        if not hit or 20 * len(hit) < len(w):
            clean.add(k)
    texts, found = found, kept("decontamination", given(found))
    assert set(found) == clean

    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == clean
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 4096 and [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:i]) for i in range(len(x))] for x in by.values())
    assert len(by) <= math.ceil(sum(r.length for r in rows) / 4096) + 1


def test_packing_leaves_nothing_in_workers(spark, sf):
    """Spark keeps a worker for later stages; what packing held would count against their memory."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert packing.pieces(docs, packing.tokenizer_path()).count() >= docs.count()

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "held": [sum(len(x) for t in packing._tokenizers.values() for x in t[2:]) + len(packing._tokenizers)]})

    found = docs.repartition(3).mapInArrow(held, "pid long, held long").collect()
    assert found and {r.held for r in found} == {0}


def test_packing_encodes_a_bounded_slice_at_once():
    texts = ["ab" * n for n in (0, 3, 50, 1, 200, 0)]
    found = list(packing.slices(iter(texts), 100))
    assert sum(found, []) == texts and [len(x) for x in found] == [3, 2, 1]
    assert list(packing.slices(iter([]), 100)) == []
