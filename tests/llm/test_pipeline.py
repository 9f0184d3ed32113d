"""The corpus pipeline's stages in order, each held against brute force on its own input."""

from __future__ import annotations

import os
import re
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_llm import CLASH, WORD, corpus, lower, shingles

SMALL = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SMALL.exists(), reason="no test data here")
def test_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, held = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(SMALL)).persist()
        held[name] = docs
        if k < 4:
            assert docs.columns == columns
    texts = {name: [(r.doc_id, r.text) for r in held[name].select("doc_id", "text").collect()] for name, _ in corpus_pipeline.STAGES[:4]}
    bad = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 0").collect()}
    rejected = {r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect()} - {i for i, _ in texts["quality classifier"]}
    assert len(bad & rejected) >= 0.8 * len(bad)
    groups = defaultdict(list)
    for i, t in texts["quality classifier"]:
        groups[lower(t)].append(i)
    assert sorted(i for i, _ in texts["exact dedup"]) == sorted(max(g) for g in groups.values())
    sets = {i: shingles(t) for i, t in texts["exact dedup"]}
    kept = {i for i, _ in texts["n-gram Jaccard join"]}
    alike = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    ids = sorted(kept)
    assert not any(alike(sets[a], sets[b]) for n, a in enumerate(ids) for b in ids[:n])
    assert all(any(alike(sets[i], sets[j]) for j in sets if j != i) for i in set(sets) - kept)
    times = Counter(i for i, _ in texts["mixing"])
    assert set(times) <= kept and max(times.values()) == 2
    packed = held["packing"].toPandas()
    assert Counter(packed[packed.piece == 0].doc_id) == times
    assert (packed.groupby("sequence_id").length.sum() <= 2048).all()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empty and long texts, repeated rows and identifiers, columns with clashing names; labels that know none of these."""
    folder = tmp_path_factory.mktemp("odd")
    plain = spark.createDataFrame(corpus() + [(1, "one text of several words under an identifier", "a", "en"), (1, "another text that has the same identifier as it", "b", "en")], "doc_id long, text string, source string, lang string")
    plain.withColumns({c: F.lit("clash") for c in CLASH}).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(10**6, 1, 0), (None, 0, 0), (10**6 + 1, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_on_odd_rows(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns, texts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, odd).persist()
        if name != "packing":
            assert docs.columns == columns and docs.where("rank != 'clash' or _row != 'clash'").count() == 0
            texts.append([(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()])
    good, exact, near, mixed = texts
    assert len(good) == len(corpus()) + 2  # nothing is known, so nothing is rejected
    assert Counter(lower(t) for _, t, _ in exact) == Counter({lower(t) for _, t, _ in good})
    sets = [shingles(t) for _, t, _ in near]
    assert not any(a and b and 100 * len(a & b) >= 80 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    assert all(s or not WORD.search(t or "") for s, (_, t, _) in zip(sets, near)) and len([t for _, t, _ in near if not WORD.search(t or "")]) == len([t for _, t, _ in exact if not WORD.search(t or "")])
    kept = Counter(near)
    assert set(mixed) <= set(kept) and all(n <= 2 * kept[r] for r, n in Counter(mixed).items())
    packed = docs.toPandas()
    assert (packed.piece == 0).sum() == len(mixed) and (packed.groupby("sequence_id").length.sum() <= 2048).all()


def test_stages_on_empty_tables(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, odd)
        assert docs.count() == 0


def test_run_equals_its_stages(spark, odd):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, odd)
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, odd)
    places = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, rows.select(*places).collect())) == Counter(map(tuple, docs.select(*places).collect()))


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_idle_workers_hold_no_garbage(spark):
    """After a stage a Python worker waits for the next one, beside the JVM: what its task took must be given back."""
    from stridelake.llm import gam, ngram_join, packing

    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 250), i -> conv((id * 37 + i * i) % 40000, 10, 36)))").alias("text")).coalesce(1).persist()
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    held = {}

    def look(stream):
        for _ in stream:
            pass
        own = re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "mb": [int(own) // 1024]})

    def idle():
        return max(r.mb for r in spark.range(0, 4, 1, 4).mapInArrow(look, "pid long, mb long").collect())

    before = idle()
    for name, df in (("classifier", gam.scored(docs, gam.train(docs, labels))), ("sets", ngram_join._sets(docs, "doc_id", "text", "doc_id n s tokens")), ("pieces", packing.pieces(docs))):
        df.write.format("noop").mode("overwrite").save()
        held[name] = idle() - before
    docs.unpersist()
    assert max(held.values()) < 100, held
