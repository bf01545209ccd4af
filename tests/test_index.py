"""The stored index: replaced texts, small segments, interrupted and repeated refreshes, compaction; and dense search by bounds."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions.vectors import hash_embedder
from foliant.operators import dense
from foliant.operators import index as tables
from foliant.operators.dense import dense_topk, pruning_report
from foliant.operators.embed import embed
from foliant.operators.retrieve import hybrid_search
from foliant.plans import search_index as index
from foliant.plans.ingest import passages
from foliant.session import staged

MODEL = hash_embedder()
TEXT = "The {} pump has a warranty of {} years, and spare parts are kept for as long."


def library(spark, texts):
    return passages(spark.createDataFrame([(o, d, f"d{d}", t) for (o, d), t in texts.items()], "org string, document_id long, document string, text string"), MODEL)


def ask(spark, *rows):
    return embed(spark.createDataFrame([(i, o, q) for i, (o, q) in enumerate(rows)], "qid long, org string, query string"), MODEL, "query", "qvec")


def found(df):
    return sorted((r.qid, r.pos, r.org, r.document_id, r.content, round(r.score, 6)) for r in df.collect())


def test_refreshes_write_what_changed(spark, tmp_path):
    path = str(tmp_path / "index")
    texts = {(o, d): TEXT.format(f"red{d}", f"{o}two") for o in ("a", "b") for d in range(6)}
    questions = ask(spark, ("a", "how long is the warranty of the red3 pump"), ("b", "spare parts of the blue pump"), ("c", "warranty"))

    def same_as_a_search_without_index():
        got = found(index.indexed_search(spark, path, questions, MODEL))
        assert got == found(hybrid_search(library(spark, texts).cache(), questions, MODEL.name))
        return [c for *_, c, _ in got]

    def refresh(version):
        return sorted((r.org, r.action) for r in index.refresh(path, library(spark, texts), MODEL, version).collect())

    written = lambda version: {(r.org, r.document_id) for r in index.store(spark, path).written("texts", version).collect()}
    assert refresh(1) == [("a", "build"), ("b", "build")] and written(1) == set(texts)
    same_as_a_search_without_index()
    texts["a", 3] = TEXT.format("red3", "nine")  # the same ids, the same number of passages
    assert refresh(2) == [("a", "rebuild")] and written(2) == {("a", 3)}
    assert any("nine" in c for c in same_as_a_search_without_index())
    assert refresh(2) == [("a", "rebuild")]  # a committed version is not written again
    assert refresh(3) == [] and written(3) == set()
    del texts["b", 1]
    texts["b", 9], texts["c", 1] = TEXT.format("blue", "three"), TEXT.format("green", "one")
    assert refresh(4) == [("b", "rebuild"), ("c", "build")] and written(4) == {("b", 9), ("c", 1)}
    same_as_a_search_without_index()
    for d in range(6):
        del texts["a", d]
    assert refresh(5) == [("a", "drop")] and written(5) == set()
    same_as_a_search_without_index()
    before = found(index.indexed_search(spark, path, questions, MODEL))
    assert index.compact(spark, path, 6) and index.store(spark, path).versions() == [6]
    assert found(index.indexed_search(spark, path, questions, MODEL)) == before
    texts["b", 9] = TEXT.format("blue", "eight")
    assert refresh(7) == [("b", "rebuild")] and written(7) == {("b", 9)}
    same_as_a_search_without_index()


def test_an_interrupted_refresh_is_not_seen(spark, tmp_path):
    path, texts = str(tmp_path / "index"), {("a", 1): TEXT.format("red", "two")}
    index.refresh(path, library(spark, texts), MODEL, 1)
    texts["a", 1] = TEXT.format("red", "nine")
    with pytest.raises(Exception):  # the texts' table fails after entries, tombstones and vectors are written
        index.refresh(path, library(spark, texts).withColumn("content", F.when(F.col("ordinal") >= 0, F.raise_error(F.lit("lost")).cast("string"))), MODEL, 2)
    questions = ask(spark, ("a", "warranty of the red pump"))
    assert "two" in found(index.indexed_search(spark, path, questions, MODEL))[0][4]
    index.refresh(path, library(spark, texts), MODEL, 2)
    assert "nine" in found(index.indexed_search(spark, path, questions, MODEL))[0][4]


def test_another_model_rebuilds_all(spark, tmp_path):
    path, texts = str(tmp_path / "index"), {("a", d): TEXT.format(d, "two") for d in range(3)}
    index.refresh(path, library(spark, texts), MODEL, 1)
    other = hash_embedder(64)
    chunks = embed(library(spark, texts).drop("embedding"), other)
    assert [r.action for r in index.refresh(path, chunks, other, 2).collect()] == ["rebuild"]
    assert {len(r.embedding) for r in index.store(spark, path).read("vectors").collect()} == {64}


def clustered(rng, many, dim, spread):
    x = rng.normal(size=(many, dim)) * spread + np.eye(dim)[rng.integers(0, dim, many)]
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("spread, some_left_out", [(0.02, True), (1.0, False)])
def test_bounds_change_no_result(spark, spread, some_left_out):
    rng = np.random.default_rng(3)
    x, q = clustered(rng, 3000, 12, spread), clustered(rng, 7, 12, spread)
    x[10] = 0  # a vector of length zero
    vectors = spark.createDataFrame([("a" if i % 3 else "b", i, i // 4, [float(v) for v in r]) for i, r in enumerate(x)], "org string, chunk_id long, document_id long, embedding array<float>").repartition(2)
    wanted = {i: [5, 10, 2000 + i, 99_999] for i in range(7)}
    asked = spark.createDataFrame([(i, "a" if i % 2 else "b", [float(v) for v in r], wanted[i] if i else None) for i, r in enumerate(q)], "qid long, org string, qvec array<float>, wanted array<long>")
    got = {(r.qid, r.chunk_id): (r.document_id, r.sim, r.dense_rank) for r in dense_topk(vectors, asked, 5, block=32).collect()}
    want = {}
    for i in range(7):
        own = [c for c in range(3000) if ("a" if c % 3 else "b") == ("a" if i % 2 else "b")]
        sims = {c: round(float(x[c].astype(float) @ q[i].astype(float)), 6) for c in own}
        ranks = {c: n + 1 for n, c in enumerate(sorted(own, key=lambda c: (-sims[c], c))[:5])}
        want |= {(i, c): (c // 4, pytest.approx(sims[c], abs=2e-6), ranks.get(c)) for c in {*ranks, *(wanted[i] if i else [])} & set(own)}
    assert got == want
    plain = dense_topk(vectors.drop("document_id"), asked.drop("wanted"), 5, block=32).collect()
    assert {(r.qid, r.chunk_id): r.dense_rank for r in plain} == {k: r for k, (_, _, r) in want.items() if r is not None}
    report = pruning_report(vectors, asked, 5, block=32).first()
    assert report.met > 0 and (report.left_out > report.met // 3) == some_left_out


def test_texts_and_vectors_stay_where_they_are(spark, tmp_path):
    """Only ids and scores go through exchanges when hits are looked up."""
    path = str(tmp_path / "index")
    index.refresh(path, library(spark, {("a", d): TEXT.format(d, "two") for d in range(4)}), MODEL, 1)
    plan = index.indexed_search(spark, path, ask(spark, ("a", "warranty of the pump")), MODEL)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" in plan
    physical = index.indexed_search(spark, path, ask(spark, ("a", "warranty of the pump")), MODEL)._jdf.queryExecution().executedPlan().toString()
    texts = next(line for line in physical.splitlines() if "FileScan" in line and "content" in line)
    above = physical.splitlines()[:physical.splitlines().index(texts)]
    assert any("BroadcastHashJoin" in line for line in above) and not any(" Exchange hash" in line for line in above)


def test_a_refresh_keeps_no_second_copy_of_passages(spark, tmp_path, monkeypatch):
    kept, write = {}, index.staged
    monkeypatch.setattr(index, "staged", lambda df, name: (kept.update({name: set(df.columns)}), write(df, name))[1])
    path, texts = str(tmp_path / "index"), {("a", d): TEXT.format(d, "two") for d in range(3)}
    for version in (1, 2):
        index.refresh(path, library(spark, texts), MODEL, version)
        texts["a", 1], texts["b", 1] = TEXT.format(1, "nine"), TEXT.format(1, "one")
    assert kept and not any(columns & {"content", "embedding"} for columns in kept.values())


def test_postings_are_the_same_by_slices(spark, tmp_path, monkeypatch):
    rows = [("a" if i % 3 else "b", i, i // 2, f"red pump {i % 4} " * (i % 3)) for i in range(40)] + [("a", 7, 3, "red valve"), ("a", 7, 3, "red valve"), ("b", 9, 5, "blue"), ("a", None, 4, "green")]
    columns, folder = "org string, chunk_id long, document_id long, content string", str(tmp_path / "texts")
    spark.createDataFrame(rows, columns).repartition(5).write.parquet(folder)
    texts = spark.read.schema(columns).parquet(folder)
    want = tables.postings(texts).join(texts.select("org", "chunk_id", "document_id"), ["org", "chunk_id"]).withColumn("bucket", index.bucket_of(F.col("org"), F.col("term"), 4))
    shape = lambda parts: sorted(map(tuple, (r for p in parts for r in p.select(*index.POSTING).collect())))
    whole = list(index._posted(texts, spark, folder, 4))
    monkeypatch.setattr(index, "SLICE_BYTES", 1)
    slices = list(index._posted(texts, spark, folder, 4))
    assert len(whole) == 2 and len(slices) == 6 and shape(whole) == shape(slices) == shape([want])


def test_questions_go_to_the_blocks(spark, monkeypatch):
    """No block of passages goes through a shuffle while the questions are few; beyond that the results are the same."""
    rng = np.random.default_rng(4)
    x, q = clustered(rng, 600, 8, 0.3), clustered(rng, 5, 8, 0.3)
    vectors = spark.createDataFrame([("ab"[i % 2], i, i // 4, [float(v) for v in r]) for i, r in enumerate(x)], "org string, chunk_id long, document_id long, embedding array<float>")
    asked = spark.createDataFrame([(i, "ab"[i % 2], [float(v) for v in r], [3, 4]) for i, r in enumerate(q)], "qid long, org string, qvec array<float>, wanted array<long>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = dense.scored_blocks(vectors, asked, 5, block=32)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan
        sent = sorted(dense_topk(vectors, asked, 5, block=32).collect())
        monkeypatch.setattr(dense, "SENT", 0)
        assert "Exchange hashpartitioning" in dense.scored_blocks(vectors, asked, 5, block=32)._jdf.queryExecution().executedPlan().toString()
        assert sorted(dense_topk(vectors, asked, 5, block=32).collect()) == sent and len(sent) >= 25
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_consumed_table_goes_before_words_are_counted(spark, tmp_path, monkeypatch):
    path, there = str(tmp_path / "index"), []
    chunks = staged(library(spark, {("a", d): TEXT.format(d, "two") for d in range(3)}), "chunks")
    monkeypatch.setattr(index, "postings", lambda *a, **b: (there.append(os.path.exists(chunks.staged_at)), tables.postings(*a, **b))[1])
    assert [r.action for r in index.refresh(path, chunks, MODEL, 1, consumed=True).collect()] == ["build"] and there == [False]
    assert "two" in found(index.indexed_search(spark, path, ask(spark, ("a", "warranty of the pump")), MODEL))[0][4]
