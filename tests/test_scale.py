"""What a task holds follows a fixed piece of the input, not the input: rows, files, slices and texts."""

import glob
import uuid
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from foliant.catalog import library as library_queries
from foliant.catalog import limits, search
from foliant.catalog.registry import Tables
from foliant.functions.vectors import PIECE_ROWS, hash_embedder, hash_features, text_pieces, unit_rows
from foliant.operators import chunk, dense, embed, folds, index
from foliant import session
from foliant.session import shared_folder, spread
from foliant.streaming import jobs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, folder, rows, parts=1):
    spark.createDataFrame(rows, DOCS).repartition(parts).write.parquet(f"{folder}/documents.parquet")
    return Tables(spark, str(folder))


@pytest.mark.parametrize("listed, doc_null", [("en", False), ("en", True), ("none", True)])
def test_not_in_by_equality_keeps_the_rows(spark, tmp_path, listed, doc_null):
    rows = [(i, f"text {i} aeiou", [listed, "de", None][i % 3], f"src{i % 10}", 5) for i in range(80)] + [(49, "again", "en" if listed == "en" else "de", "src9", 5), (1, "no source", "de", None, 5)]
    rows += [(None, "no id", "de", "src5", 5)] + ([(None, "no id", "en" if listed == "en" else "de", "src1", 5)] if doc_null else [])
    t = documents(spark, tmp_path, rows)
    got, want = search.stamped_before(t), t.sql(search.STAMPED_BEFORE)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "ExistenceJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_pieces_of_a_batch():
    texts = ["a" * (i % 50) if i % 7 else None for i in range(5000)]
    parts = list(text_pieces(pa.array(texts, pa.string()), 1000, 2000))
    assert [t for p in parts for t in p] == texts
    assert all(len(p) <= 1000 and (len(p) == 1 or sum(len(t or "") for t in p) <= 2000) for p in parts)
    assert list(text_pieces(pa.array([], pa.string()))) == [] and list(text_pieces(pa.array(["x" * 9, "y"]), 5, 4)) == [["x" * 9], ["y"]]


def test_passages_and_vectors_over_more_than_a_piece(spark):
    texts = [None if i % 11 == 0 else f"pump {i}. " * (i % 5) for i in range(3 * PIECE_ROWS)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, content string").coalesce(1)
    for r in embed.embed(rows, hash_embedder(16)).collect()[::50]:
        assert np.allclose(r.embedding, unit_rows(hash_features([texts[r.n] or ""], 16))[0])
    cut = rows.select("n", chunk.pieces(F.col("content"), 20, 5).alias("p")).collect()
    assert all(r.p == chunk.chunk_text(texts[r.n] or "", 20, 5) for r in cut) and len(cut) == len(texts)


def test_slices_are_not_tasks(spark, monkeypatch):
    tasks, write = [], folds.staged
    monkeypatch.setattr(folds, "staged", lambda df, name: (tasks.append(df.rdd.getNumPartitions()) if name == "slices" else None, write(df, name))[1])
    hits = [(f"k{i % 3}", i * 400_000, i) for i in range(300)]
    frame = spark.createDataFrame(hits, "key string, at long, id long")
    got = {r.id: (r.allowed, r.retry_after) for r in folds.rate_limit(frame, limit=3, window=5, slice_rows=7).collect()}
    machine, states, want = folds.SlidingLog(3, 5), {}, {}
    for k, at, i in hits:
        states[k], want[i] = machine.step(states.get(k, machine.start()), (at,))
    assert got == want and tasks == [1]


def test_slices_of_one_key_are_bounded(spark, tmp_path, monkeypatch):
    spark.range(90).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id)").alias("ts"), (F.col("id") % 4).alias("user_id"),
                           F.lit("error").alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    sizes, fold = [], folds.ordered_fold
    monkeypatch.setattr(folds, "SLICE_ROWS", 5)
    monkeypatch.setattr(folds, "ordered_fold", lambda *a, slice_rows: (sizes.append(slice_rows), fold(*a, slice_rows=slice_rows))[1])
    assert limits.lockout_one_key(Tables(spark, str(tmp_path))).count() == 90 and sizes == [5]


def test_intake_files_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    t = documents(spark, tmp_path, [(i, f"the pump number {i} has a warranty", "en", f"src{i % 3}", 30) for i in range(400)], 4)
    name = uuid.uuid4()
    monkeypatch.setattr(library_queries, "uuid4", lambda: name)
    found = library_queries.ingest_stream(t)
    assert found.count() == found.select("org", "document").distinct().count() > 0
    assert all(len(glob.glob(f"{shared_folder(spark).removeprefix('file://')}/foliant/{name.hex}/in/{i}/*.parquet")) > 1 for i in (1, 2))


def test_a_file_of_one_row_group_is_dealt_out(spark, tmp_path):
    path = f"{tmp_path}/one.parquet"
    pq.write_table(pa.table({"n": range(20_000), "text": [f"{i:0100d}" for i in range(20_000)]}), path, row_group_size=20_000, compression="none", use_dictionary=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        read = spark.read.parquet(path)
        assert read.rdd.getNumPartitions() >= 4
        share = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert share(read) == 20_000 and share(spread(read)) < 8_000 and spread(read).distinct().count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_words_are_counted_in_tasks_of_bounded_text(spark, monkeypatch):
    chunks = spark.createDataFrame([("a", i, "red pumps and blue valves " * 20) for i in range(60)] + [("a", 3, "red")], "org string, chunk_id long, content string")
    monkeypatch.setattr(index, "TASK_CHARS", 1000)
    posted = index.postings(chunks)
    assert posted.select(F.spark_partition_id()).distinct().count() > 8
    assert {(r.chunk_id, r.tf) for r in posted.where("term = 'red'").collect()} == {(i, 20 + (i == 3)) for i in range(60)}


def test_blocks_are_taken_apart_a_few_at_a_time(monkeypatch):
    rng = np.random.default_rng(5)
    q, rows = rng.normal(size=(3, 4)).astype(np.float32), []
    x = rng.normal(size=(90, 4)).astype(np.float32)
    for i in range(0, 90, 3):
        rows.append((4, np.arange(i, i + 3).tobytes(), np.zeros(3, np.int64).tobytes(), x[i:i + 3].tobytes(), np.zeros(4).tobytes(), np.pi, np.arange(3).tobytes(), q.tobytes(), b""))
    batch = pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["dim", "ids", "documents", "matrix", "pivot", "angle", "qids", "qmatrix", "wanted"]))
    monkeypatch.setattr(dense, "MET", 4)
    parts = pa.Table.from_batches(list(dense._score_blocks(5)(iter([batch])))).to_pandas()
    assert (parts.kind == dense.REPORT).sum() == 1 and parts[parts.kind == dense.REPORT].chunk_id.item() == 30
    for k in range(3):
        best = parts[(parts.kind == dense.BEST) & (parts.qkey == k)].chunk_id.tolist()
        assert best == np.argsort(-(x.astype(float) @ q[k].astype(float)))[:5].tolist()


def test_a_new_family_asks_for_no_token():
    written = {}
    stored = SimpleNamespace(updateValue=lambda k, v: written.update({k: v}))
    state, out = folds.TokenFamily().step([jobs._Rotated(stored, False), False], (5, "x", 9))
    assert out == ("rotated",) and written == {("x",): (5,)} and state[0].get("x") == 5


def test_staged_tables_leave_no_shuffle_files_and_can_go(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(type(spark.conf), "set", lambda self, key, value, put=type(spark.conf).set: (seen.append((key, value)), put(self, key, value))[1])
    table = session.staged(spark.range(100).groupBy((F.col("id") % 3).alias("k")).count(), "counted", compression="zstd")
    assert (session.CLEANUP, "true") in seen and spark.conf.get(session.CLEANUP) == "false" and table.count() == 3
    files = session.data_files(spark, table.staged_at)
    assert files and all(f.endswith(".zstd.parquet") and size for f, size in files)
    session.discard(table)
    assert not glob.glob(f"{table.staged_at}*")
