"""Organisations with equal ids, mixed models, replays, blank uploads, and states that keep their types."""

import pytest
from pyspark.sql import functions as F

from foliant.functions.vectors import hash_embedder
from foliant.operators import retrieve
from foliant.operators.embed import embed
from foliant.operators.folds import pack_state, unpack_state
from foliant.plans.ingest import passage_id, passages
from foliant.sources.library_sink import append_audit, documents, library, replace_documents
from foliant.streaming.jobs import ingest_batch

MODEL = hash_embedder()
TEXT = "The {} pump warranty lasts {} years and covers all parts of the machine."


@pytest.fixture(scope="module")
def two_orgs(spark):
    docs = spark.createDataFrame([("a", 1, "d1", TEXT.format("red", "two")), ("b", 1, "d1", TEXT.format("blue", "nine"))], "org string, document_id long, document string, text string")
    asked = embed(spark.createDataFrame([(1, "a", "how long is the pump warranty")], "qid long, org string, query string"), MODEL, "query", "qvec")
    return passages(docs, MODEL), asked


def test_equal_ids_do_not_mix_organisations(two_orgs):
    chunks, asked = two_orgs
    for found in (retrieve.hybrid_search(chunks, asked, MODEL.name), retrieve.overview(chunks, asked)):
        assert [(r.org, "red" in r.content) for r in found.collect()] == [("a", True)]


def test_vectors_of_another_dimension_are_left_out(two_orgs):
    chunks, asked = two_orgs
    short = chunks.withColumn("document_id", F.lit(2).cast("long")).withColumn("chunk_id", F.col("chunk_id") + 1).withColumn("embedding", F.slice("embedding", 1, 64))
    found = retrieve.hybrid_search(chunks.unionByName(short), asked, MODEL.name).collect()
    assert [r.document_id for r in found] == [1] and all(r.score is not None for r in found)


def test_a_passage_id_never_belongs_to_another_document(spark):
    rows = spark.createDataFrame([(1, 999_999), (1, 1_000_000)], "d long, o int").select(passage_id(F.col("d"), F.col("o")).alias("id"))
    with pytest.raises(Exception, match="too many passages"):
        rows.collect()


def test_states_keep_their_types():
    state = {7: (1, "x"), "7": None}
    assert unpack_state(pack_state(state)) == state


def test_blank_documents_are_reported_and_replays_change_nothing(spark, tmp_path):
    batch = spark.createDataFrame([("a", 1, "n1", TEXT, 1), ("a", 2, "blank", "  ", 2), ("a", 3, "none", None, 3)], "org string, document_id long, name string, text string, seq long")
    path = str(tmp_path / "library")
    for _ in range(2):
        ingest_batch(path, MODEL)(batch, 0)
    assert sorted(r.document_id for r in library(spark, path).log("errors").collect()) == [2, 3]
    assert [r.document_id for r in documents(spark, path).collect()] == [1]


def test_audit_batches_are_written_once(spark, tmp_path):
    events = spark.createDataFrame([("a", "chat.flagged", None)], "org string, action string, target string")
    path = str(tmp_path / "audit")
    for number in (0, 0, 1):
        append_audit(path, events, number)
    assert spark.read.parquet(path).count() == 2


def test_a_library_keeps_its_columns(spark, tmp_path):
    path = str(tmp_path / "library")
    rows = spark.createDataFrame([("a", "n1", 1), ("a", "n2", 2)], "org string, name string, size long")
    replace_documents(path, rows)
    with pytest.raises(ValueError, match="size"):
        replace_documents(path, rows.drop("size").limit(1))
    replace_documents(path, rows.where("name = 'n1'").withColumn("kind", F.lit("txt")))
    assert {(r.name, r.size, r.kind) for r in documents(spark, path).collect()} == {("n1", 1, "txt"), ("n2", 2, None)}
