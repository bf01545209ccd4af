"""The pipeline: each stage against what its operator says of the stage's input."""

import zlib

import numpy as np

import corpus_pipeline
from foliant.llm.queries import QUERIES, tokenizer_path

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    from test_llm import near

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns and docs.count() == len(after) and all(after[k] == before[k] for k in after)
        gone = before.keys() - after.keys()
        if name == "quality":
            known = [labels[k] for k in gone if k in labels]
            assert gone and np.mean(known) < 0.1
        if name == "near_duplicates":
            groups = near([(k, r["text"]) for k, r in before.items()], 5, 80)
            assert after.keys() == {k for k, n, root in groups if k == root}
        if name == "benchmark":
            hit = {r["doc_id"] for r in QUERIES["op10_contaminated"](spark, FOLDER).where("contaminated").collect()}
            assert gone == before.keys() & hit
        if name == "mixture":
            assert gone and len(after) > 0.7 * len(before)
        before = after
    from tokenizers import Tokenizer

    model, start = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), 0
    got = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == sorted(before)
    for r in got:
        ids = np.array(model.encode(before[r["doc_id"]]["text"], add_special_tokens=False).ids + [1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_an_empty_table_passes_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0


def test_near_copies_of_eight_tenths_go(spark):
    from test_llm import near

    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for edits, more in ((10, 0), (9, 0), (0, 100), (0, 150), (14, 0)):
        base = rng.choice(words, 500).tolist()
        edited = list(base)
        for at in range(20, 20 + 30 * edits, 30):
            edited[at] = f"e{at}"
        texts += [" ".join(base), " ".join(edited + rng.choice(words, more).tolist())]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.distinct_texts(spark, docs, FOLDER).collect()}
    assert kept == {k for k, n, root in near(rows, 5, 80) if k == root} and {0, 2, 4, 6, 7, 8, 9} == kept
    assert len({k for k, n, root in near(rows) if k == root}) == len(rows)  # 3 words and 0.9 keep all


def test_only_texts_that_share_enough_are_candidates(spark):
    """Of texts with nothing like them none is left; of those that are alike all are, and they meet on few n-grams, also where all texts share a passage."""
    from foliant.llm.similar import candidates

    rng = np.random.default_rng(1)
    common = " ".join(f"c{i}" for i in range(30))
    own = [" ".join(rng.choice([f"w{i}" for i in range(5000)], 200).tolist()) for _ in range(40)]
    alike = [t.replace("w", "x", 2) for t in own[:5]]
    texts = [(str(i), bytearray(f"{common} {t}".encode())) for i, t in enumerate(own + alike)]
    got = candidates(spark.createDataFrame(texts, "hash string, content binary"), 5, 80).collect()
    assert {r["hash"] for r in got} == {*map(str, range(5)), *map(str, range(40, 45))}
    for r in got:
        assert sum(map(len, r["segments"])) == r["n"] and 0 < len(r["meets"]) <= r["n"] - -(-80 * r["n"] // 100) + 1
    meets = {}
    for r in got:
        for m in r["meets"]:
            meets.setdefault(m, []).append(r["hash"])
    assert max(map(len, meets.values())) == 2  # the passage that all share is in no candidate key


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long"


def sorted_rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_near_duplicates_without_an_id_or_with_the_same_id_go(spark):
    rng = np.random.default_rng(4)
    a, b, c, d, e = (" ".join(rng.choice([f"w{i}" for i in range(5000)], 200).tolist()) for _ in range(5))
    rows = [(None, a), (None, a), (None, a + " end"), (7, b), (7, b + " end"), (7, b), (7, c), (None, d), (9, d), (8, d + " end"), (None, e), (1, None), (2, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], AWKWARD).repartition(3)
    got = sorted_rows(corpus_pipeline.distinct_texts(spark, docs, FOLDER))
    kept = [t for k, t in got]
    assert len(got) == 7 and {k for k, t in got if t is None} == {1, 2} and all(kept.count(x) == 1 for x in (c, e))
    assert [sum(t in (x, x + " end") for t in kept) for x in (a, b)] == [1, 1]
    assert [k for k, t in got if t in (d, d + " end")] == [8]  # documents with an id come first


def test_benchmark_passages_without_an_id_or_with_the_same_id_go(spark):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(None, "before " + item), (None, "before " + item), (None, "clean text"), (None, None), (5, item + " after"), (5, "a clean namesake"), (6, "clean"), (6, "clean")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], AWKWARD).repartition(3)
    got = sorted_rows(corpus_pipeline.without_benchmark(spark, docs, FOLDER))
    assert got == sorted([(None, "clean text"), (None, None), (5, "a clean namesake"), (6, "clean"), (6, "clean")], key=str)


def test_quality_mixture_and_token_files_of_awkward_rows(spark, tmp_path):
    """Nulls in any column, empty, blank and very long texts, repeated rows and extra columns: each stage gives what its docstring says."""
    rng = np.random.default_rng(6)
    good = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").join(spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").limit(6).collect()]
    long = " ".join(rng.choice(["some", "words", "again", "and", "more."], 40_000).tolist())
    rows = [(1, good[0], "en", "s"), (1, good[0], "en", "s"), (None, good[1], None, None), (None, good[1], None, None), (None, good[2], "en", None), (2, None, None, "s"), (3, "", "de", "s"), (4, " \n ", "de", "s"),
            (5, long, "en", "s"), (5, good[3], "fr", "s"), (6, good[4], "", "")]
    docs = spark.createDataFrame([(k, t, lang, source, None, "x", 1) for k, t, lang, source in rows], AWKWARD + ", score string, part long").repartition(3)
    plain = sorted_rows(docs)
    kept = corpus_pipeline.good(spark, docs, FOLDER)
    got = sorted_rows(kept)
    assert kept.columns == corpus_pipeline.COLUMNS and all(got.count(x) == plain.count(x) for x in got) and {(1, good[0]), (None, good[1]), (None, good[2]), (5, good[3])} <= set(got)
    mixed = corpus_pipeline.mixture(spark, docs, FOLDER)
    got = sorted_rows(mixed)
    assert mixed.columns == corpus_pipeline.COLUMNS and all(t and t.strip() for _, t in got) and all(got.count(x) <= plain.count(x) for x in got) and got
    files = corpus_pipeline.token_files(spark, docs, FOLDER).orderBy("start").collect()
    assert [r["doc_id"] for r in files] == sorted((k for k, *_ in rows), key=lambda k: (k is not None, k or 0)) and files[0]["start"] == 0
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(files, files[1:])) and [r["n_tokens"] for r in files if r["doc_id"] in (2, 3)] == [1, 1]
