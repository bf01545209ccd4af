"""Interval joins, running values, the library at the time of a question, contained names, stored vectors, corrected counts, listed files."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions.vectors import Embedder
from foliant.operators import library
from foliant.operators.embed import embed_stored, stored_vectors
from foliant.operators.ordered import carried, dyadic, interval_join
from foliant.sources import files
from foliant.streaming import jobs


def pieces(start, end, levels):
    """The closed form of ``dyadic``, in Python."""
    out = set()
    for level in range(levels + 1):
        first, last = -(-start >> level) if start >= 0 else 0, end >> level
        first = -(-start // (1 << level))
        if first < last:
            out |= {(level, first)} if first % 2 else set()
            out |= {(level, last - 1)} if last % 2 else set()
    return out


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 1000), st.integers(0, 1000))
def test_dyadic_pieces_cover_an_interval_once(a, b):
    got = Counter(x for level, place in pieces(a, b, 11) for x in range(place << level, (place + 1) << level))
    assert got == Counter(range(a, b))


def test_dyadic_columns(spark):
    rows = [(a, b) for a in range(0, 40, 3) for b in range(0, 40, 7)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", dyadic(F.col("a"), F.col("b"), 7).alias("p")).collect()
    assert all({(p.level, p.place) for p in r.p} == pieces(r.a, r.b, 7) for r in got)


def test_interval_join(spark):
    rnd = random.Random(4)
    points = [(i, rnd.choice("aab"), rnd.randint(-50, 4000)) for i in range(300)] + [(900, "a", None), (901, None, 5)]
    spans = [(j, rnd.choice("aac"), (s := rnd.randint(-100, 4100)), rnd.choice([None, s, s + 1, s + rnd.randint(0, 3000)])) for j in range(200)] + [(999, "a", None, 7)]
    p, s = spark.createDataFrame(points, "id long, k string, at long"), spark.createDataFrame(spans, "span long, k string, start long, end long")
    want = Counter((i, j) for i, k, at in points for j, k2, a, b in spans if None not in (k, at, a) and k == k2 and a <= at and (b is None or at < b))
    assert Counter((r.id, r.span) for r in interval_join(p, s, "k").collect()) == want
    assert interval_join(p.limit(0), s, "k").count() == 0


def test_running_values(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("aaaaaab"), i, rnd.choice([None, None, None, f"v{i}"])) for i in range(400)]
    want, last = {}, {}
    for k, i, v in rows:
        last[k] = v or last.get(k)
        want[i] = last[k]
    df = spark.createDataFrame(rows, "k string, i long, v string").repartition(3)
    for ranges in (1, 7):
        assert {r.i: r.seen for r in carried(df, "k", ["i"], "v", "seen", ranges=ranges).collect()} == want


def test_library_at_the_time_of_a_question(spark):
    rnd = random.Random(6)
    events = [(rnd.choice("ab"), i, 100 + 10 * i, rnd.choice(["upload"] * 6 + ["delete", "clear"]), f"n{rnd.randint(0, 5)}") for i in range(150)]
    questions = [(q, rnd.choice("abc"), rnd.choice([0, 99, 100, 1600, 1601, 9999, rnd.randint(90, 1700)])) for q in range(60)]
    frame = spark.createDataFrame(events, "org string, seq long, ts long, action string, name string")
    want = set()
    for q, org, at in questions:
        held = {}
        for o, seq, ts, action, name in events:
            if o == org and ts <= at:
                if action == "clear":
                    held = {}
                elif action == "delete":
                    held.pop(name, None)
                else:
                    held[name] = seq
        want |= {(q, org, n, s) for n, s in held.items()}
    got = library.library_at(spark.createDataFrame(questions, "qid long, org string, at long"), frame).collect()
    assert len(got) == len(want) and {(r.qid, r.org, r.name, r.seq) for r in got} == want


def test_contained_names(spark):
    rnd = random.Random(7)
    text = lambda n: "".join(rnd.choice("abé ") for _ in range(n))
    long = [("o", text(rnd.randint(0, 30))) for _ in range(200)]
    short = [("o", t[i:i + n]) for o, t in long[:80] for i, n in ((rnd.randint(0, 5), rnd.randint(5, 14)),)] + [("x", long[0][1]), ("o", "")]
    got = library.contained(spark.createDataFrame(short, "org string, low string").distinct(), spark.createDataFrame(long, "org string, low string").distinct())
    want = {(s, t) for o, s in short for p, t in long if o == p and len(s) >= 8 and s in t}
    assert {(r.low, r.whole) for r in got.collect()} == want


def test_a_text_is_embedded_once_for_all_runs(spark, tmp_path):
    path, log = str(tmp_path / "vectors"), tmp_path / "seen"
    log.mkdir()

    def model(name):
        def run(texts):
            import uuid

            (log / uuid.uuid4().hex).write_text("\n".join(texts))
            return np.array([[len(t), 1.0] for t in texts])

        return Embedder(name, 2, run)

    def embedded():
        seen = sorted(t for f in log.iterdir() for t in f.read_text().split("\n"))
        for f in log.iterdir():
            f.unlink()
        return seen

    docs = lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, content string")
    first = embed_stored(docs("a", "bb", "a"), model("m"), path, 1)
    assert first.count() == 3 and embedded() == ["a", "bb"]
    assert embed_stored(docs("a", "bb"), model("m"), path, 2).count() == 2 and embedded() == []
    both = {r.content: r.embedding for r in embed_stored(docs("a", "ccc"), model("m"), path, 3).collect()}
    assert embedded() == ["ccc"] and both["ccc"] == pytest.approx([3 / 10 ** 0.5, 1 / 10 ** 0.5]) and both["a"] == pytest.approx([0.5 ** 0.5] * 2)
    embed_stored(docs("a", "ccc"), model("m"), path, 3)
    assert embedded() == ["ccc"]  # a run that comes again writes its own folder again
    embed_stored(docs("a"), model("another/model"), path, 4)
    assert embedded() == ["a"] and stored_vectors(spark, path, model("m")).count() == 3


def test_counts_with_late_rows(spark):
    counted = spark.createDataFrame([("a", "2024-01-01", 5), ("a", "2024-01-02", 2), ("b", "2024-01-01", 1)], "org string, day string, value long")
    late = [("a", "2024-01-01 10:00:00", "answered", 1), ("a", "2024-01-01 11:00:00", "failed", 1), ("c", "2024-01-02 01:00:00", "answered", 1),
            ("b", "2024-01-01 01:00:00", "answered", -1), ("a", "2024-01-03 01:00:00", "answered", 1)]
    rows = spark.createDataFrame(late, "org string, ts string, outcome string, sign int").withColumn("ts", F.to_timestamp("ts"))
    got = {(r.org, r.day): r.value for r in jobs.corrected_usage(counted, rows).collect()}
    assert got == {("a", "2024-01-01"): 6, ("a", "2024-01-02"): 2, ("c", "2024-01-02"): 1}


def test_files_without_a_byte_are_errors(spark, tmp_path):
    for org, batch, name, data in (("o1", "b1", "a.txt", b"text"), ("o1", "b1", "none.txt", b""), ("o2", "b2", "big.txt", b"x" * 50), ("o2", "b3", "_left.txt", b"x")):
        (tmp_path / org / batch).mkdir(parents=True, exist_ok=True)
        (tmp_path / org / batch / name).write_bytes(data)
    (tmp_path / "o3").mkdir()
    for path in (str(tmp_path), f"file://{tmp_path}"):
        rows = {(r.org, r.batch, r.name): (r.size, r.content, r.error) for r in files.read_files(spark, path, cap=10).collect()}
        assert rows == {("o1", "b1", "a.txt"): (4, bytearray(b"text"), None), ("o1", "b1", "none.txt"): (0, bytearray(), "The file is empty."),
                        ("o2", "b2", "big.txt"): (50, None, "File exceeds the 0 MB limit.")}
