"""Streams with keyed state over several triggers against the batch form."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import folds
from foliant.streaming import jobs

COLUMNS = "key string, user_id long, family string, ts timestamp, at long, id long, ok boolean, token string, expires_at long"


@pytest.fixture(scope="module")
def arriving(spark, tmp_path_factory):
    """Rows in five files, in the order of time, each a trigger of its own."""
    rnd, rows, at = random.Random(9), [], 1_700_000_000 * folds.SECOND
    for i in range(500):
        at += rnd.choice([1, 2, 10, 40]) * folds.SECOND
        user = rnd.choice([1, 1, 1, 2, 3])
        rows.append((f"k{user}", user, f"f{user}", at, i, rnd.random() < .2, f"t{rnd.randint(0, 60)}", at + rnd.choice([-1, 10**12])))
    path = str(tmp_path_factory.mktemp("stream") / "in")
    for i in range(5):
        part = spark.createDataFrame(rows[i * 100:(i + 1) * 100], "key string, user_id long, family string, at long, id long, ok boolean, token string, expires_at long")
        part.withColumn("ts", F.timestamp_micros("at")).select(*[c.split()[0] for c in COLUMNS.split(", ")]).coalesce(1).write.parquet(f"{path}/{i}")
    return path


def run(spark, arriving, job, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(f"{arriving}/*")
    out = job(stream)
    query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert query.awaitTermination(300), query.stop()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 5
    return {r.id: r for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()}


def test_limit(spark, arriving, tmp_path):
    got = run(spark, arriving, lambda s: jobs.rate_limit_stream(s.select("key", "ts", "at", "id"), 3, 30), tmp_path)
    want = folds.rate_limit(spark.read.schema(COLUMNS).parquet(f"{arriving}/*").select("key", "at", "id"), limit=3, window=30).collect()
    assert {i: (r.allowed, r.retry_after) for i, r in got.items()} == {r.id: (r.allowed, r.retry_after) for r in want}


def test_lockout(spark, arriving, tmp_path):
    got = run(spark, arriving, lambda s: jobs.lockout_stream(s.select("user_id", "ts", "at", "id", "ok")), tmp_path)
    want = folds.lockout(spark.read.schema(COLUMNS).parquet(f"{arriving}/*").select("user_id", "at", "id", "ok")).collect()
    assert {i: (r.outcome, r.failures) for i, r in got.items()} == {r.id: (r.outcome, r.failures) for r in want}


@pytest.mark.parametrize("how", [{}, {"life": 10**6}])
def test_tokens(spark, arriving, tmp_path, how):
    got = run(spark, arriving, lambda s: jobs.token_stream(s.select("family", "ts", "at", "id", "token", "expires_at"), **how), tmp_path)
    want = folds.token_reuse(spark.read.schema(COLUMNS).parquet(f"{arriving}/*").select("family", "at", "id", "token", "expires_at")).collect()
    assert {i: r.outcome for i, r in got.items()} == {r.id: r.outcome for r in want}


def test_a_use_touches_its_own_token_only():
    class Stored(dict):
        reads, writes = [], []

        def containsKey(self, key):
            self.reads.append(key[0])
            return key in self

        def getValue(self, key):
            return self[key]

        def updateValue(self, key, value):
            self.writes.append(key[0])
            self[key] = value

    stored = Stored({(f"t{i}",): (i,) for i in range(1000)})
    machine, state = folds.TokenFamily(), [jobs._Rotated(stored), False]
    assert machine.step(state, (10**9, "t7", 10**10))[1] == ("reuse",)
    state = [jobs._Rotated(stored), False]
    assert machine.step(state, (10**9, "new", 10**10))[1] == ("rotated",) and machine.step(state, (10**9 + 1, "new", 10**10))[1] == ("benign",)
    assert stored.reads == ["t7", "new"] and stored.writes == ["new"] and stored[("new",)] == (10**9,)
