"""Structured Streaming jobs: limits, usage, intake and audit as data arrives. The batch form is the truth."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.vectors import Embedder
from ..operators.chunk import document_rollup, documents_without_text
from ..operators.folds import SECOND, Lockout, Machine, SlidingLog, TokenFamily
from ..plans.ingest import passages
from ..sources.library_sink import append_audit, replace_documents

LATENESS = "1 hour"


class _Fold(StatefulProcessor):
    """Runs a state machine per key. What is remembered of a key lies in typed states, of which a trigger reads and writes what it needs.

    With a ``life``, a key is forgotten when the watermark is so far past its last row. What a key gets in one trigger is sorted in memory: bound the trigger at
    the source (``maxFilesPerTrigger`` and the like).
    """

    def __init__(self, machine: Machine, key: str, life: int | None = None):
        self.machine, self.key, self.life = machine, key, life
        self.names = [part.split()[0] for part in machine.outputs.split(",")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until bigint") if self.life else None
        self.states = self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> list:
        raise NotImplementedError

    def load(self) -> Any:
        raise NotImplementedError

    def save(self, state: Any) -> None:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        batch = (pd.concat(frames) if len(frames) > 1 else frames[0]).sort_values(["at", "id"])  # one key's part of one trigger
        state, out = self.load(), []
        for row in zip(*[batch[c].tolist() for c in self.machine.inputs]):
            state, result = self.machine.step(state, row)
            out.append(result)
        self.save(state)
        if self.life:
            until = int(batch["at"].iloc[-1] + self.life) // 1000 + 1
            self.until.update((until,))
            self.handle.registerTimer(until)
        columns = zip(*out)
        yield pd.DataFrame({self.key: batch[self.key].to_numpy(), "id": batch["id"].to_numpy(), **dict(zip(self.names, columns))})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.until.exists() and expiredTimerInfo.getExpiryTimeInMs() >= self.until.get()[0]:
            for state in [*self.states, self.until]:
                state.clear()
        yield pd.DataFrame(columns=[self.key, "id", *self.names])

    def close(self) -> None:
        pass


class _Limit(_Fold):
    """The accepted hits of the window as a list, never more than the limit allows."""

    def open(self, handle):
        self.times = handle.getListState("times", "at bigint")
        return [self.times]

    def load(self):
        return [t for t, in self.times.get()] if self.times.exists() else self.machine.start()

    def save(self, state):
        self.times.put([(t,) for t in state])


class _Locks(_Fold):
    """Failures and the end of the lock as one value."""

    def open(self, handle):
        self.value = handle.getValueState("state", "failures int, until bigint")
        return [self.value]

    def load(self):
        return list(self.value.get()) if self.value.exists() else self.machine.start()

    def save(self, state):
        self.value.update(tuple(state))


class _Rotated(dict):
    """Tokens of a family and when they were rotated: an entry is read when a use asks for it, and written when it changes; the others stay where they are."""

    def __init__(self, stored, begun: bool = True):
        super().__init__()
        self.stored, self.begun = stored, begun  # a new family has no entry to ask for

    def get(self, token, default=None):
        if token not in self:
            super().__setitem__(token, self.stored.getValue((token,))[0] if self.begun and self.stored.containsKey((token,)) else None)
        return super().get(token, default)

    def __setitem__(self, token, at):
        super().__setitem__(token, at)
        self.stored.updateValue((token,), (at,))


class _Family(_Fold):
    """A map of tokens, and whether the family is revoked."""

    def open(self, handle):
        self.rotated = handle.getMapState("rotated", "token string", "at bigint")
        self.revoked = handle.getValueState("revoked", "revoked boolean")
        return [self.rotated, self.revoked]

    def load(self):
        return [_Rotated(self.rotated, self.rotated.exists()), self.revoked.exists()]

    def save(self, state):
        if state[1]:
            self.revoked.update((True,))


def _run(rows: DataFrame, processor: _Fold) -> DataFrame:
    """``key, id`` and the machine's outputs of a stream with key, ``ts``, ``at`` (microseconds) and ``id``."""
    key = processor.key
    return rows.withWatermark("ts", LATENESS).groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=f"`{key}` {rows.schema[key].dataType.simpleString()}, id bigint, {processor.machine.outputs}",
        outputMode="Append", timeMode="EventTime" if processor.life else "None")


def rate_limit_stream(hits: DataFrame, limit: int, window: int) -> DataFrame:
    return _run(hits, _Limit(SlidingLog(limit, window), "key", window * SECOND))


def lockout_stream(attempts: DataFrame, *, life: int | None = None) -> DataFrame:
    """Without a ``life`` (seconds) failures are never forgotten, as in the batch form; with it, those of an account without attempts for so long are."""
    return _run(attempts, _Locks(Lockout(), "user_id", life and life * SECOND))


def token_stream(uses: DataFrame, *, life: int | None = None) -> DataFrame:
    """``life`` (seconds): how long after its last use a family is remembered, at least as long as a token is valid; without it for ever."""
    return _run(uses, _Family(TokenFamily(), "family", life and life * SECOND))


def usage_stream(questions: DataFrame) -> DataFrame:
    """``org, day, value`` of a stream of questions (org, ts, outcome); a day is final an hour after its end."""
    counted = (questions.where("outcome = 'answered'").withWatermark("ts", LATENESS)
               .groupBy(F.window("ts", "1 day").alias("w"), "org").agg(F.count("*").alias("value")))
    return counted.select("org", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "value")


def corrected_usage(counted: DataFrame, late: DataFrame) -> DataFrame:
    """``org, day, value``: final days with what came too late for them.

    ``counted`` is what :func:`usage_stream` has written, ``late`` the side table of its late rows (org, ts, outcome, and optionally ``sign``, -1 where an answer is taken back). The side table
    has a folder for each batch, which a replay writes again, so a row corrects once. Days that are still open are left out; their late rows count as soon
    as the day is final. An organisation may have late rows only.
    """
    final = counted.agg(F.max("day").alias("last"))
    sign = F.col("sign") if "sign" in late.columns else F.lit(1)
    signed = late.where("outcome = 'answered'").select("org", F.date_format("ts", "yyyy-MM-dd").alias("day"), sign.cast("bigint").alias("value"))
    rows = counted.select("org", "day", F.col("value").cast("bigint").alias("value")).unionByName(signed)
    summed = rows.groupBy("org", "day").agg(F.sum("value").alias("value")).where("value <> 0")
    return summed.join(final, F.col("day") <= F.col("last"), "left_semi")


def split_late(rows: DataFrame, *, ts: str = "ts", arrived: str = "arrived") -> tuple[DataFrame, DataFrame]:
    """Rows in time, and rows that arrived more than an hour after they happened; these go to a side table."""
    late = F.col(arrived) > F.col(ts) + F.expr(f"INTERVAL {LATENESS}")
    return rows.where(~late), rows.where(late)


def late_stream(rows: DataFrame, path: str, checkpoint: str, *, ts: str = "ts", arrived: str = "arrived", **trigger: Any):
    """Start the side table of rows that came more than an hour late, which streams with a watermark may leave out; a folder for each batch."""
    late = split_late(rows, ts=ts, arrived=arrived)[1]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return late.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingest_batch(library: str, model: Embedder) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: documents (org, document_id, name, text, seq) into the library, read by ``library_sink.documents``.

    The last upload of a name within a batch wins; documents and passages change in one commit, so a batch that fails between its writes is not seen, and
    a batch that comes again changes nothing. Documents without text go to ``errors`` and replace nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        from ..operators.library import latest_by_name
        from ..session import staged

        docs = staged(latest_by_name(batch), "batch")
        pieces = staged(passages(docs.withColumnRenamed("name", "document"), model), "chunks")
        totals = document_rollup(pieces, ["org", "document_id"], model.name)
        errors = documents_without_text(docs.drop("text"), pieces, ["org", "document_id"])
        # the first batch of a stream has number 0, the first version of a library is 1
        replace_documents(library, staged(docs.drop("text").join(totals, ["org", "document_id"]), "documents"), batch_id + 1,
                          chunks=pieces.withColumn("name", F.col("document")), errors=errors)

    return write


def ingest_stream(docs: DataFrame, library: str, model: Embedder, checkpoint: str, **trigger: Any):
    """Start the intake of a stream of documents."""
    return (docs.writeStream.foreachBatch(ingest_batch(library, model)).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def audit_stream(events: DataFrame, path: str, checkpoint: str, **trigger: Any):
    """Start the sink of audit events: a folder for each batch, written again if the batch is."""
    return (events.writeStream.foreachBatch(lambda batch, number: append_audit(path, batch, number)).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
