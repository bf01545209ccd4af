"""Operators whose decisions depend on the decisions before them: rate limits, lock-outs, token families, quotas.

Each is a small state machine per key, run over rows in time order. All rows are cut into slices of the order of key and time. What a slice does to the state of a key
that enters it is written down as a small function, made for all slices at once: for lock-outs, where each of the five possible counts leads, and where the end of
a lock would; for limits, a state if there is a gap in the slice after which nothing before counts. These functions are applied one after the other, key by
key, which gives the state at every border; then all slices are walked at once. The number of jobs is the same for all sizes, a key may hold any number of rows, and no
state comes to the driver. A limit without a gap hands its times on, as then every decision depends on the one before.
"""

from __future__ import annotations

import ast
from bisect import bisect_left
from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..session import staged
from .ordered import running_sum

SECOND = 1_000_000
SLICE_ROWS = 100_000  # rows of a slice, which a task holds in Python
MOST_RANGES = 1_000  # of rows that are sorted together; a range holds as many slices as fit
PIECE = 1024  # times that a limit without a gap hands on together


def pack_state(state) -> str:
    """A state as text that keeps the types of keys and values: whole numbers stay whole numbers, also as keys."""
    return repr(state)


def unpack_state(text: str):
    return ast.literal_eval(text)


class Machine(Protocol):
    """State machine of one key. States are plain values; ``step`` returns the next state and the output columns.

    ``pieces`` says what rows in order do to any state, in pieces that ``through`` applies one after the other.
    """

    inputs: list[str]
    outputs: str

    def start(self) -> Any: ...

    def step(self, state: Any, row: tuple) -> tuple[Any, tuple]: ...

    def pieces(self, rows: list[tuple]) -> list: ...

    def through(self, piece: Any, state: Any) -> Any: ...


class SlidingLog:
    """At most ``limit`` accepted hits within ``window`` seconds; refused hits leave no trace."""

    inputs = ["at"]
    outputs = "allowed boolean, retry_after bigint"

    def __init__(self, limit: int = fv.CHAT_PER_MINUTE, window: int = fv.WINDOW_SECONDS):
        self.limit, self.window = limit, window * SECOND

    def start(self):
        return []

    def step(self, state, row):
        now = row[0]
        live = [t for t in state if now - t <= self.window]
        if len(live) < self.limit:
            return live + [now], (True, 0)
        wait = max(1, (self.window - (now - live[0])) // SECOND + 1)
        return live, (False, wait)

    def pieces(self, rows):
        """After a gap longer than the window nothing before counts: then the state at the end is known. Else the times themselves, in pieces of a bounded size."""
        times = [row[0] for row in rows]
        last_gap = next((i for i in range(len(times) - 1, 0, -1) if times[i] - times[i - 1] > self.window), 0)
        if not last_gap:
            return [("times", times[i:i + PIECE]) for i in range(0, len(times), PIECE)]
        return [("state", self._after(times[last_gap:], self.start()))]

    def _after(self, times, state):
        for now in times:
            state, _ = self.step(state, (now,))
        return state

    def through(self, piece, state):
        kind, value = piece
        return value if kind == "state" else self._after(value, state)


class Lockout:
    """Failed log-ins; the fifth locks the account, attempts while locked neither count nor succeed."""

    inputs = ["at", "ok"]
    outputs = "outcome string, failures int"

    def __init__(self, limit: int = fv.MAX_FAILED_LOGINS, minutes: int = fv.LOCKOUT_MINUTES):
        self.limit, self.lock = limit, minutes * 60 * SECOND

    def start(self):
        return [0, None]

    def step(self, state, row):
        failures, until = state
        now, ok = row
        if until is not None and until > now:
            return state, ("locked", failures)
        if ok:
            return [0, None], ("success", 0)
        failures += 1
        if failures >= self.limit:
            return [0, now + self.lock], ("lock", 0)
        return [failures, until], ("failed", failures)

    def pieces(self, rows):
        """Where each number of failures leads, and where the first attempt after a lock does: for locks from before, as (last time up to which a lock may end, state)."""
        n, times = len(rows), [row[0] for row in rows]
        ends: list = [None] * n + [[[f, None] for f in range(self.limit)]]
        for i in range(n - 1, -1, -1):
            if rows[i][1]:
                ends[i] = [ends[i + 1][0]] * self.limit
                continue
            until = times[i] + self.lock
            after = bisect_left(times, until)
            locked = ends[after][0] if after < n else [0, until]
            ends[i] = [*ends[i + 1][1:], locked]
        by_end = []
        for i in range(bisect_left(times, times[0] + self.lock) + 1):
            if i == n:
                break
            if by_end and by_end[-1][1] == ends[i][0]:
                by_end[-1][0] = times[i]
            else:
                by_end.append([times[i], ends[i][0]])
        return [(times[0], ends[0], by_end)]

    def through(self, piece, state):
        first, ends, by_end = piece
        failures, until = state
        if until is None or until <= first:
            return ends[failures]
        return next((end for last, end in by_end if until <= last), state)


class TokenFamily:
    """Use of refresh tokens, for streams. A rotated token may be used again for 10 seconds; later use revokes the family."""

    inputs = ["at", "token", "expires_at"]
    outputs = "outcome string"

    def __init__(self, grace: int = fv.REUSE_GRACE_SECONDS):
        self.grace = grace * SECOND

    def start(self):
        return [{}, False]

    def step(self, state, row):
        rotated, revoked = state
        now, token, expires = row
        at = rotated.get(token)
        if at is not None and now - at <= self.grace:
            return state, ("benign",)
        if at is not None or revoked:
            return [rotated, True], ("reuse",)
        if expires <= now:
            return state, ("expired",)
        rotated[token] = now
        return [rotated, revoked], ("rotated",)


class StorageQuota:
    """Uploads in order, admitted while the organisation stays within its bytes; a name uploaded again replaces itself."""

    inputs = ["name", "size"]
    outputs = "admitted boolean, used bigint"

    def __init__(self, limit: int = fv.MAX_ORG_BYTES):
        self.limit = limit

    def start(self):
        return [0, {}]

    def step(self, state, row):
        used, sizes = state
        name, size = row
        after = used - sizes.get(name, 0) + size
        if after > self.limit:
            return state, (False, used)
        sizes[name] = size
        return [after, sizes], (True, after)


def _walk(batch: pd.DataFrame, key: str, machine: Machine, current, state, rows: list | None):
    """Run the machine over sorted rows; returns the last key and its state, and appends outputs to ``rows``."""
    columns = [batch[c].tolist() for c in machine.inputs]
    for value, *row in zip(batch[key].tolist(), *columns):
        if value != current:
            current, state = value, machine.start()
        state, out = machine.step(state, tuple(row))
        if rows is not None:
            rows.append(out)
    return current, state


def _names(machine: Machine) -> list[str]:
    return [part.split()[0] for part in machine.outputs.split(",")]


def _schema(df: DataFrame, machine: Machine) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + machine.outputs


def ordered_fold(df: DataFrame, key: str, order: list[str], machine: Machine, *, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add the machine's outputs to every row. ``order`` must be total within a key; columns must not be null.

    The order is cut into ranges, a task each, and ranges into slices by place. So slices may be as small as one likes: their number is not that of the tasks.
    """
    ranges = max(1, -(-df.count() // max(slice_rows, SLICE_ROWS if slice_rows < SLICE_ROWS else 1)))
    place = F.monotonically_increasing_id()  # the range, and 33 bits for the place in it
    within = F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / slice_rows).cast("bigint")
    sorted_rows = df.repartitionByRange(ranges, key, *order).sortWithinPartitions(key, *order)
    cut = staged(sorted_rows.withColumn("__slice", F.shiftrightunsigned(place, 33) * F.lit(1 << 33) + within), "slices")
    kind = df.schema[key].dataType.simpleString()
    # keys that cross a border: no more than there are borders
    crossing = cut.groupBy(key).agg(F.min("__slice").alias("lo"), F.max("__slice").alias("hi")).where("lo < hi").select(key)
    used = cut.join(crossing, key, "left_semi").select("__slice", key, *dict.fromkeys([*order, *machine.inputs]))

    def summarise(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        pieces = machine.pieces(list(zip(*[rows[c].tolist() for c in machine.inputs])))
        return pd.DataFrame({"__slice": rows["__slice"].iloc[0], key: rows[key].iloc[0], "piece": range(len(pieces)), "data": [pack_state(p) for p in pieces]})

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out = []
            for number, value, piece, data in zip(*[batch[c].tolist() for c in ("__slice", key, "piece", "data")]):
                if value != current:
                    current, state = value, machine.start()
                if piece == 0:
                    out.append((number, value, pack_state(state)))
                state = machine.through(unpack_state(data), state)
            yield pd.DataFrame(out, columns=["__slice", key, "entry"])

    summed = used.groupBy("__slice", key).applyInPandas(summarise, f"__slice bigint, `{key}` {kind}, piece int, data string")
    entries = summed.repartition(key).sortWithinPartitions(key, "__slice", "piece").mapInPandas(apply, f"__slice bigint, `{key}` {kind}, entry string")
    entries = staged(entries, "entries")
    names = _names(machine)

    def run(rows: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([key, *order])
        states = dict(zip(entered[key].tolist(), entered["entry"].tolist()))
        first = rows[key].iloc[0] if len(rows) else None  # only the first key of a slice may come from another one
        state = unpack_state(states[first]) if first in states else machine.start()
        out: list = []
        _walk(rows, key, machine, first, state, out)
        return pd.concat([rows.drop(columns="__slice"), pd.DataFrame(out, columns=names, index=rows.index)], axis=1)

    return cut.groupBy("__slice").cogroup(entries.groupBy("__slice")).applyInPandas(run, _schema(df, machine))


def fold_by_key(df: DataFrame, key: str, order: list[str], machine: Machine) -> DataFrame:
    """The same for machines whose state is as large as what they have seen: a key's rows pass through one task in order, with one state."""
    names = _names(machine)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            rows: list = []
            current, state = _walk(batch, key, machine, current, state, rows)
            yield pd.concat([batch, pd.DataFrame(rows, columns=names, index=batch.index)], axis=1)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, _schema(df, machine))


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def rate_limit(hits: DataFrame, *, limit: int = fv.CHAT_PER_MINUTE, window: int = fv.WINDOW_SECONDS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Hits (key, at in microseconds, id) with ``allowed`` and ``retry_after`` seconds."""
    return ordered_fold(hits, "key", ["at", "id"], SlidingLog(limit, window), slice_rows=slice_rows)


def lockout(attempts: DataFrame, *, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Log-in attempts (user_id, at, id, ok) with ``outcome`` and ``failures``."""
    return ordered_fold(attempts, "user_id", ["at", "id"], Lockout(), slice_rows=slice_rows)


def token_reuse(uses: DataFrame, *, grace: int = fv.REUSE_GRACE_SECONDS) -> DataFrame:
    """Token uses (family, at, id, token, expires_at) with ``outcome``, as :class:`TokenFamily` gives it, without walking a family.

    A token is rotated by its first use that has not expired, and a family is revoked by its first use of a rotated token after the grace. Both are
    minima that combine before the shuffle; uses then meet them in joins that Spark can split, so a family may hold any number of rows.
    """
    use = F.struct("at", "id")
    turned = uses.where("expires_at > at").groupBy("family", "token").agg(F.min(use).alias("turned"))
    met = uses.join(turned, ["family", "token"], "left")
    again = F.coalesce(F.col("turned") < use, F.lit(False))
    late = F.col("at") - F.col("turned.at") > grace * SECOND
    revoked = met.where(again & late).groupBy("family").agg(F.min(use).alias("revoked"))
    # a token first used after the revocation is not rotated any more
    known = again & (F.col("revoked").isNull() | (F.col("turned") < F.col("revoked")))
    after = F.coalesce(F.col("revoked") < use, F.lit(False))
    outcome = (F.when(known & ~late, "benign").when(known | after, "reuse").when(F.col("expires_at") <= F.col("at"), "expired").otherwise("rotated"))
    return met.join(revoked, "family", "left").select(*[f"`{c}`" for c in uses.columns], outcome.alias("outcome"))


def storage_admission(uploads: DataFrame, *, limit: int = fv.MAX_ORG_BYTES, ranges: int | None = None) -> DataFrame:
    """Uploads (org, seq, name, size) with ``admitted`` and ``used``, the bytes held afterwards.

    While all uploads of an organisation are admitted, each adds its size less that of the last one of its name, so what is held is a running sum. Only from the first upload
    that would go beyond the limit on does a decision depend on the one before: these uploads are walked, after the last one of each name before them.
    """
    columns = uploads.columns
    last = F.lag("size", 1, 0).over(Window.partitionBy("org", "name").orderBy("seq"))
    summed = staged(running_sum(uploads.withColumn("__more", F.col("size") - last), "org", ["seq"], "__more", "__used", ranges=ranges), "sums")
    beyond = staged(summed.where(F.col("__used") > limit).groupBy("org").agg(F.min("seq").alias("__from")), "beyond")
    marked = summed.join(beyond, "org", "left")
    free = F.col("__from").isNull() | (F.col("seq") < F.col("__from"))
    admitted = marked.where(free).select(*columns, F.lit(True).alias("admitted"), F.col("__used").cast("bigint").alias("used"))
    held = marked.where(free & F.col("__from").isNotNull()).groupBy("org", "name").agg(F.max(F.struct("seq", "size")).alias("h"))
    rest = marked.where(~free).select(*columns).withColumn("__asked", F.lit(True))
    before = held.select("org", "name", "h.seq", "h.size").withColumn("__asked", F.lit(False))
    walked = fold_by_key(rest.unionByName(before, allowMissingColumns=True), "org", ["seq"], StorageQuota(limit))
    return admitted.unionByName(walked.where("__asked").drop("__asked"))
