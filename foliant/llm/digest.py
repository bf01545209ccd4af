"""Fingerprints of documents from improbable features.

Every window of bytes has an entropy; the further it lies from that of ordinary text, the rarer the window. In each stretch of windows the
rarest one (the first of several) gains a point; windows with enough points are the features. They go into Bloom filters, a new one as
soon as the last is full. Two fingerprints are alike by the bits that their filters share, beyond what chance would give.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, mixed, pieces, written

WINDOW = 32
STRETCH = 32
POINTS = 8
#: Short texts have few windows: all runs of ``SMALL`` bytes are features too, up to ``SHORT`` bytes; from there to twice as many a share of them that falls to none.
SHORT, SMALL = 256, 5
BITS = 2048
HASHES = 5
FULL = 160
#: Sum of c log2 c over the byte counts c of a window of ordinary text, in thousandths.
TYPICAL = 48_000
COUNT_LOG = np.round(1000 * np.arange(WINDOW + 2) * np.log2(np.maximum(np.arange(WINDOW + 2), 1))).astype(np.int64)


def unevenness(codes: np.ndarray) -> np.ndarray:
    """Sum of c log2 c for each window, by first byte: the entropy is 5 bits less a 32nd of it.

    A window differs from the one before by one byte that comes and one that goes. How often these occur in the window is read off their ranks among all
    places of the same byte.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    place = codes[order].astype(np.int64) * (n + 2 * WINDOW) + order
    ranks = np.arange(n)
    # equal bytes among the WINDOW - 1 places before and after
    before, after = np.empty(n, np.int64), np.empty(n, np.int64)
    before[order] = ranks - np.searchsorted(place, place - (WINDOW - 1))
    after[order] = np.searchsorted(place, place + (WINDOW - 1), "right") - 1 - ranks
    step = COUNT_LOG[1:] - COUNT_LOG[:-1]
    # the byte at i + WINDOW joins what is left of the window at i without its first byte
    first = np.bincount(codes[:WINDOW])
    change = step[before[WINDOW:]] - step[after[:n - WINDOW]]
    return int(COUNT_LOG[first].sum()) + np.concatenate(([0], np.cumsum(change)))


def features(codes: np.ndarray, uneven: np.ndarray) -> np.ndarray:
    """64-bit names of the chosen windows, in the order of their places."""
    m, small = len(uneven), np.empty(0, np.uint64)
    if SMALL <= len(codes) < 2 * SHORT:
        padded = np.zeros((len(codes) - SMALL + 1, 8), np.uint8)
        padded[:, :SMALL] = np.lib.stride_tricks.sliding_window_view(codes, SMALL)
        small = mixed(padded.view("<u8")[:, 0] + np.uint64(1 << 40))
        # the share is told by the name, so a text a little longer keeps most of what this one keeps
        share = min(1.0, (2 * SHORT - len(codes)) / SHORT)
        small = small[small >> np.uint64(32) < np.uint64(int(share * 2**32))]
    if not m:
        return distinct(small) if len(small) else np.array([xxhash.xxh3_64_intdigest(codes.tobytes())] if len(codes) else [], np.uint64)
    key = ((1 << 20) - np.abs(uneven - TYPICAL)) << 40 | np.arange(m)
    if m <= STRETCH:
        chosen = np.array([key.min() & (1 << 40) - 1])
    else:
        rows = -(-m // STRETCH)
        grid = np.full(rows * STRETCH, np.iinfo(np.int64).max)
        grid[:m] = key
        grid = grid.reshape(rows, STRETCH)
        ahead = np.minimum.accumulate(grid, 1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(behind[:m - STRETCH + 1], ahead[STRETCH - 1:m]) & (1 << 40) - 1
        # the rarest of successive stretches changes only when it leaves or is beaten: it never comes back
        starts = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
        points = np.diff(np.concatenate((starts, [len(least)])))
        chosen = least[starts][points >= POINTS]
        if not len(chosen):
            chosen = least[starts][[points.argmax()]]
    words = np.ascontiguousarray(codes[chosen[:, None] + np.arange(WINDOW)]).view("<u8")
    name = np.zeros(len(chosen), np.uint64)
    for i in range(words.shape[1]):
        name = mixed(name * np.uint64(0xD6E8FEB86659FD93) + words[:, i])
    return distinct(np.concatenate((name, small)))


def distinct(names: np.ndarray) -> np.ndarray:
    """Each name once, where it comes first: a feature that repeats takes no more room in the filters."""
    return names[np.sort(np.unique(names, return_index=True)[1])]


def filters(names: np.ndarray) -> np.ndarray:
    """Chained Bloom filters as rows of 64-bit words."""
    rows = -(-len(names) // FULL)
    bits = np.zeros((rows, BITS), np.uint8)
    row = np.arange(len(names)) // FULL
    for i in range(HASHES):
        bits[row, (names >> np.uint64(11 * i) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def best_overlaps(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each filter of ``one`` the best overlap with a filter of ``other``: 0 is chance, 1 is all bits of the smaller one."""
    a, b = np.bitwise_count(one).sum(1).astype(float), np.bitwise_count(other).sum(1).astype(float)
    out = np.empty(len(one))
    for i, row in enumerate(one):
        most, chance = np.minimum(a[i], b), a[i] * b / BITS
        out[i] = np.clip((np.bitwise_count(row & other).sum(1) - chance) / np.maximum(most - chance, 1), 0, 1).max()
    return out


def likeness(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Mean of the best overlaps both ways, by the number of features: 1 for equal fingerprints, 0 if just one is empty."""
    (names, one), (names2, other) = x, y
    if len(names) == len(names2) and np.array_equal(one, other):
        return 1.0
    if not len(names) or not len(names2):
        return 0.0
    weigh = lambda n, rows: np.minimum(FULL, n - FULL * np.arange(rows))
    p, q = weigh(len(names), len(one)), weigh(len(names2), len(other))
    return float(((p * best_overlaps(one, other)).sum() + (q * best_overlaps(other, one)).sum()) / (p.sum() + q.sum()))


def edited(text: str, following: str) -> tuple[str, int]:
    """The text with its last quarter of code points replaced by as many from the start of another, and how many stay."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter], len(text) - quarter


class Digest:
    """A text's bytes, windows, features and filters."""

    def __init__(self, raw: bytes, known: Digest | None = None, same: int = 0):
        """``known`` and ``same``: a text with the same first bytes, whose windows there need not be measured again."""
        self.codes = np.frombuffer(raw, np.uint8)
        if len(raw) < WINDOW:
            self.uneven = np.empty(0, np.int64)
        elif known is not None and same > 2 * WINDOW:
            kept = same - WINDOW + 1
            self.uneven = np.concatenate((known.uneven[:kept], unevenness(self.codes[kept:]) if len(raw) - kept >= WINDOW else np.empty(0, np.int64)))
        else:
            self.uneven = unevenness(self.codes)
        self.names = features(self.codes, self.uneven)
        self.chain = filters(self.names)

    @property
    def packed(self) -> bytes:
        """Number of features, and the filters."""
        return len(self.names).to_bytes(4, "little") + self.chain.tobytes()

    def like(self, other: Digest) -> float:
        return likeness((self.names, self.chain), (other.names, other.chain))


#: The first filters of an edited text are those of the text: only their number is kept, and the others.
FIELDS = "n_chars long, edited_sha256 string, fingerprint binary, shared int, edited_fingerprint binary, near_edited double, near_next double"
SHOWN = ["n_chars", "edited_sha256", "fingerprint", "shared", "edited_fingerprint", "near_edited", "near_next"]
KINDS = [pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.binary(), pa.float64(), pa.float64()]


def compared(raw: bytes, own: Digest, following: bytes, after: Digest) -> tuple:
    """What a document and the next one have to show."""
    text = raw.decode("utf-8", "replace")
    changed, kept = edited(text, following[:4 * len(text) + 8].decode("utf-8", "ignore"))
    changed_raw = changed.encode()
    other = Digest(changed_raw, own, len(text[:kept].encode()))
    many = min(len(own.chain), len(other.chain))
    differing = np.flatnonzero((own.chain[:many] != other.chain[:many]).any(1))
    shared = int(differing[0]) if len(differing) else many
    return len(text), sha256(changed_raw).hexdigest(), own.packed, shared, other.packed[:4] + other.chain[shared:].tobytes(), own.like(other), own.like(after)


def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range, in order: each is compared with the next one. The first and the last go on with their bytes, for the ranges beside."""
    part, last, first = TaskContext.get().partitionId(), None, True
    for batch, texts in pieces(batches, "content", 1_000_000):
        keys = batch.column("key")
        shown, who = [], []
        if last is not None:
            keys = pa.concat_arrays([last[0], keys])
            texts = [last[1], *texts]
        digests = [last[2] if i == 0 and last is not None else Digest(t) for i, t in enumerate(texts)]
        for i in range(len(texts) - 1):
            shown.append(compared(texts[i], digests[i], texts[i + 1], digests[i + 1]))
            who.append(i)
        if first:
            yield edge(part, "first", keys[:1], texts[0])
            first = False
        last = keys[len(texts) - 1:], texts[-1], digests[-1]
        yield rows(part, keys.take(pa.array(who, pa.int64())), shown)
    if last is not None:
        yield edge(part, "last", last[0], last[1])


def rows(part: int, keys: pa.Array, shown: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*shown)) if shown else [()] * len(SHOWN)
    return pa.RecordBatch.from_arrays(
        [keys, pa.array([part] * len(keys), pa.int64()), pa.nulls(len(keys), pa.string()), pa.nulls(len(keys), pa.binary()),
         *[pa.array(c, k) for c, k in zip(columns, KINDS)]], names=["key", "part", "edge", "raw", *SHOWN])


def edge(part: int, side: str, key: pa.Array, raw: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([key, pa.array([part], pa.int64()), pa.array([side]), pa.array([raw], pa.binary()), *[pa.nulls(1, k) for k in KINDS]],
                                      names=["key", "part", "edge", "raw", *SHOWN])


def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shown = [compared(a, Digest(a), b, Digest(b)) for a, b in zip(batch.column("raw").to_pylist(), batch.column("following").to_pylist())]
        yield rows(0, batch.column("key"), shown).select(["key", *SHOWN])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_per_range: int = 4_000) -> DataFrame:
    """``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The next document is that of the next key, after the last one the first; a null key comes first, equal keys are in the order of a hash of their text. A
    null text is an empty one, with a fingerprint without features; a text shorter than a small run is one feature. A single row follows itself. An empty
    table gives no row. Other columns are not read. Fingerprints are base 64 of the number of features and the filters.

    Keys are cut into ranges of about ``rows_per_range`` rows: one shuffle of the texts. A task walks its range and holds few texts at a
    time; only the first and the last row of each range meet those of its neighbours afterwards.
    """
    kind = docs.schema[key].dataType.simpleString()
    ranges = max(1, -(-docs.count() // rows_per_range))
    given = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), as_bytes(text).alias("content"))
    walked = written(given.repartitionByRange(ranges, "key", "hash").sortWithinPartitions("key", "hash").select("key", "content")
                     .mapInArrow(within, f"key {kind}, part long, edge string, raw binary, {FIELDS}"), "walked")
    firsts, lasts = (walked.where(F.col("edge") == side).select("key", "part", "raw") for side in ("first", "last"))
    order = Window.orderBy("part")  # a row for each range
    neighbours = firsts.select("part").select("part", F.coalesce(
        F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("next"))
    pairs = lasts.join(neighbours, "part").join(firsts.select(F.col("part").alias("next"), F.col("raw").alias("following")), "next").select("key", "raw", "following")
    shown = walked.where("edge IS NULL").select("key", *SHOWN).union(pairs.mapInArrow(across, f"key {kind}, {FIELDS}"))
    begun = F.substring("fingerprint", 5, F.col("shared") * F.lit(BITS // 8))
    whole = F.concat(F.substring("edited_fingerprint", 1, 4), begun, F.substring("edited_fingerprint", 5, F.octet_length("edited_fingerprint")))
    return shown.select(F.col("key").alias(key), "n_chars", "edited_sha256", F.base64("fingerprint").alias("fingerprint"), F.base64(whole).alias("edited_fingerprint"), "near_edited", "near_next")
