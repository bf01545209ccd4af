"""Long repeats between documents, by recompression.

A sequence of words is parsed level by level: runs of one symbol become a symbol, then symbols are split into left and right ones by their names and each left
symbol followed by a right one becomes a pair. Names are functions of content alone, so equal stretches of text anywhere get equal symbols,
but for a margin in which the parse also depends on what stands beside. For each symbol the stretch is known that determines it.

A window of words thus holds the same symbols wherever it occurs: those whose stretch lies inside. The highest of them (the first of several) is its anchor.
First all documents exchange anchors; only windows whose anchor occurs in two documents are then named in full and exchanged, with the
smallest document that holds them. Documents are handled in blocks: a block sends each name once, whatever the number of its documents that
hold it, so a passage in every document is as cheap as any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Names, mixed, plain_words, written
from .exchange import Blocks, answered, asked, dealt, grouped, once, repeated_again, requested

LEVELS = 4
#: Runs are named among words only: each naming of runs widens what determines a symbol by a symbol on either side.
RUNS_AT = (1,)
FAR = 1 << 40


def parsed(names: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of the parse of documents that stand one after the other, lowest first: symbols, first and last place of the stretch that determines each.

    ``ends`` marks the place after each document, which holds no word: what depends on it depends on what lies beyond.
    """
    symbol = names.copy()
    low = np.arange(len(names), dtype=np.int64)
    high = low + 1
    low[ends], high[ends] = -FAR, FAR
    stop = ends.copy()
    yield symbol, low, high
    for level in range(1, LEVELS + 1):
        if level in RUNS_AT:
            # runs of one symbol; a symbol is a run only because its neighbours differ, so both belong to what determines it
            new = np.ones(len(symbol), bool)
            new[1:] = (symbol[1:] != symbol[:-1]) | stop[1:] | stop[:-1]
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(symbol)))
            last = first + count - 1
            run = symbol[first]
            longer = count > 1
            run[longer] = mixed(run[longer] * np.uint64(0x9E3779B97F4A7C15) + count[longer].astype(np.uint64) + np.uint64(level << 32))
            before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(symbol) - 1)
            low, high = np.minimum(low[before], low[first]), np.maximum(high[after], high[last])
            if len(first):
                low[0] = -FAR
            symbol, stop = run, stop[first]
            low[stop], high[stop] = -FAR, FAR
        # pairs of a left and a right symbol
        right = (mixed(symbol ^ np.uint64(level * 0x632BE59BD9B4E019 % 2**64)) >> np.uint64(63)).astype(bool)
        n = len(symbol)
        opens = np.zeros(n, bool)
        opens[:-1] = ~right[:-1] & right[1:] & ~stop[:-1] & ~stop[1:]
        closes = np.zeros(n, bool)
        closes[1:] = opens[:-1]
        following, preceding = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
        # a left symbol stays alone because of the next, a right one because of the one before
        lone_low = np.where(right, np.minimum(low, low[preceding]), low)
        lone_high = np.where(right, high, np.maximum(high, high[following]))
        pair = mixed(mixed(symbol * np.uint64(0xD6E8FEB86659FD93) + np.uint64(level)) + symbol[following])
        symbol = np.where(opens, pair, symbol)[~closes]
        low, high = np.where(opens, low, lone_low)[~closes], np.where(opens, np.maximum(high, high[following]), lone_high)[~closes]
        stop = stop[~closes]
        low[stop], high[stop] = -FAR, FAR
        yield symbol, low, high


class Block:
    """Words of a block of documents, one after the other, with a place between; windows by first place."""

    def __init__(self, names: Names, texts: list[bytes], width: int):
        self.words = [plain_words(t) for t in texts]
        self.counts = np.array([len(w) for w in self.words], np.int64)
        flat = [np.append(names.of(w), np.uint64(0)) for w in self.words]
        self.names = np.concatenate(flat) if flat else np.empty(0, np.uint64)
        self.firsts = np.cumsum(self.counts + 1) - self.counts - 1
        self.ends = np.zeros(len(self.names), bool)
        self.ends[self.firsts + self.counts] = True
        self.doc = np.repeat(np.arange(len(texts)), self.counts + 1)
        self.width = width
        whole = np.zeros(len(self.names), bool)
        many = np.maximum(self.counts - width + 1, 0)
        starts = np.repeat(self.firsts, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        whole[starts] = True
        self.starts = starts

    def anchors(self) -> np.ndarray:
        """Name of the anchor of each window."""
        out, open_ = np.zeros(len(self.starts), np.uint64), np.ones(len(self.starts), bool)
        for level, (symbol, low, high) in reversed(list(enumerate(parsed(self.names, self.ends)))):
            usable = (high - low <= self.width) & (low >= 0)
            symbol, low, high = symbol[usable], low[usable], high[usable]
            if not len(symbol) or not open_.any():
                continue
            at = self.starts[open_]
            k = np.minimum(np.searchsorted(low, at), len(low) - 1)
            fits = (low[k] >= at) & (high[k] <= at + self.width)
            which = np.flatnonzero(open_)[fits]
            out[which] = mixed(symbol[k[fits]] + np.uint64(level + 1))
            open_[which] = False
        return out

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two names of the windows ``chosen`` by their first places: 64 and 32 bits."""
        one, two = np.zeros(len(chosen), np.uint64), np.full(len(chosen), 0x2545F4914F6CDD1D, np.uint64)
        for i in range(self.width):
            word = self.names[chosen + i]
            one = mixed(one * np.uint64(0xD6E8FEB86659FD93) + word)
            two = (two ^ word) * np.uint64(0x9E3779B97F4A7C15)
            two ^= two >> np.uint64(29)
        return one, (mixed(two) >> np.uint64(32)).astype(np.uint32)


def keys_as_numbers(keys: pa.Array) -> np.ndarray:
    """A null key is larger than all others: nothing is removed for its sake."""
    return pa.compute.fill_null(keys.cast(pa.int64()), np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def candidates(block: Block, keys: np.ndarray, shared: list[bytes]):
    """Windows of a block whose anchors occur in several documents: first places, their distinct names and which each has, and the smallest key of each name."""
    names, which = np.unique(block.anchors(), return_inverse=True)
    flags = np.frombuffer(b"".join(shared), np.uint8).astype(bool)
    places = block.starts[flags[which]] if len(names) else block.starts
    one, two = block.windows(places)
    distinct, first, name = np.unique(one, return_index=True, return_inverse=True)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, name, keys[block.doc[places]])
    return places, distinct, two[first], name, least


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 13, with_text: bool = True) -> DataFrame:
    """``key, n_words, n_removed, kept_sha256`` and, if asked for, the ``kept`` text of every row.

    Words lie between ASCII white space. Words covered by a window of ``width`` words that also starts in a document of a smaller key go; windows are those of the
    input. Kept words are joined by one space. ``key`` is a whole number. Rows of equal keys are not compared with each other; rows that repeat are handled once and get equal results; a row with a null key loses
    what any keyed document holds and takes nothing from others. Null and short texts lose nothing. An empty table gives no row. Other
    columns are not read.
    """
    rows = once(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text")
    blocks = Blocks(rows.select(F.struct("key", "many").alias("id"), "text"), "id", "text")
    parts = blocks.parts
    number_of = lambda ids: keys_as_numbers(ids.field("key"))

    def ask_anchors(number: int, ids: pa.Array, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        block = Block(Names(), texts, width)
        names, which = np.unique(block.anchors(), return_inverse=True)
        order = number_of(ids)[block.doc[block.starts]]
        low, high = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.iinfo(np.int64).min)
        np.minimum.at(low, which, order)
        np.maximum.at(high, which, order)
        yield from requested(number, names, parts, (low < high).astype(np.uint8))

    def in_several(part: int, names: list[np.ndarray], extras: list) -> tuple:
        order, first = grouped(names)
        many = np.diff(np.append(first, len(order)))
        inside = np.maximum.reduceat(np.concatenate(extras[0])[order], first)
        flags = np.empty(len(order), np.uint8)
        flags[order] = np.repeat((many > 1) | (inside > 0), many)
        return (dealt(flags, names),)

    shared = written(answered(blocks.map(ask_anchors, asked(1)), [np.uint8], in_several), "anchors")

    def ask_windows(number: int, ids: pa.Array, texts: list[bytes], flags: list[bytes]) -> Iterator[pa.RecordBatch]:
        _, distinct, second, _, least = candidates(Block(Names(), texts, width), number_of(ids), flags)
        yield from requested(number, distinct, parts, second, least)

    def held_before(part: int, names: list[np.ndarray], extras: list) -> tuple:
        flat, second, least = np.concatenate(names), np.concatenate(extras[0]), np.concatenate(extras[1])
        order = np.lexsort((second, flat))
        a, b = flat[order], second[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        smallest = np.repeat(np.minimum.reduceat(least[order], first), np.diff(np.append(first, len(order))))
        flags = np.empty(len(order), np.uint8)
        flags[order] = smallest < least[order]
        return (dealt(flags, names),)

    before = written(answered(blocks.map(ask_windows, asked(2), shared=shared), [np.uint32, np.int64], held_before), "windows")

    def cut(number: int, ids: pa.Array, texts: list[bytes], flags: list[bytes], smaller: list[bytes]) -> Iterator[pa.RecordBatch]:
        block, order = Block(Names(), texts, width), number_of(ids)
        places, _, _, name, least = candidates(block, order, flags)
        elsewhere = np.frombuffer(b"".join(smaller), np.uint8).astype(bool)
        gone = places[elsewhere[name] | (order[block.doc[places]] > least[name])]
        depth = np.bincount(gone, minlength=len(block.names) + width + 1) - np.bincount(gone + width, minlength=len(block.names) + width + 1)
        covered = np.cumsum(depth) > 0
        removed, kept = [], []
        for i, own in enumerate(block.words):
            at = int(block.firsts[i])
            out = covered[at:at + len(own)]
            lost = int(out.sum())
            removed.append(lost)
            kept.append(b" ".join(own if not lost else [w for w, x in zip(own, out.tolist()) if not x]))
        columns = [ids.field("key"), ids.field("many"), pa.array(block.counts), pa.array(removed, pa.int64()), pa.array([sha256(x).hexdigest() for x in kept])]
        if with_text:
            columns.append(pa.array([x.decode("utf-8", "replace") for x in kept]))
        yield pa.RecordBatch.from_arrays(columns, names=["key", "many", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    fields = f"key {docs.schema[key].dataType.simpleString()}, many long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return repeated_again(blocks.map(cut, fields, shared=shared, before=before)).withColumnRenamed("key", key)
