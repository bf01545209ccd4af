"""Benchmark passages in documents, by a prefix-filtered set join.

Every item is cut into windows of ``width`` words, every window into overlapping shingles. A document contains a window only if it holds all
shingles of the window, so one of them is enough to find it: the rarest. The join takes only that prefix token; length and
position bounds drop what cannot hold the window; the item-sized stretch around the token is then compared shingle by shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Names, as_bytes, letter_words, lists, pieces, runs_of, signed, written

SHINGLE = 3
#: Slots of the filter that goes to every task: 2 MB whatever the size of the benchmark. A full filter costs rows, not results.
SLOTS = 1 << 24

def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def windows_of(width: int):
    """Items to windows: ``kind`` words in a shingle, and the window as the list of its shingles."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        for batch, texts in pieces(batches, "content"):
            owner, kinds, many, flat = [], [], [], [np.empty(0, np.int64)]
            for i, text in enumerate(texts):
                words = names.of(letter_words(text))
                if not len(words):
                    continue
                length = min(width, len(words))
                kind = min(SHINGLE, length)
                windows = np.lib.stride_tricks.sliding_window_view(signed(runs_of(words, kind, kind)), length - kind + 1)
                owner += [i] * len(windows)
                kinds += [kind] * len(windows)
                many += [length - kind + 1] * len(windows)
                flat.append(windows.ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(pa.array(owner, pa.int64())), pa.array(kinds, pa.int32()), lists(np.concatenate(flat), many)],
                names=["item", "kind", "window"])

    return cut


def finder(slots: bytes, kinds: list[tuple[int, int, int]]):
    """Documents to one row with their number of words, and a row for each shingle that may be part of a window.

    ``kinds`` has, for each shingle size, the shortest and the longest window in shingles. A shingle is kept if as many as the
    shortest window has follow each other; ``near`` holds the stretch around it that the longest window can cover, 0 where nothing is kept.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(slots, np.uint8)).view(bool)
        names, row = Names(), TaskContext.get().partitionId() << 40
        for batch, texts in pieces(batches, "content"):
            counts = np.zeros(len(texts), np.int64)
            owner, places, sizes, shingled, stretches, lengths = [], [], [], [], [], []
            for i, text in enumerate(texts):
                words = names.of(letter_words(text))
                counts[i] = len(words)
                for kind, shortest, longest in kinds:
                    shingles = runs_of(words, kind, kind)
                    held = wanted[(shingles & np.uint64(SLOTS - 1)).astype(np.int64)]
                    if not held.any():
                        continue
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], held.view(np.int8), [0]))))
                    for start, stop in zip(edges[::2], edges[1::2]):
                        if stop - start < shortest:
                            held[start:stop] = False
                    at = np.flatnonzero(held)
                    if not len(at):
                        continue
                    around = np.zeros(len(held) + 2 * (longest - 1), np.int64)
                    around[longest - 1:longest - 1 + len(held)] = np.where(held, signed(shingles), 0)
                    owner.append(np.full(len(at), i))
                    places.append(at)
                    sizes.append(np.full(len(at), kind, np.int32))
                    shingled.append(signed(shingles)[at])
                    stretches.append(np.lib.stride_tricks.sliding_window_view(around, 2 * longest - 1)[at].ravel())
                    lengths += [2 * longest - 1] * len(at)
            n, rows = len(texts), np.arange(row, row + len(texts))
            row += n
            whole = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts])
            owners = np.concatenate((np.arange(n), whole(owner, np.int64))).astype(np.int64)
            none = np.arange(len(owners)) < n
            blank = lambda parts, kind: pa.array(np.concatenate((np.zeros(n, kind), whole(parts, kind))), mask=none)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(owners)), pa.array(rows[owners]), pa.array(counts[owners]), blank(places, np.int64), blank(sizes, np.int32),
                 blank(shingled, np.int64), lists(whole(stretches, np.int64), [0] * n + lengths)],
                names=["key", "row", "n_words", "at", "kind", "shingle", "near"])

    return find


def contaminated(docs: DataFrame, items: DataFrame, width: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """Documents with what they share with the items: ``key, n_words, n_hit, n_items, items, spans``.

    Words are runs of ASCII letters and digits or characters beyond ASCII, with A-Z in lower case. ``spans`` are the (start, length)
    of the windows found, ``items`` the ids of their items in ascending order. A null or empty text has no words and is no item; an item
    of fewer than ``width`` words is one window; an empty benchmark hits nothing. Repeated rows are judged one by one, null keys
    too. Items with equal windows are all named; an item without an id hits but is not named. Other columns are not read.
    """
    cut = written(items.select(F.col(item).alias("item"), as_bytes(item_text).alias("content"))
                  .mapInArrow(windows_of(width), f"item {type_of(items, item)}, kind int, window array<long>"), "windows")
    distinct = written(cut.select("kind", "window").distinct().withColumn("name", F.sha2(F.to_json("window"), 256)), "distinct")
    slots = np.zeros(SLOTS, bool)
    shingle_rows = distinct.select("kind", F.explode("window").alias("shingle"))
    # as many rows as the filter has slots at most
    for part in shingle_rows.select(F.pmod("shingle", F.lit(SLOTS)).alias("slot")).distinct().toLocalIterator():
        slots[part["slot"]] = True
    sizes = distinct.groupBy("kind").agg(F.min(F.size("window")).alias("least"), F.max(F.size("window")).alias("most")).collect()  # 3 rows at most
    kinds = [(r["kind"], r["least"], r["most"]) for r in sorted(sizes, key=lambda r: r["kind"])]
    longest = F.create_map(*[F.lit(x) for k, _, most in kinds for x in (k, most)]) if kinds else None

    found = written(docs.select(F.col(key).alias("key"), as_bytes(text).alias("content")).mapInArrow(
        finder(np.packbits(slots).tobytes(), kinds),
        f"key {type_of(docs, key)}, row long, n_words long, at long, kind int, shingle long, near array<long>"), "hits")
    rows = found.where("at IS NULL").select("row", F.col("key").alias(key), "n_words")
    nobody = F.array().cast(f"array<{type_of(items, item)}>")
    if not kinds:
        return rows.select(key, "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"),
                           nobody.alias("items"), F.array().cast("array<struct<start:bigint,length:int>>").alias("spans"))
    hits = found.where("at IS NOT NULL")
    rarity = hits.groupBy("kind", "shingle").count()
    # the prefix of a window for whole containment: its rarest shingle; one that no document holds ends the window
    tokens = distinct.select("kind", "name", "window", F.posexplode("window").alias("place", "shingle")).join(rarity, ["kind", "shingle"])
    prefix = tokens.groupBy("kind", "name").agg(
        F.min_by(F.struct("shingle", "place", "window"), F.struct("count", "shingle", "place")).alias("p"), F.count("*").alias("known")).where(
        F.col("known") == F.size("p.window")).select("kind", "name", F.col("p.shingle").alias("shingle"), F.col("p.place").alias("place"), F.col("p.window").alias("window"))
    size = F.size("window")
    start = F.col("at") - F.col("place")
    span = size + F.col("kind") - 1
    met = (hits.join(prefix, ["kind", "shingle"])
           .where((start >= 0) & (start + span <= F.col("n_words")))
           .where(F.slice("near", longest[F.col("kind")] - F.col("place"), size) == F.col("window"))
           .select("row", "name", start.alias("start"), span.alias("length")))
    met = written(met, "met")
    by_row = met.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit")),
        lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["length"]).alias("end"),
                              (a["hit"] + F.greatest(F.lit(0).cast("long"), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))).alias("hit")),
        lambda a: a["hit"])
    named = (met.select("row", "name").distinct()
             .join(cut.where("item IS NOT NULL").select("item", F.sha2(F.to_json("window"), 256).alias("name")).distinct(), "name")
             .groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items")))
    return (rows.join(by_row, "row", "left").join(named, "row", "left")
            .select(key, "n_words", F.coalesce(covered, F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("items", nobody).alias("items"),
                    F.coalesce("spans", F.array().cast("array<struct<start:bigint,length:int>>")).alias("spans")))
