"""Documents with nearly equal sets of word n-grams, by vertical partitioning.

*Order.* N-grams are ordered by the number of texts that hold them (in powers of two), the rare ones first, and by their 64-bit names. The numbers are summed over
blocks of texts, as packed arrays: no n-gram becomes a row. A set of ``n`` can only be similar to another by ``t`` if ``t n`` of its n-grams occur in a second text;
sets with fewer are done.

*Candidates.* Similar sets share one of their first ``n - ceil(t n) + 1`` n-grams, and a rare one if they have any: what very many texts hold comes last and is
hardly ever met on. These n-grams alone become rows.

*Verification.* All n-grams, by name, are cut into fragments, and every set into one segment for each. A pair is counted apart in every fragment; the counts are summed by pair.

Equal texts, and equal sets, are one from the start. In a group that meets on an n-gram, members are compared with the member that meets most others,
not all with all. Only where this leaves a group in several components, its other members are compared too, except those of the largest component with each other:
members of groups that overlap meet once, in blocks inside tasks, which emit no more than one link for each component they join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Names, as_bytes, lists, mixed, pieces, plain_words, runs_of, signed, written
from .components import components
from .exchange import Blocks, answered, asked, dealt, grouped, requested

FRAGMENTS = 8
BLOCK = 256


def set_of(names: Names, text: bytes, size: int) -> np.ndarray:
    """Distinct n-grams of a text in the global order; all words as one where there are fewer than ``size``."""
    words = names.of(plain_words(text.lower()))
    return np.unique(runs_of(words, min(size, len(words)), size)) if len(words) else np.empty(0, np.uint64)


def share_of(n: int, percent: int) -> int:
    """How many of its ``n`` n-grams a set has in common with any similar one, at least."""
    return -(-percent * n // 100)


def named_sets(size: int):
    """Texts to set sizes and 128-bit names of the sets; the texts go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        for batch, texts in pieces(batches, "content"):
            sets = [set_of(names, x, size) for x in texts]
            firsts = [int(mixed(g).sum(dtype=np.uint64)) for g in sets]
            seconds = [int(mixed(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) for g in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("hash"), pa.array([len(g) for g in sets], pa.int64()), pa.array(signed(np.array(firsts, np.uint64))), pa.array(signed(np.array(seconds, np.uint64))),
                 batch.column("content")], names=["hash", "n", "name", "name2", "content"])

    return run


def kept_bits(blocks: Blocks) -> np.uint64:
    """Which upper bits of a name count: enough that few n-grams of all texts fall together, in whole bytes, as the rest packs to nothing.
    N-grams that fall together are ranked by their sum, in every text alike."""
    wanted = min(64, -(-((blocks.size // 4 + 2).bit_length() + 10) // 8) * 8)
    return np.uint64((2**wanted - 1) << (64 - wanted))


def spread_of(part: int, names: list[np.ndarray], extras: list) -> tuple:
    """In how many texts each name occurs, as the number of binary digits."""
    order, first = grouped(names)
    totals = np.add.reduceat(np.concatenate(extras[0]).astype(np.int64)[order], first)
    digits = np.frexp(totals.astype(np.float64))[1].astype(np.uint8)
    out = np.empty(len(order), np.uint8)
    out[order] = np.repeat(digits, np.diff(np.append(first, len(order))))
    return (dealt(out, names),)


def candidates(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``hash, n, meets, segments`` of the texts that may be similar to others: the n-grams on which their sets meet, and all by fragment."""
    blocks = Blocks(texts, "hash", "content")
    upper, parts = kept_bits(blocks), blocks.parts

    def ask(number: int, keys: pa.Array, contents: list[bytes]) -> Iterator[pa.RecordBatch]:
        names = Names()
        found, many = np.unique(np.concatenate([set_of(names, x, size) for x in contents]) & upper, return_counts=True)
        yield from requested(number, found, parts, np.minimum(many, 255).astype(np.uint8))

    counts = written(answered(blocks.map(ask, asked(1)), [np.uint8], spread_of), "counts")

    def choose(number: int, keys: pa.Array, contents: list[bytes], reply: list[bytes]) -> Iterator[pa.RecordBatch]:
        names, spread = Names(), np.frombuffer(b"".join(reply), np.uint8)
        sets = [set_of(names, x, size) for x in contents]
        flat = np.concatenate(sets)
        _, at = np.unique(flat & upper, return_inverse=True)
        digits, ends = spread[at], np.cumsum([len(g) for g in sets])
        rows, meets, segments, lengths = [], [], [], []
        for i, (g, end) in enumerate(zip(sets, ends)):
            n, d = len(g), digits[end - len(g):end]
            if not n or np.count_nonzero(d > 1) < share_of(n, percent):
                continue
            first = np.lexsort((g, d))[:n - share_of(n, percent) + 1]
            rows.append(i)
            meets.append(g[first[d[first] > 1]])
            segments.append(g)
            edges = np.searchsorted((g >> np.uint64(32)) * np.uint64(FRAGMENTS) >> np.uint64(32), np.arange(FRAGMENTS + 1, dtype=np.uint64))
            lengths += np.diff(edges).tolist()
        none = np.empty(0, np.uint64)
        inner = lists(signed(np.concatenate([none, *segments])), lengths)
        yield pa.RecordBatch.from_arrays(
            [keys.take(pa.array(rows, pa.int64())), pa.array([len(g) for g in segments], pa.int64()), lists(signed(np.concatenate([none, *meets])), [len(m) for m in meets]),
             pa.ListArray.from_arrays(pa.array(np.arange(0, len(lengths) + 1, FRAGMENTS, dtype=np.int32)), inner)], names=["hash", "n", "meets", "segments"])

    return written(blocks.map(choose, "hash string, n long, meets array<long>, segments array<array<long>>", counts=counts), "candidates")


def links_in_blocks(percent: int):
    """Links between two blocks of a group (or within one): at most one for every member and component met."""

    def run(table: pa.Table) -> pa.Table:
        node, side = table.column("node").to_numpy(), table.column("side").to_numpy()
        root, grams = table.column("root").to_numpy(), table.column("grams").combine_chunks()
        offsets, flat = grams.offsets.to_numpy(), grams.flatten().to_numpy()
        sizes = np.diff(offsets)
        _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(node)), sizes)
        shared = often[column] > 1  # an n-gram of one member adds to no overlap
        _, column = np.unique(column[shared], return_inverse=True)
        row = row[shared]
        left, right = np.flatnonzero(side <= 1), np.flatnonzero(side != 1)
        overlap = np.zeros((len(left), len(right)), np.float32)
        place = np.zeros((2, len(node)), np.int64)
        place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
        isleft, isright = np.isin(row, left), np.isin(row, right)
        width = 8192
        for first in range(0, int(column.max(initial=-1)) + 1, width):
            here = (column >= first) & (column < first + width)
            a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
            a[place[0, row[here & isleft]], column[here & isleft] - first] = 1
            b[place[1, row[here & isright]], column[here & isright] - first] = 1
            overlap += a @ b.T
        union = sizes[left][:, None] + sizes[right][None, :] - overlap
        linked = (100 * overlap >= percent * union) & (root[left][:, None] != root[right][None, :])
        found, joined = [], {}

        def top(x):
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        for i, j in np.argwhere(linked):
            x, y = top(root[left[i]]), top(root[right[j]])
            if x != y:
                joined[max(x, y)] = min(x, y)
                found.append((node[left[i]], node[right[j]]))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """``pairs`` of (a, b, na, nb) with the sum of the overlaps counted in each fragment."""
    left = parts.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("x"))
    right = parts.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("y"))
    return (pairs.join(left, "a").join(right, ["b", "fragment"])
            .groupBy("a", "b", "na", "nb").agg(F.sum(F.size(F.array_intersect("x", "y"))).alias("overlap")))


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """``key, n_shingles, component_id``: documents linked where ``100 * intersection >= percent * union`` of their n-gram sets.

    Words lie between ASCII white space, A-Z in lower case; the set of a text of fewer than ``size`` words is its whole sequence. ``component_id``
    is the smallest key that a document reaches by links, itself included. A null or blank text has an empty set and links with nothing. Repeated rows
    are linked with each other (they have equal sets), and each keeps its row; rows with a null key link too, and reach the
    smallest key there is. Other columns are not read. An empty table gives no row.
    """
    content = as_bytes(text)
    rows = written(docs.select(F.col(key).alias("key"), F.md5(content).alias("hash")), "rows")
    # each distinct text moves once: copies fall together before the shuffle
    texts = docs.select(F.md5(content).alias("hash"), content.alias("content")).groupBy("hash").agg(F.any_value("content").alias("content"))
    texts = written(texts.mapInArrow(named_sets(size), "hash string, n long, name long, name2 long, content binary"), "texts")
    sets = texts.select("hash", "n", "name", "name2")
    # equal sets are one node, numbered once as the table is written, with one text that stands for all
    nodes = written(sets.where("n > 0").groupBy("n", "name", "name2").agg(F.min("hash").alias("hash")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    chosen = written(candidates(texts.where("n > 0").select("hash", "content"), size, percent).join(nodes.select("hash", "node"), "hash").drop("hash"), "chosen")
    meeting = chosen.select("node", "n", F.explode("meets").alias("meet"))
    shared = written(meeting.join(meeting.groupBy("meet").count().where("count > 1"), "meet"), "shared")
    known = shared.groupBy("node").agg(F.sum("count").alias("known"))
    members = written(shared.join(known, "node"), "members")
    hubs = members.groupBy("meet").agg(F.max_by(F.struct(F.col("node").alias("hub"), F.col("n").alias("nh")), F.struct("known", "node")).alias("h"))
    grouped_by = members.join(hubs, "meet").select("meet", "node", "n", F.col("h.hub").alias("hub"), F.col("h.nh").alias("nh"))
    near = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    pairs = written(grouped_by.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"), F.col("nh").alias("na"), F.col("n").alias("nb"))
                    .where(near).distinct(), "pairs")
    parts = chosen.select("node", F.posexplode("segments").alias("fragment", "grams")).where(F.size("grams") > 0)
    links = written(overlaps(pairs, parts).where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b"), "links")
    found = written(components(links), "found")

    # groups that are still apart, without their hubs, which met every member
    rooted = grouped_by.where("node <> hub").join(found, "node", "left").select("meet", "node", F.coalesce("root", "node").alias("root"))
    apart = rooted.groupBy("meet").agg(F.min("node").alias("first"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    left = written(rooted.join(apart.select("meet", "first"), "meet"), "left")
    if not left.isEmpty():
        # members that groups share are brought together once, however many groups they share
        clusters = components(left.select(F.col("first").alias("a"), F.col("node").alias("b"))).select("node", F.col("root").alias("cluster"))
        joined = written(left.select("node", "root").distinct().join(clusters, "node"), "clusters")
        # the largest component of a cluster is connected already: its members meet the others only
        sizes = joined.groupBy("cluster", "root").count()
        largest = sizes.groupBy("cluster").agg(F.max_by(F.struct(F.col("root").alias("main"), F.col("count").alias("inside")), F.struct("count", "root")).alias("m"), F.sum("count").alias("all"))
        blocks = lambda rows: F.ceil(rows / F.lit(BLOCK)).cast("int")
        many = largest.select("cluster", "m.main", blocks(F.col("m.inside")).alias("inner"), blocks(F.col("all") - F.col("m.inside")).alias("outer"))
        wholes = chosen.select("node", F.flatten("segments").alias("grams"))
        inside = F.col("root") == F.col("main")
        at = lambda count: F.pmod(F.xxhash64("node"), count).cast("int")
        dealt_out = joined.join(many, "cluster").join(wholes, "node").withColumn("block", F.when(inside, F.col("outer") + at(F.col("inner"))).otherwise(at(F.col("outer"))))
        # outer blocks meet every block once, themselves included: side 1 and 2 of a meeting, 0 where both are the same block
        last = F.when(inside, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
        placed = dealt_out.select("cluster", "node", "root", "grams", F.explode(F.transform(
            F.sequence(F.lit(0), last),
            lambda other: F.struct(F.least("block", other).alias("one"), F.greatest("block", other).alias("two"),
                                   F.when(F.col("block") == other, 0).when(F.col("block") < other, 1).otherwise(2).alias("side")))).alias("w"))
        more = (placed.select("cluster", "w.one", "w.two", "w.side", "node", "root", "grams")
                .groupBy("cluster", "one", "two").applyInArrow(links_in_blocks(percent), "a long, b long"))
        found = components(links.union(written(more, "more")))
    rooted = nodes.select("node", "n", "name", "name2").join(found, "node", "left").select("n", "name", "name2", F.coalesce("root", "node").alias("root"))
    of_text = sets.where("n > 0").join(rooted, ["n", "name", "name2"]).select("hash", "n", "root")
    placed_rows = written(rows.join(of_text, "hash", "left").select("key", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "root"), "rooted")
    smallest = placed_rows.where("root IS NOT NULL").groupBy("root").agg(F.min("key").alias("component_id"))
    return (placed_rows.where("root IS NOT NULL").join(smallest, "root").select("key", "n", "component_id")
            .union(placed_rows.where("root IS NULL").select("key", "n", F.col("key")))
            .select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id"))
