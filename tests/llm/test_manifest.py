"""The manifest against a plain tree over lists, for blocks of several heights, and the layout's arithmetic."""

from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import SCHEMA, awkward, rows_of

from foliant.llm.manifest import FANOUT, built, folded, manifest, place, row_digest, siblings, size_of


def digest(text):
    return sha256(text.encode()).hexdigest()


def spell(*values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The last node, and for every leaf the digests before and after it, level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for w, i in zip(ways, at):
            first = i // 8 * 8
            w.append(("".join(nodes[first:i]), "".join(nodes[i + 1:first + 8])))
        nodes = [digest("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], ways


def plainly(rows):
    """Rows of (group, key, leaf, found) to the rows of the manifest."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        trees[g] = tree([r[2] for r in groups[g]])
    root, over = tree([trees[g][0] for g in names])
    out = []
    for g, above in zip(names, over):
        for r, way in zip(groups[g], trees[g][1]):
            end = r[3]
            for a, b in way + above:
                end = digest(a + end + b)
            out.append((r[1], r[2], trees[g][0], root, digest("".join(a + b for a, b in way + above)), end, end == root))
    return out


NAMES = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def compared(spark, rows, **how):
    frame = spark.createDataFrame([(g, k, leaf, None if found == leaf else found, "x", 1) for g, k, leaf, found in rows], "lang string, id long, d string, t string, rank string, part long").repartition(3)
    got = Counter(tuple(None if v != v else v for v in (r["id"], *[r[c] for c in NAMES])) for r in rows_of(manifest(frame, "id", F.col("lang"), F.col("d"), F.col("t"), **how)))
    assert got == Counter(plainly(rows))


@pytest.mark.parametrize("height, sizes", [(1, (1, 7, 8, 9, 65)), (2, (64, 65, 300)), (4, (1, 2, 700)), (1, (1,)), (1, (1,) * 70), (3, (513, 1))])
def test_against_a_plain_tree(spark, height, sizes):
    rows = []
    for n, many in enumerate(sizes):
        group = None if n == 1 else f"g{n % 50}é"
        rows += [(group, k * 3 - 20, digest(f"{n}:{k}"), digest(f"{n}:{k}") if k % 3 else digest("other")) for k in range(many)]
    compared(spark, rows, height=height, rows_per_range=100)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [("a", 1, digest("x"), digest("x"))] * 30 + [("a", None, digest("y"), digest("z"))] * 20 + [("a", 1, digest("w"), digest("w")), (None, None, digest("x"), digest("x")), ("", 5, digest("q"), digest("q"))]
    compared(spark, rows, height=1, rows_per_range=7)


def test_awkward_rows(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    got = rows_of(manifest(docs, "doc_id", F.col("lang"), row_digest(*[F.col(c) for c in columns])))
    rows = [(r["lang"], r["doc_id"], spell(*[r[c] for c in columns])) for r in docs.collect()]
    want = Counter(plainly([(*r, r[2]) for r in rows]))
    assert Counter(tuple(None if v != v else v for v in (r["doc_id"], *[r[c] for c in NAMES])) for r in got) == want and all(r["verified"] for r in got)
    assert manifest(docs.limit(0), "doc_id", F.col("lang"), row_digest(F.col("text"))).count() == 0


def test_layout():
    for levels in range(1, 6):
        at = [place(levels, d, np.arange(FANOUT**d)) for d in range(levels)]
        assert sorted(np.concatenate(at).tolist()) == list(range(size_of(levels)))
        upper = levels // 2
        if upper:  # the upper part comes first, then each lower subtree as one stretch
            assert max(int(a.max()) for a in at[:upper]) == size_of(upper) - 1
            for k in range(FANOUT**upper):
                below = np.concatenate([at[d][k * FANOUT ** (d - upper):(k + 1) * FANOUT ** (d - upper)] for d in range(upper, levels)])
                first = size_of(upper) + k * size_of(levels - upper)
                assert sorted(below.tolist()) == list(range(first, first + size_of(levels - upper)))


def test_blocks():
    for height, many in ((0, 1), (1, 1), (1, 5), (2, 64), (3, 77), (4, 4096)):
        leaves = [digest(str(i)).encode() for i in range(many)]
        nodes = built(leaves, height)
        assert len(nodes) <= size_of(height + 1)
        for i in range(0, many, max(1, many // 50)):
            steps = siblings(nodes, height, many, i)
            assert len(steps) == height and folded(leaves[i], steps) == nodes[0]
    assert len(built([b"0" * 64], 4)) < size_of(5)  # places after the last in use are cut off
