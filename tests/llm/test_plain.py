"""Second versions, in plain loops, of what the quality model, the fingerprints and the main text compute with arrays."""

import math
from bisect import bisect_right
from collections import Counter

import numpy as np
import pytest

from foliant.llm import digest, quality
from foliant.llm.htmltext import content_lines, main_text, smoothed

FOLDER = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- quality
def plain_steps(gradient, weight, leaves=4, least=5.0):
    """Cuts found one after the other by trying every place of every piece."""
    edges = [0, len(gradient)]
    total = lambda v, a, b: math.fsum(v[a:b])
    worth = lambda a, b: total(gradient, a, b) ** 2 / (total(weight, a, b) + 1.0)
    for _ in range(leaves - 1):
        best, place = 1e-9, None
        for a, b in zip(edges, edges[1:]):
            for at in range(a + 1, b):
                if total(weight, a, at) >= least / 4 and total(weight, at, b) >= least / 4:
                    gain = worth(a, at) + worth(at, b) - worth(a, b)
                    if gain > best + 1e-12:
                        best, place = gain, at
        if place is None:
            break
        edges = sorted([*edges, place])
    out = []
    for a, b in zip(edges, edges[1:]):
        out += [total(gradient, a, b) / (total(weight, a, b) + 1.0)] * (b - a)
    return out


def plain_quarters(gradient, weight):
    """The best of all pairs of cuts of a grid."""
    n, m = gradient.shape
    best = (-1.0, None)
    for i in range(1, n):
        for j in range(1, m):
            parts = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, m)), (slice(i, n), slice(0, j)), (slice(i, n), slice(j, m))]
            gain = sum(gradient[p].sum() ** 2 / (weight[p].sum() + 1.0) for p in parts)
            if gain > best[0] + 1e-12:
                best = gain, parts
    out = np.zeros((n, m))
    for p in best[1]:
        out[p] = gradient[p].sum() / (weight[p].sum() + 1.0)
    return out, best[0]


def test_trees_are_the_best_of_all_cuts():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 9, 20):
        for _ in range(15):
            g, h = rng.normal(size=n) * 5, rng.random(n) * 4
            assert quality.steps(g, h) == pytest.approx(plain_steps(g.tolist(), h.tolist()), abs=1e-9)
    for _ in range(25):
        g, h = rng.normal(size=(5, 6)), rng.random((5, 6))
        got, gain = quality.quarters(g, h)
        want, best = plain_quarters(g, h)
        assert gain == pytest.approx(best) and got == pytest.approx(want, abs=1e-9)


def test_scores_are_sums_of_table_entries(spark):
    """Scores of the whole table again, row by row: a bin by search in the cut points, one entry of each table, a logistic curve."""
    from foliant.llm.queries import held_out

    docs, labels = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels"))
    model = quality.learn(docs, labels, held_out=held_out)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.scored(docs.select("doc_id", "text"), model).collect()}
    for r in docs.select("doc_id", "text").collect():
        x = quality.described((r["text"] or "").encode())
        bins = [bisect_right(c.tolist(), v) for c, v in zip(model.cuts, x)]
        total = model.start + sum(float(t[b]) for t, b in zip(model.tables, bins))
        total += sum(float(t[model.coarse[i][bins[i]], model.coarse[j][bins[j]]]) for (i, j), t in model.pairs.items())
        p = 1 / (1 + math.exp(-max(-40, min(40, total))))
        assert got[r["doc_id"]] == (pytest.approx(p, abs=1e-9), int(p >= 0.3))
    assert len(model.pairs) == 10 and len(got) == docs.count()


# ---------------------------------------------------------------- fingerprints
MASK = 2**64 - 1


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def plain_names(raw):
    """Features of a text, window by window."""
    n = len(raw)
    small = []
    if 5 <= n < 512:
        share = min(1.0, (512 - n) / 256)
        small = [x for i in range(n - 4) if (x := mix(int.from_bytes(raw[i:i + 5], "little") + (1 << 40))) >> 32 < int(share * 2**32)]
    places = []
    if n >= 32:
        uneven = []
        for i in range(n - 31):
            uneven.append(sum(round(1000 * c * math.log2(c)) if c > 1 else 0 for c in Counter(raw[i:i + 32]).values()))
        rare = [((1 << 20) - abs(u - 48_000), i) for i, u in enumerate(uneven)]  # the least is the rarest, the first of several
        if len(rare) <= 32:
            places = [min(rare)[1]]
        else:
            points = Counter(min(rare[i:i + 32])[1] for i in range(len(rare) - 31))
            places = sorted(i for i, p in points.items() if p >= 8)
            if not places:
                most = max(points.values())
                places = [min(i for i, p in points.items() if p == most)]
    names = []
    for i in places:
        x = 0
        for k in range(0, 32, 8):
            x = mix((x * 0xD6E8FEB86659FD93 + int.from_bytes(raw[i + k:i + k + 8], "little")) & MASK)
        names.append(x)
    return list(dict.fromkeys(names + small))


def plain_filters(names):
    return [{x >> 11 * i & 2047 for x in names[a:a + 160] for i in range(5)} for a in range(0, len(names), 160)]


def plain_likeness(one, other):
    if len(one) == len(other) and plain_filters(one) == plain_filters(other):
        return 1.0
    if not one or not other:
        return 0.0

    def best(x, filters):
        def beyond(y):
            chance, most = len(x) * len(y) / 2048, min(len(x), len(y))
            return min(1.0, max(0.0, (len(x & y) - chance) / max(most - chance, 1)))

        return max(map(beyond, filters))

    total = weight = 0.0
    for a, b in ((one, other), (other, one)):
        for i, x in enumerate(plain_filters(a)):
            size = min(160, len(a) - 160 * i)
            total, weight = total + size * best(x, plain_filters(b)), weight + size
    return total / weight


def test_fingerprints_window_by_window():
    rng = np.random.default_rng(7)
    texts = [b"", b"x", b"abcd", b"abcde", b"=" * 400, ("-" * 50 + "\n").encode() * 30]
    texts += ["".join(rng.choice(list("abcdefgh  .é"), int(n)).tolist()).encode() for n in (20, 31, 32, 40, 63, 64, 200, 256, 300, 500, 511, 512, 900, 3000)]
    digests = [digest.Digest(t) for t in texts]
    for t, d in zip(texts, digests):
        assert sorted(d.names.tolist()) == sorted(plain_names(t)) if len(t) >= 5 else len(d.names) <= 1, t[:40]
    usable = [(t, d) for t, d in zip(texts, digests) if len(t) >= 5]
    for (t, d), (u, e) in zip(usable, usable[1:]):
        assert d.names.tolist() == plain_names(t)
        assert d.like(e) == pytest.approx(plain_likeness(plain_names(t), plain_names(u)))
        cut = digest.Digest(t[:-max(1, len(t) // 10)] + b"other")
        assert d.like(cut) == pytest.approx(plain_likeness(plain_names(t), cut.names.tolist()))


# ---------------------------------------------------------------- main text
def plain_content(lines):
    """Text-to-tag ratios, smoothed by a Gaussian of three lines on either side, against their standard deviation."""
    ratio = [max(0, len(text) - linked) / max(1, tags) for text, _, tags, linked in lines]
    smooth = []
    for i in range(len(ratio)):
        near = [(math.exp(-(j - i) ** 2 / 2), ratio[j]) for j in range(max(0, i - 3), min(len(ratio), i + 4))]
        smooth.append(math.fsum(w * r for w, r in near) / math.fsum(w for w, _ in near))
    mean = math.fsum(smooth) / len(smooth)
    spread = math.sqrt(math.fsum((x - mean) ** 2 for x in smooth) / len(smooth))
    return smooth, min(spread, max(smooth))


def test_ratios_smoothing_and_threshold():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 4, 7, 30, 200):
        for _ in range(10):
            lines = [("x" * int(rng.choice([0, 3, 20, 90, 400])), 0, int(rng.integers(0, 6)), int(rng.choice([0, 0, 3, 50]))) for _ in range(n)]
            smooth, least = plain_content(lines)
            ratio = np.array([max(0, len(t) - linked) / max(1, tags) for t, _, tags, linked in lines])
            assert smoothed(ratio) == pytest.approx(smooth)
            got = content_lines(lines)
            assert all(g == (s >= least) for g, s in zip(got, smooth) if abs(s - least) > 1e-9)


def test_a_page_without_names_or_articles():
    """Nothing but ratios tells the text from the links around it."""
    paragraphs = [f"Sentence {i} of the story goes on for quite a while, so that a line of it is long." for i in range(8)]
    links = "".join(f"<div><a href=/{i}>link {i}</a></div>" for i in range(12))
    page = f"<html><body><div>{links}</div><div><h1>A story</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div><div>{links}</div></body></html>"
    assert main_text(page) == "A story " + " ".join(paragraphs)
