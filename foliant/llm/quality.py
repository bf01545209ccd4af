"""Quality of texts by a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after the other, round after round; each visit grows a tree of at most four leaves on that feature alone
and adds a fraction of it to the feature's lookup table. Pairs of features that explain most of what is left then get tables of
their own in the same way. Scoring looks up one bin per table and adds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, pieces, plain_words

FEATURES = ("bytes words word_length length_spread upper digits marks exclaims bars symbols blanks newlines high stops capitalised marked_words "
            "distinct_words top_word short_words long_words distinct_lines line_words entropy longest_run distinct_pairs").split()
SYMBOLS = np.frombuffer(b"#$%&*@^~+=<>_{}[]\\/", np.uint8)
MARKS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
ALNUM_END = frozenset(b for b in range(256) if b >= 128 or chr(b).isalnum())


def described(text: bytes) -> list[float]:
    """Features of one whole text, all finite, also of an empty one. Language, source and id take no part."""
    n = len(text)
    codes = np.frombuffer(text, np.uint8)
    seen = np.bincount(codes, minlength=256)
    words = plain_words(text)
    m = len(words)
    sizes = np.fromiter(map(len, words), np.int64, m)
    kinds = set(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = seen[seen > 0] / max(n, 1)
    runs = np.flatnonzero(np.diff(codes)) if n else np.empty(0, np.int64)
    longest = int(np.diff(np.concatenate(([-1], runs, [n - 1]))).max()) if n else 0
    per_word = 1 / max(m, 1)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return [
        np.log1p(n), np.log1p(m), float(sizes.mean()) if m else 0.0, float(sizes.std()) if m else 0.0,
        seen[65:91].sum() / max(n, 1), seen[48:58].sum() / max(n, 1), seen[MARKS].sum() / max(n, 1), seen[33] * per_word, seen[124] * per_word,
        seen[SYMBOLS].sum() * per_word, (seen[32] + seen[9:14].sum()) / max(n, 1), seen[10] * per_word, seen[128:].sum() / max(n, 1),
        seen[46] * per_word, sum(65 <= w[0] <= 90 for w in words) * per_word, sum(w[-1] not in ALNUM_END for w in words) * per_word,
        len(kinds) * per_word, max(counts.values(), default=0) * per_word, float((sizes <= 3).mean()) if m else 0.0, float((sizes >= 12).mean()) if m else 0.0,
        len(set(lines)) / max(len(lines), 1), m / max(len(lines), 1), float(-(share * np.log2(share)).sum()), float(np.log1p(longest)),
        len(set(zip(words, words[1:]))) / max(m - 1, 1)]


@dataclass
class Model:
    """Cut points of every feature, a table for each feature and each pair, and the intercept."""

    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    coarse: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, by table look-ups and additions."""
        bins = self.bins(x)
        total = np.full(len(x), self.start)
        for j, t in enumerate(self.tables):
            total += t[bins[:, j]]
        for (i, j), t in self.pairs.items():
            total += t[self.coarse[i][bins[:, i]], self.coarse[j][bins[:, j]]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def steps(gradient: np.ndarray, weight: np.ndarray, leaves: int = 4, least: float = 5.0) -> np.ndarray:
    """Values of a small tree over ordered bins: the best splits by gain, one after the other."""
    g, h = np.concatenate(([0], np.cumsum(gradient))), np.concatenate(([0], np.cumsum(weight)))
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    edges = [0, len(gradient)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(edges, edges[1:]):
            at = np.arange(a + 1, b)
            if not len(at):
                continue
            gain = np.where((h[at] - h[a] >= least / 4) & (h[b] - h[at] >= least / 4), worth(a, at) + worth(at, b) - worth(a, b), 0)
            k = int(gain.argmax())
            best = max(best, (float(gain[k]), int(at[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(gradient))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def quarters(gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of the best tree of one cut per feature over a grid of bins, and its gain."""
    g, h = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (gradient, weight))
    parts = lambda t: (t[1:-1, 1:-1], t[1:-1, -1:] - t[1:-1, 1:-1], t[-1:, 1:-1] - t[1:-1, 1:-1], t[-1, -1] - t[1:-1, -1:] - t[-1:, 1:-1] + t[1:-1, 1:-1])
    gain = sum(a ** 2 / (b + 1.0) for a, b in zip(parts(g), parts(h)))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(gradient)
    for rows, cols, a, b in zip((slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)),
                                (slice(0, j + 1), slice(j + 1, None)) * 2, parts(g), parts(h)):
        out[rows, cols] = np.broadcast_to(a, gain.shape)[i, j] / (np.broadcast_to(b, gain.shape)[i, j] + 1.0)
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 64, grid: int = 8, pairs: int = 10) -> Model:
    """A model of labels 0 and 1. With one label only, or without rows, it knows no more than the (smoothed) share of label 1."""
    columns = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for j in range(columns)]
    model = Model(cuts, [np.zeros(len(c) + 1) for c in cuts], coarse=[np.arange(len(c) + 1) * grid // (len(c) + 1) for c in cuts])
    share = (y.sum() + 1) / (len(y) + 2)
    model.start = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return model
    at = model.bins(x)
    total = np.full(len(x), model.start)
    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-total))
            step = rate * steps(np.bincount(at[:, j], y - p, len(table)), np.bincount(at[:, j], p * (1 - p), len(table)))
            table += step
            total += step[at[:, j]]
    small = np.stack([c[at[:, j]] for j, c in enumerate(model.coarse)], 1)

    def over(i, j, values):
        return np.bincount(small[:, i] * grid + small[:, j], values, grid * grid).reshape(grid, grid)

    p = 1 / (1 + np.exp(-total))
    gains = {(i, j): quarters(over(i, j, y - p), over(i, j, p * (1 - p)))[1] for i, j in combinations(range(columns), 2)}
    chosen = sorted(gains, key=lambda k: (-gains[k], k))[:pairs]
    model.pairs = {k: np.zeros((grid, grid)) for k in chosen}
    for _ in range(rounds // 3):
        for (i, j), table in model.pairs.items():
            p = 1 / (1 + np.exp(-total))
            step = rate * quarters(over(i, j, y - p), over(i, j, p * (1 - p)))[0]
            table += step
            total += step[small[:, i], small[:, j]]
    # tables have mean 0 over the rows seen; what they lose goes to the intercept, so that each shows its own part
    for j, table in enumerate(model.tables):
        mean = float(table[at[:, j]].mean())
        table -= mean
        model.start += mean
    return model


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in pieces(batches, "content"):
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([described(t) for t in texts], pa.list_(pa.float64()))], names=["label", "x"])


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", held_out=None,
          most_rows: int = 20_000, **how) -> Model:
    """Fit on at most ``most_rows`` labelled rows, those whose hashed key is smallest: a sample that does not depend on files or order.

    ``held_out(key)`` tells which rows must not be learned from. Rows without a label, key or document are left out, a null text counts as empty. A key with
    several labels counts once for each. Only features of the sample come to the driver: 25 numbers a row.
    """
    keys = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key IS NOT NULL AND label IN (0, 1)").distinct()
    if held_out is not None:
        keys = keys.where(~held_out(F.col("key")))
    sample = keys.orderBy(F.xxhash64("key"), "key", "label").limit(most_rows)
    rows = docs.select(F.col(key).alias("key"), as_bytes(text).alias("content")).join(sample, "key").select("key", "label", "content")
    got = rows.select(F.struct("key", "label").alias("label"), "content").mapInArrow(
        describe, f"label struct<key:{docs.schema[key].dataType.simpleString()},label:int>, x array<double>").toPandas()
    if not len(got):
        return fit(np.empty((0, len(FEATURES))), np.empty(0), **how)
    x = np.array(got["x"].tolist())
    y = np.array([r["label"] for r in got["label"]], float)
    order = np.lexsort((*x.T, y))  # the same model however rows arrive
    return fit(x[order], y[order], **how)


def scored(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """All rows and columns with ``score`` (probability of label 1) and ``predicted``; columns of these names are replaced.

    Every text is read whole; a null text is scored as an empty one. Repeated rows get equal scores; an empty table gives no row.
    """
    kept = [c for c in docs.columns if c not in (score, predicted)]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "__content"):
            p = model.score(np.array([described(t) for t in texts]).reshape(-1, len(FEATURES)))
            columns = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "__content"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*kept, score, predicted])

    return docs.select(*[F.col(f"`{c}`") for c in kept], as_bytes(text).alias("__content")).mapInArrow(run, f"{fields}, `{score}` double, `{predicted}` int")
