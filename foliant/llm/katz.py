"""Language-model scores by an n-gram model with Katz backoff.

Counts of up to ``MOST`` are discounted by Good and Turing. The counts of counts that this needs are smoothed first, by a straight line through their logarithms
(as in simple Good-Turing): raw ones are uneven where documents come in copies, and may rise where the formula needs them to fall. What discounting frees goes to words not
seen after a history, in proportion to the probability that the next lower order gives them, and among unigrams to one unknown word. Backoff weights make every
distribution sum to one exactly, also where no count is small enough to be discounted: there one is added to the count of the history.

Blocks of documents ask the count tables, dealt by name, for the total counts of their n-grams of all orders; then, order by order from the bigrams up, for the
backoff weights of their histories, whose sums each block adds up for the n-grams that it owns (the first block that learns one does). A token is scored by its longest
n-gram if that was seen, else by the weight of its history and, recursively, the next lower order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Names, mixed, plain_words, written
from .exchange import Blocks, answered, asked, grouped, once, repeated_again, requested

MOST = 5
#: Counts of counts up to this many take part in the fit.
FITTED = 100
#: The fitted line falls at least this steeply: else there would be nothing to discount.
LEAST_SLOPE = -1.05
END, BEGIN = np.uint64(0x8F3A11C6D2E45B79), np.uint64(0x17C6E9A3F05B8D42)


def longer(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Names of n-grams from the names of all but their last word, and of that."""
    return mixed(mixed(history) * np.uint64(0x9E3779B97F4A7C15) + word)


def small(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    size = next(k for k in (1, 2, 4, 8) if int(values.max(initial=0)) < 1 << 8 * k)
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def large(parts: list[bytes]) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *[np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64) for x in parts]])


class Tokens:
    """Tokens of a block's documents with their n-grams of every order up to ``order``; an end closes every document.

    ``grams[k]`` are the distinct names of order k + 1 and ``at[k]`` the n-gram of each token; ``histories[k]`` and ``at_history[k]`` the same of what comes before the token.
    """

    def __init__(self, texts: list[bytes], order: int):
        names = Names()
        words = [names.of(plain_words(t.lower())) for t in texts]
        self.counts = np.array([len(w) + 1 for w in words], np.int64)
        word = np.concatenate([x for w in words for x in (w, [END])]).astype(np.uint64)
        first = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.grams, self.at, self.place, self.histories, self.at_history = [], [], [], [None], [None]
        gram, begin = word, BEGIN
        for k in range(order):
            if k:
                history = np.empty_like(word)
                history[1:] = gram[:-1]
                history[first] = begin
                kinds, at = np.unique(history, return_inverse=True)
                self.histories.append(kinds)
                self.at_history.append(at)
                gram, begin = longer(history, word), longer(np.array([begin]), np.array([BEGIN]))[0]
            kinds, place, at = np.unique(gram, return_index=True, return_inverse=True)
            self.grams.append(kinds)
            self.place.append(place)  # a token that ends in the n-gram
            self.at.append(at)


class Discounts:
    """Discounted counts from the numbers of types that occur once, twice, ... (``FITTED`` of them).

    With S(r) the fitted number of types of count r, Good and Turing's estimate for r is (r + 1) S(r + 1) / S(r). Katz's formula keeps it for counts up to ``MOST`` in such
    a way that the types seen once give up all that the unseen ones get.
    """

    def __init__(self, types: list[int]):
        seen = [r for r, n in enumerate(types[:FITTED], 1) if n]
        slope = -2.0
        if len(seen) > 1:
            # each number is spread over the gap around its count
            before, after = [0, *seen[:-1]], [*seen[1:], 2 * seen[-1] - seen[-2]]
            x, y = np.log(seen), np.log([2 * types[r - 1] / (t - q) for q, r, t in zip(before, seen, after)])
            slope = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())
        self.slope = min(slope, LEAST_SLOPE)
        r = np.arange(1, MOST + 1)
        kept, rest = (1 + 1 / r) ** (self.slope + 1), (MOST + 1) ** (self.slope + 1)
        self.ratio = np.concatenate(([1.0], (kept - rest) / (1 - rest)))

    def of(self, count: np.ndarray) -> np.ndarray:
        return np.where(count <= MOST, self.ratio[np.minimum(count, MOST)], 1.0)


class Unigrams:
    """Probabilities of words by count; count 0 is the unknown word, which takes all that discounting leaves."""

    def __init__(self, tokens: int, types: list[int]):
        self.discounts = Discounts(types)
        left = sum(types[r - 1] * r * (1 - self.discounts.ratio[r]) for r in range(1, MOST + 1))
        self.total = tokens if left > 0 else tokens + 1
        self.unknown = (left if left > 0 else 1) / self.total

    def of(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.discounts.of(count) * count / self.total, self.unknown)


def total_counts(part: int, names: list[np.ndarray], extras: list) -> tuple:
    """Total count of each name times two, plus one for the block that owns it; and of the part: tokens, types, types by count."""
    order, first = grouped(names)
    counts = np.concatenate(extras[0]).astype(np.int64)[order]
    totals = np.add.reduceat(counts, first)
    reply = np.repeat(totals, np.diff(np.append(first, len(order)))) * 2
    # blocks come in order and sorting keeps it: the first that counts a name owns it
    seen = np.cumsum(counts > 0) - np.repeat(np.cumsum(counts > 0)[first] - (counts[first] > 0), np.diff(np.append(first, len(order))))
    reply += (counts > 0) & (seen == 1)
    out = np.empty(len(order), np.int64)
    out[order] = reply
    by_count = np.bincount(np.minimum(totals, FITTED + 1), minlength=FITTED + 2)[1:FITTED + 1]
    sums = np.concatenate(([totals.sum(), (totals > 0).sum()], by_count)).astype("<i8")
    return [small(x) for x in np.split(out, np.cumsum([len(x) for x in names])[:-1])], sums.tobytes()


def sums_of(answers: DataFrame, parts: int, order: int) -> np.ndarray:
    """The sums of all parts: a row for each order."""
    n = FITTED + 2

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x, "<i8") for x in batch.column("data").to_pylist()]
            kinds = batch.column("part").to_numpy() // parts
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(kinds, n)), pa.array(np.tile(np.arange(n), len(rows))), pa.array(np.concatenate([np.empty(0, np.int64), *rows]))],
                                             names=["kind", "place", "value"])

    out = np.zeros((order, n), np.int64)
    rows = answers.where("block = -1").select("part", "data").mapInArrow(read, "kind long, place long, value long").groupBy("kind", "place").agg(F.sum("value").alias("value"))
    for r in rows.collect():  # order x 102 numbers
        out[r["kind"], r["place"]] = r["value"]
    return out


def weights_of(part: int, names: list[np.ndarray], extras: list) -> tuple:
    """For each history the count to divide by and the log of its backoff weight; a history never learned has count 0."""
    order, first = grouped(names)
    count, kept, below = (np.add.reduceat(np.concatenate(x)[order], first) for x in extras)
    left = 1 - kept / np.maximum(count, 1)
    none = left <= 1e-12
    divide = np.where(none, count + 1, count) * (count > 0)
    left = np.where(none, 1 / (count + 1.0), left)
    weight = np.log10(left / np.maximum(1 - below, 1e-300))
    size = np.diff(np.append(first, len(order)))
    out = np.empty((len(order), 2))
    out[order, 0], out[order, 1] = np.repeat(divide.astype(float), size), np.repeat(weight, size)
    return ([x.tobytes() for x in np.split(out, np.cumsum([len(x) for x in names])[:-1])],)


def scored(docs: DataFrame, held_out: Callable[[Column], Column], key: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row, by a model of n-grams up to ``order``.

    Words lie between ASCII white space, A-Z in lower case; each text is closed by an end token, so a null or empty text is that token alone. Rows for which
    ``held_out(key)`` is true or null are scored but not learned from. ``score`` is the log10 probability of the text, ``base_score`` that of unigrams with one added to each count and to
    an unknown word. Repeated rows are learned as often as they occur; they are counted once, with their number, and get equal scores. Without rows to learn from, all
    probability is that of the unknown word. An empty table gives no row. Other columns are not read.
    """
    rows = once(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text")
    id_of = F.struct("key", F.coalesce(held_out(F.col("key")), F.lit(True)).alias("held_out"), "many")
    blocks = Blocks(rows.select(id_of.alias("id"), "text"), "id", "text")
    parts = blocks.parts

    def ask_counts(number: int, ids: pa.Array, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(texts, order)
        often = np.where(ids.field("held_out").to_numpy(zero_copy_only=False).astype(bool), 0, ids.field("many").to_numpy())[tokens.doc]
        for k in range(order):
            n = len(tokens.grams[k])
            yield from requested(number, tokens.grams[k], parts, np.bincount(tokens.at[k], often, n).astype(np.uint32), kind=k)

    counts = written(answered(blocks.map(ask_counts, asked(1)), [np.uint32], total_counts), "counts")
    (tokens_all, types_all, *words_by), *above = sums_of(counts, parts, order).tolist()
    unigrams = Unigrams(tokens_all, words_by)
    discounts = [unigrams.discounts] + [Discounts(by) for _, _, *by in above]
    of_order = lambda k: counts.where(F.col("part").between(k * parts, (k + 1) * parts - 1))

    def lower(k: int, single: np.ndarray, divide: np.ndarray | None, history: np.ndarray | None) -> np.ndarray:
        """Probability of n-grams of order k + 1 that were seen, from their counts and what to divide by."""
        return unigrams.of(single) if k == 0 else discounts[k].of(single) * single / np.maximum(divide[history], 1)

    weights: list[DataFrame] = []
    for k in range(1, order):

        def ask_weights(number: int, ids: pa.Array, texts: list[bytes], of_shorter: list[bytes], of_grams: list[bytes], *of_histories: list[bytes], k: int = k) -> Iterator[pa.RecordBatch]:
            tokens = Tokens(texts, k + 1)
            shorter, reply = large(of_shorter) >> 1, large(of_grams)
            own = (reply & 1).astype(bool)
            count, at = (reply >> 1)[own], tokens.place[k][own]
            history, suffix = tokens.at_history[k][at], tokens.at[k - 1][at]
            divide = np.frombuffer(b"".join(of_histories[0])).reshape(-1, 2)[:, 0] if of_histories else None
            below = lower(k - 1, shorter[suffix], divide, tokens.at_history[k - 1][at] if k > 1 else None)
            n = len(tokens.histories[k])
            yield from requested(number, tokens.histories[k], parts, np.bincount(history, count, n).astype(np.int64), np.bincount(history, discounts[k].of(count) * count, n), np.bincount(history, below, n))

        given = {"shorter": of_order(k - 1), "grams": of_order(k)} | ({"histories": weights[-1]} if weights else {})
        weights.append(written(answered(blocks.map(ask_weights, asked(3), **given), [np.int64, np.float64, np.float64], weights_of), "weights"))

    def score(number: int, ids: pa.Array, texts: list[bytes], *answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(texts, order)
        count = [(large(x) >> 1)[tokens.at[k]] for k, x in enumerate(answers[:order])]
        total = np.log10(unigrams.of(count[0]))
        for k in range(1, order):
            divide, weight = np.frombuffer(b"".join(answers[order + k - 1])).reshape(-1, 2).T[:, tokens.at_history[k]]
            seen = np.log10(np.maximum(discounts[k].of(count[k]) * count[k] / np.maximum(divide, 1), 1e-300))
            total = np.where(count[k] > 0, seen, np.where(divide > 0, weight, 0) + total)
        base = np.log10((count[0] + 1) / (tokens_all + types_all + 1))
        n = len(texts)
        per_doc = lambda values: np.bincount(tokens.doc, values, n)
        yield pa.RecordBatch.from_arrays(
            [ids.field("key"), ids.field("held_out"), pa.array(tokens.counts), pa.array(per_doc(count[0] > 0).astype(np.int64)),
             pa.array(np.full(n, tokens_all)), pa.array(per_doc(base)), pa.array(per_doc(total)), ids.field("many")],
            names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "many"])

    fields = f"key {docs.schema[key].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, many long"
    given = {f"counts{k}": of_order(k) for k in range(order)} | {f"weights{k}": w for k, w in enumerate(weights)}
    return repeated_again(blocks.map(score, fields, **given)).withColumnRenamed("key", key)
