"""Quality rules by weak supervision.

Each rule votes good or bad on a document, or abstains. No rule must be right: a document has a hidden class, good or bad, and each rule has its own chances of
each vote in either class. Expectation-maximisation estimates these chances and the share of good documents from the votes alone; no label is read. A
document is kept by its posterior probability of being good, not by passing every rule.

Documents with the same votes have the same posterior, so Spark counts documents by votes, and the estimation sees one row for each combination of
votes that occurs: at most three to the power of the number of rules, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, lists, pieces, plain_words, written

COUNTS = ("n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words n_distinct n_upper n_letters n_exclaims n_ended_lines n_bare_words n_marked_words").split()
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
SPACES = np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)
#: A line that ends so is a sentence's end.
ENDS = (b".", b"!", b"?", b":", b";", b'"', b")")
#: A word's last byte if it ends as words do: a letter, a digit or an ordinary mark.
PLAIN_ENDS = frozenset(b for b in range(256) if b >= 128 or chr(b).isalnum() or chr(b) in ".,;:!?)'\"-")
BARE = bytes(b for b in range(256) if b < 128 and not chr(b).isalnum())

#: What a rule votes: bad where the first SQL condition holds, good where the second does, otherwise nothing.
RULES = {
    "symbols": ("100 * n_symbols > 10 * n_words", "100 * n_symbols <= 2 * n_words"),
    "repeats": ("100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 10 * n_words"),
    "lines": ("100 * n_dup_lines > 30 * n_lines", "100 * n_dup_lines <= 10 * n_lines"),
    "word_length": ("word_chars < 3 * n_words OR word_chars > 12 * n_words", "10 * word_chars BETWEEN 35 * n_words AND 90 * n_words"),
    "capitals": ("100 * n_upper > 30 * n_letters", "100 * n_upper <= 10 * n_letters"),
    "exclaims": ("100 * n_exclaims > 10 * n_words", "100 * n_exclaims <= 2 * n_words"),
    "sentences": ("100 * n_ended_lines < 30 * n_lines", "100 * n_ended_lines >= 70 * n_lines"),
    "bare_words": ("100 * n_bare_words > 10 * n_words", "100 * n_bare_words <= 2 * n_words"),
    "marked_words": ("100 * n_marked_words > 10 * n_words", "100 * n_marked_words <= 3 * n_words"),
    "variety": ("n_distinct * n_distinct < n_words", "n_distinct * n_distinct >= 4 * n_words"),
    "length": ("n_words < 20", "n_words >= 100"),
}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
#: Chances of the votes bad, none, good before any is counted, in bad and in good documents: a bad document breaks a few rules, a good one hardly any.
GUESS = ((0.3, 0.1, 0.6), (0.02, 0.08, 0.9))
GOOD_SHARE = 0.8
#: The guess counts as much as this share of the documents.
TRUST = 0.02
ROUNDS = 40


def counted(text: bytes) -> list[int]:
    """``COUNTS`` of one whole text. Words lie between ASCII white space; a repeated word lies in a run of three words that occurs twice or more."""
    words = plain_words(text)
    n = len(words)
    codes = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    number: dict[bytes, int] = {}
    at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeated = 0
    if n > 2:
        # numbers of words, then of pairs, so that a run is one whole number: nothing is hashed
        _, pairs = np.unique(at[:-2] * len(number) + at[1:-1], return_inverse=True)
        _, runs, often = np.unique(pairs * len(number) + at[2:], return_inverse=True, return_counts=True)
        twice = often[runs] > 1
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[i:n - 2 + i] |= twice
        repeated = int(covered.sum())
    # bytes that start a code point, without white space
    chars = int(codes[:128].sum() + codes[192:].sum() - codes[SPACES].sum())
    upper = int(codes[65:91].sum())
    return [n, chars, int(codes[SYMBOLS].sum()), len(lines), len(lines) - len(set(lines)), repeated, len(number), upper, upper + int(codes[97:123].sum()),
            int(codes[33]), sum(x.rstrip(b" \t\n\r\x0b\x0c").endswith(ENDS) for x in lines), sum(not w.strip(BARE) for w in words), sum(w[-1] not in PLAIN_ENDS for w in words)]


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in pieces(batches, "content"):
        rows = np.array([counted(x) for x in texts], np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([batch.column("key"), lists(rows.ravel(), [len(COUNTS)] * len(rows))], names=["key", "counts"])


def vote(rule: str) -> Column:
    bad, good = RULES[rule]
    return F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)


@dataclass
class Votes:
    """The share of good documents, and for each rule the chances of the votes -1, 0, 1 in bad and in good documents: ``chances[rule, class, vote + 1]``."""

    good: float
    chances: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability that documents with these votes (one row each) are good."""
        logs = np.log(self.chances)
        at = np.arange(votes.shape[1])
        bad, good = (logs[at, c, votes + 1].sum(1) for c in (0, 1))
        return 1 / (1 + np.exp(np.clip(bad - good + np.log((1 - self.good) / self.good), -700, 700)))

    def accuracy(self) -> np.ndarray:
        """For each rule, the chance that a vote it casts is right."""
        right = (1 - self.good) * self.chances[:, 0, 0] + self.good * self.chances[:, 1, 2]
        return right / (right + (1 - self.good) * self.chances[:, 0, 2] + self.good * self.chances[:, 1, 0])


def estimated(votes: np.ndarray, many: np.ndarray, rounds: int = ROUNDS, trust: float = TRUST) -> Votes:
    """Expectation-maximisation over combinations of votes (one row each) that ``many`` documents have. Without documents, the guess."""
    rules, total = votes.shape[1], float(many.sum())
    guess = np.broadcast_to(np.array(GUESS), (rules, 2, 3))
    model = Votes(GOOD_SHARE, guess)
    if not total:
        return model
    cast = (votes[:, :, None] == np.array([-1, 0, 1])).astype(float)  # combination, rule, vote
    for _ in range(rounds):
        good = model.posterior(votes)
        seen = np.stack([np.einsum("p,pjv->jv", many * w, cast) for w in (1 - good, good)], 1) + trust * total * guess
        model = Votes(float((many * good).sum() + trust * total * GOOD_SHARE) / (total * (1 + trust)), seen / seen.sum(2, keepdims=True))
    return model


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", base_failed: str = BASE_FAILED, threshold: float = 0.5) -> DataFrame:
    """``key``, all counts, ``votes``, ``base_failed``, ``good`` (posterior probability) and ``kept`` of every row.

    Texts are read whole and once; only counts go on. The chances are estimated from the documents that do not fail the base conditions. ``kept`` is false
    where these fail, else tells whether ``good`` reaches ``threshold``. A null text is an empty one: no words, so the base conditions fail. Repeated rows get equal
    results, each its own row; a null key stays null; columns other than key and text are not read; an empty table gives no row.
    """
    rules = list(RULES)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), as_bytes(text).alias("content")).mapInArrow(count, f"key {kind}, counts array<long>")
    rows = rows.select("key", *[F.col("counts")[i].alias(c) for i, c in enumerate(COUNTS)])
    rows = written(rows.select("*", F.array(*[vote(r) for r in rules]).alias("votes"), F.expr(base_failed).alias("base_failed")), "votes")
    seen = rows.where("NOT base_failed").groupBy("votes").count().collect()  # at most 3 ** rules rows
    votes = np.array([r["votes"] for r in seen], np.int64).reshape(-1, len(rules))
    order = np.lexsort(votes.T)  # the same sums however rows arrive
    model = estimated(votes[order], np.array([r["count"] for r in seen], float)[order])
    logs = np.log(model.chances)
    # the posterior of a row as an expression: sums of logarithms that the votes choose
    odds = F.lit(float(np.log(model.good / (1 - model.good))))
    for j in range(len(rules)):
        gain = [float(logs[j, 1, v] - logs[j, 0, v]) for v in range(3)]
        odds = odds + F.element_at(F.array(*[F.lit(g) for g in gain]), F.col("votes")[j] + 2)
    good = F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
    return rows.withColumn("good", good).select(
        F.col("key").alias(key), *COUNTS, "votes", "base_failed", "good", (~F.col("base_failed") & (F.col("good") >= threshold)).alias("kept"))
