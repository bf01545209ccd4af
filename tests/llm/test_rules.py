"""Quality rules by weak supervision: counts against plain loops, estimates against votes drawn with known chances."""

import re

import numpy as np
import pytest
from test_llm import FOLDER, SCHEMA, awkward, rows_of

from foliant.llm.queries import QUERIES
from foliant.llm.rules import COUNTS, RULES, counted, estimated, judged

WHITE = "[^\x20\x09-\x0D]"


def plainly(text):
    """The counts again, word by word."""
    text = text or ""
    words = re.findall(WHITE + "+", text)
    lines = [x for x in text.split("\n") if re.search(WHITE, x)]
    runs = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for r in runs:
        seen[r] = seen.get(r, 0) + 1
    covered = {i + j for i, r in enumerate(runs) if seen[r] > 1 for j in range(3)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_lines": len(lines),
            "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(covered), "n_distinct": len(set(words)),
            "n_upper": len(re.findall("[A-Z]", text)), "n_letters": len(re.findall("[A-Za-z]", text)), "n_exclaims": text.count("!"),
            "n_ended_lines": sum(re.search('[.!?:;")][\x20\x09-\x0D]*\\Z', x) is not None for x in lines),
            "n_bare_words": sum(all(ord(c) < 128 and not c.isalnum() for c in w) for w in words),
            "n_marked_words": sum(ord(w[-1]) < 128 and not w[-1].isalnum() and w[-1] not in ".,;:!?)'\"-" for w in words)}


TEXTS = ["", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a", "x\n\nx\nx \ny.", "é ü ß\u0085ö", "### $$$ | a&&&", "HI!! YOU!!\r\nHI!! YOU!!\r\n", "\x1c \x1f a\x0bb\x0cc", "日本語 テキスト 日本語 テキスト 日本語"]


def test_counts():
    rng = np.random.default_rng(8)
    texts = TEXTS + ["".join(rng.choice(list("ab \n.!#é|"), 300).tolist()) for _ in range(200)]
    for t in texts:
        want = plainly(t)
        assert dict(zip(COUNTS, counted(t.encode()))) == {c: want[c] for c in COUNTS}, t


def test_estimates_come_back():
    """Votes drawn from known chances: the share of good documents, each rule's accuracy and the classes are found again, without labels."""
    rng = np.random.default_rng(2)
    rules, n = 9, 40_000
    good = rng.random(n) < 0.7
    bad_chances = np.array([(0.5 + 0.03 * j, 0.2, 0.3 - 0.03 * j) for j in range(rules)])
    good_chances = np.array([(0.05 + 0.01 * j, 0.25, 0.7 - 0.01 * j) for j in range(rules)])
    votes = np.stack([np.where(good, rng.choice([-1, 0, 1], n, p=good_chances[j]), rng.choice([-1, 0, 1], n, p=bad_chances[j])) for j in range(rules)], 1)
    kinds, which, many = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = estimated(kinds, many.astype(float), rounds=200, trust=0.0001)
    assert abs(model.good - 0.7) < 0.02
    assert np.abs(model.chances[:, 0] - bad_chances).max() < 0.03 and np.abs(model.chances[:, 1] - good_chances).max() < 0.03
    assert ((model.posterior(kinds)[which] >= 0.5) == good).mean() > 0.95
    right = [((votes[:, j] == 1) & good | (votes[:, j] == -1) & ~good).sum() / (votes[:, j] != 0).sum() for j in range(rules)]
    assert np.abs(model.accuracy() - right).max() < 0.02


def test_estimation_by_hand():
    """One round, every document and vote counted one by one."""
    votes, many = np.array([[1, 1], [-1, 0], [1, -1]]), np.array([6.0, 2.0, 2.0])
    model = estimated(votes, many, rounds=1, trust=0.1)
    guess = {0: {-1: 0.3, 0: 0.1, 1: 0.6}, 1: {-1: 0.02, 0: 0.08, 1: 0.9}}
    weights = []
    for v in votes:
        bad, good = 0.2, 0.8
        for x in v:
            bad, good = bad * guess[0][x], good * guess[1][x]
        weights.append(good / (bad + good))
    assert model.good == pytest.approx((sum(m * w for m, w in zip(many, weights)) + 0.1 * 10 * 0.8) / 11)
    for j in range(2):
        for group in (0, 1):
            seen = {x: 0.1 * 10 * guess[group][x] for x in (-1, 0, 1)}
            for v, m, w in zip(votes, many, weights):
                seen[v[j]] += m * (w if group else 1 - w)
            assert model.chances[j, group] == pytest.approx([seen[x] / sum(seen.values()) for x in (-1, 0, 1)])


def test_awkward_rows(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA).repartition(3)
    got = rows_of(judged(docs))
    assert len(got) == docs.count() and set(got[0]) == {"doc_id", *COUNTS, "votes", "base_failed", "good", "kept"}
    want = sorted(tuple(plainly(r[1]).values()) for r in awkward())
    assert sorted(tuple(r[c] for c in plainly("")) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got)
    assert all(r["kept"] == (not r["base_failed"] and r["good"] >= 0.5) and len(r["votes"]) == len(RULES) for r in got)
    assert judged(docs.limit(0)).count() == 0


def test_labelled_junk_goes_and_clean_documents_stay(spark):
    """Labels are read here only: no rule and no estimate sees them."""
    folder = FOLDER.replace("0.001", "0.01")
    got = QUERIES["op11_quality_rules"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("NOT base_failed").toPandas()
    junk, clean = got[got.quality == 0], got[got.quality == 1]
    assert len(junk) > 20 and junk.kept.mean() < 0.05 and clean.kept.mean() > 0.98
