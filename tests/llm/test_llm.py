"""The operators against plain versions of their own, on small tables with every kind of awkward row."""

import base64
import math
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from hashlib import md5, sha256

import numpy as np
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from foliant.llm import digest, katz, tokenfile
from foliant.llm.components import components
from foliant.llm.decontaminate import contaminated
from foliant.llm.digest import fingerprints
from foliant.llm.htmltext import extracted, main_text
from foliant.llm.mix import mixed, taken
from foliant.llm.quality import described, fit, learn, scored
from foliant.llm.queries import QUERIES, SQL, tokenizer_path
from foliant.llm.repeats import without_repeats
from foliant.llm.shards import sharded, write_shards
from foliant.llm.similar import similar
from foliant.llm.tokenfile import read_tokens, write_tokens

FOLDER = "/root/testdata/sf0.001"
RNG = np.random.default_rng(5)
WORDS = ["a", "bb", "Ccc", "d,", "e", "é", "ff", "zz9", "x-y", "Q"]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, row long, n int, name string, node long, block long, part long, "
          "content string, names string, level0 string, passes long, size int, score string, text_crc32 string, n_words string")


def sentence(n):
    return " ".join(RNG.choice(WORDS, n).tolist())


@lru_cache
def awkward():
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, copies, and columns named as those the operators use."""
    base, other = sentence(120), sentence(60)
    texts = [base, base, base + " end", base.upper(), base[:200], other, other + " " + base[50:300], None, "", "  \n\t ", "x", "x y", "a a a a a a a a a a a a a a a a a a a",
             sentence(30_000), "<|endoftext|> hi", "non break\u0085 ünï…! code", "It's don't we'll 12 3a4", sentence(13), sentence(14), other]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None) + ("k", 1, 1, "n", 1, 1, 1, "c", "m", "l", 1, 1, "s", "t", "w") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base, "en", "s0", 3) + rows[0][5:], (None, None, None, None, None) + (None,) * 15, (-7, other, "de", "s1", 3) + rows[0][5:]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def rows_of(df):
    return df.toPandas().to_dict("records")


def null(x):
    return None if x is None or x != x else int(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_with_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name]) is None


def test_there_is_a_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))


def test_mix(docs, none, spark):
    levels = [F.col("lang"), F.col("source")]
    weights = spark.createDataFrame([(["en"], 3), (["en", "s1"], 0), (["de"], 1)], "path array<string>, weight long")
    for share, epochs in (((1, 3), 1), ((1, 1), 1), ((5, 2), 2)):
        got = rows_of(mixed(docs, levels, share=share, epochs=epochs, weights=weights, seed=3))
        assert len(got) == docs.count()
        leaves = defaultdict(list)
        for r in got:
            assert r["n_tokens"] == len(plain(r["text"]))
            leaves[(r["lang"] or "(none)", r["source"] or "(none)")].append(r)
        total = sum(r["n_tokens"] for r in got)
        weigh = lambda path: {("en",): 3, ("en", "s1"): 0}.get(path, 1)
        tokens = {k: sum(r["n_tokens"] for r in v) for k, v in leaves.items()}

        def fill(budget, caps, ws):
            """Shares by weight, the children that fill up first leaving the rest to the others."""
            out, open_ = {}, [k for k in sorted(caps) if caps[k] > 0]
            budget = min(budget, sum(caps[k] for k in open_))
            while open_:
                w = sum(ws[k] for k in open_)
                full = [k for k in open_ if caps[k] * w <= ws[k] * budget]
                if not full:
                    part = {k: ws[k] * budget // w for k in open_}
                    for k in open_[:budget - sum(part.values())]:
                        part[k] += 1
                    return {**out, **part}
                k = min(full, key=lambda k: (caps[k] / ws[k], k))
                out[k] = caps[k]
                budget -= caps[k]
                open_.remove(k)
            return out

        caps = {k: v * epochs * (weigh(k) > 0) for k, v in tokens.items()}
        tops = {l: sum(v for k, v in caps.items() if k[0] == l) for l in {k[0] for k in caps}}
        first = fill(total * share[0] // share[1], tops, {l: weigh((l,)) for l in tops})
        for l, budget in first.items():
            own = fill(budget, {k: v for k, v in caps.items() if k[0] == l}, {k: weigh(k) for k in caps if k[0] == l})
            for k, b in own.items():
                assert {r["leaf_budget"] for r in leaves[k]} == {b}
                used = sum(r["n_tokens"] * r["full_epochs"] + r["part_tokens"] for r in leaves[k])
                assert used == b
                whole = b // tokens[k] if tokens[k] else 0
                order = sorted((r for r in leaves[k]), key=lambda r: md5(f"3:{whole}:{'' if null(r['doc_id']) is None else int(r['doc_id'])}".encode()).hexdigest())
                cut = [r for r in order if 0 < r["part_tokens"] < r["n_tokens"]]
                assert len(cut) <= 1
    assert mixed(none, levels).count() == 0
    assert taken(mixed(docs, levels, share=(1, 1))).columns == docs.columns


def test_budgets_are_whole_numbers_at_any_weight(spark):
    """Weights that sum far above a million: each part is the whole quotient, not one rounded up on its way."""
    rows = [(i, " ".join(["w"] * 1000), f"l{i % 3}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    given = {"l0": 7_000_003, "l1": 2_999_999, "l2": 5}
    got = rows_of(mixed(docs, [F.col("lang")], budget=9_999, weights=spark.createDataFrame([([k], w) for k, w in given.items()], "path array<string>, weight long")))
    whole, parts = sum(given.values()), {k: w * 9_999 // sum(given.values()) for k, w in given.items()}
    over = 9_999 - sum(parts.values())
    want = {k: parts[k] + (i < over) for i, k in enumerate(sorted(given))}
    assert whole > 10**7 and {r["lang"]: r["leaf_budget"] for r in got} == want


def test_rows_without_a_key_have_places_of_their_own(spark):
    from foliant.llm.mix import drawn, named

    rows = spark.createDataFrame([(None, f"text {i}") for i in range(500)] + [(7, "a"), (7, "b")], "doc_id long, text string")
    places = [r["p"] for r in rows.select(drawn(1, F.lit(0), named("doc_id", "text")).alias("p")).collect()]
    assert len(set(places)) == 501 and len({p[:3] for p in places}) > 400


def test_quality_is_held_out_without_an_id(spark):
    from foliant.llm.queries import held_out

    got = spark.createDataFrame([(None,), (1,), (2,)], "k long").select(held_out(F.col("k")).alias("h")).collect()
    assert [r["h"] for r in got] == [True, *[zlib.crc32(str(k).encode()) % 5 == 0 for k in (1, 2)]]


def test_quality_learns_and_scores(docs, none, spark):
    x = RNG.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # nothing but a pair tells the labels
    model = fit(x, y, rounds=60)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9 and (0, 1) in model.pairs
    assert np.isfinite([described(t) for t in (b"", b" ", b"x", b"\xff\xfe", b"a" * 100_000)]).all()
    labels = spark.createDataFrame([(0, 1), (5, 0), (None, 1), (6, None), (99, 1)], "doc_id long, quality int")
    model = learn(docs, labels)
    got = rows_of(scored(docs, model))
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert scored(none, learn(none, labels)).count() == 0


def test_quality_holds_on_rows_not_learned_from(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op2_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95 and (got[got.quality == 1].predicted == 1).mean() > 0.97
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got.doc_id, got.held_out))


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_fingerprints(docs, none):
    keyed = [(r[0], r[1] or "") for r in awkward()]
    for size in (4, 100):
        got = rows_of(fingerprints(docs, rows_per_range=size))
        assert len(got) == len(keyed)
        unique = {k: t for k, t in keyed if k not in (None, 0)}
        follow = ordered([(k, t) for k, t in keyed])
        for k, t in unique.items():
            i = follow.index((k, t))
            nxt = follow[(i + 1) % len(follow)]
            if nxt[0] is None:
                continue
            q = len(t) // 4
            e = t[:len(t) - q] + nxt[1][:q]
            a, b, c = (digest.Digest(z.encode()) for z in (t, e, nxt[1]))
            r = next(r for r in got if null(r["doc_id"]) == k)
            assert r["n_chars"] == len(t) and r["edited_sha256"] == sha256(e.encode()).hexdigest()
            assert base64.b64decode(r["fingerprint"]) == a.packed and base64.b64decode(r["edited_fingerprint"]) == b.packed
            assert abs(r["near_edited"] - a.like(b)) < 1e-12 and abs(r["near_next"] - a.like(c)) < 1e-12
    assert fingerprints(none).count() == 0
    codes = RNG.integers(97, 104, 500).astype(np.uint8)
    assert list(digest.unevenness(codes)) == [sum(int(digest.COUNT_LOG[c]) for c in np.bincount(codes[i:i + 32])) for i in range(469)]


def test_likeness_does_not_jump_with_size():
    """A copy with 16 more bytes is as like its original at any size, also where the kinds of features change."""
    rng = np.random.default_rng(12)
    letters = list("abcdefghijklmnopqrstuvwxyz     ")
    least = 1.0
    for n in range(60, 700, 5):
        text = "".join(rng.choice(letters, n + 16).tolist()).encode()
        a, b = digest.Digest(text[:n]), digest.Digest(text)
        least = min(least, a.like(b))
        assert len(set(a.names.tolist())) == len(a.names)
    assert least > 0.75
    lines = digest.Digest(b"=================================================\n" * 40)
    assert len(lines.names) == len(set(lines.names.tolist()))


def test_main_text(spark):
    page = ("<body class='has-menu'><div class='menu'><a href=#>x</a><a>y</a></div><div id=content><h1>T &amp; U</h1><p>Long text of the\n\n article goes here and on and on.</p><p>No.<p>"
            "Another long paragraph with <b>eno</b>ugh words to be content, really.</div><div class='comments'><p>I disagree with this article totally and completely</p></div>"
            "<div id='cookie-notice'>We use cookies</div><footer>f</footer><script>if (a<b) {}</script></body>")
    want = "T & U Long text of the article goes here and on and on. No. Another long paragraph with enough words to be content, really."
    assert main_text(page) == want
    assert [main_text(x) for x in ("", "plain & text", "<p>short", "<nav>only a menu</nav>", "<![if x]><p>abc &nbsp; d&eacute;f</p>")] == ["", "plain & text", "short", "", "abc déf"]
    rows = [(1, page, "u", 5), (1, page, None, 5), (2, None, "u", 5), (None, "", "u", 5), (3, "<p>" + "w " * 200_000, "u", 5)]
    got = rows_of(extracted(spark.createDataFrame(rows, "page_id long, html string, url string, n_chars int")))
    assert [r["text"] for r in got if r["page_id"] == 1] == [want, want] and {len(r["text"]) == r["n_chars"] for r in got} == {True} and len(got) == 5
    assert extracted(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_main_text_stays_in_wrappers_with_names_of_furniture():
    text = " ".join(f"<p>Paragraph {i} of the article goes on for as many words as it takes.</p>" for i in range(4))
    want = re.sub("<.*?>", "", text)
    side = "<div class='sidebar'><a href=#>one</a> <a href=#>two</a></div><div class='ad'>Buy it now</div><form>Search here</form>"
    for wrapper in ("div class='content-sidebar-wrap'", "div class='page has-sidebar'", "div id='main-with-nav'", "form id='aspnetForm'", "form role='form'", "div class='sidebar'",
                    "div class='site no-ads'"):
        tag = wrapper.split()[0]
        for inner in (text, f"<article>{text}</article>", f"<main>{text}</main>", f"<div class='has-menu'>{text}</div>"):
            assert main_text(f"<body><{wrapper}>{inner}{side}</{tag}></body>") == want, (wrapper, inner)
    # what is furniture by its name still goes
    remarks = "<div class='comments'><article>I disagree with this article totally and completely, and here is why I do.</article></div>"
    assert main_text(f"<body><div>{text}</div>{remarks}{side}</body>") == want


def test_main_text_of_pages_inside_elements_that_are_mostly_furniture():
    paragraphs = [f"Paragraph {i} of the article has quite a number of words, so that nobody takes it for a menu." for i in range(5)]
    article, want = "".join(f"<p>{p}</p>" for p in paragraphs), " ".join(paragraphs)
    for before, after in (("<form><fieldset>", "</fieldset></form>"), ("<label>", "</label>"), ("<div role=dialog>", "</div>"), ("<div role='banner'>", "</div>"), ("<dialog open>", "</dialog>")):
        assert main_text(f"<html><body>{before}{article}{after}</body></html>") == want, before
    for before in ("<nav><a href=/>home</a> <a href=/x>news</a>", "<button>", "<aside>"):  # never closed
        assert main_text(f"<html><body>{before}{article}</body></html>").endswith(want), before
    closed = "<nav><a href=/>home</a></nav><aside><p>Something else, told at some length in a box beside the page.</p></aside><fieldset><label>Your name</label></fieldset><button>Go</button>"
    assert main_text(f"<html><body>{closed}<div>{article}</div><footer><p>All rights reserved by the owner of these pages.</p></footer></body></html>") == want
    assert main_text(f"<body><aside><article><p>A teaser of another story, with some words.</p></article></aside><main>{article}</main></body>") == want


def test_main_text_goes_on_after_marks_the_parser_does_not_know():
    for mark in ("<![ CDATA[ x ]]>", "<![endif--]>", "<![foo[ x ]]>", "<![endif]-->", "<![>", "<![if x]>"):
        got = main_text(f"<p>Words before the mark, enough of them.</p>{mark}<p>Words after it, enough of them too.</p><!--[if x]>y<![endif]--><p>And the end.</p>")
        assert got.startswith("Words before the mark") and "Words after it, enough of them too." in got and got.endswith("And the end."), mark
    assert main_text("<p>one <![ two</p><p>three four</p>").endswith("three four") and main_text("<p>one two <![ three").endswith("three")


def test_blocks_round_trip():
    for values in ([], [7], [2**32 - 1], RNG.integers(0, 50_000, 5000), [0] * 512 + [2**31, 5], np.r_[RNG.integers(0, 8, 600), 10**9, RNG.integers(0, 8, 600)]):
        v = np.array(values, np.uint32)
        blocks = tokenfile.packed(v) if len(v) else []
        starts = np.cumsum([0, *map(len, blocks)])[:-1].astype(np.int64)
        assert np.array_equal(tokenfile.unpacked(b"".join(blocks), starts)[:len(v)], v)


def test_token_files(docs, none, spark):
    from tokenizers import Tokenizer

    model, path = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), tokenizer_path("word_bpe_49k.json")
    for size in (500, 10**9):
        got = sorted(rows_of(read_tokens(write_tokens(docs, path, file_bytes=size), with_ids=True)), key=lambda r: r["start"])
        start = 0
        keys = [null(r["doc_id"]) for r in got]
        assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and len(got) == docs.count()
        texts = defaultdict(list)
        for k, t in ((r[0], r[1]) for r in awkward()):
            texts[k].append(model.encode(t or "", add_special_tokens=False).ids + [1])
        for r in got:
            ids = [int(x) for x in r["ids"]]
            texts[null(r["doc_id"])].remove(ids)
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    assert read_tokens(write_tokens(none, path)).count() == 0


def test_shards(docs, none, spark, tmp_path):
    def jump(key, n):
        b, j, key = -1, 0, (key or 0) % 2**64
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    for n, size in ((24, 50_000), (3, 2), (1, 1)):
        got = rows_of(sharded(docs, n, rows_per_slice=size))
        assert len(got) == docs.count()
        slots = defaultdict(list)
        for r in got:
            assert (r["shard"], r["grown_shard"], r["law"]) == (jump(null(r["doc_id"]), n), jump(null(r["doc_id"]), n + 1), "key")
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert Counter((null(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == Counter(
            (k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in ((r[0], r[1]) for r in awkward()))
    assert sharded(none, 24).count() == 0
    write_shards(docs.drop("shard"), 3, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_slots_are_ranks_by_key_at_every_size(docs, spark):
    many = spark.range(5000).select(((F.col("id") * 7919) % 5003 - 900).alias("doc_id"), F.lit("t").alias("text")).repartition(3)
    for df, n in ((docs, 3), (many, 4)):
        got = [rows_of(sharded(df, n, rows_per_slice=size)) for size in (2 if df is docs else 300, 50_000)]
        order = lambda r: (r["shard"], null(r["doc_id"]) is not None, null(r["doc_id"]) or 0, r["text_crc32"], r["size"])
        for rows in got:
            seen = Counter()
            for r in sorted(rows, key=lambda r: (*order(r), r["slot"])):
                assert r["slot"] == seen[r["shard"]]
                seen[r["shard"]] += 1


def good_turing(counts):
    """Kept shares of the counts 1 to 5: a line through the logarithms of the counts of counts, Good and Turing's estimate on it, Katz's cut at 5."""
    often = Counter(counts)
    seen = sorted(r for r in often if r <= 100)
    slope = -2.0
    if len(seen) > 1:
        z = []
        for i, r in enumerate(seen):
            q = seen[i - 1] if i else 0
            t = seen[i + 1] if i + 1 < len(seen) else 2 * r - q
            z.append((math.log(r), math.log(often[r] / (0.5 * (t - q)))))
        slope = min(float(np.polyfit(*zip(*z), 1)[0]), -1.05)
    line = lambda r: r ** slope
    first = 6 * line(6) / line(1)
    return {r: ((r + 1) * line(r + 1) / line(r) / r - first) / (1 - first) for r in range(1, 6)}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz(docs, none, order):
    held = lambda k: F.crc32(k.cast("string")) % 7 == 2
    got = rows_of(katz.scored(docs, held, order=order))
    assert len(got) == docs.count()
    rows = [(k, (t or "").encode().lower().split()) for k, t in ((r[0], r[1]) for r in awkward())]
    out = lambda k: k is None or zlib.crc32(str(k).encode()) % 7 == 2
    counts = [defaultdict(Counter) for _ in range(order)]  # by history, the words after it
    for k, words in rows:
        if not out(k):
            padded = ["<s>"] * (order - 1) + words + ["</s>"]
            for i in range(order - 1, len(padded)):
                for n in range(order):
                    counts[n][tuple(padded[i - n:i])][padded[i]] += 1
    kept = [good_turing([c for p in by.values() for c in p.values()]) for by in counts]
    single, total = counts[0][()], sum(counts[0][()].values())
    d = lambda n, c: c * kept[n].get(c, 1.0)
    unknown = 1 - sum(d(0, c) for c in single.values()) / total

    @lru_cache(None)
    def back(history):
        """What counts after a history are divided by, and the weight of the lower order."""
        n, p = len(history), counts[len(history)][history]
        size = sum(p.values())
        left = 1 - sum(d(n, c) for c in p.values()) / size
        if left <= 1e-12:
            size, left = size + 1, 1 / (size + 1)
        return size, left / (1 - sum(prob(w, history[1:]) for w in p))

    @lru_cache(None)
    def prob(word, history):
        if not history:
            return d(0, single[word]) / total if single[word] else unknown
        p = counts[len(history)].get(history)
        if p is None:
            return prob(word, history[1:])
        size, weight = back(history)
        return d(len(history), p[word]) / size if p[word] else weight * prob(word, history[1:])

    for n in range(order):  # distributions sum to one, the unknown word included
        for history in list(counts[n])[:50]:
            assert abs(sum(prob(w, history) for w in single) + prob("never seen", history) - 1) < 1e-9
    want = Counter()
    for k, words in rows:
        score = base = known = 0
        padded = ["<s>"] * (order - 1) + words + ["</s>"]
        for i in range(order - 1, len(padded)):
            score += math.log10(prob(padded[i], tuple(padded[i - order + 1:i])))
            base += math.log10((single[padded[i]] + 1) / (total + len(single) + 1))
            known += single[padded[i]] > 0
        want[(k, out(k), len(words) + 1, known, total, round(base, 5), round(score, 5))] += 1
    have = Counter((null(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5)) for r in got)
    assert have == want, (sorted(map(str, (have - want)))[:3], sorted(map(str, (want - have)))[:3])
    assert katz.scored(none, held, order=order).count() == 0
    nothing = rows_of(katz.scored(docs, lambda k: F.lit(True), order=order))
    assert {(r["train_tokens"], r["score"]) for r in nothing} == {(0, 0.0)}


def test_discounts_of_real_counts_differ_by_count():
    """The counts of counts of the table are uneven (copies), the discounts are those of the formula all the same, and a model with them is better than one without backoff."""
    import duckdb

    words = duckdb.sql("SELECT regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    for n in (1, 2, 3):
        counts = Counter(tuple(w[i:i + n]) for (w,) in words for i in range(len(w) - n + 1))
        types = Counter(counts.values())
        got = katz.Discounts([types[r] for r in range(1, 101)]).ratio
        want = good_turing(counts.values())
        assert got[1:] == pytest.approx([want[r] for r in range(1, 6)], rel=1e-9)
        assert all(0 < a < b < 1 for a, b in zip(got[1:], got[2:]))
    for odd in ([], [5], [0] * 100, [0, 7], [0, 0, 0, 9, 0, 3], [1] * 100, list(range(1, 101))):
        ratio = katz.Discounts([*odd, *[0] * (100 - len(odd))]).ratio
        assert all(0 < a < 1 for a in ratio[1:])


def test_repeated_rows_are_dealt_once(spark):
    """A third of the rows are equal: they are one row of one block, learned as often as they occur."""
    from foliant.llm.exchange import once, repeated_again

    hot = [(None, "a hot text that repeats")] * 400 + [(7, "another one")] * 300 + [(i, f"text {i}") for i in range(500)]
    rows = spark.createDataFrame(hot, "key long, text string").repartition(5)
    single = once(rows, "key", "text")
    assert single.count() == 501 or single.count() == 502
    assert Counter(tuple(r) for r in repeated_again(single, 64).select("key", "text").collect()) == Counter(hot)


def test_repeats(docs, none):
    got = rows_of(without_repeats(docs))
    rows = [(r[0], [w.decode() for w in plain(r[1])]) for r in awkward()]
    first = {}
    for k, words in rows:
        for i in range(len(words) - 12):
            win = tuple(words[i:i + 13])
            first[win] = min(first.get(win, math.inf), math.inf if k is None else k)
    want = Counter()
    for k, words in rows:
        gone = {p for i in range(len(words) - 12) if first[tuple(words[i:i + 13])] < (math.inf if k is None else k) for p in range(i, i + 13)}
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        want[(k, len(words), len(gone), sha256(kept.encode()).hexdigest(), kept)] += 1
    assert Counter((null(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in got) == want
    assert without_repeats(none).count() == 0


def near(rows, size=3, percent=90):
    sets = []
    for k, t in rows:
        w = plain((t or "").encode().lower().decode() if not t else re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(rows[i][0])
    least = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    return Counter((rows[i][0], len(sets[i]), least[top(i)]) for i in range(len(rows)))


def found(df):
    return Counter((null(r["doc_id"]), r["n_shingles"], null(r["component_id"])) for r in rows_of(df))


def test_similar(docs, none):
    assert found(similar(docs)) == near([(r[0], r[1]) for r in awkward()])
    assert similar(none).count() == 0


def test_similar_in_families(spark):
    """Edited copies: many that are like the first one only, and many that are like no other although they share passages."""
    rows, base = [], RNG.integers(0, 5000, 110).tolist()
    for edits in (1, 1, 1, 2, 3, 6):
        for _ in range(12):
            own = list(base)
            for p in RNG.choice(len(own), edits, replace=False):
                own[p] = int(RNG.integers(5000, 9000))
            rows.append(own)
    rows += [base, *(RNG.integers(0, 5000, n).tolist() for n in (1, 2, 3, 9, 10, 11, 12, 20)), *(RNG.integers(0, 5000, 12).tolist()[:11] for _ in range(3))]
    rows += [r + [1] for r in rows[-12:]]
    made = [(i, " ".join(f"w{x}" for x in r)) for i, r in enumerate(rows)]
    RNG.shuffle(made)
    made = [(int(i), str(t)) for i, t in made]
    assert found(similar(spark.createDataFrame(made, "doc_id long, text string"))) == near(made)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, j) for j in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}


def test_contaminated(docs, none, spark):
    text = next(r[1] for r in awkward() if r[0] == 0)
    words = text.split()
    items = [(1, " ".join(words[20:45])), (10, " ".join(words[20:45])), (2, "X Y"), (3, "zz9"), (4, None), (5, ""), (None, " ".join(words[60:72])), (6, "not in any of them at all really no no no no"),
             (7, "é"), (2, "X Y"), (8, " ".join(words[40:52]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    letters = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    want = Counter()
    for k, t in ((r[0], r[1]) for r in awkward()):
        w, hit, who = letters(t), set(), set()
        at = defaultdict(list)
        for n in {min(10, len(letters(x))) for _, x in items}:
            for i in range(len(w) - n + 1):
                at[tuple(w[i:i + n])].append(i)
        for item, x in items:
            y = letters(x)
            n = min(10, len(y))
            for i in range(len(y) - n + 1 if n else 0):
                for p in at.get(tuple(y[i:i + n]), []):
                    hit |= set(range(p, p + n))
                    who.add(item)
        want[(k, len(w), len(hit), tuple(sorted(x for x in who if x is not None)))] += 1
    got = Counter((null(r["doc_id"]), r["n_words"], r["n_hit"], tuple(int(x) for x in r["items"])) for r in rows_of(contaminated(docs, bench)))
    assert got == want
    assert contaminated(none, bench).count() == 0
    assert {r["n_hit"] for r in rows_of(contaminated(docs, bench.limit(0)))} == {0}
