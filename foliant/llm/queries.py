"""The operators applied to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path as tokenizer_path

from ..catalog.sql_blocks import CRC
from .decontaminate import contaminated
from .digest import fingerprints
from .htmltext import extracted
from .katz import scored as katz_scored
from .manifest import manifest, row_digest
from .mix import mixed
from .quality import learn, scored
from .registry import QUERIES, SQL, query, table  # noqa: F401
from .repeats import without_repeats
from .rules import BASE_FAILED, GOOD_SHARE, GUESS, ROUNDS, RULES, TRUST, judged
from .shards import sharded
from .similar import similar
from .tokenfile import read_tokens, write_tokens
from .whitening import whitened


def domain():
    """The tables have no domain: a fixed part of the sources stands for one."""
    first = F.substring(F.md5("source"), 1, 1)
    return F.when(first < "4", "web").when(first < "9", "books").otherwise("code")


def target_weights(spark: SparkSession) -> DataFrame:
    rows = [(["web"], 5), (["books"], 3), (["code"], 2)]
    rows += [([d, lang], w) for d in ("web", "books", "code") for lang, w in (("en", 4), ("de", 3), ("fr", 2), ("es", 2))]
    rows += [(["web", lang, "src0"], 3) for lang in ("en", "de", "fr", "es")]
    return spark.createDataFrame(rows, "path array<string>, weight long")


def level_sql(i: int, above: str, node: str, weight: str) -> str:
    """Budgets of level ``i`` as SQL; ``above`` are the columns of the levels before."""
    keys = f"{above}{', ' if above else ''}{node}"
    part = f"PARTITION BY {above}" if above else ""
    given = f"JOIN b{i - 1} USING ({above})" if above else "CROSS JOIN (SELECT CAST(least((SELECT sum(tokens) FROM r) // 2, (SELECT sum(tokens * 2) FROM leaf)) AS HUGEINT) AS given)"
    return f"""n{i} AS (SELECT *, CAST({weight} AS HUGEINT) AS w FROM (SELECT {keys}, CAST(sum(tokens * 2) AS HUGEINT) AS most FROM leaf GROUP BY ALL) {given} WHERE most > 0),
o{i} AS (SELECT *, coalesce(sum(most) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_, sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_
 FROM n{i} WINDOW f AS ({part} ORDER BY CAST(most AS DOUBLE) / CAST(w AS DOUBLE), {node})),
f{i} AS (SELECT *, most * open_ <= w * (given - full_) AS filled FROM o{i}),
p{i} AS (SELECT *, given - coalesce(sum(CASE WHEN filled THEN most END) OVER ({part}), 0) AS rest, sum(CASE WHEN NOT filled THEN w END) OVER ({part}) AS opened,
 row_number() OVER (PARTITION BY {above}{', ' if above else ''}filled ORDER BY {node}) AS turn FROM f{i}),
q{i} AS (SELECT *, CASE WHEN filled THEN most ELSE CAST(w * rest AS HUGEINT) // CAST(opened AS HUGEINT) END AS part FROM p{i}),
b{i} AS (SELECT {keys}, CAST(part + CASE WHEN NOT filled AND turn <= over_ THEN 1 ELSE 0 END AS HUGEINT) AS given
 FROM (SELECT *, rest - sum(CASE WHEN NOT filled THEN part END) OVER ({part}) AS over_ FROM q{i}))"""


MIX_SQL = rf"""
WITH r AS (SELECT doc_id, CASE WHEN substr(md5(source), 1, 1) < '4' THEN 'web' WHEN substr(md5(source), 1, 1) < '9' THEN 'books' ELSE 'code' END AS domain,
 coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, CAST(coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS BIGINT) AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM r GROUP BY ALL),
{level_sql(0, '', 'domain', "CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 ELSE 2 END")},
{level_sql(1, 'domain', 'lang', "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 3 ELSE 2 END")},
{level_sql(2, 'domain, lang', 'source', "CASE WHEN domain = 'web' AND source = 'src0' THEN 3 ELSE 1 END")},
e AS (SELECT domain, lang, source, CAST(coalesce(given, 0) AS BIGINT) AS leaf_budget, CAST(tokens AS BIGINT) AS all_ FROM leaf LEFT JOIN b2 USING (domain, lang, source)),
d AS (SELECT *, CASE WHEN all_ > 0 THEN leaf_budget // all_ ELSE 0 END AS full_epochs, CASE WHEN all_ > 0 THEN leaf_budget % all_ ELSE 0 END AS rest FROM r JOIN e USING (domain, lang, source)),
s AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('7:' || CAST(full_epochs AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR))
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM d)
SELECT doc_id, domain, lang, source, leaf_budget, tokens AS n_tokens, CAST(full_epochs AS BIGINT) AS full_epochs,
 CAST(greatest(0, least(tokens, rest - before_)) AS BIGINT) AS part_tokens FROM s"""


@query("op1_mix", sql=MIX_SQL)
def op1_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Half of all tokens by weights of domain, language and source, at most two epochs of any."""
    docs = table(spark, folder, "documents").withColumn("domain", domain())
    return mixed(docs, [F.col("domain"), F.col("lang"), F.col("source")], weights=target_weights(spark), epochs=2, seed=7).select(
        "doc_id", "domain", "lang", "source", "leaf_budget", "n_tokens", "full_epochs", "part_tokens")


def held_out(key):
    """A fifth of the documents, by the checksum of the id as text, and documents without an id."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(True))


@query("op2_quality")
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, folder, "documents")
    model = learn(docs, table(spark, folder, "labels"), held_out=held_out)
    return scored(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and how much it is like that text and the next document."""
    return fingerprints(table(spark, folder, "documents"))


@query("op4_main_text")
def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extracted(table(spark, folder, "pages").select("page_id", "url", "html"))


@query("op5_token_files")
def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents, written to files and read back."""
    return read_tokens(write_tokens(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json")))


SHARD_SQL = f"""
WITH RECURSIVE {CRC},
j AS (SELECT doc_id, n, CAST(doc_id AS HUGEINT) AS state, -1::BIGINT AS shard, 0::BIGINT AS ahead FROM documents, (VALUES (24), (25)) AS t(n) UNION ALL
 SELECT doc_id, n, (state * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT, ahead,
  floor((ahead + 1)::DOUBLE * (2147483648::DOUBLE / (((state * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT) // 8589934592::HUGEINT + 1)::DOUBLE))::BIGINT FROM j WHERE ahead < n),
k AS (SELECT doc_id, max(shard) FILTER (n = 24) AS shard, max(shard) FILTER (n = 25) AS grown_shard FROM j GROUP BY doc_id),
c AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, x: xor(a >> 8, (crc_table.t)[xor(a & 255, x) + 1])), 4294967295::BIGINT) AS crc
 FROM documents, crc_table)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS BIGINT) AS slot,
 CAST(grown_shard AS INTEGER) AS grown_shard FROM k JOIN c USING (doc_id)"""


@query("op6_shards", sql=SHARD_SQL)
def op6_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards by jump consistent hashing."""
    return sharded(table(spark, folder, "documents"), 24)


@query("op7_katz")
def op7_katz(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document by a model learned from six sevenths of them."""
    return katz_scored(table(spark, folder, "documents"), lambda key: F.crc32(key.cast("string")) % 7 == 2)


@query("op8_without_repeats", sql=r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
m AS (SELECT win, min(doc_id) AS least FROM v GROUP BY win),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM v JOIN m USING (win) WHERE doc_id > least) GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w) AS x
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(gone) AS p FROM c) AS g WHERE g.doc_id = x.doc_id AND g.p = x.p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)""")
def op8_without_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the 13-word windows that an earlier document holds."""
    return without_repeats(table(spark, folder, "documents"), with_text=False)


@query("op9_similar", sql=r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
c AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT c.doc_id, l.b AS reached FROM c JOIN l ON l.a = c.reached)
SELECT w.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(reached) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.doc_id = w.doc_id GROUP BY w.doc_id""")
def op9_similar(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 3-word sets are similar by 0.9 or more."""
    return similar(table(spark, folder, "documents"))


@query("op10_contaminated", sql=r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT DISTINCT least(10, len(w)) AS size FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM (
  SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, n WHERE len(w) >= size)),
m AS (SELECT DISTINCT doc_id, item_id, i, dw.size FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)""")
def op10_contaminated(spark: SparkSession, folder: str) -> DataFrame:
    """What every document shares with the benchmark."""
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def weak_sql() -> str:
    """Counts, votes and expectation-maximisation as SQL, from the rules themselves."""
    names = list(RULES)
    votes = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v{j}" for j, (bad, good) in enumerate(RULES.values()))
    columns = ", ".join(f"v{j}" for j in range(len(names)))
    logs = lambda group: " + ".join(f"ln(c[{6 * j + 3 * group + 2} + v{j}])" for j in range(len(names)))
    posterior = f"1 / (1 + exp(greatest(-700, least(700, {logs(0)} - ({logs(1)}) + ln((1 - good) / good)))))"
    weight = ("n * (1 - g)", "n * g")
    chances = ", ".join(f"(sum(CASE WHEN v{j} = {v} THEN {weight[k]} ELSE 0 END) + {TRUST} * any_value(total) * {GUESS[k][v + 1]}) / (sum({weight[k]}) + {TRUST} * any_value(total))"
                        for j in range(len(names)) for k in (0, 1) for v in (-1, 0, 1))
    guess = ", ".join(str(GUESS[k][v]) for _ in names for k in (0, 1) for v in range(3))
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) > 1 AS twice FROM (
 SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2))),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM g WHERE twice) GROUP BY doc_id),
k AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
 len(list_distinct(w))::BIGINT AS n_distinct, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters,
 length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_exclaims, len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:;")][\x20\x09-\x0D]*$')))::BIGINT AS n_ended_lines,
 len(list_filter(w, lambda x: regexp_full_match(x, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')))::BIGINT AS n_bare_words,
 len(list_filter(w, lambda x: regexp_matches(x, '[\x00-\x20#$%&(*+/<=>@\x5B-\x60{{|}}~\x7F]$')))::BIGINT AS n_marked_words
 FROM w LEFT JOIN r USING (doc_id)),
v AS (SELECT *, {votes}, ({BASE_FAILED}) AS base_failed FROM k),
p AS (SELECT {columns}, count(*) AS n, (SELECT count(*) FROM v WHERE NOT base_failed) AS total FROM v WHERE NOT base_failed GROUP BY ALL),
em AS (SELECT 0 AS round, {GOOD_SHARE}::DOUBLE AS good, [{guess}]::DOUBLE[] AS c UNION ALL
 SELECT any_value(round) + 1, (sum(n * g) + {TRUST} * any_value(total) * {GOOD_SHARE}) / (any_value(total) * (1 + {TRUST})), [{chances}]::DOUBLE[]
 FROM (SELECT round, p.*, {posterior} AS g FROM em, p WHERE round < {ROUNDS}) HAVING count(*) > 0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND g >= 0.5 AS kept, round(g, 4) AS good
FROM (SELECT v.*, {posterior} AS g FROM v, em WHERE round = (SELECT max(round) FROM em))"""


@query("op11_quality_rules", sql=weak_sql())
def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every document, the base conditions, and what the weighed votes of the rules say."""
    return judged(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("good", 4).alias("good"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding on up to 16 whitened components."""
    return whitened(table(spark, folder, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


MERKLE_SQL = rf"""
WITH RECURSIVE {CRC},
d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
 list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda h: ('0x' || h)::BIGINT)),
  lambda a, x: xor(a >> 8, (crc_table.t)[xor(a & 255, x) + 1])) AS c FROM documents, crc_table),
s AS (SELECT doc_id, lang, i, n, (xor(c, 4294967295::BIGINT)) % 3 = 0 AS touched, CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END AS t,
 CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS lower_t,
 coalesce(length(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
  || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head FROM d),
leaves AS (SELECT doc_id, coalesce('+' || lang, '') AS grp, i::BIGINT AS i, n::BIGINT AS n, sha256(head || t) AS leaf, sha256(head || CASE WHEN touched THEN lower_t ELSE t END) AS found FROM s),
tree AS (SELECT 0 AS level, grp, i, n, leaf AS h FROM leaves UNION ALL
 SELECT any_value(level) + 1, grp, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY grp, i // 8),
subs AS (SELECT grp, h, row_number() OVER (ORDER BY encode(grp)) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, i::BIGINT AS i, n::BIGINT AS n, h FROM subs UNION ALL
 SELECT any_value(level) + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY i // 8),
path AS (SELECT l.doc_id, t.level, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < l.i >> (3 * t.level)), '') AS before_, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > l.i >> (3 * t.level)), '') AS after_
 FROM leaves AS l JOIN tree AS t ON t.grp = l.grp AND t.i >> 3 = l.i >> (3 * t.level + 3) AND t.n > 1 GROUP BY ALL),
over_ AS (SELECT s.grp, 1000 + t.level AS level, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < s.i >> (3 * t.level)), '') AS before_, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > s.i >> (3 * t.level)), '') AS after_
 FROM subs AS s JOIN top AS t ON t.i >> 3 = s.i >> (3 * t.level + 3) AND t.n > 1 GROUP BY ALL),
steps AS (SELECT * FROM path UNION ALL SELECT doc_id, level, before_, after_ FROM leaves JOIN over_ USING (grp)),
proof AS (SELECT doc_id, sha256(string_agg(before_ || after_, '' ORDER BY level)) AS proof, list(before_ || '|' || after_ ORDER BY level) AS way FROM steps GROUP BY doc_id),
ends AS (SELECT doc_id, leaf, grp, coalesce(proof, sha256('')) AS proof,
 list_reduce(list_prepend(found, coalesce(way, [])), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded FROM leaves LEFT JOIN proof USING (doc_id))
SELECT doc_id, leaf, subs.h AS subroot, top.h AS root, proof AS proof_sha256, folded AS folded_root, folded = top.h AS verified
FROM ends JOIN subs USING (grp) JOIN top ON top.n = 1"""


@query("op13_manifest", sql=MERKLE_SQL)
def op13_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Digests and proofs of every document; in a third of them, by the checksum of the id, the text's capitals are found in lower case."""
    docs = table(spark, folder, "documents")
    before = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, row_digest(*before, lower))
    return manifest(docs, "doc_id", F.col("lang"), row_digest(*before, F.col("text")), touched)
