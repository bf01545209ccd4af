"""Parts of the checking SQL: passages, terms, hashed vectors and hybrid search, written for lists in one row."""

from .. import fixed_values as fv

BLANK = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORDS = r"[\p{L}\p{N}_]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def literal(text: str) -> str:
    """A text with newlines as SQL."""
    return " || chr(10) || ".join(quoted(p) for p in text.split("\n"))


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def split_lists(source: str, key: str, text: str, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> str:
    """CTEs ending in ``cut(key, pieces)``: the passages of every text of ``source`` as a list."""
    ctes = [f"cut0 AS (SELECT {key}, [{text}] AS p FROM {source})"]
    for i, separator in enumerate(fv.SEPARATORS):
        sep = f"({literal(separator)})"
        marked = f"list_transform(string_split(x, {sep}), lambda s, i: [CASE WHEN i < len(string_split(x, {sep})) THEN s || {sep} ELSE s END])"
        packed = (f"list_reduce({marked}, lambda a, y: CASE WHEN length(a[-1]) + length(y[1]) <= {size} "
                  f"THEN list_concat(a[:-2], [a[-1] || y[1]]) ELSE list_concat(a, y) END)")
        ctes.append(f"cut{i + 1} AS (SELECT {key}, flatten(list_transform(p, lambda x: CASE WHEN length(x) <= {size} THEN [x] ELSE {packed} END)) AS p FROM cut{i})")
    last = f"cut{len(fv.SEPARATORS)}"
    sliced = f"list_transform(range(0, length(x), {size}), lambda i: substr(x, i + 1, {size}))"
    ctes.append(f"cut_all AS (SELECT {key}, flatten(list_transform(p, lambda x: CASE WHEN length(x) <= {size} THEN [x] ELSE {sliced} END)) AS p FROM {last})")
    ctes.append(f"cut_base AS (SELECT {key}, list_filter(list_transform(p, lambda x: {strip('x')}), lambda x: x <> '') AS b FROM cut_all)")
    tail = f"right(b[i - 1], {overlap})"
    start = f"CASE WHEN strpos({tail}, ' ') BETWEEN 1 AND length({tail}) - 1 THEN substr({tail}, strpos({tail}, ' ') + 1) ELSE {tail} END"
    joined = strip(f"(({start}) || ' ' || x)")
    ctes.append(f"cut AS (SELECT {key}, list_transform(b, lambda x, i: CASE WHEN i = 1 THEN x ELSE {joined} END) AS pieces FROM cut_base)")
    return ",\n".join(ctes)


def passages(source: str = "lib") -> str:
    """CTEs ending in ``chunks(org, document_id, document, ordinal, chunk_id, content)`` of a library CTE."""
    return split_lists(source, "org, document_id, document", "text") + """,
chunks AS (SELECT org, document_id, document, ordinal, document_id * 1000000 + ordinal AS chunk_id, content
  FROM (SELECT org, document_id, document, unnest(pieces) AS content, generate_subscripts(pieces, 1) - 1 AS ordinal FROM cut))"""


def stem(t: str) -> str:
    cut = lambda k: f"left({t}, length({t}) - {k})"
    return (f"CASE WHEN length({t}) > 4 AND suffix({t}, 'ies') THEN {cut(3)} || 'y' "
            f"WHEN length({t}) > 4 AND suffix({t}, 'es') AND substr({t}, length({t}) - 2, 1) IN ('s', 'x', 'z') THEN {cut(2)} "
            f"WHEN length({t}) > 3 AND suffix({t}, 's') AND NOT suffix({t}, 'ss') THEN {cut(1)} "
            f"WHEN length({t}) > 6 AND suffix({t}, 'ing') THEN {cut(3)} WHEN length({t}) > 5 AND suffix({t}, 'ed') THEN {cut(2)} ELSE {t} END")


def terms(text: str, stop: list[str]) -> str:
    """List of stems of the words of a text that are longer than one letter and not stop words."""
    listed = ", ".join(quoted(w) for w in dict.fromkeys(stop))
    kept = f"list_filter(regexp_extract_all(lower({text}), '{WORDS}'), lambda t: length(t) > 1 AND t NOT IN ({listed}))"
    return f"list_transform({kept}, lambda t: {stem('t')})"


CRC = """crc_table AS MATERIALIZED (SELECT list(t ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)::BIGINT[]),
  lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS t FROM range(256) AS r(i)))"""


def hash_vectors(source: str, key: str, text: str, name: str, dim: int = fv.HASH_DIM) -> str:
    """CTEs ending in ``name(key, slot, v)``: the non-zero parts of hashed unit vectors, in single precision."""
    return f"""{name}_w AS (SELECT {key}, regexp_extract_all(lower({text}), '{WORDS}') AS w FROM {source}),
{name}_f AS (SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]))) AS f FROM {name}_w),
{name}_d AS (SELECT f, list_transform(range(1, octet_length(encode(f)) + 1)::BIGINT[], lambda i: ('0x' || substr(hex(encode(f)), (2 * i - 1)::BIGINT, 2))::BIGINT) AS bytes
  FROM (SELECT DISTINCT f FROM {name}_f)),
{name}_h AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, x: xor(a >> 8, (crc_table.t)[xor(a & 255, x) + 1])), 4294967295::BIGINT) AS h
  FROM {name}_d, crc_table),
{name}_s AS (SELECT {key}, h % {dim} AS slot, sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1 ELSE -1 END)::BIGINT AS v FROM {name}_f JOIN {name}_h USING (f) GROUP BY ALL),
{name} AS (SELECT {key}, slot, v::FLOAT / sqrt(sum(v * v) OVER (PARTITION BY {key}))::FLOAT AS v FROM {name}_s WHERE v <> 0)"""


def keyword_leg(pool: int, allowed: str | None = None) -> str:
    """CTEs ``postings``, ``weights``, ``keyword(qid, chunk_id, bm25, coverage, lexical_rank)`` of ``chunks`` and ``questions``."""
    only = f"AND (q.qid NOT IN (SELECT qid FROM {allowed}_q) OR (q.qid, p.document_id) IN (SELECT (qid, document_id) FROM {allowed}))" if allowed else ""
    return f"""asked AS MATERIALIZED (SELECT qid, org, unnest(ts) AS term, len(ts) AS n_terms FROM (SELECT qid, org, list_distinct({terms('query', fv.QUESTION_STOP_WORDS)}) AS ts FROM questions)),
words AS MATERIALIZED (SELECT org, chunk_id, document_id, {terms('content', fv.STOP_WORDS)} AS ws FROM chunks),
corpus AS (SELECT org, count(*) AS n, avg(len(ws)) AS avg_len FROM words GROUP BY org),
postings AS MATERIALIZED (SELECT org, chunk_id, document_id, term, doc_len, count(*) AS tf FROM (SELECT org, chunk_id, document_id, len(ws) AS doc_len, unnest(ws) AS term FROM words) GROUP BY ALL),
weights AS (SELECT org, term, n, avg_len, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings JOIN corpus USING (org) GROUP BY org, term, n, avg_len),
parts AS (SELECT q.qid, p.chunk_id, q.n_terms, round(w.idf * p.tf * ({fv.BM25_K1} + 1) / (p.tf + {fv.BM25_K1}::DOUBLE * (1 - {fv.BM25_B}::DOUBLE + {fv.BM25_B}::DOUBLE * (p.doc_len / CASE WHEN w.avg_len > 0 THEN w.avg_len ELSE 1 END))) * 1000000000)::BIGINT AS part
  FROM asked q JOIN postings p ON q.org = p.org AND q.term = p.term JOIN weights w ON w.org = q.org AND w.term = q.term WHERE true {only}),
keyword_all AS (SELECT qid, chunk_id, sum(part)::BIGINT / 1000000000 AS bm25, count(*) / max(n_terms) AS coverage FROM parts GROUP BY ALL),
keyword AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, chunk_id) AS lexical_rank FROM keyword_all QUALIFY lexical_rank <= {pool})"""


def hybrid(model: str, k: int, allowed: str | None = None) -> str:
    """CTEs up to ``gated`` and ``picked`` from ``chunks``, ``questions``, ``cvec(chunk_id, slot, v)`` and ``qvec(qid, slot, v)``."""
    least, cover, margin = next(t[1:] for t in fv.RELEVANCE_THRESHOLDS if model.startswith(t[0]))
    pool = max(fv.MIN_POOL, 6 * k)
    only = f"WHERE (q.qid NOT IN (SELECT qid FROM {allowed}_q) OR (q.qid, c.document_id) IN (SELECT (qid, document_id) FROM {allowed}))" if allowed else ""
    near = f"sim >= {least} AND sim >= best - {margin}" if margin is not None else f"sim >= {least}"
    return keyword_leg(pool, allowed) + f""",
dots AS (SELECT q.qid, c.chunk_id, sum(c.v::DOUBLE * q.v::DOUBLE) AS dot FROM qvec q JOIN questions USING (qid) JOIN chunks h USING (org) JOIN cvec c ON c.chunk_id = h.chunk_id AND c.slot = q.slot GROUP BY ALL),
sims AS MATERIALIZED (SELECT q.qid, q.org, c.chunk_id, c.document_id, round(coalesce(dot, 0), 6) + 0.0 AS sim FROM questions q JOIN chunks c USING (org) LEFT JOIN dots d ON d.qid = q.qid AND d.chunk_id = c.chunk_id {only}),
dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, chunk_id) AS dense_rank FROM sims QUALIFY dense_rank <= {pool}),
both_legs AS (SELECT coalesce(d.qid, l.qid) AS qid, coalesce(d.chunk_id, l.chunk_id) AS chunk_id, dense_rank, lexical_rank FROM dense d FULL JOIN keyword l ON d.qid = l.qid AND d.chunk_id = l.chunk_id),
fused AS (SELECT b.*, coalesce(1::DOUBLE / (60 + dense_rank), 0) + coalesce(1::DOUBLE / (60 + lexical_rank), 0) AS fused FROM both_legs b),
known AS (SELECT f.*, s.org, s.document_id, s.sim, max(s.sim) OVER (PARTITION BY f.qid) AS best, coalesce(a.coverage, 0) AS coverage,
  row_number() OVER (PARTITION BY f.qid ORDER BY fused DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST) AS rank
  FROM fused f JOIN sims s ON s.qid = f.qid AND s.chunk_id = f.chunk_id LEFT JOIN keyword_all a ON a.qid = f.qid AND a.chunk_id = f.chunk_id),
gated AS (SELECT * FROM known WHERE ({near}) OR coverage >= {cover}),
top2k AS (SELECT * FROM gated QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) <= {2 * k}),
turns AS (SELECT *, row_number() OVER (PARTITION BY qid, document_id ORDER BY rank) AS turn, min(rank) OVER (PARTITION BY qid, document_id) AS first_rank FROM top2k),
picked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY turn, first_rank) AS pos FROM turns QUALIFY pos <= {k})"""
