"""Queries over passages, index tables and retrieval."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import content_words, query_terms, tokenize
from ..functions.vectors import Embedder, hash_embedder
from ..operators import chunk, embed, index, retrieve
from ..operators.dense import dense_topk as search_vectors
from ..plans import search_index
from ..plans.ingest import passages
from ..session import shared_folder, spread, staged
from . import inputs
from . import sql_blocks as b
from .registry import Tables, query

K = fv.DEFAULT_K
POOL = retrieve.pool_size(K)
LIB = f"WITH lib AS ({inputs.LIBRARY}),\n"
WHOLE = f"WITH questions AS ({inputs.QUESTIONS}), chunks AS (SELECT org, document_id AS chunk_id, document_id, document, 0 AS ordinal, text AS content FROM ({inputs.LIBRARY})),\n"
PASSAGES = f"WITH lib AS ({inputs.LIBRARY}), questions AS ({inputs.QUESTIONS}),\n{b.passages()},\n"
VECTORS = f"{b.CRC},\n{b.hash_vectors('chunks', 'chunk_id', 'content', 'cvec')},\n{b.hash_vectors('questions', 'qid', 'query', 'qvec')},\n"
MODEL = hash_embedder()


def whole_documents(t: Tables):
    """Every document as one passage."""
    return t.spread(inputs.LIBRARY).select(
        "org", F.col("document_id").alias("chunk_id"), "document_id", "document", F.lit(None).cast("int").alias("page"), F.lit(0).alias("ordinal"),
        F.col("text").alias("content"), F.lit(False).alias("suspicious"))


def library(t: Tables):
    """The library, staged as a table as intake would leave it."""
    return staged(passages(t.spread(inputs.LIBRARY), MODEL), "chunks", compression="zstd")


def asked(t: Tables):
    """The questions with their vectors, embedded once."""
    return staged(embed.embed(t.spread(inputs.QUESTIONS), MODEL, "query", "qvec"), "questions")


@query("chunk_passages", LIB + b.passages() + "\nSELECT document_id, ordinal::BIGINT AS ordinal, content FROM chunks")
def chunk_passages(t: Tables):
    """Documents cut into overlapping passages."""
    cut = chunk.chunk_documents(t.spread(inputs.LIBRARY))
    return cut.select("document_id", F.col("ordinal").cast("bigint").alias("ordinal"), "content")


SEGMENTS = "SELECT conv_id, turn, CAST(turn + 1 AS INT) AS page, text FROM conversations"


@query("chunk_segments", f"""WITH seg AS ({SEGMENTS}), {b.split_lists('seg', 'conv_id, turn, page', 'text')},
rows AS (SELECT conv_id, turn, page, unnest(pieces) AS content, generate_subscripts(pieces, 1) AS i FROM cut),
sizes AS (SELECT conv_id, count(*) AS n FROM seg GROUP BY conv_id)
SELECT conv_id, page::BIGINT AS page, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS ordinal, content
FROM rows JOIN sizes USING (conv_id) WHERE length(content) >= 20 OR n = 1""")
def chunk_segments(t: Tables):
    """Documents of many segments (the turns of conversations) cut into passages numbered over the document."""
    cut = chunk.chunk_segments(t.spread(SEGMENTS), ["conv_id"], seg_no="turn")
    return cut.select("conv_id", F.col("page").cast("bigint").alias("page"), F.col("ordinal").cast("bigint").alias("ordinal"), "content")


@query("postings_stats", WHOLE + b.keyword_leg(POOL) + """
SELECT org, term, count(*) AS df, sum(tf)::BIGINT AS occurrences FROM postings GROUP BY ALL""")
def postings_stats(t: Tables):
    """Postings of whole documents, summed up by term."""
    posted = index.postings(whole_documents(t))
    return posted.groupBy("org", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


@query("corpus_stats", WHOLE + b.keyword_leg(POOL) + "\nSELECT org, n, round(avg_len, 4) AS avg_len FROM corpus")
def corpus_stats(t: Tables):
    """Passages and mean length per organisation."""
    return index.corpus_stats(whole_documents(t)).withColumn("avg_len", F.round("avg_len", 4))


@query("tokenized_documents", f"SELECT doc_id, len(ws) AS n_terms, len(list_distinct(ws)) AS n_distinct, sha256(array_to_string(ws, ' ')) AS terms_sha256 FROM (SELECT doc_id, {b.terms('text', fv.STOP_WORDS)} AS ws FROM documents)")
def tokenized_documents(t: Tables):
    """Index terms of every document."""
    ws = spread(t.documents).select("doc_id", tokenize(F.col("text")).alias("ws"))
    return ws.select("doc_id", F.size("ws").cast("bigint").alias("n_terms"), F.size(F.array_distinct("ws")).cast("bigint").alias("n_distinct"),
                     F.sha2(F.array_join("ws", " "), 256).alias("terms_sha256"))


@query("question_terms", f"SELECT item_id AS qid, unnest(list_distinct({b.terms('text', fv.QUESTION_STOP_WORDS)})) AS term FROM benchmark")
def question_terms(t: Tables):
    """Set of terms of every question."""
    return spread(t.benchmark).select(F.col("item_id").alias("qid"), F.explode(query_terms(F.col("text"))).alias("term"))


def _summary(vectors, *keys):
    """Of every vector: non-zero parts, sums of the positions of positive and negative parts, largest part."""
    places = lambda sign: F.aggregate(F.transform("embedding", lambda v, i: F.when(F.signum(v) == sign, i.cast("bigint")).otherwise(F.lit(0).cast("bigint"))),
                                      F.lit(0).cast("bigint"), lambda a, x: a + x)
    return vectors.select(*keys, F.size(F.filter("embedding", lambda v: v != 0)).cast("bigint").alias("nonzero"), places(1).alias("above"),
                          places(-1).alias("below"), F.round(F.array_max("embedding").cast("double"), 5).alias("largest"))


_SUMMED = """count(slot) AS nonzero, coalesce(sum(CASE WHEN v > 0 THEN slot END), 0)::BIGINT AS above,
 coalesce(sum(CASE WHEN v < 0 THEN slot END), 0)::BIGINT AS below, round(greatest(coalesce(max(v), 0), CASE WHEN count(slot) < {dim} THEN 0 ELSE -1 END)::DOUBLE, 5) AS largest"""


@query("hash_vectors", PASSAGES + VECTORS + f"SELECT chunk_id, {_SUMMED.format(dim=384)} FROM chunks LEFT JOIN cvec USING (chunk_id) GROUP BY chunk_id")
def hash_vectors(t: Tables):
    """Hashed vectors of all passages."""
    return _summary(passages(t.spread(inputs.LIBRARY), MODEL).select("chunk_id", "embedding"), "chunk_id")


@query("embed_distinct", f"WITH {b.CRC}, {b.hash_vectors('documents', 'doc_id', 'text', 'cvec')} SELECT doc_id, {_SUMMED.format(dim=384)} FROM documents LEFT JOIN cvec USING (doc_id) GROUP BY doc_id")
def embed_distinct(t: Tables):
    """Vectors of whole documents, copies embedded once."""
    return _summary(embed.embed_distinct(spread(t.documents).select("doc_id", "text"), MODEL, "text"), "doc_id")


STORED = """SELECT d.doc_id, d.text AS content, e.embedding, CASE WHEN d.lang = 'en' AND e.vec_id IS NOT NULL THEN 'hash-64' ELSE 'older-model' END AS embed_model
 FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id"""


@query("reembed_stale", f"""WITH stored AS ({STORED}), old AS (SELECT * FROM stored WHERE embed_model <> 'hash-64'), {b.CRC}, {b.hash_vectors('old', 'doc_id', 'content', 'hv', 64)},
kept AS (SELECT doc_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS slot FROM stored WHERE embed_model = 'hash-64')
SELECT doc_id, 'hash-64' AS embed_model, {_SUMMED.format(dim=64)} FROM (SELECT doc_id, slot, v FROM hv UNION ALL SELECT doc_id, slot, v FROM kept WHERE v <> 0) GROUP BY doc_id""")
def reembed_stale(t: Tables):
    """Vectors made by another model, and vectors that are missing, are made again; the others stay."""
    return _summary(embed.reembed_stale(t.spread(STORED), hash_embedder(64)), "doc_id", "embed_model")


@query("embed_stored", f"""WITH {b.CRC}, {b.hash_vectors('documents', 'doc_id', 'text', 'cvec')},
first AS (SELECT coalesce(text, '') AS text, CASE WHEN bool_or(doc_id % 2 = 0) THEN 1 ELSE 2 END AS run FROM documents GROUP BY ALL),
counted AS (SELECT doc_id, {_SUMMED.format(dim=384)} FROM documents LEFT JOIN cvec USING (doc_id) GROUP BY doc_id)
SELECT c.*, run::BIGINT AS run FROM counted c JOIN documents d USING (doc_id) JOIN first f ON f.text = coalesce(d.text, '')""")
def embed_stored(t: Tables):
    """Vectors of all documents after runs over half of them, over all, and over all again, with the run that made each: the third makes none."""
    path, docs = f"{shared_folder(t.spark)}/foliant/{uuid.uuid4().hex}/vectors", spread(t.documents).select("doc_id", "text")
    for run, rows in ((1, docs.where("doc_id % 2 = 0")), (2, docs), (3, docs)):
        vectors = embed.embed_stored(rows, MODEL, path, run, "text")
    made = embed.stored_vectors(t.spark, path, MODEL).select("sha", F.col("run").cast("bigint").alias("run"))
    keyed = vectors.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)).join(made, "sha")
    return _summary(keyed, "doc_id", "run")


MIXED = """SELECT vec_id AS chunk_id, 'label' || CAST(label AS STRING) AS org, CASE WHEN vec_id % 9 = 4 THEN slice(embedding, 1, 32) ELSE embedding END AS embedding FROM embeddings"""


@query("drop_wrong_dim", "SELECT 'label' || label AS org, count(*) AS n FROM embeddings WHERE vec_id % 9 <> 4 GROUP BY ALL")
def drop_wrong_dim(t: Tables):
    """Vectors of another dimension leave the index."""
    return embed.drop_wrong_dim(t.sql(MIXED), 64).groupBy("org").agg(F.count("*").alias("n"))


# texts of the same length, cut at the same places, with other letters
OTHER_TEXT = "translate(text, 'aeiou', 'eioua')"
STAMPED_BEFORE = f"""SELECT org, document_id, CASE WHEN org = 'src9' AND document_id % 40 = 9 THEN {OTHER_TEXT} ELSE text END AS text FROM ({inputs.LIBRARY}) AS l
 WHERE org NOT IN ('src3', 'src7') AND NOT (org = 'src5' AND document_id IN (SELECT doc_id FROM documents WHERE lang = 'en'))"""


def stamped_before(t: Tables):
    """The rows of ``STAMPED_BEFORE``. Its NOT IN below an AND would compare every document with every English one; here ids meet by equality."""
    lib = t.sql(inputs.LIBRARY)
    other = F.when((F.col("org") == "src9") & (F.col("document_id") % 40 == 9), F.expr(OTHER_TEXT)).otherwise(F.col("text")).alias("text")
    english = t.documents.where("lang = 'en'").select(F.col("doc_id").alias("document_id"))
    # NOT IN is null, so it keeps no row, where the list holds a null, and for a null that is looked for in a list with entries
    counts = english.agg(F.count("*").alias("__entries"), F.count_if(F.col("document_id").isNull()).alias("__nulls"))
    unlisted = lib.where("org = 'src5'").join(english, "document_id", "left_anti").crossJoin(counts)
    unlisted = unlisted.where("__nulls = 0 AND (document_id IS NOT NULL OR __entries = 0)").select(lib.columns)
    return lib.where("org NOT IN ('src3', 'src5', 'src7')").unionByName(unlisted).select("org", "document_id", other)


@query("stale_orgs", f"""WITH now AS (SELECT org, count(*) AS c, string_agg(md5(text), '' ORDER BY document_id) AS m FROM ({inputs.LIBRARY}) GROUP BY org),
old AS (SELECT org, count(*) AS c, string_agg(md5(text), '' ORDER BY document_id) AS m FROM ({STAMPED_BEFORE}) GROUP BY org UNION ALL SELECT 'gone', 3, '')
SELECT coalesce(now.org, old.org) AS org, CASE WHEN now.org IS NULL THEN 'drop' WHEN old.org IS NULL THEN 'build' ELSE 'rebuild' END AS action
FROM now FULL JOIN old ON now.org = old.org WHERE now.org IS NULL OR old.org IS NULL OR now.c <> old.c OR now.m <> old.m""")
def stale_orgs(t: Tables):
    """Organisations whose index no longer fits their passages; one of them has other texts under the same ids."""
    stamp = lambda rows: index.index_stamp(rows.select("org", "document_id", F.col("document_id").alias("chunk_id"), F.col("text").alias("content")), MODEL.name)
    gone = t.nation.agg(F.lit("gone").alias("org"), F.lit(3).cast("bigint").alias("chunks"), F.lit(9).cast("bigint").alias("max_id"),
                        F.lit(0).cast("decimal(38,0)").alias("content_sum"), F.lit(0).cast("bigint").alias("content_xor"), F.lit(MODEL.name).alias("model"))
    return index.stale_orgs(stamp(t.sql(inputs.LIBRARY)), stamp(stamped_before(t)).unionByName(gone))


@query("dense_topk", """WITH parts AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS slot FROM embeddings),
centre AS (SELECT label, slot, avg(v)::FLOAT::DOUBLE AS c FROM parts GROUP BY ALL),
sims AS (SELECT label, vec_id, round(sum(v * c), 6) AS sim FROM parts JOIN centre USING (label, slot) GROUP BY ALL)
SELECT label::BIGINT AS qid, vec_id AS chunk_id, sim, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS dense_rank FROM sims QUALIFY dense_rank <= 30""")
def dense_topk(t: Tables):
    """The vectors of every label nearest to their mean."""
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("slot", "v"))
    mean = parts.groupBy("label", "slot").agg(F.avg(F.col("v").cast("double")).cast("float").alias("c"))
    centres = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "c"))), lambda x: x["c"]).alias("qvec"))
    org = F.concat(F.lit("label"), F.col("label").cast("string")).alias("org")
    found = search_vectors(t.embeddings.select(org, F.col("vec_id").alias("chunk_id"), "embedding"),
                           centres.select(F.col("label").cast("bigint").alias("qid"), org, "qvec"), POOL)
    return found.select("qid", "chunk_id", "sim", F.col("dense_rank").cast("bigint").alias("dense_rank"))


@query("bm25_topk", WHOLE + b.keyword_leg(POOL) + "\nSELECT qid, chunk_id, round(bm25, 4) AS bm25, round(coverage, 4) AS coverage, lexical_rank FROM keyword")
def bm25_topk(t: Tables):
    """Keyword search over whole documents."""
    found = retrieve.bm25_topk(whole_documents(t), t.spread(inputs.QUESTIONS), POOL)
    return found.select("qid", "chunk_id", F.round("bm25", 4).alias("bm25"), F.round("coverage", 4).alias("coverage"), F.col("lexical_rank").cast("bigint").alias("lexical_rank"))


_HIT = "SELECT qid, pos, p.chunk_id, p.document_id, c.document, c.content, sim AS score FROM picked p JOIN chunks c ON c.chunk_id = p.chunk_id"


def _hits(found):
    return found.select("qid", F.col("pos").cast("bigint").alias("pos"), "chunk_id", "document_id", "document", "content", "score")


@query("passage_search", PASSAGES + VECTORS + b.hybrid(MODEL.name, K) + "\n" + _HIT)
def passage_search(t: Tables):
    """Hybrid search of all questions over the passages of all documents."""
    return _hits(retrieve.hybrid_search(library(t), asked(t), MODEL.name, k=K))


def _candidates(t: Tables):
    chunks, questions = library(t), asked(t).withColumn("k", F.lit(K))
    return retrieve.rrf_fuse(retrieve.candidates(chunks, questions, POOL))


@query("fused_ranks", PASSAGES + VECTORS + b.hybrid(MODEL.name, K) + """
SELECT qid, chunk_id, dense_rank, lexical_rank, round(fused, 6) AS fused, rank, sim, round(coverage, 4) AS coverage FROM known""")
def fused_ranks(t: Tables):
    """Candidates of both legs with their ranks, fused rank, cosine and word coverage."""
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return _candidates(t).select("qid", "chunk_id", big("dense_rank"), big("lexical_rank"), F.round("fused", 6).alias("fused"), big("rank"),
                                 "sim", F.round("coverage", 4).alias("coverage"))


@query("relevance_gate", PASSAGES + VECTORS + b.hybrid(MODEL.name, K) + "\nSELECT qid, chunk_id, rank FROM gated")
def relevance_gate(t: Tables):
    """Candidates that are about their question."""
    return retrieve.relevance_gate(_candidates(t), MODEL.name).select("qid", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


EXTERNAL = "remote:table"
EXTERNAL_SQL = f"""WITH questions AS ({inputs.QUESTIONS}),
chunks AS (SELECT org, document_id AS chunk_id, document_id, document, 0 AS ordinal, text AS content FROM ({inputs.LIBRARY})),
unknown AS (SELECT chunk_id, content FROM chunks WHERE chunk_id NOT IN (SELECT vec_id FROM embeddings)), {b.CRC}, {b.hash_vectors('unknown', 'chunk_id', 'content', 'made', 64)},
cvec AS (SELECT vec_id AS chunk_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS slot FROM embeddings UNION ALL SELECT chunk_id, v, slot + 1 FROM made),
qvec AS (SELECT vec_id AS qid, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS slot FROM embeddings JOIN benchmark ON item_id = vec_id),
"""


def _external(t: Tables):
    given = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")
    documents = whole_documents(t)
    chunks = documents.join(given, "chunk_id").unionByName(embed.embed(documents.join(given, "chunk_id", "left_anti"), hash_embedder(64)))
    chunks = staged(chunks.withColumn("doc_len", F.size(content_words(F.col("content")))), "chunks")
    questions = t.sql(inputs.QUESTIONS).join(t.embeddings.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), "qid")
    return chunks, staged(questions, "questions")


@query("hybrid_search", EXTERNAL_SQL + b.hybrid(EXTERNAL, K) + "\n" + _HIT)
def hybrid_search(t: Tables):
    """Hybrid search with vectors from a table, with the thresholds and the margin of a remote model."""
    chunks, questions = _external(t)
    return _hits(retrieve.hybrid_search(chunks, questions, EXTERNAL, k=K))


ALLOWED = f"""SELECT q.qid, l.document_id FROM ({inputs.QUESTIONS}) AS q JOIN ({inputs.LIBRARY}) AS l ON q.org = l.org JOIN labels ON labels.doc_id = l.document_id
 WHERE labels.quality = 1 AND q.qid % 4 <> 0"""
_RESTRICTED = "allowed AS (" + ALLOWED + "), allowed_q AS (SELECT item_id AS qid FROM benchmark WHERE item_id % 4 <> 0),\n"


@query("restricted_search", EXTERNAL_SQL + _RESTRICTED + b.hybrid(EXTERNAL, K, "allowed") + "\n" + _HIT)
def restricted_search(t: Tables):
    """Hybrid search in which most questions may only use documents of good quality."""
    chunks, questions = _external(t)
    ids = t.sql(ALLOWED).groupBy("qid").agg(F.collect_set("document_id").alias("ids"))
    limited = questions.join(ids, "qid", "left").withColumn(
        "document_ids", F.when(F.col("qid") % 4 != 0, F.coalesce("ids", F.array().cast("array<bigint>")))).drop("ids")
    return _hits(retrieve.hybrid_search(chunks, limited, EXTERNAL, k=K))


@query("fair_share", PASSAGES + VECTORS + b.hybrid(MODEL.name, K) + "\nSELECT qid, pos, rank, document_id FROM picked")
def fair_share(t: Tables):
    """Candidates picked in turns over documents."""
    kept = retrieve.relevance_gate(_candidates(t), MODEL.name)
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return retrieve.fair_share(kept, F.lit(K)).select("qid", big("pos"), big("rank"), "document_id")


@query("overview", PASSAGES + f"""firsts AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_id) AS turn, min(chunk_id) OVER (PARTITION BY document_id) AS f FROM chunks),
shown AS (SELECT *, row_number() OVER (PARTITION BY org ORDER BY turn, f) AS pos FROM firsts QUALIFY pos <= {K})
SELECT qid, pos, chunk_id, document_id, content FROM shown JOIN questions USING (org)""")
def overview(t: Tables):
    """Opening passages for broad questions."""
    found = retrieve.overview(library(t), t.sql(inputs.QUESTIONS), k=K)
    return found.select("qid", F.col("pos").cast("bigint").alias("pos"), "chunk_id", "document_id", "content")


OWN_IDS = "SELECT source AS org, CAST(floor(doc_id / 20) AS BIGINT) AS document_id, 'doc-' || CAST(doc_id AS STRING) || '.txt' AS document, text FROM documents"


@query("org_isolation", PASSAGES + VECTORS + b.hybrid(MODEL.name, K) + f""",
firsts AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_id) AS turn, min(chunk_id) OVER (PARTITION BY document_id) AS f FROM chunks),
shown AS (SELECT *, row_number() OVER (PARTITION BY org ORDER BY turn, f) AS place FROM firsts QUALIFY place <= {K})
SELECT p.qid, 'search' AS kind, p.pos, p.document_id // 20 AS document_id, c.document, c.content FROM picked p JOIN chunks c ON c.chunk_id = p.chunk_id
UNION ALL SELECT qid, 'overview', place, document_id // 20, document, content FROM shown JOIN questions USING (org)""")
def org_isolation(t: Tables):
    """Hits and opening passages where all organisations use the same document ids: those that each has when all ids differ."""
    chunks, questions = staged(passages(t.spread(OWN_IDS), MODEL), "chunks"), asked(t)
    rows = lambda found, kind: found.select("qid", F.lit(kind).alias("kind"), F.col("pos").cast("bigint").alias("pos"), "document_id", "document", "content")
    return rows(retrieve.hybrid_search(chunks, questions, MODEL.name, k=K), "search").unionByName(rows(retrieve.overview(chunks, questions, k=K), "overview"))


@query("mixed_dim_search", EXTERNAL_SQL.replace(f"FROM ({inputs.LIBRARY}))", f"FROM ({inputs.LIBRARY}) WHERE document_id % 9 <> 4)", 1) + b.hybrid(EXTERNAL, K) + "\n" + _HIT)
def mixed_dim_search(t: Tables):
    """Search where some vectors come from a model of another dimension: their passages take no part."""
    chunks, questions = _external(t)
    cut = F.when(F.col("chunk_id") % 9 == 4, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    return _hits(retrieve.hybrid_search(chunks.withColumn("embedding", cut), questions, EXTERNAL, k=K))


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/foliant/{uuid.uuid4().hex}/index"


@query("indexed_search", PASSAGES + VECTORS + b.hybrid(MODEL.name, K) + "\n" + _HIT)
def indexed_search(t: Tables):
    """Hybrid search over a stored index, which was built for all organisations."""
    path = _folder(t)
    search_index.refresh(path, library(t), MODEL, 1, consumed=True)
    return _hits(search_index.indexed_search(t.spark, path, asked(t), MODEL, k=K))


REPLACED = f"SELECT org, document_id, document, CASE WHEN document_id % 5 = 1 THEN {OTHER_TEXT} ELSE text END AS text FROM ({inputs.LIBRARY}) AS l"


@query("replaced_text_search", PASSAGES + VECTORS + b.hybrid(MODEL.name, K) + "\n" + _HIT)
def replaced_text_search(t: Tables):
    """Search over a stored index after a fifth of the documents got other texts under the same ids, and after all its versions were written as one."""
    path = _folder(t)
    search_index.refresh(path, staged(passages(t.spread(REPLACED), MODEL), "chunks", compression="zstd"), MODEL, 1, consumed=True)
    search_index.refresh(path, library(t), MODEL, 2, consumed=True)
    search_index.compact(t.spark, path, 3)
    search_index.store(t.spark, path).expire()
    return _hits(search_index.indexed_search(t.spark, path, asked(t), MODEL, k=K))


# the library as it was before: two organisations fewer, one without its documents of odd ids, one with other texts in half of its documents, one that is gone by now
BEFORE = """SELECT org, document_id, document, CASE WHEN org = 'src9' AND document_id % 40 = 9 THEN {other} ELSE text END AS text FROM ({lib}) AS l
 WHERE org NOT IN ('src3', 'src7') AND NOT (org = 'src5' AND document_id % 40 = 5)
 UNION ALL SELECT 'gone' AS org, document_id, document, text FROM ({lib}) AS l WHERE org = 'src3'""".format(lib=inputs.LIBRARY, other=OTHER_TEXT)
_OLD = f"(SELECT org, count(*) AS n, string_agg(md5(text), '' ORDER BY document_id) AS m FROM ({BEFORE}) GROUP BY org)"


@query("rebuild_stale", WHOLE + b.keyword_leg(POOL) + f""", now AS (SELECT org, count(*) AS n, string_agg(md5(content), '' ORDER BY document_id) AS m FROM chunks GROUP BY org), old AS {_OLD},
met AS (SELECT coalesce(now.org, old.org) AS org, now.n, CASE WHEN now.n = old.n AND now.m = old.m THEN 'kept' WHEN now.org IS NULL THEN 'drop' WHEN old.org IS NULL THEN 'build' ELSE 'rebuild' END AS action
 FROM now FULL JOIN old ON now.org = old.org),
fresh AS (SELECT c.org, count(*) AS written FROM chunks c LEFT JOIN ({BEFORE}) AS f ON f.org = c.org AND f.document_id = c.document_id AND f.text = c.content WHERE f.org IS NULL GROUP BY c.org)
SELECT org, action, coalesce(met.n, 0) AS passages, CASE WHEN action = 'kept' THEN 1 WHEN action = 'drop' THEN 0 ELSE 2 END AS version, coalesce(written, 0) AS written,
 coalesce(o.postings, 0) AS postings, coalesce(o.occurrences, 0) AS occurrences
FROM met LEFT JOIN fresh USING (org) LEFT JOIN (SELECT org, count(*) AS postings, sum(tf)::BIGINT AS occurrences FROM (SELECT org, chunk_id, term, any_value(tf) AS tf FROM postings GROUP BY ALL) WHERE (org, term) IN (SELECT (org, term) FROM asked) GROUP BY org) o USING (org)""")
def rebuild_stale(t: Tables):
    """A stored index that follows its library: what the second refresh did with every organisation, how many passages it wrote, and what a search then reads."""
    path, questions = _folder(t), t.spread(inputs.QUESTIONS)
    whole = lambda sql: embed.embed(t.spread(sql).select(
        "org", F.col("document_id").alias("chunk_id"), "document_id", "document", F.col("text").alias("content")), MODEL)
    search_index.refresh(path, staged(whole(BEFORE), "chunks"), MODEL, 1)
    actions = search_index.refresh(path, staged(whole(inputs.LIBRARY), "chunks"), MODEL, 2)
    read = search_index.opened(t.spark, path, questions).posted.groupBy("org").agg(F.count("*").alias("postings"), F.sum("tf").alias("occurrences"))
    written = search_index.store(t.spark, path).written("texts", 2).groupBy("org").agg(F.count("*").alias("written"))
    known = search_index.stamps(t.spark, path).select("org", F.col("chunks").alias("passages"), "version").join(actions, "org", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return known.join(read, "org", "left").join(written, "org", "left").select(
        "org", F.coalesce("action", F.lit("kept")).alias("action"), zero("passages"), zero("version"), zero("written"), zero("postings"), zero("occurrences"))


VOWELS = "aeiou"
OWN_MODEL = Embedder("vowels-6", 6, lambda texts: np.array([[*(x.count(v) for v in VOWELS), 1] for x in texts], np.float32).reshape(-1, 6))
_COUNTS = ", ".join(f"length(text) - length(replace(text, '{v}', ''))" for v in VOWELS)


@query("own_embedder", f"""SELECT doc_id, 6 AS dims, len(list_filter(v, lambda x: x > 0)) AS nonzero, list_position(v, list_max(v)) AS largest, 1.0::DOUBLE AS length
 FROM (SELECT doc_id, [{_COUNTS}, 1] AS v FROM documents)""")
def own_embedder(t: Tables):
    """Documents embedded by a model of the user's own, with its own dimension; vectors come out with length one."""
    vectors = embed.embed(t.spread("SELECT doc_id, text FROM documents"), OWN_MODEL, "text")
    big = lambda c, name: c.cast("bigint").alias(name)
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return vectors.select("doc_id", big(F.size("embedding"), "dims"), big(F.size(F.filter("embedding", lambda v: v > 0)), "nonzero"),
                          big(F.array_position("embedding", F.array_max("embedding")), "largest"), F.round(F.sqrt(squares), 4).alias("length"))


BLANKED = "SELECT source AS org, doc_id AS document_id, 'doc-' || CAST(doc_id AS STRING) || '.txt' AS document, CASE WHEN doc_id % 9 = 2 THEN '  ' || chr(10) WHEN doc_id % 9 = 6 THEN NULL ELSE text END AS text FROM documents"


@query("documents_without_text", f"SELECT org, document_id, '{fv.NO_INDEXABLE_TEXT}' AS error FROM ({BLANKED}) WHERE {b.strip('coalesce(text, chr(32))')} = ''")
def documents_without_text(t: Tables):
    """Documents that gave no passage, as error rows."""
    docs = t.spread(BLANKED)
    return chunk.documents_without_text(docs.select("org", "document_id"), passages(docs, MODEL), ["org", "document_id"])
