"""Retrieval: keyword and hybrid search, relevance gate, fair share over documents.

Questions: ``qid`` (bigint), ``org``, ``query``, ``qvec`` and optionally ``k`` and ``document_ids``. Passages: ``org``,
``chunk_id``, ``document_id``, ``document``, ``page``, ``ordinal``, ``content``, ``suspicious``, ``embedding``.
Sums of scores are kept in whole units of 1e-9, so a result does not depend on the order in which tasks finish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import query_terms, strip
from ..functions.vectors import inner_product
from ..session import staged
from .dense import SCORE_DIGITS, dense_topk, rank_dense
from .index import corpus_stats, postings, term_stats

UNIT = 1_000_000_000
PASSAGE = ["document", "page", "content", "suspicious"]


def pool_size(k: int) -> int:
    """Candidates per leg."""
    return max(fv.MIN_POOL, 6 * k)


def clamp_k(k: Column) -> Column:
    return F.greatest(F.lit(1), F.least(k, F.lit(fv.MAX_K))).cast("int")


def explode_terms(questions: DataFrame) -> DataFrame:
    """``qid, org, term, n_terms``: the distinct terms of each question."""
    terms = questions.select("qid", "org", query_terms(F.col("query")).alias("terms"))
    return terms.select("qid", "org", F.size("terms").alias("n_terms"), F.explode_outer("terms").alias("term")).where("term IS NOT NULL")


def bm25_parts(terms: DataFrame, posted: DataFrame, corpus: DataFrame) -> DataFrame:
    """``qid, chunk_id, part, n_terms``: what each term of a question adds to each passage of its organisation.

    Document frequencies and lengths are those of the whole organisation.
    """
    k1, b = fv.BM25_K1, fv.BM25_B
    weights = term_stats(posted).join(corpus, "org").withColumn(
        "idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    length = F.col("doc_len") / F.when(F.col("avg_len") > 0, F.col("avg_len")).otherwise(1.0)
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length))
    asked = terms.join(weights, ["org", "term"])
    met = posted.join(asked, ["org", "term"])
    return met.select("qid", "chunk_id", F.round(part * UNIT).cast("bigint").alias("part"), "n_terms")


def keyword_scores(parts: DataFrame) -> DataFrame:
    """``qid, chunk_id, bm25, coverage`` of every passage that holds a term of the question."""
    return parts.groupBy("qid", "chunk_id").agg(
        (F.sum("part") / UNIT).alias("bm25"), (F.count("*") / F.max("n_terms")).alias("coverage"))


def rank_keyword(scored: DataFrame, pool: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("bm25"), "chunk_id")
    return scored.withColumn("lexical_rank", F.row_number().over(order)).where(F.col("lexical_rank") <= pool)


def bm25_scores(chunks: DataFrame, questions: DataFrame, *, posted: DataFrame | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """``qid, chunk_id, bm25, coverage`` of all passages that hold a term. Restricted questions see only their documents,
    but document frequencies and lengths stay those of the organisation. Postings and statistics are made here unless an index gives them."""
    terms = explode_terms(questions)
    parts = bm25_parts(terms, postings(chunks, terms=terms) if posted is None else posted, corpus_stats(chunks) if corpus is None else corpus)
    if "document_ids" in questions.columns:
        limited = questions.select("qid", F.col("document_ids").isNotNull().alias("limited"))
        allowed = restricted_chunks(chunks, questions).select("qid", "chunk_id").withColumn("allowed", F.lit(True))
        parts = parts.join(limited, "qid").join(allowed, ["qid", "chunk_id"], "left").where("allowed OR NOT limited")
    return keyword_scores(parts)


def bm25_topk(chunks: DataFrame, questions: DataFrame, pool: int, *, posted: DataFrame | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """``qid, chunk_id, bm25, coverage, lexical_rank``: keyword leg."""
    return rank_keyword(bm25_scores(chunks, questions, posted=posted, corpus=corpus), pool)


def thresholds(model: str) -> tuple[float, float, float | None]:
    """Least cosine, least coverage and margin for a model."""
    return next((least, cover, margin) for prefix, least, cover, margin in fv.RELEVANCE_THRESHOLDS
                if model.startswith(prefix))


def restrict(questions: DataFrame) -> DataFrame:
    """``qid, org, document_id``: the documents a restricted question may use."""
    return questions.where("document_ids IS NOT NULL").select("qid", "org", F.explode("document_ids").alias("document_id")).distinct()


def restricted_chunks(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Passages of the documents each restricted question names (at most 100 documents)."""
    return chunks.join(restrict(questions), ["org", "document_id"])


def dense_leg(chunks: DataFrame, questions: DataFrame, pool: int) -> DataFrame:
    """``qid, chunk_id, document_id, sim, dense_rank``; restricted questions are ranked over their own documents only. Passages that a question names in
    ``wanted`` come too, with a null rank if they are not among the nearest."""
    if "document_ids" not in questions.columns:
        return dense_topk(chunks, questions, pool)
    owned = restricted_chunks(chunks, questions).select("qid", "chunk_id", "document_id", "embedding")
    near = owned.join(questions.select("qid", "qvec", *[c for c in ("wanted",) if c in questions.columns]), "qid").where("size(embedding) = size(qvec)")
    wanted = F.coalesce(F.array_contains("wanted", F.col("chunk_id")), F.lit(False)) if "wanted" in questions.columns else F.lit(False)
    scored = near.select("qid", "chunk_id", "document_id", similarity(F.col("embedding"), F.col("qvec")).alias("sim"), wanted.alias("named"))
    order = Window.partitionBy("qid").orderBy(F.desc("sim"), "chunk_id")  # the passages of a hundred documents at most
    ranked = scored.withColumn("dense_rank", F.row_number().over(order)).where((F.col("dense_rank") <= pool) | F.col("named"))
    own = ranked.select("qid", "chunk_id", "document_id", "sim", F.when(F.col("dense_rank") <= pool, F.col("dense_rank")).alias("dense_rank"))
    return dense_topk(chunks, questions.where("document_ids IS NULL"), pool).unionByName(own)


def similarity(left: Column, right: Column) -> Column:
    return F.round(inner_product(left, right), SCORE_DIGITS) + F.lit(0.0)


def candidates(chunks: DataFrame, questions: DataFrame, pool: int, **index: DataFrame | None) -> DataFrame:
    """``qid, chunk_id, document_id, sim, coverage, dense_rank, lexical_rank``: passages either leg ranks within ``pool``.

    The dense leg scores what the keyword leg found while it meets all vectors anyway, and word coverage of what it finds itself is known from the postings: so
    neither a text nor a vector is looked up. A passage whose vector cannot be compared with a question's takes no part in it.
    """
    # read three times: for ranks, for what the dense leg is to score, and for coverage
    scores = staged(bm25_scores(chunks, questions, **index), "scores")
    keyword = rank_keyword(scores, pool)
    named = keyword.groupBy("qid").agg(F.collect_list("chunk_id").alias("wanted"))  # at most ``pool`` for a question
    nearest = dense_leg(chunks, questions.join(named, "qid", "left"), pool)
    found = nearest.join(keyword.select("qid", "chunk_id", "lexical_rank"), ["qid", "chunk_id"], "left").join(
        scores.select("qid", "chunk_id", "coverage"), ["qid", "chunk_id"], "left")
    return found.select("qid", "chunk_id", "document_id", "sim", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "dense_rank", "lexical_rank")


def rrf_fuse(ranked: DataFrame) -> DataFrame:
    """Add ``fused``, the sum of reciprocal ranks of both legs, and ``rank`` within the question.

    Equal sums keep the order dense first, then keyword.
    """
    leg = lambda rank: F.coalesce(1.0 / (fv.RRF_K + F.col(rank)), F.lit(0.0))
    order = Window.partitionBy("qid").orderBy(
        F.desc("fused"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank"))
    return ranked.withColumn("fused", leg("dense_rank") + leg("lexical_rank")).withColumn("rank", F.row_number().over(order))


def relevance_gate(fused: DataFrame, model: str, min_score: float | None = None) -> DataFrame:
    """Keep candidates near enough to the question or holding enough of its words."""
    least, cover, margin = thresholds(model)
    least = least if min_score is None else min_score
    near = F.col("sim") >= least
    if margin is not None:
        fused = margin_floor(fused, margin)
        near = near & (F.col("sim") >= F.col("floor"))
    return fused.where(near | (F.coalesce("coverage", F.lit(0.0)) >= cover))


def margin_floor(fused: DataFrame, margin: float) -> DataFrame:
    """Add ``floor``: the best cosine among a question's candidates less the margin."""
    return fused.withColumn("floor", F.max("sim").over(Window.partitionBy("qid")) - margin)


def fair_share(ranked: DataFrame, k: Column, *, document: str = "document_id", order: str = "rank") -> DataFrame:
    """Pick ``k`` candidates in turns over documents, from the first ``2k`` of each question; adds ``pos``."""
    question = Window.partitionBy("qid")
    top = ranked.withColumn("__n", F.row_number().over(question.orderBy(order))).where(
        (F.col("__n") <= 2 * fv.MAX_K) & (F.col("__n") <= 2 * k))
    return take_turns(top.drop("__n"), k, document=document, order=order)


def take_turns(ranked: DataFrame, k: Column, *, document: str, order: str) -> DataFrame:
    """Round-robin: the first of each document, documents in order of first appearance, then the second, ..."""
    per_document = Window.partitionBy("qid", document)
    turns = (ranked.withColumn("__turn", F.row_number().over(per_document.orderBy(order)))
             .withColumn("__first", F.min(order).over(per_document)))
    pick = Window.partitionBy("qid").orderBy("__turn", "__first")
    return (turns.withColumn("pos", F.row_number().over(pick)).where((F.col("pos") <= fv.MAX_K) & (F.col("pos") <= k))
            .drop("__turn", "__first"))


def hits(picked: DataFrame, texts: DataFrame) -> DataFrame:
    """The picked passages with what is shown of them; the score is the cosine.

    Picks are written first: they are few, so that Spark, which then knows their size, sends them to the passages and not the passages to them.
    """
    few = staged(picked.select("qid", "org", "pos", "chunk_id", F.col("sim").alias("score")), "picked")
    return few.join(texts.select("org", "chunk_id", "document_id", *PASSAGE), ["org", "chunk_id"]).select(
        "qid", "org", "pos", "chunk_id", "document_id", *PASSAGE, "score")


def comparable(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Passages whose vectors have the dimension of the questions' vectors; others are in neither leg nor in the statistics of words."""
    # a row for each model in use, written so that Spark knows it is small: nearly all passages have one dimension, which must not become a shuffle's key
    dims = staged(questions.select(F.size("qvec").alias("__dim")).distinct(), "dims")
    return chunks.withColumn("__dim", F.size("embedding")).join(dims, "__dim", "left_semi").drop("__dim")


def hybrid_search(chunks: DataFrame, questions: DataFrame, model: str, *, k: int = fv.DEFAULT_K, min_score: float | None = None,
                  posted: DataFrame | None = None, corpus: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Both legs, fusion, gate and fair share for a table of questions. Blank questions find nothing.

    With a ``k`` per question, the legs rank within the pool of the largest k allowed and the question's own pool
    cuts afterwards. ``posted``, ``corpus`` and ``texts`` come from a stored index, whose ``chunks`` (org, chunk_id, document_id, embedding) then hold one dimension only.
    Without them ``chunks`` is read four times: for statistics, postings, vectors, and the texts of the hits; it should be a written table.
    """
    own_k = "k" in questions.columns
    asked = questions.where(strip(F.col("query")) != "").withColumn(
        "k", clamp_k(F.coalesce(F.col("k"), F.lit(k)) if own_k else F.lit(k)))
    chunks = comparable(chunks, asked) if posted is None else chunks
    found = candidates(chunks, asked, pool_size(fv.MAX_K if own_k else min(max(k, 1), fv.MAX_K)), posted=posted, corpus=corpus)
    known = found.join(asked.select("qid", "org", "k"), "qid")
    if own_k:
        pool = F.greatest(F.lit(fv.MIN_POOL), 6 * F.col("k"))
        for rank in ("dense_rank", "lexical_rank"):
            known = known.withColumn(rank, F.when(F.col(rank) <= pool, F.col(rank)))
    known = known.where("dense_rank IS NOT NULL OR lexical_rank IS NOT NULL")
    kept = relevance_gate(rrf_fuse(known), model, min_score)
    return hits(fair_share(kept, F.col("k")), chunks if texts is None else texts)


def overview(chunks: DataFrame, questions: DataFrame, *, k: int = fv.DEFAULT_K) -> DataFrame:
    """Opening passages of the documents of each question's organisation, in turns, with score zero.

    Only the first passages of a document can be picked, so the scan keeps few rows per document; the best per
    organisation are found once and shared by its questions. Questions restricted to documents bring their own.
    """
    own_k = "k" in questions.columns
    asked = questions.withColumn("k", clamp_k(F.coalesce(F.col("k"), F.lit(k)) if own_k else F.lit(k)))
    opening = (chunks.where(F.col("ordinal") < fv.MAX_K).select("org", "document_id", "chunk_id")
               .join(asked.select("org").distinct(), "org", "left_semi"))
    shared = take_turns(opening.withColumnRenamed("org", "qid"), F.lit(fv.MAX_K), document="document_id", order="chunk_id")
    shared = shared.withColumnRenamed("qid", "org")
    if "document_ids" in questions.columns:
        own = take_turns(opening.join(restrict(asked), ["org", "document_id"]), F.lit(fv.MAX_K), document="document_id", order="chunk_id")
        picked = shared.join(asked.where("document_ids IS NULL").select("qid", "org", "k"), "org").unionByName(
            own.join(asked.select("qid", "k"), "qid"))
    else:
        picked = shared.join(asked.select("qid", "org", "k"), "org")
    return hits(picked.where("pos <= k").withColumn("sim", F.lit(0.0)), chunks)
