"""Index tables: postings, term and corpus statistics, staleness stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_words, stem


TASK_CHARS = 8_000_000  # of passages whose words are counted together


def postings(chunks: DataFrame, *, text: str = "content", terms: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """``org, chunk_id, term, tf, doc_len``. With ``terms`` (org, term), only these terms, kept before counting. Columns named in ``also`` are carried along: of
    passages with the same id, the largest value.

    For a whole index, passages are spread by id first: each text moves once, as it is, and cutting and counting its words stays local to
    the task, where grouping exploded words would move every posting. For given terms few postings are left, and
    these are grouped instead, so the corpus does not move at all.
    """
    texts = chunks.select("org", "chunk_id", *also, text)
    if terms is None:
        # counting holds every word of a task's passages, so the number of tasks follows the length of the texts
        chars = chunks.agg(F.sum(F.length(text))).first()[0] or 0
        texts = texts.repartition(max(chunks.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS)), "org", "chunk_id")
    words = texts.select("org", "chunk_id", *also, content_words(F.col(text)).alias("words"))
    # the outer form keeps Spark from testing the word list for emptiness first, which would tokenize twice
    exploded = words.select("org", "chunk_id", *also, F.size("words").alias("doc_len"), F.explode_outer("words").alias("word"))
    rows = exploded.where("word IS NOT NULL").select("org", "chunk_id", *also, "doc_len", stem(F.col("word")).alias("term"))
    if terms is not None:
        rows = rows.join(terms.select("org", "term").distinct(), ["org", "term"], "left_semi")
    return rows.groupBy("org", "chunk_id", "term").agg(F.count("*").alias("tf"), F.max("doc_len").alias("doc_len"), *[F.max(c).alias(c) for c in also])


def chunk_stats(chunks: DataFrame, *, text: str = "content") -> DataFrame:
    """``org, chunk_id, doc_len``; passages without terms count with length zero."""
    return chunks.select("org", "chunk_id", F.size(content_words(F.col(text))).alias("doc_len"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """``org, n, avg_len`` over all passages of an organisation; a stored ``doc_len`` is used if there is one."""
    lengths = chunks if "doc_len" in chunks.columns else chunk_stats(chunks)
    return lengths.groupBy("org").agg(F.count("*").alias("n"), F.avg("doc_len").alias("avg_len"))


def term_stats(posted: DataFrame) -> DataFrame:
    """``org, term, df``.

    Counts with a condition every posting meets: reading the same columns as the scores do, both use one exchange.
    """
    present = (F.col("tf") > 0) & (F.col("doc_len") > 0)
    return posted.groupBy("org", "term").agg(F.count(F.when(present, 1)).alias("df"))


#: Columns that make up a passage as a search shows or scores it.
CONTENT = ("chunk_id", "document", "page", "ordinal", "content", "suspicious", "embedding")


def content_digests(chunks: DataFrame, model: str) -> DataFrame:
    """``org, document_id, chunks, max_id, content_sum, content_xor, model`` of every document: sum and exclusive or of the 64-bit hashes of its passages.

    Both are made map-side, whatever the order of the passages. Columns of ``CONTENT`` that ``chunks`` has not are left out.
    """
    seen = F.xxhash64(*[F.col(c) for c in CONTENT if c in chunks.columns])
    return chunks.select("org", "document_id", "chunk_id", seen.alias("seen")).groupBy("org", "document_id").agg(
        F.count("chunk_id").alias("chunks"), F.max("chunk_id").alias("max_id"), F.sum(F.col("seen").cast("decimal(38,0)")).alias("content_sum"),
        F.bit_xor("seen").alias("content_xor")).withColumn("model", F.lit(model))


def fold_stamps(documents: DataFrame) -> DataFrame:
    """``org, chunks, max_id, content_sum, content_xor, model``: what the index of an organisation was built from, from the digests of its documents."""
    return documents.groupBy("org").agg(
        F.sum("chunks").alias("chunks"), F.max("max_id").alias("max_id"), F.sum("content_sum").cast("decimal(38,0)").alias("content_sum"),
        F.bit_xor("content_xor").alias("content_xor"), F.max("model").alias("model"))


def index_stamp(chunks: DataFrame, model: str) -> DataFrame:
    """The stamp of every organisation: it changes with the passages' number, ids, texts and vectors, and with the model."""
    return fold_stamps(content_digests(chunks, model))


STAMP = ("chunks", "max_id", "content_sum", "content_xor", "model")


def stale_orgs(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Organisations whose index must be built again, is new, or is to be dropped."""
    now, then = current.alias("now"), stored.alias("then")
    joined = now.join(then, F.col("now.org") == F.col("then.org"), "full_outer")
    same = F.lit(True)
    for column in STAMP:
        same = same & F.col(f"now.{column}").eqNullSafe(F.col(f"then.{column}"))
    action = (F.when(F.col("now.org").isNull(), "drop").when(F.col("then.org").isNull(), "build")
              .when(~same, "rebuild"))
    return joined.select(F.coalesce("now.org", "then.org").alias("org"), action.alias("action")).where("action IS NOT NULL")


def changed_documents(current: DataFrame, stored: DataFrame) -> DataFrame:
    """``org, document_id, gone``: documents whose passages differ from those stored, are new, or are no longer there."""
    now, then = current.alias("now"), stored.alias("then")
    joined = now.join(then, (F.col("now.org") == F.col("then.org")) & (F.col("now.document_id") == F.col("then.document_id")), "full_outer")
    same = F.lit(True)
    for column in STAMP:
        same = same & F.col(f"now.{column}").eqNullSafe(F.col(f"then.{column}"))
    return joined.where(~same).select(
        F.coalesce("now.org", "then.org").alias("org"), F.coalesce("now.document_id", "then.document_id").alias("document_id"), F.col("now.org").isNull().alias("gone"))
