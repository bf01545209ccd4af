"""From documents to token files, in stages that each write their result and hand it to the next.

Quality first, since what goes early costs nothing later; then one document of each group of near duplicates, removal of benchmark passages, the mixture, and
the files of token ids. All stages but the last return the columns of ``documents``; columns beyond these are left out, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path as tokenizer_path

from foliant.llm.decontaminate import contaminated
from foliant.llm.mix import mixed, taken
from foliant.llm.quality import learn, scored
from foliant.llm.queries import domain, held_out, target_weights
from foliant.llm.similar import similar
from foliant.llm.tokenfile import read_tokens, write_tokens
from foliant.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject. It learns from the labels of the documents at hand.

    A null or empty text is scored as an empty one. Rows without an id are scored like any other but never learned from; repeated rows stay or go together. Nulls in
    other columns are kept. An empty table gives an empty one.
    """
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out=held_out)
    return scored(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with ``named``, which tells apart documents without an id or with the same id; rows of equal id and text share it.

    It sorts as the id does, documents without one last.
    """
    return docs.select(*COLUMNS, F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")).alias("named"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates, by id; documents alike in no other stay, and one of rows of equal id and text.

    Near duplicates share eight tenths of their five-word shingles. That is wider than the link of ``op9_similar`` (three words, nine tenths).
    """
    rows = keyed(docs)
    first = similar(rows, key="named", size=5, percent=80).where(F.col("named").eqNullSafe(F.col("component_id"))).select("named").distinct()
    return rows.join(first, "named", "left_semi").dropDuplicates(["named"]).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark occurs."""
    rows = keyed(docs)
    hit = contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="named").where("n_hit > 0").select("named").distinct()
    return rows.join(hit, "named", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes, of nine tenths of all tokens, by weights of domain, language and source.

    A null language or source is a branch of its own. Null, blank and empty texts have no tokens and are never taken. Rows without an id are drawn by their text; repeated rows follow each
    other in the draw. An empty table gives an empty one.
    """
    placed = docs.select(*COLUMNS).withColumn("domain", domain())
    return taken(mixed(placed, [F.col("domain"), F.col("lang"), F.col("source")], share=(9, 10), weights=target_weights(spark), seed=7)).select(*COLUMNS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as files of token ids, and what these files hold.

    A null text is an empty one: its end token alone. Rows without an id come first, rows with the same id side by side, each with its own stretch of ids. An empty table gives no row.
    """
    return read_tokens(write_tokens(docs, tokenizer_path("word_bpe_49k.json"), keep_words=False))


STAGES = [("quality", good), ("near_duplicates", distinct_texts), ("benchmark", without_benchmark), ("mixture", mixture), ("token_files", token_files)]

#: SQL can express neither the model nor the tokenizer: the stages are tested against plain versions of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    folder = f"{shared_folder(spark)}/foliant/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
