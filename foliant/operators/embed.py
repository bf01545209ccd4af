"""Vectors of passages."""

from __future__ import annotations

from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import Embedder, embed_column


def embed(chunks: DataFrame, model: Embedder, text: str = "content", out: str = "embedding") -> DataFrame:
    """Add unit vectors without moving rows; right for models that cost less than a shuffle."""
    return chunks.withColumn(out, embed_column(F.col(text), model))


def embed_distinct(chunks: DataFrame, model: Embedder, text: str = "content", out: str = "embedding") -> DataFrame:
    """Add unit vectors, embedding every distinct text of the whole table once.

    Texts meet their vector by digest. A text that fills a large part of the table skews only the passage side of
    an inner join, which adaptive execution splits.
    """
    keyed = chunks.withColumn("__sha", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    distinct = keyed.groupBy("__sha").agg(F.first(text).alias("__text"))
    vectors = distinct.select("__sha", embed_column(F.col("__text"), model).alias(out))
    return keyed.join(vectors, "__sha").drop("__sha")


def stored_vectors(spark: SparkSession, path: str, model: Embedder, before: int | None = None) -> DataFrame:
    """``sha, embedding, run`` of all texts that ``model`` has embedded into a folder, in runs before ``before`` if given."""
    held = spark.read.schema("sha string, embedding array<float>, model string, run int")
    try:
        rows = held.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], "sha string, embedding array<float>, model string, run int")
    rows = rows.where(F.col("model") == model_folder(model)).drop("model")
    return rows if before is None else rows.where(F.col("run") < before)


def model_folder(model: Embedder) -> str:
    """Folder of a model's vectors; names may hold characters that paths may not."""
    return sha256(model.name.encode()).hexdigest()[:32]


def embed_stored(chunks: DataFrame, model: Embedder, path: str, run: int, text: str = "content", out: str = "embedding") -> DataFrame:
    """Add unit vectors, embedding only texts that no earlier run has embedded.

    Vectors are kept by model and digest of the text: what is new is written to a folder of its run, which the same run writes again if it is repeated. Rows then meet
    their vector by digest; a text that fills a large part of the table skews only the side of an inner join that adaptive execution splits.
    """
    spark = chunks.sparkSession
    keyed = chunks.withColumn("__sha", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    known = stored_vectors(spark, path, model, run)
    fresh = keyed.groupBy(F.col("__sha").alias("sha")).agg(F.first(text).alias("__text")).join(known.select("sha"), "sha", "left_anti")
    fresh.select("sha", embed_column(F.col("__text"), model).alias("embedding")).write.mode("overwrite").parquet(f"{path}/model={model_folder(model)}/run={run}")
    vectors = stored_vectors(spark, path, model, run + 1).select(F.col("sha").alias("__sha"), F.col("embedding").alias(out))
    return keyed.join(vectors, "__sha").drop("__sha")


def reembed_stale(chunks: DataFrame, model: Embedder, *, model_col: str = "embed_model", text: str = "content",
                  out: str = "embedding") -> DataFrame:
    """Embed again what another model embedded; the rest is passed on untouched."""
    columns = chunks.columns
    fresh = chunks.where(F.col(model_col).eqNullSafe(model.name))
    stale = chunks.where(~F.col(model_col).eqNullSafe(model.name)).drop(out, model_col)
    again = embed_distinct(stale, model, text, out).withColumn(model_col, F.lit(model.name))
    return fresh.unionByName(again.select(*columns))


def drop_wrong_dim(chunks: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Passages whose vector has another dimension do not take part in the index."""
    return chunks.where(F.size(vector) == dim)
