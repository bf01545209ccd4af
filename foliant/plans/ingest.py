"""From documents to a searchable library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guard import flag_suspicious
from ..functions.text import content_words
from ..functions.vectors import Embedder
from ..operators.chunk import chunk_documents
from ..operators.embed import embed, embed_distinct

ORDINALS = 1_000_000  # room for the passages of one document in a passage id


def passage_id(document_id: Column, ordinal: Column) -> Column:
    """Id of a passage within its organisation, in the order of documents and passages. It fails rather than take the id of another document."""
    beyond = F.raise_error(F.concat(F.lit("document with too many passages: "), document_id.cast("string")))
    return F.when(ordinal < ORDINALS, document_id * ORDINALS + ordinal).otherwise(beyond.cast("bigint"))


def passages(docs: DataFrame, model: Embedder, *, costly: bool = False) -> DataFrame:
    """Passages of documents (org, document_id bigint, document, text): cut, flagged, measured and embedded.

    Everything happens where the rows are. With a ``costly`` model, each distinct text is embedded once, which takes
    a shuffle.
    """
    cut = chunk_documents(docs.select("org", "document_id", "document", "text"))
    numbered = cut.select(
        "org", passage_id(F.col("document_id"), F.col("ordinal")).alias("chunk_id"), "document_id", "document",
        F.lit(None).cast("int").alias("page"), "ordinal", "content", F.size(content_words(F.col("content"))).alias("doc_len"))
    return (embed_distinct if costly else embed)(flag_suspicious(numbered, "content"), model)
