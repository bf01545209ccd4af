"""Web pages to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.html import html_to_text
from ..functions.text import safe_name, strip
from ..functions.urls import url_rejection



def page_intake(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """Replace ``html`` by ``name, kind, size, sha256, text, error``; refused URLs are not parsed."""
    judged = pages.withColumn("error", url_rejection(F.col(url)))
    read = judged.withColumn("__page", html_to_text(F.when(F.col("error").isNull(), F.col(html)), F.col(url))).drop(html)
    text, title = F.col("__page.text"), F.col("__page.title")
    short = F.length(strip(text)) < fv.MIN_PAGE_CHARS
    name = safe_name(F.when(title != "", title).otherwise(F.col(url)))
    return read.select(
        *[c for c in read.columns if c not in ("__page", "error")],
        F.when(name != "", name).otherwise(F.substring(url, 1, fv.MAX_NAME_CHARS)).alias("name"),
        F.lit("url").alias("kind"), F.octet_length(text).cast("bigint").alias("size"), F.sha2(text, 256).alias("sha256"),
        text.alias("text"), F.coalesce("error", F.when(short, fv.NO_PAGE_TEXT)).alias("error"),
    )
