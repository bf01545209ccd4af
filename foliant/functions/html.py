"""Readable text of web pages.

Which closing tag ends a dropped element depends on how elements nest, which regular expressions cannot follow;
the standard library's tokenizer does it page by page inside Arrow batches.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv


class _Reader(HTMLParser):
    """Collects the text nodes outside dropped elements, and the first title."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.dropped = 0  # open elements whose content is dropped
        self.nodes: list[str] = []
        self.node: list[str] = []
        self.title: list[str] | None = None
        self.in_title = False

    def flush(self) -> None:
        text = "".join(self.node)
        self.node.clear()
        if not text:
            return
        if self.in_title:
            self.title.append(text)
        if not self.dropped and text.strip():
            self.nodes.append(text.strip())

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag in fv.VOID_ELEMENTS:
            return
        if tag == "title" and self.title is None:
            self.title, self.in_title = [], True
        elif self.in_title:
            self.title.append("")  # a title holding elements has no single text
        self.open.append(tag)
        self.dropped += tag in fv.DROPPED_ELEMENTS

    def handle_startendtag(self, tag, attrs):
        self.flush()
        self.handle_starttag(tag, attrs)
        if tag not in fv.VOID_ELEMENTS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.flush()
        if tag not in self.open:
            return
        while True:
            closed = self.open.pop()
            self.dropped -= closed in fv.DROPPED_ELEMENTS
            if closed == "title":
                self.in_title = False
            if closed == tag:
                return

    def handle_data(self, data):
        self.node.append(data)

    def _boundary(self, _):
        self.flush()
        if self.in_title:
            self.title.append("")

    handle_comment = handle_decl = handle_pi = unknown_decl = _boundary


def read_page(html: str) -> tuple[str, str]:
    """Title (may be empty) and text of one page."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    lines = (line.strip() for node in reader.nodes for line in node.splitlines())
    title = reader.title[0].strip() if reader.title and len(reader.title) == 1 else ""
    return title, "\n".join(line for line in lines if line)


@F.pandas_udf(T.StructType().add("title", T.StringType()).add("text", T.StringType()))
def _read_pages(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(page or "") for page in html], columns=["title", "text"])


def html_to_text(html: Column, fallback: Column) -> Column:
    """Struct of title (``fallback`` if the page has none, at most 200 characters) and text."""
    page = _read_pages(html)
    title = F.when(page["title"] != "", page["title"]).otherwise(F.coalesce(fallback, F.lit("")))
    return F.struct(F.substring(title, 1, fv.MAX_NAME_CHARS).alias("title"), page["text"].alias("text"))
