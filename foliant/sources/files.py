"""File intake: capped reading, triage by name and content, decoding, scanned pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import fixed_values as fv
from ..functions.text import clean_layout, filled, safe_name
from ..session import staged


class FolderFiles(DataSource):
    """Files below a folder, by a listing of its own: also those without a byte, which Spark's file sources leave out.

    Options: ``path`` and ``cap``, the bytes beyond which a file's content is not read. Every folder directly below ``path`` is listed and read by a task of its
    own, so neither the names nor the contents of all files come together anywhere. Paths may have any scheme that Arrow's file systems know.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return "path string, length bigint, content binary"

    def reader(self, schema: T.StructType) -> FolderReader:
        return FolderReader(self.options["path"], int(self.options["cap"]))


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.deep = deep


class FolderReader(DataSourceReader):
    def __init__(self, path: str, cap: int):
        self.path, self.cap = path, cap

    def opened(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), re.sub("^file:", "", self.path))

    def partitions(self) -> list[Folder]:
        system, path = self.opened()
        below = system.get_file_info(fs.FileSelector(path))
        return [Folder(path, False)] + [Folder(x.path, True) for x in below if x.type == fs.FileType.Directory]

    def read(self, partition: Folder) -> Iterator[tuple[str, int, bytes | None]]:
        system, _ = self.opened()
        folders = [partition.value]
        while folders:  # one folder's listing at a time
            for x in system.get_file_info(fs.FileSelector(folders.pop())):
                if x.type == fs.FileType.Directory:
                    folders += [x.path] if partition.deep else []
                elif x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")):
                    content = None
                    if x.size <= self.cap:
                        with system.open_input_stream(x.path) as data:
                            content = data.read()
                    yield x.path, x.size, content


def read_files(spark: SparkSession, path: str, *, cap: int = fv.MAX_FILE_BYTES) -> DataFrame:
    """``batch, org, name, size, content, error`` of the files under ``path/<org>/<batch>/``.

    The content of a file over the cap is never read; it becomes an error row, and so does a file without a byte. Names that start with a dot or an
    underscore are left out, as Spark leaves them out.
    """
    spark.dataSource.register(FolderFiles)
    files = spark.read.format("folder_files").option("cap", cap).load(path)
    parts = F.split(F.col("path"), "/")
    error = F.when(F.col("length") > cap, F.lit(fv.FILE_TOO_LARGE.format(cap // fv.MB))).when(F.col("length") == 0, fv.EMPTY_FILE)
    return admit_batches(files.select(
        F.element_at(parts, -2).alias("batch"), F.element_at(parts, -3).alias("org"),
        safe_name(F.col("path")).alias("name"), F.col("length").alias("size"), "content", error.alias("error")))


def admit_batches(files: DataFrame, *, limit: int = fv.MAX_FILES_PER_BATCH) -> DataFrame:
    """Refuse every file of a batch that holds more files than allowed, and files without a usable name.

    Files are only counted, and only the batches over the limit are joined back: file contents need no shuffle unless
    these are very many.
    """
    sizes = files.groupBy("org", "batch").agg(F.count("*").alias("__files"))
    over = sizes.where(F.col("__files") > limit)
    error = (F.when(F.col("__files").isNotNull(), fv.TOO_MANY_FILES.format(limit))
             .when(F.col("name") == "", fv.BAD_FILE_NAME).otherwise(F.col("error")))
    return files.join(over, ["org", "batch"], "left").withColumn("error", error).drop("__files")


def triage_kind(files: DataFrame, name: str = "name", content: str = "content", *, kind: str = "kind", error: str = "kind_error") -> DataFrame:
    """Add ``kind`` from the extension and the first bytes, or the reason why a file has none."""
    ext, hint, raw = "__ext", "__hint", "__kind"
    data = F.col(content)
    look_up = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col(ext)]
    starts = lambda head: F.startswith(data, F.lit(head))
    pdf = F.hex(F.substring(data, 1, 1024)).rlike("^(?:20|09|0A|0B|0C|0D)*255044462D")
    webp = starts(b"RIFF") & (F.substring(data, 9, 4) == F.lit(b"WEBP"))
    valid = (F.when(F.col(raw) == "pdf", pdf)
             .when(F.col(raw).isin("docx", "pptx"), starts(b"PK\x03\x04"))
             .when(F.col(raw) == "image", starts(b"\x89PNG\r\n\x1a\n") | starts(b"\xff\xd8\xff") | webp)
             .otherwise(~F.contains(F.substring(data, 1, 8192), F.lit(b"\x00"))))
    reason = (
        F.when(F.col(hint).isNotNull(), filled(fv.OLD_FORMAT, F.col(ext), F.col(hint)))
        .when(F.col(raw).isNull(), filled(fv.UNSUPPORTED_TYPE, F.when(F.col(ext) == "", "unknown").otherwise(F.col(ext)), F.lit(fv.ALLOWED_LABEL)))
        .when(F.length(data) == 0, fv.EMPTY_FILE)
        .when(~valid, filled(fv.NOT_VALID, F.col(name), F.upper(raw))))
    named = files.withColumn(ext, F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)\z", 1)))
    judged = named.withColumns({raw: look_up(fv.KIND_BY_EXTENSION), hint: look_up(fv.LEGACY_HINTS)}).withColumn(error, reason)
    return judged.withColumn(kind, F.when(F.col(error).isNull(), F.col(raw))).drop(ext, hint, raw)


@F.pandas_udf(T.StringType())
def _utf16(content: pd.Series) -> pd.Series:
    def decode(data):
        try:
            return None if data is None else bytes(data).decode("utf-16")
        except UnicodeDecodeError:
            return None

    return content.map(decode)


def decoded(content: Column) -> Column:
    """Text of a file: UTF-8 without its mark, UTF-16 if it carries a mark, else Latin-1.

    Only files that begin with a UTF-16 mark are sent to Python, as the built-in decoder fails on malformed input.
    """
    as_utf8 = content.cast("string")
    head = F.substring(content, 1, 2)
    marked = F.when(~F.is_valid_utf8(as_utf8) & head.isin(F.lit(b"\xff\xfe"), F.lit(b"\xfe\xff")), content)
    return (F.when(F.is_valid_utf8(as_utf8), F.regexp_replace(as_utf8, r"^\ufeff", ""))
            .otherwise(F.coalesce(_utf16(marked), F.decode(content, "ISO-8859-1"))))


def text_segments(files: DataFrame, *, max_chars: int = fv.MAX_TEXT_CHARS) -> DataFrame:
    """Add ``kind``, ``text``, ``cut_chars`` and ``error``; text kinds are decoded and cleaned, the other kinds get their segments elsewhere.

    ``content`` is kept only where there is no text. ``cut_chars`` tells how many characters beyond ``max_chars`` a text has lost, 0 if none.
    """
    judged = triage_kind(files).withColumn("error", F.coalesce("error", "kind_error")).drop("kind_error")
    is_text = F.col("error").isNull() & F.col("kind").isin("txt", "md")
    read = judged.withColumn("__text", is_text).withColumn("__whole", decoded(F.when(F.col("__text"), F.col("content")))).withColumns({
        "text": clean_layout(F.substring("__whole", 1, max_chars)), "cut_chars": F.greatest(F.lit(0), F.length("__whole") - max_chars)})
    error = F.when(F.col("__text") & (F.col("text") == ""), fv.NO_TEXT).otherwise(F.col("error"))
    return read.withColumns({"error": error, "content": F.when(~F.col("__text"), F.col("content"))}).drop("__text", "__whole")


def split_accepted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and the rest.

    Rows are staged once: filtering an unread plan twice would parse and decode every file twice.
    """
    rows = staged(rows, "intake")
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL")


def failed_batches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, files, status, reason`` of batches from which nothing was accepted.

    A batch of allowed size has at most 10 reasons; a larger one is refused for its size alone.
    """
    counted = rows.groupBy(*keys).agg(
        F.count("*").alias("files"), F.count_if(F.col("error").isNull()).alias("accepted"), F.min("error").alias("first"),
        F.max(F.lower("error").rlike("quota|limit").cast("int")).alias("limited"))
    failed = counted.where("accepted = 0")
    order = Window.partitionBy(*keys).orderBy("name", "error")
    listed = rows.where("error IS NOT NULL").select(*keys, "name", "error").withColumn("n", F.row_number().over(order))
    reasons = listed.where(F.col("n") <= fv.MAX_FILES_PER_BATCH).groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("n", F.concat_ws(": ", "name", "error").alias("text")))).alias("reasons"))
    joined = F.substring(F.array_join(F.transform("reasons", lambda r: r["text"]), "; "), 1, 500)
    single = (F.col("files") == 1) | (F.col("files") > fv.MAX_FILES_PER_BATCH)
    return failed.join(reasons, keys).select(
        *keys, "files", F.when(F.col("limited") == 1, 413).otherwise(422).alias("status"),
        F.when(single, F.col("first")).otherwise(joined).alias("reason"))


def pages_needing_ocr(docs: DataFrame, segments: DataFrame, keys: list[str], *, limit: int = fv.MAX_OCR_PAGES) -> DataFrame:
    """``keys, page``: the first blank pages of documents that have no text or whose pages are mostly blank.

    ``docs``: keys and ``pages`` (at most 1000); ``segments``: keys and ``page``.
    """
    pages = docs.where("pages > 0").select(*keys, "pages", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page"))
    with_text = segments.select(*keys, "page").distinct().withColumn("__text", F.lit(1))
    marked = pages.join(with_text, [*keys, "page"], "left")
    document = Window.partitionBy(*keys)
    blank = F.col("__text").isNull()
    counted = marked.withColumns({"__blank": F.count_if(blank).over(document), "__any": F.count("__text").over(document)})
    wanted = counted.where(blank & ((F.col("__any") == 0) | (2 * F.col("__blank") >= F.col("pages"))))
    ranked = wanted.withColumn("__n", F.row_number().over(document.orderBy("page")))
    return ranked.where(F.col("__n") <= limit).select(*keys, "page")


def merge_ocr_segments(segments: DataFrame, transcribed: DataFrame, keys: list[str]) -> DataFrame:
    """Segments with the transcribed pages in page order: ``keys, seg_no, page, text``."""
    rows = segments.select(*keys, "page", "text").unionByName(transcribed.where("text <> ''").select(*keys, "page", "text"))
    order = Window.partitionBy(*keys).orderBy(F.coalesce("page", F.lit(0)))
    return rows.withColumn("seg_no", F.row_number().over(order)).select(*keys, "seg_no", "page", "text")
