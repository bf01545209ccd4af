"""Sinks: the library, in which documents replace documents of the same name, and the audit trail."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .segments import Store

log = logging.getLogger(__name__)


def library(spark: SparkSession, path: str) -> Store:
    """The library in a folder: documents by name, with tables that change together in one commit."""
    return Store(spark, path, "name")


def documents(spark: SparkSession, path: str, table: str = "documents") -> DataFrame:
    """What the library holds now of ``documents`` or ``chunks``."""
    return library(spark, path).read(table).drop("version")


def _next(store: Store) -> int:
    return max(store.versions(), default=0) + 1


def replace_documents(path: str, rows: DataFrame, version: int | None = None, *, chunks: DataFrame | None = None, errors: DataFrame | None = None) -> bool:
    """Write ``rows`` (org, name, ...), replacing what the library holds under the same organisation and name, with their ``chunks`` (org, name, ...).

    Only what is new is written. All tables change at once: before the commit's record is there, readers see none of it, after it all of it. With the
    number of a stream's batch as ``version``, a replay changes nothing (False). ``errors`` are added to a table of their own and replace nothing.
    """
    store = library(rows.sparkSession, path)
    held = store.read("documents")
    if held is not None and (lost := [c for c in held.columns if c not in (*rows.columns, "version")]):
        raise ValueError(f"the library has columns that the new rows lack: {lost}")
    tables = {"documents": rows, **({} if chunks is None else {"chunks": chunks})}
    entries = rows.select("org", "name").distinct().withColumn("gone", F.lit(False))
    return store.commit(_next(store) if version is None else version, entries, tables, {} if errors is None else {"errors": errors})


def remove_documents(path: str, names: DataFrame, version: int | None = None) -> bool:
    """Take documents (org, name) and their passages out of the library: tombstones only, nothing is rewritten."""
    store = library(names.sparkSession, path)
    entries = names.select("org", "name").distinct().withColumn("gone", F.lit(True))
    return store.commit(_next(store) if version is None else version, entries, {})


def append_audit(path: str, events: DataFrame, batch_id: int | None = None) -> bool:
    """Append audit events; a failure is logged and reported, never raised.

    With the number of a stream's batch, the batch is a folder of its own: a replay writes it again instead of adding to it, and a failure is raised, so
    that the stream tries again.
    """
    shaped = events.withColumn("target", F.substring(F.coalesce("target", F.lit("")), 1, fv.MAX_TARGET_CHARS))
    if "detail" not in events.columns:
        shaped = shaped.withColumn("detail", F.lit("{}"))
    shaped = shaped.withColumn("detail", F.coalesce("detail", F.lit("{}")))
    if batch_id is not None:
        shaped.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        return True
    try:
        shaped.write.mode("append").parquet(path)
    except Exception:
        log.exception("audit events were not written to %s", path)
        return False
    return True
