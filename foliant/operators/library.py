"""Library views: lists, previews, totals, replacement, deletion, time travel, catalogue, removed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .ordered import carried, interval_join


def list_documents(docs: DataFrame, org: str | None = None) -> DataFrame:
    """Documents, newest first within an organisation."""
    if org is not None:
        docs = docs.where(F.col("org") == org)
    return docs.orderBy("org", F.desc("created_at"), "document_id")


def preview_chunks(chunks: DataFrame, limit: int = 200) -> DataFrame:
    """The first passages of every document given; filter by organisation and document beforehand.

    Ordinals run from 0 without gaps, so the limit is a filter the scan can use.
    """
    limit = max(1, min(limit, fv.MAX_PREVIEW))
    return chunks.where(F.col("ordinal") < limit).select("org", "document_id", "ordinal", "page", "content", "suspicious")


def usage_stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``org, documents, chunks, bytes``."""
    per_org = docs.groupBy("org").agg(F.count("*").alias("documents"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    pieces = chunks.groupBy("org").agg(F.count("*").alias("chunks"))
    return per_org.join(pieces, "org", "left").select("org", "documents", F.coalesce("chunks", F.lit(0)).alias("chunks"), "bytes")


def latest_by_name(docs: DataFrame, seq: str = "seq") -> DataFrame:
    """The last upload of every (org, name). Combined before the shuffle, so a name uploaded very often is no burden."""
    last = docs.groupBy("org", "name").agg(F.max(seq).alias(seq))
    return docs.join(last, ["org", "name", seq], "left_semi")


def chunks_of(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Passages of the given documents."""
    return chunks.join(docs.select("org", "document_id"), ["org", "document_id"], "left_semi")


def delete_documents(docs: DataFrame, deletions: DataFrame) -> DataFrame:
    """What is left after deletions (org, document_id); an id of another organisation deletes nothing."""
    return docs.join(deletions.select("org", "document_id").distinct(), ["org", "document_id"], "left_anti")


def clear_library(docs: DataFrame, orgs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left after clearing organisations, and ``org, removed``."""
    gone = docs.join(orgs.select("org").distinct(), "org", "left_semi")
    counted = orgs.select("org").distinct().join(gone.groupBy("org").agg(F.count("*").alias("removed")), "org", "left")
    return docs.join(orgs.select("org").distinct(), "org", "left_anti"), counted.fillna(0, ["removed"])


def library_as_of(events: DataFrame, at: Column | None = None) -> DataFrame:
    """``org, name, seq, ts``: documents alive after the events (org, seq, ts, action, name) up to a time.

    Actions are upload, delete and clear. Two aggregations that combine before the shuffle; no window.
    """
    if at is not None:
        events = events.where(F.col("ts") <= at)
    cleared = events.where("action = 'clear'").groupBy("org").agg(F.max("seq").alias("cleared"))
    last = events.where("action <> 'clear'").groupBy("org", "name").agg(
        F.max(F.struct("seq", "ts", "action")).alias("last"))
    alive = last.join(cleared, "org", "left").where(
        (F.col("last.action") == "upload") & (F.col("last.seq") > F.coalesce("cleared", F.lit(-1))))
    return alive.select("org", "name", "last.seq", "last.ts")


def name_intervals(events: DataFrame) -> DataFrame:
    """``org, name, seq, start, end`` of every upload among the events (org, seq, ts, action, name): from its time until the name is uploaded again or deleted or its library
    cleared; ``end`` is null if none of these happened. Within an organisation ``seq`` orders the events as ``ts`` does.
    """
    named = events.where("action <> 'clear'")
    following = Window.partitionBy("org", "name").orderBy("seq")
    until = named.withColumn("next", F.lead("ts").over(following)).where("action = 'upload'")
    # the next clearing: carried backwards over the events of the organisation, in ranges
    marked = until.select("org", "seq", "name", "ts", "next", F.lit(None).cast(events.schema["ts"].dataType).alias("clear")).unionByName(
        events.where("action = 'clear'").select("org", "seq", "name", "ts", F.col("ts").alias("next"), F.col("ts").alias("clear")))
    cleared = carried(marked.withColumn("back", -F.col("seq")), "org", ["back"], "clear", "cleared")
    return cleared.where("clear IS NULL").select("org", "name", "seq", F.col("ts").alias("start"), F.least("next", "cleared").alias("end"))


def library_at(questions: DataFrame, events: DataFrame) -> DataFrame:
    """``qid, org, name, seq``: the documents that the library of each question's organisation held at the question's own time ``at`` (a whole number, as ``ts`` of the events)."""
    return interval_join(questions.select("qid", "org", "at"), name_intervals(events), "org").select("qid", "org", "name", "seq")


def catalogue(docs: DataFrame) -> DataFrame:
    """``org, catalogue, listed``: the first 50 documents by name as one line, and how many these are."""
    order = Window.partitionBy("org").orderBy("name")
    first = docs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= fv.CATALOGUE_SIZE)
    pages = F.when(F.col("pages") > 0, F.concat(F.lit(", "), F.col("pages").cast("string"), F.lit(" pages")))
    line = F.concat("name", F.lit(" ("), F.upper("kind"), F.coalesce(pages, F.lit("")), F.lit(")"))
    ordered = F.array_sort(F.collect_list(F.struct("n", line.alias("line"))))
    return first.groupBy("org").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "; ").alias("catalogue"),
                                    F.count("*").alias("listed"))


def removed_documents(audit: DataFrame, current: DataFrame, now: Column, days: int = fv.REMOVED_DAYS) -> DataFrame:
    """``org, name, id``: documents deleted lately that are not back under the same or a similar name, with the id of
    the newest deletion.

    ``audit``: org, id, ts, action, target. Names overlap if equal without case, or if one holds the other and both
    have 8 characters. Names of the library and at most 40 deletions per organisation meet on what they share, by equality: no deletion is compared with every name.
    """
    recent = audit.where((F.col("action") == "document.delete") & (F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS")))
    newest = Window.partitionBy("org").orderBy(F.desc("id"))
    last = recent.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= fv.REMOVED_EVENTS)
    gone = last.where("target <> ''").groupBy("org", F.col("target").alias("name")).agg(F.max("id").alias("id"))
    names = current.select("org", F.col("name").alias("current"), F.lower("name").alias("low")).distinct()
    lost = gone.select("org", "name", F.lower("name").alias("low"))
    same = lost.join(names, ["org", "low"]).select("org", "name")
    inside = contained(lost, names.select("org", F.col("current").alias("other"), "low")).select("org", "name")
    around = contained(names, lost.select("org", F.col("name").alias("other"), "low")).select("org", F.col("other").alias("name"))
    back = same.unionByName(inside).unionByName(around).distinct()
    return gone.join(back, ["org", "name"], "left_anti")


def runs_of_letters(low: Column) -> Column:
    """All runs of as many characters as names must have to be compared, of a name that is long enough."""
    size = fv.FUZZY_MIN_CHARS
    return F.when(F.length(low) >= size, F.transform(F.sequence(F.lit(1), F.length(low) - size + 1), lambda i: F.substring(low, i, F.lit(size))))


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """Rows of ``short`` (org, low, ...) with those of ``long`` (org, low, ...) of the same organisation whose ``low`` contains theirs, both of at least 8 characters.

    They meet by equality: one run of 8 characters of the shorter name, that with the least hash, must be among those of the longer one. So names that merely
    begin alike do not meet.
    """
    chosen = F.array_min(F.transform(runs_of_letters(F.col("low")), lambda g: F.struct(F.xxhash64(g).alias("hash"), g.alias("gram"))))
    left = short.withColumn("gram", chosen["gram"]).where("gram IS NOT NULL")
    right = long.withColumn("gram", F.explode(F.array_distinct(runs_of_letters(F.col("low"))))).withColumnRenamed("low", "whole")
    return left.join(right, ["org", "gram"]).where(F.contains("whole", F.col("low")))
