"""Usage counters, daily quotas and pages of the audit trail."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv


def count_usage(questions: DataFrame, metric: str = "queries") -> DataFrame:
    """``org, day, metric, value`` of answered questions (org, ts, outcome); blocked and failed ones do not count."""
    answered = questions.where("outcome = 'answered'")
    return answered.groupBy("org", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("value")).select(
        "org", "day", F.lit(metric).alias("metric"), "value")


def quota_state(usage: DataFrame, settings: DataFrame | None = None, default: int = fv.DAILY_QUESTIONS) -> DataFrame:
    """Add ``quota`` and ``exhausted`` to usage counters; ``settings`` (org, quota) overrides the default."""
    quota = F.lit(default)
    if settings is not None:
        usage, quota = usage.join(settings.select("org", "quota"), "org", "left"), F.coalesce("quota", F.lit(default))
    return usage.withColumn("quota", quota).withColumn("exhausted", F.col("value") >= F.col("quota"))


def admit_within_quota(questions: DataFrame, quota: int = fv.DAILY_QUESTIONS) -> DataFrame:
    """Add ``admitted`` to questions (org, id, ts, outcome): false once a day's quota of answered ones is used up.

    Only the ``quota`` first answered questions of an organisation and day are ranked; the last of these is the
    threshold the others are compared with, so a busy organisation is never gathered in one task.
    """
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = questions.withColumn("day", day)
    order = Window.partitionBy("org", "day").orderBy("ts", "id")
    ranked = rows.where("outcome = 'answered'").select("org", "day", "ts", "id").withColumn("n", F.row_number().over(order))
    last = ranked.where(F.col("n") <= quota).groupBy("org", "day").agg(
        F.max(F.struct("ts", "id")).alias("last"), F.count("*").alias("used")).where(F.col("used") == quota)
    met = rows.join(last.select("org", "day", "last"), ["org", "day"], "left")
    return met.withColumn("admitted", F.col("last").isNull() | (F.struct("ts", "id") <= F.col("last"))).drop("last")


def audit_page(audit: DataFrame, cursors: DataFrame | None = None, *, action: str | None = None, limit: int = 100) -> DataFrame:
    """The newest ``limit`` events of every organisation, older than its cursor (org, before_id) if it has one."""
    limit = max(1, min(limit, fv.MAX_AUDIT_PAGE))
    if action:
        audit = audit.where(F.col("action") == action[:fv.MAX_ACTION_CHARS])
    if cursors is not None:
        audit = audit.join(cursors.select("org", "before_id"), "org", "left").where(
            "before_id IS NULL OR before_id = 0 OR id < before_id").drop("before_id")
    order = Window.partitionBy("org").orderBy(F.desc("id"))
    return audit.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")
