"""Queries over usage, quotas, limits and their streaming forms."""

import uuid

from pyspark.sql import functions as F

from ..operators import folds, usage
from ..session import shared_folder
from ..sources.library_sink import append_audit
from ..streaming import jobs
from . import inputs
from .registry import Tables, query

QUOTA = 20
USAGE = f"asked AS ({inputs.ASKED}), counted AS (SELECT org, strftime(ts, '%Y-%m-%d') AS day, 'queries' AS metric, count(*) AS value FROM asked WHERE outcome = 'answered' GROUP BY ALL)"


@query("count_usage", f"WITH {USAGE} SELECT * FROM counted")
def count_usage(t: Tables):
    """Answered questions per organisation and day."""
    return usage.count_usage(t.sql(inputs.ASKED))


QUOTAS = "SELECT 'org' || CAST(n_nationkey AS STRING) AS org, 5 + n_nationkey AS quota FROM nation WHERE n_nationkey < 9"


@query("quota_state", f"WITH {USAGE}, quotas AS ({QUOTAS}) SELECT c.org, day, value, coalesce(quota, {QUOTA})::BIGINT AS quota, (value >= coalesce(quota, {QUOTA}))::INT::BIGINT AS exhausted FROM counted c LEFT JOIN quotas q ON q.org = c.org")
def quota_state(t: Tables):
    """Days on which an organisation used up its questions."""
    state = usage.quota_state(usage.count_usage(t.sql(inputs.ASKED)), t.sql(QUOTAS), QUOTA)
    return state.select("org", "day", "value", F.col("quota").cast("bigint").alias("quota"), F.col("exhausted").cast("bigint").alias("exhausted"))


@query("admit_within_quota", f"""WITH asked AS ({inputs.ASKED}) SELECT org, id, (coalesce(sum(CASE WHEN outcome = 'answered' THEN 1 ELSE 0 END) OVER (PARTITION BY org, ts::DATE ORDER BY ts, id
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {QUOTA})::INT::BIGINT AS admitted FROM asked""")
def admit_within_quota(t: Tables):
    """Questions asked before the day's quota was used up."""
    return usage.admit_within_quota(t.sql(inputs.ASKED), QUOTA).select("org", "id", F.col("admitted").cast("bigint").alias("admitted"))


CURSORS = "SELECT 'org' || CAST(n_nationkey AS STRING) AS org, n_nationkey * 100 AS before_id FROM nation WHERE n_nationkey < 8"


@query("audit_page", f"""WITH trail AS ({inputs.TRAIL}), cursors AS ({CURSORS}) SELECT t.org, id, action, target FROM trail t LEFT JOIN cursors c ON c.org = t.org
 WHERE before_id IS NULL OR before_id = 0 OR id < before_id QUALIFY row_number() OVER (PARTITION BY t.org ORDER BY id DESC) <= 25""")
def audit_page(t: Tables):
    """A page of the trail of every organisation."""
    return usage.audit_page(t.sql(inputs.TRAIL), t.sql(CURSORS), limit=25).select("org", "id", "action", "target")


@query("audit_page_by_action", f"WITH trail AS ({inputs.TRAIL}) SELECT org, id, target FROM trail WHERE action = 'document.delete' QUALIFY row_number() OVER (PARTITION BY org ORDER BY id DESC) <= 500")
def audit_page_by_action(t: Tables):
    """The newest deletions of every organisation."""
    return usage.audit_page(t.sql(inputs.TRAIL), action="document.delete", limit=1000).select("org", "id", "target")


LIMIT, WINDOW = 3, 6 * 3600


def hits(t: Tables):
    return t.events.select(F.concat(F.lit("chat:u:"), F.col("user_id").cast("string")).alias("key"), folds.micros("ts").alias("at"),
                           F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))


RATE_SQL = f"""WITH RECURSIVE e AS (SELECT 'chat:u:' || user_id AS key, event_id AS id, epoch_us(ts) AS tick, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT key, id, rn, [tick] AS log, true AS allowed, 0::BIGINT AS retry_after FROM e WHERE rn = 1
 UNION ALL SELECT key, id, rn, CASE WHEN len(live) < {LIMIT} THEN list_append(live, tick) ELSE live END, len(live) < {LIMIT},
 CASE WHEN len(live) < {LIMIT} THEN 0 ELSE greatest(1, ({WINDOW * 1000000} - (tick - live[1])) // 1000000 + 1) END
 FROM (SELECT e.*, list_filter(r.log, lambda x: e.tick - x <= {WINDOW * 1000000}) AS live FROM r JOIN e ON e.key = r.key AND e.rn = r.rn + 1))
SELECT key, id, allowed::INT::BIGINT AS allowed, retry_after FROM r"""


def _limited(df):
    return df.select("key", "id", F.col("allowed").cast("bigint").alias("allowed"), "retry_after")


@query("rate_limit", RATE_SQL)
def rate_limit(t: Tables):
    """Hits within a sliding limit; refused ones are not remembered."""
    return _limited(folds.rate_limit(hits(t).drop("ts"), limit=LIMIT, window=WINDOW))


@query("rate_limit_sliced", RATE_SQL)
def rate_limit_sliced(t: Tables):
    """The same with slices much smaller than a key, as for keys too large for a task."""
    largest = hits(t).groupBy("key").count().agg(F.max("count")).first()[0]
    return _limited(folds.rate_limit(hits(t).drop("ts"), limit=LIMIT, window=WINDOW, slice_rows=max(largest - 1, 1)))


def attempts(t: Tables):
    return t.events.select("user_id", F.floor(folds.micros("ts") / 1000).alias("at"), F.col("event_id").alias("id"),
                           (F.col("event_type") == "purchase").alias("ok"), F.col("ts").cast("timestamp").alias("ts"))


LOCK_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id AS id, epoch_us(ts) // 1000 AS tick, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events),
r AS (SELECT user_id, id, rn, CASE WHEN ok THEN 'success' ELSE 'failed' END AS outcome, CASE WHEN ok THEN 0 ELSE 1 END AS failures, NULL::BIGINT AS until FROM e WHERE rn = 1
 UNION ALL SELECT user_id, id, rn, CASE WHEN locked THEN 'locked' WHEN ok THEN 'success' WHEN failures >= 4 THEN 'lock' ELSE 'failed' END,
 CASE WHEN locked THEN failures WHEN ok OR failures >= 4 THEN 0 ELSE failures + 1 END, CASE WHEN locked THEN until WHEN ok THEN NULL WHEN failures >= 4 THEN tick + 900000000 ELSE until END
 FROM (SELECT e.*, r.failures, r.until, coalesce(r.until > e.tick, false) AS locked FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT user_id, id, outcome, failures::BIGINT AS failures FROM r"""


@query("lockout", LOCK_SQL)
def lockout(t: Tables):
    """Log-ins under lock-out, events standing for attempts on a faster clock."""
    return folds.lockout(attempts(t).drop("ts")).select("user_id", "id", "outcome", F.col("failures").cast("bigint").alias("failures"))


ONE_KEY = LOCK_SQL.replace("SELECT user_id, event_id AS id", "SELECT 1 AS user_id, event_id AS id", 1).replace("PARTITION BY user_id ORDER", "ORDER", 1)


@query("lockout_one_key", ONE_KEY)
def lockout_one_key(t: Tables):
    """All attempts on one account, cut into slices much smaller than that."""
    rows = attempts(t).drop("ts").withColumn("user_id", F.lit(1))
    done = folds.ordered_fold(rows, "user_id", ["at", "id"], folds.Lockout(), slice_rows=max(min(rows.count() // 7, folds.SLICE_ROWS), 1))
    return done.select("user_id", "id", "outcome", F.col("failures").cast("bigint").alias("failures"))


def token_uses(t: Tables):
    at = F.floor(folds.micros("ts") / 20000)
    return t.events.select(F.concat_ws("-", "user_id", (F.col("event_id") % 3).cast("string")).alias("family"), at.alias("at"), F.col("event_id").alias("id"),
                           F.concat_ws(":", "event_type", F.floor(F.col("value")).cast("bigint").cast("string")).alias("token"),
                           (at + F.when(F.col("event_id") % 10 == 7, -1).otherwise(1)).alias("expires_at"), F.col("ts").cast("timestamp").alias("ts"))


TOKEN_SQL = """WITH RECURSIVE e AS (SELECT user_id || '-' || event_id % 3 AS family, event_id AS id, epoch_us(ts) // 20000 AS tick, event_type || ':' || floor(value)::BIGINT AS token,
 event_id % 10 = 7 AS expired, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY epoch_us(ts) // 20000, event_id) AS rn FROM events),
r AS (SELECT family, id, rn, CASE WHEN expired THEN 'expired' ELSE 'rotated' END AS outcome, CASE WHEN expired THEN MAP {'': 0::BIGINT} ELSE MAP {token: tick} END AS rotated, false AS revoked FROM e WHERE rn = 1
 UNION ALL SELECT family, id, rn, o, CASE WHEN o = 'rotated' THEN map_concat(rotated, MAP {token: tick}) ELSE rotated END, revoked OR o = 'reuse'
 FROM (SELECT e.*, r.rotated, r.revoked, CASE WHEN e.tick - r.rotated[e.token] <= 10000000 THEN 'benign' WHEN r.rotated[e.token] IS NOT NULL OR r.revoked THEN 'reuse' WHEN expired THEN 'expired' ELSE 'rotated' END AS o
  FROM r JOIN e ON e.family = r.family AND e.rn = r.rn + 1))
SELECT family, id, outcome FROM r"""


@query("token_reuse", TOKEN_SQL)
def token_reuse(t: Tables):
    """Uses of rotating tokens, families revoked after a late reuse."""
    return folds.token_reuse(token_uses(t).drop("ts")).select("family", "id", "outcome")


# ---------------------------------------------------------------- streams, run over the whole table until it is read
def stream(t: Tables):
    """The events table as a stream."""
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)


def finished(df, t: Tables):
    """Run a stream to the end of its input and read what it wrote."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = f"{shared_folder(t.spark)}/foliant/{uuid.uuid4().hex}"
    run = df.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out")
    run.awaitTermination()
    return t.spark.read.schema(df.schema).parquet(f"{path}/out")


class Streamed(Tables):
    """Tables of which ``events`` is a stream."""

    def __getattr__(self, name):
        return stream(Tables(self.spark, self.folder)) if name == "events" else super().__getattr__(name)


@query("usage_stream", f"WITH {USAGE} SELECT org, day, value FROM counted WHERE day::TIMESTAMP + INTERVAL 1 DAY <= (SELECT max(ts) FROM asked WHERE outcome = 'answered') - INTERVAL 1 HOUR")
def usage_stream(t: Tables):
    """Answered questions per organisation and finished day, counted as they arrive."""
    events = stream(t).select(
        F.concat(F.lit("org"), (F.col("user_id") % 12).cast("string")).alias("org"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "blocked").otherwise("answered").alias("outcome"))
    return finished(jobs.usage_stream(events), t)


@query("rate_limit_stream", RATE_SQL)
def rate_limit_stream(t: Tables):
    """The sliding limit on a stream."""
    return _limited(finished(jobs.rate_limit_stream(hits(Streamed(t.spark, t.folder)), LIMIT, WINDOW), t))


@query("lockout_stream", LOCK_SQL)
def lockout_stream(t: Tables):
    """Lock-out on a stream."""
    done = finished(jobs.lockout_stream(attempts(Streamed(t.spark, t.folder))), t)
    return done.select("user_id", "id", "outcome", F.col("failures").cast("bigint").alias("failures"))


@query("token_stream", TOKEN_SQL)
def token_stream(t: Tables):
    """Token families on a stream."""
    return finished(jobs.token_stream(token_uses(Streamed(t.spark, t.folder))), t).select("family", "id", "outcome")


LATE = "CASE WHEN event_id % 13 = 5 THEN 3601 ELSE CAST(event_id % 3600 AS INT) END"


@query("split_late", f"SELECT event_id, CASE WHEN {LATE} > 3600 THEN 'late' ELSE 'in time' END AS state FROM events")
def split_late(t: Tables):
    """Events that arrived in time and events for the side table."""
    arrived = F.expr(f"ts + make_dt_interval(0, 0, 0, {LATE})")
    good, late = jobs.split_late(t.events.withColumn("arrived", arrived))
    return good.select("event_id", F.lit("in time").alias("state")).unionByName(late.select("event_id", F.lit("late").alias("state")))


@query("late_rows", f"SELECT event_id, user_id FROM events WHERE {LATE} > 3600")
def late_rows(t: Tables):
    """The side table of a stream whose rows arrive at different delays."""
    arrived = F.expr(f"ts + make_dt_interval(0, 0, 0, {LATE})")
    path = f"{shared_folder(t.spark)}/foliant/{uuid.uuid4().hex}"
    jobs.late_stream(stream(t).withColumn("arrived", arrived), f"{path}/late", f"{path}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{path}/late").select("event_id", "user_id")


VERY_LATE = "CASE WHEN event_id % 13 = 5 THEN 7200 + CAST(event_id % 50000 AS INT) ELSE CAST(event_id % 3600 AS INT) END"
ARRIVED = f"""SELECT 'org' || CAST(user_id % 12 AS STRING) AS org, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'blocked' ELSE 'answered' END AS outcome, {VERY_LATE} AS delay FROM events"""


@query("usage_stream_corrected", f"""WITH asked AS ({ARRIVED}), days AS (SELECT org, strftime(ts, '%Y-%m-%d') AS day, count(*) AS value FROM asked WHERE outcome = 'answered' GROUP BY ALL)
SELECT * FROM days WHERE day::TIMESTAMP + INTERVAL 1 DAY <= (SELECT max(ts) FROM asked WHERE outcome = 'answered' AND delay <= 3600) - INTERVAL 1 HOUR""")
def usage_stream_corrected(t: Tables):
    """Finished days of a stream of which some rows come hours late: those go to a side table, which corrects the counts."""
    path = f"{shared_folder(t.spark)}/foliant/{uuid.uuid4().hex}"
    arriving = stream(t).select(
        F.concat(F.lit("org"), (F.col("user_id") % 12).cast("string")).alias("org"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "blocked").otherwise("answered").alias("outcome"),
        F.expr(f"CAST(ts AS TIMESTAMP) + make_dt_interval(0, 0, 0, {VERY_LATE})").alias("arrived"))
    in_time, _ = jobs.split_late(arriving)
    jobs.late_stream(arriving, f"{path}/late", f"{path}/checkpoint").awaitTermination()
    late = t.spark.read.schema(arriving.schema).parquet(f"{path}/late")
    return jobs.corrected_usage(finished(jobs.usage_stream(in_time), t), late)


@query("audit_stream", f"WITH trail AS ({inputs.TRAIL}) SELECT org, action, count(*) AS n FROM trail WHERE action = 'chat.flagged' GROUP BY ALL")
def audit_stream(t: Tables):
    """Flagged questions of a stream, written to the trail as they arrive."""
    events = stream(t).where("event_type = 'signup'").select(
        F.concat(F.lit("org"), (F.col("user_id") % 12).cast("string")).alias("org"), F.col("ts"), F.lit("chat.flagged").alias("action"), F.lit("").alias("target"))
    path = f"{shared_folder(t.spark)}/foliant/{uuid.uuid4().hex}"
    jobs.audit_stream(events, f"{path}/audit", f"{path}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{path}/audit").groupBy("org", "action").agg(F.count("*").alias("n"))


@query("audit_sink", f"WITH trail AS ({inputs.TRAIL}) SELECT org, action, count(*) AS n, max(length(target)) AS longest FROM trail GROUP BY ALL")
def audit_sink(t: Tables):
    """The trail written by the stream's sink and read back."""
    path = f"{shared_folder(t.spark)}/foliant/{uuid.uuid4().hex}/audit"
    append_audit(path, t.sql(inputs.TRAIL))
    return t.spark.read.parquet(path).groupBy("org", "action").agg(F.count("*").alias("n"), F.max(F.length("target")).cast("bigint").alias("longest"))
