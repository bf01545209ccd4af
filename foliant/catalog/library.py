"""Queries over library views."""

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions.vectors import hash_embedder
from ..operators import library as lib
from ..operators.folds import storage_admission as admit
from ..session import shared_folder
from ..sources.library_sink import documents, replace_documents
from ..streaming.jobs import ingest_stream as start_intake
from . import inputs
from . import sql_blocks as b
from .registry import Tables, query
from .search import LIB, library

NOW = "2024-01-31 00:00:00"
LATEST = f"up AS ({inputs.UPLOADS}), latest AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY org, name ORDER BY seq DESC) = 1)"


@query("list_documents", f"WITH {LATEST} SELECT org, document_id, name, created_at FROM latest")
def list_documents(t: Tables):
    """Documents of the library, newest first."""
    return lib.list_documents(lib.latest_by_name(t.sql(inputs.UPLOADS))).select("org", "document_id", "name", "created_at")


@query("preview_chunks", LIB + b.passages() + " SELECT org, document_id, ordinal, content FROM chunks WHERE ordinal < 3")
def preview_chunks(t: Tables):
    """First passages of every document."""
    return lib.preview_chunks(library(t), 3).select("org", "document_id", F.col("ordinal").cast("bigint").alias("ordinal"), "content")


@query("usage_stats", f"""WITH {LATEST}, lib AS ({inputs.LIBRARY}), {b.passages()}
SELECT d.org, d.documents, coalesce(c.chunks, 0) AS chunks, d.bytes FROM (SELECT org, count(*) AS documents, sum(size)::BIGINT AS bytes FROM latest GROUP BY org) d
LEFT JOIN (SELECT org, count(*) AS chunks FROM chunks GROUP BY org) c USING (org)""")
def usage_stats(t: Tables):
    """Documents, passages and bytes per organisation."""
    return lib.usage_stats(lib.latest_by_name(t.sql(inputs.UPLOADS)), library(t))


@query("latest_by_name", f"WITH {LATEST} SELECT org, name, seq, size FROM latest")
def latest_by_name(t: Tables):
    """Last upload of every name."""
    return lib.latest_by_name(t.sql(inputs.UPLOADS)).select("org", "name", "seq", "size")


DELETIONS = "SELECT CASE WHEN doc_id % 14 = 3 THEN 'src0' ELSE source END AS org, doc_id AS document_id FROM documents WHERE doc_id % 7 = 3"


@query("delete_documents", f"WITH up AS ({inputs.UPLOADS}), gone AS ({DELETIONS}) SELECT org, document_id, name FROM up WHERE (org, document_id) NOT IN (SELECT (org, document_id) FROM gone)")
def delete_documents(t: Tables):
    """What deletions leave; an id under another organisation deletes nothing."""
    return lib.delete_documents(t.sql(inputs.UPLOADS), t.sql(DELETIONS)).select("org", "document_id", "name")


CLEARED = "SELECT CASE n_nationkey WHEN 20 THEN 'nobody' ELSE 'src' || CAST(n_nationkey AS STRING) END AS org FROM nation WHERE n_nationkey % 5 = 0"


@query("clear_library", f"""WITH up AS ({inputs.UPLOADS}), c AS ({CLEARED}) SELECT org, 'kept' AS state, count(*) AS n FROM up WHERE org NOT IN (SELECT org FROM c) GROUP BY org
UNION ALL SELECT c.org, 'removed', count(up.org) FROM c LEFT JOIN up ON up.org = c.org GROUP BY c.org""")
def clear_library(t: Tables):
    """Documents kept and removed when organisations clear their library."""
    kept, removed = lib.clear_library(t.sql(inputs.UPLOADS), t.sql(CLEARED))
    return kept.groupBy("org").agg(F.count("*").alias("n")).select("org", F.lit("kept").alias("state"), "n").unionByName(
        removed.select("org", F.lit("removed").alias("state"), F.col("removed").alias("n")))


@query("library_as_of", f"""WITH e AS ({inputs.LIBRARY_EVENTS}), past AS (SELECT * FROM e WHERE happened <= (SELECT avg(happened) FROM e)),
last AS (SELECT * FROM past WHERE action <> 'clear' QUALIFY row_number() OVER (PARTITION BY org, name ORDER BY seq DESC) = 1)
SELECT org, name, seq, happened AS ts FROM last l WHERE action = 'upload' AND seq > coalesce((SELECT max(seq) FROM past p WHERE p.org = l.org AND p.action = 'clear'), -1)""")
def library_as_of(t: Tables):
    """The library half way through its history."""
    events = t.sql(inputs.LIBRARY_EVENTS).withColumnRenamed("happened", "ts")
    half = events.agg(F.avg("ts")).first()[0]
    return lib.library_as_of(events, F.lit(half))


@query("library_now", f"""WITH e AS ({inputs.LIBRARY_EVENTS}), last AS (SELECT * FROM e WHERE action <> 'clear' QUALIFY row_number() OVER (PARTITION BY org, name ORDER BY seq DESC) = 1)
SELECT org, name, seq, happened AS ts FROM last l WHERE action = 'upload' AND seq > coalesce((SELECT max(seq) FROM e p WHERE p.org = l.org AND p.action = 'clear'), -1)""")
def library_now(t: Tables):
    """The library after all its events."""
    return lib.library_as_of(t.sql(inputs.LIBRARY_EVENTS).withColumnRenamed("happened", "ts"))


ASKED_AT = f"SELECT item_id AS qid, 'src' || CAST(item_id % 20 AS STRING) AS org, 1704067200 + CAST(item_id * 7919 % (SELECT max(doc_id) + 40 FROM documents) AS BIGINT) * 600 + CAST(item_id % 3 AS BIGINT) - 1 AS at FROM benchmark"


@query("library_at_question", f"""WITH e AS ({inputs.LIBRARY_EVENTS}), q AS ({ASKED_AT}),
last AS (SELECT q.qid, q.org, e.name, e.seq, e.action FROM q JOIN e ON e.org = q.org AND e.happened <= q.at WHERE e.action <> 'clear' QUALIFY row_number() OVER (PARTITION BY q.qid, e.name ORDER BY e.seq DESC) = 1),
cleared AS (SELECT q.qid, max(e.seq) AS seq FROM q JOIN e ON e.org = q.org AND e.happened <= q.at AND e.action = 'clear' GROUP BY q.qid)
SELECT l.qid, l.org, l.name, l.seq FROM last l LEFT JOIN cleared c USING (qid) WHERE l.action = 'upload' AND l.seq > coalesce(c.seq, -1)""")
def library_at_question(t: Tables):
    """For every question the documents that its library held when it was asked."""
    return lib.library_at(t.sql(ASKED_AT), t.sql(inputs.LIBRARY_EVENTS).withColumnRenamed("happened", "ts"))


SQL_CATALOGUE = f"""{LATEST}, first50 AS (SELECT * FROM latest QUALIFY row_number() OVER (PARTITION BY org ORDER BY name) <= 50),
catalogue AS (SELECT org, string_agg(name || ' (' || upper(kind) || CASE WHEN pages > 0 THEN ', ' || pages || ' pages' ELSE '' END || ')', '; ' ORDER BY name) AS catalogue, count(*) AS listed FROM first50 GROUP BY org)"""


@query("catalogue", f"WITH {SQL_CATALOGUE} SELECT * FROM catalogue")
def catalogue(t: Tables):
    """One line per library."""
    return lib.catalogue(lib.latest_by_name(t.sql(inputs.UPLOADS)))


SQL_REMOVED = f"""trail AS ({inputs.TRAIL}), current_names AS ({inputs.TRAIL_NAMES}),
recent AS (SELECT * FROM trail WHERE action = 'document.delete' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY QUALIFY row_number() OVER (PARTITION BY org ORDER BY id DESC) <= 40),
gone AS (SELECT org, target AS name, max(id) AS id FROM recent WHERE target <> '' GROUP BY ALL),
removed AS (SELECT org, name, id FROM gone g WHERE NOT EXISTS (SELECT 1 FROM current_names c WHERE c.org = g.org AND (lower(c.name) = lower(g.name)
 OR (least(length(c.name), length(g.name)) >= 8 AND (contains(lower(c.name), lower(g.name)) OR contains(lower(g.name), lower(c.name)))))))"""


def removed(t: Tables):
    return lib.removed_documents(t.sql(inputs.TRAIL), t.sql(inputs.TRAIL_NAMES), F.expr(f"TIMESTAMP_NTZ '{NOW}'"))


@query("removed_documents", f"WITH {SQL_REMOVED} SELECT * FROM removed")
def removed_documents(t: Tables):
    """Documents deleted lately and not back."""
    return removed(t)


QUOTA = 60_000


@query("storage_admission", f"""WITH RECURSIVE up AS ({inputs.UPLOADS}), e AS (SELECT org, seq, name, size, row_number() OVER (PARTITION BY org ORDER BY seq) AS rn FROM up),
r AS (SELECT org, seq, rn, size <= {QUOTA} AS admitted, CASE WHEN size <= {QUOTA} THEN size ELSE 0 END AS used,
  CASE WHEN size <= {QUOTA} THEN MAP {{name: size}} ELSE MAP {{'': 0::BIGINT}} END AS sizes FROM e WHERE rn = 1
 UNION ALL SELECT org, seq, rn, after <= {QUOTA}, CASE WHEN after <= {QUOTA} THEN after ELSE used END, CASE WHEN after <= {QUOTA} THEN map_concat(sizes, MAP {{name: size}}) ELSE sizes END
 FROM (SELECT e.*, r.used, r.sizes, r.used - coalesce(r.sizes[e.name], 0) + e.size AS after FROM r JOIN e ON e.org = r.org AND e.rn = r.rn + 1))
SELECT org, seq, admitted::INT::BIGINT AS admitted, used::BIGINT AS used FROM r""")
def storage_admission(t: Tables):
    """Uploads within the bytes of their organisation."""
    uploads = t.sql(inputs.UPLOADS).select("org", "seq", "name", "size")
    return admit(uploads, limit=QUOTA).select("org", "seq", F.col("admitted").cast("bigint").alias("admitted"), "used")


@query("library_sink", f"WITH {LATEST} SELECT org, name, seq, size FROM latest")
def library_sink(t: Tables):
    """The library after two writes, later documents replacing earlier ones under the same name."""
    path = f"{shared_folder(t.spark)}/foliant/{uuid4().hex}/documents"
    uploads = t.sql(inputs.UPLOADS).select("org", "name", "seq", "size")
    half = uploads.agg(F.max("seq")).first()[0] // 2
    replace_documents(path, lib.latest_by_name(uploads.where(F.col("seq") <= half)))
    replace_documents(path, lib.latest_by_name(uploads.where(F.col("seq") > half)))
    return documents(t.spark, path).select(*uploads.columns)


HALF = "(SELECT max(doc_id) / 2 FROM documents)"
# two documents of an organisation share a name; some are blank
ARRIVING = """SELECT source AS org, doc_id AS document_id, 'doc-' || CAST(CAST(floor(doc_id / 40) AS BIGINT) AS STRING) || '.txt' AS name,
 CASE WHEN doc_id % 9 = 2 THEN '  ' ELSE text END AS text, doc_id AS seq FROM documents"""


@query("ingest_stream", f"""WITH up AS (SELECT *, seq > {HALF} AS later FROM ({ARRIVING})),
last AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY later, org, name ORDER BY seq DESC) = 1),
lib AS (SELECT org, document_id, name AS document, text FROM last WHERE {b.strip('text')} <> '' QUALIFY row_number() OVER (PARTITION BY org, name ORDER BY later DESC) = 1), {b.passages()}
SELECT org, document, document_id, count(*) AS chunks, sum(length(content))::BIGINT AS chars, count(*) AS chunk_count FROM chunks GROUP BY ALL""")
def ingest_stream(t: Tables):
    """Documents taken in as a stream of two batches, in which names come again and some texts are blank: passages, and the number of them that the documents table knows."""
    path = f"{shared_folder(t.spark)}/foliant/{uuid4().hex}"
    arriving, half = t.sql(ARRIVING), t.sql(f"SELECT {HALF.strip('()').replace('SELECT ', '')}").first()[0]
    # the files of a folder, however many, are one batch of the stream
    arriving.where(F.col("seq") <= half).write.parquet(f"{path}/in/1")
    arriving.where(F.col("seq") > half).write.parquet(f"{path}/in/2")
    stream = lambda part: t.spark.readStream.schema(arriving.schema).parquet(f"{path}/in/{{{part}}}")
    for seen in ("1", "1,2"):
        start_intake(stream(seen), f"{path}/library", hash_embedder(), f"{path}/checkpoint").awaitTermination()
    known = documents(t.spark, f"{path}/library").select("org", F.col("name").alias("document"), F.col("chunk_count").cast("bigint").alias("chunk_count"))
    return documents(t.spark, f"{path}/library", "chunks").groupBy("org", "document", "document_id").agg(
        F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars")).join(known, ["org", "document"])
