"""Queries over sources and intake."""

import uuid

import pyarrow.fs as fs
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import clean_layout, safe_name
from ..functions.urls import url_rejection
from ..sources import files as src
from ..sources.pages import page_intake
from ..session import shared_folder, staged
from . import sql_blocks as b
from .registry import Tables, query

NAMES = """SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN '../../etc/passwd.txt' WHEN 1 THEN 'C:' || chr(92) || 'dir' || chr(92) || 'rep<o>rt?.PDF' WHEN 2 THEN 'a/b/'
 WHEN 3 THEN '..' WHEN 4 THEN '  .hidden. ' WHEN 5 THEN '' WHEN 6 THEN text WHEN 7 THEN 'x/./' WHEN 8 THEN 'tab' || chr(9) || '|pipe*.md'
 WHEN 9 THEN '/' ELSE 'notes ' || CAST(doc_id AS STRING) || '.txt' END AS name FROM documents"""


def sql_safe_name(x: str) -> str:
    parts = f"list_filter(string_split(replace({x}, chr(92), '/'), '/'), lambda p: p NOT IN ('', '.'))"
    return f"left(trim(regexp_replace(coalesce(({parts})[-1], ''), '{fv.UNSAFE_NAME_CHARS}', '', 'g'), ' .'), {fv.MAX_NAME_CHARS})"


@query("safe_name", f"WITH n AS ({NAMES}) SELECT doc_id, {sql_safe_name('name')} AS name FROM n")
def safe_names(t: Tables):
    """Names made safe."""
    return t.spread(NAMES).select("doc_id", safe_name(F.col("name")).alias("name"))


LAYOUT = """SELECT doc_id, chr(10) || ' ' || replace(text, '. ', '.' || ' ' || chr(9) || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) ELSE '' END) || chr(9) || chr(10) AS text FROM documents"""


TIDY = "regexp_replace(regexp_replace({x}, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"


@query("clean_layout", f"WITH l AS ({LAYOUT}) SELECT doc_id, {b.strip(TIDY.format(x='text'))} AS text FROM l")
def layout(t: Tables):
    """Documents with tidy line ends."""
    return t.spread(LAYOUT).select("doc_id", clean_layout(F.col("text")).alias("text"))


# uploaded files: names with all kinds of extensions, contents given as hex with the right or a wrong beginning
FILES = """SELECT org, batch, doc_id, name, hexed, CAST(length(hexed) / 2 AS BIGINT) AS size FROM (
 SELECT source AS org, CASE WHEN doc_id % 20 = 7 THEN 'big' WHEN doc_id % 20 = 3 THEN 'single' || CAST(doc_id AS STRING) ELSE 'b' || CAST(doc_id % 140 AS STRING) END AS batch, doc_id,
 CASE WHEN doc_id % 89 = 3 THEN '' ELSE 'f' || CAST(doc_id AS STRING) || CASE doc_id % 16 WHEN 0 THEN '.txt' WHEN 1 THEN '.csv' WHEN 2 THEN '.md' WHEN 3 THEN '.markdown' WHEN 4 THEN '.pdf'
 WHEN 5 THEN '.docx' WHEN 6 THEN '.pptx' WHEN 7 THEN '.png' WHEN 8 THEN '.jpg' WHEN 9 THEN '.webp' WHEN 10 THEN '.doc' WHEN 11 THEN '.rtf' WHEN 12 THEN '.exe'
 WHEN 13 THEN '' WHEN 14 THEN '.TXT' ELSE '.tar.txt' END END AS name,
 CASE WHEN doc_id % 31 = 30 THEN '' ELSE
 CASE doc_id % 16 WHEN 4 THEN CASE WHEN doc_id % 3 = 0 THEN '20' ELSE '200A255044462D' END WHEN 5 THEN CASE WHEN doc_id % 3 = 0 THEN '' ELSE '504B0304' END WHEN 6 THEN '504B0304'
 WHEN 7 THEN '89504E470D0A1A0A' WHEN 8 THEN CASE WHEN doc_id % 3 = 0 THEN '41' ELSE 'FFD8FF' END WHEN 9 THEN CASE WHEN doc_id % 3 = 0 THEN '524946460000000057455B50' ELSE '524946460000000057454250' END
 WHEN 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'EFBBBF' ELSE '' END WHEN 1 THEN CASE WHEN doc_id % 3 = 0 THEN '00' ELSE '' END
 WHEN 2 THEN CASE doc_id % 3 WHEN 0 THEN 'E92061E0A0' WHEN 1 THEN 'FFFE226F575B874E' ELSE '' END ELSE '' END
 || CASE WHEN doc_id % 16 = 2 AND doc_id % 3 < 2 THEN '' ELSE hex(text) END END AS hexed FROM documents) AS f"""


def sql_filled(template: str, *values: str) -> str:
    parts = template.split("{}")
    return " || ".join([b.quoted(parts[0]), *[x for value, part in zip(values, parts[1:]) for x in (value, b.quoted(part))]])


def sql_triage() -> str:
    """CTEs ending in ``judged`` with kind and error per file."""
    kinds = " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in fv.KIND_BY_EXTENSION.items())
    hints = " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in fv.LEGACY_HINTS.items())
    return f"""files AS ({FILES}), e AS (SELECT *, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) AS ext FROM files),
k AS (SELECT *, CASE ext {kinds} END AS kind0, CASE ext {hints} END AS hint FROM e),
judged AS (SELECT *, CASE WHEN hint IS NOT NULL THEN {sql_filled(fv.OLD_FORMAT, 'ext', 'hint')}
 WHEN kind0 IS NULL THEN {sql_filled(fv.UNSUPPORTED_TYPE, "CASE WHEN ext = '' THEN 'unknown' ELSE ext END", b.quoted(fv.ALLOWED_LABEL))}
 WHEN hexed = '' THEN '{fv.EMPTY_FILE}'
 WHEN NOT CASE WHEN kind0 = 'pdf' THEN regexp_matches(left(hexed, 2048), '^(?:20|09|0A|0B|0C|0D)*255044462D') WHEN kind0 IN ('docx', 'pptx') THEN starts_with(hexed, '504B0304')
  WHEN kind0 = 'image' THEN starts_with(hexed, '89504E470D0A1A0A') OR starts_with(hexed, 'FFD8FF') OR (starts_with(hexed, '52494646') AND substr(hexed, 17, 8) = '57454250')
  ELSE NOT list_contains(regexp_extract_all(left(hexed, 16384), '..'), '00') END
 THEN {sql_filled(fv.NOT_VALID, 'name', 'upper(kind0)')} END AS kerror FROM k)"""


def _files(t: Tables):
    return t.spread(FILES).withColumn("content", F.unhex("hexed")).withColumn("error", F.lit(None).cast("string"))


@query("triage_kind", f"WITH {sql_triage()} SELECT doc_id, CASE WHEN kerror IS NULL THEN kind0 END AS kind, kerror AS error FROM judged")
def triage_kind(t: Tables):
    """Kinds of files from name and content."""
    return src.triage_kind(_files(t)).select("doc_id", "kind", F.col("kind_error").alias("error"))


def sql_decoded() -> str:
    """CTEs ending in ``decoded`` with the text of text files. Latin-1 and UTF-16 are read byte by byte."""
    number = lambda h: f"('0x' || {h})::INT"
    latin = f"array_to_string(list_transform(regexp_extract_all(hexed, '..'), lambda h: chr({number('h')})), '')"
    wide = f"array_to_string(list_transform(regexp_extract_all(substr(hexed, 5), '....'), lambda h: chr({number('(substr(h, 3, 2) || substr(h, 1, 2))')})), '')"
    tidy = TIDY.format(x="replace(raw, chr(0), '')")
    return f"""{sql_triage()}, raw AS (SELECT *, CASE WHEN starts_with(hexed, 'FFFE') THEN {wide} WHEN starts_with(hexed, 'E92061') THEN {latin}
 ELSE decode(unhex(CASE WHEN starts_with(hexed, 'EFBBBF') THEN substr(hexed, 7) ELSE hexed END)) END AS raw FROM judged WHERE kerror IS NULL AND kind0 IN ('txt', 'md')),
decoded AS (SELECT doc_id, {b.strip(tidy)} AS text FROM raw)"""


@query("decode_text", f"WITH {sql_decoded()} SELECT doc_id, text FROM decoded")
def decode_text(t: Tables):
    """Texts of the text files, in whatever encoding they came."""
    good, _ = src.split_accepted(src.text_segments(_files(t)))
    return good.where("kind IN ('txt', 'md')").select("doc_id", "text")


SQL_ADMITTED = f"""{sql_decoded()}, batches AS (SELECT org, batch, count(*) AS n FROM files GROUP BY ALL),
rows AS (SELECT j.org, j.batch, j.doc_id, j.name, CASE WHEN n > 10 THEN '{fv.TOO_MANY_FILES.format(10)}' WHEN name = '' THEN '{fv.BAD_FILE_NAME}' WHEN kerror IS NOT NULL THEN kerror
 WHEN kind0 IN ('txt', 'md') AND coalesce(d.text, '') = '' THEN {b.quoted(fv.NO_TEXT)} END AS error FROM judged j JOIN batches USING (org, batch) LEFT JOIN decoded d USING (doc_id))"""


@query("split_accepted", f"WITH {SQL_ADMITTED} SELECT doc_id, 'accepted' AS outcome, NULL::VARCHAR AS error FROM rows WHERE error IS NULL UNION ALL SELECT doc_id, 'rejected', error FROM rows WHERE error IS NOT NULL")
def split_accepted(t: Tables):
    """Files accepted and files rejected with a reason."""
    good, bad = src.split_accepted(src.text_segments(src.admit_batches(_files(t))))
    return good.select("doc_id", F.lit("accepted").alias("outcome"), F.lit(None).cast("string").alias("error")).unionByName(
        bad.select("doc_id", F.lit("rejected").alias("outcome"), "error"))


@query("failed_batches", f"""WITH {SQL_ADMITTED} SELECT org, batch, count(*) AS files, CASE WHEN bool_or(regexp_matches(lower(error), 'quota|limit')) THEN 413 ELSE 422 END::BIGINT AS status,
 CASE WHEN count(*) = 1 OR count(*) > 10 THEN min(error) ELSE left(string_agg(name || ': ' || error, '; ' ORDER BY name, error), 500) END AS reason
 FROM rows GROUP BY org, batch HAVING count(*) FILTER (error IS NULL) = 0""")
def failed_batches(t: Tables):
    """Uploads of which nothing was accepted."""
    rows = staged(src.text_segments(src.admit_batches(_files(t))), "intake")
    return src.failed_batches(rows, ["org", "batch"]).withColumn("status", F.col("status").cast("bigint"))


# conversations as scanned documents: user turns are pages with text, the others are read by a model
SCANS = "SELECT conv_id, CAST(max(turn) + 1 + conv_id % 20 AS INT) AS pages FROM conversations GROUP BY conv_id"
READ = "SELECT conv_id, CAST(turn + 1 AS INT) AS page, text FROM conversations WHERE role = 'user' AND conv_id % 6 <> 5"
SEEN = "SELECT conv_id, CAST(turn + 1 AS INT) AS page, CASE WHEN turn % 6 = 5 THEN '' ELSE text END AS text FROM conversations WHERE role <> 'user'"


@query("pages_needing_ocr", f"""WITH docs AS ({SCANS}), segments AS ({READ}), pages AS (SELECT conv_id, pages, unnest(range(1, pages + 1)) AS page FROM docs),
marked AS (SELECT p.*, s.conv_id IS NULL AS blank, count(*) FILTER (s.conv_id IS NULL) OVER (PARTITION BY p.conv_id) AS blanks, count(s.conv_id) OVER (PARTITION BY p.conv_id) AS texts
 FROM pages p LEFT JOIN (SELECT DISTINCT conv_id, page FROM segments) s ON s.conv_id = p.conv_id AND s.page = p.page)
SELECT conv_id, page FROM marked WHERE blank AND (texts = 0 OR 2 * blanks >= pages) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY page) <= 15""")
def pages_needing_ocr(t: Tables):
    """Pages without text that a vision model is to read."""
    return src.pages_needing_ocr(t.sql(SCANS), t.sql(READ), ["conv_id"]).select("conv_id", F.col("page").cast("bigint").alias("page"))


@query("merge_ocr_segments", f"WITH s AS (SELECT * FROM ({READ}) UNION ALL SELECT * FROM ({SEEN}) WHERE text <> '') SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY page) AS seg_no, page::BIGINT AS page, text FROM s")
def merge_ocr_segments(t: Tables):
    """Pages with text and transcribed pages in page order."""
    merged = src.merge_ocr_segments(t.sql(READ), t.sql(SEEN), ["conv_id"])
    return merged.select("conv_id", F.col("seg_no").cast("bigint").alias("seg_no"), F.col("page").cast("bigint").alias("page"), "text")


URLS = """SELECT page_id, html, CASE page_id % 41 WHEN 0 THEN 'http://127.9.8.7/' WHEN 1 THEN 'https://localhost/x' WHEN 2 THEN 'http://db.localhost/' WHEN 3 THEN 'http://169.254.7.7/'
 WHEN 4 THEN 'http://10.200.' || CAST(page_id % 256 AS STRING) || '.1/' WHEN 5 THEN 'http://192.168.44.2/' WHEN 6 THEN 'http://172.31.255.1/' WHEN 7 THEN 'http://[::1]/' WHEN 8 THEN 'http://[::ffff:10.0.0.1]/'
 WHEN 9 THEN 'http://0.1.2.3/' WHEN 10 THEN 'http://100.127.0.1/' WHEN 11 THEN 'http://nas.local/' WHEN 12 THEN 'file:///tmp/x' WHEN 13 THEN 'ssh://example.net/' WHEN 14 THEN 'mailto:a@example.net'
 WHEN 15 THEN 'http://me:pw@example.net/' WHEN 16 THEN 'http://example.net:3000/' WHEN 17 THEN 'http://example.net:25/' WHEN 18 THEN 'https://9.9.9.9/x' WHEN 19 THEN 'http://[2620:fe::9]:443/'
 WHEN 20 THEN 'http:///path' WHEN 21 THEN 'HTTPS://Example.NET:443' WHEN 22 THEN 'http://@example.net/' WHEN 23 THEN 'no address' WHEN 24 THEN 'http://9.9.' || CAST(page_id % 256 AS STRING) || '.1/'
 ELSE url END AS url FROM pages"""
# addresses that occur above and are not globally routable
PRIVATE = r"^(127\.|169\.254\.|10\.|192\.168\.|172\.31\.|0\.1\.|100\.127\.|::1$|::ffff:10\.)"
SQL_REJECTED = f"""CASE WHEN NOT regexp_matches(url, '^(?i)https?:') THEN '{fv.URL_BAD_SCHEME}' WHEN host = '' THEN '{fv.URL_NO_HOST}' WHEN regexp_matches(usr, '[^:]') THEN '{fv.URL_CREDENTIALS}'
 WHEN port NOT IN ('', '80', '443') THEN '{fv.URL_BAD_PORT}' WHEN host = 'localhost' OR suffix(host, '.localhost') OR suffix(host, '.local') OR suffix(host, '.internal') OR regexp_matches(host, '{PRIVATE}')
 THEN '{fv.URL_NOT_PUBLIC}' END"""
SQL_URLS = f"""urls AS ({URLS}), a AS (SELECT *, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS authority FROM urls),
hp AS (SELECT page_id, url, html, regexp_extract(authority, '^(.*)@', 1) AS usr,
 lower(CASE WHEN contains(authority, '[') THEN regexp_extract(authority, '\\[([^\\]]*)\\]', 1) ELSE regexp_extract(authority, '^(?:.*@)?([^:]*)', 1) END) AS host,
 CASE WHEN suffix(authority, ']') THEN '' ELSE regexp_extract(authority, ':(\\d*)$', 1) END AS port FROM a)"""


@query("url_admission", f"WITH {SQL_URLS} SELECT page_id, url, {SQL_REJECTED} AS error FROM hp")
def url_admission(t: Tables):
    """Why URLs may not be fetched."""
    return t.spread(URLS).select("page_id", "url", url_rejection(F.col("url")).alias("error"))


def sql_page_text(html: str) -> str:
    dropped = "|".join(e for e in fv.DROPPED_ELEMENTS if e != "img")
    text = f"regexp_replace({html}, '(?is)<!--.*?-->|<!doctype[^>]*>', chr(10), 'g')"
    for element in dropped.split("|"):
        text = f"regexp_replace({text}, '(?is)<{element}\\b[^>]*>.*?</{element}\\s*>', chr(10), 'g')"
    text = f"regexp_replace({text}, '(?s)</?[a-zA-Z][^>]*>', chr(10), 'g')"
    return sql_unescape(text)


def sql_unescape(text: str) -> str:
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", " "), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{char}')"
    return text


@query("page_intake", f"""WITH {SQL_URLS}, r AS (SELECT page_id, url, {SQL_REJECTED} AS error, html FROM hp),
x AS (SELECT page_id, url, error, CASE WHEN error IS NULL THEN array_to_string(list_filter(list_transform(string_split({sql_page_text('html')}, chr(10)), lambda l: {b.strip('l')}), lambda l: l <> ''), chr(10)) ELSE '' END AS text,
 CASE WHEN error IS NULL THEN {b.strip(sql_unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} ELSE '' END AS title0 FROM r),
n AS (SELECT *, {sql_safe_name(f"left(CASE WHEN title0 = '' THEN url ELSE title0 END, {fv.MAX_NAME_CHARS})")} AS name0 FROM x)
SELECT page_id, CASE WHEN name0 = '' THEN left(url, 200) ELSE name0 END AS name, 'url' AS kind, octet_length(encode(text))::BIGINT AS size, sha256(text) AS sha256, text,
 coalesce(error, CASE WHEN length({b.strip('text')}) < {fv.MIN_PAGE_CHARS} THEN '{fv.NO_PAGE_TEXT}' END) AS error FROM n""")
def pages(t: Tables):
    """Web pages as documents, with the reason where one is refused."""
    return page_intake(t.spread(URLS)).select("page_id", "name", "kind", "size", "sha256", "text", "error")


# files on disk: the documents of an organisation in batches of one file, some of them too large to be read
CAP = 4000
ON_DISK = """SELECT source AS org, 'b' || CAST(doc_id AS STRING) AS batch, CASE WHEN doc_id % 17 = 3 THEN '' ELSE coalesce(text, '') END AS value FROM documents"""


def write_files(rows, path: str) -> None:
    """A file for every row, under folders of its organisation and batch."""

    def write(part) -> None:
        for r in part:
            system, folder = fs.FileSystem.from_uri(f"{path}/{r['org']}/{r['batch']}") if "://" in path else (fs.LocalFileSystem(), f"{path}/{r['org']}/{r['batch']}")
            system.create_dir(folder)
            with system.open_output_stream(f"{folder}/document.txt") as out:
                out.write(r["value"].encode())

    rows.foreachPartition(write)


@query("read_files", f"""SELECT org, batch, octet_length(encode(value))::BIGINT AS size, CASE WHEN octet_length(encode(value)) <= {CAP} THEN sha256(value) END AS sha256,
 CASE WHEN octet_length(encode(value)) > {CAP} THEN '{fv.FILE_TOO_LARGE.format(0)}' WHEN value = '' THEN '{fv.EMPTY_FILE}' END AS error FROM ({ON_DISK})""")
def read_files(t: Tables):
    """Files written from the documents and read back; of those over the cap only the size is known, and those without a byte are errors too."""
    path = f"{shared_folder(t.spark)}/foliant/{uuid.uuid4().hex}/files"
    write_files(t.spread(ON_DISK), path)
    return src.read_files(t.spark, path, cap=CAP).select("org", "batch", "size", F.sha2("content", 256).alias("sha256"), "error")
