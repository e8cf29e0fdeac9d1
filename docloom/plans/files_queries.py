"""Queries over locations and file contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.sources import files as f

from .registry import literal, query, table, values

URLS = [("https://a.org/x/report.PDF?v=1",), ("http://b.com/",), ("https://c.net/a.b/c",), ("s3://bucket/k/doc.docx",), ("gs://g/x.eml#top",), ("file:///tmp/a.txt",), ("ftp://d/e.html",), ("plain/name.txt",), ("https://e.io/mail.eml/",)]
URLS_SQL = f"(SELECT url FROM pages UNION ALL SELECT url FROM {values(URLS, 'url')})"


def urls(spark, d):
    return table(spark, d, "pages").select("url").unionByName(spark.createDataFrame(URLS, "url string"))


EXT = r"lower(regexp_extract({}, '(\.[A-Za-z0-9]+)$', 1))"
PATH = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(f"SELECT url, CASE WHEN {EXT.format(PATH)} = '' THEN '.txt' ELSE {EXT.format(PATH)} END AS extension FROM {URLS_SQL}")
def ext_from_url(spark, d):
    return urls(spark, d).select("url", f.url_extension(F.col("url")).alias("extension"))


SCHEME = r"lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1))"


@query(f"SELECT url, CASE WHEN {SCHEME} IN ('http', 'https') THEN 'http' WHEN {SCHEME} IN ('s3', 's3a') THEN 's3' WHEN {SCHEME} = 'gs' THEN 'gs' WHEN {SCHEME} IN ('file', '') THEN 'file' ELSE 'unsupported' END AS reader FROM {URLS_SQL}")
def scheme_router(spark, d):
    return urls(spark, d).select("url", f.scheme(F.col("url")).alias("reader"))


NAMES = [('a<b>:"c|d?.txt', 10), ("x" * 300 + ".docx", 20), ("run.exe", 5), ("data.xyz", 5), ("big.pdf", 60 << 20), ("ok.PDF", 5), ("noext", 1), ("p\\q/r*.eml", 7)]
NAMES_SQL = values(NAMES, "name, size")


def names(spark):
    return spark.createDataFrame(NAMES, "name string, size long")


CLEAN = "translate(name, '<>:\"|?*\\/', '_________')"
TAIL = r"regexp_extract(x, '(\.[A-Za-z0-9]+)$', 1)"


@query(f"SELECT name, CASE WHEN length(x) <= 255 THEN x ELSE substr(x, 1, 255 - length({TAIL})) || {TAIL} END AS safe FROM (SELECT name, {CLEAN} AS x FROM {NAMES_SQL})")
def sanitize_filename(spark, d):
    return names(spark).select("name", f.safe_name(F.col("name")).alias("safe"))


REFUSAL = f"CASE WHEN e IN ({', '.join(map(literal, f.DANGEROUS))}) THEN 'dangerous' WHEN e NOT IN ({', '.join(map(literal, f.SUPPORTED))}) THEN 'unsupported' WHEN size > {f.MOST_BYTES} THEN 'too large' END"


@query(f"SELECT name, {REFUSAL} AS refusal FROM (SELECT *, {EXT.format('name')} AS e FROM {NAMES_SQL})")
def ext_validate(spark, d):
    return names(spark).select("name", f.refusal(f.extension(F.col("name")), F.col("size")).alias("refusal"))


query(f"SELECT name FROM {NAMES_SQL} WHERE size <= {f.MOST_BYTES}", "size_validate")(lambda spark, d: names(spark).where(F.col("size") <= f.MOST_BYTES).select("name"))
query(f"SELECT name, {REFUSAL} IS NULL AS read FROM (SELECT *, {EXT.format('name')} AS e FROM {NAMES_SQL})", "parse_from_file")(lambda spark, d: names(spark).select("name", f.refusal(f.extension(F.col("name")), F.col("size")).isNull().alias("read")))

TYPES = [(".pdf", "application/pdf"), (".txt", "text/plain; charset=utf-8"), (".html", "text/plain"), (".eml", "MESSAGE/RFC822"), (".zzz", "x/y")]
WANT = "CASE e " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in f.MIME.items()) + " END"
_TYPED = f"SELECT e, found, {WANT} IS NULL OR {WANT} = regexp_extract(lower(found), '^([^; ]+)', 1) AS ok FROM {values(TYPES, 'e, found')}"


@query(_TYPED)
def mime_validate(spark, d):
    return spark.createDataFrame(TYPES, "e string, found string").select("e", "found", f.mime_ok(F.col("e"), F.col("found")).alias("ok"))


query(_TYPED, "content_type_validate")(mime_validate)

HEADERS = [('attachment; filename="a b.pdf"', "https://x/y.txt"), (None, "https://x/z/report.pdf?q"), ("inline", "https://x/"), ("attachment; filename=c.txt", None)]


@query(f"""SELECT h, url, coalesce(nullif(regexp_extract(h, 'filename="?([^";]+)"?', 1), ''), nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/([^/?#]+)', 1), ''), 'download_' || substr(md5(url), 1, 8)) AS name FROM {values(HEADERS, 'h, url')}""")
def filename_from_response(spark, d):
    return spark.createDataFrame(HEADERS, "h string, url string").select("h", "url", f.download_name(F.col("h"), F.col("url")).alias("name"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def file_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"))


@query("SELECT doc_id, length(trim(text)) < 100 AS needs_ocr FROM documents")
def ocr_required(spark, d):
    return table(spark, d, "documents").select("doc_id", f.needs_ocr(F.col("text")).alias("needs_ocr"))


SCAN = r"SELECT doc_id, 'utf-8' AS encoding, CAST(len(string_split(text, chr(10))) AS INTEGER) AS line_count, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS word_count FROM documents"


@query(SCAN)
def scan_txt(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return f.text_files(rows).select(F.col("path").cast("long").alias("doc_id"), "encoding", "line_count", "word_count")


@query("SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 1")
def check_duplicate(spark, d):
    """Documents whose whole content another one has, by the full digest; a prefix of it serves for names only."""
    whole = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    again = whole.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    return whole.join(again, "h", "left_semi").select("doc_id")


@query("SELECT event_id AS file_id FROM events WHERE ts < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 24 HOUR")
def cleanup_cache(spark, d):
    return table(spark, d, "events").where("ts < timestamp_ntz '2024-01-30 00:00:00' - interval 24 hours").select(F.col("event_id").alias("file_id"))


CONTENTS = [("a.txt", "plain text"), ("b.html", "<p>Hi &amp; bye</p>"), ("c.exe", "x"), ("d.txt", "   "), ("e.zzz", "y")]


@query("SELECT path, extension, text, error FROM (VALUES ('a.txt', '.txt', 'plain text', NULL), ('b.html', '.html', 'Hi & bye', NULL), ('c.exe', '.exe', NULL, 'dangerous'), ('d.txt', '.txt', '   ', 'no text'), ('e.zzz', '.zzz', NULL, 'unsupported')) AS t(path, extension, text, error)")
def parse_dispatch(spark, d):
    rows = spark.createDataFrame(CONTENTS, "path string, c string").select("path", F.encode("c", "UTF-8").alias("content"))
    return f.parsed(rows.select("path", F.col("path").alias("name"), F.octet_length("content").alias("size"), f.extension(F.col("path")).alias("extension"), "content"))


def _mail() -> bytes:
    return b"Subject: Hello\r\nContent-Type: text/plain\r\n\r\nBody line\r\n"


def _archive() -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in (("a.txt", "one"), ("sub/b.eml", "two"), (".hidden", "x"), ("c.exe", "no")):
            z.writestr(name, data)
    return out.getvalue()


@query("SELECT 'm.eml' AS path, '.eml' AS extension, 'Subject: Hello' || chr(10) || 'Body line' AS text, NULL AS error")
def scan_eml(spark, d):
    rows = spark.createDataFrame([("m.eml", bytearray(_mail()))], "path string, content binary")
    return f.parsed(rows.select("path", F.col("path").alias("name"), F.octet_length("content").alias("size"), F.lit(".eml").alias("extension"), "content"))


@query("SELECT path, name, extension, CAST(size AS BIGINT) AS size, error FROM (VALUES ('z.zip', 'a.txt', '.txt', 3, NULL), ('z.zip', 'sub/b.eml', '.eml', 3, NULL), ('z.zip', 'c.exe', '.exe', 2, 'dangerous')) AS t(path, name, extension, size, error)")
def scan_zip(spark, d):
    rows = spark.createDataFrame([("z.zip", bytearray(_archive()))], "path string, content binary").withColumn("extension", F.lit(".zip"))
    return f.unzipped(rows).select("path", "name", "extension", "size", "error")
