"""Files as rows: finding, checking, parsing. Reading is Spark's own; only formats without a reader go through Python."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from email import message_from_bytes, policy
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that are read, those that never are, and the largest file in bytes.
SUPPORTED = (".pdf", ".docx", ".txt", ".eml", ".html", ".htm", ".zip")
DANGEROUS = (".exe", ".bat", ".cmd", ".com", ".pif", ".scr", ".vbs", ".js", ".jar", ".msi", ".dmg", ".app", ".sh", ".py", ".php", ".asp", ".aspx", ".jsp")  # fixed values
MOST_BYTES = 50 << 20
#: What each extension should hold.
MIME = {".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".txt": "text/plain", ".eml": "message/rfc822", ".html": "text/html", ".htm": "text/html", ".zip": "application/zip"}


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, extension, size, modified and content of each file below ``path``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content").withColumn("extension", extension(F.col("name")))


def extension(name: Column, otherwise: str = "") -> Column:
    found = F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1))
    return F.when(found == "", otherwise).otherwise(found)


def url_extension(url: Column) -> Column:
    """The extension of a URL's path; .txt where it has none."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return extension(path, ".txt")


def scheme(url: Column) -> Column:
    """Which reader a location goes to: http, s3, gs, file, or unsupported."""
    found = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    return F.when(found.isin("http", "https"), "http").when(found.isin("s3", "s3a"), "s3").when(found == "gs", "gs").when(found.isin("file", ""), "file").otherwise("unsupported")


def safe_name(name: Column, most: int = 255) -> Column:
    """Signs that file systems forbid as underscores; longer names are cut before their extension."""
    clean = F.translate(name, '<>:"|?*\\/', "_________")
    ext = F.regexp_extract(clean, r"(\.[A-Za-z0-9]+)$", 1)
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.substring(clean, F.lit(1), F.lit(most) - F.length(ext)), ext))


def refusal(ext: Column, size: Column, most: int = MOST_BYTES) -> Column:
    """Why a file is not read; null if it is."""
    return F.when(ext.isin(*DANGEROUS), "dangerous").when(~ext.isin(*SUPPORTED), "unsupported").when(size > most, "too large")


def mime_ok(ext: Column, found: Column) -> Column:
    """Whether the type that was found is the one the extension stands for; unknown extensions pass."""
    want = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))[ext]
    return want.isNull() | (want == F.regexp_extract(F.lower(found), r"^([^; ]+)", 1))


def needs_ocr(text: Column, least: int = 100) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < least


def download_name(disposition: Column, url: Column) -> Column:
    """A name for a download: from its header, else the end of the URL's path, else made from the URL."""
    named = F.nullif(F.regexp_extract(disposition, r'filename="?([^";]+)"?', 1), F.lit(""))
    path = F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/([^/?#]+)", 1), F.lit(""))
    return F.coalesce(named, path, F.concat(F.lit("download_"), F.substring(F.md5(url), 1, 8)))


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 where they are, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def text_files(rows: DataFrame) -> DataFrame:
    """path, text, encoding, line_count and word_count of plain text files."""
    text = decoded(F.col("content"))
    encoding = F.when(F.is_valid_utf8(F.col("content").cast("string")), "utf-8").otherwise("latin-1")
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return rows.select("path", text.alias("text"), encoding.alias("encoding"), F.size(F.split(text, "\n")).alias("line_count"), words.alias("word_count"))


def _docx(data: bytes) -> str:
    """Paragraphs, then the rows of tables with bars between their cells."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{space}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{space}t"))
    lines = [said(p) for p in body.findall(f"{space}p")]
    lines += [" | ".join(said(cell) for cell in row.iter(f"{space}tc")) for table in body.findall(f"{space}tbl") for row in table.iter(f"{space}tr")]
    return "\n".join(x for x in lines if x.strip())


def _eml(data: bytes) -> str:
    """The subject, then the plain parts, and the text of HTML parts where there is no plain one."""
    import re
    from html import unescape

    mail = message_from_bytes(data, policy=policy.default)
    plain, marked = [], []
    for part in mail.walk():
        if part.get_content_maintype() == "text" and not part.is_attachment():
            (plain if part.get_content_subtype() == "plain" else marked).append(part.get_content())
    marked = [unescape(re.sub(r"(?s)<[^>]+>", "", re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>", "", m))) for m in marked]
    return "\n".join([f"Subject: {mail['subject'] or ''}", *(x.strip() for x in (plain or marked))])


PARSERS = {".docx": _docx, ".eml": _eml}


def parsed(rows: DataFrame, parsers: dict | None = None) -> DataFrame:
    """path, extension, text and error of ``files``: text and HTML by expressions, other formats by ``parsers`` (bytes to text).

    A parser for .pdf is not part of the library; pass one. A file that can't be parsed has an error and no text, like one
    without text.
    """
    from docloom.functions import text as t

    own = PARSERS | (parsers or {})
    keep = rows.withColumn("error", refusal(F.col("extension"), F.col("size")))
    plain = keep.where(F.col("error").isNotNull() | F.col("extension").isin(".txt", ".html", ".htm"))
    raw = decoded(F.col("content"))
    text = F.when(F.col("extension") == ".txt", raw).otherwise(t.html_text(raw))
    plain = plain.select("path", "extension", F.when(F.col("error").isNull(), text).alias("text"), "error")
    other = keep.where(F.col("error").isNull() & ~F.col("extension").isin(".txt", ".html", ".htm", ".zip")).select("path", "extension", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for row in batch.to_pylist():
                try:
                    made, wrong = own[row["extension"]](row["content"]), None
                except KeyError as e:
                    made, wrong = None, f"no parser for {row['extension']}" if e.args and e.args[0] == row["extension"] else f"KeyError: {e}"
                except Exception as e:  # noqa: BLE001  a broken file must not end the job
                    made, wrong = None, f"{type(e).__name__}: {e}"
                texts.append(made)
                errors.append(wrong)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "extension", "text", "error"])

    every = plain.unionByName(other.mapInArrow(run, "path string, extension string, text string, error string"))
    empty = F.col("error").isNull() & (F.trim(F.coalesce("text", F.lit(""))) == "")
    return every.withColumn("error", F.when(empty, "no text").otherwise(F.col("error")))


def unzipped(rows: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """path (of the archive), name, extension, size, content and error of each member of zip archives; hidden files are skipped."""
    schema = "path string, name string, size long, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for row in batch.to_pylist():
                archive = zipfile.ZipFile(io.BytesIO(row["content"]))
                for info in archive.infolist():
                    leaf = info.filename.rsplit("/", 1)[-1]
                    if info.is_dir() or leaf.startswith(".") or info.filename.startswith("__MACOSX"):
                        continue
                    data = archive.read(info) if info.file_size <= most else None
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((row["path"], info.filename, info.file_size, data), kinds)], ["path", "name", "size", "content"])

    out = rows.where("extension = '.zip'").select("path", "content").mapInArrow(run, schema).withColumn("extension", extension(F.col("name")))
    return out.withColumn("error", refusal(F.col("extension"), F.col("size"), most))


def written_index(vectors: DataFrame, path: str) -> DataFrame:
    """Vectors saved as a table and read again: the index is the table."""
    vectors.write.mode("overwrite").parquet(path)
    return vectors.sparkSession.read.parquet(path)
