"""The ingestion catalog: documents, chunks, states, an audit trail and caches, as tables that are replaced or appended to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a document, in the order in which it passes them; error can follow any.
STATES = ("uploaded", "parsed", "chunked", "embedded", "indexed", "error")


def upserted(now: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``now`` with the rows of ``new`` in place of those with the same key, and those that have a new key."""
    return now.join(new.select(key), key, "left_anti").unionByName(new)


def inserted(now: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``now`` and the rows of ``new`` whose key it does not have."""
    return now.unionByName(new.join(now.select(key), key, "left_anti"))


def deleted(now: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return now.join(gone.select(key), key, "left_anti")


def latest_state(log: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each document's last state by (ts, log_id)."""
    return log.groupBy(key).agg(F.max_by("status", F.struct("ts", "log_id")).alias("status"), F.max("ts").alias("updated_at"))


def audit(log: DataFrame, doc_id: int | None = None, step: str | None = None, limit: int = 100) -> DataFrame:
    """The newest entries, of one document or step if given."""
    log = log if doc_id is None else log.where(F.col("doc_id") == doc_id)
    log = log if step is None else log.where(F.col("status") == step)
    return log.orderBy(F.col("ts").desc(), F.col("log_id").desc()).limit(limit)


def reindex_flags(now: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id and whether its content is unchanged: then indexing skips it."""
    old = now.select("doc_id", F.col("doc_hash").alias("old"))
    return new.join(old, "doc_id", "left").select("doc_id", F.col("doc_hash").eqNullSafe(F.col("old")).alias("skip"))


def cached_after(accesses: DataFrame, size: int, seconds: int, at: str) -> DataFrame:
    """What a cache of ``size`` entries and ``seconds`` of life holds at time ``at`` after ``accesses`` (key, ts, event_id):
    the keys that were used last, unless they are too old."""
    last = accesses.groupBy("key").agg(F.max(F.struct("ts", "event_id")).alias("x")).select("key", "x.ts", "x.event_id")
    newest = last.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(size)
    return newest.where(F.col("ts") > F.expr(f"timestamp_ntz '{at}' - interval {seconds} seconds")).select("key", "ts")


def with_index(chunks: DataFrame, doc: str = "doc_id", order: str = "pos") -> DataFrame:
    """Chunks numbered from 0 in their document."""
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy(doc).orderBy(order)) - 1)


def document_hash(chunks: DataFrame) -> DataFrame:
    """SHA-256 of each document's chunks (doc_id, chunk_index, content) put together in order."""
    rows = F.sort_array(F.collect_list(F.struct("chunk_index", "content")))
    return chunks.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(rows, lambda x: x["content"]), ""), 256).alias("doc_hash"))


def file_name(source: Column, doc_id: Column, extension: Column) -> Column:
    return F.concat(source, F.lit("_"), doc_id.cast("string"), extension)


def indexed(documents: DataFrame, stored: DataFrame, chunks: DataFrame, *, overwrite: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Indexes ``chunks`` (doc_id, chunk_index, content) into ``documents`` (doc_id, doc_hash, total_chunks) and ``stored`` (like chunks).

    Returns both as they are afterwards, and doc_id, doc_hash, total_chunks and skipped of each document that came. One whose hash
    is stored already is skipped. With ``overwrite`` none is, and what was stored of a document goes first; otherwise a chunk
    takes the place of the one with its index. Rows without doc_id, index or content are refused.
    """
    wrong = chunks.where("doc_id is null or chunk_index is null or content is null").count()
    if wrong:
        raise ValueError(f"{wrong} chunks lack doc_id, chunk_index or content")
    came = document_hash(chunks).join(chunks.groupBy("doc_id").agg(F.count("*").alias("total_chunks")), "doc_id")
    flags = reindex_flags(documents, came).select("doc_id", (F.col("skip") & F.lit(not overwrite)).alias("skipped"))
    result = came.join(flags, "doc_id")
    anew = result.where("not skipped").select("doc_id", "doc_hash", "total_chunks")
    new = chunks.join(anew.select("doc_id"), "doc_id", "left_semi")
    left = deleted(stored, anew, "doc_id") if overwrite else stored.join(new.select("doc_id", "chunk_index"), ["doc_id", "chunk_index"], "left_anti")
    return upserted(documents, anew, "doc_id"), left.unionByName(new), result
