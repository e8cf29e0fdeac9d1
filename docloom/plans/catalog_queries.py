"""Queries over the ingestion catalog, which is derived from the documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.operators import catalog as c

from .registry import query, table
from .text_queries import CHUNK_ID, COUNT, SENTENCES

# A first load of the sources below, and a second one of all German documents whose content has changed.
META = "SELECT doc_id, sha256(text) AS doc_hash, source, lang, 1 AS version FROM documents WHERE source < 'src5'"
NEW = "SELECT doc_id, sha256(text || lang) AS doc_hash, source, lang, 2 AS version FROM documents WHERE lang = 'de'"


def docs(spark, d):
    return table(spark, d, "documents")


def stored(spark, d):
    return docs(spark, d).where("source < 'src5'").select("doc_id", F.sha2("text", 256).alias("doc_hash"), "source", "lang", F.lit(1).alias("version"))


def incoming(spark, d):
    return docs(spark, d).where("lang = 'de'").select("doc_id", F.sha2(F.concat("text", "lang"), 256).alias("doc_hash"), "source", "lang", F.lit(2).alias("version"))


@query(f"SELECT * FROM ({META}) WHERE doc_id NOT IN (SELECT doc_id FROM ({NEW})) UNION ALL {NEW}")
def upsert_document(spark, d):
    return c.upserted(stored(spark, d), incoming(spark, d), "doc_id")


@query(f"{META} UNION ALL SELECT * FROM ({NEW}) WHERE doc_id NOT IN (SELECT doc_id FROM ({META}))")
def insert_document(spark, d):
    return c.inserted(stored(spark, d), incoming(spark, d), "doc_id")


query(f"{META} UNION ALL SELECT * FROM ({NEW}) WHERE doc_hash NOT IN (SELECT doc_hash FROM ({META}))", "join_dup_hash")(lambda spark, d: c.inserted(stored(spark, d), incoming(spark, d), "doc_hash"))


@query(f"SELECT * FROM ({META}) WHERE doc_id NOT IN (SELECT doc_id FROM ({NEW}))")
def delete_document(spark, d):
    return c.deleted(stored(spark, d), incoming(spark, d), "doc_id")


query(f"SELECT doc_id FROM ({META}) WHERE doc_id NOT IN (SELECT doc_id FROM ({NEW}))", "setop_except")(lambda spark, d: c.deleted(stored(spark, d), incoming(spark, d), "doc_id").select("doc_id"))
query(f"SELECT doc_id, version FROM ({META}) UNION ALL SELECT doc_id, version FROM ({NEW})", "setop_union_all")(lambda spark, d: stored(spark, d).unionByName(incoming(spark, d)).select("doc_id", "version"))


@query(f"SELECT n.doc_id, n.doc_hash IS NOT DISTINCT FROM m.doc_hash AS skip FROM ({NEW}) n LEFT JOIN ({META}) m USING (doc_id)")
def join_reindex_skip(spark, d):
    return c.reindex_flags(stored(spark, d), incoming(spark, d))


CHUNKS = f"SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS pos, unnest(s) AS content FROM (SELECT doc_id, {SENTENCES.format('text')} AS s FROM documents)"


def chunks(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(t.sentences(F.col("text"))).alias("pos", "content"))


@query(f"SELECT doc_id, pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS chunk_index, {CHUNK_ID.format('content')} AS chunk_id FROM ({CHUNKS})")
def index_prepare_metadata(spark, d):
    return c.with_index(chunks(spark, d)).select("doc_id", "pos", "chunk_index", t.chunk_id(F.col("content")).alias("chunk_id"))


query(f"SELECT doc_id, pos, sha256(content) AS h FROM ({CHUNKS})", "insert_chunks")(lambda spark, d: chunks(spark, d).select("doc_id", "pos", F.sha2("content", 256).alias("h")))


@query(f"SELECT doc_id, sha256(string_agg(content, '' ORDER BY pos)) AS doc_hash FROM ({CHUNKS}) GROUP BY doc_id")
def agg_concat_hash(spark, d):
    return c.document_hash(chunks(spark, d).withColumnRenamed("pos", "chunk_index"))


@query(f"SELECT d.doc_id, d.lang, x.pos FROM documents d JOIN ({CHUNKS}) x USING (doc_id)")
def join_doc_chunks(spark, d):
    return docs(spark, d).select("doc_id", "lang").join(chunks(spark, d), "doc_id").select("doc_id", "lang", "pos")


@query(f"SELECT doc_id, count(*) AS chunks, CAST(sum({COUNT.format('content')}) AS BIGINT) AS tokens, round(avg({COUNT.format('content')}), 6) AS mean, count(*) - count(DISTINCT {CHUNK_ID.format('content')}) AS duplicates FROM ({CHUNKS}) GROUP BY doc_id")
def agg_chunk_stats(spark, d):
    n = t.token_count(F.col("content"))
    return chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(n).alias("tokens"), F.round(F.avg(n), 6).alias("mean"), (F.count("*") - F.count_distinct(t.chunk_id(F.col("content")))).alias("duplicates"))


@query(f"SELECT round(avg(n), 2) AS mean FROM (SELECT count(*) AS n FROM ({CHUNKS}) GROUP BY doc_id)")
def agg_avg_of_counts(spark, d):
    return chunks(spark, d).groupBy("doc_id").count().agg(F.round(F.avg("count"), 2).alias("mean"))


@query("SELECT count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents")
def agg_count_total(spark, d):
    return docs(spark, d).agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters"))


@query("SELECT count(*) AS documents, count(DISTINCT source) AS sources, round(avg(n_chars), 4) AS mean FROM documents")
def agg_index_stats(spark, d):
    return docs(spark, d).agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"), F.round(F.avg("n_chars"), 4).alias("mean"))


@query("SELECT count(DISTINCT label) AS models FROM embeddings")
def agg_distinct_models(spark, d):
    return table(spark, d, "embeddings").agg(F.count_distinct("label").alias("models"))


# The log: each event moves the document of the user's id to the state of its type.
LOG = "SELECT event_id AS log_id, user_id AS doc_id, ts, event_type AS status FROM events"


def log(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("log_id"), F.col("user_id").alias("doc_id"), "ts", F.col("event_type").alias("status"))


LATEST = f"SELECT doc_id, max_by(status, (ts, log_id)) AS status, max(ts) AS updated_at FROM ({LOG}) GROUP BY doc_id"


@query(f"SELECT doc_id, status, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, log_id DESC) AS n, ts AS updated_at FROM ({LOG})) WHERE n = 1")
def update_status(spark, d):
    return c.latest_state(log(spark, d))


@query(f"SELECT status, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, log_id DESC) AS n FROM ({LOG})) WHERE n = 1 GROUP BY status")
def agg_status_breakdown(spark, d):
    return c.latest_state(log(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query(LOG)
def audit_log(spark, d):
    return log(spark, d)


@query(f"SELECT * FROM ({LOG}) WHERE status = 'click' ORDER BY ts DESC, log_id DESC LIMIT 100")
def filter_audit_dynamic(spark, d):
    return c.audit(log(spark, d), step="click")


@query(f"SELECT * FROM ({LOG}) ORDER BY ts DESC, log_id DESC LIMIT 100")
def sort_time_desc_limit(spark, d):
    return c.audit(log(spark, d))


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY ts DESC, log_id DESC) AS place FROM ({LOG})) WHERE place <= 10")
def filter_status(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("status").orderBy(F.col("ts").desc(), F.col("log_id").desc())
    return log(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 10").withColumn("place", F.col("place").cast("long"))


@query(f"SELECT * FROM ({LOG}) WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY")
def delete_old_logs(spark, d):
    return log(spark, d).where("ts >= timestamp_ntz '2024-01-30 00:00:00' - interval 7 days")


@query("SELECT d.doc_id, coalesce(e.vec_id, -1) AS embedding_id FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def update_embedding_id(spark, d):
    return docs(spark, d).join(table(spark, d, "embeddings"), F.col("vec_id") == F.col("doc_id"), "left").select("doc_id", F.coalesce("vec_id", F.lit(-1)).alias("embedding_id"))


@query("SELECT user_id AS key, ts FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1) WHERE r <= 100 AND ts > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 86400 SECOND")
def cache_lru_ttl(spark, d):
    a = table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", "event_id")
    return c.cached_after(a, 100, 86_400, "2024-01-30 12:00:00")


@query("SELECT count(*) FILTER (vec_id IS NOT NULL) AS hits, count(*) FILTER (vec_id IS NULL) AS misses FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def embed_cache(spark, d):
    j = docs(spark, d).join(table(spark, d, "embeddings"), F.col("vec_id") == F.col("doc_id"), "left")
    return j.agg(F.count("vec_id").alias("hits"), F.count_if(F.col("vec_id").isNull()).alias("misses"))


@query("SELECT doc_id, lang, source FROM documents WHERE sha256(text) = (SELECT min(sha256(text)) FROM documents)")
def point_lookup(spark, d):
    least = docs(spark, d).agg(F.min(F.sha2("text", 256))).first()[0]
    return docs(spark, d).where(F.sha2("text", 256) == least).select("doc_id", "lang", "source")


@query(f"SELECT count(*) AS wrong FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS want FROM ({CHUNKS})) WHERE pos <> want")
def validate_index_input(spark, d):
    return c.with_index(chunks(spark, d)).where("pos <> chunk_index").agg(F.count("*").alias("wrong"))


@query("SELECT doc_id, e.embedding IS NOT NULL AND bool_and(e.embedding IS NOT NULL) OVER (PARTITION BY source) AS given FROM documents LEFT JOIN embeddings e ON vec_id = doc_id")
def embedding_or_compute(spark, d):
    from pyspark.sql import Window

    j = docs(spark, d).join(table(spark, d, "embeddings"), F.col("vec_id") == F.col("doc_id"), "left")
    return j.select("doc_id", F.bool_and(F.col("embedding").isNotNull()).over(Window.partitionBy("source")).alias("given"))


query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dimension FROM embeddings", "embedding_dim")(lambda spark, d: table(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("dimension")))
query(f"SELECT doc_id, pos, content FROM ({CHUNKS})", "sort_by_index")(lambda spark, d: chunks(spark, d))
