"""Queries that run as streams over the events, and chunking as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import chunking
from docloom.operators import context as c
from docloom.operators import search
from docloom.streaming import alerts as a

from .metrics_queries import SUPPRESS
from .registry import query, table
from .retrieval_queries import asked, nearest_sql, vectors


def _stream(spark, d):
    rows = table(spark, d, "events")
    return a.event_stream(spark, f"{d}/events.parquet", rows.schema)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windowed_metrics(spark, d):
    out = a.gathered(a.windowed_metrics(_stream(spark, d)), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query(SUPPRESS)
def stream_alert_state(spark, d):
    out = a.gathered(a.suppressed_stream(_stream(spark, d).withColumnRenamed("event_type", "key")))
    return out.select("key", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")


@query("SELECT event_id, event_type AS key, ts FROM events WHERE value > 100")
def stream_threshold(spark, d):
    return a.gathered(a.threshold_alerts(_stream(spark, d), 100)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query()
def chunk_recursive(spark, d):
    return chunking.recursive_chunks(table(spark, d, "documents"))


@query()
def chunk_document(spark, d):
    return chunking.chunk_documents(table(spark, d, "documents"))


@query()
def chunk_text(spark, d):
    return chunking.chunk_documents(table(spark, d, "documents"), "sentence").select(F.lit("document").alias("source"), "doc_id", "chunk_index", "content")


@query()
def dedup_pipeline(spark, d):
    """Of each result list the first three, and of the rest what is not too near to anything kept, eight at most."""
    near = search.nearest(asked(spark, d), vectors(spark, d), 20).join(vectors(spark, d), "vec_id").withColumnRenamed("vec_id", "id")
    kept = c.greedy_distinct(near, ["query_id"], 0.2).select("query_id", "id")
    ranked = near.select("query_id", "id", "rank").join(kept.withColumn("kept", F.lit(True)), ["query_id", "id"], "left").where("rank <= 3 or kept")
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("rank")
    return ranked.withColumn("place", F.row_number().over(w)).where("place <= 8").select("query_id", "id", "place")
