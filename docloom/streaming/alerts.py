"""Alerts and metrics on streams. Event time is a timestamp; cast it from timestamp_ntz first, a watermark needs that."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plumbing import fresh_path


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """Events that arrive as Parquet files in the folder ``path`` (or as one file), with ts as a timestamp. The number of files
    bounds what a batch takes in."""
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    files = spark.read.parquet(path).inputFiles()
    single = len(files) == 1 and files[0].rstrip("/").endswith(f"/{name}")  # a file can't be watched, its folder can
    stream = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_metrics(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, sum and mean of value by window and event_type; a window closes ``late`` after its end."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "total", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of each user's sessions."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").count()
    return g.select("user_id", F.col("w.start").alias("start"), F.col("count").alias("n"))


def threshold_alerts(events: DataFrame, most: float) -> DataFrame:
    """Events whose value is over ``most``, as alerts: stateless."""
    return events.where(F.col("value") > most).select("ts", "event_id", F.col("event_type").alias("key"))


def suppressed_stream(alerts: DataFrame, seconds: int = 300) -> DataFrame:
    """key, ts and event_id of alerts that go out: of one key none within ``seconds`` of the last that went out.

    The state of a key is the time of its last alert and has no expiry. Within a batch a key's alerts are taken in order of
    event time; an alert that comes later than one that went out, but is older, is held back if it falls within its silence.
    """
    import pandas as pd

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        keep = []
        for at in rows["at"]:
            go = last is None or at - last >= seconds * 1_000_000
            last = at if go else last
            keep.append(go)
        state.update((int(last),))
        yield rows[keep]

    keyed = alerts.select("key", F.unix_micros("ts").alias("at"), "event_id")
    sent = keyed.groupBy("key").applyInPandasWithState(step, "key string, at long, event_id long", "last long", "append", "NoTimeout")
    return sent.select("key", F.timestamp_micros("at").alias("ts"), "event_id")


def routed(alerts: DataFrame, sinks: dict[str, Callable[[DataFrame], None]], channels: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Starts a query that hands each batch's alerts to the sink of each of their channels (``channels`` adds a column of that name)."""

    def each(batch: DataFrame, _: int) -> None:
        batch = channels(batch).persist()
        for name, sink in sinks.items():
            sink(batch.where(F.col("channel") == name))
        batch.unpersist()

    return alerts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gathered(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows of a stream over files that are there already, through a written table that driver and executors share."""
    spark = stream.sparkSession
    folder = fresh_path(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True)
    keep = "overwrite" if mode == "complete" else "append"
    query = writer.foreachBatch(lambda batch, _: batch.write.mode(keep).parquet(folder)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)
