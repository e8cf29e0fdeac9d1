"""Exact deduplication by keyed streaming state.

Every row arrives on a stream, in micro-batches, as its digest, identifier and the place of its
content (file and row).  A stateful aggregation without watermark, so without
expiry, keeps for each digest the identifier that stays, its place and the
number of arrivals; the state lies in RocksDB on the executors' disks and its
snapshots in the shared folder.  Digests alone decide nothing: the bytes of all
rows whose digest was hit are fetched by their places and compared, and rows whose digest agrees but whose
bytes do not are grouped by their bytes.  DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, text_or_empty, written

#: Parts into which the rows of one digest are dealt when their bytes are compared.
SALTS = 32
#: Bytes of arrivals (some hundred a row) that one micro-batch of the stream takes in.
BATCH_BYTES = 64 << 30

#: State lies in RocksDB; stores that are small and many must not allocate their logs ahead.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` read from files, so that every row has a place; other frames are written down first."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return docs
    except AnalysisException:
        return written(docs, "dedup-input")


def arrivals_state(spark: SparkSession, folder: str, schema: T.StructType, *, checkpoint: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The keyed state after all rows of the Parquet files in ``folder`` (digest, doc_id, file_path, row_index) have come:
    digest, stays (doc_id, file_path, row_index) and the number of arrivals.

    A micro-batch takes files of about ``batch_bytes``, one at least. With the ``checkpoint`` of an earlier run the stream
    goes on where that one ended: files it has seen are not read again, and its state is kept.
    """
    checkpoint = checkpoint or fresh_path(spark, "dedup-state")
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(folder)
        state = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "file_path", "row_index")).alias("stays"), F.count("*").alias("arrived"))
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    kept = spark.read.format("statestore").load(checkpoint)
    value = [f.name for f in kept.schema["value"].dataType.fields]
    return kept.select(F.col("key.digest").alias("digest"), F.col("value")[value[0]].alias("stays"), F.col("value")[value[1]].alias("arrived"))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, *, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, file_path, row_index, keep_id, group_size, kept and text_sha256 of each row of ``docs`` (doc_id, text).

    Texts are equal when their bytes are; null counts as empty, so null and empty texts are one group. Of equal texts
    the row with the largest doc_id stays (null is smaller than any; of rows with one doc_id, the last by file and row
    stays, so that exactly one row of a group is kept). ``digest`` only decides which rows meet.
    """
    docs = placed(docs)
    body = text_or_empty(docs)
    place = [F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index")]
    rows = docs.select(docs["doc_id"], body.alias("text"), *place)
    hashed = rows.select(digest(F.col("text")).alias("digest"), "doc_id", "file_path", "row_index", F.sha2("text", 256).alias("text_sha256"))
    spark, folder = docs.sparkSession, fresh_path(docs.sparkSession, "dedup-arrivals")
    hashed.write.parquet(folder)
    arrivals = spark.read.schema(hashed.schema).parquet(folder)
    if arrivals.isEmpty():
        return arrivals.select("doc_id", "file_path", "row_index", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    state = written(arrivals_state(spark, folder, arrivals.drop("text_sha256").schema, batch_bytes=batch_bytes), "dedup-kept")
    # Full bytes of all hits, fetched by their places, which spreads the copies of a digest over all tasks. Each task
    # leaves a digest's two extremes, and these meet in parts.
    hit = arrivals.select("digest", "file_path", "row_index").join(state.where("arrived > 1").select("digest"), "digest", "left_semi")
    salt = F.pmod(F.xxhash64("file_path", "row_index"), F.lit(SALTS))
    extremes = [F.min("text").alias("least"), F.max("text").alias("most")]
    fetched = rows.select("file_path", "row_index", "text").join(hit, ["file_path", "row_index"])
    met = fetched.groupBy("digest", salt.alias("salt")).agg(*extremes)
    apart = written(met.groupBy("digest").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most").select("digest"), "dedup-apart")
    named = arrivals.join(state, "digest", "left")
    same_row = F.struct("doc_id", "file_path", "row_index").eqNullSafe(F.col("stays"))
    out = lambda df: df.select("doc_id", "file_path", "row_index", F.col("stays.doc_id").alias("keep_id"), F.col("arrived").alias("group_size"), same_row.alias("kept"), "text_sha256")
    if apart.isEmpty():
        return out(named)
    # Digests that hold different bytes: their rows are grouped by the bytes themselves.
    clear = out(named.join(apart, "digest", "left_anti"))
    places = arrivals.select("digest", "file_path", "row_index").join(apart, "digest", "left_semi").drop("digest")
    mixed = rows.join(places, ["file_path", "row_index"])
    groups = mixed.groupBy("text").agg(F.max(F.struct("doc_id", "file_path", "row_index")).alias("stays"), F.count("*").alias("arrived"))
    return clear.unionByName(out(mixed.withColumn("text_sha256", F.sha2("text", 256)).join(groups, "text")))


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    docs = placed(docs)
    stay = exact_groups(docs).where("kept").select(F.col("file_path").alias("__file"), F.col("row_index").alias("__row"))
    at = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return at.join(stay, ["__file", "__row"], "left_semi").drop("__file", "__row")
