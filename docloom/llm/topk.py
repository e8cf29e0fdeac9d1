"""Exact top-k search by inner product, through histograms of scores.

Every query is scored against every vector, in blocks of queries whose size is
fixed.  Nothing but histograms leaves a task: the first pass counts scores in
wide bins, the driver finds for each query of the block the bin that holds its
kth score, and further passes count inside that bin until it is one score wide.
The last pass lets through what lies above the kth score and, of those equal to
it, the smallest ids; so a vector that millions share costs no more than k rows
a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path

#: Queries of a block (what is broadcast: some MB), bins of a histogram, and scores held at once in a task.
BLOCK, BINS, TILE = 16_384, 256, 1 << 21
#: Vector components are multiplied by this and rounded down.
SCALE = 64


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of vectors that have an id and only finite components."""
    v = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)


def matrix(lists: pa.Array, width: int, scale: int, kind: type) -> np.ndarray:
    """Quantised vectors, padded with zeros to ``width``: ``kind`` holds all sums of products exactly."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(kind)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), kind)
    for row, (a, size) in enumerate(zip(np.cumsum(sizes) - sizes, sizes)):
        out[row, :size] = values[a : a + size]
    return out


class _Block:
    """Queries of a block with what is known of their kth scores: they are at least ``low`` and below ``low + width``,
    and ``above`` scores are not below that."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, bound: int):
        self.ids, self.rows, self.k, self.bound = ids, rows, k, bound
        self.width = 2 * bound + 1
        self.low, self.above = np.full(len(ids), -bound, np.int64), np.zeros(len(ids), np.int64)

    @property
    def bin(self) -> int:
        return -(-self.width // BINS)


def _scores(block: _Block, batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Tiles of scores: which queries, candidate ids, and scores with a column for each candidate; own ones are least."""
    q = block.rows
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            ids = part.column(0).to_numpy()
            c = matrix(part.column(1), q.shape[1], scale, q.dtype.type).T
            step = max(1, TILE // max(1, len(ids)))
            for a in range(0, len(q), step):
                tile = slice(a, a + step)
                s = (q[tile] @ c).astype(np.int64)
                s[block.ids[tile, None] == ids[None, :]] = -block.bound - 1
                yield tile, ids, s


def _histogram(block, scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        counts = np.zeros((len(b.ids), BINS), np.int64)
        for tile, _, s in _scores(b, batches, scale):
            low = b.low[tile, None]
            place = (s - low) // b.bin
            inside = (s >= low) & (s < low + b.width)
            place += np.arange(len(s))[:, None] * BINS
            counts[tile] += np.bincount(place[inside], minlength=len(s) * BINS).reshape(-1, BINS)
        # The kth score of all is not below the kth of these: lower bins can't matter.
        from_top = np.cumsum(counts[:, ::-1], 1)[:, ::-1]
        counts[(from_top - counts) >= (b.k - b.above)[:, None]] = 0
        q, place = np.nonzero(counts)
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(counts[q, place])], ["q", "bin", "n"])

    return run


def _select(block, scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        ties: dict[int, np.ndarray] = {}
        names = ["query_id", "vec_id", "score"]
        for tile, ids, s in _scores(b, batches, scale):
            kth = b.low[tile, None]
            q, c = np.nonzero((s > kth) & (s >= -b.bound))
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(b.ids[tile][q]), pa.array(ids[c]), pa.array(s[q, c])], names)
            q, c = np.nonzero((s == kth) & (s >= -b.bound))
            cuts = np.flatnonzero(np.diff(q, prepend=-1))
            for row, own in zip(q[cuts], np.split(ids[c], cuts[1:]) if len(q) else []):
                row = int(row) + tile.start
                room = int(b.k - b.above[row])
                held = np.concatenate([ties[row], own]) if row in ties else own
                ties[row] = np.partition(held, room - 1)[:room] if len(held) > room else held
        if ties:
            q = np.repeat(np.fromiter(ties, np.int64), [len(x) for x in ties.values()])
            yield pa.RecordBatch.from_arrays([pa.array(b.ids[q]), pa.array(np.concatenate(list(ties.values()))), pa.array(b.low[q])], names)

    return run


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 20, *, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` best vectors for each query, all if there are fewer.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id. A score is the inner product of the
    components times ``scale``, rounded down; ties go to the smaller vec_id. Vectors that are null or hold null or
    non-finite components, and rows without vec_id, take no part; shorter vectors count as padded with zeros. Rows with
    the query's own id are no candidates of it; of query rows that share an id the least vector (as arrays compare)
    asks. Vectors that repeat under other ids are candidates of their own.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    whole = F.transform("embedding", lambda x: F.floor(x * scale).cast("double"))
    shape = rows.select(F.size("embedding").alias("width"), F.aggregate(whole, F.lit(0.0), lambda a, x: a + x * x).alias("square")).agg(F.max("width"), F.max("square")).first()
    folder = fresh_path(spark, "topk")
    schema = "query_id long, vec_id long, score long"
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    total = asked.count() if shape[0] else 0
    blocks = -(-total // block)
    if total:
        bound = int(shape[1]) + 1
        if bound >= 1 << 52:
            raise ValueError("vectors are too large for exact scores")
        kind = np.float32 if bound < 1 << 23 else np.float64
    for number in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).toArrow() if blocks > 1 else asked.toArrow()
        if not own.num_rows:
            continue
        b = _Block(own.column(0).to_numpy(), matrix(own.column(1), shape[0], scale, kind), k, bound)
        while True:
            shared = spark.sparkContext.broadcast(b)
            found = rows.mapInArrow(_histogram(shared, scale), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).toArrow()
            counts = np.zeros((len(b.ids), BINS), np.int64)
            counts[found.column(0).to_numpy(), found.column(1).to_numpy()] = found.column(2).to_numpy()
            from_top = np.cumsum(counts[:, ::-1], 1)[:, ::-1] + b.above[:, None]
            enough = from_top >= k
            place = np.where(enough.any(1), BINS - 1 - np.argmax(enough[:, ::-1], 1), 0)  # with too few, everything counts
            b.above = from_top[np.arange(len(place)), place] - counts[np.arange(len(place)), place]
            b.low = np.where(enough.any(1), b.low + place * b.bin, -b.bound - 1)
            done, b.width = b.bin == 1, b.bin
            shared.unpersist()
            if done:
                break
        shared = spark.sparkContext.broadcast(b)
        rows.mapInArrow(_select(shared, scale), schema).write.mode("append").parquet(folder)
        shared.unpersist()
    if not blocks:
        spark.createDataFrame([], schema).write.parquet(folder)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = spark.read.schema(schema).parquet(folder).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
