"""Optimal length buckets, and batches of equal token budget inside them.

The histogram of exact lengths over all documents (as many cells as there are
different lengths, so bounded by the longest text and not by the corpus) goes
to the driver.  Dynamic programming picks the bucket bounds that waste the
fewest padded tokens; as the waste of a bucket is linear in its bound, each
layer is a lower envelope of lines and takes linear time.  Rows are numbered
inside a bucket without gathering it: hashed parts are counted, the counts are
summed up, and each part numbers its own rows from its offset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Buckets, tokens of a batch with its padding, and rows numbered together at most (about).
BUCKETS, BUDGET, PART_ROWS = 16, 65_536, 4096


def optimal_bounds(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that minimise the padding. ``lengths`` ascend."""
    n = len(lengths)
    if n <= buckets:
        return list(lengths)
    number, tokens = [0], [0]
    for size, count in zip(lengths, counts):
        number.append(number[-1] + count)
        tokens.append(tokens[-1] + count * size)
    # best[j]: least padding of the first j lengths; a last bucket over lengths i..j-1 adds
    # lengths[j-1] * (number[j] - number[i]) - (tokens[j] - tokens[i]).
    best = [0] + [lengths[j - 1] * number[j] - tokens[j] for j in range(1, n + 1)]
    cuts = []
    for layer in range(2, buckets + 1):
        lines: list[tuple[int, int, int]] = []  # slope, height, i: the envelope of lines, steepest last
        new, cut, front = list(best), [0] * (n + 1), 0
        for j in range(layer, n + 1):
            i = j - 1
            slope, height = -number[i], best[i] + tokens[i]
            while len(lines) - front >= 2 and (lines[-1][1] - lines[-2][1]) * (lines[-2][0] - slope) >= (height - lines[-2][1]) * (lines[-2][0] - lines[-1][0]):
                lines.pop()
            lines.append((slope, height, i))
            x = lengths[j - 1]
            while len(lines) - front >= 2 and lines[front + 1][0] * x + lines[front + 1][1] <= lines[front][0] * x + lines[front][1]:
                front += 1
            slope, height, i = lines[front]
            new[j], cut[j] = slope * x + height + x * number[j] - tokens[j], i
        best = new
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        bounds.append(lengths[j - 1])
        j = cut[j]
        if not j:
            break
    if j:
        bounds.append(lengths[j - 1])
    return bounds[::-1]


def packed(docs: DataFrame, length: str = "n_tokens", *, buckets: int = BUCKETS, budget: int = BUDGET, key: str = "doc_id") -> DataFrame:
    """``docs`` with bucket (from 0), bucket_tokens (its bound), padding, batch (from 0 in its bucket) and slot.

    ``docs`` should be a written table: it is read twice. A batch holds ``budget // bucket_tokens`` rows of one bucket,
    one at least, so its padded tokens stay within the budget unless one text alone exceeds it; texts are never cut.
    Only the last batch of a bucket may hold fewer. Rows keep their order by length and ``key`` inside hashed parts of a
    bucket; a null length counts as 0, null keys come first. Columns with the names of the new ones are replaced.
    """
    new = ["bucket", "bucket_tokens", "padding", "batch", "slot"]
    rows = docs.select(*(docs[c] for c in docs.columns if c not in new and c != length), F.coalesce(docs[length].cast("long"), F.lit(0)).alias(length))
    histogram = sorted(rows.groupBy(length).count().collect())
    bounds = optimal_bounds([x[0] for x in histogram], [x[1] for x in histogram], buckets)
    parts = max(1, -(-sum(x[1] for x in histogram) // PART_ROWS))
    bucket = reduce(lambda a, b: a + b, [(F.col(length) > b).cast("int") for b in bounds[:-1]], F.lit(0))
    bound = F.element_at(F.array(*(F.lit(b).cast("long") for b in bounds or [0])), F.col("bucket") + 1)
    rows = rows.withColumn("bucket", bucket).withColumn("bucket_tokens", bound).withColumn("__part", F.pmod(F.xxhash64(length, key), F.lit(parts)))
    counts = rows.groupBy("bucket", "__part").count()
    before = Window.partitionBy("bucket").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    own = Window.partitionBy("bucket", "__part").orderBy(length, key)
    numbered = rows.withColumn("__row", F.row_number().over(own)).join(offsets, ["bucket", "__part"])
    at = F.col("__offset") + F.col("__row") - 1
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket_tokens"))))
    out = numbered.withColumn("padding", F.col("bucket_tokens") - F.col(length)).withColumn("batch", F.floor(at / fit).cast("long")).withColumn("slot", F.pmod(at, fit).cast("long"))
    return out.drop("__part", "__offset", "__row")


def token_packed(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """doc_id and the batch of every document of ``docs`` (doc_id, text), by tokens of ``tokenizer``."""
    from .token_counts import token_counts

    lengths = token_counts(docs.select("doc_id", "text"), tokenizer)
    return packed(written(lengths, "lengths"), **options).select("doc_id", "n_tokens", "bucket", "bucket_tokens", "padding", "batch", "slot")
