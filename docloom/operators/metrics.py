"""Latency, token and cost metrics over event tables, and alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Price in USD of a thousand prompt and completion tokens; what is not listed costs DEFAULT_PRICE. Our own table.
PRICES = [("gpt-large", 0.03, 0.06), ("gpt-small", 0.001, 0.002), ("haiku-like", 0.0008, 0.004), ("sonnet-like", 0.003, 0.015)]
DEFAULT_PRICE = (0.01, 0.03)
#: Token limits by model name or its beginning; and by family where neither is known.
LIMITS = [("gpt-large", 8192), ("gpt-small", 16384), ("haiku", 200_000), ("sonnet", 200_000)]
DEFAULT_LIMIT = 4096
#: Tokens a character by the beginning of a model's name.
RATIOS = [("gpt", 0.25), ("sonnet", 0.30), ("haiku", 0.28)]
DEFAULT_RATIO = 0.25
#: Severity of each kind of alert.
SEVERITY = [("latency", "warning"), ("token_usage", "warning"), ("error", "error"), ("fallback", "warning"), ("outage", "critical"), ("security", "critical"), ("cost", "info")]
#: Substrings of an error message, in the order in which they are looked for, and what they mean.
REASONS = [("timeout", "timeout"), ("timed out", "timeout"), ("rate limit", "rate_limit"), ("429", "rate_limit"), ("token", "token_limit"), ("context length", "token_limit"), ("unauthorized", "auth"), ("401", "auth"), ("connection", "network"), ("500", "server"), ("503", "server")]


def rolling(rows: int = 100, keys: tuple[str, ...] = ("event_type",), order: tuple[str, ...] = ("ts", "event_id")) -> object:
    """The last ``rows`` rows of a key, the current one among them."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1), 0)


def rolling_p95(value: Column, window: object) -> Column:
    """The value at place floor(0.95 n) of the window's sorted values, from 0."""
    held = F.sort_array(F.collect_list(value).over(window))
    return F.element_at(held, F.floor(F.size(held) * 95 / 100).cast("int") + 1)


def p95_exclusive(df: DataFrame, keys: list[str], value: str, least: int = 20) -> DataFrame:
    """The 95th percentile of each group by the exclusive method, 0 for groups of fewer than ``least`` rows.

    The two neighbouring order statistics are picked by row number, so no group's values are gathered in one row.
    """
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    j = F.least(F.greatest(F.floor(19 * (n + 1) / 20), F.lit(1)), n - 1)
    ranked = df.select(*keys, F.col(value).alias("v"), F.row_number().over(w.orderBy(value)).alias("r"), n.alias("n"), j.alias("j"))
    delta = 19 * (F.col("n") + 1) - 20 * F.col("j")
    part = F.when(F.col("r") == F.col("j"), F.col("v") * (20 - delta) / 20).when(F.col("r") == F.col("j") + 1, F.col("v") * delta / 20).otherwise(0.0)
    return ranked.groupBy(*keys).agg(F.when(F.max("n") >= least, F.sum(part)).otherwise(0.0).alias("p95"))


def choose(pairs: list[tuple], test, otherwise) -> Column:
    """The first value whose key passes ``test``."""
    out = None
    for key, value in pairs:
        out = F.when(test(key), F.lit(value)) if out is None else out.when(test(key), F.lit(value))
    return out.otherwise(F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise)


def severity(kind: Column) -> Column:
    return choose(SEVERITY, lambda k: kind == k, "info")


def error_reason(message: Column) -> Column:
    return choose(REASONS, lambda k: F.lower(message).contains(k), "unknown")


def token_limit(model: Column) -> Column:
    """A model's limit: by its whole name, else by the beginning of its name."""
    return choose(LIMITS, lambda k: model == k, choose(LIMITS, lambda k: model.startswith(k), DEFAULT_LIMIT))


def estimated_tokens(text: Column, model: Column) -> Column:
    """Characters that are no white space times the family's ratio, rounded down."""
    ratio = choose(RATIOS, lambda k: model.startswith(k), DEFAULT_RATIO)
    return F.floor(F.length(F.regexp_replace(text, r"(?U)\s+", "")) * ratio).cast("long")


def prices(spark) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, prompt_price double, completion_price double")


def priced(usage: DataFrame) -> DataFrame:
    """``usage`` (model, prompt_tokens, completion_tokens) with cost in USD."""
    p = usage.join(F.broadcast(prices(usage.sparkSession)), "model", "left")
    cost = F.col("prompt_tokens") / 1000 * F.coalesce("prompt_price", F.lit(DEFAULT_PRICE[0])) + F.col("completion_tokens") / 1000 * F.coalesce("completion_price", F.lit(DEFAULT_PRICE[1]))
    return p.withColumn("cost", cost).drop("prompt_price", "completion_price")


def total_cost(cost: Column, places: int) -> Column:
    """The sum of costs, added as decimals, so that neither partitions nor the order of rows turn a tie the other way; half goes up."""
    return F.round(F.sum(cost.cast("decimal(28,12)")), places).cast("double")


def suppressed(alerts: DataFrame, seconds: int = 300) -> DataFrame:
    """The alerts that go out: of one key, none within ``seconds`` of the last one that went out.

    ``alerts`` has key, ts (a timestamp) and event_id. What is held back does not extend the silence. Rows of a key pass in
    order through one task, which keeps only the last time; null keys are one key.
    """
    rows = alerts.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = (), 0
        for batch in batches:
            keep = []
            for k, (key, at) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if (key,) != now or at - last >= seconds * 1_000_000:
                    now, last = (key,), at
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))

    sent = rows.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInArrow(run, rows.schema)
    return sent.select("key", F.timestamp_micros("at").cast("timestamp_ntz").alias("ts"), "event_id")


def alert_key(kind: Column, message: Column, metadata: Column) -> Column:
    return F.md5(F.concat_ws(":", kind, message, metadata))
