"""Queries over events and model usage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.operators import metrics as m

from .registry import query, table, values

events = lambda spark, d: table(spark, d, "events")
LAST = "OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"
CASE = lambda pairs, test, other: "CASE " + " ".join(f"WHEN {test(k)} THEN {repr(v) if not isinstance(v, str) else chr(39) + v + chr(39)}" for k, v in pairs) + f" ELSE {other} END"


@query(f"SELECT event_id, round(avg(value) {LAST}, 9) AS mean FROM events")
def win_rolling_avg(spark, d):
    return events(spark, d).select("event_id", F.round(F.avg("value").over(m.rolling()), 9).alias("mean"))


@query(f"SELECT event_id, list_sort(h)[CAST(floor(len(h) * 95 / 100) AS INTEGER) + 1] AS p95 FROM (SELECT event_id, list(value) {LAST} AS h FROM events)")
def win_rolling_p95(spark, d):
    return events(spark, d).select("event_id", m.rolling_p95(F.col("value"), m.rolling()).alias("p95"))


@query(f"SELECT event_id, count(*) {LAST} AS held FROM events")
def win_rolling_count(spark, d):
    return events(spark, d).select("event_id", F.count("*").over(m.rolling()).alias("held"))


P95 = """SELECT event_type, round(CASE WHEN max(n) >= 20 THEN sum(CASE WHEN r = j THEN v * (20 - (19 * (n + 1) - 20 * j)) / 20 WHEN r = j + 1 THEN v * (19 * (n + 1) - 20 * j) / 20 ELSE 0 END) ELSE 0 END, 6) AS p95 FROM (
    SELECT *, least(greatest(19 * (n + 1) // 20, 1), n - 1) AS j FROM (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)) GROUP BY event_type"""


@query(P95)
def agg_p95_exclusive(spark, d):
    return m.p95_exclusive(events(spark, d), ["event_type"], "value").withColumn("p95", F.round("p95", 6))


@query(f"SELECT event_type, count(*) AS requests, round(avg(value), 6) AS mean, p95 FROM events JOIN ({P95}) USING (event_type) GROUP BY event_type, p95")
def agg_module_summary(spark, d):
    e = events(spark, d)
    return e.groupBy("event_type").agg(F.count("*").alias("requests"), F.round(F.avg("value"), 6).alias("mean")).join(agg_p95_exclusive(spark, d), "event_type")


@query("SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def agg_avg_op_time(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT round(100 * avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 2) AS success_rate FROM events")
def agg_success_rate(spark, d):
    return events(spark, d).agg(F.round(100 * F.avg(F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)), 2).alias("success_rate"))


@query("SELECT round(sum(CASE WHEN vec_id IS NOT NULL THEN 1.0 ELSE 0.0 END) / count(*), 2)::DOUBLE AS hit_rate, count(*) AS asked FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def agg_hit_rate(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "embeddings"), F.col("vec_id") == F.col("doc_id"), "left")
    return j.agg(F.round(F.sum(F.when(F.col("vec_id").isNotNull(), 1.0).otherwise(0.0)) / F.count("*"), 2).alias("hit_rate"), F.count("*").alias("asked"))


# Usage of models: an answer and the turn before it; the model by conversation.
MODELS = ["gpt-large", "gpt-small", "sonnet-like", "haiku-like", "unlisted"]
RATIO = CASE(m.RATIOS, lambda k: f"starts_with(model, '{k}')", m.DEFAULT_RATIO)
EST = "CAST(floor(length(regexp_replace({}, '\\s+', '', 'g')) * " + f"({RATIO})::DOUBLE) AS BIGINT)"
PICK = "['" + "', '".join(MODELS) + "'][conv_id % 5 + 1]"
USAGE = f"""SELECT conv_id, turn, model, {EST.format("coalesce(question, '')")} AS prompt_tokens, {EST.format('text')} AS completion_tokens FROM (
    SELECT conv_id, turn, role, text, {PICK} AS model, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question FROM conversations) WHERE role = 'assistant'"""


def usage(spark, d):
    c = table(spark, d, "conversations")
    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("conv_id") % 5 + 1).cast("int"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    a = c.withColumn("model", model).withColumn("question", F.lag("text").over(w)).where("role = 'assistant'")
    return a.select("conv_id", "turn", "model", m.estimated_tokens(F.coalesce("question", F.lit("")), F.col("model")).alias("prompt_tokens"), m.estimated_tokens(F.col("text"), F.col("model")).alias("completion_tokens"))


PRICES = values(m.PRICES, "model, prompt_price, completion_price")
COST = f"SELECT u.*, prompt_tokens / 1000.0 * coalesce(prompt_price, {m.DEFAULT_PRICE[0]})::DOUBLE + completion_tokens / 1000.0 * coalesce(completion_price, {m.DEFAULT_PRICE[1]})::DOUBLE AS cost FROM ({USAGE}) u LEFT JOIN {PRICES} USING (model)"


@query(USAGE)
def tok_est_family(spark, d):
    return usage(spark, d)


@query(f"SELECT conv_id, turn, model, round(cost, 6) AS cost FROM ({COST})")
def join_model_config(spark, d):
    return m.priced(usage(spark, d)).select("conv_id", "turn", "model", F.round("cost", 6).alias("cost"))


@query(f"SELECT model, round(sum(cost), 4) AS cost FROM ({COST}) GROUP BY model")
def agg_cost(spark, d):
    return m.priced(usage(spark, d)).groupBy("model").agg(m.total_cost(F.col("cost"), 4).alias("cost"))


@query(f"SELECT model, count(*) AS requests, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, round(avg(prompt_tokens), 4) AS prompt_mean, round(sum(cost), 2) AS cost FROM ({COST}) GROUP BY model")
def agg_model_summary(spark, d):
    p = m.priced(usage(spark, d))
    return p.groupBy("model").agg(F.count("*").alias("requests"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.round(F.avg("prompt_tokens"), 4).alias("prompt_mean"), m.total_cost(F.col("cost"), 2).alias("cost"))


@query(f"SELECT count(*) AS requests, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, round(sum(cost), 3) AS cost FROM ({COST})")
def agg_totals(spark, d):
    return m.priced(usage(spark, d)).agg(F.count("*").alias("requests"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), m.total_cost(F.col("cost"), 3).alias("cost"))


LIMIT = CASE(m.LIMITS, lambda k: f"model = '{k}'", CASE(m.LIMITS, lambda k: f"starts_with(model, '{k}')", m.DEFAULT_LIMIT))


@query(f"SELECT DISTINCT model, {LIMIT} AS token_limit FROM ({USAGE})")
def tok_limit(spark, d):
    return usage(spark, d).select("model", m.token_limit(F.col("model")).alias("token_limit")).distinct()


@query(f"SELECT conv_id, turn, model FROM ({USAGE}) WHERE prompt_tokens + completion_tokens <= floor(0.01 * ({LIMIT}))")
def filter_token_limit(spark, d):
    fits = F.col("prompt_tokens") + F.col("completion_tokens") <= F.floor(0.01 * m.token_limit(F.col("model")))
    return usage(spark, d).where(fits).select("conv_id", "turn", "model")


@query("""SELECT model, prompt_price::DOUBLE AS prompt_price, completion_price::DOUBLE AS completion_price FROM (SELECT * FROM """ + PRICES + """) WHERE model <> 'gpt-small' UNION ALL SELECT 'gpt-small', 0.002::DOUBLE, 0.004::DOUBLE UNION ALL SELECT 'new', 0.1::DOUBLE, 0.2::DOUBLE""")
def update_model_cost(spark, d):
    new = spark.createDataFrame([("gpt-small", 0.002, 0.004), ("new", 0.1, 0.2)], "model string, prompt_price double, completion_price double")
    return m.prices(spark).join(new.select("model"), "model", "left_anti").unionByName(new)


@query(f"SELECT conv_id, turn, 'latency' AS kind, {CASE(m.SEVERITY, lambda k: chr(39) + 'latency' + chr(39) + f' = {chr(39)}{k}{chr(39)}', chr(39) + 'info' + chr(39))} AS severity FROM ({USAGE}) WHERE completion_tokens > 300")
def stream_threshold_alerts(spark, d):
    return usage(spark, d).where("completion_tokens > 300").select("conv_id", "turn", F.lit("latency").alias("kind"), m.severity(F.lit("latency")).alias("severity"))


KINDS = [(k,) for k, _ in m.SEVERITY] + [("other",)]


@query(f"SELECT kind, {CASE(m.SEVERITY, lambda k: f'kind = {chr(39)}{k}{chr(39)}', chr(39) + 'info' + chr(39))} AS severity FROM {values(KINDS, 'kind')}")
def severity_map(spark, d):
    return spark.createDataFrame(KINDS, "kind string").select("kind", m.severity(F.col("kind")).alias("severity"))


ERRORS = [("Request timed out",), ("Rate limit reached",), ("HTTP 429",), ("max token count",), ("Unauthorized",), ("Connection reset",), ("HTTP 503",), ("odd",), ("",)]


@query(f"SELECT message, {CASE(m.REASONS, lambda k: f'contains(lower(message), {chr(39)}{k}{chr(39)})', chr(39) + 'unknown' + chr(39))} AS reason FROM {values(ERRORS, 'message')}")
def error_categorize(spark, d):
    return spark.createDataFrame(ERRORS, "message string").select("message", m.error_reason(F.col("message")).alias("reason"))


@query("SELECT event_id, md5(event_type || ':' || CAST(user_id AS VARCHAR) || ':' || props) AS key FROM events")
def alert_key(spark, d):
    return events(spark, d).select("event_id", m.alert_key(F.col("event_type"), F.col("user_id").cast("string"), F.col("props")).alias("key"))


SUPPRESS = """WITH RECURSIVE e AS (SELECT event_type AS key, ts, min(event_id) AS event_id FROM events GROUP BY ALL),
    later AS (SELECT key, ts, min(ts) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN INTERVAL 5 MINUTE FOLLOWING AND UNBOUNDED FOLLOWING) AS nts FROM e),
    nxt AS (SELECT a.key, a.ts, a.nts, b.event_id AS nid FROM later a LEFT JOIN e b ON a.key = b.key AND a.nts = b.ts),
    sent AS (SELECT key, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) AS r FROM e) WHERE r = 1
             UNION ALL SELECT n.key, n.nts, n.nid FROM sent s JOIN nxt n ON n.key = s.key AND n.ts = s.ts WHERE n.nts IS NOT NULL)
    SELECT key, ts, event_id FROM sent"""


@query(SUPPRESS)
def stream_alert_suppress(spark, d):
    return m.suppressed(events(spark, d).withColumnRenamed("event_type", "key"))


@query("SELECT event_id, unnest(CASE WHEN event_type = 'error' THEN ['log', 'email', 'pager'] WHEN value > 100 THEN ['log', 'email'] ELSE ['log'] END) AS channel FROM events")
def stream_alert_route(spark, d):
    routes = F.when(F.col("event_type") == "error", F.array(*map(F.lit, ("log", "email", "pager")))).when(F.col("value") > 100, F.array(F.lit("log"), F.lit("email"))).otherwise(F.array(F.lit("log")))
    return events(spark, d).select("event_id", F.explode(routes).alias("channel"))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 24 HOUR")
def filter_retention(spark, d):
    return events(spark, d).where("ts > timestamp_ntz '2024-01-30 00:00:00' - interval 24 hours").select("event_id")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def log_events(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT 'docloom_requests_total{module=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def sink_prometheus(spark, d):
    return events(spark, d).groupBy("event_type").count().select(F.concat(F.lit('docloom_requests_total{module="'), "event_type", F.lit('"} '), F.col("count").cast("string")).alias("line"))


@query("SELECT event_id, '{\"level\":\"INFO\",\"module\":\"' || event_type || '\",\"user\":' || user_id || '}' AS line FROM events")
def sink_json_log(spark, d):
    return events(spark, d).select("event_id", F.to_json(F.struct(F.lit("INFO").alias("level"), F.col("event_type").alias("module"), F.col("user_id").alias("user"))).alias("line"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_metrics_ingest(spark, d):
    w = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return events(spark, d).groupBy(w.alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def window_tumbling(spark, d):
    return events(spark, d).groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).count().select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("count").alias("n"))


@query("SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * unnest(range(0, 4))) AS start FROM events) GROUP BY ALL")
def window_sliding(spark, d):
    return events(spark, d).groupBy(F.window(F.col("ts").cast("timestamp"), "1 day", "6 hours").alias("w")).count().select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("count").alias("n"))


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s""")
def window_session(spark, d):
    g = events(spark, d).groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w")).count()
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("count").alias("n"))


# Outcomes of attempts by priority: the first that succeeds within the budget answers.
ATTEMPTS = [(1, 1, "a", False, 900), (1, 2, "b", True, 700), (1, 3, "c", True, 100), (2, 1, "a", False, 4000), (2, 2, "b", True, 100), (3, 1, "a", False, 10), (3, 2, "b", False, 20), (4, 1, "a", True, 50)]


@query(f"""SELECT request, max(CASE WHEN ok AND prior < 3000 THEN model END) AS model, count(*) AS attempts FROM (
    SELECT *, coalesce(sum(ms) OVER w, 0) AS prior, coalesce(max(CASE WHEN ok THEN 1 ELSE 0 END) OVER w, 0) AS answered FROM {values(ATTEMPTS, 'request, priority, model, ok, ms')}
    WINDOW w AS (PARTITION BY request ORDER BY priority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE answered = 0 AND prior < 3000 GROUP BY request""")
def llm_fallback(spark, d):
    w = Window.partitionBy("request").orderBy("priority").rowsBetween(Window.unboundedPreceding, -1)
    a = spark.createDataFrame(ATTEMPTS, "request int, priority int, model string, ok boolean, ms int")
    a = a.withColumn("prior", F.coalesce(F.sum("ms").over(w), F.lit(0))).withColumn("answered", F.coalesce(F.max(F.col("ok").cast("int")).over(w), F.lit(0)))
    return a.where("answered = 0 and prior < 3000").groupBy("request").agg(F.max(F.when(F.col("ok"), F.col("model"))).alias("model"), F.count("*").alias("attempts"))


@query(f"""SELECT request, priority, model, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY model ORDER BY request) AS BIGINT) AS failures FROM {values(ATTEMPTS, 'request, priority, model, ok, ms')}""")
def llm_event_log(spark, d):
    w = Window.partitionBy("model").orderBy("request")
    a = spark.createDataFrame(ATTEMPTS, "request int, priority int, model string, ok boolean, ms int")
    return a.select("request", "priority", "model", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(w).alias("failures"))
