"""Small queries of all kinds, and compositions of others."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import answers
from docloom.functions import text as t
from docloom.functions.vectors import cosine as cos
from docloom.operators import catalog, chunking
from docloom.operators import context as c
from docloom.plumbing import fresh_path
from docloom.sources import files
from docloom.streaming import alerts

from .context_queries import BOOST, HITS, QUESTIONS, _boost, _near, _questions, hits
from .files_queries import NAMES_SQL, names
from .registry import query, table, values
from .retrieval_queries import docs, texts, vectors
from .text_queries import html_sql


shared = fresh_path


@query(r"SELECT doc_id, 'chunk_' || CAST(k - 1 AS INTEGER) AS chunk_id, s AS content FROM (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, string_split(text, '. ')[1:10] AS p FROM documents)) WHERE length(s) > 20")
def filter_chunk_fallback(spark, d):
    """Ten sentences at most where nothing else can cut a document: the limit is the operator's own."""
    cut = docs(spark, d).select("doc_id", F.posexplode(F.slice(F.split("text", r"\. ", -1), 1, 10)).alias("k", "content"))
    return cut.where(F.length("content") > 20).select("doc_id", F.concat(F.lit("chunk_"), F.col("k").cast("string")).alias("chunk_id"), "content")


ASKS = [(1, ["a"]), (2, []), (3, ["q"] * 10), (4, ["q"] * 11)]


@query("SELECT id, n BETWEEN 1 AND 10 AS valid FROM (VALUES (1, 1), (2, 0), (3, 10), (4, 11)) AS t(id, n)")
def validate_question_count(spark, d):
    return spark.createDataFrame(ASKS, "id int, questions array<string>").select("id", F.size("questions").between(1, 10).alias("valid"))


@query(f"SELECT query_id, text, CAST(row_number() OVER (ORDER BY query_id % 2 DESC, length(text), query_id) AS INTEGER) AS place FROM {values(QUESTIONS, 'query_id, text')}")
def sort_multi_key(spark, d):
    w = Window.orderBy((F.col("query_id") % 2).desc(), F.length("text"), "query_id")
    return _questions(spark).withColumn("place", F.row_number().over(w))


JSONS = [('{"text":"a","source_id":"s","page_number":3}',), ('{"source_id":"x"}',), ("broken",)]


@query("SELECT * FROM (VALUES ('a', 's', 3), ('', 'x', NULL), ('', NULL, NULL)) AS t(text, source_id, page_number)")
def context_chunks_from_dicts(spark, d):
    parsed = F.from_json("j", "text string, source_id string, page_number int")
    return spark.createDataFrame(JSONS, "j string").select(parsed.alias("x")).select(F.coalesce("x.text", F.lit("")).alias("text"), "x.source_id", "x.page_number")


TIMES = [("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05+00:00",), ("2024-02-29",)]


@query("SELECT s, strptime(left(replace(s, 'T', ' ') || ' 00:00:00', 19), '%Y-%m-%d %H:%M:%S') AS ts FROM (VALUES ('2024-01-02T03:04:05Z'), ('2024-01-02T03:04:05+00:00'), ('2024-02-29')) AS t(s)")
def iso_time(spark, d):
    return spark.createDataFrame(TIMES, "s string").select("s", F.to_timestamp("s").cast("timestamp_ntz").alias("ts"))


@query(r"SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE substr(text, 1, 1000 + coalesce(instr(translate(substr(text, 1001, 100), '!?', '..'), '.'), 0)) END AS text FROM documents")
def prompt_truncate(spark, d):
    return docs(spark, d).select("doc_id", answers.truncated(F.col("text"), 1000, 100).alias("text"))


@query()
def summarize_chunks(spark, d):
    q = texts(spark, d).select("query_id", t.distinct_words(F.col("text")).alias("question"))
    n = lambda x: F.greatest(F.size(F.split(x, t.SPACE)), F.lit(1))
    short = hits(spark, d).join(q, "query_id").withColumn("summary", t.summary(F.col("question"), F.col("text")))
    return short.select("query_id", "doc_id", "summary", F.round(n(F.col("summary")) / n(F.col("text")), 6).alias("ratio"))


@query()
def dedup_redundancy_replace(spark, d):
    """In order of rank, a passage too near to a kept one stays out, unless it matters more: then it takes that one's place."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "id", F.col("score").alias("w"), F.col("embedding").cast("array<float>").alias("e"))))
    start = F.expr("cast(array() as array<struct<rank:int,id:bigint,w:double,e:array<float>>>)")

    def step(k, x):
        near = lambda y: cos(y["e"], x["e"]) > 0.2
        swapped = F.transform(k, lambda y: F.when(near(y) & (x["w"] > y["w"]), x).otherwise(y))
        return F.when(F.exists(k, near), F.array_distinct(swapped)).otherwise(F.concat(k, F.array(x)))

    kept = _near(spark, d).groupBy("query_id").agg(F.aggregate(rows, start, step).alias("k"))
    return kept.select("query_id", F.explode("k").alias("x")).select("query_id", "x.id")


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:128], ' ') AS text FROM documents")
def tok_truncate(spark, d):
    return docs(spark, d).select("doc_id", t.first_words(F.col("text"), 256 // 2).alias("text"))


SYN = " UNION ALL ".join(f"SELECT '{w}' AS w, unnest({list(s)}) AS s" for w, s in c.SYNONYMS)


@query(rf"SELECT DISTINCT query_id, w, s FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}_]+')) AS w FROM {values(QUESTIONS, 'query_id, text')}) JOIN ({SYN}) USING (w)")
def join_dictionary(spark, d):
    words = _questions(spark).select("query_id", F.explode(t.query_words(F.col("text"))).alias("w"))
    table_ = spark.createDataFrame(c.SYNONYMS, "w string, s array<string>").select("w", F.explode("s").alias("s"))
    return words.join(F.broadcast(table_), "w").select("query_id", "w", "s").distinct()


THES = rf"SELECT DISTINCT query_id, regexp_replace(text, '(?i)\b' || w || '\b', s) AS query, 0.7::DOUBLE AS confidence FROM (SELECT query_id, text, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}_]+')) AS w FROM {values(QUESTIONS, 'query_id, text')}) JOIN ({SYN}) USING (w)"


@query(THES)
def q_thesaurus(spark, d):
    found = join_dictionary(spark, d).join(_questions(spark), "query_id")
    return found.select("query_id", F.expr("regexp_replace(text, concat('(?i)\\\\b', w, '\\\\b'), s, 1)").alias("query"), F.lit(0.7).alias("confidence")).distinct()


@query(f"SELECT query_id, unnest(['details of ' || lower(text), lower(text) || ' explained']) AS query, 0.75::DOUBLE AS confidence FROM {values(QUESTIONS, 'query_id, text')}")
def q_llm(spark, d):
    """The deterministic stand-in for rewriting by a model."""
    made = F.array(F.concat(F.lit("details of "), F.lower("text")), F.concat(F.lower("text"), F.lit(" explained")))
    return _questions(spark).select("query_id", F.explode(made).alias("query"), F.lit(0.75).alias("confidence"))


@query()
def compress_context(spark, d):
    """Each result list ranked by its best passage, near copies out, the rest within a budget of words."""
    best = hits(spark, d).withColumn("lead", F.first("text").over(Window.partitionBy("query_id").orderBy("rank")))
    ranked = best.withColumn("o", t.word_overlap(F.substring("lead", 1, 200), F.col("text")))
    ranked = c.first_of(ranked.withColumn("key", t.chunk_id(F.col("text"))), ["query_id", "key"], ["rank"])
    cut = c.truncated_to_budget(ranked.withColumn("neg", -F.col("o")), ["query_id"], ["neg", "rank"], 1000, 0)
    return cut.select("query_id", "doc_id", "text", "words")


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS chunk_id, md5('{\"model\":\"m\",\"text\":\"' || doc_id || '\"}') AS cache_key FROM documents")
def cache_key_md5(spark, d):
    key = F.md5(F.to_json(F.struct(F.lit("m").alias("model"), F.col("doc_id").cast("string").alias("text"))))
    return docs(spark, d).select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("chunk_id"), key.alias("cache_key"))


@query("SELECT name, substr(sha256(name), 1, 8) || '_' || translate(name, '<>:\"|?*\\/', '_________') AS stored FROM (SELECT name FROM " + NAMES_SQL + ") WHERE length(name) < 200")
def load_local(spark, d):
    n = names(spark).where(F.length("name") < 200)
    return n.select("name", F.concat(F.substring(F.sha2("name", 256), 1, 8), F.lit("_"), files.safe_name(F.col("name"))).alias("stored"))


@query(f"SELECT page_id, length({html_sql('html')}) AS characters FROM pages")
def scan_html(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(t.html_text(F.col("html"))).cast("long").alias("characters"))


@query("SELECT vec_id, label FROM embeddings")
def sink_index(spark, d):
    return files.written_index(vectors(spark, d), shared(spark, "index")).select("vec_id", "label")


query("SELECT vec_id, label FROM embeddings WHERE label <> 3", "sink_chroma")(lambda spark, d: files.written_index(vectors(spark, d), shared(spark, "collection")).where("label <> 3").select("vec_id", "label"))


@query("SELECT doc_id, lang, n_chars FROM documents")
def sink_json(spark, d):
    path = shared(spark, "json")
    docs(spark, d).select("doc_id", "lang", "n_chars").write.json(path)
    return spark.read.schema("doc_id long, lang string, n_chars long").json(path)


@query("SELECT channel, count(*) AS n FROM (SELECT unnest(CASE WHEN event_type = 'error' THEN ['log', 'email'] ELSE ['log'] END) AS channel FROM events WHERE value > 100) GROUP BY channel")
def stream_alert_batches(spark, d):
    """Alerts handed to the sinks of their channels, batch by batch."""
    root = shared(spark, "routed")
    stream = alerts.threshold_alerts(alerts.event_stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema), 100)
    routes = lambda b: b.withColumn("channel", F.explode(F.when(F.col("key") == "error", F.array(F.lit("log"), F.lit("email"))).otherwise(F.array(F.lit("log")))))
    sinks = {n: (lambda b: b.write.mode("append").parquet(f"{root}/out")) for n in ("log", "email")}
    alerts.routed(stream, sinks, routes, f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("channel").agg(F.count("*").alias("n"))


@query(f"SELECT query_id, doc_id, round({BOOST}, 4) AS importance, rank FROM ({HITS}) WHERE rank <= 3")
def summarize_top(spark, d):
    return hits(spark, d).where("rank <= 3").select("query_id", "doc_id", F.round(_boost(), 4).alias("importance"), "rank")


@query("SELECT count(*) AS wrong FROM documents WHERE text IS NULL")
def dedup_validate_chunks(spark, d):
    return docs(spark, d).where("text is null").agg(F.count("*").alias("wrong"))


@query("SELECT 'd.docx' AS path, '.docx' AS extension, 'One' AS text, NULL AS error")
def scan_docx(spark, d):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p></w:body></w:document>')
    rows = spark.createDataFrame([("d.docx", bytearray(out.getvalue()))], "path string, content binary")
    return files.parsed(rows.select("path", F.col("path").alias("name"), F.octet_length("content").alias("size"), F.lit(".docx").alias("extension"), "content"))


