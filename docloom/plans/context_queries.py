"""Queries that turn ranked passages into context, and expand questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.operators import context as c
from docloom.operators import search

from .registry import query, table, values
from .retrieval_queries import asked, bm25_sql, docs, nearest_sql, texts, vectors
from .text_queries import CHUNK_ID

HITS = f"SELECT r.query_id, r.rank, d.doc_id, r.score, d.text, d.source FROM ({bm25_sql(20)}) r JOIN documents d USING (doc_id)"


def hits(spark, d):
    """The best twenty documents for each item of the benchmark, with their texts."""
    return search.bm25(texts(spark, d), docs(spark, d), 20).join(docs(spark, d).select("doc_id", "text", "source"), "doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {CHUNK_ID.format('text')} ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_chunk_id(spark, d):
    return c.first_of(docs(spark, d).withColumn("key", t.chunk_id(F.col("text"))), ["key"], ["doc_id"]).select("doc_id")


query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {CHUNK_ID.format('text')}", "win_dedup_first")(dedup_chunk_id)


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS doc_hash FROM documents GROUP BY sha256(text)")
def dedup_doc_hash(spark, d):
    return docs(spark, d).groupBy(F.sha2("text", 256).alias("doc_hash")).agg(F.min("doc_id").alias("doc_id"))


KEY = r"regexp_replace(lower(text), '^\s+|\s+$', '', 'g')"


@query(f"SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, {KEY} AS k FROM documents) WHERE length(k) >= 50 GROUP BY k")
def dedup_exact_text(spark, d):
    key = t.strip(F.lower("text"))
    return docs(spark, d).select("doc_id", key.alias("k")).where(F.length("k") >= 50).groupBy("k").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE length({KEY}) >= 50")
def filter_min_length(spark, d):
    return docs(spark, d).where(F.length(t.strip(F.lower("text"))) >= 50).select("doc_id")


@query("""WITH RECURSIVE r AS (SELECT query_id, vec_id, score, rank, embedding FROM (""" + nearest_sql(20) + """) JOIN embeddings USING (vec_id)),
    walk AS (SELECT q.query_id, 0 AS n, []::BIGINT[] AS kept FROM (SELECT DISTINCT query_id FROM r) q
        UNION ALL SELECT w.query_id, n + 1, CASE WHEN EXISTS (SELECT 1 FROM r k WHERE k.query_id = w.query_id AND list_contains(w.kept, k.vec_id) AND list_cosine_similarity(k.embedding::DOUBLE[], x.embedding::DOUBLE[]) > 0.2) THEN kept ELSE list_append(kept, x.vec_id) END
        FROM walk w JOIN r x ON x.query_id = w.query_id AND x.rank = w.n + 1)
    SELECT query_id, unnest(kept) AS id FROM (SELECT query_id, kept, row_number() OVER (PARTITION BY query_id ORDER BY n DESC) AS z FROM walk) WHERE z = 1""")
def dedup_greedy_cosine(spark, d):
    near = search.nearest(asked(spark, d), vectors(spark, d), 20).join(vectors(spark, d), "vec_id").withColumnRenamed("vec_id", "id")
    return c.greedy_distinct(near, ["query_id"], 0.2).select("query_id", "id")


def _near(spark, d):
    return search.nearest(asked(spark, d), vectors(spark, d), 20).join(vectors(spark, d), "vec_id").withColumnRenamed("vec_id", "id")


@query()
def cluster_agglomerative(spark, d):
    return c.clusters(_near(spark, d), ["query_id"], threshold=1.2)


@query()
def cluster_ward(spark, d):
    return c.clusters(_near(spark, d), ["query_id"], linkage="ward", threshold=1.2)


@query("SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS n FROM embeddings) WHERE n = 1")
def win_rep_per_cluster(spark, d):
    return c.first_of(vectors(spark, d), ["label"], [F.col("embedding")[0].desc(), "vec_id"]).select("label", "vec_id")


@query(f"SELECT query_id, doc_id, rank, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(length(text) // 4) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM ({HITS})) WHERE used <= 3000")
def win_budget_prefix(spark, d):
    return c.within_budget(hits(spark, d), ["query_id"], ["rank"], F.expr("length(text) div 4"), 3000).select("query_id", "doc_id", "rank", "used")


N = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


def _truncate_sql(budget: int, least: int) -> str:
    return f"""SELECT query_id, doc_id, CASE WHEN n <= {budget} - before THEN text ELSE array_to_string(w[1:({budget} - before)::INTEGER], ' ') END AS text, CAST(least(n, {budget} - before) AS BIGINT) AS words FROM (
        SELECT *, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT *, {N} AS w, len({N}) AS n FROM ({HITS}))) WHERE n <= {budget} - before OR (before < {budget} AND {budget} - before > {least})"""


@query(_truncate_sql(1500, 50))
def win_budget_truncate(spark, d):
    return c.truncated_to_budget(hits(spark, d), ["query_id"], ["rank"], 1500).select("query_id", "doc_id", "text", F.col("words").cast("long").alias("words"))


@query(_truncate_sql(1000, 0))
def win_budget_truncate0(spark, d):
    return c.truncated_to_budget(hits(spark, d), ["query_id"], ["rank"], 1000, 0).select("query_id", "doc_id", "text", F.col("words").cast("long").alias("words"))


@query(f"SELECT query_id, doc_id, rank FROM (SELECT *, sum(length(text) // 4) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM ({HITS})) WHERE used <= 2000 OR rank = 1")
def win_context_pack(spark, d):
    used = F.sum(F.expr("length(text) div 4")).over(Window.partitionBy("query_id").orderBy("rank"))
    return hits(spark, d).withColumn("used", used).where("used <= 2000 or rank = 1").select("query_id", "doc_id", "rank")


BOOST = "least(1.0::DOUBLE, score / 100 + CASE WHEN rank <= 10 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN contains(source, '1') THEN 0.1::DOUBLE ELSE 0 END)"


def _boost():
    return F.least(F.lit(1.0), F.col("score") / 100 + F.when(F.col("rank") <= 10, 0.05).otherwise(0.0) + F.when(F.col("source").contains("1"), 0.1).otherwise(0.0))


@query(f"SELECT query_id, doc_id, round({BOOST}, 5) AS importance FROM ({HITS})")
def win_page_boost(spark, d):
    return hits(spark, d).select("query_id", "doc_id", F.round(_boost(), 5).alias("importance"))


@query(f"SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(b, 5) DESC, rank) AS n FROM (SELECT *, {BOOST} AS b FROM ({HITS})) WHERE round(b, 5) >= 0.3) WHERE n <= 10")
def filter_importance(spark, d):
    w = Window.partitionBy("query_id").orderBy(F.col("b").desc(), "rank")
    return hits(spark, d).withColumn("b", F.round(_boost(), 5)).where("b >= 0.3").withColumn("n", F.row_number().over(w)).where("n <= 10").select("query_id", "doc_id")


@query()
def extractive_summary(spark, d):
    q = texts(spark, d).select("query_id", t.distinct_words(F.col("text")).alias("question"))
    return hits(spark, d).join(q, "query_id").select("query_id", "doc_id", t.summary(F.col("question"), F.col("text")).alias("summary"))


@query()
def compress(spark, d):
    """Important passages, summed up for the question, within the budget."""
    q = texts(spark, d).select("query_id", t.distinct_words(F.col("text")).alias("question"))
    kept = hits(spark, d).withColumn("b", F.round(_boost(), 5)).where("b >= 0.05").join(q, "query_id")
    short = kept.select("query_id", "doc_id", "rank", t.summary(F.col("question"), F.col("text")).alias("text"))
    return c.truncated_to_budget(short, ["query_id"], ["rank"], 600).select("query_id", "doc_id", "rank", "text", "words")


@query(rf"SELECT round(sum(len({N}[1:50])) / greatest(sum(len({N})), 1), 6)::DOUBLE AS ratio FROM documents")
def agg_compression_ratio(spark, d):
    n = F.size(F.filter(F.split("text", t.SPACE), lambda w: w != ""))
    return docs(spark, d).agg(F.round(F.sum(F.least(n, F.lit(50))) / F.greatest(F.sum(n), F.lit(1)), 6).alias("ratio"))


@query("SELECT count(*) AS original, count(DISTINCT text) AS final, count(*) - count(DISTINCT text) AS removed, round(100 * (count(*) - count(DISTINCT text)) / count(*), 2)::DOUBLE AS percent FROM documents")
def agg_dedup_stats(spark, d):
    # Distinct digests, so that no whole text is shuffled.
    n, k = F.count("*"), F.count_distinct(F.sha2("text", 256))
    return docs(spark, d).agg(n.alias("original"), k.alias("final"), (n - k).alias("removed"), F.round(100 * (n - k) / n, 2).alias("percent"))


PASSAGES = [(1, 1, "policy.pdf", "4.2", 7, 0.91234, "text a"), (1, 2, "plan.txt", None, None, 0.0, "text b"), (2, 1, "x", "1", 3, 0.5, "text c")]
PASSAGES_SQL = values(PASSAGES, "query_id, place, source, clause, page, score, body")
HEADER = "'[' || concat_ws(' - ', 'Source ' || place, 'Doc: ' || source, 'Clause: ' || clause, 'Page: ' || page, CASE WHEN score <> 0 THEN 'Score: ' || printf('%.3f', score::DOUBLE) END) || ']'"


def _passages(spark):
    return spark.createDataFrame(PASSAGES, "query_id int, place int, source string, clause string, page int, score double, body string")


def _header():
    return c.header(*(F.col(x) for x in ("source", "clause", "page", "score", "place")))


@query(f"SELECT query_id, place, {HEADER} || chr(10) || body AS passage FROM {PASSAGES_SQL}")
def prompt_format_chunk(spark, d):
    return _passages(spark).select("query_id", "place", F.concat(_header(), F.lit("\n"), "body").alias("passage"))


CONTEXT = f"SELECT query_id, string_agg({HEADER} || chr(10) || body, chr(10) || chr(10) ORDER BY place) AS context FROM {PASSAGES_SQL} GROUP BY query_id"


def _context(spark):
    rows = _passages(spark).select("query_id", F.struct("place", F.concat(_header(), F.lit("\n"), "body").alias("p")).alias("x")).groupBy("query_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return rows.select("query_id", F.array_join(F.transform("x", lambda x: x["p"]), "\n\n").alias("context"))


@query(CONTEXT)
def context_text(spark, d):
    return _context(spark)


def _prompt_sql() -> str:
    parts = []
    for task in c.TEMPLATES:
        for model in c.WRAPPERS:
            shape = c.WRAPPERS[model].replace("{prompt}", c.TEMPLATES[task]).replace("'", "''").replace("\n", "' || chr(10) || '")
            parts.append(f"SELECT query_id, '{task}' AS task, '{model}' AS model, replace(replace('{shape}', '{{question}}', 'What is {{it}}?'), '{{context}}', context) AS prompt FROM ({CONTEXT})")
    return " UNION ALL ".join(parts)


@query(_prompt_sql())
def prompt_build(spark, d):
    ctx, out = _context(spark), None
    for task in c.TEMPLATES:
        for model in c.WRAPPERS:
            one = ctx.select("query_id", F.lit(task).alias("task"), F.lit(model).alias("model"), c.prompt(task, model, F.col("context"), F.lit("What is {it}?")).alias("prompt"))
            out = one if out is None else out.unionByName(one)
    return out


query(_prompt_sql(), "llm_prompt_format")(prompt_build)


@query(f"SELECT query_id, CAST(regexp_extract(l, '^\\[Source ([0-9]+)', 1) AS INTEGER) AS place, regexp_extract(l, 'Doc: ([^ \\]]+)', 1) AS source FROM (SELECT query_id, unnest(string_split(context, chr(10))) AS l FROM ({CONTEXT})) WHERE starts_with(l, '[Source ')")
def extract_sources(spark, d):
    lines = _context(spark).select("query_id", F.explode(F.split("context", "\n")).alias("l")).where(F.col("l").startswith("[Source "))
    return lines.select("query_id", F.regexp_extract("l", r"^\[Source ([0-9]+)", 1).cast("int").alias("place"), F.regexp_extract("l", r"Doc: ([^ \]]+)", 1).alias("source"))


@query(f"SELECT query_id, md5(string_agg(source || ':' || place || ':' || substr(body, 1, 100), '|' ORDER BY place)) AS key FROM {PASSAGES_SQL} GROUP BY query_id")
def context_hash(spark, d):
    one = F.struct("place", F.concat_ws(":", "source", F.col("place").cast("string"), F.substring("body", 1, 100)).alias("s"))
    return _passages(spark).groupBy("query_id").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["s"]), "|")).alias("key"))


QUESTIONS = [(1, "What does the policy cover?"), (2, "Ask HR about the claim deadline"), (3, "nothing here"), (4, "IT cost"), (5, "")]


def _questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id int, text string")


@query(f"SELECT query_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda w: length(w) > 1) AS words FROM {values(QUESTIONS, 'query_id, text')}")
def q_tokenize(spark, d):
    return _questions(spark).select("query_id", t.query_words(F.col("text")).alias("words"))


def _expand_sql() -> str:
    syn = " UNION ALL ".join(f"SELECT '{w}' AS w, unnest(['{s[0]}', '{s[1]}']) AS s" for w, s in c.SYNONYMS)
    ab = " UNION ALL ".join(f"SELECT '{w.lower()}' AS w, '{s}' AS s" for w, s in c.ABBREVIATIONS)
    return rf"""WITH q AS (SELECT * FROM {values(QUESTIONS, 'query_id, text')}), ws AS (SELECT DISTINCT query_id, text, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda w: length(w) > 1)) AS w FROM q),
    every AS (SELECT query_id, text AS query, 'original' AS kind, 1.0::DOUBLE AS confidence FROM q UNION ALL SELECT query_id, regexp_replace(text, '(?i)\b' || w || '\b', s), 'synonym', 0.8 FROM ws JOIN ({syn}) USING (w)
        UNION ALL SELECT query_id, regexp_replace(text, '(?i)\b' || w || '\b', s), 'abbreviation', 0.9 FROM ws JOIN ({ab}) USING (w)),
    once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(query) ORDER BY confidence DESC, length(query), query) AS n FROM every) WHERE n = 1)"""


EXPANDED = _expand_sql() + " SELECT query_id, query, kind, confidence, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, length(query), query) AS place FROM once) WHERE place <= {k}"


@query(EXPANDED.replace("{k}", "3"))
def q_expand(spark, d):
    return c.expanded(_questions(spark))


@query("SELECT * FROM (" + EXPANDED.replace("{k}", "99") + ") WHERE kind = 'synonym'")
def q_synonym(spark, d):
    return c.expanded(_questions(spark), 99).where("kind = 'synonym'")


@query("SELECT * FROM (" + EXPANDED.replace("{k}", "99") + ") WHERE kind = 'abbreviation'")
def q_abbrev(spark, d):
    return c.expanded(_questions(spark), 99).where("kind = 'abbreviation'")


query(EXPANDED.replace("{k}", "99"), "dedup_expansions")(lambda spark, d: c.expanded(_questions(spark), 99))


@query(r"SELECT b.item_id, d.item_id AS other, round((len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))))::DOUBLE, 6) AS jaccard FROM (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')) AS x FROM benchmark) b JOIN (SELECT item_id - 1 AS k, item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')) AS y FROM benchmark) d ON d.k = b.item_id")
def setop_intersect(spark, d):
    b = table(spark, d, "benchmark")
    o = b.select((F.col("item_id") - 1).alias("k"), F.col("item_id").alias("other"), F.col("text").alias("y"))
    return b.join(o, F.col("k") == F.col("item_id")).select("item_id", "other", F.round(t.jaccard(F.col("text"), F.col("y")), 6).alias("jaccard"))
