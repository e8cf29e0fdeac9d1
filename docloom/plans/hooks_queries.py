"""Queries that call models through hooks, by their deterministic stand-ins; vector stores; indexing; checked options."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import settings
from docloom.operators import catalog, hooks, search
from docloom.plumbing import fresh_path, spread
from docloom.sources import files, store

from .registry import query, table, values
from .retrieval_queries import asked, both, docs, nearest_sql, texts, vectors

COUNTS = "[len(regexp_extract_all(t, '[aeiou]'))::DOUBLE, len(regexp_extract_all(t, '[A-Z]'))::DOUBLE, len(regexp_extract_all(t, '[0-9]'))::DOUBLE, len(regexp_extract_all(t, ' '))::DOUBLE]"
EMBED = f"SELECT doc_id, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS e FROM (SELECT doc_id, {COUNTS} AS v FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"


@query(f"SELECT doc_id, {', '.join(f'round(e[{k + 1}], 6) AS x{k}' for k in range(4))} FROM ({EMBED})")
def embed_dense(spark, d):
    made = hooks.embedded(spread(docs(spark, d).select("doc_id", "text")), hooks.letter_embedder)
    return made.select("doc_id", *(F.round(F.col("embedding")[k], 6).alias(f"x{k}") for k in range(4)))


NEAR = f"SELECT r.query_id, r.vec_id AS doc_id, r.rank, least(length(b.text), length(d.text)) / greatest(length(b.text), length(d.text), 1)::DOUBLE AS x FROM ({nearest_sql(20, asks='q.vec_id IN (SELECT item_id FROM benchmark)')}) r JOIN benchmark b ON b.item_id = r.query_id JOIN documents d ON d.doc_id = r.vec_id"


def _pairs(spark, d):
    near = search.nearest(both(spark, d), vectors(spark, d), 20).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    return near.join(texts(spark, d).withColumnRenamed("text", "question"), "query_id").join(docs(spark, d).select("doc_id", "text"), "doc_id")


@query(f"SELECT query_id, doc_id, round(x, 6) AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, rank) AS place FROM ({NEAR})) WHERE place <= 5")
def rerank_model(spark, d):
    """A cross-encoder's place: any hook that scores (question, text)."""
    return hooks.reranked(_pairs(spark, d), hooks.length_scorer, 5).withColumn("score", F.round("score", 6))


@query(f"""SELECT query_id, doc_id, round(x, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY x DESC, rank) AS INTEGER) AS place
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id, batch ORDER BY x DESC, rank) AS own FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1) // 8 AS batch FROM ({NEAR}))) WHERE own <= 3""")
def rerank_batch(spark, d):
    """Candidates in batches of eight, of each the best three, then all that stayed in one order."""
    return hooks.reranked(_pairs(spark, d), hooks.length_scorer, 3, batch=8).withColumn("score", F.round("score", 6))


def _first_sentence():
    return lambda texts: [(t or "").split(". ")[0][:200] for t in texts]


@query("SELECT doc_id, substr(string_split(coalesce(text, ''), '. ')[1], 1, 200) AS summary FROM documents")
def abstractive_summary(spark, d):
    """A summariser's place; the stand-in gives the first sentence."""
    return hooks.mapped(docs(spark, d).select("doc_id", "text"), ["text"], _first_sentence, "summary", "string").select("doc_id", "summary")


@query()
def tok_est_tokenizer(spark, d):
    """Tokens by a file of a tokenizer library."""
    import os

    if folder := os.environ.get("DOCLOOM_TOKENIZERS"):
        path = os.path.join(folder, "byte_bpe_50k.json")
    else:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return hooks.mapped(spread(docs(spark, d).select("doc_id", "text")), ["text"], hooks.tokenizer_counts(path), "tokens", "long").select("doc_id", "tokens")


def _fetcher():
    """A site for tests: /flaky/n answers at the n-th try, /large never ends, /gone is refused; others give their path."""
    tries: dict[str, int] = {}

    def fetch(url: str):
        path = url.split("/", 3)[3]
        tries[url] = tries.get(url, 0) + 1
        if path.startswith("gone"):
            raise hooks.Refused("404")
        if path.startswith("flaky/") and tries[url] < int(path[6:]):
            raise OSError("reset")
        return ("text/html", (b"x" * 100 for _ in range(10**6))) if path == "large" else ("text/plain", iter([path.encode()]))

    return fetch


URLS = ["https://a.b/one", "https://a.b/flaky/3", "https://a.b/flaky/9", "https://a.b/large", "https://a.b/gone", "ftp://a.b/x", None]
FETCHED = [(URLS[0], 3, 1, None), (URLS[1], 7, 3, None), (URLS[2], None, 3, "failed: reset"), (URLS[3], None, 1, "too large"), (URLS[4], None, 1, "refused: 404"), (URLS[5], None, 0, "no http url"), (None, None, 0, "no http url")]


@query(f"SELECT url, CAST(size AS INTEGER) AS size, CAST(tries AS INTEGER) AS tries, error FROM {values(FETCHED, 'url, size, tries, error')}")
def load_http(spark, d):
    """Pages by a fetch hook, with tries and a bound on their size; the hook here is a site for tests, as there is no network."""
    urls = spark.createDataFrame([(u,) for u in URLS], "url string")
    return hooks.fetched(urls, _fetcher, most_bytes=1000).select("url", F.octet_length("content").alias("size"), "tries", "error")


@query("SELECT path, text, error FROM (VALUES ('a.pdf', NULL, 'no parser for .pdf'), ('b.pdf', NULL, 'no parser for .pdf')) AS t(path, text, error) UNION ALL SELECT 'with parser: ' || path, 'pages of ' || path, NULL FROM (VALUES ('a.pdf'), ('b.pdf')) AS t(path)")
def scan_pdf(spark, d):
    """PDF files need a parser, which is passed; without one a file has an error."""
    rows = spark.createDataFrame([(p, bytearray(f"pages of {p}", "ascii")) for p in ("a.pdf", "b.pdf")], "path string, content binary")
    rows = rows.select("path", F.col("path").alias("name"), F.octet_length("content").alias("size"), F.lit(".pdf").alias("extension"), "content")
    bare = files.parsed(rows).select("path", "text", "error")
    own = files.parsed(rows, {".pdf": lambda data: bytes(data).decode()}).select(F.concat(F.lit("with parser: "), "path").alias("path"), "text", "error")
    return bare.union(own)


@query("""WITH s AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN list_transform(embedding, lambda x: -x::DOUBLE) ELSE embedding::DOUBLE[] END AS embedding FROM embeddings WHERE vec_id % 7 <> 3)
    SELECT query_id, vec_id, round(score, 6) AS score, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM (
        SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding), 9) AS score FROM embeddings q JOIN s c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)) WHERE n <= 5""")
def vector_store(spark, d):
    """A store that is filled, changed in place, deleted from, saved and loaded, and then asked."""
    rows = vectors(spark, d).select("vec_id", "embedding")
    size = len(rows.first().embedding)
    turned = rows.where("vec_id % 5 = 0").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    held = store.store("flat", spark, size).add(rows).add(turned).delete(rows.where("vec_id % 7 = 3"))
    path = fresh_path(spark, "vector-store")
    held.save(path)
    return store.load(spark, path).search(asked(spark, d), 5).withColumn("score", F.round("score", 6))


LINES = "SELECT doc_id, unnest(p) AS content, generate_subscripts(p, 1) - 1 AS chunk_index FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)"


def _indexed(spark, d, overwrite):
    """Lines as chunks, where documents of even doc_id are stored as they are and those of odd one in an older form of two chunks."""
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("chunk_index", "content"))
    hashes = catalog.document_hash(lines)
    now = hashes.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_hash")).otherwise("old").alias("doc_hash"), F.lit(2).cast("long").alias("total_chunks"))
    old = docs(spark, d).where("doc_id % 2 = 1").select("doc_id", F.explode(F.array(F.lit(0), F.lit(99_999))).alias("chunk_index"), F.lit("old").alias("content"))
    stored = lines.where("doc_id % 2 = 0").unionByName(old)
    documents, chunks, result = catalog.indexed(now, stored, lines, overwrite=overwrite)
    after = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum((F.col("content") == "old").cast("long")).alias("old"))
    return result.select("doc_id", "skipped").join(documents, "doc_id").join(after, "doc_id")


INDEXED = """WITH l AS ({lines}), h AS (SELECT doc_id, sha256(string_agg(content, '' ORDER BY chunk_index)) AS doc_hash, count(*) AS n, sum(CASE WHEN content = 'old' THEN 1 ELSE 0 END) AS own FROM l GROUP BY doc_id)
    SELECT doc_id, {skip} AS skipped, doc_hash, CASE WHEN {skip} THEN 2 ELSE n END AS total_chunks, n + {left} AS chunks, CAST(own + {left} AS BIGINT) AS old FROM h"""


@query(INDEXED.format(lines=LINES, skip="(doc_id % 2 = 0)", left="(CASE WHEN doc_id % 2 = 1 THEN 1 ELSE 0 END)"))
def index_document(spark, d):
    """Unchanged documents are skipped, the chunks of changed ones take the places of the old."""
    return _indexed(spark, d, False)


@query(INDEXED.format(lines=LINES, skip="(false)", left="0"))
def index_document_overwrite(spark, d):
    return _indexed(spark, d, True)


#: Kinds of entries of the event log, with their level.
LOG_KINDS = [("event", "info"), ("success", "info"), ("failure", "error"), ("latency", "info"), ("llm_call", "info"), ("token_estimation", "info"), ("alert", "warning"), ("fallback", "warning"), ("retrieval", "info"), ("api_request", "info"), ("cost", "info"), ("rate_limit", "warning"), ("system_health", "info"), ("performance", "info")]  # fixed values


@query(f"SELECT kind, CASE WHEN kind = 'api_request' AND value >= 100 THEN 'error' ELSE level END AS level, count(*) AS n, round(sum(value), 4) AS total, min(ts) AS first, max(ts) AS last FROM (SELECT *, CAST(event_id % 14 AS INTEGER) AS k FROM events) JOIN {values([(k, *x) for k, x in enumerate(LOG_KINDS)], 'k, kind, level')} USING (k) GROUP BY ALL")
def log_event_kinds(spark, d):
    """All kinds of log entries: each event becomes an entry of one kind with its level, and entries are counted by both."""
    kinds = F.array(*(F.struct(F.lit(a).alias("kind"), F.lit(b).alias("level")) for a, b in LOG_KINDS))
    rows = table(spark, d, "events").select(kinds[(F.col("event_id") % 14).cast("int")].alias("x"), "value", "ts")
    level = F.when((F.col("x.kind") == "api_request") & (F.col("value") >= 100), "error").otherwise(F.col("x.level"))
    return rows.groupBy(F.col("x.kind").alias("kind"), level.alias("level")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("SELECT doc_id, substr(sha256(concat_ws('|', 'retrieval', lang, source, CAST(n_chars AS VARCHAR))), 1, 32) AS key FROM documents")
def cache_key(spark, d):
    """The key of a cached result: its parts joined by bars, hashed."""
    parts = F.concat_ws("|", F.lit("retrieval"), "lang", "source", F.col("n_chars").cast("string"))
    return docs(spark, d).select("doc_id", F.substring(F.sha2(parts, 256), 1, 32).alias("key"))


WORDS = "list_distinct(list_filter(string_split(lower(coalesce({}, '')), ' '), lambda w: w <> ''))"


@query(f"SELECT r.query_id, r.vec_id AS doc_id, len(list_distinct(list_concat({WORDS.format('b.text')}, {WORDS.format('d.text')}))) AS either, len(list_intersect({WORDS.format('b.text')}, {WORDS.format('d.text')})) AS both FROM ({nearest_sql(5, asks='q.vec_id IN (SELECT item_id FROM benchmark)')}) r JOIN benchmark b ON b.item_id = r.query_id JOIN documents d ON d.doc_id = r.vec_id")
def setop_union_arrays(spark, d):
    """Words that a question or a text has, and those that both have."""
    split = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), " "), lambda w: w != ""))
    rows = _pairs(spark, d).where("rank <= 5").select("query_id", "doc_id", split("question").alias("q"), split("text").alias("t"))
    return rows.select("query_id", "doc_id", F.size(F.array_union("q", "t")).cast("long").alias("either"), F.size(F.array_intersect("q", "t")).cast("long").alias("both"))


CONFIGS = [("chunking", {"most": 10, "least": 20}, "most must be larger than least"), ("chunking", {"overlap": 300}, "overlap must be smaller than most"), ("chunking", {}, None), ("dedup", {"threshold": 1.5}, "threshold must be between 0 and 1"), ("dedup", {"preserve": 9}, "preserve must be between 0 and most"), ("dedup", {"most": 0, "preserve": 0}, "most must be 1 or more"), ("embedding", {"batch": 0}, "batch must be positive"), ("embedding", {}, None)]


@query(f"SELECT CAST(n AS INTEGER) AS n, error FROM {values([(k, e) for k, (_, _, e) in enumerate(CONFIGS)], 'n, error')}")
def config_validate(spark, d):
    """Options are checked when they are made."""
    kinds, rows = {"chunking": settings.Chunking, "dedup": settings.Dedup, "embedding": settings.Embedding}, []
    for k, (kind, options, _) in enumerate(CONFIGS):
        try:
            kinds[kind](**options)
            rows.append((k, None))
        except ValueError as e:
            rows.append((k, str(e)))
    return spark.createDataFrame(rows, "n int, error string")


@query()
def create_chunker(spark, d):
    """Chunks of each strategy by one factory; an unknown strategy is the recursive one."""
    rows = spread(docs(spark, d).select("doc_id", "text"))
    made = [settings.chunker(settings.Chunking(strategy=s))(rows).withColumn("strategy", F.lit(s)) for s in ("fixed", "sentence", "recursive", "unknown")]
    out = made[0]
    for x in made[1:]:
        out = out.unionByName(x)
    return out.groupBy("doc_id", "strategy").agg(F.count("*").alias("chunks"))
