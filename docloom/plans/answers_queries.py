"""Queries over answers: turns of the assistant, and fixed rows with what those lack."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import answers as a

from .registry import literal, query, table, values

RAW = [
    (1, "Answer: The limit is 30 days [Source 1], see (Source: policy.pdf) and clause 4.2. Confidence: 85%"),
    (2, "I'm sorry, I cannot help with that."),
    (3, "Sure, it costs 5.   Really.\n\n\n\nYes [2] [2] page 7. Certainty: 0.4"),
    (4, '{"a": 1}'),
    (5, "<p class=x>Hi</p><script>alert(1)</script> javascript:void onclick=1"),
    (6, "#### Title\n* one\n+ two ***bold***"),
    (7, "password: hunter2 and 1234 5678 9012 3456"),
    (8, ""),
    (9, "short"),
    (10, "I am 92.5% confident that it's \"so\" & not <else>."),
    (11, "[1, 2]"),
]
ROWS = f"(SELECT 'raw' AS kind, id, c FROM {values(RAW, 'id, c')} UNION ALL SELECT 'turn' AS kind, conv_id * 1000 + turn AS id, text AS c FROM conversations WHERE role = 'assistant')"


def rows(spark, d):
    raw = spark.createDataFrame(RAW, "id long, c string").select(F.lit("raw").alias("kind"), "id", "c")
    turns = table(spark, d, "conversations").where("role = 'assistant'").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("c"))
    return raw.unionByName(turns)


def without_sql(c: str, beginnings) -> str:
    return "CASE " + " ".join(f"WHEN starts_with(lower({c}), {literal(b.lower())}) THEN ltrim(substr({c}, {len(b) + 1}))" for b in beginnings) + f" ELSE {c} END"


BARE = r"trim(regexp_replace(regexp_replace(coalesce(c, ''), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'))"


@query(f"SELECT kind, id, {without_sql('x', a.PREFIXES)} AS text FROM (SELECT kind, id, {BARE} AS x FROM {ROWS})")
def out_clean(spark, d):
    return rows(spark, d).select("kind", "id", a.clean(F.col("c")).alias("text"))


@query(f"SELECT kind, id, {without_sql('c', a.PREAMBLES)} AS text FROM {ROWS}")
def out_trim_preamble(spark, d):
    return rows(spark, d).select("kind", "id", a.without(F.col("c"), a.PREAMBLES).alias("text"))


@query(rf"SELECT kind, id, regexp_replace(regexp_replace(regexp_replace(c, '#{{3,}}', '##', 'g'), '(?m)^[*+] ', '- ', 'g'), '\*{{3,}}', '**', 'g') AS text FROM {ROWS}")
def out_clean_markdown(spark, d):
    return rows(spark, d).select("kind", "id", a.clean_markdown(F.col("c")).alias("text"))


CITED = "list_concat(" * (len(a.CITATIONS) - 1) + f"regexp_extract_all(c, '{a.CITATIONS[0]}', 1)" + "".join(f", regexp_extract_all(c, '{p}', 1))" for p in a.CITATIONS[1:])


@query(f"SELECT kind, id, list_filter(l, lambda x, i: list_position(l, x) = i) AS cited FROM (SELECT kind, id, {CITED} AS l FROM {ROWS})")
def out_citations(spark, d):
    return rows(spark, d).select("kind", "id", a.citations(F.col("c")).alias("cited"))


query(f"SELECT kind, id, len(list_distinct({CITED})) AS n FROM {ROWS}", "dedup_citations")(lambda spark, d: rows(spark, d).select("kind", "id", F.size(a.citations(F.col("c"))).cast("long").alias("n")))

FOUND = "CAST(coalesce(" + ", ".join(f"nullif(regexp_extract(c, '{p}', 1), '')" for p in a.CONFIDENCE) + ") AS DOUBLE)"


@query(f"SELECT kind, id, CASE WHEN f IS NULL THEN NULL ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN f > 1 THEN f / 100 ELSE f END)) END AS confidence FROM (SELECT kind, id, {FOUND} AS f FROM {ROWS})")
def out_confidence(spark, d):
    return rows(spark, d).select("kind", "id", a.confidence(F.col("c")).alias("confidence"))


SHAPE = r"""CASE WHEN (starts_with(trim(c), '{') AND ends_with(trim(c), '}')) OR (starts_with(trim(c), '[') AND ends_with(trim(c), ']')) THEN 'JSON'
    WHEN regexp_matches(trim(c), '(?i)<(p|div|ul|ol|table|h[1-6])[ >]') THEN 'HTML' WHEN regexp_matches(trim(c), '(?m)^(#{1,6} |[-*] |[0-9]+\. )') OR contains(c, '**') THEN 'MARKDOWN' ELSE 'TEXT' END"""


@query(f"SELECT kind, id, {SHAPE} AS shape FROM {ROWS}")
def out_format(spark, d):
    return rows(spark, d).select("kind", "id", a.shape(F.col("c")).alias("shape"))


REFUSED = " OR ".join(f"starts_with(lower(trim(c)), {literal(r)})" for r in a.REFUSALS)
VALID = f"length(trim(c)) BETWEEN 10 AND 2000 AND NOT ({REFUSED})"


@query(f"SELECT kind, id, {VALID} AS valid FROM {ROWS}")
def out_validate(spark, d):
    return rows(spark, d).select("kind", "id", a.valid(F.col("c")).alias("valid"))


ISSUES = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(c, '{p}') THEN '{n}' END" for n, p in a.UNSAFE) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT kind, id, {ISSUES} AS issues FROM {ROWS}")
def out_safety(spark, d):
    return rows(spark, d).select("kind", "id", a.issues(F.col("c")).alias("issues"))


SANE = "regexp_replace(regexp_replace(c, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?i)javascript:', '', 'g')"
for _s, _e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
    SANE = f"replace({SANE}, '{_s}', '{_e}')"


@query(f"SELECT kind, id, {SANE} AS text FROM {ROWS}")
def out_sanitize(spark, d):
    return rows(spark, d).select("kind", "id", a.sanitized(F.col("c")).alias("text"))


@query(f"SELECT kind, id, {without_sql('x', a.PREFIXES)} AS answer, {SHAPE} AS shape, {VALID} AS valid, len({ISSUES}) AS issues FROM (SELECT *, {BARE} AS x FROM {ROWS})")
def out_parse(spark, d):
    c = F.col("c")
    return rows(spark, d).select("kind", "id", a.clean(c).alias("answer"), a.shape(c).alias("shape"), a.valid(c).alias("valid"), F.size(a.issues(c)).cast("long").alias("issues"))


@query(f"SELECT kind, id, CASE WHEN trim(c) = '' THEN 'empty' WHEN len({ISSUES}) > 0 THEN 'unsafe' WHEN NOT ({VALID}) THEN 'invalid' ELSE 'ok' END AS event FROM {ROWS}")
def answer_event_log(spark, d):
    c = F.col("c")
    return rows(spark, d).select("kind", "id", F.when(F.trim(c) == "", "empty").when(F.size(a.issues(c)) > 0, "unsafe").when(~a.valid(c), "invalid").otherwise("ok").alias("event"))


N = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))"


@query(f"SELECT conv_id, turn, round(least(({N.format('text')} / greatest(0.1 * {N.format('q')}, 1.0))::DOUBLE, 1.0), 3) AS confidence FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations) WHERE role = 'assistant' AND q IS NOT NULL")
def confidence_heuristic(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").withColumn("q", F.lag("text").over(w)).where("role = 'assistant' and q is not null")
    return t.select("conv_id", "turn", a.heuristic_confidence(F.col("text"), F.col("q")).alias("confidence"))


@query(r"SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 500 + coalesce(instr(translate(substr(text, 501, 200), '!?', '..'), '.'), 0)) END AS text FROM documents")
def text_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", a.truncated(F.col("text"), 500).alias("text"))
