"""Queries over texts: cleaning, hashing, counting, chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as t

from docloom.plumbing import spread

from .registry import query, table, values

docs = lambda spark, d: table(spark, d, "documents")
pages = lambda spark, d: table(spark, d, "pages")

# The same things in SQL. RE2 has no Unicode classes under \w and \s, so they are spelled out.
W = r"[\p{L}\p{N}\p{M}_]+"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
PLAIN = r"regexp_replace(regexp_replace(lower(" + STRIP + r"), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', '', 'g')"
CHUNK_ID = "substr(sha256(" + PLAIN + "), 1, 16)"
COUNT = "len(regexp_extract_all({}, '" + W.replace("{", "{{").replace("}", "}}") + "'))"


def html_sql(c: str) -> str:
    bare = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]+>', '', 'g')"
    for entity, sign in t.ENTITIES:
        bare = f"replace({bare}, '{entity}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return f"CASE WHEN contains({c}, '<') AND contains({c}, '>') THEN {bare} ELSE {c} END"


def space_sql(c: str) -> str:
    one = rf"regexp_replace(regexp_replace(regexp_replace({c}, '\r\n?', chr(10), 'g'), '[\t\f\v\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'), ' +', ' ', 'g')"
    trimmed = f"array_to_string(list_transform(string_split({one}, chr(10)), lambda s: trim(s)), chr(10))"
    return rf"regexp_replace(regexp_replace({trimmed}, '\n{{2,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')"


def lines_sql(c: str, each: str) -> str:
    return f"array_to_string(list_transform(string_split({c}, chr(10)), lambda s: {each}), chr(10))"


BULLET_LINE = r"regexp_replace(regexp_replace(s, '^[ ]*[•●◦▪*+–-] +', '• '), '^[ ]*\(?([0-9]{1,3})[.):] +', '\1. ')"
RUNNING = t.RUNNING_LINES
SIGNS = "translate({}, " + "'" + t.SIGNS[0] + "', '" + t.SIGNS[1].replace("'", "''") + "')"


def running_sql(c: str) -> str:
    every = f"string_split({c}, chr(10))"
    least = f"greatest(2.0, 0.1 * len(list_filter({every}, lambda x: trim(x) <> '')))"
    return f"array_to_string(list_filter({every}, lambda s: NOT (regexp_matches(trim(s), '{RUNNING}') AND len(list_filter({every}, lambda u: trim(u) = trim(s))) > {least})), chr(10))"


def final_sql(c: str) -> str:
    bare = STRIP.format(rf"regexp_replace({c}, '\n{{3,}}', chr(10) || chr(10), 'g')")
    return f"CASE WHEN {bare} = '' THEN '' ELSE {bare} || chr(10) END"


@query(f"SELECT doc_id, {CHUNK_ID.format('text')} AS chunk_id FROM documents")
def chunk_id(spark, d):
    return docs(spark, d).select("doc_id", t.chunk_id(F.col("text")).alias("chunk_id"))


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, substr(sha256(text), 1, 8) AS short FROM documents")
def generate_hash(spark, d):
    c = F.col("text")
    return docs(spark, d).select("doc_id", t.digest(c, "md5").alias("md5"), t.digest(c, "sha1").alias("sha1"), t.digest(c).alias("sha256"), t.digest(c, length=8).alias("short"))


@query()
def generate_hash_sha512(spark, d):
    return docs(spark, d).select("doc_id", t.digest(F.col("text"), "sha512").alias("sha512"))


@query(f"SELECT doc_id, {COUNT.format('text')} AS tokens FROM documents")
def token_count(spark, d):
    return docs(spark, d).select("doc_id", t.token_count(F.col("text")).alias("tokens"))


SENTENCES = r"list_filter(list_transform(list_concat(regexp_extract_all({0}, '[^.!?]+[.!?]+'), [regexp_replace({0}, '(?s)^.*[.!?]', '')]), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@query(f"SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {SENTENCES.format('text')} AS s FROM documents)")
def sent_split(spark, d):
    return spread(docs(spark, d)).select("doc_id", F.posexplode(t.sentences(F.col("text"))).alias("pos", "sentence"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(translate(regexp_replace(text, '[\x00-\x08\x0E-\x1F\x7F]', '', 'g'), '|01', 'IOl'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents")
def ocr_clean(spark, d):
    return spread(docs(spark, d)).select("doc_id", t.ocr_clean(F.col("text")).alias("text"))


@query(f"SELECT page_id, {html_sql('html')} AS text FROM pages")
def html_strip(spark, d):
    return pages(spark, d).select("page_id", t.html_text(F.col("html")).alias("text"))


@query(f"SELECT page_id, {space_sql(html_sql('html'))} AS text FROM pages")
def ws_normalize(spark, d):
    return pages(spark, d).select("page_id", t.normal_space(t.html_text(F.col("html"))).alias("text"))


PREPROCESS = final_sql(running_sql(lines_sql(space_sql(html_sql(SIGNS.format("c"))), BULLET_LINE)))


@query(f"SELECT page_id, {PREPROCESS} AS text FROM (SELECT page_id, html AS c FROM pages)")
def preprocess_text(spark, d):
    return pages(spark, d).select("page_id", t.preprocess(F.col("html")).alias("text"))


@query(f"SELECT doc_id, {PREPROCESS} AS text FROM (SELECT doc_id, text AS c FROM documents)")
def preprocess_documents(spark, d):
    return spread(docs(spark, d)).select("doc_id", t.preprocess(F.col("text")).alias("text"))


# Lines that the tables do not have, for the steps that look for them.
LINES = [
    (1, "• one\n- two\n  * three\n1) four\n(2) five\n3: six\nplain - text"),
    (2, "Page 1\nbody a\nPage 1\nbody b\nPage 1\nbody c\nCONFIDENTIAL memo"),
    (3, "name  size   colour\nant  2   red\nno table here\nlone  row"),
    (4, "1. SCOPE OF WORK\n1.2 Details\nGENERAL TERMS\ntext\nSECTION 4 applies"),
    (5, "“Quoted” — it’s – so…\n\n\n\nnext"),
    (6, ""),
    (7, "Draft v1\nDraft v1\nDraft v1\nDraft v1"),
    (8, "  \t spaced\f out \r\nline\r\n\r\n\r\nend  "),
    (9, "aaaaaaaaaaaa !!!!!!!! 123456789012"),
    (10, None),
]


def _lines(spark):
    return spark.createDataFrame(LINES, "id int, c string")


LINES_SQL = values([(k, None if c is None else c) for k, c in LINES], "id, c")


@query(f"SELECT id, {SIGNS.format('c')} AS text FROM {LINES_SQL}")
def unicode_fix(spark, d):
    return _lines(spark).select("id", t.plain_signs(F.col("c")).alias("text"))


@query(f"SELECT id, {lines_sql('c', BULLET_LINE)} AS text FROM {LINES_SQL}")
def bullets_std(spark, d):
    return _lines(spark).select("id", t.bullets(F.col("c")).alias("text"))


@query(f"SELECT id, {running_sql('c')} AS text FROM {LINES_SQL}")
def header_footer_drop(spark, d):
    return _lines(spark).select("id", t.without_running_lines(F.col("c")).alias("text"))


SECTION = r"CASE WHEN regexp_matches(s, '^[0-9]+\.[0-9]+(\.[0-9]+)*\.? +\S') THEN '[SUBSECTION] ' || s WHEN regexp_matches(s, '^[0-9]+\. +[A-Z][A-Z ]+$') OR regexp_matches(s, '^[A-Z][A-Z ]{3,}$') OR regexp_matches(s, '^(SECTION|ARTICLE|CHAPTER) +[0-9IVX]+') THEN '[SECTION] ' || s ELSE s END"


@query(f"SELECT id, {lines_sql('c', SECTION)} AS text FROM {LINES_SQL}")
def sections_tag(spark, d):
    return _lines(spark).select("id", t.section_tags(F.col("c")).alias("text"))


WIDE = r"regexp_matches(coalesce({}, ''), '\S {{2,}}\S')"
PIPES = "array_to_string(list_transform(l, lambda s, k: CASE WHEN " + WIDE.format("s") + " AND (" + WIDE.format("CASE WHEN k > 1 THEN l[k - 1] END") + " OR " + WIDE.format("l[k + 1]") + r") THEN regexp_replace(regexp_replace(s, '^\s+|\s+$', '', 'g'), ' {2,}', ' | ', 'g') ELSE s END), chr(10))"


@query(f"SELECT id, {PIPES} AS text FROM (SELECT id, string_split(c, chr(10)) AS l FROM {LINES_SQL})")
def table_pipes(spark, d):
    return _lines(spark).select("id", t.table_pipes(F.col("c")).alias("text"))


@query(f"SELECT id, {final_sql('c')} AS text FROM {LINES_SQL}")
def final_cleanup(spark, d):
    return _lines(spark).select("id", t.final_form(F.col("c")).alias("text"))


@query("SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, trim(unnest(l)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def text_line_stream(spark, d):
    return spread(docs(spark, d)).select("doc_id", F.posexplode(t.lines(F.col("text"))).alias("pos", "line")).withColumn("line", F.trim("line"))


ONE_LINE = STRIP.format(r"regexp_replace({c}, '\s+', ' ', 'g')")


@query(f"SELECT doc_id, CASE WHEN regexp_matches(x, '{RUNNING}') OR length(x) < 3 THEN '' ELSE x END AS text FROM (SELECT doc_id, {ONE_LINE.format(c='text')} AS x FROM documents)")
def parser_clean(spark, d):
    return spread(docs(spark, d)).select("doc_id", t.parsed(F.col("text")).alias("text"))


RE2_SUSPICIOUS = (r"[^\p{L}\p{N}\p{M}_\s]{3,}", r"[0-9]{4,}")


def _quality_sql() -> str:
    ratio = [f"len(regexp_extract_all(text, '{p}')) / greatest(length(text), 1)" for p in RE2_SUSPICIOUS]
    w = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')"
    score = "1.0" + "".join(f" - 0.3 * {r}" for r in ratio)
    score = f"CAST({score} AS DOUBLE) * CASE WHEN length(text) < 50 THEN 0.5 ELSE 1 END * CASE WHEN len({w}) > 10 AND len(list_distinct({w})) / greatest(len({w}), 1) < 0.5 THEN 0.7 ELSE 1 END"
    return f"SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0 ELSE greatest({score}, 0) END, 6) AS score, {' OR '.join(f'{r} > 0.1' for r in ratio)} AS suspicious FROM documents"


@query(_quality_sql())
def text_quality(spark, d):
    q = t.quality(F.col("text"), RE2_SUSPICIOUS)
    return spread(docs(spark, d)).select("doc_id", q.alias("q")).select("doc_id", F.round("q.score", 6).alias("score"), "q.suspicious")


@query()
def text_quality_default(spark, d):
    q = t.quality(F.col("text"))
    return spread(docs(spark, d)).select("doc_id", q.alias("q")).select("doc_id", F.round("q.score", 6).alias("score"), "q.suspicious")


FIXED_SQL = """
WITH RECURSIVE walk AS (
    SELECT doc_id, text, 0 AS start, 0 AS stop, false AS over, 0 AS k FROM documents WHERE length(text) > 0
    UNION ALL
    SELECT doc_id, text, s AS start, e AS stop, e >= length(text) AS over, k + 1 FROM (
        SELECT *, CASE WHEN s + 1000 < length(text) AND blank > 200 THEN s + blank ELSE least(s + 1000, length(text)) END AS e FROM (
            SELECT *, CASE WHEN contains(w, ' ') THEN length(w) - instr(reverse(w), ' ') ELSE 0 END AS blank FROM (
                SELECT *, substr(text, s + 1, least(s + 1000, length(text)) - s) AS w FROM (
                    SELECT *, CASE WHEN k = 0 THEN 0 ELSE greatest(stop - 100, start + 1) END AS s FROM walk WHERE NOT over))))
)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index, start AS start_char, stop AS end_char, substr(text, start + 1, stop - start) AS content
FROM walk WHERE k > 0 AND stop - start >= 200
"""


@query(FIXED_SQL)
def chunk_fixed(spark, d):
    return spread(docs(spark, d)).select("doc_id", F.explode(t.fixed_chunks(F.col("text"))).alias("x")).select("doc_id", "x.chunk_index", F.col("x.start").alias("start_char"), F.col("x.end").alias("end_char"), "x.content")


@query()
def chunk_sentence(spark, d):
    return spread(docs(spark, d)).select("doc_id", F.explode(t.sentence_chunks(F.col("text"))).alias("x")).select("doc_id", "x.*")


@query(r"SELECT doc_id, w AS term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS w FROM documents) GROUP BY ALL")
def term_frequencies(spark, d):
    return docs(spark, d).select("doc_id", F.explode(t.terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:50], ' ') AS summary FROM documents")
def compress_mock(spark, d):
    return docs(spark, d).select("doc_id", t.first_words(F.col("text"), 50).alias("summary"))


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:100], ' ') AS text FROM documents")
def trim_words(spark, d):
    return docs(spark, d).select("doc_id", t.first_words(F.col("text"), 100).alias("text"))


@query("SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def tok_est_chars4(spark, d):
    return docs(spark, d).select("doc_id", F.expr("length(text) div 4").alias("tokens"))
