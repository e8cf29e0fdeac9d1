"""Behaviour of functions and operators that tables alone do not show."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import answers, text
from docloom.functions import vectors as v
from docloom.operators import catalog, chunking, context, metrics, search
from docloom.sources import files
from docloom.streaming import alerts


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("x")).first().x


def test_chunk_id_ignores_case_space_and_punctuation(spark):
    ids = {one(spark, s, text.chunk_id) for s in ("Hello, World!", " hello   world ", "HELLO\n\tWORLD...")}
    assert len(ids) == 1 and len(ids.pop()) == 16


def test_words_and_sentences(spark):
    assert one(spark, "This is a test sentence here.", text.token_count) == 6
    assert one(spark, "One. Two! Three? and a rest", text.sentences) == ["One.", "Two!", "Three?", "and a rest"]
    assert one(spark, "", text.sentences) == [] and one(spark, "  ", text.sentences) == []


def test_preprocessing_twice_changes_nothing(spark):
    rows = ["<p>a &amp; b</p>\n\n\n• x", "Page 1\nx\nPage 1\ny\nPage 1", "“q” — r", None, "", "1) a\n2) b"]
    for s in rows:
        first = one(spark, s, text.preprocess)
        assert one(spark, first, text.preprocess) == first


def test_fixed_chunks_cover_the_text_and_end(spark):
    body = ("word " * 900).strip()
    chunks = one(spark, body, text.fixed_chunks)
    assert chunks[0].start == 0 and chunks[-1].end == len(body)
    assert all(a.end > b.start and b.end > a.end for a, b in zip(chunks, chunks[1:]))
    assert all(c.content == body[c.start : c.end] for c in chunks)
    assert one(spark, "x" * 5000, text.fixed_chunks)[-1].end == 5000 and one(spark, "", text.fixed_chunks) == []


def test_sentence_chunks_keep_their_bounds(spark):
    body = " ".join(f"Sentence number {k} has exactly seven words." for k in range(200))
    chunks = one(spark, body, text.sentence_chunks)
    assert chunks and all(100 <= c.words <= 256 for c in chunks)
    assert [c.chunk_index for c in chunks] == list(range(len(chunks)))


def test_recursive_chunks_have_true_offsets(spark):
    body = "\n\n".join(" ".join(f"Section {k} sentence {j} goes on and on." for j in range(30)) for k in range(4))
    rows = chunking.recursive_chunks(spark.createDataFrame([(1, body), (2, None)], "doc_id long, text string")).orderBy("chunk_index").collect()
    assert rows and all(r.content == body[r.start_char : r.end_char].strip() for r in rows)
    with_copies = spark.createDataFrame([(1, body + "\n\n" + body)], "doc_id long, text string")
    assert chunking.chunk_documents(with_copies).count() <= len(rows) + 1


def test_greedy_distinct_keeps_no_near_pair(spark):
    rows = [(1, k, 1.0 - k / 10, [1.0, k * 0.05]) for k in range(8)]
    df = spark.createDataFrame(rows, "q int, id long, score double, embedding array<float>")
    kept = sorted(r.id for r in context.greedy_distinct(df, ["q"], 0.99).collect())
    assert kept[0] == 0 and len(kept) < 8
    assert context.greedy_distinct(df.where("false"), ["q"]).count() == 0


def test_budgets(spark):
    df = spark.createDataFrame([(1, k, "w " * 60) for k in range(5)], "q int, pos int, text string")
    cut = context.truncated_to_budget(df, ["q"], ["pos"], 175).orderBy("pos").collect()
    assert [r.words for r in cut] == [60, 60, 55]
    assert [r.words for r in context.truncated_to_budget(df, ["q"], ["pos"], 165).orderBy("pos").collect()] == [60, 60]
    assert context.within_budget(df, ["q"], ["pos"], F.lit(10), 30).count() == 3


def test_clusters(spark):
    rows = [(1, k, float(k), [float(k // 3), 0.0]) for k in range(9)]
    df = spark.createDataFrame(rows, "q int, id long, score double, embedding array<double>")
    for linkage in ("complete", "ward"):
        out = context.clusters(df, ["q"], linkage=linkage, threshold=0.5).collect()
        assert len({r.cluster for r in out}) == 3 and sorted(r.id for r in out if r.best) == [2, 5, 8]


def test_bm25_of_frequent_terms_and_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a d"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a"), (2, "b b"), (3, "zzz")], "query_id long, text string")
    got = {(r.query_id, r.doc_id): r.score for r in search.bm25(q, docs).collect()}
    assert {d for k, d in got if k == 1} == {1, 2, 3} and (2, 1) in got and not any(k == 3 for k, _ in got)
    assert search.bm25(q, docs.where("false")).count() == 0


def test_bm25_without_k_ranks_all(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("a "), F.col("id").cast("string")).alias("text"))
    q = spark.createDataFrame([(1, "a")], "query_id long, text string")
    got = search.bm25(q, docs, None, variant="lucene").collect()
    assert sorted(r.rank for r in got) == list(range(1, 61)) and len({r.doc_id for r in got}) == 60
    assert search.bm25(q, docs, variant="lucene").count() == 20


def test_nearest_in_blocks(spark):
    df = spark.createDataFrame([(k, [float(k % 7), float(k % 5), 1.0]) for k in range(100)] + [(200, None)], "vec_id long, embedding array<double>")
    q = df.where("vec_id < 20")
    whole = sorted(map(tuple, search.nearest(q, df, 5).collect()))
    assert whole == sorted(map(tuple, search.nearest(q, df, 5, block=4).collect())) and len(whole) == 100
    with pytest.raises(ValueError):
        search.nearest(q, df, 5, "nope")


def test_inverted_lists_find_most(spark):
    import random

    rng = random.Random(1)
    df = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(1000)], "vec_id long, embedding array<double>")
    q = df.where("vec_id % 20 = 0")
    want = {(r.query_id, r.vec_id) for r in search.nearest(q, df, 10, "ip").collect()}
    got = {(r.query_id, r.vec_id) for r in search.nearest_by_lists(q, df, 10, probes=8).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_inverted_lists_reach_their_recall_on_a_table(spark):
    import os

    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    df = spark.read.parquet(path).select("vec_id", "embedding")
    q = df.where("vec_id % 7 = 0")
    want = {(r.query_id, r.vec_id) for r in search.nearest(q, df, 10, "ip").collect()}
    got = {(r.query_id, r.vec_id) for r in search.nearest_by_lists(q, df).collect()}
    share = len(want & got) / len(want)
    print("recall", share)
    assert share >= 0.9


def test_product_codes_have_eight_bits(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = search.product_codes(df, parts=2).collect()
    error = np.mean([((np.array(r.decoded) - x[r.vec_id]) ** 2).sum() / (x[r.vec_id] ** 2).sum() for r in rows])
    assert len(rows) == 600 and max(c for r in rows for c in r.codes) >= 200 and error < 0.3
    few = spark.createDataFrame([(k, [float(k % 3)] * 16) for k in range(30)], "vec_id long, embedding array<double>")
    assert all(np.allclose(r.decoded, r.vec_id % 3) for r in search.product_codes(few, parts=2).collect())


def test_half_precision(spark):
    assert one(spark, [0.1, -3.0, 0.0], v.halved, "array<float>") == [0.0999755859375, -3.0, 0.0]


def test_p95_exclusive(spark):
    import statistics

    values = [((k * 37) % 101) / 7 for k in range(60)]
    df = spark.createDataFrame([("a", x) for x in values] + [("b", 1.0)] * 5, "k string, v double")
    got = {r.k: r.p95 for r in metrics.p95_exclusive(df, ["k"], "v").collect()}
    assert abs(got["a"] - statistics.quantiles(values, n=20)[18]) < 1e-9 and got["b"] == 0


def test_catalog(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, x string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(catalog.upserted(now, new, "id")) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(catalog.inserted(now, new, "id")) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(catalog.deleted(now, new, "id")) == [(1, "a")]


def test_answers(spark):
    assert one(spark, "Confidence: 85%", answers.confidence) == 0.85 and one(spark, "none", answers.confidence) is None
    assert one(spark, "see [Source 2] and [Source 2], page 4", answers.citations) == ["2", "4"]
    assert one(spark, "I cannot do that at all", answers.valid) is False


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "b.html").write_text("<b>x</b> &lt;y&gt;")
    (tmp_path / "m.eml").write_bytes(b"Subject: S\r\nContent-Type: text/html\r\n\r\n<p>Hi</p>")
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "d.docx").write_bytes(out.getvalue())
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.parsed(files.files(spark, str(tmp_path))).collect()}
    assert got["a.txt"] == ("caf\xe9", None) and got["b.html"] == ("x <y>", None) and got["m.eml"] == ("Subject: S\nHi", None)
    assert got["d.docx"] == ("Para\na | b", None) and got["bad.docx"][0] is None and got["bad.docx"][1]


def test_suppression_of_a_stream_equals_the_table(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(seconds=97 * k), "ab"[k % 2]) for k in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, key string")
    df.write.parquet(str(tmp_path / "events"))
    table = sorted((r.key, r.event_id) for r in metrics.suppressed(df).collect())
    stream = alerts.gathered(alerts.suppressed_stream(alerts.event_stream(spark, str(tmp_path / "events"), df.schema)))
    assert sorted((r.key, r.event_id) for r in stream.collect()) == table


def test_the_entry_without_the_corpus_operators(spark):
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; n = e.queries(); assert len(n) > 150 and not any(k.startswith('op') for k in n); e.oracle_sql()"
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_long_texts_take_linear_time(spark):
    """One text of a million characters, of which most lines are page numbers: what took minutes when it was quadratic."""
    import time

    body = "\n".join(f"Page {k % 40}" if k % 3 else f"line {k} of it  with some  words. And more" for k in range(60_000))
    assert len(body) > 1_000_000
    df = spark.createDataFrame([(body,)], "c string")
    for change in (text.fixed_chunks, text.sentence_chunks, text.without_running_lines, text.table_pipes, text.preprocess):
        began = time.perf_counter()
        got = df.select(change(F.col("c")).alias("x")).first().x
        assert len(got) > 500 and time.perf_counter() - began < 30, change.__name__


def test_running_lines_against_counts(spark):
    import collections
    import random

    rng = random.Random(3)
    for _ in range(20):
        every = [rng.choice(["Page 1", " Page 1 ", "page 2", "7", "text", "", "Draft x", f"own {rng.random()}"]) for _ in range(rng.randint(0, 60))]
        counts = collections.Counter(x.strip(" ") for x in every)
        least = max(2.0, 0.1 * sum(x.strip(" ") != "" for x in every))
        runs = ("page 1", "page 2", "7", "draft x")
        want = [x for x in every if not (x.strip(" ").lower() in runs and counts[x.strip(" ")] > least)]
        assert one(spark, "\n".join(every), text.without_running_lines) == "\n".join(want)


def test_hashing_finds_the_nearest_without_pairs(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(900, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(k, e.tolist()) for k, e in enumerate(x)] + [(900, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asks = df.where("vec_id % 20 = 0")
    keys = lambda found: {(r.query_id, r.vec_id, r["rank"]) for r in found.collect()}
    true = {(r.query_id, r.vec_id) for r in search.nearest(asks, df, 10, "ip").collect()}
    few = search.nearest_by_hashing(asks, df, bucket=0.05, tables=60)
    found = keys(few)
    assert len({(q, d) for q, d, _ in found} & true) >= 0.9 * len(true) and keys(search.nearest_by_hashing(asks, df, bucket=0.05, tables=60, block=7)) == found
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and all(r["rank"] <= 10 and r.query_id != r.vec_id for r in few.collect())
    assert search.nearest_by_hashing(asks.where("false"), df).count() == 0 and search.nearest_by_hashing(asks, df.where("false")).count() == 0


def test_bm25_with_null_texts_as_its_sql(spark, tmp_path):
    import duckdb

    from docloom.plans import registry

    docs = [(k, None if k % 3 == 0 else " ".join(f"w{(k * j) % 17}" for j in range(1 + k % 7))) for k in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "w1 w2 w5"), (2, "w3 w3")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    columns = "query_id, doc_id, score, rank"
    for name in ("bm25", "bm25_elastic", "filter_bm25_positive"):
        got = sorted(map(tuple, registry.queries()[name](spark, str(tmp_path)).select(*columns.split(", ")).collect()))
        assert got == sorted(con.sql(f"select {columns} from ({registry.oracle_sql()[name]})").fetchall()) and (got or name[0] == "f")


def test_bm25_of_more_matches_than_a_million(spark, tmp_path):
    import duckdb

    from docloom.plans import registry

    # 1,000,020 of 2,250,045 documents have the word, so often in the query that all of them score above 5.
    con = duckdb.connect()
    con.sql(f"copy (select range as doc_id, case when range % 9 < 4 then 'w' else 'x' end as text from range(2250045)) to '{tmp_path}/documents.parquet'")
    con.sql(f"copy (select 1::bigint as item_id, repeat('w ', 80) as text) to '{tmp_path}/benchmark.parquet'")
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    want = con.sql(f"select count(*), max(rank), min(score), max(doc_id) from ({registry.oracle_sql()['filter_bm25_positive']})").fetchall()[0]
    got = registry.queries()["filter_bm25_positive"](spark, str(tmp_path)).agg(F.count("*"), F.max("rank"), F.min("score"), F.max("doc_id")).first()
    assert tuple(got) == want and got[0] == got[1] == 1_000_020


def test_bm25_scores_are_rounded_as_sql_rounds(spark):
    import duckdb
    import numpy as np

    from docloom.plans import retrieval_queries

    sql = lambda x, places: duckdb.execute("select round(?::double, ?)", [x, places]).fetchall()[0][0]
    scores = [16.0416705, 32.7364305, 32.7583935, 8.0000005, 5.0000015, 7.25, 1e-7]
    got = retrieval_queries.rounded(spark.createDataFrame([(x,) for x in scores], "score double")).collect()
    assert [r.score for r in got] == [sql(x, 6) for x in scores]
    halves = [1 / 1024, 3 / 1024, 5 + 1 / 1024, 16.0416705, 0.0]
    assert search._nine(np.array(halves)).tolist() == [sql(x, 9) for x in halves]


def test_unit_vectors_as_their_sql(spark, tmp_path):
    import duckdb
    import numpy as np

    from docloom.plans import registry

    rows = [(1, [1.0, -1e-9, 1e-9]), (2, [0.0, 0.0]), (3, [-3.0, 4.0]), (4, []), (5, None), (6, [1e200, 1.0]), (7, [-1e-200])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create table embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet' where embedding is not null")  # SQL refuses null
    want = dict(con.sql(registry.oracle_sql()["l2_normalize"]).fetchall())
    got = {r.vec_id: r.unit for r in registry.queries()["l2_normalize"](spark, str(tmp_path)).collect()}
    assert got.pop(5, 0) is None and repr(got) == repr({k: want[k] for k in got}) and len(got) == 6
    x = np.random.default_rng(5).normal(size=500) / 8
    ours = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(F.transform("x", lambda y: v.rounded(y, 3)).alias("x")).first().x
    assert repr(ours) == repr([con.execute("select round(?::double, 3)", [y]).fetchone()[0] for y in x.tolist()])

def test_costs_that_add_up_to_a_tie(spark, tmp_path):
    from docloom.plans import registry

    rows = [(4, 1, "assistant", "x" * 236), (4, 2, "user", ""), (4, 3, "assistant", "x" * 144)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.queries()["agg_cost"](spark, str(tmp_path)).collect()
    assert [(r.model, r.cost) for r in got] == [("unlisted", 0.0029)]  # 0.00285, as doubles 0.0028499999999999997
