"""The pipeline's stages one by one, and the queries' contracts on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_data
def test_stages(spark):
    import corpus_pipeline as p
    from docloom.llm import common, jaccard, passages, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(p.STAGES):
        before, docs = docs, common.written(stage(spark, docs, SF), name)
        counts.append(docs.count())
        if k < len(p.STAGES) - 1:
            assert docs.columns == columns
        if name == "toxicity":
            model = toxicity.trained(before, spark.read.parquet(f"{SF}/labels.parquet"))
            want = toxicity.scored(before, model).where(F.col("score") < toxicity.THRESHOLD)
            assert sorted(r.doc_id for r in want.collect()) == sorted(r.doc_id for r in docs.collect())
        if name == "exact_dedup":
            assert counts[-1] == before.select("text").distinct().count() == docs.select("text").distinct().count()
            best = {r.text: r.top for r in before.groupBy("text").agg(F.max("doc_id").alias("top")).collect()}
            assert {r.text: r.doc_id for r in docs.collect()} == best
        if name == "jaccard_join":
            groups = jaccard.near_groups(before)
            assert counts[-1] == groups.select("component_id").distinct().count()
            assert sorted(r.doc_id for r in docs.collect()) == sorted({r.component_id for r in groups.collect()})
        if name == "substring_dedup":
            assert passages.repeated_passages(docs).count() <= 0.1 * max(1, passages.repeated_passages(before).count()) + 1
            assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2]


@needs_data
def test_queries_have_the_contracts_columns(spark):
    from docloom.llm import queries as q

    want = {
        "op1_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        "op2_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op3_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
        "op5_bpe_codec": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op8_topk": ["query_id", "rank", "vec_id", "score"],
        "op9_jaccard": ["doc_id", "n_shingles", "component_id"],
    }
    for name, columns in want.items():
        assert q.queries()[name](spark, SF).columns == columns
    assert sorted(int(n[2:].split("_")[0]) for n in q.queries()) == list(range(1, 11))


@needs_data
def test_queries_against_their_sql(spark):
    import duckdb

    from docloom.llm import queries as q

    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    for name, sql in q.oracle_sql().items():
        rel = con.sql(sql)
        columns = rel.columns
        got = sorted(repr(tuple(r[c] for c in columns)) for r in q.queries()[name](spark, SF).collect())
        assert got == sorted(map(repr, rel.fetchall())), name
