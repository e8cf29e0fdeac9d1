"""Hooks, stores, indexing and options, and what SQL can't say about ranking."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from docloom import settings
from docloom.operators import catalog, hooks, search
from docloom.sources import store


def test_hooks_get_batches_and_are_made_once_a_task(spark):
    def make():
        seen = []

        def f(xs):
            seen.append(len(xs))
            return [f"{x}:{len(seen)}:{len(xs)}" for x in xs]

        return f

    rows = spark.range(10).coalesce(1).select(F.col("id").cast("string").alias("x"), F.lit(1).alias("out"))
    got = [r.out for r in hooks.mapped(rows, ["x"], make, "out", "string", batch=4).collect()]
    assert got == [f"{k}:{k // 4 + 1}:{4 if k < 8 else 2}" for k in range(10)]
    with pytest.raises(Exception, match="the hook made 0 values"):
        hooks.mapped(rows, ["x"], lambda: lambda xs: [], "out", "string").collect()


def test_tokenizer_counts(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    one, texts = Tokenizer.from_file(path), ["a few words", "", None, "Ünïcode 12345 " * 50]
    got = hooks.mapped(spark.createDataFrame([(t,) for t in texts], "text string"), ["text"], hooks.tokenizer_counts(path), "n", "long").collect()
    assert collections.Counter(r.n for r in got) == collections.Counter(len(one.encode(t or "", add_special_tokens=False).ids) for t in texts)


def test_store(spark, tmp_path):
    one = store.store("flat", spark, 2).add(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>"))
    two = one.add(spark.createDataFrame([(2, [1.0, 1.0]), (3, [1.0, 0.1])], "vec_id long, embedding array<double>")).delete(spark.createDataFrame([(1,), (9,)], "vec_id long"))
    assert one.stats()["vectors"] == 2 and two.stats()["vectors"] == 2
    two.save(f"file://{tmp_path}/s")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in store.load(spark, f"file://{tmp_path}/s").search(asked, 5).orderBy("rank").collect()] == [3, 2]
    for bad in ([1.0], [1.0, None], [float("nan"), 1.0], None):
        with pytest.raises(ValueError, match="1 vectors are not"):
            one.add(spark.createDataFrame([(5, bad)], "vec_id long, embedding array<double>"))
    with pytest.raises(ValueError, match="unknown store"):
        store.store("other", spark, 2)


def test_indexing_is_repeatable_and_refuses_nulls(spark):
    kinds = "doc_id long, chunk_index int, content string"
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], kinds)
    documents, stored, result = catalog.indexed(spark.createDataFrame([], "doc_id long, doc_hash string, total_chunks long"), spark.createDataFrame([], kinds), chunks)
    assert {(r.doc_id, r.total_chunks, r.skipped) for r in result.collect()} == {(1, 2, False), (2, 1, False)}
    again = catalog.indexed(documents, stored, chunks)
    assert {r.skipped for r in again[2].collect()} == {True} and again[1].count() == 3
    with pytest.raises(ValueError, match="1 chunks lack"):
        catalog.indexed(documents, stored, spark.createDataFrame([(1, 0, None)], kinds))


def test_tfidf_against_its_definition(spark):
    texts = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "", None, "Mat! mat? MAT"]
    split = [[w for w in re.findall(r"\w+", (t or "").lower()) if len(w) > 1] for t in texts]
    counts = [collections.Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for w in split]
    total, df = collections.Counter(), collections.Counter()
    for c in counts:
        total.update(c)
        df.update(c.keys())
    kept = {t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:8]}
    want = {}
    for k, c in enumerate(counts):
        x = {t: n * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in c.items() if t in kept}
        want |= {(k, t): v / math.sqrt(sum(y * y for y in x.values())) for t, v in x.items()}
    got = {(r.doc_id, r.term): r.weight for r in search.tfidf(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 8).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-8) for k in want)


def test_bm25_in_blocks_is_the_same(spark):
    rows = spark.createDataFrame([(k, f"word{k % 7} word{k % 11} common" + " common" * (k % 3)) for k in range(200)] + [(500, None), (501, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(k, f"word{k} common word{k + 1} nowhere") for k in range(9)] + [(50, None), (51, "nowhere")], "query_id long, text string")
    for k in (3, None):
        whole, parts = (sorted(map(tuple, search.bm25(asked, rows, k, block=b).collect())) for b in (1024, 2))
        assert whole == parts and whole
    assert search.bm25(asked, rows.limit(0)).count() == 0 and search.bm25(asked.limit(0), rows).count() == 0


def test_options():
    assert settings.model_name(" Fast ") == "haiku-like" and settings.model_name("own") == "own"
    with pytest.raises(ValueError):
        settings.Chunking(size=0)
    with pytest.raises(ValueError):
        settings.Embedding(model="")
