"""Models as hooks: what needs one takes a factory, which each task calls once, and a function over lists of rows.

``make()`` returns ``f(*columns: list) -> list`` with one value for each row; it runs over Arrow batches, so a model is
loaded once a task and gets whole batches. Beside the hooks are deterministic stand-ins that need no model.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Make = Callable[[], Callable[..., list]]


def mapped(rows: DataFrame, columns: list[str], make: Make, out: str, kind: str, batch: int = 64) -> DataFrame:
    """``rows`` with what the hook makes of ``columns``, ``batch`` rows at a time, in column ``out`` of type ``kind``."""
    names = [c for c in rows.columns if c != out]
    at, field = [names.index(c) for c in columns], T._parse_datatype_string(kind)
    arrow = to_arrow_type(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hook = make()
        for whole in batches:
            for k in range(0, whole.num_rows, batch):
                part = whole.slice(k, batch)
                made = hook(*(part.column(j).to_pylist() for j in at))
                if len(made) != part.num_rows:
                    raise ValueError(f"the hook made {len(made)} values of {part.num_rows} rows")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, arrow)], [*names, out])

    return rows.select(names).mapInArrow(run, T.StructType([*(rows.schema[c] for c in names), T.StructField(out, field)]))


def embedded(rows: DataFrame, make: Make, text: str = "text", out: str = "embedding", batch: int = 64) -> DataFrame:
    """``rows`` with a vector of length 1 for each text (null counts as empty; a vector of zeros stays one)."""

    def unit() -> Callable[..., list]:
        hook = make()

        def f(texts: list) -> list:
            v = np.asarray(hook([x or "" for x in texts]), float)
            return list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12))

        return f

    return mapped(rows, [text], unit, out, "array<double>", batch)


def letter_embedder() -> Callable[[list], list]:
    """The stand-in for an embedding model: how many vowels, capitals, digits and blanks a text has."""
    kinds = [re.compile(p) for p in ("[aeiou]", "[A-Z]", "[0-9]", " ")]
    return lambda texts: [[float(len(k.findall(x))) for k in kinds] for x in texts]


def reranked(pairs: DataFrame, make: Make, k: int, *, batch: int | None = None, order: str = "rank") -> DataFrame:
    """query_id, doc_id, score and place of each query's best rows by what the hook says of (question, text).

    With ``batch``, candidates are taken in batches of that many in their ``order``; each keeps its best ``k``, and what they
    keep is sorted as one list. Without, the best ``k`` of all stay. Ties keep the order they came in.
    """
    w = Window.partitionBy("query_id")
    scored = mapped(pairs.select("query_id", "doc_id", order, "question", "text"), ["question", "text"], make, "score", "double").drop("question", "text")
    if batch:
        scored = scored.withColumn("batch", F.floor((F.row_number().over(w.orderBy(order)) - 1) / batch))
        best = F.row_number().over(Window.partitionBy("query_id", "batch").orderBy(F.col("score").desc(), order))
        scored = scored.withColumn("own", best).where(F.col("own") <= k)
    place = F.row_number().over(w.orderBy(F.col("score").desc(), order))
    out = scored.withColumn("place", place).select("query_id", "doc_id", "score", "place")
    return out if batch else out.where(F.col("place") <= k)


def length_scorer() -> Callable[..., list]:
    """The stand-in for a cross-encoder: how near the lengths of question and text are, 0 to 1."""
    return lambda questions, texts: [min(len(q or ""), len(t or "")) / max(len(q or ""), len(t or ""), 1) for q, t in zip(questions, texts)]


def tokenizer_counts(path: str) -> Make:
    """A hook that counts tokens by a file of the tokenizers library (.json), of sentencepiece (.model) or of tiktoken ranks (.tiktoken)."""

    def make() -> Callable[[list], list]:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            one = Tokenizer.from_file(path)
            return lambda texts: [len(x.ids) for x in one.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            return lambda texts: [len(x) for x in model.encode([t or "" for t in texts])]
        raise ValueError(f"no tokenizer for {path}")

    return make


class Refused(Exception):
    """What a fetch hook raises for an answer that trying again won't change."""


def fetched(urls: DataFrame, make: Make, *, attempts: int = 3, most_bytes: int = 50 << 20, pause: float = 0.0) -> DataFrame:
    """``urls`` (url, any columns) with content, content_type, tries and error, by a hook ``f(url) -> (content type, chunks of bytes)``.

    A failure is tried again ``attempts`` times in all, after a pause that doubles; Refused is not. A content that passes
    ``most_bytes`` is given up while it streams. Each row has content or an error, never both.
    """
    names = urls.columns
    at = names.index("url")
    schema = T.StructType([*urls.schema.fields, *T._parse_datatype_string("content binary, content_type string, tries int, error string").fields])

    def one(fetch: Callable, url: str | None) -> tuple:
        if not re.match(r"(?i)https?://[^/\s]+", url or ""):
            return None, None, 0, "no http url"
        for n in range(1, attempts + 1):
            try:
                kind, chunks = fetch(url)
                held, size = [], 0
                for chunk in chunks:
                    size += len(chunk)
                    if size > most_bytes:
                        return None, kind, n, "too large"
                    held.append(chunk)
                return b"".join(held), kind, n, None
            except Refused as e:
                return None, None, n, f"refused: {e}"
            except Exception as e:  # noqa: BLE001 (whatever a client raises is a failed try)
                error = str(e)
                if n < attempts:
                    time.sleep(pause * 2 ** (n - 1))
        return None, None, attempts, f"failed: {error}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch, kinds = make(), [pa.binary(), pa.string(), pa.int32(), pa.string()]
        for batch in batches:
            for k in range(batch.num_rows):  # a row at a time: contents are large
                made = one(fetch, batch.column(at)[k].as_py())
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, *(pa.array([x], t) for x, t in zip(made, kinds))], schema.names)

    return urls.mapInArrow(run, schema)
