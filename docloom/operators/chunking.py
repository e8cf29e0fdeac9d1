"""Chunks of documents: by sections and sentences, by sentences, or by characters, with ids and quality."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text

#: Where sections begin, from the coarsest to the finest.
SECTIONS = (r"\n(?=[0-9]+\. +[A-Z])", r"\n(?=[A-Z][A-Z ]{5,}\n)", r"\n\s*\n")
STRATEGIES = ("recursive", "sentence", "fixed")


def _pieces(start: int, body: str, most: int, level: int) -> Iterator[tuple[int, str]]:
    """Sections of at most ``most`` characters where the patterns allow, with their true offsets."""
    if len(body) <= most or level == len(SECTIONS):
        yield start, body
        return
    at = 0
    for cut in [*(m.start() for m in re.finditer(SECTIONS[level], body)), len(body)]:
        if cut > at:
            yield from _pieces(start + at, body[at:cut], most, level + 1)
        at = cut


def _sentences(start: int, body: str, most: int, least: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans of whole sentences of up to ``most`` words; what has fewer than ``least`` goes."""
    spans = [(m.start(), m.end(), len(re.findall(r"\b\w+\b", m.group()))) for m in re.finditer(r"[^.!?]+(?:[.!?]+|\Z)", body)]
    held: list[tuple[int, int, int]] = []
    for span in spans:
        if held and sum(s[2] for s in held) + span[2] > most:
            if sum(s[2] for s in held) >= least:
                yield start + held[0][0], start + held[-1][1]
            tail: list[tuple[int, int, int]] = []
            for s in reversed(held):
                if sum(x[2] for x in tail) + s[2] > overlap:
                    break
                tail.insert(0, s)
            held = tail
        held.append(span)
    if held and sum(s[2] for s in held) >= least:
        yield start + held[0][0], start + held[-1][1]


def recursive_chunks(docs: DataFrame, *, characters: int = 1000, most: int = 256, least: int = 100, overlap: int = 30) -> DataFrame:
    """doc_id, chunk_index, start_char, end_char and content: sections as chunks if they have ``least`` to ``most`` words, sentences
    of the larger ones packed. Offsets are true places in the text, and indexes run through the whole document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans: list[tuple[int, int]] = []
                for start, piece in _pieces(0, body, characters, 0):
                    n = len(re.findall(r"\b\w+\b", piece))
                    if least <= n <= most:
                        spans.append((start, start + len(piece)))
                    elif n > most:
                        spans += _sentences(start, piece, most, least, overlap)
                rows += [(doc_id, k, a, b, body[a:b].strip()) for k, (a, b) in enumerate(spans)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["doc_id", "chunk_index", "start_char", "end_char", "content"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).mapInArrow(run, "doc_id long, chunk_index int, start_char int, end_char int, content string")


def chunk_documents(docs: DataFrame, strategy: str = "recursive", *, ocr: bool = False, distinct: bool = True) -> DataFrame:
    """Chunks by ``strategy`` (an unknown one is recursive) with chunk_id, tokens, quality and suspicious; of chunks of a document
    with one chunk_id the first stays. ``ocr`` puts misreadings right first; it changes every 0 and 1, so it is off."""
    if ocr:
        docs = docs.withColumn("text", text.ocr_clean(F.col("text")))
    if strategy == "sentence":
        rows = docs.select("doc_id", F.explode(text.sentence_chunks(F.coalesce("text", F.lit("")))).alias("x")).select("doc_id", "x.chunk_index", "x.content")
    elif strategy == "fixed":
        rows = docs.select("doc_id", F.explode(text.fixed_chunks(F.coalesce("text", F.lit("")))).alias("x")).select("doc_id", "x.chunk_index", "x.content")
    else:
        rows = recursive_chunks(docs).select("doc_id", "chunk_index", "content")
    rows = rows.withColumn("chunk_id", text.chunk_id(F.col("content")))
    if distinct:
        w = Window.partitionBy("doc_id", "chunk_id").orderBy("chunk_index")
        rows = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    q = text.quality(F.col("content"))
    return rows.withColumn("tokens", text.token_count(F.col("content"))).withColumn("q", q).select("doc_id", "chunk_index", "content", "chunk_id", "tokens", F.round("q.score", 6).alias("quality"), "q.suspicious")
