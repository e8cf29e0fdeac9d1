"""Byte-level BPE, encoded and decoded.

A pre-tokenizer match is laid out as Latin-1, one character a byte, so that an
Aho-Corasick automaton over the vocabulary finds every token at every place in
one pass.  The encoder goes from left to right with the longest token, accepts
it only if it fits after the one before (a memoised test of adjacent tokens),
and backs up when none fits; places found hopeless are never entered again, so
the work is linear in the bytes.  The result is the one that merging by rank
gives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import Vocabulary, file_name, read_ranks, shipped
from .common import slices, text_or_empty, tidily


class Codec:
    """Encodes and decodes texts by one vocabulary."""

    #: Encoded matches kept in each of two generations of the memo; longer matches than LONGEST are not kept.
    MEMO, LONGEST = 150_000, 48

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.v, self.pattern = vocabulary, regex.compile(pattern)
        self.size = {k: len(token) for token, k in vocabulary.ids.items()}
        self.token = {str(k): token for token, k in vocabulary.ids.items()}
        self.tokens = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, k in vocabulary.ids.items():
            self.tokens.add_word(token.decode("latin-1"), k)
        self.tokens.make_automaton()
        self.memo: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def encode_match(self, data: bytes) -> list[int]:
        """The ids of one pre-tokenizer match."""
        whole = self.v.ids.get(data)
        if whole is not None:
            return [whole]
        n, size, v = len(data), self.size, self.v
        seams = v._seams  # looked up in place: this is the inner loop
        at: list[list[int]] = [[] for _ in range(n)]  # tokens by the place they begin, shortest first
        for end, k in self.tokens.iter(data.decode("latin-1")):
            at[end + 1 - size[k]].append(k)
        out: list[int] = []
        untried = [at[0]]  # for each accepted token and the next: what else may stand there
        hopeless: set[int] = set()
        place, left = 0, -1
        while place < n:
            choices = untried[-1]
            while choices:
                k = choices.pop()
                to = place + size[k]
                if to not in hopeless:
                    if left >= 0:
                        good = seams.get((left, k))
                        if not (v.fits(left, k) if good is None else good):
                            continue
                    out.append(k)
                    place, left = to, k
                    if place < n:
                        untried.append(list(at[place]))
                    break
            else:
                hopeless.add(place)
                untried.pop()
                place -= size[out.pop()]
                left = out[-1] if out else -1
        return out

    def encode(self, text: str) -> str:
        """All ids of a text in decimal, joined by commas."""
        memo, out = self.memo, []
        for match in self.pattern.findall(text):
            ids = memo.get(match)
            if ids is None:
                ids = self.older.get(match) or ",".join(map(str, self.encode_match(match.encode())))
                if len(match) <= self.LONGEST:
                    if len(memo) >= self.MEMO:
                        self.older, self.memo = memo, {}
                        memo = self.memo
                    memo[match] = ids
            out.append(ids)
        return ",".join(out)

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.split(","))) if ids else b""


_codec: dict[object, Codec] = {}


def encoded(df: DataFrame, path: str, pattern: str, *, text: str = "text", ids: bool = False) -> DataFrame:
    """``df`` without ``text`` but with n_tokens, ids_sha256 and decoded_sha256 of every whole text; with ``ids`` also the
    ids (an array of ints) and the decoded bytes.

    ``path``: a file of ranks as tiktoken reads it, read on the driver and sent along; ``pattern`` splits texts first.
    Null counts as empty; an empty text has no ids. Special strings are ordinary text. Columns of ``df`` with the
    names of the new ones are replaced.
    """
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids:
        added += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    names = [f.name for f in added]
    keep = [c for c in df.columns if c != text and c not in names]
    held, name, at = shipped(df.sparkSession, read_ranks(path)), file_name(path), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec.get((name, pattern))
        if codec is None:
            _codec.clear()
            codec = _codec[name, pattern] = Codec(held.value, pattern)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in slices(batches, at):
            rows = []
            for one in batch.column(at).to_pylist():
                coded = codec.encode(one)
                decoded = codec.decode(coded)
                row = [coded.count(",") + 1 if coded else 0, sha(coded.encode()), sha(decoded)]
                rows.append([*row, [int(k) for k in coded.split(",")] if coded else [], decoded] if ids else row)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()]
            new = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *new], [*keep, *names])

    return df.select(*(df[c] for c in keep), text_or_empty(df, text).alias("__text")).mapInArrow(tidily(run), T.StructType([*(df.schema[c] for c in keep), *added]))
