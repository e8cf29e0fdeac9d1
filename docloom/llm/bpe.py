"""Byte-pair vocabularies: which adjacent tokens can stand together in an encoding.

A sequence of tokens is the BPE encoding of its bytes exactly if every adjacent
pair is; a pair is if undoing its merges, latest first, never meets a merge
across the seam that would have come earlier.  Both the count transducer and
the Aho-Corasick encoder rest on that test.
"""

from __future__ import annotations

import base64
import json
import os
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import SparkSession


@dataclass
class Vocabulary:
    """``ids``: token bytes to id. ``merge``: pair of ids to (priority, id).
    ``parts``: id to the pair it was last merged from; a single byte has none.
    ``special``: strings that are one token wherever they stand."""

    ids: dict[bytes, int]
    merge: dict[tuple[int, int], tuple[int, int]]
    parts: dict[int, tuple[int, int, int]]
    special: dict[str, int] = field(default_factory=dict)
    _seams: dict[tuple[int, int], bool] = field(default_factory=dict)

    #: Entries kept in the memo of seams before it starts anew.
    MEMO = 1 << 20

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` side by side."""
        known = self._seams.get((left, right))
        if known is None:
            if len(self._seams) >= self.MEMO:
                self._seams.clear()
            known = self._seams[left, right] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        merge, parts = self.merge, self.parts
        before = None  # a merge across the seam counts only if it comes before this priority
        while True:
            across = merge.get((left, right))
            if across is not None and (before is None or across[0] < before):
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                before, left = a[0], a[2]
            else:  # of equal priorities the leftmost goes first, so a tie across the seam wins
                before, right = b[0] + 1, b[1]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_seams": {}}


def merged(pieces: list[int], merge: dict[tuple[int, int], tuple[int, int]], below: int | None = None) -> list[int]:
    """Plain BPE: the earliest merge first, leftmost of equals, only those before ``below``."""
    pieces = list(pieces)
    while len(pieces) > 1:
        best = min(((m[0], k) for k, pair in enumerate(zip(pieces, pieces[1:])) if (m := merge.get(pair))), default=None)
        if best is None or (below is not None and best[0] >= below):
            break
        k = best[1]
        pieces[k : k + 2] = [merge[pieces[k], pieces[k + 1]][1]]
    return pieces


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies in JSON use for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def read_json(path: str) -> Vocabulary:
    """A byte-level BPE of the ``tokenizers`` library: only listed pairs merge, in their order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    letters = byte_letters()
    as_bytes = lambda s: bytes(letters[c] for c in s)
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ids = {as_bytes(s): k for s, k in model["model"]["vocab"].items() if s not in special}
    merge, parts = {}, {}
    for order, pair in enumerate(model["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        a, b = ids[as_bytes(a)], ids[as_bytes(b)]
        whole = ids[as_bytes(pair[0]) + as_bytes(pair[1])] if not isinstance(pair, str) else ids[as_bytes(pair.replace(" ", ""))]
        merge[a, b] = (order, whole)
        parts.setdefault(whole, (order, a, b))
    return _reachable(Vocabulary(ids, merge, parts, special))


@lru_cache(maxsize=4)
def read_ranks(path: str) -> Vocabulary:
    """Ranks as of ``tiktoken``: any two tokens merge whose bytes together have a rank."""
    with open(path, "rb") as f:
        ids = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    merge: dict[tuple[int, int], tuple[int, int]] = {}
    for token, rank in ids.items():
        for cut in range(1, len(token)):
            a, b = ids.get(token[:cut]), ids.get(token[cut:])
            if a is not None and b is not None:
                merge[a, b] = (rank, rank)
    parts = {}
    for token, rank in ids.items():
        if len(token) > 1:
            last = merged([ids[token[k : k + 1]] for k in range(len(token))], merge, rank)
            if len(last) == 2 and merge.get(tuple(last), (None, None))[1] == rank:
                parts[rank] = (rank, *last)
    return _reachable(Vocabulary(ids, merge, parts))


def _reachable(v: Vocabulary) -> Vocabulary:
    """Without tokens that no merge makes: BPE never emits them."""
    v.ids = {token: k for token, k in v.ids.items() if len(token) == 1 or k in v.parts}
    return v


def file_name(path: str) -> tuple[str, int, int]:
    """What tells a vocabulary file from others and from its earlier contents, so that a worker keeps what it made of it."""
    found = os.stat(path)
    return path, found.st_size, found.st_mtime_ns


def shipped(spark: SparkSession, v: Vocabulary):
    """``v`` as a broadcast; its size is that of the vocabulary file, whatever the corpus."""
    return spark.sparkContext.broadcast(v)
