r"""Word shingles as 64-bit hashes, for whole Arrow columns at once.

A-Z are lower-cased, words are ``[^\x20\x09-\x0D]+``, a shingle is five words in
a row; a text of fewer words has its whole sequence as its one shingle, one
without words has none.  Two different shingles share a hash with a chance of
2**-64; hashes are only compared within pairs of texts that are candidates.
"""

from __future__ import annotations

import hashlib

import numpy as np

from .common import LOWER, SEPARATOR, mix64

WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: each word's hash, the place of its first byte, and the number of words before each text (and in all)."""
    word = ~SEPARATOR[data]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[begins] = word[begins]
    at = np.flatnonzero(starts)
    before = np.searchsorted(at, offsets)
    if not len(at):
        return np.zeros(0, np.uint64), at, before
    place = np.arange(len(data))
    place[at[0] :] -= np.repeat(at, np.diff(np.append(at, len(data))))
    most = int(place[word].max()) + 1
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, _BASE)]).astype(np.uint64))
    values = np.where(word, LOWER[data].astype(np.uint64) + np.uint64(1), np.uint64(0)) * powers[np.minimum(place, most)]
    sizes = np.add.reduceat(word.astype(np.int64), at).astype(np.uint64)
    return mix64(np.add.reduceat(values, at) + sizes * _STEPS[0]), at, before


def shingle_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: the hash of each shingle in order of place, the number of shingles before each text (and in all),
    and word places and counts as ``word_hashes`` gives them."""
    words, at, before = word_hashes(data, offsets)
    n = np.diff(before)
    counts = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(counts)])
    own = np.repeat(np.arange(len(n)), counts)
    place = before[own] + np.arange(len(own)) - first[own]
    hashes = np.zeros(len(own), np.uint64)
    size = np.minimum(n[own], WORDS).astype(np.int64)
    for k in range(WORDS):
        held = np.flatnonzero(size > k)
        hashes[held] += words[place[held] + k] * _STEPS[k]
    return mix64(hashes + size.astype(np.uint64)), first, at, before


def sets_of(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text in ascending order, one text after the other, and where each text's begin."""
    out, sizes = [], np.zeros(len(first), np.int64)
    for k in range(len(first) - 1):
        own = np.sort(hashes[first[k] : first[k + 1]])
        fresh = np.ones(len(own), bool)
        np.not_equal(own[1:], own[:-1], out=fresh[1:])
        own = own if fresh.all() else own[fresh]
        out.append(own)
        sizes[k + 1] = len(own)
    return np.concatenate(out) if out else hashes, np.cumsum(sizes)


def signature(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingles."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
