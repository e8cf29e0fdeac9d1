"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers are composed.  The first walks characters and
marks where the pre-tokenizer's matches begin; it has nine states, so the map
of a chunk of text from every entry state to its exit state is nine small
numbers, and the maps of all chunks compose through a parallel prefix scan.
The second walks the bytes of a match; its states (the longest suffix that
begins some token, with the last token and count at each place inside it) are
compiled as they are met, and every transition is annotated with the number of
tokens it adds.  A text's count is the sum of the annotations on its path.
All chunks of a batch, and then all of its different matches, advance side by
side, so a long text costs no more than many short ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Vocabulary, file_name, read_json, shipped
from .common import bytes_of, kept, mix64, slices, text_or_empty, tidily

#: Characters of a chunk.
CHUNK = 512

# Symbols of the splitting transducer: letter, number, other, apostrophe that begins a
# contraction of one or two letters, white space inside a run (also before the end), last
# white space of a run: a blank, or another one.
LETTER, NUMBER, OTHER, SHORT, LONG, INSIDE, BLANK, BREAK = range(8)
# Its states: between matches, in letters, in numbers, in others, after a blank that joins the next
# match, in a white-space run, with one or two letters of a contraction to come.
BETWEEN, LETTERS, NUMBERS, OTHERS, JOINING, SPACES, ONE, TWO = range(8)


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a match begins before the character, by state and symbol."""
    to = np.zeros((8, 8), np.uint8)
    begins = np.zeros((8, 8), bool)
    for state in range(8):
        for symbol in range(8):
            if state in (ONE, TWO):
                to[state, symbol] = BETWEEN if state == ONE else ONE
            elif symbol in (LETTER, NUMBER, OTHER):
                own = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS}[symbol]
                to[state, symbol], begins[state, symbol] = own, state not in (own, JOINING)
            elif symbol in (SHORT, LONG):
                runs_on = state in (OTHERS, JOINING)
                to[state, symbol] = OTHERS if runs_on else ONE if symbol == SHORT else TWO
                begins[state, symbol] = not runs_on
            elif symbol == INSIDE:
                to[state, symbol], begins[state, symbol] = SPACES, state != SPACES
            else:
                to[state, symbol], begins[state, symbol] = JOINING if symbol == BLANK else BETWEEN, True
    return to, begins


SPLIT_TO, SPLIT_BEGINS = _splitter()


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    r"""LETTER, NUMBER, OTHER or INSIDE (white space) of every code point, as \p{L}, \p{N} and \s have them."""
    import regex

    classes = np.full(0x110000, OTHER, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    every = "".join(map(chr, points))
    for pattern, symbol in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", INSIDE)):
        for run in regex.finditer(pattern, every):
            classes[points[run.start()] : points[run.end() - 1] + 1] = symbol
    return classes


def symbols(chars: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The symbol of each character; ``last``: whether its text ends after it."""
    out = character_classes()[chars]
    n = len(chars)
    white = out == INSIDE
    follows = np.zeros(n, bool)  # a character that is not white space follows in the same text
    follows[:-1] = ~white[1:] & ~last[:-1]
    ends = white & follows
    out[ends & (chars == 0x20)] = BLANK
    out[ends & (chars != 0x20)] = BREAK
    for k in np.flatnonzero((chars == 0x27) & ~last):
        a = chars[k + 1]
        if a in (0x73, 0x74, 0x6D, 0x64):  # s t m d
            out[k] = SHORT
        elif not last[k + 1] and (a, chars[k + 2]) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)):  # re ve ll
            out[k] = LONG
    return out


#: Characters after which most chunks have forgotten the state they were entered in.
HEAD = 32


def chunk_maps(held: np.ndarray, anew: np.ndarray) -> np.ndarray:
    """Each chunk's exit state by entry state. ``held``, ``anew``: symbols and text starts, by place and chunk."""
    step = SPLIT_TO.ravel()
    places, chunks = held.shape
    maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (chunks, 8)).copy()
    for at in range(min(HEAD, places)):
        maps[anew[at]] = BETWEEN
        maps = step[maps * 8 + held[at, :, None]]
    open_ = np.flatnonzero((maps != maps[:, :1]).any(1))
    one, many = maps[:, 0].copy(), maps[open_]
    for at in range(HEAD, places):
        one[anew[at]] = BETWEEN
        one = step[one * 8 + held[at]]
        if len(open_):
            many[anew[at, open_]] = BETWEEN
            many = step[many * 8 + held[at, open_, None]]
    maps[:] = one[:, None]
    maps[open_] = many
    return maps


def scanned(maps: np.ndarray) -> np.ndarray:
    """Parallel prefix scan: the maps of the first chunk, the first two, the first three ..."""
    maps, reach = maps.copy(), 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], 1)
        reach *= 2
    return maps


def match_starts(symbol: np.ndarray, first: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where matches begin. ``first``: whether a text begins at the character."""
    n = len(symbol)
    chunks = -(-n // chunk)
    held, anew = np.zeros(chunks * chunk, np.uint8), np.zeros(chunks * chunk, bool)
    held[:n], anew[:n] = symbol, first
    held, anew = (np.ascontiguousarray(x.reshape(chunks, chunk).T) for x in (held, anew))
    state = np.full(chunks, BETWEEN, np.uint8)
    state[1:] = scanned(chunk_maps(held, anew))[:-1, BETWEEN]
    starts = np.empty(held.shape, bool)
    step, begins = SPLIT_TO.ravel(), SPLIT_BEGINS.ravel()
    for at in range(chunk if chunks else 0):
        state[anew[at]] = BETWEEN
        taken = state * 8 + held[at]
        starts[at] = begins[taken]
        state = step[taken]
    return starts.T.ravel()[:n]


BYTES = [bytes((k,)) for k in range(256)]
DEAD = (-1, 0)


class CountTransducer:
    """The byte transducer of one vocabulary, compiled as it is used.

    Transitions are few for a state, so they lie in one open-addressed table, keyed by state and byte.
    """

    #: States kept before everything is compiled anew: about 100 MB.
    MOST = 250_000

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.begins = {token[:k] for token in vocabulary.ids for k in range(1, len(token) + 1)}
        self.clear()

    def clear(self) -> None:
        start = (b"", ((None, 0),))
        self.states: list[tuple[bytes, tuple]] = [start]
        self.known: dict[tuple, int] = {start: 0}
        self.live: dict[bytes, tuple] = {}
        self.used = 0
        self._table(1 << 18)

    def _table(self, size: int) -> None:
        self.keys, self.to, self.adds = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int8)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is or would be."""
        mask = np.int64(len(self.keys) - 1)
        at = ((keys * np.int64(0x9E3779B97F4A7C15 - (1 << 64))) >> np.int64(20)) & mask
        held = self.keys[at]
        lost = np.flatnonzero(held != keys)
        lost = lost[held[lost] >= 0]
        while len(lost):
            at[lost] = (at[lost] + 1) & mask
            held = self.keys[at[lost]]
            lost = lost[(held != keys[lost]) & (held >= 0)]
        return at

    def _put(self, keys: np.ndarray, to: np.ndarray, adds: np.ndarray) -> None:
        """New transitions; none of the keys is there yet."""
        self.used += len(keys)
        if self.used * 4 >= len(self.keys):
            size = len(self.keys)
            while self.used * 4 >= size:
                size *= 2
            held = self.keys >= 0
            keys, to, adds = (np.concatenate(x) for x in ((self.keys[held], keys), (self.to[held], to), (self.adds[held], adds)))
            self._table(size)
        while len(keys):
            at = self._slots(keys)
            _, first = np.unique(at, return_index=True)  # of those that want one place, one gets it now
            self.keys[at[first]], self.to[at[first]], self.adds[at[first]] = keys[first], to[first], adds[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, to, adds = keys[rest], to[rest], adds[rest]

    def _compile(self, missing: list[int]) -> None:
        """Transitions for ``missing``, each a state times 256 and a byte.

        A state is the longest suffix of the match so far that begins a token, and for each place in it from which a
        token may still run on the last token of the encoding up to there and its count, relative to the count here.
        """
        ids, begins, fits, seams = self.v.ids, self.begins, self.v.fits, self.v._seams
        states, known, live_of = self.states, self.known, self.live
        to, adds = [], []
        for key in missing:
            suffix, places = states[key >> 8]
            suffix += BYTES[key & 255]
            while suffix not in begins:
                suffix = suffix[1:]
            for k in range(len(suffix)):
                token = ids.get(suffix[k:])
                if token is not None:
                    before, count = places[k - len(suffix)]
                    if before is None:
                        break
                    if before >= 0:
                        good = seams.get((before, token))
                        if fits(before, token) if good is None else good:
                            break
            count += 1
            n = len(suffix)
            live = live_of.get(suffix)
            if live is None:
                live = live_of[suffix] = tuple(suffix[k:] in begins for k in range(n))
            kept = tuple([(p[0], p[1] - count) if on else DEAD for on, p in zip(live, places[len(places) - n :])])
            state = (suffix, (*kept, (token, 0)))
            number = known.get(state)
            if number is None:
                number = known[state] = len(states)
                states.append(state)
            to.append(number)
            adds.append(count)
        self._put(np.array(missing, np.int64), np.array(to, np.int32), np.array(adds, np.int8))

    def counts(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each match, the bytes begin .. end - 1 of ``data``. All matches advance together."""
        out = np.zeros(len(begin), np.int64)
        order = np.argsort(begin - end, kind="stable")  # the longest first
        at, left = begin[order], (end - begin)[order]
        live = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1 if len(left) else 1), side="right")  # matches that have a byte to go
        total, state = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        if len(self.states) > self.MOST:
            self.clear()
        for step, n in enumerate(live.tolist()):
            if not n:
                break
            taken = state[:n] << 8 | data[at[:n] + step]
            slot = self._slots(taken)
            lost = self.keys[slot] < 0
            if lost.any():
                self._compile(np.unique(taken[lost]).tolist())
                slot = self._slots(taken)
            total[:n] += self.adds[slot]
            state[:n] = self.to[slot]
        out[order] = total
        return out


#: Masks of the first bytes of eight.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def different(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which matches stand for all, and for each match its stand-in. Matches of up to 16 bytes are compared as they are,
    longer ones by a digest of 128 bits."""
    size = end - begin
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    low = eight[begin] & KEEP[np.minimum(size, 8)]
    high = eight[begin + 8 * (size > 8)] & KEEP[np.clip(size - 8, 0, 8)]
    for k in np.flatnonzero(size > 16).tolist():
        low[k], high[k] = np.frombuffer(hashlib.blake2b(data[begin[k] : end[k]].tobytes(), digest_size=16).digest(), "<u8")
    mixed = mix64(low ^ mix64(high + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, first, back = np.unique(mixed, return_index=True, return_inverse=True)
    stand = first[back]
    odd = np.flatnonzero((low != low[stand]) | (high != high[stand]) | (size != size[stand]))
    if len(odd):  # they share a mixed value by chance: each for itself
        back[odd] = len(first) + np.arange(len(odd))
        first = np.concatenate([first, odd])
    return first, back


def count_tokens(transducer: CountTransducer, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens of each text. ``data``: the UTF-8 bytes of all texts; ``offsets``: where each begins, and the end."""
    rows = len(offsets) - 1
    counts = np.zeros(rows, np.int64)
    owner, bounds = np.arange(rows), np.stack([offsets[:-1], offsets[1:]], 1)
    if special := transducer.v.special:
        raw = data.tobytes()
        pattern = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(special, key=len, reverse=True)))
        pieces, owners, at = [], [], 0
        for row, (a, b) in enumerate(bounds.tolist() if pattern.search(raw) else []):
            at = a
            for found in pattern.finditer(raw, a, b):
                pieces.append((at, found.start()))
                owners.append(row)
                counts[row] += 1
                at = found.end()
            pieces.append((at, b))
            owners.append(row)
        if counts.any():
            data = np.concatenate([data[a:b] for a, b in pieces])
            owner, bounds = np.array(owners), np.array(pieces)
    sizes = bounds[:, 1] - bounds[:, 0]
    owner, sizes = owner[sizes > 0], sizes[sizes > 0]
    if not len(sizes):
        return counts
    begin = np.cumsum(sizes) - sizes
    leads = (data & 0xC0) != 0x80  # bytes that begin a character
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    place = np.flatnonzero(leads)
    first_byte = np.zeros(len(data), bool)
    first_byte[begin] = True
    first = first_byte[place]
    last = np.append(first[1:], True)
    match = place[np.flatnonzero(match_starts(symbols(chars, last), first))]
    ends = np.append(match[1:], len(data))
    which, back = different(data, match, ends)
    tokens = transducer.counts(data, match[which], ends[which])[back]
    sums = np.concatenate([[0], np.cumsum(tokens)])
    cut = np.searchsorted(match, np.append(begin, len(data)))
    counts += np.bincount(owner, np.diff(sums[cut]), rows).astype(np.int64)
    return counts


def token_counts(df: DataFrame, path: str, text: str = "text", count: str = "n_tokens", keep_text: bool = False) -> DataFrame:
    """``df`` with the token count of every whole text in column ``count``, which replaces one of that name.

    ``path``: a byte-level BPE in the JSON format of the ``tokenizers`` library; it is read on the driver and
    sent along. Null counts as empty, an empty text has no tokens, special strings inside texts are one token
    each, nothing is added or cut off. Rows, other columns and their order stay as they are; the text itself comes
    back only with ``keep_text``.
    """
    held, name = shipped(df.sparkSession, read_json(path)), file_name(path)
    keep = [c for c in df.columns if c != count and (keep_text or c != text)]
    at = len(keep)
    wide = df.select(*(df[c] for c in keep), text_or_empty(df, text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = kept(name, lambda: CountTransducer(held.value))  # it takes a hundred megabytes
        for batch in slices(batches, at, 1 << 20):
            n = count_tokens(machine, *bytes_of(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(n, pa.int64())], [*keep, count])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(count, T.LongType())])
    return wide.mapInArrow(tidily(run, keeps=True), schema)


def counted(df: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, UTF-8 bytes, tokens, and whether there are more than ``limit`` tokens, of every text of ``df``."""
    narrow = df.select("doc_id", text_or_empty(df).alias("text"))
    out = token_counts(narrow.withColumn("n_bytes", F.octet_length("text").cast("long")), path)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
