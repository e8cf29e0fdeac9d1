"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

The kernel of two strings sums, over all subsequences of three letters that both
have, a decay for the room they take in each, so ``i.d.i.o.t`` and ``idxiot`` stay
close to ``idiot``.  A document is a bag of sentences and a sentence a bag of
strings: its words (long ones in overlapping windows) and its runs of very short
words put together, which catches spaced-out spellings.  Sentences carry the label
of their document, which multiple-instance learning brings to their strings: those
that speak for toxic documents more than chance would are positives, the strings of
clean sentences are negatives, and the SVM works on the negatives that violate its
margin until hardly any does.

How a document's margins become its score is learnt from other labelled documents
than the SVM saw: a logistic curve over its largest margins, over how many
different strings reach each of some margins, and over how many it has.

A kernel with few landmarks is linear in the subsequences, so the trained model
is one weight for each of them (a table of 29 x 29 x 29) and a bias; scoring
gathers those weights for all strings of a batch at once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATOR, bytes_of, slices, text_or_empty, tidily, written
from .shingles import word_hashes

#: Labelled documents that are learnt from at most (those with the smallest hash of doc_id), and of their sentences about how many
#: at most (a pseudo-random choice). Two of three documents are the SVM's, the others the curve's.
SAMPLE, SENTENCES = 9000, 200_000
#: Strings of a sentence at most, where it is cut otherwise.
STRINGS = 40
#: Landmarks of each kind; passes over the negatives, and how many violating ones each adds; evidence that makes a string a
#: positive (log-likelihood ratio, absolute and as a share of the strongest).
LANDMARKS, ROUNDS, HARDER, TELLING, TELLING_SHARE = 128, 3, 6000, 6.0, 0.04
#: Decay of the kernel for each place, letters of a window, its step, and letters of a word that counts as very short.
DECAY, WIDTH, STEP, SHORT = 0.6, 16, 8, 2
#: Letters of the kernel: a-z, then what only takes room, and the beginning of a word; 0 pads.
BLANK, FILLER, BEGIN = 0, 27, 28
SIZE = 29
#: Weight of the SVM's norm against its losses.
RIDGE = 0.03
#: Weight of all positives against that of the negatives.
BALANCE = 0.3
#: Margins of a text that its score looks at, and margins for which it counts the strings that reach them.
TOP, LEVELS = 4, (-0.5, 0.0, 0.5, 1.0)
EVIDENCE = TOP + len(LEVELS) + 1
#: Digits and signs that stand for letters.
_LOOKS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "|": "l"}


def _alphabets() -> tuple[np.ndarray, np.ndarray]:
    """The letter of each ASCII byte, and of each last byte of a two-byte character from U+00C0 on (accents fall off)."""
    plain, latin = np.full(256, FILLER, np.uint8), np.full(256, FILLER, np.uint8)
    for k in range(26):
        plain[0x41 + k] = plain[0x61 + k] = k + 1
    for sign, letter in _LOOKS.items():
        plain[ord(sign)] = ord(letter) - 96
    for k in range(0x80, 0xC0):
        base = unicodedata.normalize("NFKD", chr(0x40 + k).lower())[0]
        latin[k] = ord(base) - 96 if "a" <= base <= "z" else (k % 26) + 1
    return plain, latin


_PLAIN, _LATIN = _alphabets()


def letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letter of each byte, and whether the byte is the last of its character (other bytes are no letters)."""
    after = np.append(data[1:], np.uint8(0))
    last = (after & 0xC0) != 0x80
    before = np.concatenate([np.zeros(1, np.uint8), data[:-1]])
    out = _PLAIN[data]
    wide = data >= 0x80
    if wide.any():
        other = ((data.astype(np.int32) + before * np.int32(7)) % 26 + 1).astype(np.uint8)  # other scripts: any letter, always the same
        first = np.where(wide, np.where(before == 0xC3, _LATIN[data], other), out)
        signs = wide & ((before == 0xC2) | (before == 0x80))  # signs of Latin-1, and quotes and dashes
        out = np.where(signs, np.uint8(FILLER), first)
    return out, last


_TRIPLES = np.array(list(combinations(range(WIDTH), 3)), np.int64)
_WEIGHTS = (DECAY ** (_TRIPLES[:, 2] - _TRIPLES[:, 0] + 1)).astype(np.float32)


def strings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings of all texts as rows of WIDTH letters, and the text each belongs to."""
    return _strings(data, offsets)[:2]


def _strings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Also the byte at which the word of each begins."""
    _, at, before = word_hashes(data, offsets)
    if not len(at):
        return np.zeros((0, WIDTH), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = np.searchsorted(before, np.arange(len(at)), side="right") - 1
    # Letters alone, one for each character of a word, and where each word begins among them.
    letter, last = letters(data)
    held = last & ~SEPARATOR[data]
    count = np.cumsum(held)
    begin = count[at] - held[at]
    end = np.append(begin[1:], count[-1])
    flat = np.concatenate([letter[held], np.zeros(WIDTH + 1, np.uint8)])
    size = end - begin
    for _ in range(3):  # signs after a word are no part of it, unless nothing else is
        size = size - ((size > 1) & (flat[begin + size - 1] == FILLER))
    places = np.arange(WIDTH)
    rows, words = [], []

    def put(starts: np.ndarray, sizes: np.ndarray, word: np.ndarray, lead: bool) -> None:
        block = np.empty((len(starts), WIDTH), np.uint8)
        block[:, 0] = BEGIN
        take = places[: WIDTH - lead]
        part = flat[starts[:, None] + take]
        part[take >= sizes[:, None]] = BLANK
        block[:, int(lead) :] = part
        rows.append(block)
        words.append(word)

    put(begin, size, np.arange(len(begin)), True)
    long_ = np.flatnonzero(size > WIDTH - 1)
    if len(long_):
        more = -(-(size[long_] - WIDTH + 1) // STEP)
        which = np.repeat(long_, more)
        shift = (np.arange(len(which)) - np.repeat(np.cumsum(more) - more, more) + 1) * STEP
        put(begin[which] + shift, size[which] - shift, which, False)
    # Runs of at least three very short words, put together.
    tiny = size <= SHORT
    follows = np.zeros(len(tiny), bool)
    follows[1:] = tiny[1:] & tiny[:-1] & (own[1:] == own[:-1])
    first = np.flatnonzero(tiny & ~follows)
    if len(first):
        broken = np.append(np.flatnonzero(~follows), len(tiny))
        lengths = broken[np.searchsorted(broken, first, side="right")] - first
        blocks, heads = [], []
        for f, n in zip(first[lengths >= 3].tolist(), lengths[lengths >= 3].tolist()):
            glued = np.concatenate([[np.uint8(BEGIN)], *(flat[begin[k] : begin[k] + size[k]] for k in range(f, f + n))])
            for a in range(0, max(1, len(glued) - WIDTH + STEP), STEP):
                block = np.zeros(WIDTH, np.uint8)
                part = glued[a : a + WIDTH]
                block[: len(part)] = part
                blocks.append(block)
                heads.append(f)
        if blocks:
            rows.append(np.array(blocks, np.uint8))
            words.append(np.array(heads, np.int64))
    word = np.concatenate(words)
    return np.concatenate(rows), own[word], at[word]


def sentences(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Of each sentence, the text it is in and its strings, WIDTH bytes each, without those that an earlier one of the text has.

    A sentence ends after a word with ``.``, ``!``, ``?`` or a line break behind its last letter; one of more than STRINGS strings is cut."""
    table, own, place = _strings(data, offsets)
    if not len(table):
        return
    ends = np.concatenate([[0], np.cumsum((data == 0x0A) | np.isin(data, np.frombuffer(b".!?", np.uint8)) & np.append(SEPARATOR[data[1:]], True))])
    _, back = _distinct(table)
    order = np.lexsort((place, own))
    first = np.unique((own * (int(back.max()) + 1) + back)[order], return_index=True)[1]
    order = order[np.sort(first)]
    mark = np.stack([own[order], ends[place[order]]])
    begins = np.flatnonzero(np.append(True, (mark[:, 1:] != mark[:, :-1]).any(0)))
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(order)]):
        for at in range(a, b, STRINGS):
            yield int(own[order[at]]), table[order[at : min(at + STRINGS, b)]].tobytes()


def _distinct(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, and for each row of ``table`` which of them it is."""
    keys = np.ascontiguousarray(table).view(np.uint64).reshape(len(table), 2)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    fresh = np.append(True, (keys[order[1:]] != keys[order[:-1]]).any(1))[: len(order)]
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(fresh) - 1
    return table[order[fresh]], back


def self_kernels(table: np.ndarray) -> np.ndarray:
    """The kernel of each row with itself, by the usual recurrence."""
    s = table.astype(np.int16)
    size = int((s > 0).sum(1).max(initial=0))
    real = (s > 0) & (s != FILLER)
    square = np.float32(DECAY * DECAY)
    equal = (s[:, :size, None] == s[:, None, :size]) & real[:, :size, None]
    prior = np.ones((len(s), size + 1, size + 1), np.float32)
    total = np.zeros(len(s), np.float32)
    for length in range(1, 4):
        step = np.where(equal, square * prior[:, :-1, :-1], np.float32(0))
        if length == 3:
            total = step.sum((1, 2))
            break
        after = np.zeros_like(prior)
        for i in range(size):
            row = np.zeros(len(s), np.float32)
            for j in range(size):
                row = row * DECAY + step[:, i, j]
                after[:, i + 1, j + 1] = after[:, i, j + 1] * DECAY + row
        prior = after
    return total


def _codes(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and place triple, the subsequence's number, and 0 where it isn't one of letters."""
    s = table.astype(np.int32)
    a, b, c = (s[:, _TRIPLES[:, k]] for k in range(3))
    good = (a > 0) & (b > 0) & (c > 0) & (a != FILLER) & (b != FILLER) & (c != FILLER)
    return np.where(good, (a * SIZE + b) * SIZE + c, 0), good


@dataclass
class Model:
    """A weight for each subsequence, a bias, and the curve from a text's evidence to its score."""

    weights: np.ndarray
    bias: float
    slopes: np.ndarray
    shift: float

    def margins(self, table: np.ndarray) -> np.ndarray:
        """Decision values of strings."""
        out = np.full(len(table), self.bias, np.float32)
        size = (table > 0).sum(1)
        order = np.argsort(size, kind="stable")
        order = order[size[order] >= 3]
        for at in range(0, len(order), 2048):
            part = order[at : at + 2048]
            width = int(size[part].max())
            s = table[part, :width].astype(np.int32)
            s[s == FILLER] = 0
            total = np.zeros(len(part), np.float32)
            # Sums of weights over triples, last letter outermost: few long gathers.
            for i in range(width - 2):
                for j in range(i + 1, width - 1):
                    pair = (s[:, i] * SIZE + s[:, j]) * SIZE
                    dead = (s[:, i] == 0) | (s[:, j] == 0)
                    pair[dead] = 0
                    for k in range(j + 1, width):
                        total += np.float32(DECAY ** (k - i + 1)) * self.weights[np.where(dead, 0, pair + s[:, k])]
            norm = np.sqrt(self_kernels(table[part, :width]))
            out[part] += np.where(norm > 0, total / np.maximum(norm, 1e-9), 0)
        return out

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text, the TOP largest margins of its different strings (-1 to 1.5), how many strings exceed each of LEVELS, and how many it has (logarithms)."""
        n = len(offsets) - 1
        out = np.zeros((n, EVIDENCE))
        out[:, :TOP] = -1
        table, own = strings(data, offsets)
        if len(table):
            different, back = _distinct(table)
            key = np.unique(own * len(different) + back)
            own, margin = key // len(different), np.clip(self.margins(different), -1, 1.5)[key % len(different)]
            high = np.flatnonzero(margin > -1)
            order = high[np.lexsort((-margin[high], own[high]))]
            rank = np.arange(len(order)) - np.searchsorted(own[order], own[order])
            held = order[rank < TOP]
            out[own[held], rank[rank < TOP]] = margin[held]
            for k, level in enumerate(LEVELS):
                out[:, TOP + k] = np.log1p(np.bincount(own[margin > level], minlength=n))
            out[:, -1] = np.log1p(np.bincount(own, minlength=n))
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Score of each text, 0 to 1."""
        return 1 / (1 + np.exp(-np.clip(self.evidence(data, offsets) @ self.slopes + self.shift, -30, 30)))


def features(table: np.ndarray, columns: np.ndarray | None = None) -> np.ndarray:
    """Kernel features of strings, normalised: a row of subsequence values for each; of all subsequences, or those of ``columns``."""
    columns = np.arange(SIZE**3) if columns is None else columns
    where = np.zeros(SIZE**3, np.int64)
    where[columns] = np.arange(len(columns)) + 1
    codes, good = _codes(table)
    codes = where[codes]
    values = np.where(good, _WEIGHTS, np.float32(0))
    width = len(columns) + 1
    out = np.bincount((codes + np.arange(len(table))[:, None] * width).ravel(), values.ravel(), width * len(table)).reshape(len(table), width)[:, 1:]
    return (out / np.maximum(np.sqrt(self_kernels(table)), 1e-9)[:, None]).astype(np.float32)


def _against(table: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised kernels of many strings with the landmarks (rows of features)."""
    columns = np.flatnonzero(landmarks.any(0))
    dense = np.ascontiguousarray(landmarks[:, columns].T)
    return np.concatenate([features(table[a : a + 128], columns) @ dense for a in range(0, len(table), 128)] or [np.zeros((0, len(landmarks)), np.float32)])


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton's method; a small ridge on everything but the bias."""
    width = x.shape[1] + 1
    w, ridge = np.zeros(width), RIDGE * np.eye(width)
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        square, pull = ridge.copy(), np.zeros(width)
        for a in range(0, len(x), 2048):  # in parts, for the driver's memory
            part = slice(a, a + 2048)
            z = np.hstack([x[part], np.ones((len(x[part]), 1))]).astype(np.float64)
            inside = y[part] * (z @ w) < 1
            z, c = z[inside], cost[part][inside]
            square += (z * c[:, None]).T @ z
            pull += z.T @ (c * y[part][inside])
        new = np.linalg.solve(square, pull)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def _evidence_for(ones: np.ndarray, zeros: np.ndarray, share: float) -> np.ndarray:
    """Log-likelihood ratio of each string's share of toxic documents against ``share``; 0 where it is not above it."""
    n = ones + zeros
    q = np.clip(ones / np.maximum(n, 1), 1e-9, 1 - 1e-9)
    return np.where(q > share, n * (q * np.log(q / share) + (1 - q) * np.log((1 - q) / (1 - share))), 0.0)


def fit(table: np.ndarray, ones: np.ndarray, zeros: np.ndarray, toxic: int, clean: int) -> Model:
    """A model, its curve not yet fitted, of different strings: in how many toxic and how many clean documents each is, of so many in all."""
    share = (toxic + 1) / (toxic + clean + 2)
    model = Model(np.zeros(SIZE**3, np.float32), -1.0, np.zeros(EVIDENCE), float(np.log(share / (1 - share))))
    if not toxic or not clean or not len(table):
        return model
    whole = (table > 0).sum(1) >= 4
    telling = np.where(whole, _evidence_for(ones, zeros, toxic / (toxic + clean)), 0.0)
    held = np.flatnonzero(telling > max(TELLING, TELLING_SHARE * telling.max(initial=0.0)))
    if not len(held):
        return model
    common = np.flatnonzero(zeros > 0)
    # Landmarks: strings that labels speak for most, and the most frequent of the others.
    marks = np.concatenate([held[np.argsort(-telling[held], kind="stable")[:LANDMARKS]], common[np.argsort(-(zeros * whole)[common], kind="stable")[:LANDMARKS]]])
    phi = np.concatenate([features(table[marks[a : a + 32]]) for a in range(0, len(marks), 32)])
    values, vectors = np.linalg.eigh((phi @ phi.T).astype(np.float64))
    keep = values > 1e-4
    root = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)  # Nyström: features of x are k(x, landmarks) @ root
    few = common[np.argsort(-(zeros * (telling <= TELLING))[common], kind="stable")[:HARDER]]
    x_held, x_few, gain = _against(table[held], phi) @ root, _against(table[few], phi) @ root, np.sqrt(ones[held])
    for turn in range(ROUNDS):
        against = np.sqrt(zeros[few])
        cost = np.concatenate([gain * (BALANCE * max(1.0, against.sum()) / gain.sum()), against])
        w, model.bias = _svm(np.concatenate([x_held, x_few]), np.concatenate([np.ones(len(held)), -np.ones(len(few))]), cost)
        model.weights = (phi.T @ (root @ w)).astype(np.float32)
        model.weights[0] = 0
        if turn == ROUNDS - 1:
            break
        # Of all strings of clean sentences those that violate the margin most join the ones the SVM works on.
        margin = model.margins(table[common])
        worst = np.argsort(-(margin + 1) * np.sqrt(zeros[common]), kind="stable")[:HARDER]
        hard = np.setdiff1d(common[worst[margin[worst] > -1]], few)
        if not len(hard):
            break
        few, x_few = np.concatenate([few, hard]), np.concatenate([x_few, _against(table[hard], phi) @ root])
    return model


def _curve(evidence: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression of the label on the standardised evidence, with a small ridge."""
    mean, spread = evidence.mean(0), evidence.std(0) + 1e-6
    z = np.hstack([(evidence - mean) / spread, np.ones((len(evidence), 1))])
    ridge = np.diag([1.0] * EVIDENCE + [1e-3])
    w = np.zeros(EVIDENCE + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge
        step = np.linalg.solve(h, z.T @ (p - toxic) + ridge @ w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / spread, float(w[-1] - (w[:-1] * mean / spread).sum())


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sentence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2, 1 << 20):
        found = list(sentences(*bytes_of(batch.column(2))))
        for a in range(0, len(found), 10_000):
            own, held = zip(*found[a : a + 10_000])
            take = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(range(a, a + len(own)), pa.int64()), pa.array(held, pa.binary())], ["doc_id", "toxic", "place", "strings"])


def _string_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2, 4 << 20):
        data, offsets = bytes_of(batch.column(2))
        own = np.repeat(np.arange(batch.num_rows), np.diff(offsets) // WIDTH)
        halves = np.frombuffer(data.tobytes(), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", "toxic", "a", "b"])


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_sentences: int = SENTENCES) -> Model:
    """A model of at most ``sample`` labelled rows that are not held out, those with the smallest hash of doc_id, and of about
    ``most_sentences`` of their sentences. The driver sees counts of different strings and the evidence of documents, no text."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    joined = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = written(joined.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("curve", F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(3)) == 0), "toxic-sample")
    number = {(r.curve, r.toxic): r["count"] for r in rows.groupBy("curve", "toxic").count().collect()}
    apart = min(number.get((True, y), 0) for y in (0, 1)) >= 8  # of few documents, all are for both
    learnt = rows.where(~F.col("curve")) if apart else rows
    n = [sum(number.get((c, y), 0) for c in ((False,) if apart else (False, True))) for y in (0, 1)]
    if not all(n):
        return fit(np.zeros((0, WIDTH), np.uint8), np.zeros(0), np.zeros(0), n[1], n[0])
    own = written(learnt.select("doc_id", "toxic", "text").mapInArrow(tidily(_sentence_rows), "doc_id long, toxic int, place long, strings binary"), "toxic-sentences")
    part = min(1.0, most_sentences / max(1, own.count()))
    some = own.where(F.pmod(F.xxhash64("strings", "doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)))
    each = some.select("doc_id", "toxic", "strings").mapInArrow(tidily(_string_rows), "doc_id long, toxic int, a long, b long").distinct()
    counts = each.groupBy("a", "b").agg(F.sum("toxic").alias("ones"), F.sum(1 - F.col("toxic")).alias("zeros")).toArrow().sort_by([("a", "ascending"), ("b", "ascending")])
    table = np.stack([counts.column("a").to_numpy(), counts.column("b").to_numpy()], 1).view(np.uint8).reshape(-1, WIDTH)
    model = fit(table, counts.column("ones").to_numpy(), counts.column("zeros").to_numpy(), n[1], n[0])
    del counts, table
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 1 << 20):
            found = shared.value.evidence(*bytes_of(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(found), pa.list_(pa.float64()))], ["doc_id", "toxic", "evidence"])

    seen = (rows.where("curve") if apart else rows).select("doc_id", "toxic", "text").mapInArrow(tidily(evidence), "doc_id long, toxic int, evidence array<double>").toArrow().sort_by("doc_id")
    model.slopes, model.shift = _curve(np.array(seen.column("evidence").to_pylist()), seen.column("toxic").to_numpy())
    shared.destroy()
    return model


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text in column ``score`` (which replaces one of that name); null counts as empty."""
    from pyspark.sql import types as T

    names = [c for c in docs.columns if c != score]
    shared, at = docs.sparkSession.sparkContext.broadcast(model), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, 1 << 20):
            out = shared.value.scores(*bytes_of(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.float64())], [*names, score])

    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(score, T.DoubleType())])
    return docs.select(*(docs[c] for c in names), text_or_empty(docs, text).alias("__text")).mapInArrow(tidily(run), schema)


#: A document is toxic from this score on.
THRESHOLD = 0.7


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, toxic).

    Labels of held-out rows, and of rows without doc_id, are never looked at; where labels repeat a doc_id the larger counts.
    Of rows that share a labelled doc_id the least text is learnt from. Null counts as empty; an empty text's score is that of
    no evidence. Without labels of both kinds every score is the share of toxic labels, smoothed.
    """
    model = trained(docs, labels)
    # The text goes to Python once and does not come back.
    narrow = docs.select(docs["doc_id"], held_out(docs["doc_id"]).alias("held_out"), text_or_empty(docs).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 1 << 20):
            score = shared.value.scores(*bytes_of(batch.column(2)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return narrow.mapInArrow(tidily(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
