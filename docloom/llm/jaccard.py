"""Documents linked by the Jaccard similarity of their word shingles, and their components.

Filtering by prefixes under several global orders of shingles.  If two sets
overlap in at least ``a`` members, the first ``n - a + 1`` members of each, under
any order that both share, have one in common, and the first ``n - a + l`` have
``l``.  That is used three times:

1. Under the order of hashes each set shows the first quarter of its members.
   Sets of which too few of these are in any other set are linked with nothing.
2. Of the others all members are counted. In every further order the members
   that no other set has come first, so a set's prefix in it is short, or empty
   if the set can't be linked: by document frequency, by frequency with ties in
   another order, and by hash alone.
3. Pairs meet in a bucket of the first order and must share prefix members in
   the others too before their members are compared.

Buckets are not paired off in full.  Each set is first compared with one pivot,
the one that it meets most often, in two rounds; sets that are connected by then
need no comparison.  What remains are pairs of one bucket in different
components; all of them are compared.  Equal sets are one set throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, mix64, slices, text_or_empty, tidily, written
from .components import components
from .shingles import sets_of, shingle_rows, signature

#: Linked when PERCENT_OF * intersection >= PERCENT * union.
PERCENT, PERCENT_OF = 80, 100
#: Frequencies from here on are ordered as one.
FREQUENT = 1024


def overlap(n: np.ndarray) -> np.ndarray:
    """The least overlap of a set of ``n`` members with any set it is linked with."""
    return -(-n * PERCENT // PERCENT_OF)


def _more(n: np.ndarray) -> np.ndarray:
    """Common members that the first filter asks of a set of ``n``; grows with ``n``."""
    return 1 + n // 16


def shown(n: np.ndarray) -> np.ndarray:
    """Length of the prefix of the first filter."""
    return np.minimum(n, n - overlap(n) + _more(n))


def needed(n: np.ndarray) -> np.ndarray:
    """How many members of that prefix must be shown by another set: as many as the smallest partner asks."""
    return _more(overlap(n))


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, mark, n, sig, sid, and the shown members: how many others of the batch have (shared), which of those this set
    stands for (known), which it alone has (fresh). A set that this task has met before shows nothing."""
    seen: set[int] = set()
    for batch in slices(batches, 2, 4 << 20):
        data, offsets = bytes_of(batch.column(2))
        hashes, first = sets_of(*shingle_rows(data, offsets)[:2])
        n = np.diff(first)
        sigs = [signature(hashes[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        sids = np.array([int.from_bytes(s[:8], "little", signed=True) for s in sigs], np.int64)
        own = []
        for k, sid in enumerate(sids.tolist()):
            if n[k] and sid not in seen:
                seen.add(sid)
                own.append(k)
        own = np.array(own, np.int64)
        take = shown(n[own])
        row = np.repeat(own, take)
        token = hashes[np.repeat(first[own], take) + np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)]
        order = np.argsort(token, kind="stable")
        ordered = token[order]
        begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
        many = np.repeat(np.diff(np.append(begins, len(ordered))) > 1, np.diff(np.append(begins, len(ordered))))
        leads = np.zeros(len(ordered), bool)
        leads[begins] = True
        shared, lead = np.zeros(len(token), bool), np.zeros(len(token), bool)
        shared[order], lead[order] = many, leads
        count = np.bincount(row[shared], minlength=len(n))

        def lists(held: np.ndarray) -> pa.Array:
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[held], minlength=len(n)))])  # noqa: B023
            flat = token[held].astype("<u8").tobytes()  # noqa: B023
            return pa.array([flat[8 * a : 8 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())

        columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), pa.array(sids), pa.array(count, pa.int64()), lists(shared & lead), lists(~shared)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "n", "sig", "sid", "shared", "known", "fresh"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each known or fresh member."""
    for batch in batches:
        sid = batch.column(0).to_numpy()
        for column, known in ((batch.column(1), True), (batch.column(2), False)):
            data, offsets = bytes_of(column)
            token = np.frombuffer(data.tobytes(), "<i8")
            if len(token):
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(sid, np.diff(offsets) // 8)), pa.array(np.full(len(token), known))], ["token", "sid", "known"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of token and sid: how many members of each set another set shows too, beyond the known ones."""
    held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
    last_shared = False  # whether the token of the held rows is known to be shared already
    def emit(token, sid, known, first_shared):
        if not len(token):
            return None
        begins = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        sizes = np.diff(np.append(begins, len(token)))
        several = (sid[begins] != sid[begins + sizes - 1]) | np.logical_or.reduceat(known, begins)
        several[0] |= first_shared
        counted = np.repeat(several, sizes) & ~known
        counted[1:] &= ~((token[1:] == token[:-1]) & (sid[1:] == sid[:-1]))
        ids, n = np.unique(sid[counted], return_counts=True)
        return several[-1], pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], ["sid", "n"])

    for batch in batches:
        token, sid, known = (np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns))
        if not len(token):
            continue
        cut = int(np.searchsorted(token, token[-1], side="left"))
        first = last_shared
        if cut:
            yield emit(token[:cut], sid[:cut], known[:cut], first)[1]
            first = False
        token, sid, known = token[cut:], sid[cut:], known[cut:]
        if first or sid[0] != sid[-1] or known.any():  # a frequent one: let its rows go
            yield emit(token, sid, known, first)[1]
            held, last_shared = [token[-1:], sid[-1:], np.ones(1, bool)], True
        else:
            held, last_shared = [token[:1], sid[:1], known[:1]], False
    if (out := emit(*held, last_shared)) is not None:
        yield out[1]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All members of the sets that are left, from their texts."""
    for batch in slices(batches, 2, 1 << 20):
        data, offsets = bytes_of(batch.column(2))
        hashes, first = sets_of(*shingle_rows(data, offsets)[:2])
        sid, sigs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        own = [k for k, s in enumerate(sigs) if signature(hashes[first[k] : first[k + 1]]) == s]
        n = np.diff(first)[own]
        token = np.concatenate([hashes[first[k] : first[k + 1]] for k in own] or [hashes[:0]]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(sid[own], n)), pa.array(np.repeat(n, n).astype(np.int64))], ["token", "sid", "n"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of token and sid, those of tokens in several sets, with the number of sets up to FREQUENT."""
    held = [np.zeros(0, np.int64)] * 3
    running = 0  # sets of the held token that have gone out already
    def out(token, sid, n, before, whole):
        fresh = np.append(True, (token[1:] != token[:-1]) | (sid[1:] != sid[:-1]))
        token, sid, n = token[fresh], sid[fresh], n[fresh]
        begins = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        sizes = np.diff(np.append(begins, len(token)))
        df = sizes.copy()
        df[0] += before
        df = np.repeat(np.minimum(df, FREQUENT), sizes)
        keep = df > 1
        return pa.RecordBatch.from_arrays([pa.array(sid[keep]), pa.array(n[keep]), pa.array(df[keep].astype(np.int32)), pa.array(token[keep])], ["sid", "n", "df", "token"])

    for batch in batches:
        token, sid, n = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns))
        if not len(token):
            continue
        cut = int(np.searchsorted(token, token[-1], side="left"))
        if cut:
            yield out(token[:cut], sid[:cut], n[:cut], running, True)
            running = 0
        token, sid, n = token[cut:], sid[cut:], n[cut:]
        fresh = np.append(True, sid[1:] != sid[:-1])
        token, sid, n = token[fresh], sid[fresh], n[fresh]
        if running >= FREQUENT or len(token) > FREQUENT:  # its frequency is settled: let all but the last row go
            yield out(token[:-1], sid[:-1], n[:-1], max(running, FREQUENT), False) if len(token) > 1 else out(token[:0], sid[:0], n[:0], 0, False)
            running = max(running, FREQUENT)
            token, sid, n = token[-1:], sid[-1:], n[-1:]
        held = [token, sid, n]
    if len(held[0]):
        yield out(*held, running, True)


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of sid, df and token: each set's shared members and its prefixes in three orders."""
    names = ["sid", "n", "m", "weight", "tokens", "first", "second", "third"]
    held = None

    def sets(table, whole):
        sid, n, df, token = table
        begins = np.flatnonzero(np.append(True, sid[1:] != sid[:-1]))
        ends = np.append(begins[1:], len(sid))
        if not whole:
            begins, ends = begins[:-1], ends[:-1]
        rows = []
        for a, b in zip(begins.tolist(), ends.tolist()):
            size = int(n[a])
            prefix = (b - a) - int(overlap(size)) + 1
            if prefix < 1:
                continue
            t, f = token[a:b].view(np.uint64), df[a:b]
            other, third = mix64(t ^ np.uint64(0x5851F42D4C957F2D)), mix64(t ^ np.uint64(0x14057B7EF767814F))
            pick = lambda order: np.sort(t[order[:prefix]]).tobytes()  # noqa: B023, E731
            rows.append((int(sid[a]), size, b - a, (int(f.sum()) + size - (b - a)) / size, np.sort(t).tobytes(), t[:prefix].tobytes(), pick(np.lexsort((other, f))), pick(np.argsort(third))))
        at = int(ends[-1]) if len(ends) else 0
        return rows, [x[at:] for x in table]

    def batch_of(rows):
        kinds = [*[pa.int64()] * 3, pa.float64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        table = [c.to_numpy() for c in batch.columns]
        table = [np.concatenate([h, c]) for h, c in zip(held, table)] if held is not None else table
        if not len(table[0]):
            continue
        rows, held = sets(table, False)
        if rows:
            yield batch_of(rows)
    if held is not None and len(held[0]):
        rows, _ = sets(held, True)
        if rows:
            yield batch_of(rows)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = bytes_of(batch.column(4))
        size = np.diff(offsets) // 8
        sid, n, m, weight = (np.repeat(batch.column(k).to_numpy(), size) for k in range(4))
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data.tobytes(), "<i8")), pa.array(sid), pa.array(n), pa.array(m), pa.array(weight)], ["token", "sid", "n", "m", "weight"])


def _openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each member of a set's first prefix, with those that stand before it."""
    for batch in batches:
        for sid, n, m, prefix in zip(*(c.to_pylist() for c in batch.columns)):
            tokens = np.frombuffer(prefix, "<i8")
            size = len(tokens)
            ends = np.cumsum(np.arange(size))
            before = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(np.concatenate([tokens[:k] for k in range(size)] or [tokens])))
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.full(size, sid)), pa.array(np.full(size, n)), pa.array(np.full(size, m)), before], ["token", "sid", "n", "m", "before"])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of candidate pairs with both sets those that are linked; prefixes must meet in every order."""
    for batch in batches:
        get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
        a, b, na, nb = (get(x).to_numpy() for x in ("a", "b", "n_a", "n_b"))
        views = {x: bytes_of(get(x)) for x in ("tokens_a", "tokens_b", "second_a", "second_b", "third_a", "third_b")}
        row = lambda name, k: np.frombuffer(views[name][0][views[name][1][k] : views[name][1][k + 1]].tobytes(), "<u8")  # noqa: B023, E731
        keep = []
        for k in range(batch.num_rows):
            if PERCENT_OF * min(na[k], nb[k]) < PERCENT * max(na[k], nb[k]):
                continue
            if not _common(row("second_a", k), row("second_b", k)) or not _common(row("third_a", k), row("third_b", k)):
                continue
            both = _common(row("tokens_a", k), row("tokens_b", k))
            if PERCENT_OF * both >= PERCENT * (int(na[k]) + int(nb[k]) - both):
                keep.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda x: sets.select(F.col("sid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "tokens", "second", "third")))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(tidily(_verified), "a long, b long")


def _survivors(first: DataFrame) -> DataFrame:
    """sid and the number of shown members that other sets show too, of the sets of the first pass."""
    rows = first.where("octet_length(known) + octet_length(fresh) > 0").select("sid", "known", "fresh")
    tokens = rows.mapInArrow(tidily(_tokens), "token long, sid long, known boolean")
    met = tokens.repartition("token").sortWithinPartitions("token", "sid").mapInArrow(tidily(_shared), "sid long, n long")
    local = first.where("shared > 0").select("sid", F.col("shared").alias("n"))
    return met.unionByName(local).groupBy("sid").agg(F.sum("n").alias("shared"))


def _may_link(n_a: F.Column, m_a: F.Column, n_b: F.Column, m_b: F.Column) -> F.Column:
    """Whether sets of these sizes can overlap enough with the members that they share with any other set."""
    sizes = F.least(n_a, n_b) * PERCENT_OF >= F.greatest(n_a, n_b) * PERCENT
    return sizes & (F.least(m_a, m_b) * (PERCENT_OF + PERCENT) >= (n_a + n_b) * PERCENT)


def _roots(sets: DataFrame) -> DataFrame:
    """node and root of all sets that are linked with another. ``sets``: a written table of _ordered."""
    postings = written(sets.select("sid", "n", "m", "weight", "first").mapInArrow(tidily(_postings), "token long, sid long, n long, m long, weight double"), "near-postings")
    # Pivots: the set of a bucket whose members are the most frequent, as those of an original among its near copies are, and
    # then the one that shares the largest part of its members.
    own = ("sid", "n", "m", "root")
    pivots = [F.max(F.struct("weight", *own)), F.max(F.struct((F.col("m") / F.col("n")).alias("share"), *own)), None]
    links, roots = None, None
    for pivot in pivots:
        if roots is None:
            now = postings.withColumn("root", F.col("sid"))
        else:
            now = postings.join(roots, postings["sid"] == roots["node"], "left").select("token", "sid", "n", "m", "weight", F.coalesce("root", "sid").alias("root"))
        open_ = now.groupBy("token").agg(F.min("root").alias("least"), F.max("root").alias("most"), *([] if pivot is None else [pivot.alias("p")])).where("least <> most")
        if pivot is not None:
            may = (F.col("root") != F.col("p.root")) & _may_link(F.col("n"), F.col("m"), F.col("p.n"), F.col("p.m"))
            met = now.join(open_.select("token", "p"), "token").where(may).groupBy(F.col("sid").alias("a"), F.col("p.sid").alias("b")).count()
            best = met.groupBy("a").agg(F.max(F.struct("count", -F.col("b"), "b")).alias("best"))
            pairs = best.select("a", F.col("best.b").alias("b"))
        else:
            # A pair is taken at the first member that its prefixes share, so it comes up once.
            busy = now.join(open_.select("token"), "token", "left_semi").groupBy("sid", "root").agg(F.count("*").alias("open")).select("sid", "root")
            opened = sets.join(busy, "sid", "left_semi").select("sid", "n", "m", "first").mapInArrow(tidily(_openings), "token long, sid long, n long, m long, before array<long>")
            active = opened.join(open_.select("token"), "token", "left_semi").join(busy, "sid")
            x, y = (active.select("token", F.col("sid").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in (*own[1:], "before"))) for k in "ab")
            may = (F.col("root_a") < F.col("root_b")) & _may_link(*(F.col(c) for c in ("n_a", "m_a", "n_b", "m_b")))
            # Sets of these sizes must share ``least`` members, so few of either's can stand before the first of them.
            least = F.expr(f"((n_a + n_b) * {PERCENT} + {PERCENT + PERCENT_OF - 1}) div {PERCENT + PERCENT_OF}")
            early = (F.size("before_a") + least <= F.col("m_a")) & (F.size("before_b") + least <= F.col("m_b"))
            pairs = x.join(y, "token").where(may & early & ~F.arrays_overlap("before_a", "before_b")).select("a", "b")
        found = written(_links(pairs, sets), "near-links")
        links = found if links is None else links.unionByName(found)
        roots = written(components(links), "near-roots")
    return roots


def near_groups(docs: DataFrame, mark: F.Column | None = None) -> DataFrame:
    """doc_id, mark, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    A document's set holds its distinct shingles of five words (see ``shingles``); null counts as empty, and without words
    the set is empty and linked with nothing: component_id is the row's own doc_id. Two documents are linked when
    100 * intersection >= 80 * union; component_id is the smallest doc_id (null is not counted, unless all are null) that
    links reach. Rows that share a doc_id are documents of their own. ``mark`` (a string column, null if none) comes along.
    Sets are told apart by 128 bits, and by 64 bits in the search for candidates.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.lit(None) if mark is None else mark).cast("string").alias("mark"), text_or_empty(docs).alias("text"))
    first = written(rows.mapInArrow(tidily(_first_pass), "doc_id long, mark string, n long, sig binary, sid long, shared long, known binary, fresh binary"), "near-first")
    sets = written(first.where("n > 0").groupBy("sig", "sid", "n").agg(F.min("doc_id").alias("rep")), "near-sets")
    counts = _survivors(first)
    left = written(sets.join(counts, "sid").where(F.col("shared") >= 1 + F.floor(F.expr(f"(n * {PERCENT} + {PERCENT_OF - 1}) div {PERCENT_OF}") / 16)).select("sid", "sig", "rep"), "near-left")
    texts = rows.join(left, rows["doc_id"].eqNullSafe(left["rep"])).select("sid", "sig", "text")
    members = texts.mapInArrow(tidily(_members), "token long, sid long, n long")
    shared = members.repartition("token").sortWithinPartitions("token", "sid").mapInArrow(tidily(_frequencies), "sid long, n long, df int, token long")
    ordered = shared.repartition("sid").sortWithinPartitions("sid", "df", "token").mapInArrow(tidily(_ordered), "sid long, n long, m long, weight double, tokens binary, first binary, second binary, third binary")
    ordered = written(ordered, "near-ordered")
    roots = _roots(ordered)
    linked = sets.join(roots, sets["sid"] == roots["node"])
    smallest = linked.groupBy("root").agg(F.min("rep").alias("least"))
    groups = linked.join(smallest, "root").select("sig", F.col("least"))
    named = written(sets.join(groups, "sig", "left").select("sig", F.coalesce("least", "rep").alias("component_id")), "near-named")
    empty = first.where("n = 0").select("doc_id", "mark", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return first.where("n > 0").select("doc_id", "mark", "n", "sig").join(named, "sig").select("doc_id", "mark", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that are linked, directly or through others, with one that stays.

    Of a component the row with the smallest doc_id stays (of rows that share it the one whose text's SHA-256 is least; rows
    equal in both stay together). Documents without words stay.
    """
    sha = F.sha2(text_or_empty(docs), 256)
    groups = near_groups(docs, sha)
    stay = groups.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("stays"))
    keys = stay.select(F.col("stays.doc_id").alias("__id"), F.col("stays.mark").alias("__sha")).unionByName(groups.where("n_shingles = 0").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__sha")).distinct())
    at = docs.withColumn("__row_sha", sha)
    kept = at.join(written(keys, "near-stay"), at["doc_id"].eqNullSafe(F.col("__id")) & (at["__row_sha"] == F.col("__sha")), "left_semi")
    return kept.drop("__row_sha")
