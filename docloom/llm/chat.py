"""Minimum-cost repair of chat roles, and rendering.

A legal conversation is an optional system turn, then user and assistant in
turn, ending with the assistant.  Each turn can stay, take another role, or be
merged into the turn before it; empty turns can be put in.  A turn is thus a
4 x 4 matrix of least costs between states of the automaton, and conversations
are products of such matrices in (min, +).  Products are associative, so a long
conversation is cut into blocks of turn numbers, and a block whose turn numbers
repeat into parts: each part gives its matrix, the few matrices of a
conversation are composed, and each part is then solved by itself between the
states that the composition has fixed.  Only roles take part in that; texts pass
once, row by row, beside one byte for each turn of their block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, written

ROLES = ("system", "user", "assistant")
#: States: nothing said yet, or the role of the turn that was said last.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = (ASSISTANT,)
#: What it costs to change a known role, to give a role to a turn without a known one, to merge, and to put in an empty turn.
RELABEL, NAME, MERGE, INSERT = 3, 1, 2, 4
#: Turn numbers of a block.
BLOCK = 4096
#: How a turn is written.
TEMPLATE = ("<|im_start|>{role}\n", "<|im_end|>\n")
FAR = 1 << 40
#: Names by number, as tables between the passes hold them.
KNOWN = ("", *ROLES)
ACTIONS = ("keep", "relabel", "merge")
KEY = [("conv_id", pa.int64()), ("block", pa.int64()), ("part", pa.int64())]


def _label(role: str, wanted: int) -> int:
    return 0 if role == ROLES[wanted - 1] else RELABEL if role in ROLES else NAME


@lru_cache(maxsize=None)
def moves(role: str) -> tuple[tuple[tuple[int, int, str, int], ...], ...]:
    """For a turn of ``role``, by state before it: (cost, state after, action, empty turn put in before or 0)."""
    out = []
    for state in range(4):
        best: dict[tuple, tuple] = {}
        if state:  # merged into the turn before: it takes that turn's role
            best[state, "merge", 0] = (MERGE + _label(role, state), state, "merge", 0)
        for to in NEXT[state]:
            action = "keep" if role == ROLES[to - 1] else "relabel"
            best[to, action, 0] = (_label(role, to), to, action, 0)
        for empty in NEXT[state]:
            for to in NEXT[empty]:
                action = "keep" if role == ROLES[to - 1] else "relabel"
                best[to, action, empty] = (INSERT + _label(role, to), to, action, empty)
        out.append(tuple(sorted(best.values())))
    return tuple(out)


def closing(state: int) -> int:
    """Cost of ending in ``state``: an assistant's empty turn may be put in."""
    return 0 if state in FINAL else INSERT if ASSISTANT in NEXT[state] else 2 * INSERT


def known_role(role: str | None) -> str:
    name = (role or "").strip().lower()
    return name if name in ROLES else ""


def least(matrix: list[list[int]], role: str) -> list[list[int]]:
    """``matrix`` followed by a turn of ``role``."""
    out = [[FAR] * 4 for _ in range(4)]
    for state, choices in enumerate(moves(role)):
        for cost, to, *_ in choices:
            for start in range(4):
                if (sum_ := matrix[start][state] + cost) < out[start][to]:
                    out[start][to] = sum_
    return out


IDENTITY = [[0 if a == b else FAR for b in range(4)] for a in range(4)]


def path(roles: list[str], start: int, end: int | None) -> tuple[int, list[tuple[int, str, int]]]:
    """Least cost and (state, action, empty turn before) of each turn, from ``start`` to ``end`` (None: wherever closing is cheapest).

    Of equal paths the one whose states, from the last turn back, are smallest is taken.
    """
    costs, back = [0 if s == start else FAR for s in range(4)], []
    for role in roles:
        new, came = [FAR] * 4, [None] * 4
        for state in range(4):
            if costs[state] < FAR:
                for cost, to, action, empty in moves(role)[state]:
                    if costs[state] + cost < new[to]:
                        new[to], came[to] = costs[state] + cost, (state, action, empty)
        costs = new
        back.append(came)
    if end is None:
        end = min(range(4), key=lambda s: (costs[s] + closing(s), s))
    total, out = costs[end], []
    for came in reversed(back):
        state, action, empty = came[end]
        out.append((end, action, empty))
        end = state
    return total, out[::-1]


def _parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[tuple, int, list]]:
    """Runs of rows with equal (conv_id, block), in parts of ``most`` rows: (conv_id, block), the part's number, its roles."""
    now, part, roles = None, 0, []
    for batch in batches:
        for conv, block, role in zip(*(c.to_pylist() for c in batch.columns)):
            if (conv, block) != now or len(roles) == most:
                if roles:
                    yield now, part, roles
                part = part + 1 if (conv, block) == now else 0
                now, roles = (conv, block), []
            roles.append(known_role(role))
    if roles:
        yield now, part, roles


def _gathered(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Tuples as batches of at most ``most`` rows."""
    while held := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """conv_id, block, part, entry, exit and whether it closes the conversation, of each part, from all parts' matrices in order."""

    def solved() -> Iterator[tuple]:
        state = min(range(4), key=lambda s: (costs[s] + closing(s), s))
        for k in range(len(places) - 1, -1, -1):
            entry = steps[4 * k + state]
            yield now, *places[k], entry, state, k == len(places) - 1
            state = entry

    now, places, steps, costs, begun = None, [], bytearray(), [], False
    for batch in batches:
        for conv, block, part, flat in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != now or not begun:
                yield from solved() if begun else ()
                now, places, steps, costs, begun = conv, [], bytearray(), [0] + [FAR] * 3, True
            new = [min((costs[s] + flat[4 * s + t], s) for s in range(4)) for t in range(4)]
            places.append((block, part))
            steps += bytes(s for _, s in new)
            costs = [c for c, _ in new]
    yield from solved() if begun else ()


def repaired(turns: DataFrame, *, block: int = BLOCK, template: tuple[str, str] = TEMPLATE) -> DataFrame:
    """A row for each turn of ``turns`` (conv_id, turn, role, text), repaired at least cost:

    conv_id, turn, role, text, new_role, action (keep, relabel, merge), inserted (the role of an empty turn before it or
    null), added (the same after the last turn of a conversation) and rendered: what the turn adds to the conversation's
    text. Joined in order of turn, role and text, the pieces of a conversation are its whole text; a turn's closing mark
    is part of the piece that ends it. Roles are compared without case and outer blanks; a null or unknown role has
    no name yet. Null texts count as empty, a null turn comes first, a null conv_id is a conversation of its own. Rows
    of one turn number follow each other by role and text. Other columns are left out.
    """
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), turns["role"].cast("string").alias("role"), F.coalesce(turns["text"].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))).cast("long"))
    narrow = rows.select("conv_id", "block", "turn", "role")
    dealt = narrow.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role").select("conv_id", "block", "role")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for key, part, roles in _parts(batches, block):
                matrix = IDENTITY
                for role in roles:
                    matrix = least(matrix, role)
                yield *key, part, bytes(KNOWN.index(r) for r in roles), [x for row in matrix for x in row]

        yield from _gathered(each(), pa.schema([*KEY, ("roles", pa.binary()), ("matrix", pa.list_(pa.int64()))]))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(_composed(batches), pa.schema([*KEY, ("entry", pa.int32()), ("exit", pa.int32()), ("closes", pa.bool_())]))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A byte for each turn: its state, action and the empty turn before it; and the empty turns after the last one."""

        def each() -> Iterator[tuple]:
            for batch in batches:
                for conv, number, part, roles, entry, exit_, closes in zip(*(c.to_pylist() for c in batch.columns)):
                    _, found = path([KNOWN[r] for r in roles], entry, exit_)
                    tail = [] if not closes or exit_ in FINAL else [ASSISTANT] if exit_ == USER else [USER, ASSISTANT]
                    yield conv, number, part, bytes(s | ACTIONS.index(a) << 2 | e << 4 for s, a, e in found), entry, bytes(tail) if closes else None

        yield from _gathered(each(), pa.schema([*KEY, ("steps", pa.binary()), ("entry", pa.int32()), ("tail", pa.binary())]))

    blocks = written(dealt.mapInArrow(matrices, "conv_id long, block long, part long, roles binary, matrix array<long>"), "chat-blocks")
    ordered = blocks.select("conv_id", "block", "part", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")
    bounds = ordered.mapInArrow(compose, "conv_id long, block long, part long, entry int, exit int, closes boolean").alias("b")
    same = F.col("r.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("r.block") == F.col("b.block")) & (F.col("r.part") == F.col("b.part"))
    met = blocks.alias("r").join(bounds, same).select("r.conv_id", "r.block", "r.part", "r.roles", "b.entry", "b.exit", "b.closes")
    solved = met.mapInArrow(steps, "conv_id long, block long, part long, steps binary, entry int, tail binary")
    # A block's steps come before its turns in the same stream, so texts are joined with nothing.
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    lead = solved.select("conv_id", "block", F.lit(0).alias("kind"), F.col("part").alias("turn"), none("string", "role"), none("string", "text"), "steps", "entry", "tail")
    body = rows.select("conv_id", "block", F.lit(1).alias("kind"), "turn", "role", "text", none("binary", "steps"), none("int", "entry"), none("binary", "tail"))
    both = lead.unionByName(body).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "kind", "turn", "role", "text")
    opening, end = template
    empty_turn = lambda state: opening.format(role=ROLES[state - 1]) + end

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, plan, at, first, tail, out, held = (), bytearray(), 0, True, None, [], 0
        for batch in slices(batches, 5):
            for conv, number, kind, turn, role, text, own, entry, last in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv, number) != now:
                    now, plan, at, first, tail = (conv, number), bytearray(), 0, entry == START, None
                if not kind:
                    plan += own
                    tail = last if last is not None else tail
                    continue
                state, action, empty = plan[at] & 3, ACTIONS[plan[at] >> 2 & 3], plan[at] >> 4
                if action == "merge":
                    piece = "\n" + text
                else:
                    piece = ("" if first and not at else end) + (empty_turn(empty) if empty else "") + opening.format(role=ROLES[state - 1]) + text
                at += 1
                final = tail is not None and at == len(plan)
                if final:
                    piece += end + "".join(map(empty_turn, tail))
                out.append((conv, turn, role, text, ROLES[state - 1], action, ROLES[empty - 1] if empty else None, ROLES[tail[-1] - 1] if final and tail else None, piece))
                held += len(text)
                if held > 4 << 20 or len(out) == 5000:
                    yield _batch(out)
                    out, held = [], 0
        if out:
            yield _batch(out)

    names = ["conv_id", "turn", "role", "text", "new_role", "action", "inserted", "added", "rendered"]

    def _batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k < 2 else pa.string()) for k, x in enumerate(zip(*out))], names)

    schema = T.StructType([T.StructField(c, T.LongType() if k < 2 else T.StringType()) for k, c in enumerate(names)])
    return both.mapInArrow(render, schema)
