"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import base64
import collections
import functools
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, n_tokens int, score string, bucket int"


def word(rng, n=None):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(n or rng.randint(2, 8)))


def words(rng, n):
    return [word(rng) for _ in range(n)]


def documents(seed=5):
    """Texts with copies, near copies, shared passages, and everything odd; with columns whose names operators use."""
    rng = random.Random(seed)
    base = words(rng, 200)
    texts = [None, "", "   ", "one", "one two three four", "one two three four", "A b  C d e", "a B c D e", "x " * 2500, "y" * 3000, "é日本 \U0001f600 <|endoftext|> it's  \n\n", " " * 50]
    texts += [" ".join(words(rng, rng.randint(5, 120))) for _ in range(15)]
    for edits in (0, 0, 1, 2, 3, 6, 12):
        near = list(base)
        for _ in range(edits):
            near[rng.randrange(len(near))] = word(rng)
        texts.append(" ".join(near))
    passage = words(rng, 60)
    texts += [" ".join(words(rng, 80) + passage + words(rng, 40)) for _ in range(3)]
    rows = [(k, t, "en", 7, "s", 1) for k, t in enumerate(texts)]
    return [*rows, rows[-1], rows[4], (None, "no id at all", "de", None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


# --- WARC -------------------------------------------------------------------------------------------------------------

PAGES = [(1, "u1", "<p>a</p>"), (2, "u2", "<p>a</p>"), (9, "u9", "<p>a</p>"), (3, "u3", None), (4, "u4", ""), (5, "u5", "é" * 4000), (6, "u\r\n6", "z"), (6, "u6", "z"), (7, "u7", "q"), (7, "u7", "q"), (None, "n", "k"), (8, None, "k")]


def test_warc_round_trip(spark, tmp_path):
    from docloom.llm import warc

    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string").repartition(4)
    folder = f"file://{tmp_path}/a"
    manifest = warc.write_warc(pages, folder, shard_bytes=2000, roll_bytes=1500)
    assert manifest.count() > 1
    got = warc.read_warc(manifest, folder, payload=True).collect()
    assert len(got) == len(PAGES)
    last = {}
    for page_id, url, html in PAGES:
        last[html or ""] = max(last.get(html or "", (-1, "")), (-1 if page_id is None else page_id, url or ""))
    by_payload = {base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(): h for h in last}
    kinds = collections.Counter()
    for r in got:
        html = by_payload[r.payload_digest]
        assert r.payload_bytes == len(html.encode())
        kinds[html, r.record_type] += 1
        if r.record_type == "response":
            assert r.payload == html.encode() and r.refers_to is None
            assert (-1 if r.page_id is None else r.page_id) == last[html][0]
        else:
            assert r.refers_to == last[html][0]
    assert all(kinds[h, "response"] == 1 for h in last)
    # The same files again, whatever the partitioning; and nothing temporary left.
    again = warc.write_warc(pages.repartition(1), f"file://{tmp_path}/b", shard_bytes=2000, roll_bytes=1500)
    key = lambda m: sorted((r.name, r.records, r.bytes, r.sha256) for r in m.collect())
    assert key(again) == key(manifest)
    assert not (tmp_path / "a/_temporary").exists()


def test_warc_small_payloads_are_responses(spark, tmp_path):
    from docloom.llm import warc

    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/a"
    got = {r.page_id: r.record_type for r in warc.read_warc(warc.write_warc(pages, folder, least=5), folder).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_warc_of_ids_far_apart(spark, tmp_path):
    from docloom.llm import warc

    ids = [-(1 << 63), -5, 0, 3, 4, 5, 6, (1 << 63) - 1]
    pages = spark.createDataFrame([(i, "u", f"{i} " * 100) for i in ids], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/a"
    manifest = warc.write_warc(pages, folder, shard_bytes=500)
    assert manifest.select("shard").distinct().count() > 3
    assert sorted(r.page_id for r in warc.read_warc(manifest, folder).collect()) == ids


def test_warc_of_large_ids_next_to_none(spark, tmp_path):
    """Ids that no double holds, rows without id, one id of many rows, and copies of all of them."""
    from docloom.llm import warc

    rows = [((1 << 60) + k if k % 9 else None, f"u{k}", f"text {k % 70} " * 20) for k in range(400)] + [(77, f"v{k}", f"text {k % 70} " * 20) for k in range(150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    manifest = warc.write_warc(pages, f"file://{tmp_path}/w", shard_bytes=3000)
    got = warc.read_warc(manifest, f"file://{tmp_path}/w").collect()
    assert len(got) == len(rows) and manifest.select("shard").distinct().count() > 15
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    best = {}
    for r in rows:
        best[r[2]] = max(best.get(r[2], r), r, key=order)
    where = {(r.page_id, r.url): r for r in got}
    for r in rows:
        one, own = where[r[0], r[1]], best[r[2]] == r
        assert (one.record_type, one.refers_to) == (("response", None) if own else ("revisit", best[r[2]][0])), r
    # Every revisit names a record that is there.
    named, ids = set(), {r.record_id for r in got}
    for name in (r.name for r in manifest.collect()):
        with open(f"{tmp_path}/w/{name}", "rb") as f:
            fields = [x for x, _ in warc.records_of(f)]
            assert fields[0]["WARC-Type"] == "warcinfo" and fields[0]["WARC-Filename"] == name
            named |= {x["WARC-Refers-To"] for x in fields if x["WARC-Type"] == "revisit"}
    assert named and named <= ids


def test_warc_shards_of_many_clusters_are_small(spark):
    from docloom.llm import warc

    ids = [c * 10**15 + k for c in range(40) for k in range(100)] + [5] * 200
    rows = spark.createDataFrame([(k, 1000) for k in ids] + [(None, 1000)] * 90, "page_id long, size long")
    layout = warc._shards(rows, 10_000)
    known = np.array(ids, np.int64)
    mixed = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, len(ids))
    sizes = 1000 * np.bincount(layout.of(known, np.ones(len(ids), bool), mixed), minlength=layout.shards)
    assert len(sizes) == layout.shards and layout.nulls == 9 and sizes[:9].sum() == 0
    assert sizes.max() <= 25_000 and np.median(sizes[9:]) >= 5_000  # the one id of 200 rows is dealt by hash
    order = np.argsort(known, kind="stable")
    assert (np.diff(np.searchsorted(layout.upper, known[order])) >= 0).all()
    nothing = warc._shards(rows.limit(0), 10_000)
    assert nothing.shards == 1


def test_warc_of_nothing(spark):
    from docloom.llm import warc

    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- tokens -----------------------------------------------------------------------------------------------------------


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    from docloom.llm.token_counts import counted, token_counts

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = sorted((str(r[0]), len((r[1] or "").encode()), size(r[1]), size(r[1]) > 512) for r in documents())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in counted(docs, path).collect()) == want
    assert counted(none, path).count() == 0
    kept = token_counts(docs, path, keep_text=True)
    assert sorted(kept.columns) == sorted(docs.columns) and all(r.n_tokens == size(r.text) for r in kept.collect())


def test_count_transducer_on_odd_texts():
    from tokenizers import Tokenizer

    from docloom.llm.bpe import read_json
    from docloom.llm.token_counts import CountTransducer, chunk_maps, count_tokens, match_starts, scanned, symbols

    path, rng = P.path("byte_bpe_50k.json"), random.Random(2)
    library, machine = Tokenizer.from_file(path), CountTransducer(read_json(path))
    parts = ["a", "'", "s", "'re", " ", "  ", "\n", "\t", "the", "é", "1", "23", "!", "$$", "日本", "<|endoftext|>", " ", "­", "½", "​", "'ll", "x'd", "İ", "\U0001f600"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["a" * 3000, " " * 999 + "x", "word" * 700]
    raw = [t.encode() for t in texts]
    got = count_tokens(machine, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    assert got.tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    # The chunk maps compose: where matches begin does not depend on the chunks.
    chars = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le"), np.uint32)
    first = np.zeros(len(chars), bool)
    first[np.cumsum([0] + [len(t) for t in texts if t])[:-1]] = True
    s = symbols(chars, np.append(first[1:], True))
    assert (match_starts(s, first, 64) == match_starts(s, first, len(s))).all()
    maps = np.array([[1, 0, 2], [2, 2, 1]], np.uint8)
    assert scanned(maps).tolist() == [[1, 0, 2], [2, 2, 1]]
    assert chunk_maps(s[:40, None].copy(), first[:40, None].copy()).shape == (1, 8)


def test_bpe_codec(docs, none):
    import tiktoken

    from docloom.llm.bpe_codec import encoded

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((str(r[0]), tuple(library.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in documents())
    got = encoded(docs, path, P.PATTERN, ids=True).collect()
    assert sorted((str(r.doc_id), tuple(r.ids), bytes(r.decoded)) for r in got) == want
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded).hexdigest()
    assert encoded(none, path, P.PATTERN).count() == 0


# --- exact duplicates -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("collide", [False, True])
def test_exact_dedup(docs, collide):
    from docloom.llm.exact_dedup import exact_groups, kept_rows, sha256

    weak = (lambda c: F.substring(F.sha2(c, 256), 1, 1)) if collide else sha256
    groups = collections.defaultdict(list)
    for r in documents():
        groups[r[1] or ""].append(r[0])
    big = lambda ids: max(ids, key=lambda i: -1 if i is None else i)
    want = sorted((str(i), str(big(ids)), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    got = exact_groups(docs, weak).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    if not collide:
        assert kept_rows(docs).count() == len(groups) and kept_rows(docs).columns == docs.columns


def test_exact_dedup_in_small_batches(docs):
    from docloom.llm.exact_dedup import exact_groups

    order = lambda df: sorted(map(str, df.drop("file_path", "row_index").collect()))
    assert order(exact_groups(docs, batch_bytes=1)) == order(exact_groups(docs))


def test_exact_dedup_state_outlives_a_stop(spark, tmp_path):
    """Two runs with one checkpoint, each of several micro-batches: hits of the second find what the first has kept."""
    from docloom.llm.exact_dedup import arrivals_state

    rng, folder, seen = random.Random(6), f"file://{tmp_path}/in", []
    for run in range(2):
        rows = [(f"d{rng.randrange(60)}", None if k == 5 else rng.randrange(1000), f"f{run}", k) for k in range(200)]
        seen += rows
        df = spark.createDataFrame(rows, "digest string, doc_id long, file_path string, row_index long")
        df.repartition(3).write.mode("append").parquet(folder)
        state = arrivals_state(spark, folder, df.schema, checkpoint=f"file://{tmp_path}/state", batch_bytes=1).collect()
        want = collections.defaultdict(list)
        for digest, *rest in seen:
            want[digest].append(tuple(rest))
        biggest = lambda rows: max(rows, key=lambda r: (-1 if r[0] is None else r[0], *r[1:]))
        assert {r.digest: (tuple(r.stays), r.arrived) for r in state} == {d: (biggest(v), len(v)) for d, v in want.items()}
    assert len(list((tmp_path / "state" / "commits").glob("[0-9]*"))) >= 6


def test_exact_dedup_of_nothing(none):
    from docloom.llm.exact_dedup import exact_groups, kept_rows

    assert exact_groups(none).count() == 0 and kept_rows(none).count() == 0


# --- packing ----------------------------------------------------------------------------------------------------------


def test_optimal_bounds_against_every_choice():
    from docloom.llm.packing import optimal_bounds

    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted(rng.sample(range(60), rng.randint(1, 9)))
        counts = [rng.randint(1, 9) for _ in lengths]
        waste = lambda bounds: sum(c * (min(b for b in bounds if b >= s) - s) for s, c in zip(lengths, counts))  # noqa: B023, E731
        for k in range(1, 6):
            bounds = optimal_bounds(lengths, counts, k)
            assert len(bounds) <= k and bounds[-1] == lengths[-1]
            best = min(waste([*c, lengths[-1]]) for n in range(k) for c in itertools.combinations(lengths[:-1], n))
            assert waste(bounds) == best


def test_packed(spark, none):
    from docloom.llm.packing import packed

    rng = random.Random(3)
    rows = [(k, rng.randint(0, 900)) for k in range(3000)] + [(None, 5), (7, 7), (7, 7), (1, None), (2, 100_000)]
    out = packed(spark.createDataFrame(rows, "doc_id long, n_tokens int"), buckets=5, budget=4000).collect()
    assert len(out) == len(rows)
    batches = collections.defaultdict(list)
    for r in out:
        assert r.padding == r.bucket_tokens - r.n_tokens >= 0
        batches[r.bucket, r.batch].append(r)
    for (bucket, batch), own in batches.items():
        fit = max(1, 4000 // max(1, own[0].bucket_tokens))
        assert sorted(r.slot for r in own) == list(range(len(own))) and len(own) <= fit
        if len(own) < fit:
            assert batch == max(b for k, b in batches if k == bucket)
    assert packed(none).count() == 0


# --- chat -------------------------------------------------------------------------------------------------------------


def cheapest(roles):
    """Least cost over all ways to repair, by search."""
    from docloom.llm import chat

    costs = {chat.START: 0}
    for role in roles:
        new = {}
        for s, c in costs.items():
            for cost, to, *_ in chat.moves(role)[s]:
                new[to] = min(new.get(to, math.inf), c + cost)
        costs = new
    return min(c + chat.closing(s) for s, c in costs.items())


LEGAL = re.compile(r"s?(ua)+")


@functools.cache
def cheapest_of_all(roles):
    """Least cost over all repairs, written out: a turn keeps or takes any role or joins the one before; up to one empty
    turn of any role stands before it and up to two at the end; what is legal is a pattern over initials."""
    price = lambda had, takes: 0 if had == takes else 3 if had in "sua" else 1
    best = math.inf
    gaps = ["", "s", "u", "a"]
    for choice in itertools.product("suam", repeat=len(roles)):
        for before in itertools.product(gaps, repeat=len(roles)):
            said, cost = "", 0
            for had, takes, gap in zip(roles, choice, before):
                said, cost = said + gap, cost + 4 * len(gap)
                if takes == "m":
                    if not said or gap:
                        cost = math.inf
                        break
                    cost += 2 + price(had, said[-1])
                else:
                    said, cost = said + takes, cost + price(had, takes)
            if cost < best:
                best = min([best] + [cost + 4 * len(end) for end in ("", "a", "ua") if LEGAL.fullmatch(said + end)])
    return best


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_chat_repair_against_every_sequence(spark, block):
    from docloom.llm import chat

    name = {"s": "system", "u": "user", "a": "assistant", "?": "tool"}
    rows, wanted = [], {}
    for conv, roles in enumerate(r for n in (1, 2, 3) for r in itertools.product("sua?", repeat=n)):
        wanted[conv] = cheapest_of_all(roles)
        # Turn numbers in order, or all null or equal with roles in the order in which they are taken then.
        rows += [(conv, t, name[r], "") for t, r in enumerate(roles)]
    got = chat.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), block=block).collect()
    convs = collections.defaultdict(list)
    for r in got:
        convs[r.conv_id].append(r)
    assert len(convs) == len(wanted)
    for conv, own in convs.items():
        own.sort(key=lambda r: r.turn)
        said = "".join(role[0] for role in re.findall(r"<\|im_start\|>(\w+)\n", "".join(r.rendered for r in own)))
        assert LEGAL.fullmatch(said)
        kept = sum(r.action != "merge" for r in own)
        changed = sum(0 if r.role == r.new_role else 1 if r.role == "tool" else 3 for r in own)
        assert changed + 2 * (len(own) - kept) + 4 * (len(said) - kept) == wanted[conv]


@pytest.mark.parametrize("turn", [None, 7])
def test_chat_repair_of_one_turn_number(spark, turn):
    """Many rows without a turn number, or with one and the same, in parts: the same repair as if they had numbers."""
    from docloom.llm import chat

    rng = random.Random(9)
    rows = [(rng.choice(["user", "assistant", "system", None, "bot"]), rng.choice(["a", "b", "long " * 40_000, None])) for _ in range(300)]
    rows.sort(key=lambda r: tuple((x is not None, x or "") for x in r))
    table = lambda numbers: spark.createDataFrame([(1, t, *r) for t, r in zip(numbers, rows)], "conv_id long, turn long, role string, text string")
    one = chat.repaired(table([turn] * len(rows)), block=16).collect()
    many = chat.repaired(table(range(len(rows))), block=4096).collect()
    spent = lambda out: sum((0 if chat.known_role(r.role) == r.new_role else 3 if chat.known_role(r.role) else 1) + 2 * (r.action == "merge") + 4 * (r.inserted is not None) for r in out)
    assert len(one) == len(rows) and spent(one) == spent(many)


def test_chat_moves_are_legal():
    from docloom.llm import chat

    for role in ("system", "user", "assistant", ""):
        for state, choices in enumerate(chat.moves(role)):
            for cost, to, action, empty in choices:
                if action == "merge":
                    assert state == to and cost >= chat.MERGE
                else:
                    assert to in chat.NEXT[empty or state] and (not empty or empty in chat.NEXT[state])


@pytest.mark.parametrize("block", [2, 4096])
def test_chat_repair(spark, block):
    from docloom.llm import chat

    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "User ", None, "bot"]), rng.choice(["hi", None, "", "x y"])) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, None, "user", "a"), (None, 1, "user", "b"), (50, 1, "user", "same"), (50, 1, "user", "same"), (51, 0, "assistant", "z")]
    got = chat.repaired(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, block int"), block=block).collect()
    assert len(got) == len(rows)
    convs = collections.defaultdict(list)
    for r in got:
        convs[r.conv_id].append(r)
    for own in convs.values():
        own.sort(key=lambda r: (-1 if r.turn is None else r.turn, r.role or "", r.text))
        own.sort(key=lambda r: (-1 if r.turn is None else r.turn, (0, "") if r.role is None else (1, r.role), r.text))
        said, cost = [], 0
        for r in own:
            role = chat.known_role(r.role)
            if r.action == "merge":
                cost += chat.MERGE + chat._label(role, chat.ROLES.index(r.new_role) + 1)
                assert said[-1] == r.new_role
                continue
            if r.inserted:
                said.append(r.inserted)
                cost += chat.INSERT
            said.append(r.new_role)
            cost += chat._label(role, chat.ROLES.index(r.new_role) + 1)
        if own[-1].added:
            cost += chat.INSERT * (2 if said[-1] == "system" else 1)
            said += ["user"] * (said[-1] == "system") + ["assistant"]
        state = chat.START
        for role in said:
            assert chat.ROLES.index(role) + 1 in chat.NEXT[state]
            state = chat.ROLES.index(role) + 1
        assert state in chat.FINAL
        assert cost == cheapest([chat.known_role(r.role) for r in own])
        text = "".join(r.rendered for r in own)
        assert re.findall(r"<\|im_start\|>(\w+)\n", text) == said and text.count("<|im_end|>\n") == len(said)


def test_chat_of_nothing(spark):
    from docloom.llm import chat

    assert chat.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- toxicity ---------------------------------------------------------------------------------------------------------


def kernel(a, b, decay):
    return sum(decay ** (x[-1] - x[0] + 1 + y[-1] - y[0] + 1) for x in itertools.combinations(range(len(a)), 3) for y in itertools.combinations(range(len(b)), 3) if all(a[i] == b[j] for i, j in zip(x, y)))


def test_string_kernel():
    from docloom.llm import toxicity as t

    table, own = t.strings(np.frombuffer("banana idiot aéa".encode(), np.uint8), np.array([0, 17]))
    assert own.tolist() == [0, 0, 0]
    for k, s in enumerate(("^banana", "^idiot", "^aea")):
        assert math.isclose(t.self_kernels(table)[k], kernel(s, s, t.DECAY), rel_tol=1e-4)
    phi = t.features(table)
    assert math.isclose(phi[0] @ phi[1], kernel("^banana", "^idiot", t.DECAY) / math.sqrt(kernel("^banana", "^banana", t.DECAY) * kernel("^idiot", "^idiot", t.DECAY)), abs_tol=1e-5)


def test_sentences_hold_each_string_of_a_text_once():
    from docloom.llm import toxicity as t

    texts = ["one two. Two three\nfour one five", "", "a b c. d " + "x" * 900, "one"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(x) for x in texts])
    table, own = t.strings(data, offsets)
    rows = list(t.sentences(data, offsets))
    assert all(0 < len(held) <= t.STRINGS * t.WIDTH and len(held) % t.WIDTH == 0 for _, held in rows)
    got = sorted((k, held[a : a + t.WIDTH]) for k, held in rows for a in range(0, len(held), t.WIDTH))
    assert got == sorted({(int(k), row.tobytes()) for k, row in zip(own, table)})
    word = lambda x: t.strings(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]))[0].tobytes()
    assert [held for k, held in rows if k == 0] == [word("one two"), word("three"), word("four five")]
    assert list(t.sentences(np.zeros(0, np.uint8), np.array([0, 0]))) == []


def test_toxicity_learns_the_same_of_any_bound(spark, labelled):
    """Bounds of the sample change what is learnt, not whether it is: a third of the sentences still tells toxic documents."""
    from docloom.llm import toxicity as t

    docs = spark.createDataFrame([(k, x) for k, x, _ in labelled], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in labelled], "doc_id long, toxic int")
    got = t.scored(docs, t.trained(docs, labels, sample=500, most_sentences=400)).collect()
    truth = {k: y for k, _, y in labelled}
    assert sum((r.score >= t.THRESHOLD) == (truth[r.doc_id] == 1) for r in got) / len(got) > 0.9


@pytest.fixture(scope="module")
def labelled(spark):
    rng, bad = random.Random(6), ["grobnik", "zuvlasch", "pleftor"]
    rows = []
    for k in range(900):
        w = words(rng, rng.randint(20, 60))
        toxic = k % 4 == 0
        for _ in range(3 if toxic else 0):
            one = rng.choice(bad)
            at = rng.randrange(1, len(one))
            w.insert(rng.randrange(len(w)), rng.choice([one, one, one[:at] + "." + one[at:]]))
        rows.append((k, " ".join(w), int(toxic)))
    return rows


def test_toxicity(spark, labelled):
    from zlib import crc32

    from docloom.llm import toxicity as t

    odd = [(5000, None), (5001, ""), (None, "abc def"), (5002, "grobnik " * 3000), (3, labelled[3][1])]
    docs = spark.createDataFrame([*((k, x) for k, x, _ in labelled), *odd], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([*((k, y, 1) for k, _, y in labelled), (None, 1, 1), (7, None, 1)], "doc_id long, toxic int, score int")
    got = t.toxicity(docs, labels).collect()
    assert len(got) == len(labelled) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = {k: y for k, _, y in labelled}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k in [*truth, 5000, 5001, 5002] if crc32(str(k).encode()) % 3 == 1}
    right = [r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth]
    assert sum(right) / len(right) > 0.95
    toxic = [r.predicted for r in held if truth.get(r.doc_id) == 1]
    assert sum(toxic) / len(toxic) >= 0.9  # at the threshold itself
    assert all(r.score < 0.5 for r in got if r.doc_id in (5000, 5001))
    # Labels that are held out are never looked at.
    other = labels.withColumn("toxic", F.when(t.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted((str(r.doc_id), r.score) for r in t.toxicity(docs, other).collect()) == sorted((str(r.doc_id), r.score) for r in got)


def test_toxicity_without_labels(spark, none):
    from docloom.llm import toxicity as t

    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert {r.score for r in t.toxicity(docs, nothing).collect()} == {0.5}
    assert t.toxicity(none, nothing).count() == 0


# --- top-k ------------------------------------------------------------------------------------------------------------


def test_topk(spark):
    from docloom.llm.topk import exact_topk

    rng = np.random.default_rng(3)
    vectors = [(k, [float(x) for x in rng.normal(size=8) / 3]) for k in range(300)]
    same = [float(x) for x in rng.normal(size=8)]
    vectors += [(k, same) for k in range(300, 420)] + [(20, vectors[20][1]), (500, None), (501, [1.0] * 7 + [None]), (502, [1.0] * 7 + [float("nan")]), (503, [1.0] * 7 + [float("inf")]), (504, [0.5] * 3), (None, same), (520, [])]
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<float>, score string").repartition(4)
    valid = [(i, np.floor(64 * np.array([np.float32(x) for x in e] + [0.0] * (8 - len(e)), float)) if e else np.zeros(8)) for i, e in vectors if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    for block in (4, 1000):
        got = collections.defaultdict(list)
        for r in exact_topk(df, F.col("vec_id") % 20 == 0, 20, block=block).collect():
            got[r.query_id].append((r["rank"], -r.score, r.vec_id))
        assert set(got) == {i for i, _ in valid if i % 20 == 0}
        for q, e in {i: e for i, e in valid if i % 20 == 0}.items():
            want = sorted((-int(e @ c), i) for i, c in valid if i != q)[:20]
            assert sorted(got[q]) == [(n + 1, s, i) for n, (s, i) in enumerate(want)]


def test_topk_of_few_and_none(spark):
    from docloom.llm.topk import exact_topk

    schema = "vec_id long, embedding array<float>"
    assert exact_topk(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.5, 0.5])], schema)
    assert [(r["rank"], r.vec_id, r.score) for r in exact_topk(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(1, 2, 2048), (2, 1, -4096)]
    assert exact_topk(spark.createDataFrame([(0, [1.0])], schema), F.col("vec_id") % 20 == 0).count() == 0


# --- near duplicates --------------------------------------------------------------------------------------------------


def components_of(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for k, r in enumerate(rows):
        ids[find(k)].append(r[0])
    return [(rows[k][0], len(sets[k]), min((i for i in ids[find(k)] if i is not None), default=None)) for k in range(len(rows))]


def test_jaccard_join(docs, none):
    from docloom.llm.jaccard import near_groups, one_of_each

    want = components_of(documents())
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_groups(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert near_groups(none).count() == 0 and one_of_each(none).count() == 0
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    full = collections.Counter(c for _, n, c in want if n)
    assert len({(r.doc_id, r.text) for r in kept.collect() if shingles(r.text)}) == len(full)


def test_jaccard_join_of_families(spark):
    from docloom.llm.jaccard import near_groups

    rng, rows = random.Random(8), []
    for _ in range(6):
        base = words(rng, rng.choice([6, 30, 150]))
        for _ in range(25):
            near = list(base)
            for _ in range(rng.randint(0, 5)):
                near[rng.randrange(len(near))] = word(rng)
            rows.append((len(rows), " ".join(near)))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(components_of(rows))


def test_components(spark):
    from docloom.llm.components import components

    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- passages ---------------------------------------------------------------------------------------------------------


def test_compact_windows_cover_every_subsequence():
    from docloom.llm.passages import compact_windows

    rng = np.random.default_rng(1)
    for high in (1, 3, 1000):
        sizes = [0, 9, 10, 60, 3, 400, 11]
        first = np.concatenate([[0], np.cumsum(sizes)])
        h = rng.integers(0, high, first[-1]).astype(np.uint64) + np.uint64(1)
        windows = list(zip(*(x.tolist() for x in compact_windows(h, first, 10))))
        assert len(windows) == len(set(windows)) and all(b - a + 1 >= 10 for a, _, b in windows)
        for low, end in zip(first[:-1].tolist(), first[1:].tolist()):
            for i in range(low, end):
                for j in range(i + 9, min(end, i + 200), 1 if end - low < 100 else 7):
                    c = i + int(h[i : j + 1].argmin())
                    assert sum(a <= i and j <= b and k == c for a, k, b in windows) == 1
    assert [len(x) for x in compact_windows(np.zeros(0, np.uint64), np.array([0]), 10)] == [0, 0, 0]
    wide = np.arange(1000, 0, -1).astype(np.uint64)
    assert list(zip(*(x.tolist() for x in compact_windows(wide, np.array([0, 1000]), 46)))) == [(0, c, c) for c in range(45, 1000)]


def test_repeated_passages(spark, none):
    from docloom.llm.passages import repeated_passages, without_repeats

    rng = random.Random(9)
    passage, short = words(rng, 60), words(rng, 40)
    changed = [*passage[:30], "other", *passage[31:]]
    texts = [words(rng, 100) for _ in range(12)]
    texts[2] = texts[2][:30] + passage + texts[2][30:]
    texts[5] = passage + texts[5]
    texts[8] = texts[8] + changed
    texts[3], texts[4] = texts[3] + short, short + texts[4]
    rows = [(k, " ".join(t), 1) for k, t in enumerate(texts)] + [(20, " ".join(texts[6]), 1), (21, None, 1), (22, "", 1), (None, " ".join(texts[2]), 1), (23, "q " * 900, 1), (24, "q " * 900, 1), (20, " ".join(texts[6]), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int").repartition(3)
    got = {(r.doc_id, r.start, r.end, r.first_id) for r in repeated_passages(docs).collect()}
    assert {(5, 0, 60, 2), (20, 0, 100, 6), (24, 0, 900, 23)} <= got
    assert any(d == 8 and f == 2 and s <= 102 and e == 160 for d, s, e, f in got)
    assert {d for d, *_ in got} == {5, 8, 20, 24}
    left = without_repeats(docs)
    assert left.columns == docs.columns
    kept = collections.defaultdict(list)
    for r in left.collect():
        kept[r.doc_id].append(r.text)
    assert kept[5] == [" ".join(texts[5][60:])] and 20 not in kept and 24 not in kept
    for k in (0, 1, 2, 3, 4, 6, 7):
        assert kept[k] == [" ".join(texts[k])]
    assert repeated_passages(none).count() == 0 and without_repeats(none).count() == 0


def test_passages_against_exact_windows(spark):
    from docloom.llm.passages import repeated_passages

    rng = random.Random(10)
    pool = [words(rng, rng.randint(50, 90)) for _ in range(8)]
    texts = [list(itertools.chain(*(rng.choice(pool) if rng.random() < 0.3 else words(rng, 30) for _ in range(8)))) for _ in range(60)]
    got = collections.defaultdict(set)
    for r in repeated_passages(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect():
        got[r.doc_id].update(range(r.start, r.end))
    first, need = {}, collections.defaultdict(set)
    for k, t in enumerate(texts):
        for a in range(len(t) - 49):
            if first.setdefault(tuple(t[a : a + 50]), k) != k:
                need[k].update(range(a, a + 50))
    assert sum(len(need[k] - got[k]) for k in need) <= 0.02 * sum(map(len, need.values()))


def test_passages_with_a_frequent_line(spark):
    from docloom.llm.passages import repeated_passages

    rng = random.Random(11)
    line, rows, pairs = words(rng, 24), [], 30
    for k in range(pairs):
        front, back = words(rng, 13), words(rng, 13)
        rows += [(1000 + k, words(rng, 40) + front + line + back), (3000 + k, front + line + back + words(rng, 40))]
    rows += [(k, words(rng, 60) + line + words(rng, 60)) for k in [*range(40), *range(2000, 2040), *range(4000, 4040)]]
    rows = [(d, " ".join(t)) for d, t in rows]
    got = {(r.doc_id, r.first_id, r.start, r.end) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {(3000 + k, 1000 + k, 0, 50) for k in range(pairs)}


def test_meetings_do_not_depend_on_batches():
    from docloom.llm import passages as m

    rng = np.random.default_rng(12)
    for level in (m.WINDOW, m.CLOSE):
        key, doc, c = np.sort(rng.integers(0, 12, 150)), rng.integers(0, 7, 150), rng.integers(0, 50, 150)
        flag = np.where(rng.random(150) < 0.02, m.HOT, 0)
        table = m._ordered(m._row(key, doc, c, c - 3, c + 4, rng.integers(0, 3, 150), rng.integers(0, 3, 150), level | flag))
        batch = m._batch(table)
        results = []
        for size in (150, 1, 2, 7):
            out = m._meetings(level)(iter([batch.slice(k, size) for k in range(0, 150, size)]))
            results.append(sorted(repr(r) for b in out for r in b.to_pylist()))
        assert results[0] and all(r == results[0] for r in results)


def test_meetings_of_few_documents_are_all_pairs_and_of_many_go_on():
    from docloom.llm import passages as m

    table = m._ordered(m._row(np.array([1, 1, 1, 2, 2, 2, 2, 2]), [5, 6, 9, 1, 2, 3, 4, 4], np.arange(8) + 50, np.arange(8), np.arange(8) + 90, np.full(8, 7), np.zeros(8, int), np.full(8, m.WINDOW)))
    rows = [dict(zip(m._NAMES, x)) for b in m._meetings(m.WINDOW)(iter([m._batch(table)])) for x in zip(*(c.to_pylist() for c in b.columns))]
    met = {(r["a"], r["key"]) for r in rows if r["rk"] & 7 == m.MET}
    assert met == {(6, 5), (9, 5), (9, 6), (2, 1), (3, 1), (3, 2), (4, 1), (4, 3)}
    assert sorted(r["a"] for r in rows if r["rk"] & 7 == m.CLOSE) == [1, 2, 3, 4, 4]  # each with the one context it has
    local = m._settled_here(table)
    kinds = collections.Counter((int(k) & 15) for t in local for k in t[3])
    assert kinds[m.WINDOW] == 3 and kinds[m.WINDOW | m.HOT] == 1  # one row stands for all of the frequent key


def test_regions_join_intervals_of_different_functions():
    from docloom.llm import passages as m

    def regions(*windows, least=10):
        c, l, r, f, kind = (np.array(x) for x in zip(*windows))
        table = m._ordered(m._row(np.full(len(c), 3), np.full(len(c), 8), c, l, r, c * 0, c * 0, kind | f << 4))
        sizes = [len(c), 1, 2]
        got = [[(r["a"], r["p"], r["low"], r["high"]) for b in m._regions(least)(iter([m._batch(table).slice(k, n) for k in range(0, len(c), n)])) for r in b.to_pylist()] for n in sizes]
        assert got[0] == got[1] == got[2]
        return got[0]

    assert regions((20, 10, 40, 0, m.MET), (25, 15, 60, 1, m.MET)) == [(8, 3, 5, 50)]  # they agree on 15..40
    assert regions((20, 10, 40, 0, m.MET), (25, 15, 60, 0, m.MET)) == []  # one function alone
    assert regions((20, 10, 24, 0, m.MET), (25, 15, 60, 1, m.MET)) == []  # no subsequence holds both minima
    assert regions((20, 10, 26, 0, m.MET), (25, 19, 60, 1, m.MET)) == []  # none of 10 or more does
    assert regions((50, 45, 58, 2, m.MET_CLOSE)) == [(8, 3, 20, 80)]
    # A nest of windows: the widest that has its minimum inside counts.
    assert regions((30, 0, 900, 1, m.MET), (60, 31, 800, 1, m.MET), (90, 61, 120, 1, m.MET), (100, 50, 700, 0, m.MET)) == [(8, 3, 40, 710)]
    assert regions((100, 0, 900, 1, m.MET), (100, 90, 109, 0, m.MET), (500, 490, 509, 0, m.MET)) == [(8, 3, 80, 119)]


def test_passages_of_stock_phrases(spark):
    """Exact and near copies all of whose words come from phrases that other documents use too."""
    from docloom.llm.passages import repeated_passages

    for size, phrases in ((12, 40), (20, 30), (30, 25)):
        rng = random.Random(size)
        stock = [words(rng, size) for _ in range(phrases)]
        text = lambda n: list(itertools.chain(*(rng.choice(stock) for _ in range(n))))  # noqa: B023, E731
        passage = text(-(-60 // size) + 1)[size // 3 :][:60]
        texts = []
        for k in range(300):
            own = text(8)
            at = rng.randrange(len(own))
            texts.append(own[:at] + passage + own[at:] if k % 4 == 0 else own)
        got = collections.defaultdict(set)
        for r in repeated_passages(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)).collect():
            got[r.doc_id].update(range(r.start, r.end))
        first, need = {}, collections.defaultdict(set)
        for k, t in enumerate(texts):
            for a in range(len(t) - 49):
                if first.setdefault(tuple(t[a : a + 50]), k) != k:
                    need[k].update(range(a, a + 50))
        assert len(need) > 70
        missed = sum(len(need[k] - got[k]) for k in need)
        assert missed <= 0.02 * sum(map(len, need.values())), (size, missed)


def test_near_passages_against_all_pairs(spark):
    """Passages with a Jaccard similarity of 0.8 to 0.95, by the definition."""
    from docloom.llm.passages import repeated_passages

    rng, rows, planted = random.Random(15), [], []
    for k in range(150):
        size = rng.randint(55, 140)
        passage = words(rng, size)
        copy = list(passage)
        for at in rng.sample(range(5, size - 5), max(1, size // 60)):
            copy[at] = "x" + copy[at] + str(k)
        sets = [{tuple(t[j : j + 5]) for j in range(len(t) - 4)} for t in (passage, copy)]
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]):
            planted.append((1000 + k, k, 20, 20 + size))
        rows += [(k, " ".join(words(rng, 25) + passage + words(rng, 10))), (1000 + k, " ".join(words(rng, 20) + copy + words(rng, 30)))]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.first_id) for r in got} <= {(d, p) for d, p, *_ in planted} | {(1000 + k, k) for k in range(150)}
    spans = {(r.doc_id, r.first_id): (r.start, r.end) for r in got}
    good = sum((d, p) in spans and spans[d, p][0] <= s + 5 and spans[d, p][1] >= e - 5 for d, p, s, e in planted)
    assert len(planted) > 100 and good >= 0.95 * len(planted)


def test_passages_with_insertions(spark):
    from docloom.llm.passages import _compared, repeated_passages

    rng, rows, want = random.Random(13), [], {}
    for k, (size, more) in enumerate([(50, 2), (60, 4), (80, 7), (90, 8)] * 3):
        passage = words(rng, size)
        copy = passage[: size // 2] + words(rng, more) + passage[size // 2 :]
        own, other = (np.array([hash(tuple(t[j : j + 5])) for j in range(len(t) - 4)], np.int64).view(np.uint64) for t in (copy, passage))
        assert [(s, e) for s, e, *_ in _compared(own, 0, other, 46)] == [(0, size + more)]
        rows += [(k, " ".join(words(rng, 30) + passage)), (100 + k, " ".join(copy + words(rng, 30)))]
        want[100 + k] = (k, 0, size + more)
    got = {r.doc_id: (r.first_id, r.start, r.end) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.items()) <= set(want.items()) and len(got) >= 0.7 * len(want)


def test_runs_against_all_rows_of_runs():
    from docloom.llm.passages import _runs

    rng = np.random.default_rng(14)
    for share in (0.5, 0.8, 0.9):
        for _ in range(30):
            match = rng.random(40) < share
            edges = np.flatnonzero(np.diff(np.concatenate([[0], match.view(np.int8), [0]])))
            good = [(a, b) for a in edges[::2] for b in edges[1::2] if a < b and 5 * match[a:b].sum() >= 4 * (b - a)]
            most = {(a, b) for a, b in good if not any((c, d) != (a, b) and c <= a and b <= d for c, d in good)}
            assert {(r[0][0], r[-1][1]) for r in _runs(match)} == most


def test_repeats_half_in_a_common_passage(spark):
    # All documents of a group share 60 words, some also the 25 that follow: a repeat that lies half in a passage found elsewhere.
    from docloom.llm import passages

    docs, tail_of = [], {}
    for seed in range(4):
        rng = random.Random(seed)
        words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]  # noqa: B023, E731
        common, tails = words(60), [words(25) for _ in range(40)]
        order = [t for t in range(40) for _ in range(3)]
        rng.shuffle(order)
        for k, t in enumerate(order):
            docs.append((1000 * seed + k, " ".join(words(30) + common + tails[t] + words(30))))
            tail_of[docs[-1][0]] = (seed, t)
    covered = {}
    for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    seen = set()
    for k, _ in docs:
        assert tail_of[k] not in seen or set(range(30, 115)) <= covered[k]
        seen.add(tail_of[k])
