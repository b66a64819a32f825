"""Vector codes, mixtures and conversation repair against plain versions, and on odd rows."""

import collections
import functools
import hashlib
import itertools
import math
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from lexline.llm import codebooks, conversations, mixture

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
given = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


def rows(name, columns="*"):
    return duckdb.sql(f"SELECT {columns} FROM '{DATA}/{name}.parquet'").fetchall()


# --- vector codes -------------------------------------------------------------------------------


def plain_codes(table, parts, entries, rounds, scale=256):
    """{row: (code, error)} and the codebooks, with whole numbers and plain loops."""
    size = len(table[0][2])
    width = size // parts
    whole = [[math.floor(scale * x) for x in v] for _, _, v in table]
    order = sorted(range(len(table)), key=lambda i: (table[i][0] is None, table[i][0], table[i][2]))
    out = [["", 0] for _ in table]
    books = []
    for p in range(parts):
        part = [w[p * width : (p + 1) * width] for w in whole]
        book = [part[i] for i in order[:entries]]

        def best(x):
            return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

        for _ in range(rounds):
            members = collections.defaultdict(list)
            for x in part:
                members[best(x)[1]].append(x)
            book = [
                [sum(c) // len(members[e]) for c in zip(*members[e], strict=True)] if e in members else c
                for e, c in enumerate(book)
            ]
        for i, x in enumerate(part):
            far, e = best(x)
            out[i][0] += f"{e:02x}"
            out[i][1] += far
        books += book
    text = ",".join(str(x) for entry in books for x in entry)
    return out, hashlib.sha256(text.encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int, code string, row int"


def vector_rows(seed, n=90, size=16):
    r = random.Random(seed)
    centres = [[r.uniform(-0.6, 0.6) for _ in range(size)] for _ in range(4)]
    out = []
    for i in range(n):
        v = [float(np.float32(c + r.gauss(0, 0.2))) for c in r.choice(centres)]
        out.append((i * 3 % n if i % 10 else None, v if i % 4 else [0.25] * size, r.choice([1, 2, None]), "own", i))
    return out


@pytest.mark.parametrize("rows_per_owner", [7, 1_000])
@pytest.mark.parametrize("rounds", [0, 1, 2, 4])
def test_codes_against_plain_loops(spark, rows_per_owner, rounds):
    table = vector_rows(rounds)
    bad = [
        (1_000, None, 1, "x", -1),
        (1_001, [float("nan")] * 16, 1, "x", -1),
        (1_002, [float("inf")] * 16, 1, "x", -1),
        (1_003, [None] + [0.0] * 15, 1, "x", -1),
        (1_004, [0.5] * 8, 1, "x", -1),
        (1_005, [], 1, "x", -1),
        (1_006, [1e30] * 16, 1, "x", -1),
    ]
    df = spark.createDataFrame(table + bad, VECTORS)
    got = codebooks.compress(df, parts=4, entries=6, rounds=rounds, rows_per_owner=rows_per_owner).collect()
    want, digest = plain_codes([r[:1] + (r[2],) + r[1:2] for r in table], 4, 6, rounds)
    totals = collections.Counter()
    for row, (_, error) in zip(table, want, strict=True):
        totals[row[2]] += error
    plain = [(r[0], code, error, totals[r[2]]) for r, (code, error) in zip(table, want, strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([(g["vec_id"], g["code"], g["error"], g["label_error"]) for g in got], key=key) == sorted(plain, key=key)
    assert {g["codebooks_sha256"] for g in got} == {digest}


def test_only_parts_that_change_their_entry_move(spark):
    table = [(i, [float(i // 10)] * 4, None, "", i) for i in range(40)]
    valid = codebooks.valid_vectors(spark.createDataFrame(table, VECTORS))
    books = np.array([[[0, 0], [512, 512]], [[0, 0], [512, 512]]])
    members = codebooks.first_members(valid, books, 256, 3)
    now = codebooks.judged(members, np.array([[[0, 0], [1300, 1300]], [[0, 0], [512, 512]]]))
    away = codebooks.moved(now, 3).collect()
    # The middle values leave the entry that moved off, at the first position alone.
    assert {(r["position"], r["entry"]) for r in away} == {(0, 0)} and len(away) == 10
    assert members.count() == 80 and {r["salt"] for r in members.collect()} <= {0, 1, 2}


def test_codes_of_few_or_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert codebooks.compress(none).count() == 0
    assert codebooks.compress(spark.createDataFrame([(1, None, 1, "", 0)], VECTORS)).count() == 0
    one = codebooks.compress(spark.createDataFrame([(None, [-0.001] * 32, None, "", 0)] * 2, VECTORS)).collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in one] == [("00" * 16, 0, 0)] * 2
    assert one[0]["codebooks_sha256"] == hashlib.sha256(",".join(["-1"] * 64).encode()).hexdigest()


# --- mixtures -----------------------------------------------------------------------------------


def plain_targets(sizes, weights=(3, 1, 2)):
    """Targets by taking the largest excess off again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = budget / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 2 * sizes[s] + 1e-9]
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            budget -= out[s]
            open_.remove(s)
    return out


def check_mix(got, docs, slack):
    """``docs`` are (doc_id, text, source); ``slack`` is the part of its target that a source may be off."""
    size = {None: 0}
    by_source = collections.Counter()
    for _, text, source in docs:
        size[text] = len(WORD.findall(text or ""))
        by_source[source] += size[text]
    want = plain_targets(by_source)
    taken = collections.Counter()
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        assert r["source_size"] == by_source[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        taken[r["source"]] += r["taken"]
    for source in want:
        assert abs(taken[source] - want[source]) <= max(1, slack * want[source]), source
    key = lambda r: (r[0] is None, r)
    assert sorted([(r["doc_id"], r["size"]) for r in got], key=key) == sorted([(k, size[t]) for k, t, _ in docs], key=key)


MIXED = "doc_id long, text string, source string, size string, target int"


def mixed_docs(seed, n=300):
    r = random.Random(seed)
    out = []
    for i in range(n):
        source = r.choice(["b", "b", "b", "a", "Ω", "z", "", None, "tiny"])
        words = 1 if source == "tiny" else r.randint(0, 40)
        text = None if i % 37 == 0 else r.choice([" ", "\n"]).join(["w"] * words)
        out.append((i if i % 9 else None, text, source, "own", 1))
    return out


@pytest.mark.parametrize("margin", [1, 50, 1 << 16])
def test_mix_meets_its_targets(spark, margin):
    table = mixed_docs(margin)
    df = spark.createDataFrame(table, MIXED)
    got = mixture.mix(df, margin=margin).collect()
    check_mix(got, [r[:3] for r in table], 0)
    again = mixture.mix(df.repartition(7), margin=margin).collect()
    columns = ["doc_id", "source", "size", "taken"]
    assert collections.Counter(tuple(r[c] for c in columns) for r in got) == collections.Counter(
        tuple(r[c] for c in columns) for r in again
    )


def test_mix_of_rows_that_are_all_alike(spark):
    """One source, one length, one text, no ids: the copies come out exactly, whatever the partitions."""
    df = spark.createDataFrame([(None, "a b c", None, "", 0)] * 500, MIXED)
    got = mixture.mix(df, margin=1).collect()
    assert len(got) == 500 and sum(r["taken"] for r in got) == 2250 and got[0]["source"] is None
    assert mixture.mix(df.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, "a", "", 0), (2, " ", "b", "", 0)], MIXED)
    assert [(r["size"], r["target"], r["taken"]) for r in mixture.mix(blank).collect()] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("seed", range(40))
def test_nearest_sum_against_all_subsets(seed):
    r = random.Random(seed)
    sizes = r.sample(range(1, 30), r.randint(1, 4))
    counts = [r.randint(0, 3) for _ in sizes]
    goal = r.choice([0, r.uniform(0, 90), r.randint(0, 90), r.randint(0, 40) + 0.5])
    used = mixture.nearest_sum(np.array(sizes), np.array(counts), goal)
    assert all(0 <= u <= c for u, c in zip(used, counts, strict=True))
    sums = {sum(s * k for s, k in zip(sizes, ks, strict=True)) for ks in itertools.product(*[range(c + 1) for c in counts])}
    assert int((used * sizes).sum()) == min(sums, key=lambda s: (abs(s - goal), s))


def test_budget_keeps_the_spread_and_places_long_documents():
    sizes, counts = np.array([0, 3, 10, 1_000]), np.array([9, 6_000, 4_000, 50])
    extra = mixture.fit_budget(sizes, counts, 1.25 * 108_000, margin=2_000) - counts
    assert abs((sizes * extra).sum() - 27_000) <= 0.5
    assert abs(extra[1] - 1_500) < 300 and abs(extra[2] - 1_000) < 300
    # Documents of more words than the knapsack has cells for are placed by length.
    words = (mixture.fit_budget(np.array([5, 900]), np.array([40, 6]), 3_000.0, margin=8, cells=64) * [5, 900]).sum()
    assert 2_895 < words <= 3_000


@given
def test_op12(spark):
    got = entry.queries()["op12_mixture"](spark, DATA).collect()
    docs = rows("documents", "doc_id, text, source")
    source = {k: s for k, _, s in docs}
    check_mix([r.asDict() | {"source": source[r["doc_id"]]} for r in got], docs, 0.002)


# --- conversations ------------------------------------------------------------------------------

SPACE = " \t\n\x0b\x0c\r"


def plain_repair(messages):
    """Results from (turn, role, text) by a recursion over (row, state) on whole answers."""
    order = sorted(
        [tuple(m) for m in messages],
        key=lambda m: (m[0] is not None, m[0] or 0, m[1], m[2]),
    )
    seen, faults = set(), []
    for _, role, text in order:
        body = text.strip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    need = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.lru_cache(None)
    def best(i, state, inserted):
        options = [(0, "", ())] if i == len(order) and state in ("", "a") else []
        if inserted < 3:
            role = need[state][-1]
            c, audit, out = best(i, role, inserted + 1)
            options.append((c + 2, "I" + audit, ({"u": "user:", "a": "assistant:"}[role], *out)))
        if i < len(order):
            _, role, text = order[i]
            c, audit, out = best(i + 1, state, 0)
            options.append((c + 3, "D" + audit, out))
            late = faults[i] == "truncated"
            if faults[i] in ("", "truncated"):
                if role[:1] and role[:1] in need[state]:
                    c, audit, out = best(i + 1, role[:1], 0)
                    options.append((c + late, "K" + audit, (f"{role}:{text}", *out)))
                new = need[state][-1]
                c, audit, out = best(i + 1, new, 0)
                options.append((c + 2 + late, "R" + audit, ({"u": "user:", "a": "assistant:"}[new] + text, *out)))
        return min(options, default=(math.inf, "", ()))

    cost, audit, out = best(0, "", 0)
    turns = [t for t, _, _ in order if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(order)]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        audit,
        hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def plain_damage(table):
    """{conv_id: [(turn, role, text)]} after the damage."""
    out = {}
    for conv, turn, role, text in table:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out.setdefault(conv, []).extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return out


def repaired(df, **options):
    got = conversations.repair(df, **options).collect()
    out = {r["conv_id"]: tuple(r)[1:] for r in got}
    assert len(out) == len(got)
    return out


CHAT = "conv_id long, turn long, role string, text string, cost string, audit string"


def chats(seed, n, mean):
    r = random.Random(seed)
    out = []
    for c in range(n):
        roles = r.choice([["user"], ["user", "assistant"], ["tool", "user"], ["system", "user", "assistant", "", None], ["assistant"]])
        for t in range(r.randint(1, 2 * mean)):
            role = r.choice(roles) if r.random() < 0.5 else roles[t % len(roles)]
            text = r.choice(["Yes.", "No", "", None, " \n", f"t{r.randint(0, 4 * mean)}.", f"t{t} ", f"u{t}!\n"])
            out.append((None if c == 0 else c, None if r.random() < 0.02 else t + (t > 5), role, text, "own", "own"))
    return out


@pytest.mark.parametrize(("seed", "mean"), [(1, 4), (2, 4), (3, 40)])
def test_repair_against_recursion(spark, seed, mean):
    table = chats(seed, 60, mean)
    want = {k: plain_repair(v) for k, v in plain_damage([r[:4] for r in table]).items()}
    df = spark.createDataFrame(table, CHAT)
    assert repaired(df) == want
    # The same conversations cut into chunks of a few rows.
    assert repaired(df, rows_per_chunk=3) == want
    assert repaired(df.repartition(5), rows_per_chunk=11) == want


def test_one_conversation_of_most_rows(spark):
    """Roles that never settle the costs: all alike, so that each cut hands its vector on."""
    r = random.Random(4)
    for roles in (["user"], ["tool"], ["assistant", "assistant", "user"], ["user", "assistant"]):
        table = [(7, t, roles[t % len(roles)], f"m{t}{r.choice('.,')}", "", "") for t in range(400)]
        want = {k: plain_repair(v) for k, v in plain_damage([x[:4] for x in table]).items()}
        assert repaired(spark.createDataFrame(table, CHAT), rows_per_chunk=37) == want
    # All rows the same: one stays, the rest are duplicates that share one order key.
    table = [(7, 1, "user", "same.", "", "")] * 300
    want = {k: plain_repair(v) for k, v in plain_damage([x[:4] for x in table]).items()}
    assert repaired(spark.createDataFrame(table, CHAT), rows_per_chunk=20) == want
    blank = [(7, t, "user", " ", "", "") for t in range(100)]
    want = {k: plain_repair(v) for k, v in plain_damage([x[:4] for x in blank]).items()}
    assert repaired(spark.createDataFrame(blank, CHAT), rows_per_chunk=20) == want


def test_reruns_stop_where_runs_differ_by_a_constant():
    r = random.Random(5)
    for _ in range(200):
        kinds = [r.choice("suaxSUAX") for _ in range(r.randint(0, 30))]
        known, end = (conversations.backward([r.choice("uaxs") for _ in range(r.randint(0, 5))], conversations.END)[0][0] for _ in range(2))
        vectors, total = conversations.backward(kinds, known)
        want, full = conversations.backward(kinds, end)
        assert conversations.rerun(kinds, end, known, vectors[0], total) == (want[0], full)


def test_dropped_conversations_and_no_rows(spark):
    gone = next(c for c in itertools.count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.", "", "")], CHAT)
    empty = hashlib.sha256(b"").hexdigest()
    assert repaired(df) == {gone: (0, 0, 0, 0, 0, 0, "", empty)}
    assert repaired(df, rows_per_chunk=0) == {gone: (0, 0, 0, 0, 0, 0, "", empty)}
    assert repaired(df.limit(0)) == {}


@given
def test_op13(spark):
    got = entry.queries()["op13_conversations"](spark, DATA).collect()
    want = plain_damage(rows("conversations", "conv_id, turn, role, text"))
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == {k: plain_repair(v) for k, v in want.items()}
