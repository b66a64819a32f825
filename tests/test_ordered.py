"""Ordered operators against plain Python, with blocks small enough that keys span many."""

import random

import pytest
from pyspark.sql import functions as F

from lexline.operators import ordered
from lexline.operators.chunking import token_budget
from lexline.operators.joins import salted_join


def skewed(seed, n=400, step=1):
    """Rows (key, row_no, a, b, n); key 0 has most of them, numbers are shared by all keys."""
    rng = random.Random(seed)
    return [
        (
            0 if rng.random() < 0.6 else rng.randint(1, 5),
            i * step,
            rng.choice(["x", "y", None]),
            rng.choice(["p", None, None, None]),
            rng.randint(0, 9),
        )
        for i in range(n)
    ]


SCHEMA = "k int, row_no long, a string, b string, n int"


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("seed,block,step", [(1, 7, 1), (2, 64, 3), (3, 1, 1), (4, 10_000, 1)])
def test_scan(spark, seed, block, step):
    rows = skewed(seed, step=step)
    got = ordered.scan(
        spark.createDataFrame(rows, SCHEMA).repartition(5),
        ["k"],
        "row_no",
        sums={"total": F.col("n"), "idx": F.lit(1)},
        mins={"least": F.col("n")},
        lasts={"a": F.col("a"), "b": F.col("b")},
        rows_per_block=block,
    ).collect()
    want = {}
    for k, group in by_key(rows).items():
        total, a, b, least = 0, None, None, 10
        for i, r in enumerate(group, start=1):
            total, least = total + r[4], min(least, r[4])
            a, b = (r[2] or a), (r[3] or b)
            want[k, r[1]] = (total, i, a, b, least)
    assert {(r.k, r.row_no): (r.total, r.idx, r.a, r.b, r.least) for r in got} == want


def spans_of(rows, col):
    out = []
    for k, group in by_key(rows).items():
        start = 0
        for i in range(1, len(group) + 1):
            if i == len(group) or group[i][col] != group[start][col]:
                if i - start > 1:
                    out.append((k, group[start][col], group[start][1], group[i - 1][1], i - start))
                start = i
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,block", [(1, 3), (2, 2), (3, 1), (4, 50), (5, 10_000)])
def test_merge_spans(spark, seed, block):
    rows = skewed(seed)
    got = ordered.merge_spans(
        spark.createDataFrame(rows, SCHEMA).repartition(3), ["k"], "row_no", ["a", "b"], rows_per_block=block
    ).collect()
    for name, col in (("a", 2), ("b", 3)):
        found = [(r.k, r.value, r.first_row, r.last_row, r.rows) for r in got if r.column == name]
        assert sorted(found, key=str) == spans_of(rows, col)


def test_spans_rebuild_the_column(spark):
    rows = skewed(9)
    spans = ordered.merge_spans(
        spark.createDataFrame(rows, SCHEMA), ["k"], "row_no", ["a"], min_rows=1, rows_per_block=11
    ).collect()
    for r in rows:
        hits = [s for s in spans if s.k == r[0] and s.first_row <= r[1] <= s.last_row]
        assert [h.value for h in hits] == [r[2]]


def test_bounded_gives_the_same(spark):
    df = spark.createDataFrame(skewed(6), SCHEMA)
    outs = [
        ordered.scan(df, ["k"], "row_no", lasts={"b": F.col("b")}, **kw)
        for kw in ({"bounded": True}, {"rows_per_block": 5})
    ]
    assert sorted(map(tuple, outs[0].collect()), key=str) == sorted(map(tuple, outs[1].collect()), key=str)
    spans = [
        ordered.merge_spans(df, ["k"], "row_no", ["a", "b"], **kw).collect()
        for kw in ({"bounded": True}, {"rows_per_block": 5})
    ]
    assert sorted(map(str, spans[0])) == sorted(map(str, spans[1]))


@pytest.mark.parametrize("parts", [1, 17])
def test_partition_independence(spark, parts):
    df = spark.createDataFrame(skewed(8), SCHEMA).repartition(parts)
    got = ordered.number_rows(df, ["k"], "row_no", "i", rows_per_block=9)
    per_key = got.groupBy("k").agg(F.min("i"), F.max("i"), F.count("i"), F.countDistinct("i")).collect()
    assert all(r[1] == 1 and r[2] == r[3] == r[4] for r in per_key)


def test_no_task_gets_a_whole_large_key(spark):
    """The window over a large key works on its blocks."""
    n, block = 20_000, 500
    df = spark.range(n).select(F.lit(0).alias("k"), F.col("id").alias("row_no"))
    blocks = ordered.split_blocks(df, ["k"], "row_no", block).groupBy("k", ordered.BLOCK).count()
    assert blocks.agg(F.max("count")).first()[0] == block and blocks.count() == n // block


def test_token_budget(spark):
    rows = [("s", i, "w " * 5) for i in range(100)] + [("t", i, "one") for i in range(3)]
    df = spark.createDataFrame(rows, "s string, i long, text string")
    got = token_budget(df, ["s"], "i", "text", budget=42, rows_per_block=4).collect()
    assert sorted((r.s, r.i) for r in got) == [("s", i) for i in range(9)] + [("t", i) for i in range(3)]


@pytest.mark.parametrize("how,per_salt", [("left", 3), ("inner", 10), ("left", 100_000)])
def test_salted_join(spark, how, per_salt):
    df = spark.createDataFrame(skewed(5), SCHEMA)
    lookup = spark.createDataFrame([(0, "zero"), (1, "one"), (1, "uno"), (9, "nine")], "k int, word string")
    got = salted_join(df, lookup, ["k"], ["row_no"], how, per_salt)
    want = df.join(lookup, "k", how)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_blocks_of_sparse_row_numbers(spark):
    df = spark.range(1_000).select(F.lit("k").alias("k"), (F.col("id") * 1_000_000 - 7).alias("row_no"))
    sizes = [r["count"] for r in ordered.split_blocks(df, ["k"], "row_no", 100).groupBy(ordered.BLOCK).count().collect()]
    assert 10 <= len(sizes) <= 11 and max(sizes) <= 101
    got = ordered.number_rows(df, ["k"], "row_no", "i", rows_per_block=100).orderBy("row_no").collect()
    assert [r["i"] for r in got] == list(range(1, 1_001))
