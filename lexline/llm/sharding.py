"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows fall into blocks by a hash of their key. How many rows of a block go to each part of a shard
is drawn first, as counts: the matrix of a uniform permutation has the block sizes as row sums, the
part sizes as column sums, and hypergeometric entries. The blocks are halved again and again; each
half draws its column sums from those of the whole. Then the rows are permuted within a block, the
first so many go to the first part and so on, and each part permutes what it received. Part sizes
are known before any row moves, so places in a shard need no second count.

All of it is DataFrame functions. The matrix has ``blocks * shards * parts`` entries whatever the
number of rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexline.llm.common import uniform


def _let(f, **named: Column) -> Column:
    """``f`` of a struct of the named values, each worked out once."""
    values = F.struct(*[c.alias(name) for name, c in named.items()])
    return F.element_at(F.transform(F.array(values), f), 1)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` out of ``total`` items are ``marked``, by inversion of ``u``.

    Probabilities are summed from the mode upwards, then from it downwards, by the ratio of
    neighbours, over twelve standard deviations and a margin; beyond that lies less than a double
    can hold. Work grows with the standard deviation, not with the counts.
    """
    zero = F.lit(0).cast("long")

    def limits(p: Column) -> Column:
        total, marked, drawn = p["total"], p["marked"], p["drawn"]
        low, high = F.greatest(zero, drawn + marked - total), F.least(drawn, marked)
        middle = F.floor((drawn + 1) * ((marked + 1) / (total + 2).cast("double")))
        share = marked / F.greatest(total, F.lit(1)).cast("double")
        variance = drawn * share * (1 - share) * (total - drawn) / F.greatest(total - 1, F.lit(1))
        return _let(
            inverted,
            total=total,
            marked=marked,
            drawn=drawn,
            u=p["u"],
            low=low,
            high=high,
            mode=F.least(high, F.greatest(low, middle)),
            reach=F.ceil(12 * F.sqrt(variance)).cast("long") + 24,
        )

    def inverted(p: Column) -> Column:
        first, last = F.greatest(p["low"], p["mode"] - p["reach"]), F.least(p["high"], p["mode"] + p["reach"])
        down = F.when(first < p["mode"], F.sequence(p["mode"] - 1, first)).otherwise(
            F.array().cast("array<bigint>")
        )
        mode, marked, drawn = p["mode"], p["marked"], p["drawn"]
        others = p["total"] - marked - drawn  # with k: neither marked nor drawn

        def weight(k: Column, before: Column) -> Column:
            """Against the mode's, from that of the neighbour nearer to the mode."""
            rise = (marked - k + 1) * ((drawn - k + 1) / (k * (others + k)).cast("double"))
            fall = (k + 1) * ((others + k + 1) / ((marked - k) * (drawn - k)).cast("double"))
            nearer = F.when(k == mode - 1, F.lit(1.0)).otherwise(before)
            return F.when(k == mode, F.lit(1.0)).when(k > mode, before * rise).otherwise(nearer * fall)

        def add(s: Column, k: Column) -> Column:
            return _let(
                lambda w: F.struct(w["w"].alias("w"), (s["sum"] + w["w"]).alias("sum")), w=weight(k, s["w"])
            )

        def pick(s: Column, k: Column) -> Column:
            at = lambda w: F.when((s["at"] < 0) & (s["left"] < w["w"]), k).otherwise(s["at"])
            return _let(
                lambda w: F.struct(w["w"].alias("w"), (s["left"] - w["w"]).alias("left"), at(w).alias("at")),
                w=weight(k, s["w"]),
            )

        def found(q: Column) -> Column:
            whole = F.aggregate(
                q["order"], F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")), add, lambda s: s["sum"]
            )
            start = F.struct(
                F.lit(1.0).alias("w"), (p["u"] * whole).alias("left"), F.lit(-1).cast("long").alias("at")
            )
            at = F.aggregate(q["order"], start, pick, lambda s: s["at"])
            return _let(lambda r: F.when(r["at"] < 0, mode).otherwise(r["at"]), at=at)

        drawing = _let(found, order=F.concat(F.sequence(mode, last), down))
        return F.when(p["low"] >= p["high"], p["low"]).otherwise(drawing)

    return _let(limits, total=total, marked=marked, drawn=drawn, u=u)


def _sample(columns: Column, rows: Column, *seed: Column | int) -> Column:
    """Column sums of a uniform sample of ``rows`` rows out of rows with sums ``columns``."""
    start = F.struct(
        F.aggregate(columns, F.lit(0).cast("long"), lambda a, c: a + c).alias("total"),
        rows.cast("long").alias("left"),
        F.array().cast("array<bigint>").alias("out"),
    )

    def step(s: Column, c: Column) -> Column:
        got = hypergeometric(s["total"], c, s["left"], uniform(*seed, F.size(s["out"])))
        return _let(
            lambda g: F.struct(
                (s["total"] - c).alias("total"),
                (s["left"] - g["got"]).alias("left"),
                F.concat(s["out"], F.array(g["got"])).alias("out"),
            ),
            got=got,
        )

    return F.aggregate(columns, start, step, lambda s: s["out"])


def communication_matrix(
    spark: SparkSession, row_sums: list[int], column_sums: list[int], seed: int
) -> DataFrame:
    """(block, counts): a matrix with these sums as a uniform permutation makes it.

    The number of blocks is a power of two. Blocks below the sixteenth part of all are drawn in
    tasks of their own.
    """
    blocks, ends = len(row_sums), [0, *itertools.accumulate(row_sums)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    node = spark.range(1).select(
        F.lit(0).alias("low"), longs(ends).alias("ends"), longs(column_sums).alias("counts")
    )
    for level in range(blocks.bit_length() - 1):
        half = blocks >> (level + 1)
        rows = F.element_at("ends", F.col("low") + half + 1) - F.element_at("ends", F.col("low") + 1)
        node = node.withColumn("left", _sample(F.col("counts"), rows, seed, level, F.col("low")))
        right = F.zip_with("counts", "left", lambda c, x: c - x)
        halves = F.array(
            F.struct(F.col("low"), F.col("left").alias("counts")),
            F.struct((F.col("low") + half).alias("low"), right.alias("counts")),
        )
        node = node.select("ends", F.explode(halves).alias("half")).select("ends", "half.*")
        if 2 << level == 16:
            node = node.repartitionByRange(16, "low")
    return node.select(F.col("low").alias("block"), "counts")


def shuffle_into_shards(
    df: DataFrame,
    key: str = "doc_id",
    shards: int = 16,
    *,
    blocks: int = 256,
    parts: int = 16,
    seed: int = 2017,
) -> DataFrame:
    """All rows of ``df`` with ``shard`` and ``slot``: shard sizes differ by one row at most, every
    arrangement is as likely, and slots run from 0 without gaps.

    Rows fall into blocks by a hash of ``key`` and all columns; equal rows take places of their
    own, null keys and null texts are values, no row gives no row. Columns of ``df`` named shard or
    slot are replaced. ``blocks`` is a power of two; a block and a part of a shard are what one
    task sorts, so at 100 TB take 4,096 blocks and 256 parts.
    """
    if blocks & (blocks - 1):
        raise ValueError("blocks must be a power of two")
    spark = df.sparkSession
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")]
    rows = df.select(F.struct(*kept).alias("row"))
    key_of = F.col("row").getField(key)
    # Of key and row, so that rows that share a key, or have none, fall into all blocks.
    block = F.pmod(F.xxhash64(F.lit(seed), key_of, "row"), F.lit(blocks)).cast("int")

    # One number a block comes to the driver.
    given = {r["block"]: r["n"] for r in rows.groupBy(block.alias("block")).agg(F.count("*").alias("n")).collect()}
    row_sums = [given.get(b, 0) for b in range(blocks)]
    n = sum(row_sums)
    in_shard = [(n + shards - 1 - s) // shards for s in range(shards)]
    column_sums = [(m + parts - 1 - p) // parts for m in in_shard for p in range(parts)]
    before = [sum(column_sums[i - i % parts : i]) for i in range(len(column_sums))]

    matrix = communication_matrix(spark, row_sums, column_sums, seed + 1)
    upto = F.transform(
        F.sequence(F.lit(1), F.lit(len(column_sums))),
        lambda i: F.aggregate(F.slice("counts", 1, i), F.lit(0).cast("long"), lambda a, c: a + c),
    )
    # blocks * shards * parts numbers: a bound that the parameters set.
    matrix = F.broadcast(matrix.select("block", upto.alias("upto")))

    def permuted(salt: int, *by: str):
        order = [F.xxhash64(F.lit(seed + salt), key_of), F.xxhash64(F.lit(seed + salt), "row")]
        return F.row_number().over(Window.partitionBy(*by).orderBy(*order))

    dealt = (
        rows.withColumn("block", block)
        .withColumn("n", permuted(2, "block"))
        .join(matrix, "block")
        # The column of a row: how many columns end before its place in the block.
        .select("row", F.size(F.filter("upto", lambda u: u < F.col("n"))).alias("column"))
    )
    first = F.array(*[F.lit(b).cast("long") for b in before])
    return dealt.withColumn("n", permuted(3, "column")).select(
        "row.*",
        F.floor(F.col("column") / parts).cast("int").alias("shard"),
        (F.element_at(first, F.col("column") + 1) + F.col("n") - 1).alias("slot"),
    )
