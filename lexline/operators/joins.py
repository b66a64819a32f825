"""Joins whose key may be shared by most rows of one side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexline.operators.ordered import MOST_KEYS, ROWS_PER_BLOCK

SALT = "_salt"
#: Rows of one key that are joined with each other at once, and left rows that travel as one.
LEFT_PER_BLOCK, RIGHT_PER_BLOCK, LEFT_PER_PACK = 100_000, 4_000, 1_000


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    rows_per_salt: int = ROWS_PER_BLOCK,
    counts: DataFrame | None = None,
    strategy: str | None = None,
) -> DataFrame:
    """Join ``rows`` with a lookup side so that no task gets all rows of a frequent key.

    A key with more than ``rows_per_salt`` rows is split by a hash of the ``spread`` columns, which
    together tell its rows apart, and its lookup rows are repeated once per split. The number of
    repeats over all keys is at most twice (rows / rows_per_salt). Other keys join as they are.
    ``counts`` (``on`` and ``n``) saves counting ``rows`` where the counts are known. ``strategy`` is a
    join hint: ``merge`` where a lookup row is long or shared by many rows, as a broadcast of ``rows`` would
    gather all that one lookup row gives.
    """
    if counts is None:
        counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    # At most MOST_KEYS rows are broadcast; a key left out has less than that share of all rows.
    frequent = (
        counts.where(F.col("n") > rows_per_salt)
        .orderBy(F.col("n").desc(), *on)
        .limit(MOST_KEYS)
        .select(*on, F.ceil(F.col("n") / F.lit(rows_per_salt)).cast("long").alias("_splits"))
    )
    splits = F.coalesce("_splits", F.lit(1).cast("long"))
    salted = (
        rows.join(F.broadcast(frequent), list(on), "left")
        .withColumn(SALT, F.pmod(F.xxhash64(*spread), splits))
        .drop("_splits")
    )
    repeated = (
        lookup.join(F.broadcast(frequent), list(on), "left")
        .withColumn(SALT, F.explode(F.sequence(F.lit(0).cast("long"), splits - F.lit(1))))
        .drop("_splits")
    )
    if strategy is not None:
        repeated = repeated.hint(strategy)
    return salted.join(repeated, [*on, SALT], how).drop(SALT)


def block_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_spread: Sequence[str],
    right_spread: Sequence[str],
    left_per_block: int = LEFT_PER_BLOCK,
    right_per_block: int = RIGHT_PER_BLOCK,
    left_per_pack: int = LEFT_PER_PACK,
) -> DataFrame:
    """Inner join on a key that many rows of both sides may share, so that one key gives very many rows.

    Both sides of such a key are cut into blocks by a hash of their ``spread`` columns, each row is
    repeated for the blocks of the other side, and each pair of blocks is joined alone. What is repeated is
    written and sorted, so it is kept small: rows of the left side, which should be the narrow one, travel
    in packs of about ``left_per_pack``, which meet the rows of a right block one by one and are taken
    apart behind the join; rows of the right side are repeated only for every ``left_per_block`` left
    ones. Pairs are dealt over all shuffle partitions, however small the input is, as the result is what
    takes time. Other keys join as they are.
    """
    spark = left.sparkSession
    # No other row equals a null key.
    for k in on:
        left, right = left.where(F.col(k).isNotNull()), right.where(F.col(k).isNotNull())
    sizes = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_l")).join(
        right.groupBy(*on).agg(F.count(F.lit(1)).alias("_r")), list(on)
    )
    packs_per_block = max(1, left_per_block // left_per_pack)
    packs = F.ceil(F.col("_l") / F.lit(left_per_pack)).cast("long")
    right_blocks = F.ceil(F.col("_r") / F.lit(right_per_block)).cast("long")
    # At most MOST_KEYS rows are broadcast, the keys that give most rows.
    frequent = F.broadcast(
        sizes.select(*on, (F.col("_l") * F.col("_r")).alias("_n"), packs.alias("_ps"), right_blocks.alias("_rs"))
        .where((F.col("_ps") > 1) | (F.col("_rs") > 1))
        .orderBy(F.col("_n").desc(), *on)
        .limit(MOST_KEYS)
        .drop("_n")
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one, nil = F.lit(1).cast("long"), F.lit(0).cast("long")
    key = [*on, "_lb", "_rb"]
    left_blocks = F.ceil(F.coalesce("_ps", one) / F.lit(packs_per_block)).cast("long")
    own = [c for c in left.columns if c not in on]
    packed = (
        left.join(frequent, list(on), "left")
        .withColumn("_lp", F.pmod(F.xxhash64(*left_spread), F.coalesce("_ps", one)))
        .groupBy(*on, "_lp", F.coalesce("_rs", one).alias("_rs"))
        .agg(F.collect_list(F.struct(*own)).alias("_pack"))
        .withColumn("_lb", F.floor(F.col("_lp") / F.lit(packs_per_block)).cast("long"))
        .withColumn("_rb", F.explode(F.sequence(nil, F.col("_rs") - one)))
        .drop("_lp", "_rs")
        .repartition(n, *key)
    )
    rows = (
        right.join(frequent, list(on), "left")
        .withColumn("_rb", F.pmod(F.xxhash64(*right_spread), F.coalesce("_rs", one)))
        .withColumn("_lb", F.explode(F.sequence(nil, left_blocks - one)))
        .drop("_ps", "_rs")
        .repartition(n, *key)
    )
    pairs = packed.join(rows.hint("merge"), key).drop("_lb", "_rb").withColumn("_row", F.explode("_pack"))
    others = [c for c in right.columns if c not in on]
    return pairs.select(*on, *[F.col("_row").getField(c).alias(c) for c in own], *others)
