"""Mix sources to target weights: fit word budgets by subset sums over counts of lengths.

Documents are counted by source and exact length. A source's target says how often all of it is
taken (``base``) and which budget is left; a bounded knapsack over its lengths finds how many documents
of each length bring the sum nearest to that budget. Which ones is drawn by a hash of the seed and
the document, so that a rerun draws the same.

A source of W words has at most sqrt(2 W) lengths, so the counts of one source, the only rows that go
to one task together, stay few however many documents it has. To draw ``n`` of the documents of one
length, rows are sorted by (source, length, hash) over range partitions. Counts per partition give the
place of each partition's first row, so a source, or a length that most documents have, is spread over
as many tasks as its rows ask for.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexline.session import durable

#: Words of budget that are always left to the knapsack, and its most cells. Documents of more than a
#: quarter of the cells are placed by length from above instead.
MARGIN, CELLS = 1 << 16, 4 << 20

#: Place of a row in the whole sort of its partition, below the partition's number.
LOCAL_BITS = 33


def n_words(text: Column) -> Column:
    """How many runs of other characters than space, tab, line ends and the like; null has none."""
    marked = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.regexp_replace(marked, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def sized(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    """(doc_id, source, size, u): ``u`` is drawn from the seed and the document alone. A source is
    marked by ``=`` in front, no source is the empty text, so that equality holds for both."""
    return docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("source"),
        n_words(F.col(text).cast("string")).alias("size"),
        F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("u"),
        F.monotonically_increasing_id().alias("row"),
    )


def numbered(rows: DataFrame, order: list, out: str) -> DataFrame:
    """``rows`` with their place from 0 in a sort by ``order``, over all partitions."""
    local = F.lit((1 << LOCAL_BITS) - 1)
    held = durable(rows.orderBy(*order).withColumn(out, F.monotonically_increasing_id()))
    part = F.shiftright(out, LOCAL_BITS)
    # One row for each partition of the sort.
    counts = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    before = counts.select("_part", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"))
    placed = held.join(F.broadcast(before), part == F.col("_part"))
    return placed.withColumn(out, F.col(out).bitwiseAND(local) + F.col("_before")).drop("_part", "_before")


def targets(sources: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> DataFrame:
    """``sources`` (source, source_size) with ``target``.

    ``share`` (a fraction) of all sizes is dealt by weight; no target is above ``most`` times its
    source's size, and what is over goes to the others by weight. The level per weight at which all
    fits rises with each round, in which the sources below it are summed up; it is kept as two whole
    numbers.
    """
    no_source = F.col("source") == ""
    ranked = numbered(sources, [no_source, "source"], "no")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int"))
    rows = durable(ranked.withColumn("weight", weight.cast("long")))
    wide = "decimal(38,0)"
    up, down = share

    def summed(condition: Column) -> tuple[int, int, int]:
        r = rows.where(condition).agg(F.count("*"), F.sum(F.col("source_size").cast(wide)), F.sum("weight")).first()
        return r[0], int(r[1] or 0), int(r[2] or 0)

    _, whole, weight_of_all = summed(F.lit(True))
    level, per = up * whole, max(1, weight_of_all)  # target = weight * level / (per * down)
    limit = F.col("source_size").cast(wide) * most * down
    full, known = F.lit(False), 0
    while True:
        full = limit * F.lit(Decimal(per)).cast(wide) < F.col("weight") * F.lit(Decimal(level)).cast(wide)
        n, size, weight = summed(full)
        if n == known or weight == weight_of_all:
            break
        known, level, per = n, up * whole - most * down * size, weight_of_all - weight
    open_target = F.col("weight") * F.lit(float(level)) / F.lit(float(per * down))
    at_most = F.col("source_size").cast("double") * most
    return rows.select(
        "source", "source_size", F.when(full, at_most).otherwise(F.least(open_target, at_most)).alias("target")
    )


def nearest_sum(sizes: np.ndarray, counts: np.ndarray, goal: float) -> np.ndarray:
    """How often each size is used, at most ``counts`` times, for the sum nearest to ``goal``.

    Of two sums as near the lower one wins. A sum is first reached by the earliest size that can, with
    the fewest copies of it, from sums that earlier sizes reach.
    """
    used = np.zeros(len(sizes), np.int64)
    wanted = int(np.ceil(goal - 0.5))
    top = wanted + int(sizes.max(initial=0))
    reached, by, copies = np.zeros(top + 1, bool), np.full(top + 1, -1, np.int32), np.zeros(top + 1, np.int32)
    reached[0] = True
    for i, (size, count) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)):
        if reached[wanted]:
            break
        new, k = np.flatnonzero(reached), 0
        while len(new) and k < count:
            k += 1
            new = new[new <= top - size] + size
            new = new[~reached[new]]
            reached[new], by[new], copies[new] = True, i, k
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - goal))])
    while at:
        used[by[at]] += copies[at]
        at -= int(copies[at]) * int(sizes[by[at]])
    return used


def fit_budget(
    sizes: np.ndarray, counts: np.ndarray, target: float, most: int = 2, margin: int = MARGIN, cells: int = CELLS
) -> np.ndarray:
    """Copies of documents of each size, at most ``most`` times ``counts``, for about ``target`` words.

    All documents are taken as often as that fits. The budget left beyond ``margin`` is dealt evenly
    over them, so that the mix keeps the spread of lengths; what rounding leaves of it goes to the
    sizes that lost most. The rest, a little more than ``margin`` words, is fitted exactly by
    ``nearest_sum``. A source of few documents, where that misses, is fitted anew with any number of
    copies of each.
    """
    extra = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    if not total:
        return extra
    base = min(most, int(target // total))
    left = target - base * total
    small = sizes <= cells // 4
    margin = max(margin, 2 * int(sizes[small].max(initial=0)))
    even = counts * (max(0.0, left - margin) / total)
    extra = np.minimum(np.floor(even).astype(np.int64), counts)
    left -= float((sizes * extra).sum())
    # Sizes that lost most by rounding first, then the long ones, then all as often as they fit.
    lost, long = np.argsort(extra - even, kind="stable"), np.flatnonzero(~small)[::-1]
    for i, once in [*((i, True) for i in lost), *((i, False) for i in long), *((i, False) for i in lost)]:
        room = int((left - (margin if small[i] else 0)) // max(1, sizes[i]))
        n = max(0, min(room, int(counts[i] - extra[i]), 1 if once else room))
        if sizes[i]:
            extra[i] += n
            left -= n * float(sizes[i])
    items = lost[small[lost] & (sizes[lost] > 0) & (counts[lost] > extra[lost])]
    if len(items):
        extra[items] += nearest_sum(sizes[items], (counts - extra)[items], left)
    copies = base * counts + extra
    missed = abs(int((sizes * copies).sum()) - target)
    if missed > 0.5 and target <= cells:
        used = nearest_sum(sizes[sizes > 0], most * counts[sizes > 0], target)
        if abs(int((sizes[sizes > 0] * used).sum()) - target) < missed:
            copies[sizes > 0] = used
    return copies


def budgets(lengths: DataFrame, most: int = 2, margin: int = MARGIN, cells: int = CELLS) -> DataFrame:
    """(source, size, base, extra) from rows (source, size, n, target): all documents of a length are
    taken ``base`` times, ``extra`` of them once more."""

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", kind="stable")
        sizes, counts = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        copies = fit_budget(sizes, counts, float(group["target"].iloc[0]), most, margin, cells)
        return pd.DataFrame(
            {"source": group["source"], "size": sizes, "base": copies // counts, "extra": copies % counts}
        )

    return lengths.groupBy("source").applyInPandas(plan, "source string, size long, base long, extra long")


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    seed: int = 12,
    margin: int = MARGIN,
    cells: int = CELLS,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row for each row of ``docs``.

    Sources, by code point with no source last, have ``weights`` in turn and share ``share`` (a
    fraction) of all words, see ``targets``; ``taken`` is ``copies`` times ``size``. A document is taken
    ``target div source_size`` times or once more, but in a source of few documents, where that misses
    its target, any number of times up to ``most``. A null or empty text has size 0 and takes 0. Rows that share an id, or have none, are taken each for itself;
    equal rows are alike, so any of them may be the one that is taken. Other columns are left aside;
    an empty table gives no rows.
    """
    rows = durable(sized(docs, key, text, source, seed))
    lengths = durable(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    totals = lengths.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size")
    )
    wanted = durable(targets(totals, weights, share, most))
    plan = durable(budgets(lengths.join(wanted, "source"), most, margin, cells))

    sort = ["source", "size", "u", "row"]
    sorted_rows = rows.repartitionByRange(*sort).withColumn("part", F.spark_partition_id())
    held = durable(sorted_rows)
    group = ["part", "source", "size"]
    counts = held.groupBy(*group).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    open_places = F.col("extra") - F.coalesce(F.col("before"), F.lit(0))
    quota = (
        counts.withColumn("before", F.sum("n").over(earlier))
        .join(plan, ["source", "size"])
        .join(wanted, "source")
        .select(*group, "base", "source_size", "target", open_places.alias("open"))
    )
    place = F.row_number().over(Window.partitionBy(*group).orderBy("u", "row"))
    copies = F.col("base") + (place <= F.col("open")).cast("long")
    return held.join(quota, group).select(
        "doc_id",
        F.when(F.col("source") != "", F.substring("source", 2, 2**31 - 1)).alias("source"),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (F.col("size") * copies).alias("taken"),
    )
