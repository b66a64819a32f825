"""Order-dependent operators that hold up when one key has most of the rows.

A plain window sends all rows of a key to one task. Here a key with more than ``rows_per_block``
rows is cut into blocks of consecutive row numbers, evenly between its lowest and its highest one, so
there are as many blocks as its rows ask for, however far apart the numbers are. Each block is worked
on alone, a one-row summary per block is carried over the blocks of its key, and the two are put
together. A task sees about ``rows_per_block`` rows of one key where numbers are spread evenly, and the
block summaries of one key.

Row numbers are integers, unique within a key; keys are not null. ``bounded=True`` is for rows whose
key cannot be large, such as the lines of one text value; they go through one plain window.

The input is read three times (rows per key, summaries of large keys, the rows themselves), each time
with only the columns needed. Give it a table, or a frame made durable, not a long computation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 1_000_000
#: Keys that are split, those with most rows: any other has less than that share of all rows.
MOST_KEYS = 100_000
LARGE = "_large"
BLOCK = "_block"


def split_blocks(
    df: DataFrame,
    keys: Sequence[str],
    row_no: str,
    rows_per_block: int = ROWS_PER_BLOCK,
    bounded: bool = False,
) -> DataFrame:
    """Mark the rows of large keys and give them their block; all other rows are in block 0."""
    if bounded:
        return df.withColumns({LARGE: F.lit(False), BLOCK: F.lit(0).cast("long")})
    low, high = F.col("_low").cast("long"), F.col("_high").cast("long")
    width = F.ceil((high - low + 1) * (F.lit(rows_per_block) / F.col("_rows"))).cast("long")
    # At most MOST_KEYS rows are broadcast.
    large = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"), F.min(row_no).alias("_low"), F.max(row_no).alias("_high"))
        .where(F.col("_rows") > rows_per_block)
        .orderBy(F.col("_rows").desc(), *keys)
        .limit(MOST_KEYS)
        .select(*keys, low.alias("_low"), F.greatest(F.lit(1), width).alias("_width"))
    )
    return (
        df.join(F.broadcast(large), list(keys), "left")
        .withColumn(LARGE, F.col("_width").isNotNull())
        .withColumn(
            BLOCK, F.coalesce(F.expr(f"(`{row_no}` - _low) div _width"), F.lit(0).cast("long"))
        )
        .drop("_low", "_width")
    )


def scan(
    df: DataFrame,
    keys: Sequence[str],
    row_no: str,
    *,
    sums: Mapping[str, Column] | None = None,
    mins: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
    bounded: bool = False,
) -> DataFrame:
    """Add running sums, minima and last non-null values per key, up to and with each row.

    ``sums``, ``mins`` and ``lasts`` map output names to expressions over ``df``; an output may
    replace a column of ``df``.
    """
    sums, mins, lasts = dict(sums or {}), dict(mins or {}), dict(lasts or {})
    keep = [c for c in df.columns if c not in {*sums, *mins, *lasts}]
    s_in = {name: f"_s{i}" for i, name in enumerate(sums)}
    m_in = {name: f"_m{i}" for i, name in enumerate(mins)}
    l_in = {name: f"_l{i}" for i, name in enumerate(lasts)}
    work = df.select(
        *keep,
        *[F.coalesce(e, F.lit(0)).alias(s_in[n]) for n, e in sums.items()],
        *[e.alias(m_in[n]) for n, e in mins.items()],
        *[e.alias(l_in[n]) for n, e in lasts.items()],
    )
    blocked = split_blocks(work, keys, row_no, rows_per_block, bounded)

    group = [*keys, LARGE, BLOCK]
    upto = (
        Window.partitionBy(*(keys if bounded else group))
        .orderBy(row_no)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = blocked.select(
        *keep,
        LARGE,
        BLOCK,
        *[F.sum(c).over(upto).alias(c) for c in s_in.values()],
        *[F.min(c).over(upto).alias(c) for c in m_in.values()],
        *[F.last(c, ignorenulls=True).over(upto).alias(c) for c in l_in.values()],
    )
    if bounded:
        outputs = {**s_in, **m_in, **l_in}
        return local.select(*keep, *[F.col(c).alias(n) for n, c in outputs.items()])

    before = (
        Window.partitionBy(*keys, LARGE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    summary = (
        blocked.where(F.col(LARGE))
        .groupBy(*group)
        .agg(
            *[F.sum(c).alias(c) for c in s_in.values()],
            *[F.min(c).alias(c) for c in m_in.values()],
            *[
                F.max_by(c, F.when(F.col(c).isNotNull(), F.col(row_no))).alias(c)
                for c in l_in.values()
            ],
        )
    )
    carry = summary.select(
        *group,
        *[F.sum(c).over(before).alias(c + "_carry") for c in s_in.values()],
        *[F.min(c).over(before).alias(c + "_carry") for c in m_in.values()],
        *[F.last(c, ignorenulls=True).over(before).alias(c + "_carry") for c in l_in.values()],
    )

    return local.join(carry, group, "left").select(
        *keep,
        *[
            (F.col(c) + F.coalesce(F.col(c + "_carry"), F.lit(0))).alias(n)
            for n, c in s_in.items()
        ],
        *[F.least(c, c + "_carry").alias(n) for n, c in m_in.items()],
        *[F.coalesce(F.col(c), F.col(c + "_carry")).alias(n) for n, c in l_in.items()],
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    row_no: str,
    out: str,
    *,
    rows_per_block: int = ROWS_PER_BLOCK,
    bounded: bool = False,
) -> DataFrame:
    """Number the rows of each key 1, 2, 3 … in ``row_no`` order."""
    return scan(
        df,
        keys,
        row_no,
        sums={out: F.lit(1).cast("long")},
        rows_per_block=rows_per_block,
        bounded=bounded,
    )


def merge_spans(
    df: DataFrame,
    keys: Sequence[str],
    row_no: str,
    columns: Sequence[str],
    *,
    min_rows: int = 2,
    rows_per_block: int = ROWS_PER_BLOCK,
    bounded: bool = False,
) -> DataFrame:
    """Runs of equal neighbours in each column: (keys, column_no, column, value, first, last, rows).

    Null equals null. Runs are found block by block; only runs that touch the edge of a block are
    compared across blocks.
    """
    blocked = split_blocks(df.select(*keys, row_no, *columns), keys, row_no, rows_per_block, bounded)
    group = [*keys, LARGE, BLOCK]
    order = Window.partitionBy(*group).orderBy(row_no)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    changed = blocked.select(
        *group,
        row_no,
        *columns,
        *[
            F.when((F.row_number().over(order) > 1) & F.lag(c).over(order).eqNullSafe(F.col(c)), 0)
            .otherwise(1)
            .alias(f"_c{i}")
            for i, c in enumerate(columns)
        ],
    )
    runs = changed.select(
        *group,
        row_no,
        *columns,
        *[F.sum(f"_c{i}").over(upto).alias(f"_r{i}") for i in range(len(columns))],
    )
    cells = runs.select(
        *group,
        row_no,
        F.posexplode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.col(c).cast("string").alias("value"),
                        F.col(f"_r{i}").alias("run"),
                    )
                    for i, c in enumerate(columns)
                ]
            )
        ).alias("column_no", "_cell"),
    ).select(*group, row_no, "column_no", "_cell.column", "_cell.value", "_cell.run")
    partial = cells.groupBy(*group, "column_no", "column", "run").agg(
        F.first("value").alias("value"),
        F.min(row_no).alias("first_row"),
        F.max(row_no).alias("last_row"),
        F.count(F.lit(1)).alias("rows"),
    )
    last_run = F.max("run").over(Window.partitionBy(*group, "column_no", "column"))
    partial = partial.withColumn("_head", F.col("run") == 1).withColumn("_tail", F.col("run") == last_run)

    out = [*keys, "column_no", "column", "value", "first_row", "last_row", "rows"]
    if bounded:
        return partial.select(*out).where(F.col("rows") >= min_rows)
    at_edge = F.col("_head") | F.col("_tail")
    inner = partial.where(~F.col(LARGE) | ~at_edge).select(*out)

    cell_key = [*keys, "column_no", "column"]
    edge_order = Window.partitionBy(*cell_key).orderBy("first_row")
    joins_previous = (
        F.col("_head")
        & F.lag("_tail", 1, False).over(edge_order)
        & F.lag("value").over(edge_order).eqNullSafe(F.col("value"))
    )
    stitched = (
        partial.where(F.col(LARGE))
        .where(at_edge)
        .withColumn("_new", F.when(joins_previous, 0).otherwise(1))
        .withColumn(
            "_span",
            F.sum("_new").over(edge_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        )
        .groupBy(*cell_key, "_span")
        .agg(
            F.first("value").alias("value"),
            F.min("first_row").alias("first_row"),
            F.max("last_row").alias("last_row"),
            F.sum("rows").alias("rows"),
        )
        .select(*out)
    )
    return inner.unionByName(stitched).where(F.col("rows") >= min_rows)
