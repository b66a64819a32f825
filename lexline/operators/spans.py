"""Merged cells of written sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexline.operators.joins import salted_join
from lexline.operators.ordered import ROWS_PER_BLOCK, merge_spans, scan
from lexline.session import durable

#: Rows above the first data row of a written sheet.
HEADER_ROWS = 1


def glossary_spans(
    glossary: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    row_no: str = "row_no",
    rows_per_block: int = ROWS_PER_BLOCK,
    bounded: bool = False,
) -> DataFrame:
    """Rows over which the table description is merged: runs of one table name, none for null."""
    spans = merge_spans(
        glossary, keys, row_no, ["table_name"], rows_per_block=rows_per_block, bounded=bounded
    )
    return spans.where(F.col("value").isNotNull()).select(
        *keys, F.col("value").alias("table_name"), "first_row", "last_row", "rows"
    )


def sheet_rows(
    rows: DataFrame,
    sheet: str = "sheet_id",
    chunk: str = "chunk_no",
    pos: str = "pos",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add ``sheet_row``, the row of the written sheet, below the header, that each row has.

    The rows of a sheet come in chunks, one generated text each, and within a chunk in the order of
    ``pos``. How many rows the chunks before have is summed over the chunks of the sheet; within a
    chunk, rows are numbered by a plain window.
    """
    totals = rows.groupBy(sheet, chunk).agg(F.count(F.lit(1)).alias("_n"))
    upto = scan(durable(totals), [sheet], chunk, sums={"_upto": F.col("_n")}, rows_per_block=rows_per_block)
    before = upto.select(sheet, chunk, (F.col("_upto") - F.col("_n") + F.lit(HEADER_ROWS)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(sheet, chunk).orderBy(pos))
    numbered = rows.withColumn("_place", place)
    joined = salted_join(numbered, before, [sheet, chunk], [pos], "inner", rows_per_block, counts=totals.withColumnRenamed("_n", "n"))
    return joined.withColumn("sheet_row", (F.col("_before") + F.col("_place")).cast("long")).drop("_place", "_before")


def sheet_spans(
    rows: DataFrame,
    sheet: str = "sheet_id",
    chunk: str = "chunk_no",
    pos: str = "pos",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Rows of the written sheet over which a table's description is merged, whatever chunks they came in."""
    numbered = durable(sheet_rows(rows, sheet, chunk, pos, rows_per_block).select(sheet, "sheet_row", "table_name"))
    return glossary_spans(numbered, (sheet,), "sheet_row", rows_per_block)
