"""Schema sheets to lines, slices, chunks and batches of text; token budgets.

A sheet has ``sheet_id, schema_name, table_name, column_name, row_no``, with ``row_no`` unique
within a sheet. Schemas and tables come in first-seen order. Texts are given as rows of at most 36
columns, so a table of any width and a sheet of any length never become one value.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexline import constants as K
from lexline.functions import text as X
from lexline.operators.joins import salted_join
from lexline.operators.ordered import ROWS_PER_BLOCK, number_rows, scan
from lexline.session import durable

SCHEMA_KEY = ["sheet_id", "schema_name"]
TABLE_KEY = [*SCHEMA_KEY, "table_name"]
TABLES_PER_BLOCK = 256


def _tables(sheet: DataFrame) -> DataFrame:
    """One row per table of the sheet, made durable as numbering reads it several times."""
    return durable(
        sheet.groupBy(*TABLE_KEY).agg(
            F.min("row_no").alias("table_row"), F.count(F.lit(1)).alias("n_columns")
        )
    )


def _numbered(tables: DataFrame, rows_per_block: int) -> DataFrame:
    return scan(
        tables,
        SCHEMA_KEY,
        "table_row",
        sums={"table_no": F.lit(1).cast("long")},
        mins={"schema_row": F.col("table_row")},
        rows_per_block=rows_per_block,
    )


def sheet_tables(sheet: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Tables with first row, column count, number within their schema (from 1), schema's first row."""
    return _numbered(_tables(sheet), rows_per_block)


def column_lines(sheet: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Lines of 12 column names of each table: ``line_no`` from 0 and the joined names."""
    numbered = number_rows(sheet, TABLE_KEY, "row_no", "_idx", rows_per_block=rows_per_block)
    line = F.floor((F.col("_idx") - F.lit(1)) / F.lit(K.COLUMNS_PER_LINE)).cast("long")
    return (
        numbered.withColumn("line_no", line)
        .groupBy(*TABLE_KEY, "line_no")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("_idx", "column_name"))),
                    lambda s: s["column_name"],
                ),
                ", ",
            ).alias("columns")
        )
    )


def schema_text(sheet: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Column lines with the place of each line in the sheet's text.

    Order by ``schema_row, table_no, line_no`` to read the text. ``text`` ends with a comma on all
    lines of a table but its last.
    """
    last_line = F.floor((F.col("n_columns") - F.lit(1)) / F.lit(K.COLUMNS_PER_LINE))
    tables = _tables(sheet)
    placed = salted_join(
        column_lines(sheet, rows_per_block),
        _numbered(tables, rows_per_block),
        TABLE_KEY,
        ["line_no"],
        "inner",
        rows_per_block,
        counts=tables.select(*TABLE_KEY, (last_line + F.lit(1)).alias("n")),
    )
    return placed.select(
        *TABLE_KEY,
        "schema_row",
        "table_no",
        "line_no",
        F.concat("columns", F.when(F.col("line_no") < last_line, ",").otherwise("")).alias("text"),
    )


def schema_chunks(
    sheet: DataFrame,
    tables_per_chunk: int = K.TABLES_PER_CHUNK,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Column lines with the chunk of their table; the schema is named in its first chunk only."""
    chunk = F.floor((F.col("table_no") - F.lit(1)) / F.lit(tables_per_chunk)).cast("long")
    return schema_text(sheet, rows_per_block).select(
        *TABLE_KEY,
        chunk.alias("chunk_no"),
        "table_no",
        "line_no",
        ((chunk == 0) & (F.col("table_no") == 1) & (F.col("line_no") == 0)).alias("schema_header"),
        "text",
    )


def _sections(rows: DataFrame, columns_title: str, schema_end: str, header: Column) -> DataFrame:
    """``schema_text`` rows with the titles of schema and table in the text of their first line."""
    schema = F.when(header, F.concat(F.lit("\nSCHEMA: "), "schema_name", F.lit(schema_end))).otherwise("")
    table = F.when(F.col("line_no") == 0, F.concat(F.lit("\nTable: "), "table_name", F.lit(columns_title))).otherwise("")
    return rows.withColumn("text", F.concat(schema, table, "text", F.lit("\n")))


def sheet_sections(sheet: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Pieces of a sheet's whole text, with a title for each schema and table.

    Put together in the order of ``schema_row, table_no, line_no`` within a sheet, without anything between
    them, they are the text. For a sheet without column names see ``table_sections``.
    """
    first = (F.col("table_no") == 1) & (F.col("line_no") == 0)
    return _sections(schema_text(sheet, rows_per_block), "\nColumns:\n", "", first)


def table_sections(sheet: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``sheet_sections`` of a sheet that names schemas and tables alone: one piece per table, no columns."""
    schema = F.when(F.col("table_no") == 1, F.concat(F.lit("\nSCHEMA: "), "schema_name")).otherwise("")
    return sheet_tables(sheet, rows_per_block).select(
        *TABLE_KEY,
        "schema_row",
        "table_no",
        F.lit(0).cast("long").alias("line_no"),
        F.concat(schema, F.lit("\nTable: "), "table_name").alias("text"),
    )


def chunk_sections(
    sheet: DataFrame, tables_per_chunk: int = K.TABLES_PER_CHUNK, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """``schema_chunks`` with the titles in the text: the pieces of a chunk, put together in the order of
    ``table_no, line_no``, are its text."""
    return _sections(schema_chunks(sheet, tables_per_chunk, rows_per_block), "\nColumns: ", "\n", F.col("schema_header"))


def table_slices(sheet: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Slices of 36 columns of each table as text, ``slice_no`` from 0."""
    numbered = number_rows(sheet, TABLE_KEY, "row_no", "_idx", rows_per_block=rows_per_block)
    per_slice = K.COLUMNS_PER_LINE * K.LINES_PER_SLICE
    last_line = F.floor((F.size("_names") - F.lit(1)) / F.lit(K.COLUMNS_PER_LINE)).cast("int")
    lines = F.transform(
        F.sequence(F.lit(0), last_line),
        lambda i: F.array_join(
            F.slice("_names", i * F.lit(K.COLUMNS_PER_LINE) + F.lit(1), F.lit(K.COLUMNS_PER_LINE)), ", "
        ),
    )
    return (
        numbered.withColumn(
            "slice_no", F.floor((F.col("_idx") - F.lit(1)) / F.lit(per_slice)).cast("long")
        )
        .groupBy(*TABLE_KEY, "slice_no")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_idx", "column_name"))),
                lambda s: s["column_name"],
            ).alias("_names")
        )
        .select(
            *TABLE_KEY,
            "slice_no",
            F.concat(
                F.lit("\nTable: "),
                "table_name",
                F.lit("\nColumns: "),
                F.array_join(lines, ",\n"),
                F.lit("\n"),
            ).alias("text"),
        )
    )


def _held_after(held: Column, n: Column, chunk_size: int) -> Column:
    """Slices held after a table, with everything above ``chunk_size`` the same state."""
    started = F.when(held > chunk_size, F.lit(0)).otherwise(held)
    return F.least(started + n, F.lit(chunk_size + 1)).cast("int")


def chunk_numbers(
    tables: DataFrame,
    chunk_size: int = 1,
    tables_per_block: int = TABLES_PER_BLOCK,
) -> DataFrame:
    """Number the chunk of each table within its schema, from 0.

    A chunk is closed before a table once it holds more than ``chunk_size`` slices. The count of
    held slices has ``chunk_size + 2`` states that matter, so a block of tables is a small map from
    entry state to exit state and closed chunks. Blocks are mapped in parallel, the maps are
    followed in block order, and each block is then numbered from its known entry state.
    """
    width = K.COLUMNS_PER_LINE * K.LINES_PER_SLICE
    n_slices = F.ceil(F.col("n_columns") / F.lit(width)).cast("int")
    block = F.floor((F.col("table_no") - F.lit(1)) / F.lit(tables_per_block)).cast("long")
    blocks = (
        tables.select(*TABLE_KEY, "table_no", n_slices.alias("n"), block.alias("block"))
        .groupBy(*SCHEMA_KEY, "block")
        .agg(F.array_sort(F.collect_list(F.struct("table_no", "n", "table_name"))).alias("ts"))
    )

    def run_block(entry: Column) -> Column:
        return F.aggregate(
            "ts",
            F.struct(entry.cast("int").alias("held"), F.lit(0).cast("long").alias("closed")),
            lambda acc, t: F.struct(
                _held_after(acc["held"], t["n"], chunk_size).alias("held"),
                (acc["closed"] + F.when(acc["held"] > chunk_size, 1).otherwise(0))
                .cast("long")
                .alias("closed"),
            ),
        )

    maps = blocks.select(
        *SCHEMA_KEY,
        "block",
        F.transform(F.sequence(F.lit(0), F.lit(chunk_size + 1)), run_block).alias("map"),
    ).select(
        *SCHEMA_KEY,
        "block",
        F.transform("map", lambda m: m["held"]).alias("held"),
        F.transform("map", lambda m: m["closed"]).alias("closed"),
    )

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        state, first, entries, firsts = 0, 0, [], []
        for held, closed in zip(pdf["held"], pdf["closed"]):
            entries.append(state)
            firsts.append(first)
            first += int(closed[state])
            state = int(held[state])
        return pdf[[*SCHEMA_KEY, "block"]].assign(entry=entries, first_chunk=firsts)

    id_type = dict(tables.dtypes)["sheet_id"]
    # One small row per block of tables: 1/256 of the tables of a schema at most in one task.
    entered = maps.groupBy(*SCHEMA_KEY).applyInPandas(
        follow,
        f"sheet_id {id_type}, schema_name string, block long, entry int, first_chunk long",
    )
    state = F.aggregate(
        "ts",
        F.struct(
            F.col("entry").alias("held"),
            F.col("first_chunk").alias("chunk"),
            F.expr("cast(array() as array<bigint>)").alias("out"),
        ),
        lambda acc, t: F.struct(
            _held_after(acc["held"], t["n"], chunk_size).alias("held"),
            (acc["chunk"] + F.when(acc["held"] > chunk_size, 1).otherwise(0)).cast("long").alias("chunk"),
            F.array_append(
                acc["out"],
                (acc["chunk"] + F.when(acc["held"] > chunk_size, 1).otherwise(0)).cast("long"),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return (
        blocks.join(entered, [*SCHEMA_KEY, "block"])
        .select(*SCHEMA_KEY, F.explode(F.arrays_zip(F.col("ts"), state.alias("chunk"))).alias("z"))
        .select(
            *SCHEMA_KEY,
            F.col("z.ts.table_name").alias("table_name"),
            F.col("z.ts.table_no").alias("table_no"),
            F.col("z.ts.n").cast("long").alias("n_slices"),
            F.col("z.chunk").alias("schema_chunk"),
        )
    )


def schema_batches(
    sheet: DataFrame,
    chunk_size: int = 1,
    batch_size: int = 1,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Slices of 36 columns with the chunk and batch of their table.

    Chunks are numbered over the whole sheet in schema order; the counter starts anew with each
    schema. Order by ``chunk_no, table_no, slice_no`` to read the texts; ``schema_header`` marks the
    slice that the schema's name stands before.
    """
    tables = durable(sheet_tables(sheet, rows_per_block))
    numbered = durable(chunk_numbers(tables, chunk_size))
    schemas = durable(
        tables.groupBy(*SCHEMA_KEY)
        .agg(F.min("table_row").alias("schema_row"))
        .join(
            numbered.groupBy(*SCHEMA_KEY).agg((F.max("schema_chunk") + F.lit(1)).alias("n_chunks")),
            SCHEMA_KEY,
        )
    )
    offsets = scan(
        schemas,
        ["sheet_id"],
        "schema_row",
        sums={"_upto": F.col("n_chunks")},
        rows_per_block=rows_per_block,
    ).select(*SCHEMA_KEY, (F.col("_upto") - F.col("n_chunks")).alias("_first"))
    placed = salted_join(
        numbered, offsets, SCHEMA_KEY, ["table_no"], "inner", rows_per_block
    ).select(*TABLE_KEY, "table_no", (F.col("_first") + F.col("schema_chunk")).alias("chunk_no"))
    return salted_join(
        table_slices(sheet, rows_per_block),
        placed,
        TABLE_KEY,
        ["slice_no"],
        "inner",
        rows_per_block,
        counts=numbered.select(*TABLE_KEY, F.col("n_slices").alias("n")),
    ).select(
        *TABLE_KEY,
        F.floor(F.col("chunk_no") / F.lit(batch_size)).cast("long").alias("batch_no"),
        "chunk_no",
        "table_no",
        "slice_no",
        ((F.col("table_no") == 1) & (F.col("slice_no") == 0)).alias("schema_header"),
        "text",
    )


def join_responses(responses: DataFrame, run: str = "run_id", number: str = "chunk_no") -> DataFrame:
    """Ordered pieces whose concatenation is the joined text of a run.

    ``prefix`` holds the separator that stands before each piece but the first of its run, whatever
    its number.
    """
    first = responses.groupBy(run).agg(F.min(number).alias("_first"))
    return salted_join(responses, first, [run], [number], "inner").select(
        run,
        number,
        F.when(F.col(number) == F.col("_first"), "").otherwise("  \n").alias("prefix"),
        "text",
    )


def token_budget(
    rows: DataFrame,
    keys: Sequence[str],
    row_no: str,
    text: str,
    budget: int = K.ANALYSIS_TOKENS,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Rows of each key while the tokens before them stay under the budget, without their texts.

    A round is started as long as the text so far is below the budget, so the row that crosses it
    is the last one kept. Texts are counted where they are read and take no part in the shuffle.
    """
    # Texts are read and counted once; the counts are read several times.
    counted = durable(rows.withColumn("n_tokens", X.token_count(F.col(text)).cast("long")).drop(text))
    total = scan(
        counted,
        keys,
        row_no,
        sums={"used_tokens": F.col("n_tokens")},
        rows_per_block=rows_per_block,
    )
    return total.where(F.col("used_tokens") - F.col("n_tokens") < budget)


def drop_leading_rows(
    rows: DataFrame,
    keys: Sequence[str],
    row_no: str,
    used_tokens: str,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Leave out leading documentation rows when a diagram's budget runs low.

    ``used_tokens`` is the total of each key. With less than 6,000 tokens left, one row per 100 tokens
    short of the reserve is dropped from the front, unless that would leave none. Where the budget
    is used up there is no further round and nothing is dropped.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    numbered = number_rows(rows, keys, row_no, "_idx", rows_per_block=rows_per_block)
    used = F.col(used_tokens)
    low = (used < K.DIAGRAM_TOKENS) & (F.lit(K.DIAGRAM_TOKENS) - used < K.DIAGRAM_LOW_WATER)
    short = ((F.lit(K.DIAGRAM_RESERVE_TOKENS) - used) / F.lit(100)).cast("long")
    drop = F.when(low & (F.col("n") > short), short).otherwise(F.lit(0))
    return (
        salted_join(numbered, sizes, keys, [row_no], "inner", rows_per_block, counts=sizes)
        .where(F.col("_idx") > drop)
        .drop("_idx", "n")
    )
