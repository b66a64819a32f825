"""Generated texts to rows.

A response is one row (``doc_id, text``) with ``doc_id`` unique, so the lines of a document, and
with them every window over ``doc_id`` here, are bounded by the size of one text value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexline import constants as K
from lexline.functions import text as X
from lexline.operators.ordered import ROWS_PER_BLOCK, scan

# A line with two pipes makes a glossary response unusable.
_TWO_PIPES = "[|][^\n]*[|]"


def _carry(order: str = "pos"):
    return (
        Window.partitionBy("doc_id")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def rejected_responses(responses: DataFrame) -> DataFrame:
    """Documents with a term line of more than one pipe; they give no rows at all."""
    return responses.where(F.rlike("text", F.lit(_TWO_PIPES))).select(
        "doc_id", F.lit("more than one pipe in a line").alias("reason")
    )


def _glossary_lines(responses: DataFrame) -> DataFrame:
    """Non-blank lines of usable responses with their kind and stripped text."""
    line = F.col("line")
    body = X.strip(line)
    kind = (
        F.when(F.contains(line, F.lit("|")), "term")
        .when(F.contains(line, F.lit("Tablespace:")), "tablespace")
        .when(F.contains(line, F.lit("Table: ")), "table")
        .otherwise("description")
    )
    return (
        responses.where(~F.rlike("text", F.lit(_TWO_PIPES)))
        .select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("pos", "line"))
        .where(body != "")
        .select("doc_id", "pos", "line", body.alias("body"), kind.alias("kind"))
    )


def _term_cells(line: Column) -> tuple[Column, Column]:
    cells = F.split(line, "[|]")
    return X.strip(cells[0]), X.strip(cells[1])


def glossary_parse(responses: DataFrame) -> DataFrame:
    """Pipe glossary text to rows, each with the tablespace, table and description it stands under.

    Names keep the blank after their label. Any other line without a pipe is a description, the end
    mark included, and holds until the next one.
    """
    w = _carry()
    kind = F.col("kind")

    def carried(column: str) -> Column:
        return F.last(column, ignorenulls=True).over(w).alias(column)

    # Each line goes through the shuffle in one of these columns only.
    split = _glossary_lines(responses).select(
        "doc_id",
        "pos",
        F.when(kind == "tablespace", F.replace("body", F.lit("Tablespace:"), F.lit(""))).alias("tablespace"),
        F.when(kind == "table", F.replace("body", F.lit("Table:"), F.lit(""))).alias("table_name"),
        F.when(kind == "description", F.col("body")).alias("table_description"),
        F.when(kind == "term", F.col("line")).alias("line"),
    )
    term, definition = _term_cells(F.col("line"))
    return (
        split.select(
            "doc_id", "pos", "line", carried("tablespace"), carried("table_name"), carried("table_description")
        )
        .where(F.col("line").isNotNull())
        .select(
            "doc_id",
            "pos",
            "tablespace",
            "table_name",
            "table_description",
            term.alias("column_name"),
            definition.alias("definition"),
        )
        .where(F.lower("column_name") != "term")
    )


def glossary_markdown(responses: DataFrame) -> DataFrame:
    """Markdown lines of each usable response, in ``pos`` order."""
    term, definition = _term_cells(F.col("line"))
    kind = F.col("kind")
    return (
        _glossary_lines(responses)
        .where((kind != "term") | (F.lower(term) != "term"))
        .select(
            "doc_id",
            "pos",
            F.when(kind == "tablespace", F.concat(F.lit("\n### "), "body"))
            .when(kind == "table", F.concat(F.lit("\n#### "), "body"))
            .when(kind == "term", F.concat(F.lit("- **"), term, F.lit("**: "), definition))
            .otherwise(F.col("body"))
            .alias("text"),
        )
    )


def define_parse(responses: DataFrame) -> DataFrame:
    """``Table:`` / ``Description:`` / ``- column: text`` responses to rows.

    The last description of a table goes to all its columns; column lines without a colon or
    before any table are left out, as are tables without columns.
    """
    line = F.col("line")

    def after(label: str) -> Column:
        return X.strip(F.split(line, label)[1])

    kind = (
        F.when(F.startswith(line, F.lit("Table:")), "table")
        .when(F.startswith(line, F.lit("Description:")), "description")
        .when(F.startswith(line, F.lit("-")) & F.contains(line, F.lit(":")), "column")
    )
    in_table = Window.partitionBy("doc_id", "table_no")
    by_pos = in_table.orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    head = F.substring_index(line, ":", 1)
    tail = F.substring(line, F.instr(line, ":") + F.lit(1), F.length(line))
    return (
        responses.select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("pos", "line"))
        .withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .withColumn("table_no", F.sum(F.when(F.col("kind") == "table", 1).otherwise(0)).over(_carry()))
        .where(F.col("table_no") > 0)
        .select(
            "doc_id",
            "pos",
            "kind",
            "line",
            F.first(F.when(F.col("kind") == "table", after("Table:")), ignorenulls=True)
            .over(by_pos)
            .alias("table_name"),
            F.coalesce(
                F.last(
                    F.when(F.col("kind") == "description", after("Description:")), ignorenulls=True
                ).over(by_pos),
                F.lit(""),
            ).alias("table_description"),
        )
        .where(F.col("kind") == "column")
        .select(
            "doc_id",
            "pos",
            "table_name",
            "table_description",
            X.strip(F.btrim(head, F.lit("-"))).alias("column_name"),
            X.strip(tail).alias("column_description"),
        )
    )


def lineage_parse(responses: DataFrame) -> DataFrame:
    """Documentation tables to rows of 14 cells; ``row_no`` is the line in the text.

    Takes ``script_id, text``. The two header lines and lines without 14 or 15 pipes are skipped.
    A cell from the eighth on that is empty, not just blank, becomes ``S/B``.
    """
    cells = F.split("line", "[|]")

    def cell(i: int) -> Column:
        if i < 8:
            return X.strip(cells[i])
        return F.when(cells[i] == "", K.SAME_AS_ABOVE).otherwise(X.strip(cells[i]))

    return (
        responses.select("script_id", F.posexplode(X.lines(F.col("text"))).alias("row_no", "line"))
        .where((F.col("row_no") >= 2) & X.count_of(F.col("line"), "|").isin(14, 15))
        .select(
            "script_id",
            "row_no",
            *[cell(i + 1).alias(c) for i, c in enumerate(K.LINEAGE_COLUMNS)],
        )
    )


def fill_same_as_above(
    rows: DataFrame,
    keys: list[str],
    row_no: str,
    columns: list[str],
    rows_per_block: int = ROWS_PER_BLOCK,
    bounded: bool = False,
) -> DataFrame:
    """Replace ``S/B`` and null by the last other value above; ``N/A`` is a value like any other."""
    return scan(
        rows,
        keys,
        row_no,
        lasts={c: F.nullif(F.col(c), F.lit(K.SAME_AS_ABOVE)) for c in columns},
        rows_per_block=rows_per_block,
        bounded=bounded,
    )


def trim_partial_rows(responses: DataFrame) -> DataFrame:
    """Drop unfinished rows at the end of documentation tables.

    From the end, rows with less than 14 pipes go until a complete one is met; the two header lines
    stay. When a row met on the way holds the end mark the text is left as it is.
    """
    rows = X.lines(F.col("text"))

    def stop(row: Column, i: Column) -> Column:
        complete = X.count_of(row, "|") >= 14
        marked = F.contains(row, F.lit(K.END_MARK))
        return F.when((i >= 2) & (complete | marked), i)

    last = F.array_max(F.transform("_rows", stop))
    return (
        responses.withColumn("_rows", rows)
        .withColumn("_last", last)
        .withColumn(
            "text",
            F.when(
                F.contains(F.get("_rows", F.col("_last")), F.lit(K.END_MARK)), F.col("text")
            ).otherwise(
                F.array_join(
                    F.slice("_rows", F.lit(1), F.coalesce(F.col("_last") + F.lit(1), F.lit(2))), "\n"
                )
            ),
        )
        .drop("_rows", "_last")
    )
