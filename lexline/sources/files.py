"""Sheets, scripts and glossaries from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexline import constants as K

_CSV = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def schema_sheet(spark: SparkSession, path: str, sheet_id: str = "sheet") -> DataFrame:
    """Schema sheet from CSV: ``Schema Name, Table Name[, Column Name], row_no``.

    Rows have no order of their own once a file is read in parts, so the sheet brings ``row_no``.
    """
    raw = spark.read.options(**_CSV).csv(path)
    column = F.col("`Column Name`") if "Column Name" in raw.columns else F.lit(None).cast("string")
    return raw.select(
        F.lit(sheet_id).alias("sheet_id"),
        F.col("`Schema Name`").alias("schema_name"),
        F.col("`Table Name`").alias("table_name"),
        column.alias("column_name"),
        F.col("row_no").cast("long").alias("row_no"),
    )


def glossary_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Four-column business glossary from CSV with ``row_no``."""
    raw = spark.read.options(**_CSV).csv(path)
    return raw.select(
        *[F.col(f"`{h}`").alias(c) for h, c in zip(K.SHEET_GLOSSARY_HEADERS, K.SHEET_GLOSSARY_COLUMNS)],
        F.col("row_no").cast("long").alias("row_no"),
    )


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Five-column glossary written by ``sinks.write_glossary``."""
    raw = spark.read.options(**_CSV).csv(path)
    extra = [F.col("row_no").cast("long").alias("row_no")] if "row_no" in raw.columns else []
    return raw.select(
        *[F.col(f"`{h}`").alias(c) for h, c in zip(K.GLOSSARY_HEADERS, K.GLOSSARY_COLUMNS)], *extra
    )


def decoded(content: Column) -> Column:
    """Text of file bytes: UTF-8 where they are valid, else UTF-16."""
    return F.when(F.is_valid_utf8(F.expr("cast(content as string)")), F.decode(content, "UTF-8")).otherwise(
        F.decode(content, "UTF-16")
    )


def script_corpus(spark: SparkSession, path: str, dialect: str) -> DataFrame:
    """All ``.sql`` and ``.txt`` files below a folder, one row each."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.{sql,txt}")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return files.select(
        F.col("path").alias("script_id"),
        "path",
        F.lit(dialect).alias("dialect"),
        decoded(F.col("content")).alias("text"),
    )
