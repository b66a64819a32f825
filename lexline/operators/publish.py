"""Publishing: comment statements, glossary terms, glossaries, and their reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexline import constants as K
from lexline.functions import text as X
from lexline.operators.joins import salted_join
from lexline.operators.ordered import ROWS_PER_BLOCK
from lexline.session import durable


def _quoted_name(*parts: Column) -> Column:
    return F.concat_ws(
        ".", *[F.concat(F.lit("`"), F.replace(p, F.lit("`"), F.lit("``")), F.lit("`")) for p in parts]
    )


def comment_ddl(glossary: DataFrame, catalog: str | None, schemas: Sequence[str]) -> DataFrame:
    """Comment statements for a glossary with ``row_no``: one per table, one per column row.

    The first row of a table with a description that is not empty gives the table comment. A glossary without a
    description column has none.
    """
    if "table_description" not in glossary.columns:
        glossary = glossary.withColumn("table_description", F.lit(None).cast("string"))
    schema, table = X.resolve_table(F.col("table_name"), schemas)
    parts = ([F.lit(catalog)] if catalog else []) + [schema, table]
    named = glossary.select(
        "row_no",
        _quoted_name(*parts).alias("fq_table"),
        "table_description",
        "column_name",
        "definition",
    )

    def literal(text: Column) -> Column:
        return F.concat(F.lit("'"), X.sql_quote_body(text), F.lit("'"))

    tables = (
        named.where(F.coalesce("table_description", F.lit("")) != "")
        .groupBy("fq_table")
        .agg(F.min_by("table_description", "row_no").alias("d"), F.min("row_no").alias("row_no"))
        .select(
            F.lit("TABLE").alias("level"),
            "fq_table",
            F.lit(None).cast("string").alias("column_name"),
            "row_no",
            F.concat(F.lit("COMMENT ON TABLE "), "fq_table", F.lit(" IS "), literal(F.col("d"))).alias("ddl"),
        )
    )
    columns = named.where(
        F.col("column_name").isNotNull() & (F.coalesce("definition", F.lit("")) != "")
    ).select(
        F.lit("COLUMN").alias("level"),
        "fq_table",
        "column_name",
        "row_no",
        F.concat(
            F.lit("ALTER TABLE "),
            "fq_table",
            F.lit(" ALTER COLUMN "),
            _quoted_name(F.col("column_name")),
            F.lit(" COMMENT "),
            literal(F.col("definition")),
        ).alias("ddl"),
    )
    return tables.unionByName(columns)


_STATUS = "level string, fq_table string, column_name string, error string"


def _outcome(execute: Callable[[str], object], ddl: str) -> str | None:
    """Error text of a statement, null when it ran."""
    try:
        execute(ddl)
        return None
    except Exception as e:  # reported in the result, as the next statements still run
        return (str(e).splitlines() or [type(e).__name__])[0]


def apply_comments(
    ddl: DataFrame, connect: Callable[[], Callable[[str], object]], num_connections: int | None = None
) -> DataFrame:
    """Run comment statements on a server and return ``level, fq_table, column_name, error``.

    ``connect`` is called once per partition and gives a function that runs one statement. Setting
    a comment again changes nothing, so a task that is run twice does no harm.
    """
    if num_connections:
        ddl = ddl.repartition(num_connections, "fq_table", "row_no")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        execute = None
        for pdf in batches:
            execute = execute or connect()
            errors = [_outcome(execute, statement) for statement in pdf["ddl"]]
            yield pdf[["level", "fq_table", "column_name"]].assign(error=errors)

    return ddl.mapInPandas(run, _STATUS)


def apply_in_session(
    spark: SparkSession, ddl: DataFrame, path: str, rows_per_write: int = 10_000, run: str | None = None
) -> DataFrame:
    """Run comment statements on the session's own catalog, whose commands run on the driver.

    For a few statements; ``apply_comments`` runs any number of them in parallel. Statements come to
    the driver a partition at a time, and outcomes are written in pieces to a folder of this ``run``
    below ``path``, so that another run counts for itself.
    """
    held = []
    path = f"{path.rstrip('/')}/{run or uuid.uuid4().hex}"

    def flush() -> None:
        spark.createDataFrame(held, _STATUS).write.mode("append").parquet(path)
        held.clear()

    for row in ddl.toLocalIterator():
        held.append((row["level"], row["fq_table"], row["column_name"], _outcome(spark.sql, row["ddl"])))
        if len(held) == rows_per_write:
            flush()
    flush()
    return spark.read.parquet(path)


def publish_summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of done and failed rows; ``results`` has an ``error`` that is null on success.

    Of comments, column comments are counted as done and any as failed.
    """
    failed = F.col("error").isNotNull()
    done = ~failed & (F.col("level") == "COLUMN") if "level" in results.columns else ~failed
    return results.groupBy(*by).agg(
        F.count(F.when(done, 1)).alias("succeeded"), F.count(F.when(failed, 1)).alias("failed")
    )


def failure_lines(results: DataFrame) -> DataFrame:
    """One report line per failure: ``- table.column: error``."""
    return results.where(F.col("error").isNotNull()).select(
        F.concat(
            F.lit("- "),
            "fq_table",
            F.lit("."),
            F.coalesce("column_name", F.lit("[TABLE_DESC]")),
            F.lit(": "),
            "error",
        ).alias("line")
    )


def asset_lookup(assets: DataFrame) -> DataFrame:
    """One guid per normalised asset name; the later of two equal names wins."""
    return assets.groupBy(X.normalize_name(F.col("name")).alias("norm_name")).agg(
        F.max_by("guid", "pos").alias("table_guid")
    )


def asset_match(
    glossary: DataFrame,
    assets: DataFrame,
    spread: Sequence[str] = ("row_no",),
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add ``table_guid`` of the asset each row's table names, null when there is none.

    ``spread`` are columns that tell the rows of a table apart, as one table may have most rows.
    """
    named = glossary.withColumn("norm_name", X.normalize_name(F.col("table_name")))
    return salted_join(
        named, asset_lookup(assets), ["norm_name"], spread, "left", rows_per_block
    ).drop("norm_name")


def assign_terms(
    glossary: DataFrame,
    assets: DataFrame,
    existing: DataFrame,
    keys: Sequence[str] = ("glossary_guid",),
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Give every row a free term name, or a reason why it has none.

    ``glossary``: ``keys``, ``row_no`` (unique within the keys), ``table_name``, ``column_name``,
    ``definition``; ``assets`` as for ``asset_match``; ``existing``: ``keys``, ``name``. First the
    rows whose bare column name is free get it, the lowest ``row_no`` winning; then the others try
    the name with the table in front; rows that lose there too fail.

    Winners are found by aggregation and rows are told apart by ``row_no``, so a name most rows
    share is never gathered in one place. Names are settled on narrow rows, written once; the
    glossary itself is shuffled once, to take its results.
    """
    key = list(keys)
    row_key = [*key, "row_no"]
    base = X.sanitize_term(F.col("column_name"))
    prefixed = F.concat(X.sanitize_term(F.col("table_name")), F.lit("_"), base)
    named_rows = glossary.select(
        *row_key, "table_name", X.term_name(base).alias("_base"), X.term_name(prefixed).alias("_prefixed")
    )
    matched = durable(asset_match(named_rows, assets, row_key, rows_per_block).drop("table_name"))
    known = matched.where(F.col("table_guid").isNotNull())
    taken = existing.select(*key, "name").distinct()

    def winners(candidates: DataFrame, column: str, taken: DataFrame) -> DataFrame:
        return (
            candidates.groupBy(*key, F.col(column).alias("name"))
            .agg(F.min("row_no").alias("row_no"))
            .join(taken, [*key, "name"], "left_anti")
        )

    first = durable(winners(known, "_base", taken))
    rest = known.join(first.select(*row_key), row_key, "left_anti")
    second = winners(rest, "_prefixed", taken.unionByName(first.select(*key, "name")))
    settled = matched.join(first.unionByName(second), row_key, "left").select(
        *row_key, "name", "table_guid", "_prefixed"
    )

    found = F.col("table_guid").isNotNull()
    reason = F.when(
        ~found, F.concat(F.lit("Table '"), "table_name", F.lit("' not found in the asset list"))
    ).when(F.col("name").isNull(), "already exists")
    return glossary.join(settled, row_key).select(
        *row_key,
        "table_name",
        "column_name",
        F.coalesce("name", F.when(found, F.col("_prefixed")), "column_name").alias("term"),
        X.short_description(F.col("definition")).alias("short_desc"),
        F.col("definition").alias("long_desc"),
        F.when(reason.isNull(), K.TERM_STATUS).alias("status"),
        "table_guid",
        reason.alias("error"),
    )


def find_or_create_glossary(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Guid of each requested glossary name, found ignoring case or made new.

    ``requests``: ``name`` and ``pos``; ``registry``: ``guid, name, pos``. The first entry of equal
    names wins; requests that differ only in case share one new guid, made from the name.
    """
    low = F.lower("name")
    found = registry.groupBy(low.alias("_low")).agg(F.min_by("guid", "pos").alias("_found"))
    asked = requests.groupBy(low.alias("_low")).agg(F.min_by("name", "pos").alias("name"))
    return asked.join(found, "_low", "left").select(
        "name",
        F.coalesce("_found", F.sha2("_low", 256)).alias("guid"),
        F.col("_found").isNull().alias("created"),
    )


def new_entries(created: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry rows (``name, guid, pos``) of created glossaries, behind those that are there."""
    last = registry.agg(F.coalesce(F.max("pos"), F.lit(0)).cast("long").alias("_last"))
    # One row of totals; entries are numbered by the range they are sorted into.
    return created.orderBy("name").crossJoin(F.broadcast(last)).select(
        "name", "guid", (F.col("_last") + 1 + F.monotonically_increasing_id()).cast("long").alias("pos")
    )


def list_glossaries(registry: DataFrame) -> DataFrame:
    return registry.select("name", "guid")
