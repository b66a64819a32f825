"""From dictionary rows to labelled table overviews and chunks of text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexline import constants as K
from lexline.functions import text as X
from lexline.operators.joins import salted_join

TABLE_KEY = ["conn_id", "schema_name", "table_name"]
COLUMN_KEY = [*TABLE_KEY, "column_name"]


def user_schemas(schemas: DataFrame, name: str = "schema_name") -> DataFrame:
    """Drop system schemas; names and prefixes heed case."""
    col = F.col(name)
    keep = ~col.isin(*K.SYSTEM_SCHEMAS)
    for prefix in K.SYSTEM_SCHEMA_PREFIXES:
        keep = keep & ~F.startswith(col, F.lit(prefix))
    return schemas.where(keep)


def list_tables(dictionary: DataFrame) -> DataFrame:
    """Tables of each connection, system schemas left out."""
    return user_schemas(dictionary.select(*TABLE_KEY)).distinct()


def catalog_columns(dictionary: DataFrame, with_defaults: bool = True) -> DataFrame:
    """Column rows of a dictionary view with the constraint text of each column.

    Expects ``conn_id, schema_name, table_name, pos, column_name, data_type, is_nullable`` and, for
    ``with_defaults``, ``column_default``; ``is_nullable`` is ``YES`` or ``NO``.
    """
    nullable = F.col("is_nullable") == "YES"
    default = F.col("column_default") if with_defaults else F.lit(None).cast("string")
    return dictionary.select(
        *TABLE_KEY,
        "pos",
        "column_name",
        F.col("data_type").alias("type"),
        nullable.alias("nullable"),
        default.alias("default"),
        X.constraint_text(nullable, default if with_defaults else None).alias("constraints"),
    )


def catalog_constraints(table_constraints: DataFrame, key_usage: DataFrame) -> DataFrame:
    """Key rows from the two constraint views of a server.

    The join key has connection, schema and table besides the constraint name, as names repeat
    across them. Foreign keys without a known target keep a null target.
    """
    on = [*TABLE_KEY, "constraint_name"]
    kind = (
        F.when(F.col("constraint_type") == "PRIMARY KEY", "PK")
        .when(F.col("constraint_type") == "FOREIGN KEY", "FK")
        .when(F.col("constraint_type") == "UNIQUE", "UNIQUE")
    )
    named = (
        table_constraints.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(*on, "kind", "ref_table", "ref_column")
    )
    return named.join(key_usage.select(*on, "column_name"), on).select(
        *TABLE_KEY, "constraint_name", "kind", "column_name", "ref_table", "ref_column"
    )


def key_flags(keys: DataFrame) -> DataFrame:
    """One row per keyed column: primary and unique flags and its foreign targets, in name order."""
    target = F.coalesce(F.concat_ws(".", "ref_table", "ref_column"), F.lit(""))
    # The targets of one column are bounded by the foreign keys a server allows on it.
    return keys.groupBy(*COLUMN_KEY).agg(
        F.max(F.col("kind") == "PK").alias("is_primary"),
        F.max(F.col("kind") == "UNIQUE").alias("is_unique"),
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.when(
                        F.col("kind") == "FK",
                        F.struct(F.col("constraint_name").alias("n"), target.alias("t")),
                    )
                )
            ),
            lambda s: s["t"],
        ).alias("foreign"),
    )


def column_labels(columns: DataFrame, keys: DataFrame, repeat_primary: bool = False) -> DataFrame:
    """Label every column; ``repeat_primary`` also lists the primary key among the constraints."""
    flagged = columns.join(key_flags(keys), COLUMN_KEY, "left")
    primary = F.coalesce("is_primary", F.lit(False))
    constraints = F.col("constraints")
    if repeat_primary:
        constraints = F.concat(constraints, F.when(primary, ", PRIMARY KEY").otherwise(""))
    return flagged.select(
        *TABLE_KEY,
        "pos",
        "column_name",
        X.column_label(
            F.col("column_name"),
            F.col("type"),
            constraints,
            primary,
            F.col("foreign"),
            F.coalesce("is_unique", F.lit(False)),
        ).alias("label"),
    )


def plain_labels(columns: DataFrame) -> DataFrame:
    """Labels without key notes: ``name: (type) [constraints]``."""
    return columns.select(
        *TABLE_KEY,
        "pos",
        "column_name",
        X.column_label(F.col("column_name"), F.col("type"), F.col("constraints")).alias("label"),
    )


def table_overview(
    labels: DataFrame, connections: DataFrame | None = None, keys: Sequence[str] = TABLE_KEY
) -> DataFrame:
    """Ordered labels of each table. A server bounds the columns of a table, so they make one array.

    Connections without tables stay in the result with null table and labels when ``connections``
    is given. ``keys`` may tell tables of one name apart.
    """
    overview = labels.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda s: s["label"]).alias("metadata")
    )
    if connections is None:
        return overview
    empty = connections.select("conn_id").join(overview.select("conn_id"), "conn_id", "left_anti")
    return overview.unionByName(empty, allowMissingColumns=True)


def with_connections(rows: DataFrame, connections: DataFrame) -> DataFrame:
    """Rows with the catalog and the kind of their connection (``conn_id, catalog_name, db_kind``).

    A connection that is not listed leaves both null.
    """
    return rows.join(connections.select("conn_id", "catalog_name", "db_kind"), "conn_id", "left")


def select_columns(columns: DataFrame, schemas: DataFrame, tables: DataFrame) -> DataFrame:
    """Dictionary rows of the ``tables`` (``schema_name, table_name``) that were chosen in schemas which
    were chosen for their connection (``conn_id, schema_name``)."""
    chosen = schemas.select("conn_id", "schema_name").distinct()
    named = tables.select("schema_name", "table_name").distinct()
    return columns.join(chosen, ["conn_id", "schema_name"], "left_semi").join(
        named, ["schema_name", "table_name"], "left_semi"
    )


def select_tables(tables: DataFrame, selection: str | Column, name: str = "table_name") -> DataFrame:
    """Tables named in a comma list; ``all`` keeps every table.

    ``selection`` is one text for all rows, or a column that holds the list of each row.
    """
    asked = F.lit(selection) if isinstance(selection, str) else selection
    wanted = F.transform(F.split(asked, ","), lambda t: F.lower(X.strip(t)))
    return tables.where(
        (F.lower(X.strip(asked)) == "all") | F.array_contains(wanted, F.lower(F.col(name)))
    )


def table_chunks(overview: DataFrame) -> DataFrame:
    """Text of each table handed to a generator."""
    return overview.where(F.col("table_name").isNotNull()).select(
        *[c for c in overview.columns if c != "metadata"],
        F.concat(
            F.lit("Tablespace: "),
            F.col("conn_id"),
            F.lit("\nTable: "),
            X.qualified_table(F.col("schema_name"), F.col("table_name")),
            F.lit("\nMetadata: "),
            X.quoted_list(F.col("metadata")),
            F.lit("\n"),
        ).alias("text"),
    )


def structure_report(catalogs: DataFrame, schemas: DataFrame) -> DataFrame:
    """Ordered lines of a structure report per connection.

    ``catalogs``: ``conn_id, catalog_no, catalog_name, failed``; ``schemas``: ``conn_id,
    catalog_name, schema_no, schema_name``. One row per line, so no report is held as one value;
    read in ``(catalog_no, line_no)`` order.
    """
    shown = catalogs.where(~F.lower("catalog_name").isin(*K.SYSTEM_CATALOGS))
    on = ["conn_id", "catalog_name"]
    frame = F.array(
        F.struct(F.lit(-1).cast("long").alias("catalog_no"), F.lit(K.REPORT_HEAD).alias("text")),
        F.struct(F.lit(1 << 62).alias("catalog_no"), F.lit(K.REPORT_TAIL).alias("text")),
    )
    conns = catalogs.select("conn_id").distinct()
    head = conns.select("conn_id", F.explode(frame).alias("f")).select(
        "conn_id", "f.catalog_no", F.lit(0).cast("long").alias("line_no"), "f.text"
    )
    titles = shown.select(
        "conn_id",
        F.col("catalog_no").cast("long"),
        F.lit(0).cast("long").alias("line_no"),
        F.concat(F.lit("\nCatalog: `"), "catalog_name", F.lit("`")).alias("text"),
    )
    lines = (
        salted_join(schemas, shown.where(~F.col("failed")), on, ["schema_no"], "inner")
        .select(
            "conn_id",
            F.col("catalog_no").cast("long"),
            (F.col("schema_no") + F.lit(1)).cast("long").alias("line_no"),
            F.concat(F.lit("  - Schema: `"), "schema_name", F.lit("`")).alias("text"),
        )
    )
    notes = (
        shown.join(schemas.select(*on).distinct().withColumn("_has", F.lit(True)), on, "left")
        .where(F.col("failed") | F.col("_has").isNull())
        .select(
            "conn_id",
            F.col("catalog_no").cast("long"),
            F.lit(1).cast("long").alias("line_no"),
            F.when(F.col("failed"), "  - (Could not fetch schemas)")
            .otherwise("  - (No schemas found in this catalog)")
            .alias("text"),
        )
    )
    return head.unionByName(titles).unionByName(lines).unionByName(notes)


def preview(rows: DataFrame, n: int = 5, order: Sequence[str] = ()) -> DataFrame:
    """The first rows of a table; a top-n when an order is given."""
    return (rows.orderBy(*order) if order else rows).limit(n)
