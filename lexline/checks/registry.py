"""Registered queries with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexline import constants as K
from lexline.checks import inputs
from lexline.functions import chat as C
from lexline.functions import text as X
from lexline.operators import (
    catalog,
    chat,
    chunking,
    generate,
    lineage,
    ordered,
    parse,
    publish,
    scripts,
    spans,
)
from lexline.plans import flows
from lexline.session import durable
from lexline.sources import assets

Load = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(*, needs: tuple[str, ...] = (), sql: str | None = None):
    """Register a function of a loader under its own name; ``needs`` are the inputs of the SQL."""

    def register(fn: Callable[[Load], DataFrame]) -> Callable[[Load], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(partial(inputs.load, spark, sf_dir))

        QUERIES[fn.__name__] = run
        if sql is not None:
            head = f"WITH RECURSIVE {inputs.ctes(*needs)}" if needs else ""
            body = sql.strip()
            joiner = ", " if head and not body.upper().startswith("SELECT") else " "
            ORACLES[fn.__name__] = f"{head}{joiner}{body}"
        return fn

    return register


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WS = _literal(K.WHITESPACE)


def _strip(expr: str) -> str:
    return f"trim({expr}, {_WS})"


def _lines(source: str, key: str, out: str = "l") -> str:
    """WITH items: lines of stripped texts with their position from 0."""
    return (
        f"{out}_split AS (SELECT {key}, string_split({_strip('text')}, chr(10)) AS ls FROM {source}), "
        f"{out} AS (SELECT {key}, CAST(i - 1 AS INTEGER) AS pos, ls[i] AS line "
        f"FROM {out}_split, UNNEST(range(1, len(ls) + 1)) AS t(i))"
    )


def _pipes(expr: str = "line") -> str:
    return f"(length({expr}) - length(replace({expr}, '|', '')))"


def _sanitize(expr: str) -> str:
    spaced = f"regexp_replace({_strip(expr)}, '[ @.,()]', '_', 'g')"
    ascii_only = f"regexp_replace({spaced}, '[^A-Za-z0-9_]', '', 'g')"
    return f"trim(regexp_replace({ascii_only}, '_+', '_', 'g'), '_')"


def _normalize(expr: str) -> str:
    return f"replace(ltrim(lower({_strip(expr)}), '.'), '\"', '')"


def _deny() -> str:
    return ", ".join(_literal(s) for s in K.SYSTEM_SCHEMAS)


_USER_SCHEMA = (
    f"schema_name NOT IN ({_deny()}) AND NOT starts_with(schema_name, 'db_') "
    "AND NOT starts_with(schema_name, 'pg_')"
)
_CONSTRAINTS = (
    "CASE WHEN is_nullable = 'YES' THEN 'NULL' ELSE 'NOT NULL' END || "
    "CASE WHEN coalesce(column_default, '') <> '' THEN ', DEFAULT ' || column_default ELSE '' END"
)
_KEYS_SQL = """
    keys AS (
      SELECT tc.conn_id, tc.schema_name, tc.table_name, tc.constraint_name,
             CASE constraint_type WHEN 'PRIMARY KEY' THEN 'PK' WHEN 'FOREIGN KEY' THEN 'FK' ELSE 'UNIQUE' END AS kind,
             column_name, ref_table, ref_column
      FROM table_constraints tc JOIN key_usage ku
        ON tc.conn_id = ku.conn_id AND tc.schema_name = ku.schema_name AND tc.table_name = ku.table_name
          AND tc.constraint_name = ku.constraint_name
      WHERE constraint_type IN ('PRIMARY KEY', 'FOREIGN KEY', 'UNIQUE'))"""
_LABELS_SQL = (
    _KEYS_SQL
    + f""",
    flags AS (
      SELECT conn_id, schema_name, table_name, column_name, bool_or(kind = 'PK') AS pk, bool_or(kind = 'UNIQUE') AS uq,
             string_agg(CASE WHEN kind <> 'FK' THEN NULL WHEN ref_table IS NULL THEN ' [Foreign Key]'
               ELSE ' [Foreign Key references ' || ref_table || '.' || ref_column || ']' END, ''
               ORDER BY constraint_name) AS fk
      FROM keys GROUP BY ALL),
    labels AS (
      SELECT d.conn_id, d.schema_name, d.table_name, d.pos, d.column_name,
             d.column_name || ': (' || data_type || ')' || CASE WHEN pk THEN ' [Primary Key]' ELSE '' END
             || coalesce(fk, '') || CASE WHEN uq THEN ' [Unique]' ELSE '' END || ' [' || {_CONSTRAINTS} || ']' AS label
      FROM dictionary d LEFT JOIN flags f ON d.conn_id = f.conn_id AND d.schema_name = f.schema_name
        AND d.table_name = f.table_name AND d.column_name = f.column_name)"""
)
_CATALOG = ("dictionary", "table_constraints", "key_usage")


def _labels(load: Load) -> DataFrame:
    keys = catalog.catalog_constraints(load("table_constraints"), load("key_usage"))
    return catalog.column_labels(catalog.catalog_columns(load("dictionary")), keys)


# ---- dictionaries ----------------------------------------------------------------------------


@query(
    needs=("dictionary",),
    sql=f"""SELECT conn_id, schema_name, table_name, pos, column_name, data_type AS type,
            is_nullable = 'YES' AS nullable, column_default AS "default", {_CONSTRAINTS} AS constraints FROM dictionary""",
)
def catalog_columns(load):
    return catalog.catalog_columns(load("dictionary"))


@query(needs=("table_constraints", "key_usage"), sql=_KEYS_SQL + " SELECT * FROM keys")
def catalog_constraints(load):
    return catalog.catalog_constraints(load("table_constraints"), load("key_usage"))


@query(
    needs=("dictionary",),
    sql=f"SELECT DISTINCT conn_id, schema_name, table_name FROM dictionary WHERE {_USER_SCHEMA}",
)
def list_tables(load):
    return catalog.list_tables(load("dictionary"))


@query(
    needs=("dictionary",),
    sql=f"SELECT conn_id, schema_name, count(*) AS n_columns FROM dictionary WHERE {_USER_SCHEMA} GROUP BY ALL",
)
def user_schemas(load):
    counted = load("dictionary").groupBy("conn_id", "schema_name").agg(F.count(F.lit(1)).alias("n_columns"))
    return catalog.user_schemas(counted)


@query(
    sql="""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
           ORDER BY o_totalprice DESC, o_orderkey LIMIT 5"""
)
def preview_top5(load):
    rows = load("all_orders")
    return catalog.preview(rows, 5, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query(needs=_CATALOG, sql=_LABELS_SQL + " SELECT * FROM labels")
def column_labels(load):
    return _labels(load)


@query(
    needs=("dictionary",),
    sql=f"""SELECT conn_id, schema_name, table_name, pos, column_name,
            column_name || ': (' || data_type || ') [' || {_CONSTRAINTS} || ']' AS label FROM dictionary""",
)
def plain_labels(load):
    return catalog.plain_labels(catalog.catalog_columns(load("dictionary")))


@query(
    needs=_CATALOG,
    sql=_LABELS_SQL
    + """ SELECT conn_id, schema_name, table_name,
          string_agg(label, ', ' ORDER BY pos) AS metadata FROM labels GROUP BY ALL""",
)
def table_overview(load):
    return catalog.table_overview(_labels(load)).withColumn("metadata", F.array_join("metadata", ", "))


_QUOTED = (
    "CASE WHEN contains(label, '''') AND NOT contains(label, '\"') THEN '\"' || label || '\"' "
    "ELSE '''' || replace(label, '''', '\\''') || '''' END"
)
_QUALIFIED = (
    "CASE WHEN lower(schema_name) IN ('', 'purview', 'main') THEN table_name "
    "ELSE schema_name || '.' || table_name END"
)


@query(
    needs=_CATALOG,
    sql=_LABELS_SQL
    + f""" SELECT conn_id, schema_name, table_name, 'Tablespace: ' || conn_id || chr(10) || 'Table: '
          || {_QUALIFIED} || chr(10) || 'Metadata: [' || string_agg({_QUOTED}, ', ' ORDER BY pos) || ']' || chr(10) AS text
          FROM labels GROUP BY conn_id, schema_name, table_name""",
)
def table_chunks(load):
    return catalog.table_chunks(catalog.table_overview(_labels(load)))


@query(
    needs=("dictionary",),
    sql="""SELECT conn_id, schema_name, table_name, column_name FROM dictionary
           WHERE lower(table_name) IN ('t_3', 't_0', 't_101')
           UNION ALL
           SELECT conn_id || '/all', schema_name, table_name, column_name FROM dictionary""",
)
def select_tables(load):
    rows = load("dictionary").select("conn_id", "schema_name", "table_name", "column_name")
    every = rows.withColumn("conn_id", F.concat("conn_id", F.lit("/all")))
    return catalog.select_tables(rows, "T_3, t_0 ,T_101").unionByName(catalog.select_tables(every, " All "))


@query(
    needs=("catalogs", "catalog_schemas"),
    sql=f"""
    shown AS (SELECT * FROM catalogs WHERE lower(catalog_name) NOT IN ('system', 'information_schema'))
    SELECT DISTINCT conn_id, CAST(-1 AS BIGINT) AS catalog_no, CAST(0 AS BIGINT) AS line_no,
      {_literal(K.REPORT_HEAD)} AS text FROM catalogs
    UNION ALL SELECT DISTINCT conn_id, CAST(4611686018427387904 AS BIGINT), CAST(0 AS BIGINT), {_literal(K.REPORT_TAIL)} FROM catalogs
    UNION ALL SELECT conn_id, catalog_no, 0, chr(10) || 'Catalog: `' || catalog_name || '`' FROM shown
    UNION ALL SELECT c.conn_id, catalog_no, schema_no + 1, '  - Schema: `' || schema_name || '`'
      FROM shown c JOIN catalog_schemas s ON c.conn_id = s.conn_id AND c.catalog_name = s.catalog_name WHERE NOT failed
    UNION ALL SELECT conn_id, catalog_no, 1, CASE WHEN failed THEN '  - (Could not fetch schemas)'
      ELSE '  - (No schemas found in this catalog)' END FROM shown c
      WHERE failed OR NOT EXISTS (SELECT 1 FROM catalog_schemas s
        WHERE c.conn_id = s.conn_id AND c.catalog_name = s.catalog_name)""",
)
def structure_report(load):
    return catalog.structure_report(load("catalogs"), load("catalog_schemas"))


@query(needs=("asset_entities",), sql="""SELECT name, id AS guid FROM asset_entities
       WHERE entityType = 'azure_sql_table'""")
def asset_list(load):
    return assets.asset_list(load("asset_entities"))


_ASSET_COLUMNS_SQL = """
    cols AS (
      SELECT guid, 0 AS pos, 'g1' AS column_guid, json_extract_string(json, '$.referredEntities.g1.attributes.name') AS name,
        'int' AS type, false AS nullable,
        json_extract_string(json, '$.referredEntities.g1.attributes.description') AS description FROM asset_json
      UNION ALL
      SELECT guid, 2, 'g3', json_extract_string(json, '$.referredEntities.g3.attributes.name'), 'text', true, ''
      FROM asset_json)"""


@query(needs=("asset_json",), sql=_ASSET_COLUMNS_SQL + " SELECT * FROM cols")
def asset_columns(load):
    return assets.asset_columns(load("asset_json"))


@query(
    needs=("asset_json",),
    sql=_ASSET_COLUMNS_SQL
    + """ SELECT guid, pos, name, name || ': (' || type || ')' ||
         CASE WHEN nullable THEN '' ELSE ' [NOT NULL | ' || description || ']' END AS label FROM cols""",
)
def asset_labels(load):
    return assets.asset_labels(assets.asset_columns(load("asset_json")))


# ---- names and short texts -------------------------------------------------------------------


@query(needs=("names",), sql=f"SELECT id, {_normalize('name')} AS normal FROM names")
def normalize_name(load):
    return load("names").select("id", X.normalize_name(F.col("name")).alias("normal"))


@query(needs=("names",), sql=f"SELECT id, {_sanitize('name')} AS term FROM names")
def sanitize_term(load):
    return load("names").select("id", X.sanitize_term(F.col("name")).alias("term"))


@query(
    needs=("names",),
    sql=f"""SELECT id, CASE WHEN starts_with(lower(n), 'sales.f.') THEN 'sales.F' WHEN starts_with(lower(n), 'sales.')
              THEN 'SALES' ELSE 'sales.F' END AS schema_name,
            CASE WHEN starts_with(lower(n), 'sales.') THEN substr(n, 7) ELSE n END AS table_name
            FROM (SELECT id, {_strip('name')} AS n FROM names)""",
)
def resolve_table(load):
    schema, table = X.resolve_table(F.col("name"), ["sales.F", "SALES"])
    return load("names").select("id", schema.alias("schema_name"), table.alias("table_name"))


@query(
    needs=("answers",),
    sql=f"""items AS (SELECT doc_id, string_split({_strip("substr(text, instr(text, ':') + 1)")}, ', ') AS ls FROM answers)
            SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, ls[i] AS item FROM items, UNNEST(range(1, len(ls) + 1)) t(i)""",
)
def answer_list(load):
    return scripts.answer_list(load("answers"))


@query(
    needs=("fenced",),
    sql=f"""SELECT doc_id, {_strip("trim(replace(replace(replace(text, '```plaintext', ''), '```graphviz', ''), '```dot', ''), '`')")}
            AS text FROM fenced""",
)
def strip_fences(load):
    return load("fenced").select("doc_id", X.strip_fences(F.col("text")).alias("text"))


@query(
    needs=("statements",),
    sql=f"""SELECT doc_id, array_to_string(list_slice(string_split_regex({_strip('text')}, '\\s+'), 1, 8), ' ') || ' ...'
            AS short, CASE WHEN {_strip('text')} = '' THEN 0 ELSE len(string_split_regex({_strip('text')}, '\\s+')) END
            ::INTEGER AS n_tokens FROM statements""",
)
def truncate_stmt(load):
    text = F.col("text")
    return load("statements").select(
        "doc_id", X.truncate_statement(text).alias("short"), X.token_count(text).alias("n_tokens")
    )


# ---- schema sheets ---------------------------------------------------------------------------

_SHEET_SQL = """
    tables AS (SELECT schema_name, table_name, min(row_no) AS table_row, count(*) AS n FROM sheet GROUP BY ALL),
    schemas AS (SELECT schema_name, min(row_no) AS schema_row FROM sheet GROUP BY ALL),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY schema_name ORDER BY table_row) AS table_no FROM tables),
    idx AS (SELECT *, row_number() OVER (PARTITION BY schema_name, table_name ORDER BY row_no) - 1 AS i FROM sheet),
    col_lines AS (
      SELECT schema_name, table_name, i // 12 AS line_no, string_agg(column_name, ', ' ORDER BY i) AS columns
      FROM idx GROUP BY ALL),
    placed AS (
      SELECT 'sheet' AS sheet_id, c.schema_name, c.table_name, schema_row, table_no, line_no,
             columns || CASE WHEN line_no < (n - 1) // 12 THEN ',' ELSE '' END AS text
      FROM col_lines c JOIN numbered USING (schema_name, table_name) JOIN schemas USING (schema_name))"""


@query(needs=("sheet",), sql=_SHEET_SQL + " SELECT * FROM placed")
def schema_text(load):
    return chunking.schema_text(load("sheet"))


@query(
    needs=("sheet",),
    sql=_SHEET_SQL
    + """ SELECT sheet_id, schema_name, table_name, (table_no - 1) // 10 AS chunk_no, table_no, line_no,
          table_no = 1 AND line_no = 0 AS schema_header, text FROM placed""",
)
def schema_chunks10(load):
    return chunking.schema_chunks(load("sheet"))


def _sections_sql(select: str, title: str, schema_end: str) -> str:
    return (
        _SHEET_SQL
        + f""" SELECT {select}, CASE WHEN table_no = 1 AND line_no = 0 THEN chr(10) || 'SCHEMA: ' || schema_name
          || {schema_end} ELSE '' END || CASE WHEN line_no = 0 THEN chr(10) || 'Table: ' || table_name || chr(10)
          || {title} ELSE '' END || text || chr(10) AS text FROM placed"""
    )


@query(
    needs=("sheet",),
    sql=_sections_sql("sheet_id, schema_name, table_name, schema_row, table_no, line_no", "'Columns:' || chr(10)", "''"),
)
def sheet_sections(load):
    return chunking.sheet_sections(load("sheet"))


@query(
    needs=("sheet",),
    sql=_SHEET_SQL
    + """ SELECT 'sheet' AS sheet_id, schema_name, table_name, schema_row, table_no, CAST(0 AS BIGINT) AS line_no,
          CASE WHEN table_no = 1 THEN chr(10) || 'SCHEMA: ' || schema_name ELSE '' END || chr(10) || 'Table: ' || table_name
            AS text FROM numbered JOIN schemas USING (schema_name)""",
)
def table_sections(load):
    return chunking.table_sections(load("sheet"))


@query(
    needs=("sheet",),
    sql=_sections_sql(
        "sheet_id, schema_name, table_name, (table_no - 1) // 10 AS chunk_no, table_no, line_no, "
        "table_no = 1 AND line_no = 0 AS schema_header",
        "'Columns: '",
        "chr(10)",
    ),
)
def chunk_sections(load):
    return chunking.chunk_sections(load("sheet"))


def _batches_sql(chunk_size: int, batch_size: int) -> str:
    return (
        _SHEET_SQL
        + f""",
    sl AS (SELECT schema_name, table_name, table_no, (n + 35) // 36 AS n FROM numbered),
    walk AS (
      SELECT schema_name, table_name, table_no, CAST(0 AS BIGINT) AS chunk, n AS held FROM sl WHERE table_no = 1
      UNION ALL
      SELECT s.schema_name, s.table_name, s.table_no, chunk + CASE WHEN held > {chunk_size} THEN 1 ELSE 0 END,
             CASE WHEN held > {chunk_size} THEN 0 ELSE held END + s.n
      FROM walk w JOIN sl s ON s.schema_name = w.schema_name AND s.table_no = w.table_no + 1),
    sizes AS (SELECT schema_name, max(chunk) + 1 AS n_chunks, schema_row FROM walk JOIN schemas USING (schema_name)
              GROUP BY ALL),
    offsets AS (SELECT schema_name, CAST(sum(n_chunks) OVER (ORDER BY schema_row) - n_chunks AS BIGINT) AS first FROM sizes),
    slices AS (
      SELECT schema_name, table_name, line_no // 3 AS slice_no,
             chr(10) || 'Table: ' || table_name || chr(10) || 'Columns: '
             || string_agg(columns, ',' || chr(10) ORDER BY line_no) || chr(10) AS text
      FROM col_lines GROUP BY schema_name, table_name, line_no // 3),
    batches AS (
      SELECT 'sheet' AS sheet_id, schema_name, table_name, (first + chunk) // {batch_size} AS batch_no,
             first + chunk AS chunk_no, table_no, slice_no, table_no = 1 AND slice_no = 0 AS schema_header, text
      FROM slices JOIN walk USING (schema_name, table_name) JOIN offsets USING (schema_name))"""
    )


@query(needs=("sheet",), sql=_batches_sql(2, 3) + " SELECT * FROM batches")
def schema_batches(load):
    return chunking.schema_batches(load("sheet"), chunk_size=2, batch_size=3)


@query(
    needs=("numbered_chunks",),
    sql="""SELECT run_id, chunk_no, CASE WHEN chunk_no = min(chunk_no) OVER (PARTITION BY run_id) THEN '' ELSE '  ' || chr(10) END AS prefix, text
           FROM numbered_chunks""",
)
def join_responses(load):
    return chunking.join_responses(load("numbered_chunks"))


@query(
    needs=("numbered_chunks", "excerpts"),
    sql="""SELECT c.run_id, c.chunk_no, c.text, coalesce(excerpt, 'N/A') AS excerpt FROM numbered_chunks c
           LEFT JOIN excerpts e ON c.run_id = e.run_id AND c.chunk_no = e.chunk_no""",
)
def chunk_dictionary(load):
    return generate.chunk_dictionary(load("numbered_chunks"), load("excerpts"))


@query(
    needs=("text_rows",),
    sql=f"""counted AS (SELECT source, doc_id, text, CAST(CASE WHEN {_strip('text')} = '' THEN 0
              ELSE len(string_split_regex({_strip('text')}, '\\s+')) END AS BIGINT) AS n_tokens FROM text_rows),
            summed AS (SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS used_tokens
              FROM counted)
            SELECT source, doc_id, n_tokens, used_tokens FROM summed WHERE used_tokens - n_tokens < 2000""",
)
def token_budget(load):
    return chunking.token_budget(load("text_rows"), ["source"], "doc_id", "text", budget=2000)


@query(
    needs=("budget_rows",),
    sql="""numbered AS (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY row_no) AS i,
              count(*) OVER (PARTITION BY script_id) AS n,
              CAST(trunc((126800 - used_tokens) / 100) AS BIGINT) AS short FROM budget_rows)
           SELECT script_id, row_no, used_tokens FROM numbered
           WHERE i > CASE WHEN used_tokens < 116800 AND 116800 - used_tokens < 6000 AND n > short THEN short ELSE 0 END""",
)
def drop_leading_rows(load):
    return chunking.drop_leading_rows(load("budget_rows"), ["script_id"], "row_no", "used_tokens")


# ---- generated texts to rows -----------------------------------------------------------------

_G1_SQL = (
    _lines("(SELECT * FROM g1 WHERE NOT regexp_matches(text, '[|][^' || chr(10) || ']*[|]'))", "doc_id")
    + f""",
    kinds AS (
      SELECT doc_id, pos, line, {_strip('line')} AS body, CASE WHEN contains(line, '|') THEN 'term'
        WHEN contains(line, 'Tablespace:') THEN 'tablespace' WHEN contains(line, 'Table: ') THEN 'table'
        ELSE 'description' END AS kind FROM l WHERE {_strip('line')} <> '')"""
)
_G1_ROWS_SQL = (
    _G1_SQL
    + f""",
    carried AS (
      SELECT doc_id, pos, line, kind,
        last_value(CASE WHEN kind = 'tablespace' THEN replace(body, 'Tablespace:', '') END IGNORE NULLS) OVER w AS tablespace,
        last_value(CASE WHEN kind = 'table' THEN replace(body, 'Table:', '') END IGNORE NULLS) OVER w AS table_name,
        last_value(CASE WHEN kind = 'description' THEN body END IGNORE NULLS) OVER w AS table_description
      FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    terms AS (
      SELECT doc_id, pos, tablespace, table_name, table_description,
        {_strip("split_part(line, '|', 1)")} AS column_name, {_strip("split_part(line, '|', 2)")} AS definition
      FROM carried WHERE kind = 'term' AND lower({_strip("split_part(line, '|', 1)")}) <> 'term')"""
)


@query(needs=("g1",), sql=_G1_ROWS_SQL + " SELECT * FROM terms")
def glossary_parse(load):
    return parse.glossary_parse(load("g1"))


@query(
    needs=("g1",),
    sql=_G1_SQL
    + f""" SELECT doc_id, pos, CASE kind WHEN 'tablespace' THEN chr(10) || '### ' || body
            WHEN 'table' THEN chr(10) || '#### ' || body WHEN 'term' THEN '- **' || {_strip("split_part(line, '|', 1)")}
            || '**: ' || {_strip("split_part(line, '|', 2)")} ELSE body END AS text
          FROM kinds WHERE kind <> 'term' OR lower({_strip("split_part(line, '|', 1)")}) <> 'term'""",
)
def glossary_markdown(load):
    return parse.glossary_markdown(load("g1"))


@query(
    needs=("g1",),
    sql="""SELECT doc_id, 'more than one pipe in a line' AS reason FROM g1
           WHERE EXISTS (SELECT 1 FROM UNNEST(string_split(text, chr(10))) t(x)
                         WHERE length(x) - length(replace(x, '|', '')) > 1)""",
)
def rejected_responses(load):
    return parse.rejected_responses(load("g1"))


_G2_SQL = (
    _lines("g2", "doc_id")
    + f""",
    k AS (SELECT *, CASE WHEN starts_with(line, 'Table:') THEN 't' WHEN starts_with(line, 'Description:') THEN 'd'
            WHEN starts_with(line, '-') AND contains(line, ':') THEN 'c' END AS kind FROM l),
    n AS (SELECT *, count(*) FILTER (kind = 't') OVER (PARTITION BY doc_id ORDER BY pos) AS table_no FROM k
          WHERE kind IS NOT NULL),
    heads AS (
      SELECT doc_id, table_no, max({_strip("split_part(line, 'Table:', 2)")}) FILTER (kind = 't') AS table_name,
        coalesce(arg_max({_strip("split_part(line, 'Description:', 2)")}, pos) FILTER (kind = 'd'), '') AS table_description
      FROM n WHERE table_no > 0 GROUP BY ALL)
    SELECT doc_id, pos, table_name, table_description,
      {_strip("trim(split_part(line, ':', 1), '-')")} AS column_name,
      {_strip("substr(line, instr(line, ':') + 1)")} AS column_description
    FROM n JOIN heads USING (doc_id, table_no) WHERE kind = 'c'"""
)


@query(
    needs=("g2",),
    sql=_G2_SQL,
)
def define_parse(load):
    return parse.define_parse(load("g2"))


def _cell(i: int, name: str) -> str:
    value = _strip(f"p[{i + 1}]")
    return f"CASE WHEN p[{i + 1}] = '' THEN 'S/B' ELSE {value} END AS {name}" if i >= 8 else f"{value} AS {name}"


_G3_SQL = (
    _lines("g3", "script_id")
    + f""",
    cells AS (SELECT script_id, pos AS row_no, string_split(line, '|') AS p FROM l
              WHERE pos >= 2 AND {_pipes()} IN (14, 15)),
    parsed AS (SELECT script_id, row_no, {", ".join(_cell(i + 1, c) for i, c in enumerate(K.LINEAGE_COLUMNS))} FROM cells)"""
)


def _filled_sql(source: str, key: str = "script_id", columns: tuple[str, ...] = K.LINEAGE_COLUMNS) -> str:
    cells = ", ".join(
        f"last_value(nullif({c}, 'S/B') IGNORE NULLS) OVER "
        f"(PARTITION BY {key} ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS {c}"
        for c in columns
    )
    return f"filled AS (SELECT {key}, row_no, {cells} FROM {source})"


@query(needs=("g3",), sql=_G3_SQL + " SELECT * FROM parsed")
def lineage_parse(load):
    return parse.lineage_parse(load("g3"))


@query(
    needs=("g3",),
    sql=_lines("g3", "script_id")
    + f""",
    stops AS (SELECT script_id, max(pos) FILTER (pos >= 2 AND ({_pipes()} >= 14 OR contains(line, '------'))) AS stop
              FROM l GROUP BY ALL),
    marks AS (SELECT script_id, stop, bool_or(pos = stop AND contains(line, '------')) AS marked
              FROM l JOIN stops USING (script_id) GROUP BY ALL),
    kept AS (SELECT script_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM l JOIN stops USING (script_id)
             WHERE pos <= coalesce(stop, 1) GROUP BY ALL)
    SELECT script_id, CASE WHEN marked THEN g3.text ELSE kept.text END AS text
    FROM g3 JOIN marks USING (script_id) JOIN kept USING (script_id)""",
)
def trim_partial_rows(load):
    return parse.trim_partial_rows(load("g3"))


@query(
    needs=("step_rows",),
    sql="""SELECT user_id, event_id,
             last_value(nullif(kind, 'S/B') IGNORE NULLS) OVER w AS kind,
             last_value(nullif(mark, 'S/B') IGNORE NULLS) OVER w AS mark
           FROM step_rows WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
def fill_same_as_above(load):
    return parse.fill_same_as_above(load("step_rows"), ["user_id"], "event_id", ["kind", "mark"])


def _spans_sql(source: str, key: str, row: str, columns: tuple[str, ...]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {key}, {i} AS column_no, '{c}' AS \"column\", {c} AS value, {row} AS r FROM {source}"
        for i, c in enumerate(columns)
    )
    return f"""
    u AS ({parts}),
    c AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND value IS NOT DISTINCT FROM lag(value) OVER w THEN 0 ELSE 1 END AS n
          FROM u WINDOW w AS (PARTITION BY {key}, column_no ORDER BY r)),
    runs AS (SELECT *, sum(n) OVER (PARTITION BY {key}, column_no ORDER BY r) AS run FROM c),
    spans AS (SELECT {key}, column_no, "column", value, min(r) AS first_row, max(r) AS last_row, count(*) AS rows
              FROM runs GROUP BY {key}, column_no, "column", value, run HAVING count(*) >= 2)"""


@query(
    needs=("step_rows",),
    sql=_spans_sql("step_rows", "user_id", "event_id", ("kind", "mark")) + " SELECT * FROM spans",
)
def merge_spans(load):
    return ordered.merge_spans(load("step_rows"), ["user_id"], "event_id", ["kind", "mark"])


@query(
    needs=("span_rows",),
    sql=_spans_sql("span_rows", "doc_id", "row_no", ("table_name",))
    + " SELECT doc_id, value AS table_name, first_row, last_row, rows FROM spans WHERE value IS NOT NULL",
)
def glossary_spans(load):
    return spans.glossary_spans(load("span_rows"))


_SHEET_ROWS_SQL = """
    placed AS (SELECT sheet_id, table_name, 1 + row_number() OVER (PARTITION BY sheet_id ORDER BY chunk_no, pos) AS sheet_row
               FROM chunk_rows),"""


@query(
    needs=("chunk_rows",),
    sql=_SHEET_ROWS_SQL
    + _spans_sql("placed", "sheet_id", "sheet_row", ("table_name",))
    + " SELECT sheet_id, value AS table_name, first_row, last_row, rows FROM spans WHERE value IS NOT NULL",
)
def sheet_spans(load):
    return spans.sheet_spans(load("chunk_rows"))


# ---- lineage ---------------------------------------------------------------------------------

_ENTITY = "upper(trim({}, '@'))"
_EDGES_PART = f"""
    src AS (
      SELECT script_id, row_no, {_ENTITY.format(_strip('table_name'))} AS dst, derivation_purpose AS purpose, src, from_join
      FROM (
        SELECT *, {_ENTITY.format(_strip("unnest(string_split(join_table, ','))"))} AS src, true AS from_join FROM filled
        UNION ALL
        SELECT *, {_ENTITY.format(_strip("unnest(string_split(filter_table, ','))"))} AS src, false FROM filled)
      WHERE src IS NOT NULL AND src NOT IN ('', 'N/A', 'S/B') AND dst IS NOT NULL AND dst NOT IN ('', 'N/A', 'S/B')),
    legend AS (
      SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY first_row) AS purpose_no FROM (
        SELECT script_id, derivation_purpose AS purpose, min(row_no) AS first_row FROM filled
        WHERE derivation_purpose IS NOT NULL AND derivation_purpose NOT IN ('', 'N/A', 'S/B') GROUP BY ALL)),
    edges AS (
      SELECT e.*, purpose_no, NOT EXISTS (SELECT 1 FROM src s WHERE s.script_id = e.script_id AND s.src = e.dst) AS to_final
      FROM (SELECT script_id, src, dst, purpose, NOT bool_or(from_join) AS filter_only, min(row_no) AS first_row
            FROM src GROUP BY ALL) e
      LEFT JOIN legend g ON g.script_id = e.script_id AND g.purpose = e.purpose),
    named AS (
      SELECT script_id, row_no, layer, {_ENTITY.format(_strip('table_name'))} AS name, {_strip('table_name')} AS raw,
        column_name FROM filled),
    firsts AS (
      SELECT script_id, name, arg_min(layer, row_no) AS layer FROM named
      WHERE name IS NOT NULL AND name NOT IN ('', 'N/A', 'S/B') AND layer IS NOT NULL GROUP BY ALL),
    layers AS (
      SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY first_row) AS layer_no FROM (
        SELECT n.script_id, n.layer, min(n.row_no) AS first_row FROM named n
        WHERE name NOT IN ('', 'N/A', 'S/B') AND n.layer NOT IN ('', 'N/A', 'S/B') AND EXISTS (
          SELECT 1 FROM firsts f WHERE f.script_id = n.script_id AND f.layer = n.layer) GROUP BY ALL)),
    aligned AS (
      SELECT f.script_id, name, f.layer, layer_no FROM firsts f
      LEFT JOIN layers l ON f.script_id = l.script_id AND f.layer = l.layer),
    nodes AS (
      SELECT n.script_id, n.name, CASE WHEN marked THEN 'temp' WHEN NOT derived THEN 'source' WHEN NOT feeds THEN 'final'
        ELSE 'temp' END AS kind, layer, layer_no
      FROM (
        SELECT script_id, name, bool_or(feeds) AS feeds, bool_or(derived) AS derived, bool_or(marked) AS marked FROM (
          SELECT script_id, src AS name, true AS feeds, false AS derived, false AS marked FROM src
          UNION ALL SELECT script_id, dst, false, true, false FROM src
          UNION ALL SELECT script_id, name, false, true, regexp_matches(raw, '^[@#]') FROM named
            WHERE name IS NOT NULL AND name NOT IN ('', 'N/A', 'S/B')) GROUP BY ALL) n
      LEFT JOIN aligned a ON a.script_id = n.script_id AND a.name = n.name)"""
_EDGES_SQL = _filled_sql("doc_rows") + "," + _EDGES_PART


def _filled(load: Load) -> DataFrame:
    rows = lineage.diagram_rows(load("doc_rows"))
    columns = [c for c in rows.columns if c in K.LINEAGE_COLUMNS]
    return durable(parse.fill_same_as_above(rows, ["script_id"], "row_no", columns))


@query(needs=("doc_rows",), sql=_filled_sql("doc_rows") + " SELECT * FROM filled")
def fill_documentation(load):
    columns = list(K.LINEAGE_COLUMNS)
    return parse.fill_same_as_above(load("doc_rows"), ["script_id"], "row_no", columns)


@query(
    needs=("doc_rows",),
    sql=_EDGES_SQL
    + " SELECT script_id, src, dst, purpose, purpose_no, filter_only, to_final, first_row FROM edges",
)
def lineage_edges(load):
    return lineage.lineage_edges(_filled(load))


@query(needs=("doc_rows",), sql=_EDGES_SQL + " SELECT script_id, name, kind, layer, layer_no FROM nodes")
def lineage_nodes(load):
    return lineage.lineage_nodes(_filled(load))


@query(needs=("doc_rows",), sql=_EDGES_SQL + " SELECT * FROM legend")
def purpose_legend(load):
    return lineage.purpose_legend(_filled(load))


@query(needs=("doc_rows",), sql=_EDGES_SQL + " SELECT * FROM aligned")
def layer_alignment(load):
    return lineage.layer_alignment(_filled(load))


@query(
    needs=("doc_rows",),
    sql=_EDGES_SQL
    + """ SELECT script_id, name, column_name, min(row_no) AS first_row FROM named
         WHERE name NOT IN ('', 'N/A', 'S/B') AND column_name NOT IN ('', 'N/A', 'S/B') GROUP BY ALL""",
)
def node_columns(load):
    return lineage.node_columns(_filled(load))


_ESCAPED = "replace(replace({}, '\\', '\\\\'), '\"', '\\\"')"


def _dot_sql() -> str:
    def case(i: int) -> str:
        return " ".join(f"WHEN '{k}' THEN '{c[i]}'" for k, c in K.NODE_COLOURS.items())

    titles = [
        ("Source Table", "source"),
        ("Temp Tables, Cursors, Functions", "temp"),
        ("CTE", "cte"),
        ("Final Table/Report", "final"),
    ]
    kinds = [
        ("Data flow (source tables, temporary tables, CTEs)", K.EDGE_COLOUR, "solid"),
        ("Data flow to final report (aggregation)", K.FINAL_EDGE_COLOUR, "solid"),
        ("Filters only (dashed)", K.EDGE_COLOUR, "dashed"),
    ]
    fixed = [(0, "", "digraph lineage {"), (9, "", "}")]
    for i, (title, kind) in enumerate(titles):
        fill, border = K.NODE_COLOURS[kind]
        fixed.append(
            (1, i, f'  "legend {title}" [label="{title}", shape=box, style=filled, fillcolor="{fill}", color="{border}"];')
        )
    for i, (title, colour, style) in enumerate(kinds):
        fixed.append((2, i, f'  "edge {i} from" -> "edge {i} to" [label="{title}", color="{colour}", style={style}];'))
    values = ", ".join(f"({s}, '{i}', {_literal(t)})" for s, i, t in fixed)
    name, purpose, column = (_ESCAPED.format(c) for c in ("name", "purpose", "column_name"))
    pad = "lpad(CAST({} AS VARCHAR), 20, '0')"
    return (
        _EDGES_SQL
        + f""",
    cols AS (SELECT script_id, name, column_name, min(row_no) AS first_row FROM named
             WHERE name NOT IN ('', 'N/A', 'S/B') AND column_name NOT IN ('', 'N/A', 'S/B') GROUP BY ALL),
    shown AS (SELECT * FROM nodes WHERE layer_no IS NOT NULL),
    shown_layers AS (SELECT DISTINCT script_id, layer, layer_no FROM shown)
    SELECT script_id, CAST(section AS INTEGER) AS section, item, CAST(0 AS BIGINT) AS line_no, text
      FROM (SELECT DISTINCT script_id FROM nodes), (VALUES {values}) v(section, item, text)
    UNION ALL SELECT script_id, 3, {pad.format('purpose_no')}, 0, '  "purpose ' || purpose_no
      || '" [shape=plaintext, label="' || purpose_no || '. ' || {purpose} || '"];' FROM legend
    UNION ALL SELECT script_id, 4, name, -1, '  "' || {name} || '" [shape=box, style="rounded, filled", fontname="Arial", '
      || 'fillcolor="' || CASE kind {case(0)} END || '", color="' || CASE kind {case(1)} END || '", label="' || {name}
      || ' \\' FROM nodes
    UNION ALL SELECT script_id, 4, name, first_row, '\\n- ' || {column} || '\\' FROM cols
    UNION ALL SELECT script_id, 4, name, 4611686018427387904, '"];' FROM nodes
    UNION ALL SELECT script_id, 5, src || chr(9) || dst, coalesce(purpose_no, 0), '  "' || {_ESCAPED.format('src')}
      || '" -> "' || {_ESCAPED.format('dst')} || '" [label="' || coalesce(CAST(purpose_no AS VARCHAR), '') || '", color="'
      || CASE WHEN to_final THEN '{K.FINAL_EDGE_COLOUR}' ELSE '{K.EDGE_COLOUR}' END
      || CASE WHEN filter_only THEN '", style=dashed];' ELSE '"];' END FROM edges
    UNION ALL SELECT script_id, 6, {pad.format('layer_no')}, -1, '  label' || layer_no || ' [shape=box, style=filled, '
      || 'fillcolor=yellow, fontcolor=black, fontsize=12, label="' || {_ESCAPED.format('layer')} || '"];' FROM shown_layers
    UNION ALL SELECT script_id, 7, {pad.format('layer_no')} || chr(9) || name, 0, '  {{ rank=same; label' || layer_no
      || '; "' || {name} || '" }}' FROM shown
    UNION ALL SELECT script_id, 8, {pad.format('layer_no')}, 0, '  label' || (layer_no - 1) || ' -> label' || layer_no
      || ' [style=invis];' FROM shown_layers WHERE layer_no > 1"""
    )


@query(needs=("doc_rows",), sql=_dot_sql())
def dot_text(load):
    return lineage.dot_text(_filled(load))


#: What each script must give, by the form it ends with (``o_orderkey % 15``, None for all): references
#: (name, role, alias) and conditions (use, table, column). ``N % 29`` in a name is that number.
_SCRIPT_FORMS: list[tuple[int | None, str, str]] = [
    (
        None,
        "C_{k % 5} cte, STG_{k % 31} target, RAW_{k % 19} source R, SRC_{k % 13} source A, DBO.CUST_{c % 17} source B",
        "join SRC_{k % 13} ID, join DBO.CUST_{c % 17} ID, join C_{k % 5} ID, filter DBO.CUST_{c % 17} FLAG, "
        "filter SRC_{k % 13} ST, filter DBO.CUST_{c % 17} NOTE",
    ),
    (1, "DBO.M_{k % 29} target T, S.Q_1 source S", "join DBO.M_{k % 29} ID, join S.Q_1 ID"),
    (2, "U_{k % 23} target, P_1 source X, P_2 source Y, P_3 source P_3", "join P_1 ID, join P_2 ID, filter P_3 K"),
    (3, "D_{k % 11} target, E_1 source E", ""),
    (4, "V_1 target, W_1 source Z, W~2 source V", ""),
    (5, "K cte, L cte, N target", ""),
    (6, "#TMP_{k % 29} target, S6_1 source A, R6_1 source B", "join S6_1 DT, join R6_1 LO, join R6_1 HI"),
    (7, "CT_{k % 23} target, S7_1 source X, T7_{c % 9} source Z", "join T7_{c % 9} ID, join Q ID"),
    (8, "V8_{k % 23} target, O8_1 source O", "filter O8_1 DT"),
    (9, "CUR_{k % 29} target, H9_1 source H", "filter H9_1 FLAG"),
    (10, "CRS_1 target, I10_{c % 7} source I, CRS_1 source CRS_1", ""),
    (11, "G11_{k % 11} target, G11_{k % 11} source G, K~11 source K", "join G11_{k % 11} ID, join K~11 ID"),
    (12, "Y12_{k % 11} target, Y12_{k % 11} source Y, W12_1 source W", "join Y12_{k % 11} ID, join W12_1 ID, filter W12_1 OK"),
    (13, "U13_1 source U, V13_1 source V13_1", "join U13_1 ID, join V13_1 ID, filter U13_1 A"),
]


def _forms_sql(which: int, columns: Sequence[str]) -> str:
    """One SELECT for each row that a form gives, written from the forms and not from the scanner."""

    def value(text: str) -> str:
        text = _literal(text.replace("~", " "))
        for letter, column in (("k", "o_orderkey"), ("c", "o_custkey")):
            text = re.sub(r"{" + letter + r" % (\d+)}", rf"' || CAST({column} % \1 AS VARCHAR) || '", text)
        return text

    parts = []
    for form in _SCRIPT_FORMS:
        where = "" if form[0] is None else f" WHERE o_orderkey % 15 = {form[0]}"
        for item in filter(None, form[which].split(", ")):
            fields = re.findall(r"(?:{[^}]*}|\S)+", item)
            cells = [value(f) for f in [*fields, ""][: len(columns)]]
            listed = ", ".join(f"{v} AS {c}" for v, c in zip(cells, columns, strict=True))
            parts.append(f"SELECT o_orderkey AS script_id, {listed} FROM orders{where}")
    return "SELECT DISTINCT * FROM (" + " UNION ALL ".join(parts) + ")"


@query(sql=_forms_sql(1, ["name", "role", "alias"]))
def script_table_refs(load):
    return scripts.script_table_refs(load("scripts"))


@query(sql=_forms_sql(2, ["use", "table_name", "column_name"]))
def script_joins(load):
    return scripts.script_joins(load("scripts"))


@query(
    needs=("script_tables", "sheet_glossary"),
    sql="""tokens AS (SELECT DISTINCT script_id, unnest(string_split_regex(upper(name), '[_.]')) AS token FROM script_tables),
      heads AS (SELECT table_name, min(row_no) AS table_row, arg_min(table_description, row_no) AS d
                FROM sheet_glossary GROUP BY ALL),
      m AS (SELECT * FROM tokens JOIN heads ON token = upper(table_name))
      SELECT script_id, table_row, CAST(-1 AS BIGINT) AS line_row, table_name || chr(10) || d AS text FROM m
      UNION ALL
      SELECT script_id, table_row, row_no, column_name || ': ' || column_description FROM m JOIN sheet_glossary g
        ON g.table_name = m.table_name""",
)
def glossary_context(load):
    return scripts.glossary_context(load("script_tables"), load("sheet_glossary"))


_CONTEXT_SQL = """
    tokens AS (SELECT DISTINCT script_id, unnest(string_split_regex(upper(name), '[_.]')) AS token FROM script_tables),
    heads AS (SELECT table_name, min(row_no) AS table_row, arg_min(table_description, row_no) AS d
              FROM sheet_glossary GROUP BY ALL),
    described AS (
      SELECT table_name, string_agg(column_name || ': ' || column_description || chr(10), '' ORDER BY row_no) AS columns
      FROM sheet_glossary GROUP BY ALL),
    contexts AS (
      SELECT script_id, string_agg(table_name || chr(10) || d || chr(10) || columns || chr(10), '' ORDER BY table_row) AS context
      FROM tokens JOIN heads ON token = upper(table_name) JOIN described USING (table_name) GROUP BY ALL)"""


@query(needs=("script_tables", "sheet_glossary"), sql=_CONTEXT_SQL + " SELECT * FROM contexts")
def script_contexts(load):
    members, contexts = flows.shared_contexts(load("script_tables"), load("sheet_glossary"))
    return scripts.with_contexts(members, members, contexts).select("script_id", "context")


@query(
    needs=("script_tables", "sheet_glossary", "scripts"),
    sql=_CONTEXT_SQL
    + """ SELECT s.script_id, 'Dialect: T-SQL' || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(context, 'N/A')
          || chr(10) || chr(10) || 'Script:' || chr(10) || text AS text
        FROM scripts s LEFT JOIN contexts c ON c.script_id = s.script_id""",
)
def script_prompts(load):
    """What a generator is asked for each script, with what the glossary says of its tables."""
    members, contexts = flows.shared_contexts(load("script_tables"), load("sheet_glossary"))
    return flows.script_prompts(load("scripts"), contexts, "T-SQL", members)


# ---- publishing ------------------------------------------------------------------------------

_GUIDS_SQL = f"guids AS (SELECT {_normalize('name')} AS n, arg_max(guid, pos) AS table_guid FROM assets GROUP BY ALL)"
_MATCH_SQL = (
    _GUIDS_SQL
    + f""",
    matched AS (SELECT g.*, table_guid FROM glossary5 g LEFT JOIN guids ON n = {_normalize('table_name')})"""
)
_TERMS_SQL = (
    _MATCH_SQL
    + f""",
    named AS (SELECT *, substr({_sanitize('column_name')}, 1, 255) AS b,
      substr({_sanitize('table_name')} || '_' || {_sanitize('column_name')}, 1, 255) AS p FROM matched),
    r1 AS (SELECT *, row_number() OVER (PARTITION BY glossary_guid, b ORDER BY row_no) AS k FROM named
           WHERE table_guid IS NOT NULL),
    first AS (SELECT glossary_guid, row_no, b AS term FROM r1 WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM existing_terms e
              WHERE e.glossary_guid = r1.glossary_guid AND e.name = b)),
    r2 AS (SELECT r.*, row_number() OVER (PARTITION BY r.glossary_guid, p ORDER BY r.row_no) AS k2 FROM r1 r
           LEFT JOIN first f ON f.glossary_guid = r.glossary_guid AND f.row_no = r.row_no WHERE f.row_no IS NULL),
    second AS (SELECT glossary_guid, row_no, p AS term FROM r2 WHERE k2 = 1
               AND NOT EXISTS (SELECT 1 FROM existing_terms e WHERE e.glossary_guid = r2.glossary_guid AND e.name = p)
               AND NOT EXISTS (SELECT 1 FROM first f WHERE f.glossary_guid = r2.glossary_guid AND f.term = p)),
    terms AS (
      SELECT n.glossary_guid, n.row_no, table_name, column_name,
        coalesce(c.term, CASE WHEN table_guid IS NOT NULL THEN p END, column_name) AS term,
        substr(definition, 1, 250) AS short_desc, definition AS long_desc,
        CASE WHEN c.term IS NOT NULL THEN 'Approved' END AS status, table_guid,
        CASE WHEN table_guid IS NULL THEN 'Table ''' || table_name || ''' not found in the asset list'
          WHEN c.term IS NULL THEN 'already exists' END AS error
      FROM named n LEFT JOIN (SELECT * FROM first UNION ALL SELECT * FROM second) c
        ON c.glossary_guid = n.glossary_guid AND c.row_no = n.row_no)"""
)


@query(
    needs=("glossary5", "assets"),
    sql=_MATCH_SQL + " SELECT glossary_guid, row_no, table_name, table_guid FROM matched",
)
def asset_match(load):
    rows = load("glossary5").select("glossary_guid", "row_no", "table_name")
    return publish.asset_match(rows, load("assets"))


@query(needs=("glossary5", "assets", "existing_terms"), sql=_TERMS_SQL + " SELECT * FROM terms")
def assign_terms(load):
    return publish.assign_terms(load("glossary5"), load("assets"), load("existing_terms"))


@query(
    needs=("glossary5", "assets", "existing_terms"),
    sql=_TERMS_SQL
    + """ SELECT glossary_guid, count(*) FILTER (error IS NULL) AS succeeded, count(*) FILTER (error IS NOT NULL) AS failed
         FROM terms GROUP BY ALL""",
)
def publish_summary(load):
    return flows.publish_terms(load("glossary5"), load("assets"), load("existing_terms"))["summary"]


@query(
    needs=("glossary_requests", "glossary_registry"),
    sql="""found AS (SELECT lower(name) AS n, arg_min(guid, pos) AS g FROM glossary_registry GROUP BY ALL),
      asked AS (SELECT lower(name) AS n, arg_min(name, pos) AS name FROM glossary_requests GROUP BY ALL)
      SELECT name, coalesce(g, sha256(a.n)) AS guid, g IS NULL AS created FROM asked a LEFT JOIN found f ON a.n = f.n""",
)
def find_or_create_glossary(load):
    return publish.find_or_create_glossary(load("glossary_requests"), load("glossary_registry"))


@query(
    needs=("glossary5",),
    sql=f"""named AS (
        SELECT row_no, table_description AS d, column_name, definition,
          '`cat`.`s`.`' || CASE WHEN starts_with(lower(t), 's.') THEN substr(t, 3) ELSE t END || '`' AS fq_table
        FROM (SELECT *, {_strip('table_name')} AS t FROM glossary5))
      SELECT 'TABLE' AS level, fq_table, CAST(NULL AS VARCHAR) AS column_name, min(row_no) AS row_no,
        'COMMENT ON TABLE ' || fq_table || ' IS ''' || replace(arg_min(d, row_no), '''', '''''') || '''' AS ddl
      FROM named WHERE d <> '' GROUP BY fq_table
      UNION ALL
      SELECT 'COLUMN', fq_table, column_name, row_no, 'ALTER TABLE ' || fq_table || ' ALTER COLUMN `' || column_name
        || '` COMMENT ''' || replace(definition, '''', '''''') || '''' FROM named WHERE definition <> ''""",
)
def comment_ddl(load):
    return publish.comment_ddl(load("glossary5"), "cat", ["s"])


# ---- chat ------------------------------------------------------------------------------------

_ROLE = "CASE WHEN lower(coalesce(role, 'user')) = 'user' THEN 'human' WHEN lower(role) IN ('ai', 'assistant') THEN 'ai' END"
_PROMPT = (
    "question || concat_ws(' ', CASE WHEN path <> '' THEN "
    "'(Note: I have just uploaded a file available at path: ' || path || ')' END, "
    "CASE WHEN agent <> '' THEN '(User has specified intent for agent: ' || agent || ')' END)"
)


def _classify_sql(source: str) -> str:
    path = f"nullif({_strip(f'regexp_extract(content, {_literal(C.SAVED_PATH)}, 1)')}, '')"
    return f"""
    typed AS (
      SELECT *, CASE WHEN contains(content, '[upload_required]') OR contains(lower(content), 'provide the file')
          OR contains(lower(content), 'connection details') THEN 'DATASOURCE_FORM'
        WHEN contains(lower(content), '[lineage_file_upload_required]') OR contains(lower(content), 'lineage form')
          THEN 'LINEAGE_FORM'
        WHEN contains(lower(content), '[discover_db_details_required]') OR contains(lower(content), 'discover form')
          THEN 'DISCOVER_FORM'
        WHEN contains(lower(content), 'saved to:') OR contains(lower(content), 'download link') THEN 'FILE'
        ELSE 'CHAT' END AS response_type FROM {source}),
    classified AS (
      SELECT * EXCLUDE (content, agent),
        CASE response_type WHEN 'DATASOURCE_FORM' THEN {_strip("replace(content, '[upload_required]', '')")}
          WHEN 'LINEAGE_FORM' THEN {_strip("replace(content, '[lineage_file_upload_required]', '')")}
          WHEN 'DISCOVER_FORM' THEN {_strip("replace(content, '[discover_db_details_required]', '')")}
          ELSE content END AS content,
        CASE WHEN contains(agent, 'DefineAgent') THEN 'DEFINE' WHEN contains(agent, 'LineageExtractorAgent') THEN 'LINEAGE'
          WHEN contains(agent, 'DiscoverAgent') THEN 'DISCOVER' END AS agent,
        CASE WHEN response_type = 'FILE' THEN {path} END AS server_path,
        CASE WHEN response_type = 'FILE' THEN string_split({path}, '/')[-1] END AS filename
      FROM typed)"""


@query(
    needs=("messages",),
    sql=f"SELECT conv_id, turn, {_ROLE} AS role, coalesce(content, '') AS content FROM messages WHERE {_ROLE} IS NOT NULL",
)
def chat_normalize(load):
    return chat.chat_normalize(load("messages"))


@query(
    needs=("messages",),
    sql=f"""SELECT conv_id, string_agg({_ROLE} || '=' || content, chr(10) ORDER BY turn) AS messages
            FROM messages WHERE {_ROLE} IS NOT NULL GROUP BY ALL""",
)
def chat_history(load):
    joined = F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"]))
    return chat.chat_history(load("messages")).withColumn("messages", F.array_join(joined, "\n"))


@query(needs=("requests",), sql=f"SELECT *, {_PROMPT} AS prompt FROM requests")
def chat_prompt(load):
    return chat.chat_prompt(load("requests"))


@query(needs=("replies",), sql=_classify_sql("replies") + " SELECT * FROM classified")
def classify_response(load):
    return chat.classify_response(load("replies"))


@query(
    needs=("replies",),
    sql=f"""SELECT id, path, string_split(path, '/')[-1] AS filename FROM (
            SELECT id, nullif({_strip(f'regexp_extract(content, {_literal(C.SAVED_PATH)}, 1)')}, '') AS path FROM replies)""",
)
def extract_path(load):
    path = C.saved_path(F.col("content"))
    return load("replies").select("id", path.alias("path"), C.base_name(path).alias("filename"))


_FOLD_SQL = """
    kept AS (SELECT conv_id, seq, content, coalesce(nullif(msg_name, ''), agent) AS agent FROM agent_events
             WHERE msg_type = 'ai' AND content <> ''
               AND content NOT IN ('DefineAgent', 'LineageExtractorAgent', 'DiscoverAgent', 'supervisor')),
    folded AS (SELECT conv_id, arg_max(content, seq) AS content, arg_max(agent, seq) AS agent FROM kept GROUP BY ALL)"""


@query(needs=("agent_events",), sql=_FOLD_SQL + " SELECT * FROM folded")
def fold_events(load):
    return chat.fold_events(load("agent_events"))


@query(
    needs=("requests", "agent_events"),
    sql=_FOLD_SQL
    + f""",
    answered AS (SELECT r.conv_id, coalesce(content, {_literal(K.FALLBACK_REPLY)}) AS content,
      coalesce(f.agent, 'supervisor') AS agent FROM requests r LEFT JOIN folded f ON f.conv_id = r.conv_id),"""
    + _classify_sql("answered")
    + f" SELECT c.*, {_PROMPT.replace('agent', 'r.agent').replace('for r.agent', 'for agent')} AS prompt "
    + "FROM classified c JOIN requests r ON r.conv_id = c.conv_id",
)
def chat_turns(load):
    return flows.chat_turns(load("requests"), load("agent_events"))


@query(
    needs=("requests", "agent_events", "messages"),
    sql=f"""
    said AS (SELECT conv_id, turn, {_ROLE} AS role, coalesce(content, '') AS content FROM messages WHERE {_ROLE} IS NOT NULL),
    given AS (
      SELECT r.conv_id, turn, role, content FROM requests r JOIN said s ON s.conv_id = r.conv_id
      UNION ALL SELECT conv_id, 9223372036854775807, 'human', {_PROMPT} FROM requests)
    SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, role, content FROM given""",
)
def chat_turn_messages(load):
    """What the model is given in each turn: the history of the conversation and the new prompt."""
    turns = flows.chat_turns(load("requests"), load("agent_events"), load("messages"))
    rows = turns.select("conv_id", F.posexplode("messages").alias("pos", "m"))
    return rows.select("conv_id", "pos", "m.role", "m.content")


@query(
    needs=(*_CATALOG, "connections", "chosen_schemas", "chosen_tables"),
    sql=_LABELS_SQL
    + f""" SELECT l.conn_id, l.schema_name, l.table_name, l.pos, l.column_name, CASE WHEN db_kind = 'Databricks'
             THEN l.column_name || ': (' || data_type || ') [' || {_CONSTRAINTS} || ']' ELSE label END AS label
           FROM labels l JOIN dictionary d USING (conn_id, schema_name, table_name, column_name)
           LEFT JOIN connections c ON c.conn_id = l.conn_id
           WHERE (l.conn_id, l.schema_name) IN (SELECT (conn_id, schema_name) FROM chosen_schemas)
             AND (l.schema_name, l.table_name) IN (SELECT (schema_name, table_name) FROM chosen_tables)""",
)
def discover_selected(load):
    return flows.selected_labels(
        *(load(n) for n in (*_CATALOG, "connections", "chosen_schemas", "chosen_tables"))
    )


# ---- less common cases of operators above ----------------------------------------------------


@query(
    needs=(*_CATALOG, "listed_connections"),
    sql=_LABELS_SQL
    + """ SELECT conn_id, schema_name, table_name, string_agg(label, ', ' ORDER BY pos) AS metadata FROM labels GROUP BY ALL
          UNION ALL SELECT conn_id, NULL, NULL, NULL FROM listed_connections
            WHERE conn_id NOT IN (SELECT conn_id FROM dictionary)""",
)
def connection_overview(load):
    overview = catalog.table_overview(_labels(load), load("listed_connections"))
    return overview.withColumn("metadata", F.array_join("metadata", ", "))


@query(
    needs=("asset_json",),
    sql=_ASSET_COLUMNS_SQL + " SELECT guid, pos, name, name || ': (' || type || ')' AS label FROM cols",
)
def bare_asset_labels(load):
    return assets.asset_labels(assets.asset_columns(load("asset_json")), notes=False)


@query(
    needs=("doc_rows", "doc_ctes"),
    sql=_EDGES_SQL
    + """ SELECT n.script_id, n.name, CASE WHEN c.name IS NULL THEN kind ELSE 'cte' END AS kind, layer, layer_no
          FROM nodes n LEFT JOIN (SELECT script_id, upper(name) AS name FROM doc_ctes) c
            ON c.script_id = n.script_id AND c.name = n.name""",
)
def node_kinds(load):
    return lineage.lineage_nodes(_filled(load), load("doc_ctes"))


@query(
    needs=("comment_results",),
    sql="""SELECT '- ' || fq_table || '.' || coalesce(column_name, '[TABLE_DESC]') || ': ' || error AS line
           FROM comment_results WHERE error IS NOT NULL""",
)
def failure_lines(load):
    return publish.failure_lines(load("comment_results"))


@query(
    needs=("comment_results",),
    sql="""SELECT fq_table, count(*) FILTER (error IS NULL AND level = 'COLUMN') AS succeeded,
             count(*) FILTER (error IS NOT NULL) AS failed FROM comment_results GROUP BY ALL""",
)
def comment_summary(load):
    return publish.publish_summary(load("comment_results"), ["fq_table"])


# ---- flows over texts that were generated elsewhere -------------------------------------------


def _answers(load: Load, name: str, key: str, end: str) -> DataFrame:
    """Given answers as a batch service returns them, with their ``end``."""
    texts = load(name).select(key, F.concat("text", F.lit(end)).alias("text"))
    return generate.answered(texts.select(key), texts, [key], generate.mark_in_last_line)


@query(needs=("g1",), sql=_G1_ROWS_SQL + " SELECT * REPLACE (CAST(doc_id AS VARCHAR) AS doc_id) FROM terms")
def discover_glossary(load):
    return flows.glossary_results(_answers(load, "g1", "doc_id", ""), ["doc_id"])["glossary"]


@query(
    needs=("asset_entities", "asset_json"),
    sql=_ASSET_COLUMNS_SQL
    + f""",
    labels AS (SELECT guid, pos, name || ': (' || type || ')' AS label FROM cols)
    SELECT 'live_connection' AS conn_id, '' AS schema_name, e.name AS table_name, guid,
      'Tablespace: live_connection' || chr(10) || 'Table: ' || e.name || chr(10) || 'Metadata: ['
      || string_agg({_QUOTED}, ', ' ORDER BY pos) || ']' || chr(10) AS text
    FROM labels JOIN asset_entities e ON e.id = guid WHERE entityType = 'azure_sql_table' GROUP BY e.name, guid""",
)
def discover_assets(load):
    return flows.asset_prompts(assets.asset_list(load("asset_entities")), load("asset_json"))


@query(
    needs=("numbered_chunks", "excerpts"),
    sql="""SELECT c.run_id, c.chunk_no, excerpt AS text, CASE WHEN excerpt IS NULL THEN 0 ELSE 1 END AS rounds,
             coalesce(ends_with(excerpt, '------'), false) AS complete,
             CASE WHEN excerpt IS NULL THEN 'no answer' END AS error
           FROM numbered_chunks c LEFT JOIN excerpts e ON c.run_id = e.run_id AND c.chunk_no = e.chunk_no""",
)
def enrich_chunks(load):
    """Prompts with the answers that came for them."""
    found = load("excerpts").select("run_id", "chunk_no", F.col("excerpt").alias("text"))
    return generate.answered(load("numbered_chunks"), found, ["run_id", "chunk_no"])


@query(
    needs=("numbered_chunks", "excerpts"),
    sql="""SELECT c.run_id, c.chunk_no, excerpt AS text, CASE WHEN excerpt IS NULL THEN 'no answer' END AS error
           FROM numbered_chunks c LEFT JOIN excerpts e ON c.run_id = e.run_id AND c.chunk_no = e.chunk_no
           WHERE NOT coalesce(ends_with(excerpt, '------'), false)""",
)
def unfinished_texts(load):
    """What is set aside before parsing: prompts without an answer, and answers without an end."""
    found = load("excerpts").select("run_id", "chunk_no", F.col("excerpt").alias("text"))
    texts = generate.answered(load("numbered_chunks"), found, ["run_id", "chunk_no"])
    return flows.glossary_results(texts, ["run_id", "chunk_no"])["unfinished"].drop("rounds", "complete")


@query(
    needs=("sheet",),
    sql=_batches_sql(1, 1)
    + """ SELECT sheet_id, batch_no, chunk_no, 'N/A' AS excerpt, 'a shop' AS description,
          string_agg(CASE WHEN schema_header THEN chr(10) || 'SCHEMA: ' || schema_name || chr(10) ELSE '' END || text, ''
                     ORDER BY table_no, slice_no) AS text
        FROM batches GROUP BY ALL""",
)
def sheet_prompts(load):
    """What a generator is asked for each chunk of a sheet."""
    return flows.sheet_prompts(load("sheet"), description="a shop")


@query(
    needs=("g2",),
    sql=_G2_SQL.replace("SELECT doc_id, pos, table_name,", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, pos, table_name,"),
)
def define_glossary(load):
    return flows.define_results(_answers(load, "g2", "doc_id", "\n------"), ["doc_id"])["glossary"]


_WHOLE_SQL = _G3_SQL + ", " + _filled_sql("parsed")


def _documented(load: Load) -> dict[str, DataFrame]:
    return flows.script_results(_answers(load, "g3", "script_id", "\n------"), load("scripts"))


@query(needs=("g3",), sql=_WHOLE_SQL + " SELECT * FROM filled")
def analyse_scripts(load):
    return _documented(load)["documentation"]


@query(
    needs=("g3",),
    sql=_WHOLE_SQL
    + f""" SELECT * REPLACE ({_ENTITY.format('table_name')} AS table_name, {_ENTITY.format('join_table')} AS join_table,
           {_ENTITY.format('filter_table')} AS filter_table),
           1 + row_number() OVER (PARTITION BY script_id ORDER BY row_no) AS sheet_row FROM filled""",
)
def documentation_sheet(load):
    return _documented(load)["sheet"]


@query(
    needs=("g3",),
    sql=_WHOLE_SQL
    + ","
    + _EDGES_PART
    + " SELECT script_id, src, dst, purpose, purpose_no, filter_only, to_final, first_row FROM edges",
)
def script_lineage(load):
    return _documented(load)["edges"]
