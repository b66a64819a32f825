"""Inputs of the registered queries, derived from the given tables by SQL both engines read.

Each text is one SELECT over whole tables. ``spark.sql`` fills the table names with DataFrames; for
the check SQL they become plain names. A third of the rows share one key in several of them.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from lexline.session import spread

_T = "CAST(FLOOR(o_orderkey / 20) AS BIGINT)"
_CONN = f"CASE WHEN {_T} % 3 = 0 THEN 'conn_0' ELSE 'conn_' || CAST({_T} % 47 AS STRING) END"
_SCHEMA = (
    f"CASE WHEN {_T} % 11 = 0 THEN 'pg_catalog' WHEN {_T} % 13 = 0 THEN 'main' "
    f"WHEN {_T} % 17 = 0 THEN 'PG_X' ELSE 'S' || CAST({_T} % 5 AS STRING) END"
)
_TABLE = f"'t_' || CAST({_T} AS STRING)"
_POS = "CAST(o_orderkey % 20 + 1 AS INT)"
_COLUMN = "'c_' || CAST(o_orderkey AS STRING)"


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _g3_row(column: str, tail: str) -> str:
    return (
        "'| Load | d | @t_' || " + _s("o_custkey") + f" || ' | about t | {column} | INT | text | ' || {tail}"
    )


_G3_HEAD = (
    "'| a | b | c | d | e | f | g | h | i | j | k | l | m | n |' || chr(10) || "
    "'| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |' || chr(10)"
)
_G3_ROWS = (
    _g3_row("id", "'src_a, src_' || " + _s("o_orderkey % 13") + " || ' | id | a.id = b.id | N/A | N/A | N/A | ' || o_orderpriority || ' |'")
    + " || chr(10) || '|S/B|S/B|S/B|S/B| amt |DEC| amount ||| |  | S/B ||S/B|' || chr(10) || '' || chr(10) || "
    + _g3_row("st", "'N/A | N/A | N/A | src_f | flag | flag = 1 |'")
    + " || ' Keep ' || o_orderstatus || ' |  '"
)

SQL = {
    "all_orders": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM {orders}",
    "dictionary": f"""
        SELECT {_CONN} AS conn_id, {_SCHEMA} AS schema_name, {_TABLE} AS table_name, {_POS} AS pos,
               {_COLUMN} AS column_name,
               CASE o_orderstatus WHEN 'F' THEN 'BIGINT' WHEN 'O' THEN 'VARCHAR' ELSE 'DATE' END AS data_type,
               CASE WHEN o_orderkey % 3 = 0 THEN 'NO' ELSE 'YES' END AS is_nullable,
               CASE WHEN o_orderkey % 5 = 0 THEN 'it''s' WHEN o_orderkey % 5 = 1 THEN '' END AS column_default
        FROM {{orders}}""",
    "connections": f"""
        SELECT DISTINCT {_CONN} AS conn_id, 'cat' AS catalog_name,
               CASE WHEN {_CONN} < 'conn_3' THEN 'Databricks' ELSE 'PostgreSQL' END AS db_kind FROM {{orders}}""",
    "listed_connections": f"""
        SELECT DISTINCT {_CONN} || CASE WHEN {_T} % 5 = 0 THEN '_new' ELSE '' END AS conn_id FROM {{orders}}""",
    "comment_results": f"""
        SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'TABLE' ELSE 'COLUMN' END AS level, 't_' || {_s('o_custkey % 9')} AS fq_table,
               CASE WHEN o_orderkey % 3 > 0 THEN 'c_' || {_s('o_orderkey')} END AS column_name,
               CASE WHEN o_orderstatus = 'F' THEN 'no ' || o_orderpriority END AS error
        FROM {{orders}}""",
    "doc_ctes": f"""
        SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS script_id,
               'src_' || {_s('o_orderkey % 13')} AS name FROM {{orders}} WHERE o_orderstatus = 'F'""",
    "chosen_schemas": f"""
        SELECT DISTINCT {_CONN} AS conn_id, {_SCHEMA} AS schema_name FROM {{orders}} WHERE {_T} % 4 > 0""",
    "chosen_tables": f"""
        SELECT DISTINCT {_SCHEMA} AS schema_name, {_TABLE} AS table_name FROM {{orders}} WHERE {_T} % 7 < 5""",
    "table_constraints": f"""
        SELECT {_CONN} AS conn_id, {_SCHEMA} AS schema_name, {_TABLE} AS table_name,
               CASE WHEN o_orderkey % 20 = 0 THEN 'pk_' || {_s('o_orderkey % 100')}
                    ELSE 'k_' || {_s('o_orderkey')} END || {_TABLE} AS constraint_name,
               CASE WHEN o_orderkey % 20 = 0 THEN 'PRIMARY KEY' WHEN o_orderkey % 5 = 1 THEN 'UNIQUE'
                    WHEN o_orderkey % 3 = 0 THEN 'FOREIGN KEY' ELSE 'CHECK' END AS constraint_type,
               CASE WHEN o_orderkey % 6 = 3 THEN 'customers' END AS ref_table,
               CASE WHEN o_orderkey % 6 = 3 THEN 'id' END AS ref_column
        FROM {{orders}}""",
    "key_usage": f"""
        SELECT {_CONN} AS conn_id, {_SCHEMA} AS schema_name, {_TABLE} AS table_name,
               CASE WHEN o_orderkey % 20 = 0 THEN 'pk_' || {_s('o_orderkey % 100')}
                    ELSE 'k_' || {_s('o_orderkey')} END || {_TABLE} AS constraint_name,
               {_COLUMN} AS column_name
        FROM {{orders}}""",
    "sheet": f"""
        SELECT 'sheet' AS sheet_id, o_orderpriority AS schema_name,
               'T_' || {_s('CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_custkey END')} AS table_name,
               {_COLUMN} AS column_name, o_orderkey AS row_no
        FROM {{orders}}""",
    "names": f"""
        SELECT o_orderkey AS id,
               CASE o_orderkey % 4
                 WHEN 0 THEN '  .."Cust@Name' || {_s('o_custkey')} || '"' || chr(9)
                 WHEN 1 THEN ' Order Id (PK), v1.' || {_s('o_orderkey')} || chr(13) || chr(10)
                 WHEN 2 THEN '__é--' || o_orderpriority || '__'
                 ELSE 'Sales.' || o_orderstatus || '.T_' || {_s('o_custkey')} END AS name
        FROM {{orders}}""",
    "answers": f"""
        SELECT o_orderkey AS doc_id,
               CASE WHEN o_orderkey % 3 = 0 THEN 'Tables: ' ELSE '' END || 'src_' || {_s('o_custkey')}
               || ', dbo.' || o_orderstatus || ', ' || o_orderpriority || ' ' AS text
        FROM {{orders}}""",
    "fenced": """
        SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '```dot' WHEN 1 THEN '```graphviz' WHEN 2 THEN '```plaintext'
               ELSE '' END || chr(10) || text || chr(10) || '```' AS text
        FROM {documents}""",
    "statements": "SELECT doc_id, text FROM {documents}",
    "g1": f"""
        SELECT doc_id,
               'Tablespace: ' || source || chr(10) || 'Table: s.' || lang || {_s('doc_id')} || chr(10) || text
               || chr(10) || chr(10) || 'Term | Definition' || chr(10) || 'id | key of ' || {_s('doc_id')}
               || chr(13) || chr(10) || 'lang|  language ' || chr(10) || '------' || chr(10) || 'Table: s.other'
               || chr(10) || 'amt | amount' || chr(10) || '------' AS text
        FROM {{documents}}""",
    "g2": f"""
        SELECT doc_id,
               'Table: ' || lang || {_s('doc_id')} || chr(10) || 'Description: from ' || source || chr(10) || text
               || chr(10) || '- ID: key: unique ' || chr(10) || '- bad line' || chr(10) || '--Amt : amount'
               || chr(10) || 'Table: EMPTY' || chr(10) || 'Description: nothing' || chr(10) || 'Table: LAST'
               || chr(10) || '- only: one' AS text
        FROM {{documents}}""",
    "g3": f"""
        SELECT o_orderkey AS script_id, {_G3_HEAD} || {_G3_ROWS} || chr(10) ||
               CASE o_orderkey % 4 WHEN 0 THEN '| cut | row |' WHEN 1 THEN '------'
                 WHEN 2 THEN '| cut |' || chr(10) || '| again | x |' ELSE '' END AS text
        FROM {{orders}}""",
    "doc_rows": f"""
        SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS script_id, o_orderkey AS row_no,
               CASE WHEN o_orderkey % 4 = 1 THEN 'S/B' WHEN o_orderkey % 10 = 3 THEN 'N/A' ELSE o_orderpriority END AS layer,
               'about ' || o_orderstatus AS description,
               CASE WHEN o_orderkey % 5 = 1 THEN 'S/B' WHEN o_orderkey % 2 = 0 THEN '@t_' || {_s('o_orderkey % 17')}
                    ELSE 'r_' || {_s('o_orderkey % 17')} END AS table_name,
               'S/B' AS table_description, 'c_' || {_s('o_orderkey % 9')} AS column_name, 'INT' AS data_type,
               'text' AS column_description,
               CASE o_orderkey % 7 WHEN 0 THEN 'N/A' WHEN 1 THEN 'S/B'
                 ELSE 'src_' || {_s('o_orderkey % 13')} || ', @t_' || {_s('o_orderkey % 17 + 1')} END AS join_table,
               'id' AS join_column, 'a.id = b.id' AS join_statement,
               CASE o_orderkey % 3 WHEN 0 THEN 'src_' || {_s('o_orderkey % 11')} WHEN 1 THEN 'N/A' ELSE 'S/B' END
                 AS filter_table,
               'f' AS filter_column, 'f = 1' AS filter_statement,
               CASE WHEN o_orderkey % 6 = 0 THEN 'S/B' ELSE 'Purpose ' || {_s('o_orderkey % 23')} END
                 AS derivation_purpose
        FROM {{orders}}""",
    "step_rows": """
        SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN 'S/B' ELSE event_type END AS kind,
               CASE WHEN value < 5 THEN 'S/B' WHEN value < 8 THEN NULL WHEN value < 12 THEN 'N/A' ELSE props END AS mark
        FROM {events}""",
    "scripts": f"""
        SELECT o_orderkey AS script_id,
               '-- order ' || {_s('o_orderkey')} || ' from nowhere x' || chr(10)
               || 'WITH c_' || {_s('o_orderkey % 5')} || ' AS (SELECT r.id FROM raw_' || {_s('o_orderkey % 19')} || ' r)'
               || chr(10) || 'INSERT INTO @stg_' || {_s('o_orderkey % 31')} || ' SELECT a.id, b.amt' || chr(10)
               || 'FROM src_' || {_s('o_orderkey % 13')} || ' a LEFT JOIN dbo.cust_' || {_s('o_custkey % 17')}
               || ' AS b ON a.id = b.id AND b.flag = ''from x join y''' || chr(10)
               || 'JOIN c_' || {_s('o_orderkey % 5')} || ' ON a.id=c_' || {_s('o_orderkey % 5')} || '.id'
               || chr(10) || 'WHERE a.st <> 3 /* join z */ OR b.note IS NULL' || chr(10) || CASE o_orderkey % 15
                 WHEN 1 THEN 'MERGE INTO [dbo].[m_' || {_s('o_orderkey % 29')} || '] t USING "S"."q_1" s ON t.id = s.id '
                   || 'WHEN MATCHED THEN UPDATE SET a = 1'
                 WHEN 2 THEN 'UPDATE u_' || {_s('o_orderkey % 23')} || ' SET a = ''x--y'' FROM p_1 x, p_2 AS y, p_3 '
                   || 'WHERE x.id = y.id AND p_3.k = 4'
                 WHEN 3 THEN 'DELETE FROM d_' || {_s('o_orderkey % 11')} || ' WHERE id IN (SELECT e.id FROM e_1 e)'
                 WHEN 4 THEN 'insert @v_1 select z.id from @w_1 z, [w 2] v'
                 WHEN 5 THEN 'WITH k (i, j) AS (SELECT 1, ''it''''s -- not''), l AS(SELECT i FROM k) INSERT INTO n SELECT l.i FROM l'
                 WHEN 6 THEN ';SELECT a.id, sum(b.amt) AS amt INTO #tmp_' || {_s('o_orderkey % 29')} || ' FROM s6_1 a JOIN r6_1 b '
                   || 'ON a.dt >= b.lo AND a.dt < b.hi GROUP BY a.id'
                 WHEN 7 THEN 'CREATE TABLE ct_' || {_s('o_orderkey % 23')} || ' AS SELECT q.id FROM (SELECT x.id FROM s7_1 x) q, '
                   || 't7_' || {_s('o_custkey % 9')} || ' z WHERE z.id = q.id'
                 WHEN 8 THEN 'CREATE OR REPLACE VIEW v8_' || {_s('o_orderkey % 23')} || ' (y) AS SELECT EXTRACT(YEAR FROM o.dt) '
                   || 'FROM o8_1 o WHERE o.dt BETWEEN 1 AND 5'
                 WHEN 9 THEN 'CURSOR cur_' || {_s('o_orderkey % 29')} || ' IS SELECT h.id FROM h9_1 h WHERE h.flag NOT IN (1, 2) FOR UPDATE;'
                 WHEN 10 THEN 'DECLARE crs_1 CURSOR LOCAL FOR SELECT i.id FROM i10_' || {_s('o_custkey % 7')} || ' i;'
                   || 'FETCH NEXT FROM crs_1 INTO @x;'
                 WHEN 11 THEN 'DELETE g FROM g11_' || {_s('o_orderkey % 11')} || ' g JOIN [k 11] k ON g.id = k.id'
                 WHEN 12 THEN 'UPDATE y SET y.a = w.b FROM y12_' || {_s('o_orderkey % 11')} || ' y INNER JOIN w12_1 w ON y.id = w.id '
                   || 'WHERE w.ok IS NOT NULL'
                 WHEN 13 THEN ';SELECT trim(LEADING FROM u.nm) FROM u13_1 u WITH (NOLOCK), v13_1 (NOLOCK) '
                   || 'WHERE u.id = v13_1.id AND u.a IS DISTINCT FROM 3'
                 ELSE '' END AS text
        FROM {{orders}}""",
    "glossary5": f"""
        SELECT 'g' || {_s('o_orderkey % 2')} AS glossary_guid, o_orderkey AS row_no, ' conn' AS tablespace,
               CASE WHEN o_orderkey % 8 = 7 THEN 't_' ELSE ' S.t_' END || {_s('o_custkey % 40')} AS table_name,
               CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Orders, it''s ' || {_s('o_orderkey')} END AS table_description,
               o_orderpriority || CASE WHEN o_orderkey % 10 = 0 THEN ' (v' || {_s('o_orderkey % 50')} || ')' ELSE '' END
                 AS column_name,
               CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'It''s ' || o_orderstatus || {_s('o_orderkey')} END AS definition
        FROM {{orders}}""",
    "assets": f"""
        SELECT '."S".T_' || {_s('c_custkey % 35')} || ' ' AS name, 'guid_' || {_s('c_custkey')} AS guid, c_custkey AS pos
        FROM {{customer}}""",
    "existing_terms": f"""
        SELECT 'g' || {_s('o_orderkey % 2')} AS glossary_guid, 'S_t_' || {_s('o_custkey % 40')} || '_2HIGH' AS name
        FROM {{orders}} WHERE o_orderstatus = 'P' AND o_totalprice > 300000""",
    "sheet_glossary": """
        SELECT upper(p_brand) AS table_name, 'Parts of ' || p_type AS table_description, p_name AS column_name,
               'Size ' || CAST(p_size AS STRING) AS column_description, p_partkey AS row_no
        FROM {part}""",
    "script_tables": f"""
        SELECT s_suppkey AS script_id, 'stg_Brand#' || {_s('s_suppkey % 29')} || '.x' AS name FROM {{supplier}}
        UNION ALL
        SELECT s_suppkey AS script_id, 'dbo.brand#' || {_s('s_nationkey')} AS name FROM {{supplier}}""",
    "glossary_requests": f"""
        SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS name, p_partkey AS pos
        FROM {{part}}""",
    "glossary_registry": f"""
        SELECT 'bRand#' || {_s('c_custkey % 12')} AS name, 'guid_' || {_s('c_custkey')} AS guid, c_custkey AS pos
        FROM {{customer}}""",
    "numbered_chunks": """
        SELECT o_orderpriority AS run_id, o_orderkey AS chunk_no, 'chunk of ' || o_orderstatus AS text FROM {orders}""",
    "excerpts": f"""
        SELECT o_orderpriority AS run_id, o_orderkey AS chunk_no, 'Field ' || {_s('o_custkey')}
               || CASE WHEN o_custkey % 2 = 0 THEN chr(10) || '------' ELSE '' END AS excerpt
        FROM {{orders}} WHERE o_orderstatus = 'F'""",
    "text_rows": "SELECT source, doc_id, text FROM {documents}",
    "messages": """
        SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 'AI' WHEN turn % 6 = 4 THEN NULL ELSE role END
               AS role, text AS content
        FROM {conversations}""",
    "requests": f"""
        SELECT c_custkey AS conv_id, 'Document ' || c_name AS question,
               CASE WHEN c_custkey % 3 = 0 THEN '/u/' || {_s('c_custkey')} || '.sql' WHEN c_custkey % 3 = 1 THEN '' END AS path,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'LINEAGE' WHEN 'MACHINERY' THEN 'DEFINE' END AS agent
        FROM {{customer}}""",
    "agent_events": f"""
        SELECT user_id AS conv_id, event_id AS seq,
               CASE event_type WHEN 'click' THEN 'DefineAgent' WHEN 'view' THEN 'LineageExtractorAgent'
                 WHEN 'error' THEN 'DiscoverAgent' ELSE 'supervisor' END AS agent,
               CASE WHEN event_id % 5 < 3 THEN 'ai' WHEN event_id % 5 = 3 THEN 'tool' ELSE 'human' END AS msg_type,
               CASE WHEN event_id % 4 = 0 THEN 'DefineAgent' WHEN event_id % 4 = 1 THEN '' END AS msg_name,
               CASE WHEN event_id % 11 = 0 THEN 'DefineAgent' WHEN event_id % 11 = 1 THEN 'supervisor'
                 WHEN event_id % 11 = 2 THEN ''
                 WHEN event_id % 11 = 3 THEN 'Excel output saved to: `out/a ' || {_s('event_id')} || '.xlsx`'
                 WHEN event_id % 11 = 4 THEN 'Give the path [upload_required]'
                 ELSE 'Reply ' || props END AS content
        FROM {{events}}""",
    "replies": f"""
        SELECT o_orderkey AS id,
               CASE o_orderkey % 9
                 WHEN 0 THEN 'Give path ' || {_s('o_custkey')} || ' [upload_required] '
                 WHEN 1 THEN 'Give path [UPLOAD_REQUIRED]'
                 WHEN 2 THEN 'Send [Lineage_File_Upload_Required] ' || o_orderstatus
                 WHEN 3 THEN 'Send [lineage_file_upload_required] ' || o_orderstatus
                 WHEN 4 THEN 'Connection details please, saved to: a.csv'
                 WHEN 5 THEN 'Saved to: `out/a ' || {_s('o_orderkey')} || '.XLSX` ok'
                 WHEN 6 THEN 'saved to:' || chr(10) || ' out/' || o_orderstatus || '/' || {_s('o_orderkey')} || '.txt.'
                 WHEN 7 THEN 'Saved to: out/a.pdf'
                 ELSE 'Use the Discover Form ' || o_orderpriority END AS content,
               CASE o_orderkey % 4 WHEN 0 THEN 'DefineAgent' WHEN 1 THEN 'my LineageExtractorAgent'
                 WHEN 2 THEN 'DiscoverAgent' ELSE 'supervisor' END AS agent
        FROM {{orders}}
        UNION ALL
        SELECT -1 - conv_id * 1000 - turn AS id, text AS content, role AS agent FROM {{conversations}}""",
    "chunk_rows": f"""
        SELECT 's' || {_s('o_orderkey % 2')} AS sheet_id, CAST(FLOOR(o_orderkey / 14) AS BIGINT) AS chunk_no,
               o_orderkey % 14 * 3 AS pos,
               CASE WHEN FLOOR(o_orderkey / 60) % 5 = 4 THEN NULL
                    ELSE 't_' || CAST(CAST(FLOOR(o_orderkey / 60) AS BIGINT) AS STRING) END AS table_name
        FROM {{orders}}""",
    "span_rows": """
        SELECT o_custkey AS doc_id, o_orderkey AS row_no,
               CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE o_orderstatus END AS table_name
        FROM {orders}""",
    "budget_rows": f"""
        SELECT o_custkey AS script_id, o_orderkey AS row_no, 106000 + o_custkey % 20 * 1000 AS used_tokens
        FROM {{orders}}""",
    "catalogs": f"""
        SELECT DISTINCT o_orderpriority AS conn_id, o_custkey % 60 AS catalog_no,
               CASE WHEN o_custkey % 60 = 7 THEN 'System' ELSE 'cat_' || {_s('o_custkey % 60')} END AS catalog_name,
               o_custkey % 60 = 9 AS failed
        FROM {{orders}}""",
    "catalog_schemas": f"""
        SELECT DISTINCT o_orderpriority AS conn_id,
               CASE WHEN o_custkey % 60 = 7 THEN 'System' WHEN o_custkey % 60 < 4 THEN 'elsewhere'
                    ELSE 'cat_' || {_s('o_custkey % 60')} END AS catalog_name,
               o_orderkey % 50 AS schema_no, 'schema_' || {_s('o_orderkey % 50')} AS schema_name
        FROM {{orders}}""",
    "asset_entities": f"""
        SELECT 'guid_' || {_s('o_orderkey')} AS id, 'T_' || {_s('o_custkey')} AS name,
               CASE o_orderstatus WHEN 'F' THEN 'azure_sql_table' ELSE 'azure_sql_view' END AS entityType
        FROM {{orders}}""",
    "asset_json": f"""
        SELECT 'guid_' || {_s('o_orderkey')} AS guid,
               '{{{{"referredEntities":{{{{"g1":{{{{"typeName":"azure_sql_column","attributes":{{{{"name":"id_'
               || {_s('o_orderkey')} || '","data_type":"int","is_nullable":false,"description":"key of ' || o_orderpriority
               || '"}}}}}}}},"g2":{{{{"typeName":"azure_sql_table","attributes":{{{{"name":"t"}}}}}}}},"g3":{{{{"typeName":'
               || '"azure_sql_column","attributes":{{{{"name":"' || o_orderstatus || '","data_type":"text"}}}}}}}}}}}}}}}}' AS json
        FROM {{orders}}""",
}


def _tables(sql: str) -> list[str]:
    return sorted({f for _, f, _, _ in string.Formatter().parse(sql) if f})


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input as a DataFrame over the parquet tables below ``sf_dir``."""
    sql = SQL[name]
    tables = {t: spread(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in _tables(sql)}
    return spark.sql(sql, **tables)


def ctes(*names: str) -> str:
    """WITH items of inputs for a check SQL."""
    return ", ".join(
        f"{n} AS ({SQL[n].format(**{t: t for t in _tables(SQL[n])})})" for n in names
    )
