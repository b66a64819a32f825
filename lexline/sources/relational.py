"""Relational servers: read options by kind, and their dictionaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# URL form and driver class by kind of server.
URLS = {
    "Microsoft SQL Server": "jdbc:sqlserver://{host};databaseName={database};encrypt=true",
    "MySQL": "jdbc:mysql://{host}:{port}/{database}",
    "OracleDB": "jdbc:oracle:thin:@//{host}:{port}/{service}",
    "SQLite": "jdbc:sqlite:{database}",
    "PostgreSQL": "jdbc:postgresql://{host}:{port}/{database}",
}
DRIVERS = {
    "Microsoft SQL Server": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "MySQL": "com.mysql.cj.jdbc.Driver",
    "OracleDB": "oracle.jdbc.OracleDriver",
    "SQLite": "org.sqlite.JDBC",
    "PostgreSQL": "org.postgresql.Driver",
}
WINDOWS_LOGIN = "Windows Authentication"


def jdbc_options(config: Mapping[str, str]) -> tuple[dict[str, str] | None, str | None]:
    """(options, error) of a server; the password is an option, never part of the URL."""
    kind = config.get("rdbms", "")
    if kind not in URLS:
        return None, f"Unsupported kind of server: {kind}"
    values = dict(config)
    if kind == "SQLite":
        values["database"] = values.get("database", "").strip('"').replace("\\", "/")
    try:
        url = URLS[kind].format(**values)
    except KeyError as e:
        return None, f"Connection needs a value for {e.args[0]}"
    options = {"url": url, "driver": DRIVERS[kind]}
    if kind == "Microsoft SQL Server" and config.get("authentication") == WINDOWS_LOGIN:
        options["url"] += ";integratedSecurity=true"
    elif kind != "SQLite":
        options["user"] = config.get("username", "")
        options["password"] = config.get("password", "")
    return options, None


def jdbc_scan(
    spark: SparkSession,
    config: Mapping[str, str],
    source: str,
    *,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    num_partitions: int = 16,
    fetch_size: int = 10_000,
    predicates: Sequence[str] | None = None,
) -> DataFrame:
    """Read a table, or a query in parentheses with an alias, in ranges of a partition column, or by one task
    for each of ``predicates``, which must part the rows.

    Filters, column choice and limits on the result are pushed to the server.
    """
    options, error = jdbc_options(config)
    if error:
        raise ValueError(error)
    if predicates is not None:
        properties = {k: v for k, v in options.items() if k != "url"} | {"fetchsize": str(fetch_size)}
        return spark.read.jdbc(options["url"], source, predicates=list(predicates), properties=properties)
    reader = spark.read.format("jdbc").options(**options, dbtable=source, fetchsize=str(fetch_size))
    if partition_column and bounds:
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(num_partitions),
        )
    return reader.load()


# Queries on the dictionary views of each kind of server. Columns give schema_name,
# table_name, pos, column_name, data_type, is_nullable, column_default; constraints give
# schema_name, table_name, constraint_name, constraint_type and the first referred column; key usage
# gives the columns of each constraint.
_COLUMNS = (
    "SELECT table_schema AS schema_name, table_name, ordinal_position AS pos, column_name, data_type, "
    "is_nullable, column_default FROM information_schema.columns"
)
_KEY_USAGE = (
    "SELECT table_schema AS schema_name, table_name, constraint_name, column_name "
    "FROM information_schema.key_column_usage"
)
_CONSTRAINTS = (
    "SELECT tc.table_schema AS schema_name, tc.table_name, tc.constraint_name, tc.constraint_type, "
    "ref.table_name AS ref_table, ref.column_name AS ref_column "
    "FROM information_schema.table_constraints tc "
    "LEFT JOIN information_schema.referential_constraints rc "
    "ON rc.constraint_schema = tc.constraint_schema AND rc.constraint_name = tc.constraint_name "
    "LEFT JOIN information_schema.key_column_usage ref "
    "ON ref.constraint_schema = rc.unique_constraint_schema "
    "AND ref.constraint_name = rc.unique_constraint_name AND ref.ordinal_position = 1"
)
_SQL_SERVER_UNIQUE = (
    "FROM sys.indexes i JOIN sys.objects o ON o.object_id = i.object_id "
    "JOIN sys.schemas s ON s.schema_id = o.schema_id"
)
DICTIONARY = {
    "PostgreSQL": (_COLUMNS, _CONSTRAINTS, _KEY_USAGE),
    "MySQL": (
        _COLUMNS,
        "SELECT tc.table_schema AS schema_name, tc.table_name, tc.constraint_name, tc.constraint_type, "
        "ref.referenced_table_name AS ref_table, ref.referenced_column_name AS ref_column "
        "FROM information_schema.table_constraints tc LEFT JOIN information_schema.key_column_usage ref "
        "ON ref.table_schema = tc.table_schema AND ref.table_name = tc.table_name "
        "AND ref.constraint_name = tc.constraint_name AND ref.ordinal_position = 1",
        _KEY_USAGE,
    ),
    # Unique columns of this kind are those of its unique indexes.
    "Microsoft SQL Server": (
        _COLUMNS,
        _CONSTRAINTS + " WHERE tc.constraint_type IN ('PRIMARY KEY', 'FOREIGN KEY') "
        "UNION ALL SELECT s.name, o.name, i.name, 'UNIQUE', NULL, NULL " + _SQL_SERVER_UNIQUE
        + " WHERE i.is_unique = 1 AND i.is_primary_key = 0",
        "SELECT k.table_schema AS schema_name, k.table_name, k.constraint_name, k.column_name "
        "FROM information_schema.key_column_usage k JOIN information_schema.table_constraints tc "
        "ON tc.table_schema = k.table_schema AND tc.constraint_name = k.constraint_name "
        "WHERE tc.constraint_type IN ('PRIMARY KEY', 'FOREIGN KEY') "
        "UNION ALL SELECT s.name, o.name, i.name, c.name " + _SQL_SERVER_UNIQUE
        + " JOIN sys.index_columns ic ON ic.object_id = i.object_id AND ic.index_id = i.index_id "
        "JOIN sys.columns c ON c.object_id = ic.object_id AND c.column_id = ic.column_id "
        "WHERE i.is_unique = 1 AND i.is_primary_key = 0 AND ic.is_included_column = 0",
    ),
    "OracleDB": (
        "SELECT owner AS schema_name, table_name, column_id AS pos, column_name, data_type, "
        "CASE nullable WHEN 'Y' THEN 'YES' ELSE 'NO' END AS is_nullable, data_default AS column_default "
        "FROM all_tab_columns",
        "SELECT c.owner AS schema_name, c.table_name, c.constraint_name, CASE c.constraint_type "
        "WHEN 'P' THEN 'PRIMARY KEY' WHEN 'R' THEN 'FOREIGN KEY' WHEN 'U' THEN 'UNIQUE' END AS constraint_type, "
        "ref.table_name AS ref_table, ref.column_name AS ref_column FROM all_constraints c "
        "LEFT JOIN all_cons_columns ref ON ref.owner = c.r_owner "
        "AND ref.constraint_name = c.r_constraint_name AND ref.position = 1",
        "SELECT owner AS schema_name, table_name, constraint_name, column_name FROM all_cons_columns",
    ),
    "SQLite": (
        "SELECT 'main' AS schema_name, m.name AS table_name, p.cid + 1 AS pos, p.name AS column_name, "
        "p.type AS data_type, CASE p.\"notnull\" WHEN 1 THEN 'NO' ELSE 'YES' END AS is_nullable, "
        "p.dflt_value AS column_default FROM sqlite_master m JOIN pragma_table_info(m.name) p "
        "WHERE m.type = 'table'",
        "SELECT 'main' AS schema_name, m.name AS table_name, 'pk_' || m.name AS constraint_name, "
        "'PRIMARY KEY' AS constraint_type, NULL AS ref_table, NULL AS ref_column "
        "FROM sqlite_master m WHERE m.type = 'table' "
        "UNION ALL SELECT 'main', m.name, 'fk_' || m.name || f.id, 'FOREIGN KEY', f.\"table\", f.\"to\" "
        "FROM sqlite_master m JOIN pragma_foreign_key_list(m.name) f WHERE f.seq = 0 "
        "UNION ALL SELECT 'main', m.name, i.name, 'UNIQUE', NULL, NULL "
        "FROM sqlite_master m JOIN pragma_index_list(m.name) i WHERE i.origin = 'u'",
        "SELECT 'main' AS schema_name, m.name AS table_name, 'pk_' || m.name AS constraint_name, "
        "p.name AS column_name FROM sqlite_master m JOIN pragma_table_info(m.name) p WHERE p.pk > 0 "
        "UNION ALL SELECT 'main', m.name, 'fk_' || m.name || f.id, f.\"from\" "
        "FROM sqlite_master m JOIN pragma_foreign_key_list(m.name) f "
        "UNION ALL SELECT 'main', m.name, i.name, c.name FROM sqlite_master m "
        "JOIN pragma_index_list(m.name) i JOIN pragma_index_info(i.name) c WHERE i.origin = 'u'",
    ),
}


def dictionary_schemas(spark: SparkSession, config: Mapping[str, str]) -> list[str]:
    """Names of the schemas that a server's dictionary has columns of: one small query, one name a row."""
    columns, _, _ = DICTIONARY[config.get("rdbms", "")]
    found = jdbc_scan(spark, config, f"(SELECT DISTINCT schema_name FROM ({columns}) c) schemas")
    return sorted(r[0] for r in found.where(F.col("schema_name").isNotNull()).collect())


def schema_predicates(schemas: Sequence[str], groups: int = 16) -> list[str]:
    """Conditions that part a dictionary by schema, each schema in one of at most ``groups`` groups.

    Rows of schemas that are not named, such as one made after the list was read, are in the last group.
    """
    names = sorted(set(schemas))
    quoted = ["'" + n.replace("'", "''") + "'" for n in names]
    n = max(1, min(groups, len(quoted)))
    parts = [quoted[i::n] for i in range(n)]
    if not quoted:
        return ["1 = 1"]
    out = [f"schema_name IN ({', '.join(part)})" for part in parts]
    out.append(f"schema_name IS NULL OR schema_name NOT IN ({', '.join(quoted)})")
    return out


def read_dictionary(
    spark: SparkSession,
    config: Mapping[str, str],
    conn_id: str,
    schemas: Sequence[str] | None = None,
    groups: int = 16,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Columns, constraints and key usage of a whole server in three reads, tagged with its id.

    One read per view replaces the reads per table; choices of schema or table made on the result
    are pushed to the server. With ``schemas`` (see ``dictionary_schemas``) each view is read by as many
    tasks as there are groups of schemas, otherwise by one.
    """
    kind = config.get("rdbms", "")
    if kind not in DICTIONARY:
        raise ValueError(f"Unsupported kind of server: {kind}")
    predicates = None if schemas is None else schema_predicates(schemas, groups)
    columns, constraints, usage = (
        jdbc_scan(spark, config, f"({sql}) dictionary", predicates=predicates).select(F.lit(conn_id).alias("conn_id"), "*")
        for sql in DICTIONARY[kind]
    )
    return columns, constraints, usage
