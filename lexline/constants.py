"""Values that must stay exactly as they are for results to be right."""

# Fixed value: the characters that count as white space at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Cell marks of documentation tables and the end mark of a text.
SAME_AS_ABOVE = "S/B"
NOT_APPLICABLE = "N/A"
END_MARK = "------"

# Schemas of a server that hold no user tables.
SYSTEM_SCHEMAS = (
    "INFORMATION_SCHEMA",
    "sys",
    "information_schema",
    "mysql",
    "performance_schema",
    "SYS",
    "SYSTEM",
    "OUTLN",
    "CTXSYS",
    "MDSYS",
)
SYSTEM_SCHEMA_PREFIXES = ("db_", "pg_")
SYSTEM_CATALOGS = ("system", "information_schema")

# Schema names that only stand in for "no schema".
PLACEHOLDER_SCHEMAS = ("purview", "main")

# Entity types in exported asset JSON.
ASSET_TABLE_TYPE = "azure_sql_table"
ASSET_COLUMN_TYPE = "azure_sql_column"

# Limits on text handed to a catalog.
SHORT_DESCRIPTION_CHARS = 250
TERM_NAME_CHARS = 255
TERM_STATUS = "Approved"

# Layout of schema texts.
COLUMNS_PER_LINE = 12
LINES_PER_SLICE = 3
TABLES_PER_CHUNK = 10

# Budgets in tokens.
ANALYSIS_TOKENS = 80_000
DIAGRAM_TOKENS = 116_800
DIAGRAM_RESERVE_TOKENS = 126_800
DIAGRAM_LOW_WATER = 6_000

# Columns of the documentation table, in file order.
LINEAGE_HEADERS = (
    "Layer",
    "Description",
    "Table",
    "Table Description",
    "Column",
    "Data Type",
    "Column Description",
    "Join Table",
    "Join Column",
    "Join Statement",
    "Filter Table",
    "Filter Column",
    "Filter Statement",
    "Derivation Purpose",
)
# Headers of the two glossary files.
GLOSSARY_HEADERS = ("Tablespace", "Table", "Table Description", "Column", "Definition")
SHEET_GLOSSARY_HEADERS = (
    "Table Name",
    "Table Description",
    "Column Name",
    "Column Description",
)

# Agents, their short names, and texts of a chat turn.
AGENTS = (
    ("DefineAgent", "DEFINE"),
    ("LineageExtractorAgent", "LINEAGE"),
    ("DiscoverAgent", "DISCOVER"),
)
SUPERVISOR = "supervisor"
FALLBACK_REPLY = (
    "I'm sorry, I encountered an issue and cannot respond right now. Please try rephrasing."
)

# Colours of the lineage diagram as (fill, border) per node kind, and edge colours.
NODE_COLOURS = {
    "source": ("#D0E8FF", "#3B82F6"),
    "temp": ("#D1FAD7", "#34D399"),
    "cte": ("#FFEED6", "#FB923C"),
    "final": ("#EDE7F6", "#A855F7"),
}
EDGE_COLOUR = "#4B5563"
FINAL_EDGE_COLOUR = "#14B8A6"


def snake(header: str) -> str:
    """Column name used inside the library for a file header."""
    return header.lower().replace(" ", "_")


LINEAGE_COLUMNS = tuple(
    {"Table": "table_name", "Column": "column_name"}.get(h, snake(h)) for h in LINEAGE_HEADERS
)
GLOSSARY_COLUMNS = ("tablespace", "table_name", "table_description", "column_name", "definition")
SHEET_GLOSSARY_COLUMNS = tuple(snake(h) for h in SHEET_GLOSSARY_HEADERS)

# First and last line of a structure report.
REPORT_HEAD = "Here are the catalogs and schemas found in your workspace:"
REPORT_TAIL = (
    "\nPlease review the list and tell me which catalog and which specific schema(s) you want me to "
    "generate a glossary for."
)
# Kinds of servers whose labels carry no key notes.
PLAIN_LABEL_KINDS = ("Databricks",)
