"""Hand-worked cases of FIXTURES.md."""

import collections
import random
import re
import sys
import tracemalloc

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql import functions as F

from lexline import constants as K
from lexline.functions import chat as C
from lexline.functions import text as X
from lexline.operators import catalog, chat, chunking, generate, joins, lineage, parse, publish, scripts
from lexline.operators.ordered import merge_spans
from lexline.plans import flows
from lexline.session import durable
from lexline.sources import assets

# The generators below run in Python workers, which cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def one(spark, expr, **cols):
    return spark.createDataFrame([Row(**cols)]).select(expr.alias("v")).first().v


def sheet_of(spark, tables):
    rows, n = [], 0
    for schema, table, columns in tables:
        for c in columns:
            rows.append(("x", schema, table, c, n))
            n += 1
    return spark.createDataFrame(
        rows, "sheet_id string, schema_name string, table_name string, column_name string, row_no long"
    )


F1 = [("A", "T1", "ab"), ("A", "T2", "cd"), ("B", "T3", "e"), ("B", "T4", "f"), ("B", "T5", "g")]


def test_f1_batches(spark):
    got = chunking.schema_batches(sheet_of(spark, F1)).orderBy("chunk_no", "table_no", "slice_no")
    assert values(got, "schema_name", "chunk_no", "table_name", "schema_header") == [
        ("A", 0, "T1", True),
        ("A", 0, "T2", False),
        ("B", 1, "T3", True),
        ("B", 1, "T4", False),
        ("B", 2, "T5", False),
    ]
    assert got.first().text == "\nTable: T1\nColumns: a, b\n"


def test_f1_wide_table_stays_in_one_chunk(spark):
    wide = [("A", "W", [f"c{i}" for i in range(73)]), ("A", "N", ["z"])]
    got = chunking.schema_batches(sheet_of(spark, wide)).orderBy("chunk_no", "table_no", "slice_no")
    assert values(got, "table_name", "chunk_no", "slice_no") == [
        ("W", 0, 0),
        ("W", 0, 1),
        ("W", 0, 2),
        ("N", 1, 0),
    ]
    lines = got.first().text.strip().split("\n")
    assert len(lines) == 4 and lines[1].startswith("Columns: c0, c1") and lines[1].endswith("c11,")


def greedy(sizes, chunk_size):
    held, chunk, out = 0, 0, []
    for n in sizes:
        if held > chunk_size:
            held, chunk = 0, chunk + 1
        out.append(chunk)
        held += n
    return out


def test_chunk_numbers_follow_the_counter(spark):
    sizes = [((i * 7919) % 83) + 1 for i in range(300)]
    rows = [("x", "S", f"t{i:04d}", i, n, i + 1) for i, n in enumerate(sizes)]
    tables = spark.createDataFrame(
        rows,
        "sheet_id string, schema_name string, table_name string, table_row long, n_columns long, table_no long",
    )
    for chunk_size in (1, 2, 5):
        got = chunking.chunk_numbers(tables, chunk_size, tables_per_block=16)
        slices = [-(-n // 36) for n in sizes]
        assert [r[1] for r in sorted(values(got, "table_no", "schema_chunk"))] == greedy(slices, chunk_size)


def test_schema_text_and_chunks10(spark):
    many = [("A", f"T{i}", [f"c{j}" for j in range(1 + 13 * (i % 2))]) for i in range(12)]
    sheet = sheet_of(spark, many)
    text = chunking.schema_text(sheet, rows_per_block=4).orderBy("schema_row", "table_no", "line_no")
    assert values(text, "table_name", "text")[:3] == [
        ("T0", "c0"),
        ("T1", ", ".join(f"c{j}" for j in range(12)) + ","),
        ("T1", "c12, c13"),
    ]
    chunks = chunking.schema_chunks(sheet).where("line_no = 0").orderBy("table_no")
    assert values(chunks, "chunk_no", "schema_header") == [
        (i // 10, i == 0) for i in range(12)
    ]


DICTIONARY = (
    "conn_id string, schema_name string, table_name string, pos int, column_name string, "
    "data_type string, is_nullable string, column_default string"
)


def f2_labels(spark):
    columns = spark.createDataFrame(
        [
            ("c", "s", "orders", 1, "id", "BIGINT", "NO", None),
            ("c", "s", "orders", 2, "cust", "BIGINT", "YES", ""),
            ("c", "s", "orders", 3, "st", "VARCHAR", "YES", "N"),
        ],
        DICTIONARY,
    )
    constraints = spark.createDataFrame(
        [
            ("c", "s", "orders", "pk", "PRIMARY KEY", None, None),
            ("c", "s", "orders", "fk", "FOREIGN KEY", "customers", "id"),
            ("c", "z", "orders", "pk", "PRIMARY KEY", None, None),
        ],
        "conn_id string, schema_name string, table_name string, constraint_name string, "
        "constraint_type string, ref_table string, ref_column string",
    )
    usage = spark.createDataFrame(
        [("c", "s", "orders", "pk", "id"), ("c", "s", "orders", "fk", "cust"), ("c", "z", "orders", "pk", "st")],
        "conn_id string, schema_name string, table_name string, constraint_name string, column_name string",
    )
    return catalog.column_labels(
        catalog.catalog_columns(columns), catalog.catalog_constraints(constraints, usage)
    )


def test_f2_f3_labels_overview_chunk(spark):
    labels = f2_labels(spark)
    want = [
        "id: (BIGINT) [Primary Key] [NOT NULL]",
        "cust: (BIGINT) [Foreign Key references customers.id] [NULL]",
        "st: (VARCHAR) [NULL, DEFAULT N]",
    ]
    assert [r[0] for r in values(labels.orderBy("pos"), "label")] == want
    conns = spark.createDataFrame([("c",), ("empty",)], "conn_id string")
    overview = catalog.table_overview(labels, conns)
    assert values(overview.orderBy("conn_id"), "conn_id", "metadata") == [("c", want), ("empty", None)]
    assert catalog.table_chunks(overview).first().text == (
        "Tablespace: c\nTable: s.orders\nMetadata: " + str(want) + "\n"
    )
    wide = spark.range(1, 1_202).select(
        F.lit("c").alias("conn_id"), F.lit("s").alias("schema_name"), F.lit("w").alias("table_name"),
        F.col("id").alias("pos"), F.concat(F.lit("c"), "id").alias("column_name"), F.lit("x").alias("label"),
    )
    assert [len(r[0]) for r in values(catalog.table_overview(wide), "metadata")] == [1_201]


def test_warehouse_labels(spark):
    columns = spark.createDataFrame([("c", "s", "t", 1, "id", "INT", "NO", "")], DICTIONARY)
    keys = spark.createDataFrame(
        [("c", "s", "t", "k", "PK", "id", None, None), ("c", "s", "t", "f", "FK", "id", None, None)],
        "conn_id string, schema_name string, table_name string, constraint_name string, kind string, "
        "column_name string, ref_table string, ref_column string",
    )
    rows = catalog.catalog_columns(columns, with_defaults=False)
    got = catalog.column_labels(rows, keys, repeat_primary=True)
    assert got.first().label == "id: (INT) [Primary Key] [Foreign Key] [NOT NULL, PRIMARY KEY]"
    assert catalog.plain_labels(rows).first().label == "id: (INT) [NOT NULL]"


def test_f4_user_schemas(spark):
    names = ["sales", "sys", "information_schema", "pg_catalog", "db_owner", "PG_X", "hr"]
    df = spark.createDataFrame([(n,) for n in names], "schema_name string")
    assert values(catalog.user_schemas(df), "schema_name") == [("sales",), ("PG_X",), ("hr",)]


F5 = (
    '{"referredEntities":{"g1":{"typeName":"azure_sql_column","attributes":{"name":"a","data_type":"int",'
    '"is_nullable":false,"description":"key"}},"g2":{"typeName":"azure_sql_table","attributes":{"name":"t"}},'
    '"g3":{"typeName":"azure_sql_column","attributes":{"name":"b","data_type":"text"}}}}'
)


def test_f5_assets(spark):
    columns = assets.asset_columns(spark.createDataFrame([("t1", F5)], "guid string, json string"))
    assert values(columns, "name", "type", "nullable", "description") == [
        ("a", "int", False, "key"),
        ("b", "text", True, ""),
    ]
    assert values(assets.asset_labels(columns), "label") == [("a: (int) [NOT NULL | key]",), ("b: (text)",)]
    assert values(assets.asset_labels(columns, notes=False), "label") == [("a: (int)",), ("b: (text)",)]


def test_f6_asset_match(spark):
    listed = spark.createDataFrame(
        [('.Sales."Orders"', "g1", 1), ("customers", "g2", 2), ("CUSTOMERS", "g3", 3)],
        "name string, guid string, pos int",
    )
    rows = spark.createDataFrame([(1, " Customers "), (2, "sales.orders"), (3, "none")], "row_no long, table_name string")
    got = dict(values(publish.asset_match(rows, listed), "table_name", "table_guid"))
    assert got == {" Customers ": "g3", "sales.orders": "g1", "none": None}


F7 = "Tablespace: conn\nTable: s.orders\nAll orders.\n\nTerm | Definition\nid | Order key\ncust | Buyer key\n------"


def test_f7_glossary(spark):
    docs = spark.createDataFrame(
        [(1, F7), (2, F7 + "\na | b | c"), (3, F7 + "\nTable: s.x\r\nk | v"), (4, "k | v")],
        "doc_id int, text string",
    )
    rows = values(
        parse.glossary_parse(docs).orderBy("doc_id", "pos"),
        "doc_id",
        "tablespace",
        "table_name",
        "table_description",
        "column_name",
        "definition",
    )
    head = (" conn", " s.orders", "All orders.")
    assert rows == [
        (1, *head, "id", "Order key"),
        (1, *head, "cust", "Buyer key"),
        (3, *head, "id", "Order key"),
        (3, *head, "cust", "Buyer key"),
        (3, " conn", " s.x", "------", "k", "v"),
        (4, None, None, None, "k", "v"),
    ]
    assert values(parse.rejected_responses(docs), "doc_id") == [(2,)]
    markdown = parse.glossary_markdown(docs.where("doc_id = 1")).orderBy("pos")
    assert "\n".join(r[0] for r in values(markdown, "text")) == (
        "\n### Tablespace: conn\n\n#### Table: s.orders\nAll orders.\n- **id**: Order key\n"
        "- **cust**: Buyer key\n------"
    )


def test_f8_define(spark):
    text = (
        "- early: lost\nTable: ORDERS\nDescription: All orders.\n- ID: Order key: unique\n- bad line\n"
        "Table: EMPTY\nDescription: nothing\nTable: LATE\n- a: b\nDescription: after"
    )
    rows = parse.define_parse(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert values(rows, "table_name", "table_description", "column_name", "column_description") == [
        ("ORDERS", "All orders.", "ID", "Order key: unique"),
        ("LATE", "after", "a", "b"),
    ]


def test_f9_context(spark):
    tables = spark.createDataFrame([(1, "stg_orders"), (1, "dbo.customers")], "script_id int, name string")
    glossary = spark.createDataFrame(
        [
            ("ORDERS", "All orders", "ID", "Key", 1),
            ("CUSTOMERS", "Buyers", "ID", "Key", 2),
            ("ORDERS", "ignored", "AMT", "Amount", 3),
            ("ITEMS", "Lines", "ID", "Key", 4),
        ],
        "table_name string, table_description string, column_name string, column_description string, row_no long",
    )
    got = scripts.glossary_context(tables, glossary).orderBy("table_row", "line_row")
    assert [r[0] for r in values(got, "text")] == [
        "ORDERS\nAll orders",
        "ID: Key",
        "AMT: Amount",
        "CUSTOMERS\nBuyers",
        "ID: Key",
    ]


def test_f9_comments(spark):
    rows = spark.createDataFrame(
        [
            (1, " s.orders", "All orders.", "id", "It's key"),
            (2, "S.orders", "Other", "b", ""),
            (3, "loose", None, None, "x"),
        ],
        "row_no long, table_name string, table_description string, column_name string, definition string",
    )
    got = publish.comment_ddl(rows, "c", ["s", "z"]).orderBy("level")
    assert values(got, "level", "ddl") == [
        ("COLUMN", "ALTER TABLE `c`.`s`.`orders` ALTER COLUMN `id` COMMENT 'It''s key'"),
        ("TABLE", "COMMENT ON TABLE `c`.`s`.`orders` IS 'All orders.'"),
    ]
    bare = publish.comment_ddl(rows.drop("table_description"), None, ["s"])
    assert values(bare, "ddl") == [("ALTER TABLE `s`.`orders` ALTER COLUMN `id` COMMENT 'It''s key'",)]


def test_f10_names(spark):
    for name, term, normal in [
        (" Order Id (PK), v1.2 ", "Order_Id_PK_v1_2", "order id (pk), v1.2"),
        ('.."Cust@Name"', "Cust_Name", "cust@name"),
        ("__é--x__", "x", "__é--x__"),
    ]:
        assert one(spark, X.sanitize_term(F.col("n")), n=name) == term
        assert one(spark, X.sanitize_term(X.sanitize_term(F.col("n"))), n=name) == term
        assert one(spark, X.normalize_name(F.col("n")), n=name) == normal


def terms_of(spark, existing):
    rows = spark.createDataFrame(
        [("g", 1, "t1", "id", "A"), ("g", 2, "t2", "id", "B"), ("g", 3, "t2", "id", "C"), ("g", 4, "t9", "x", "D")],
        "glossary_guid string, row_no long, table_name string, column_name string, definition string",
    )
    listed = spark.createDataFrame([("t1", "g1", 1), ("t2", "g2", 2)], "name string, guid string, pos int")
    taken = spark.createDataFrame([("g", e) for e in existing], "glossary_guid string, name string")
    got = publish.assign_terms(rows, listed, taken, rows_per_block=1).orderBy("row_no")
    return values(got, "term", "error")


def test_f11_terms(spark):
    missing = "Table 't9' not found in the asset list"
    assert terms_of(spark, []) == [
        ("id", None),
        ("t2_id", None),
        ("t2_id", "already exists"),
        ("x", missing),
    ]
    assert terms_of(spark, ["id"]) == [
        ("t1_id", None),
        ("t2_id", None),
        ("t2_id", "already exists"),
        ("x", missing),
    ]


def f12_text(last=None):
    def row(layer, table, column, join, filter_, purpose, other="N/A"):
        cells = [layer, other, table, other, column, other, other, join, other, other, filter_, other, other, purpose]
        return "| " + " | ".join(cells) + " |"

    head = ["| " + " | ".join(K.LINEAGE_HEADERS) + " |", "|" + " --- |" * 14]
    rows = [
        row("Load", "@stg", "id", "src_a, src_b", "src_a", "Join sources"),
        row("S/B", "S/B", "amt", "S/B", "S/B", "S/B", "S/B"),
        row("Report", "rpt", "id", "N/A", "@stg", "Filter active"),
    ]
    return "\n".join(head + rows + ([last] if last else []))


def f12_filled(spark):
    docs = spark.createDataFrame([(1, f12_text())], "script_id int, text string")
    return parse.fill_same_as_above(
        parse.lineage_parse(docs), ["script_id"], "row_no", list(K.LINEAGE_COLUMNS), bounded=True
    )


def test_f12_fill_edges_nodes_layers(spark):
    filled = f12_filled(spark)
    assert values(
        filled.where("row_no = 3"), "layer", "table_name", "column_name", "join_table", "filter_table", "data_type"
    ) == [("Load", "@stg", "amt", "src_a, src_b", "src_a", "N/A")]
    edges = lineage.lineage_edges(filled)
    assert sorted(values(edges, "src", "dst", "purpose_no", "filter_only", "to_final")) == [
        ("SRC_A", "STG", 1, False, False),
        ("SRC_B", "STG", 1, False, False),
        ("STG", "RPT", 2, True, True),
    ]
    nodes = lineage.lineage_nodes(filled)
    assert sorted(values(nodes, "name", "kind", "layer")) == [
        ("RPT", "final", "Report"),
        ("SRC_A", "source", None),
        ("SRC_B", "source", None),
        ("STG", "temp", "Load"),
    ]
    flagged = spark.createDataFrame([(1, "stg")], "script_id int, name string")
    assert ("STG", "cte") in values(lineage.lineage_nodes(filled, flagged), "name", "kind")
    spans = merge_spans(filled, ["script_id"], "row_no", ["layer", "table_name", "column_name"])
    assert sorted(values(spans, "column", "first_row", "last_row")) == [("layer", 2, 3), ("table_name", 2, 3)]


def test_f12_overwrite_sources(spark):
    got = lineage.normalise_entities(f12_filled(spark), overwrite_sources=True).where("row_no = 2")
    assert values(got, "table_name", "join_table", "filter_table") == [("STG", "STG", "STG")]
    own = lineage.normalise_entities(f12_filled(spark)).where("row_no = 2")
    assert values(own, "table_name", "join_table", "filter_table") == [("STG", "SRC_A, SRC_B", "SRC_A")]


def test_f12_trim(spark):
    texts = [
        f12_text(),
        f12_text("| a | b | c |"),
        f12_text("------"),
        f12_text("| cut |\n------ \n| again"),
        "h\n| --- |\n| only | partial |",
        " h ",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "script_id int, text string")
    got = [r[0] for r in values(parse.trim_partial_rows(docs).orderBy("script_id"), "text")]
    assert got == [texts[0], texts[0], texts[2], texts[3], "h\n| --- |", "h"]
    assert [generate.whole_rows(t) for t in texts] == got


def test_f12_empty_and_blank_cells(spark):
    line = "|a|b|c|d|e|f|g|| |x||x|x||"
    docs = spark.createDataFrame([(1, f"h\nh\n{line}\n{line}|\n| short |")], "script_id int, text string")
    rows = parse.lineage_parse(docs)
    assert rows.count() == 1
    assert values(rows, "join_table", "join_column", "filter_table", "derivation_purpose") == [
        ("S/B", "", "S/B", "S/B")
    ]


def test_f12_dot(spark):
    lines = lineage.dot_text(f12_filled(spark), bounded=True).orderBy("section", "item", "line_no")
    text = "\n".join(r[0] for r in values(lines, "text"))
    assert text.startswith("digraph lineage {") and text.endswith("}")
    assert '"SRC_A" -> "STG" [label="1", color="#4B5563"];' in text
    assert '"STG" -> "RPT" [label="2", color="#14B8A6", style=dashed];' in text
    assert 'label="STG \\\n\\n- id\\\n\\n- amt\\\n"];' in text
    assert '{ rank=same; label1; "STG" }' in text and "label1 -> label2 [style=invis];" in text
    assert text.count("{") == text.count("}")


def test_repeated_tail(spark):
    assert one(spark, lineage.drop_repeated_tail(F.col("t")), t="a\nb\nb\nb\ncut") == "a\nb"
    assert one(spark, lineage.drop_repeated_tail(F.col("t")), t="a\nb\nc") == "a\nb"
    assert one(spark, lineage.drop_repeated_tail(F.col("t")), t="cut") == ""


F13 = (
    "INSERT INTO @stg SELECT a.id, CASE WHEN b.id IS NULL THEN 'O' ELSE 'R' END\n"
    "FROM src_a a LEFT JOIN src_b b ON a.id = b.id AND b.flag = 'Y'"
)


def test_f13_script(spark):
    corpus = spark.createDataFrame([(1, F13)], "script_id int, text string")
    assert sorted(values(scripts.script_table_refs(corpus), "role", "name", "alias")) == [
        ("source", "SRC_A", "A"),
        ("source", "SRC_B", "B"),
        ("target", "STG", ""),
    ]
    assert sorted(values(scripts.script_joins(corpus), "use", "table_name", "column_name")) == [
        ("filter", "SRC_B", "FLAG"),
        ("join", "SRC_A", "ID"),
        ("join", "SRC_B", "ID"),
    ]
    short = one(spark, X.truncate_statement(F.col("t")), t=F13)
    assert short == "INSERT INTO @stg SELECT a.id, CASE WHEN b.id ..."


def test_f15_chat(spark):
    rows = [(1, i, r, str(i)) for i, r in enumerate(["user", "AI", "assistant", "system", None])]
    messages = spark.createDataFrame(rows, "conv_id int, turn int, role string, content string")
    assert values(chat.chat_normalize(messages).orderBy("turn"), "role") == [("human",), ("ai",), ("ai",), ("human",)]
    history = chat.chat_history(messages).collect()
    assert [[m.content for m in r.messages] for r in history] == [["0", "1", "2", "4"]]
    got = one(spark, C.prompt(F.col("q"), F.col("p"), F.col("a")), q="Go", p="/u/x.sql", a="LINEAGE")
    assert got == (
        "Go(Note: I have just uploaded a file available at path: /u/x.sql) "
        "(User has specified intent for agent: LINEAGE)"
    )
    assert one(spark, C.prompt(F.col("q"), F.col("p"), F.col("a")), q="Go", p="", a="") == "Go"


EVENTS = [
    (1, "supervisor", "ai", "", "DefineAgent"),
    (2, "DefineAgent", "ai", "DefineAgent", "Excel output saved to: `out/a b.xlsx`"),
    (3, "DefineAgent", "tool", "", "ok"),
    (4, "supervisor", "ai", "supervisor", ""),
]


def test_f16_fold(spark):
    rows = [("a", *e) for e in EVENTS] + [("b", *e) for e in EVENTS if e[0] != 2]
    events = spark.createDataFrame(
        rows, "conv_id string, seq int, agent string, msg_type string, msg_name string, content string"
    )
    requests = spark.createDataFrame([("a",), ("b",)], "conv_id string")
    got = chat.classify_response(chat.with_fallback(requests, chat.fold_events(events))).orderBy("conv_id")
    assert values(got, "content", "agent", "response_type", "filename") == [
        ("Excel output saved to: `out/a b.xlsx`", "DEFINE", "FILE", "a b.xlsx"),
        (K.FALLBACK_REPLY, None, "CHAT", None),
    ]


def test_f17_responses(spark):
    cases = [
        ("Give path [upload_required]", "DATASOURCE_FORM", "Give path", None),
        ("Give path [UPLOAD_REQUIRED]", "CHAT", None, None),
        ("Send [Lineage_File_Upload_Required]", "LINEAGE_FORM", None, None),
        ("Connection details please, saved to: a.csv", "DATASOURCE_FORM", None, None),
        ("Saved to: `out/a b.XLSX` ok", "FILE", None, "out/a b.XLSX"),
        ("Saved to: out/a.pdf", "FILE", None, None),
        ("hello", "CHAT", None, None),
    ]
    df = spark.createDataFrame([(i, c[0], "") for i, c in enumerate(cases)], "id int, content string, agent string")
    got = values(chat.classify_response(df).orderBy("id"), "content", "response_type", "server_path")
    assert got == [(c[2] or c[0], c[1], c[3]) for c in cases]


def test_find_or_create(spark):
    registry = spark.createDataFrame([("Sales", "g1", 1), ("SALES", "g2", 2)], "name string, guid string, pos int")
    asked = spark.createDataFrame([("sales", 1), ("New", 2), ("NEW", 3)], "name string, pos int")
    got = values(publish.find_or_create_glossary(asked, registry).orderBy("created"), "name", "guid", "created")
    assert got[0] == ("sales", "g1", False) and got[1][0] == "New" and got[1][2] and len(got) == 2


def test_structure_report(spark):
    catalogs = spark.createDataFrame(
        [("c", 0, "main", False), ("c", 1, "System", False), ("c", 2, "bad", True), ("c", 3, "bare", False)],
        "conn_id string, catalog_no long, catalog_name string, failed boolean",
    )
    schemas = spark.createDataFrame(
        [("c", "main", 1, "b"), ("c", "main", 0, "a"), ("c", "System", 0, "x")],
        "conn_id string, catalog_name string, schema_no long, schema_name string",
    )
    got = catalog.structure_report(catalogs, schemas).orderBy("catalog_no", "line_no")
    assert [r[0] for r in values(got, "text")][1:] == [
        "\nCatalog: `main`",
        "  - Schema: `a`",
        "  - Schema: `b`",
        "\nCatalog: `bad`",
        "  - (Could not fetch schemas)",
        "\nCatalog: `bare`",
        "  - (No schemas found in this catalog)",
        K.REPORT_TAIL,
    ]


def test_strip_matches_python(spark):
    for text in ["\x1c a b 　\r\n", " x\x85", "\t\v\f", "", "a"]:
        assert one(spark, X.strip(F.col("t")), t=text) == text.strip()


def test_quoted_list_matches_python(spark):
    items = ["a", "it's", 'say "x"', "it's \"both\"", "back\\slash"]
    got = one(spark, X.quoted_list(F.col("t")), t=items)
    assert got == str(items)


def stubborn(prompt, so_far):
    """Two rows more each time; the last line is cut until the third call."""
    n = so_far.count("\n") + 1 if so_far else 0
    return f"row {n}\nrow {n + 1}\n" + ("------" if n >= 3 else "cut")


def failing(prompt, so_far):
    raise RuntimeError("no answer")


def test_generation_rounds_and_errors(spark):
    chunks = spark.createDataFrame([("a", "p"), ("b", "p")], "k string, text string")
    got = generate.enrich(chunks, stubborn, max_rounds=None, num_partitions=2).orderBy("k").collect()
    assert got[0].text == "row 0\nrow 1\nrow 2\nrow 3\nrow 4\nrow 5\n------"
    assert got[0].rounds == 3 and got[0].complete and got[0].error is None
    capped = generate.enrich(chunks, stubborn, max_rounds=2).first()
    assert capped.rounds == 2 and not capped.complete and not capped.text.endswith("------")
    broken = generate.enrich(chunks, failing, max_rounds=3).collect()
    assert len(broken) == 2 and broken[0].error == "RuntimeError: no answer" and not broken[0].complete


def test_unfinished_texts_stand_apart(spark):
    labels = spark.createDataFrame(
        [("c", "s", "t", 1, "id", "id: (INT)")],
        "conn_id string, schema_name string, table_name string, pos int, column_name string, label string",
    )
    short = flows.discover_glossary(labels, stubborn, max_rounds=2)
    assert short["glossary"].count() == 0 and short["unfinished"].count() == 1
    whole = flows.discover_glossary(labels, stubborn, max_rounds=None)
    assert whole["unfinished"].count() == 0


def test_given_answers(spark):
    prompts = spark.createDataFrame([(1, "p"), (2, "p"), (3, "p")], "k int, text string")
    answers = spark.createDataFrame([(1, "a\n------"), (2, "b")], "k int, text string")
    got = generate.answered(prompts, answers, ["k"]).orderBy("k")
    assert values(got, "complete", "error") == [(True, None), (False, None), (False, "no answer")]


def rows_in_parts(prompt, so_far):
    lines = f12_text("------").split("\n")
    have = so_far.count("\n") + 1 if so_far else 0
    return "\n".join(lines[have : have + 3]) + ("\n| cut |" if have + 3 < len(lines) else "")


def test_documentation_loop():
    ask = generate.ask_until_end
    text, rounds, complete = ask(rows_in_parts, "script", generate.documentation_ending(), 10)
    assert rounds >= 2 and "cut" not in text and complete
    text, rounds, complete = ask(rows_in_parts, "script", generate.documentation_ending(budget=1), 10)
    assert rounds == 1 and not complete


def documented(prompt, so_far):
    """Rows of the two tables that the flow's script joins; the prompt must hold its context."""
    assert "Dialect: T-SQL" in prompt and "Context:\nsrc_a: about a" in prompt
    head = "| " + " | ".join(K.LINEAGE_HEADERS) + " |"
    same = ["S/B"] * 14
    first = ["Load", "d", "@stg", "t", "id", "N/A", "x", "src_a, src_b", "N/A", "N/A", "N/A", "N/A", "N/A", "Load it"]
    second = [*same]
    second[4] = "amt"
    return "\n".join([head, "|" + " --- |" * 14, *("| " + " | ".join(r) + " |" for r in (first, second)), "------"])


def test_script_flow(spark):
    corpus = spark.createDataFrame([(1, F13.replace("a.id,", "a.id, a.amt,"))], "script_id int, text string")
    contexts = spark.createDataFrame([(1, "src_a: about a")], "script_id int, context string")
    out = flows.script_lineage(corpus, documented, max_rounds=3, contexts=contexts, dialect="T-SQL")
    assert sorted(values(out["edges"], "src", "dst")) == [("SRC_A", "STG"), ("SRC_B", "STG")]
    assert values(out["documentation"].where("column_name = 'amt'"), "table_name") == [("@stg",)]
    assert values(out["sheet"].where("column_name = 'amt'"), "table_name", "join_table") == [("STG", "SRC_A, SRC_B")]
    assert ("table_name", 2, 3) in values(out["spans"], "column", "first_row", "last_row")
    assert flows.script_diagram(corpus, out["documentation"]).count() > 10


def test_sheet_prompts_carry_all_inputs(spark):
    sheet = sheet_of(spark, F1)
    excerpts = spark.createDataFrame([("x", 0, "dictionary of A")], "sheet_id string, chunk_no long, excerpt string")
    got = flows.sheet_prompts(sheet, description="a shop", excerpts=excerpts).orderBy("chunk_no")
    assert values(got, "description", "excerpt")[:2] == [("a shop", "dictionary of A"), ("a shop", "N/A")]


def test_script_reference_forms(spark):
    texts = {
        1: "SELECT * FROM s1 a, s2 b WHERE a.id = b.id AND b.k = 1",
        2: "MERGE INTO tgt t USING src s ON t.id = s.id WHEN MATCHED THEN UPDATE SET x = 1",
        3: "UPDATE tt SET a = 'a--b' FROM u1",
        4: "DELETE FROM dd WHERE id IN (SELECT id FROM kept)",
        5: 'INSERT INTO [dbo].[T1] SELECT * FROM "S"."T2"',
        6: "WITH a (x,y) AS (SELECT 1 FROM base) INSERT INTO t SELECT x FROM a",
        7: "insert @t select * from @p -- from nowhere",
    }
    df = spark.createDataFrame(list(texts.items()), "script_id int, text string")
    got = {}
    for k, name, role in values(scripts.script_table_refs(df), "script_id", "name", "role"):
        got.setdefault(k, set()).add((name, role))
    assert got == {
        1: {("S1", "source"), ("S2", "source")},
        2: {("TGT", "target"), ("SRC", "source")},
        3: {("TT", "target"), ("U1", "source")},
        4: {("DD", "target"), ("KEPT", "source")},
        5: {("DBO.T1", "target"), ("S.T2", "source")},
        6: {("A", "cte"), ("BASE", "source"), ("T", "target")},
        7: {("T", "target"), ("P", "source")},
    }
    assert ("filter", "S2", "K") in values(scripts.script_joins(df.where("script_id = 1")), "use", "table_name", "column_name")


SCANNED = {
    "SELECT a.x INTO #tmp FROM src a; SELECT v.y INTO v_a, v_b FROM w v": [
        ("#TMP", "target", ""), ("SRC", "source", "A"), ("W", "source", "V"),
    ],
    "CREATE TABLE IF NOT EXISTS c AS SELECT * FROM s; CREATE TABLE d (id int, k varchar(3) DEFAULT 'from x')": [
        ("C", "target", ""), ("S", "source", "S"),
    ],
    "create or replace view v (a, b) as with k as (select 1 from base) select * from k, z": [
        ("BASE", "source", "BASE"), ("K", "cte", ""), ("V", "target", ""), ("Z", "source", "Z"),
    ],
    "CURSOR c (p IN number) IS SELECT id FROM h FOR UPDATE; DECLARE d CURSOR LOCAL FOR SELECT 1 FROM g; FETCH NEXT FROM d INTO @x": [
        ("C", "target", ""), ("D", "source", "D"), ("D", "target", ""), ("G", "source", "G"), ("H", "source", "H"),
    ],
    "SELECT * FROM [my table] m, \"Other Table\" JOIN `x y`.`z` ON m.a = 1, last l": [
        ("LAST", "source", "L"), ("MY TABLE", "source", "M"), ("OTHER TABLE", "source", "OTHER TABLE"), ("X Y.Z", "source", "X Y.Z"),
    ],
    "SELECT * FROM (SELECT a FROM (SELECT b FROM deep) i) q (a, b), t2 z LEFT JOIN t3 ON f(z.a, 1) = 2, t4": [
        ("DEEP", "source", "DEEP"), ("T2", "source", "Z"), ("T3", "source", "T3"), ("T4", "source", "T4"),
    ],
    "SELECT * FROM (a JOIN b ON a.i = b.i) JOIN c USING (i, j), d": [
        ("A", "source", "A"), ("B", "source", "B"), ("C", "source", "C"), ("D", "source", "D"),
    ],
    "DELETE a FROM tgt a JOIN src s ON a.i = s.i; DELETE TOP (5) FROM other; DELETE FROM x WHERE y = 1": [
        ("OTHER", "target", ""), ("SRC", "source", "S"), ("TGT", "source", "A"), ("TGT", "target", ""), ("X", "target", ""),
    ],
    "UPDATE a SET a.v = s.v, w = 1 FROM dbo.tgt AS a, src s": [
        ("DBO.TGT", "source", "A"), ("DBO.TGT", "target", ""), ("SRC", "source", "S"),
    ],
    "SELECT EXTRACT(YEAR FROM o.dt), TRIM(LEADING FROM o.n) FROM o WHERE o.a IS DISTINCT FROM b AND EXISTS (SELECT 1 FROM e)": [
        ("E", "source", "E"), ("O", "source", "O"),
    ],
    "SELECT * FROM t WITH (NOLOCK), u x WITH (NOLOCK, INDEX(1)) JOIN v (NOLOCK) ON 1 = 1 CROSS APPLY f(x.a) y, generate(1, 2) g": [
        ("T", "source", "T"), ("U", "source", "X"), ("V", "source", "V"),
    ],
    "INSERT ALL INTO a (x) VALUES (1) INTO b VALUES (2) SELECT * FROM s; INSERT OVERWRITE TABLE c SELECT 1": [
        ("A", "target", ""), ("B", "target", ""), ("C", "target", ""), ("S", "source", "S"),
    ],
    "MERGE INTO t USING (SELECT * FROM s) q ON t.i = q.i WHEN MATCHED THEN UPDATE SET a = 1, b = 2 WHEN NOT MATCHED THEN INSERT (a) VALUES (1)": [
        ("S", "source", "S"), ("T", "target", ""),
    ],
    "CREATE TABLE k (i int REFERENCES p ON DELETE CASCADE ON UPDATE SET NULL); SELECT 1 FROM a UNION ALL SELECT 2 FROM b": [
        ("A", "source", "A"), ("B", "source", "B"),
    ],
    "SELECT 'it''s FROM x -- ' /* FROM y */ FROM z -- FROM w": [("Z", "source", "Z")],
    "": [],
}


def test_scripts_are_scanned_form_by_form(spark):
    df = spark.createDataFrame([*enumerate(SCANNED), (99, None)], "script_id int, text string")
    got = {i: [] for i in range(len(SCANNED))}
    for i, *ref in values(scripts.script_table_refs(df), "script_id", "name", "role", "alias"):
        got[i].append(tuple(ref))
    assert {text: sorted(got[i]) for i, text in enumerate(SCANNED)} == {t: sorted(r) for t, r in SCANNED.items()}


def test_script_conditions(spark):
    texts = {
        1: "SELECT * FROM a x JOIN b y ON x.lo >= y.d AND x.hi<y.d AND x.k <> 'n' WHERE NOT y.z IN (1) OR x.n IS NOT NULL",
        2: "UPDATE t SET t.a = s.b FROM s WHERE s.c NOT LIKE 'x%' AND s.d = @p AND t.i = s.i AND s.e BETWEEN 1 AND 2",
        3: "SELECT 1 FROM p a WHERE a.i = 1; SELECT 1 FROM q a WHERE a.j = 2; DELETE r WHERE zz.k = 3",
        4: "SELECT CASE WHEN a.x = 1 THEN 2 END FROM db.s.t a WHERE db.s.t.y > 3 AND a.w = (SELECT max(b.w) FROM b)",
        5: "MERGE tgt t USING src s ON t.id = s.id WHEN MATCHED THEN UPDATE SET t.v = s.v",
    }
    df = spark.createDataFrame(list(texts.items()), "script_id int, text string")
    got = {}
    for i, use, table, column in values(scripts.script_joins(df), "script_id", "use", "table_name", "column_name"):
        got.setdefault(i, set()).add((use, table, column))
    assert got == {
        1: {("join", "A", "LO"), ("join", "B", "D"), ("join", "A", "HI"), ("filter", "A", "K"), ("filter", "B", "Z"), ("filter", "A", "N")},
        2: {("filter", "S", "C"), ("filter", "S", "D"), ("filter", "S", "E"), ("join", "T", "I"), ("join", "S", "I")},
        3: {("filter", "P", "I"), ("filter", "Q", "J"), ("filter", "ZZ", "K")},
        4: {("filter", "DB.S.T", "Y"), ("filter", "DB.S.T", "W")},
        5: {("join", "TGT", "ID"), ("join", "SRC", "ID")},
    }


def test_long_scripts_and_literals(spark):
    literal = "'" + "a''" * 20_000 + "'"
    text = f"INSERT INTO t SELECT {literal} FROM s WHERE s.a = {literal};\n" + "SELECT a.x FROM u a;\n" * 2_000
    df = spark.createDataFrame([(1, text)], "script_id int, text string")
    assert sorted(values(scripts.script_table_refs(df), "name")) == [("S",), ("T",), ("U",)]


def test_empty_descriptions_make_no_comment(spark):
    rows = [(1, "t", "", "a", "x"), (2, "t", "real", "b", "y"), (3, "u", "", "c", "z")]
    df = spark.createDataFrame(
        rows, "row_no long, table_name string, table_description string, column_name string, definition string"
    )
    got = publish.comment_ddl(df, "c", ["s"]).where("level = 'TABLE'")
    assert [r[0].endswith("IS 'real'") for r in values(got, "ddl")] == [True]


def test_layers_without_entities_of_their_own_take_no_number(spark):
    rows = [(1, i, layer, name) for i, (layer, name) in enumerate(
        [("A", "t1"), ("B", "t1"), ("C", "t2"), ("N/A", "t3"), ("D", "t4")], 1)]
    filled = spark.createDataFrame(rows, "script_id int, row_no long, layer string, table_name string")
    got = dict((n, k) for n, k in values(lineage.layer_alignment(filled), "name", "layer_no"))
    assert got == {"T1": 1, "T2": 2, "T3": None, "T4": 3}


def test_runs_that_begin_at_one(spark):
    df = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b")], "run_id string, chunk_no long, text string")
    got = values(chunking.join_responses(df).orderBy("chunk_no"), "prefix")
    assert got == [("",), ("  \n",)]


def test_select_tables(spark):
    df = spark.createDataFrame([("A",), ("b",), ("c",)], "table_name string")
    assert values(catalog.select_tables(df, " a, B "), "table_name") == [("A",), ("b",)]
    assert catalog.select_tables(df, "ALL ").count() == 3


def test_report_lines(spark):
    results = spark.createDataFrame(
        [("COLUMN", "`t`", "a", None), ("COLUMN", "`t`", "b", "no such column"), ("TABLE", "`u`", None, "gone")],
        "level string, fq_table string, column_name string, error string",
    )
    assert values(publish.publish_summary(results), "succeeded", "failed") == [(1, 2)]
    assert values(publish.failure_lines(results), "line") == [
        ("- `t`.b: no such column",),
        ("- `u`.[TABLE_DESC]: gone",),
    ]


def test_report_file(spark):
    assert one(spark, X.report_file(F.col("n"), "_ETL_Documentation"), n="load.sql") == "load_ETL_Documentation"
    assert one(spark, X.report_file(F.col("n"), "_x"), n="a.txt") == "a_x"


def test_assets_of_one_name_stay_apart(spark):
    listed = spark.createDataFrame([("g1", "T"), ("g2", "T"), ("g3", "U")], "guid string, name string")
    details = spark.createDataFrame([(g, F5) for g in ("g1", "g2", "g3")], "guid string, json string")
    prompts = flows.asset_prompts(listed, details, "t")
    assert sorted(values(prompts, "guid", "table_name")) == [("g1", "T"), ("g2", "T")]
    assert all("\nTable: T\nMetadata: ['a" in t for (t,) in values(prompts, "text"))


def test_every_term_row_is_settled_once(spark):
    rng = random.Random(3)
    rows = [("g", i, rng.choice(["t1", "t2", "t9"]), rng.choice(["id", "id", "a b", "t1_id"]), "d") for i in range(200)]
    taken = {"a_b"}
    df = spark.createDataFrame(
        rows, "glossary_guid string, row_no long, table_name string, column_name string, definition string"
    )
    listed = spark.createDataFrame([("t1", "g1", 1), ("t2", "g2", 2)], "name string, guid string, pos int")
    existing = spark.createDataFrame([("g", t) for t in taken], "glossary_guid string, name string")
    got = publish.assign_terms(df, listed, existing, rows_per_block=20).collect()

    names, created = set(taken), {}
    known = [r for r in rows if r[2] != "t9"]
    for prefixed in (False, True):
        claimed = {}
        for r in known:
            base = r[3].replace(" ", "_")
            name = f"{r[2]}_{base}" if prefixed else base
            if r[1] not in created and name not in names and name not in claimed:
                claimed[name] = r[1]
        created.update({row: name for name, row in claimed.items()})
        names |= set(claimed)
    assert len(got) == len(rows)
    assert {r.row_no: r.term for r in got if r.error is None} == created
    assert len(set(created.values())) == len(created)


def test_fill_undoes_compress(spark):
    rng = random.Random(4)
    full = [(k, i, rng.choice("ab"), rng.choice(["N/A", "x"])) for i in range(120) for k in (rng.choice([0, 0, 1]),)]
    seen, short = {}, []
    for k, i, *cells in full:
        above = seen.get(k, [None, None])
        short.append((k, i, *[K.SAME_AS_ABOVE if c == a else c for c, a in zip(cells, above)]))
        seen[k] = cells
    schema = "k int, i long, a string, b string"
    got = parse.fill_same_as_above(spark.createDataFrame(short, schema), ["k"], "i", ["a", "b"], rows_per_block=8)
    assert sorted(values(got, "k", "i", "a", "b")) == sorted(full)


def test_context_lines_of_one_table_named_by_many_scripts(spark):
    tables = spark.range(1500).select(F.col("id").alias("script_id"), F.lit("stg_a").alias("name"))
    glossary = spark.range(5000).selectExpr(
        "'A' AS table_name", "'d' AS table_description", "'c' || id AS column_name", "'x' AS column_description", "id AS row_no"
    )
    lines = scripts.glossary_context(tables, glossary).where("line_row >= 0")
    tasks = lines.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in tasks) == 1500 * 5000


def test_block_join_moves_left_rows_in_packs(spark):
    left = spark.createDataFrame([(k, i % 40, "x" if i % 3 else None) for i in range(90) for k in ("a", "b", None)], "k string, i int, n string")
    right = spark.createDataFrame([(k, j, None if j % 4 else "y") for j in range(30) for k in ("a", "c", None)], "k string, j int, m string")
    left = left.unionByName(spark.createDataFrame([("c", 7, "one")], left.schema))
    want = sorted(map(str, left.join(right, "k").collect()))
    for sizes in ((4, 3, 2), (100, 7, 10), (1, 1, 1), (1_000, 1_000, 1_000)):
        got = joins.block_join(left, right, ["k"], ["i"], ["j"], *sizes)
        assert got.columns == ["k", "i", "n", "j", "m"] and sorted(map(str, got.collect())) == want
    # Rows of the right side go to as many blocks as there are for the left one, not to each pack.
    plan = joins.block_join(left, right, ["k"], ["i"], ["j"], 1_000, 3, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1 and plan.count("explode(_pack") == 1


def test_scripts_of_the_same_tables_share_a_context(spark):
    tables = spark.createDataFrame(
        [(1, "x_b.a"), (2, "A"), (2, "b"), (None, "a_B"), (3, "b"), (4, "none")], "script_id int, name string"
    )
    glossary = spark.createDataFrame(
        [("A", "all", "i", "key", 1), ("A", "", "n", None, 3), ("B", "buyers", "j", "id", 2)],
        "table_name string, table_description string, column_name string, column_description string, row_no long",
    )
    members, contexts = flows.shared_contexts(tables, glossary)
    assert contexts.count() == 2
    shown = scripts.with_contexts(members, members, contexts)
    both, one = "A\nall\ni: key\nB\nbuyers\nj: id\n\n", "B\nbuyers\nj: id\n\n"
    assert sorted(values(shown, "script_id", "context"), key=str) == [(1, both), (2, both), (3, one), (None, both)]
    plain = scripts.script_contexts(scripts.glossary_context(tables, glossary))
    assert sorted(values(plain, "script_id", "context"), key=str) == sorted(values(shown, "script_id", "context"), key=str)


def test_parquet_writers_hold_few_long_contexts(spark, tmp_path):
    members = spark.range(60).select(F.col("id").alias("script_id"), F.lit("A").alias("context_id"))
    contexts = spark.range(1).select(F.lit("A").alias("script_id"), F.repeat(F.lit("about a, "), 50_000).alias("context"))
    shown = scripts.with_contexts(members, members, contexts).select("script_id", "context").coalesce(1)
    shown.write.option("parquet.block.size", 1 << 20).option("compression", "none").parquet(str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("*.parquet")
    about = pq.ParquetFile(file).metadata
    assert about.num_rows == 60 and about.num_row_groups >= 15


def test_lines_of_a_context_are_not_python_objects():
    rows = [(r, n, t) for r in (2, 1, None) for n in (1, None, -1) for t in ("b", None, "a\n")]
    table = pa.table(
        {
            "script_id": pa.array(["k"] * len(rows)),
            "table_row": pa.array([r[0] for r in rows], pa.int64()),
            "line_row": pa.array([r[1] for r in rows], pa.int64()),
            "text": pa.array([r[2] for r in rows], pa.string()),
        }
    )
    first = lambda x: (x is not None, x)
    ordered = sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else "") for x in r))
    want = ""
    for (r, _, t), after in zip(ordered, [*ordered[1:], None]):
        end = after is None or (first(r) != first(after[0]) and r is not None and after[0] is not None)
        want += "" if t is None else t + ("\n\n" if end else "\n")
    assert scripts._context(table).to_pylist() == [{"script_id": "k", "context": want}]
    none = table.set_column(3, "text", pa.nulls(len(rows), pa.string()))
    assert scripts._context(none)["context"].to_pylist() == [""]
    many = pa.concat_tables([table] * 10_000)
    tracemalloc.start()
    try:
        assert len(scripts._context(many)["context"][0].as_py()) > 400_000
        assert tracemalloc.get_traced_memory()[1] < 4_000_000
    finally:
        tracemalloc.stop()


def test_prompts_of_shared_contexts(spark):
    corpus = spark.createDataFrame([(1, "s1"), (1, "again"), (2, "s2"), (None, "s"), (9, None)], "script_id int, text string")
    members = spark.createDataFrame([(1, "A"), (2, "A"), (None, "A"), (7, "B")], "script_id int, context_id string")
    contexts = spark.createDataFrame([("A", "about a"), ("B", "about b")], "script_id string, context string")
    shared = flows.script_prompts(corpus, contexts, "D", members)
    each = members.join(contexts.withColumnRenamed("script_id", "context_id"), "context_id")
    plain = flows.script_prompts(corpus, each, "D")
    assert sorted(values(shared, "script_id", "text"), key=str) == sorted(values(plain, "script_id", "text"), key=str)
    assert sum("about a" in text for _, text in values(shared, "script_id", "text")) == 3


def test_words_of_scripts_are_found_in_a_table_of_characters():
    inside = scripts._WORD[1:-1]
    ranges, singles = re.findall(".-.", inside), re.sub(".-.", "", inside)
    assert len(ranges) <= 2 and all(ord(c) < 256 for c in singles)
    assert re.fullmatch(f"{scripts._WORD}+", "AMZ059_$@#:\u00aa\u00c0\ud7ff" + scripts.SHIELDS)
    assert not re.search(scripts._WORD, " .,;()[]'\"-=<>\n\u00a9\ue000\ue00a\uff21az")


def test_scripts_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(scripts, "SCRIPTS_PER_TASK", 10)
    corpus = spark.range(200).coalesce(1).selectExpr("id AS script_id", "'SELECT * FROM a, b WHERE a.i = b.i' AS text")
    for found, n in ((scripts.script_joins(corpus), 400), (scripts.script_table_refs(corpus), 400)):
        tasks = [r.n for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert sum(tasks) == n and len(tasks) == 20 and max(tasks) <= 40


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_of_short_scripts_deal_rows_once(spark):
    cell = lambda x: None if x % 7 == 0 else ["", "N/A", "a, b", "@b", "c,a", "D"][x % 6]
    draw = random.Random(3)
    rows = [
        (None if k == 4 else k, n, *[cell(draw.randrange(50)) for _ in range(3)], f"P{draw.randrange(4)}" if n % 3 else "N/A")
        for k in range(5)
        for n in range(12)
    ]
    filled = spark.createDataFrame(
        rows, "script_id int, row_no int, table_name string, join_table string, filter_table string, derivation_purpose string"
    )
    short, long = lineage.lineage_edges(filled, bounded=True), lineage.lineage_edges(filled)
    assert short.dtypes == long.dtypes
    assert sorted(map(str, short.collect())) == sorted(map(str, long.collect())) and short.count() > 20
    assert plan_of(lineage.lineage_edges(filled, bounded=True)).count("Exchange hashpartitioning") <= 2


def test_diagram_reads_its_parts_once_and_cuts_long_scripts(spark):
    r = random.Random(8)
    names = ["@t", "#u ", "a", " b", "c@", "N/A", "S/B", "", None]
    cells = ["x, a", "b,@t,,N/A", "c", "N/A", "", None, "y ,\t#u"]
    table = [
        (r.choice([1, 1, 1, 2, 3]), i, r.choice(["l", "m", "n", "N/A", None]), r.choice(names), r.choice(["k", "v", "N/A", None]),
         r.choice(cells), r.choice(cells), r.choice(["p", 'q"', "N/A", "", None]))
        for i in range(200)
    ]
    columns = "layer string, table_name string, column_name string, join_table string, filter_table string, derivation_purpose string"
    filled = spark.createDataFrame(table, f"script_id int, row_no long, {columns}")
    ctes = spark.createDataFrame([(1, "a"), (2, "zz")], "script_id int, name string")
    want = collections.Counter(map(tuple, lineage.dot_text(filled, ctes, bounded=True).collect()))
    long, short = lineage.dot_text(filled, ctes, rows_per_block=3), lineage.dot_text(filled, ctes)
    # Nodes, legend, edges and layers are each read once for all their lines, not once for each kind of line.
    assert plan_of(short).count("FileScan parquet") <= 7
    assert collections.Counter(map(tuple, long.collect())) == collections.Counter(map(tuple, short.collect())) == want
    nodes = lineage.lineage_nodes(filled, rows_per_block=3)
    assert sorted(map(str, nodes.collect())) == sorted(map(str, lineage.lineage_nodes(filled, bounded=True).collect()))
    # A cell is stripped once for each row: neither a filter nor the explode works it out again.
    kept = durable(filled)
    assert plan_of(lineage.node_columns(kept)).count("trim(table_name") == plan_of(lineage._edge_rows(kept)).count("trim(table_name") == 1
