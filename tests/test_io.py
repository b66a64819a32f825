"""Sources, sinks and their round trips, and the stream."""

import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lexline import constants as K
from lexline import session, sinks
from lexline.operators import catalog, chat, parse, publish
from lexline.plans import flows
from lexline.session import checkpoint_dir, durable
from lexline.sources import assets, files, relational, session_catalog
from lexline.streaming import fold

from test_fixtures import EVENTS

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_jdbc_options_by_kind():
    base = {"host": "h", "port": "1", "database": "d", "service": "s", "username": "u", "password": "p@:/"}
    for kind, url in [
        ("MySQL", "jdbc:mysql://h:1/d"),
        ("PostgreSQL", "jdbc:postgresql://h:1/d"),
        ("OracleDB", "jdbc:oracle:thin:@//h:1/s"),
        ("Microsoft SQL Server", "jdbc:sqlserver://h;databaseName=d;encrypt=true"),
    ]:
        options, error = relational.jdbc_options({**base, "rdbms": kind})
        assert error is None and options["url"] == url and options["password"] == "p@:/"
    options, _ = relational.jdbc_options(
        {**base, "rdbms": "Microsoft SQL Server", "authentication": "Windows Authentication"}
    )
    assert options["url"].endswith(";integratedSecurity=true") and "password" not in options
    options, _ = relational.jdbc_options({"rdbms": "SQLite", "database": '"C:\\a\\b.db"'})
    assert options["url"] == "jdbc:sqlite:C:/a/b.db"


def test_jdbc_errors_are_values():
    assert relational.jdbc_options({"rdbms": "Nothing"})[1] == "Unsupported kind of server: Nothing"
    assert relational.jdbc_options({"rdbms": "MySQL"})[1] == "Connection needs a value for host"


def test_schema_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text('row_no,Schema Name,Table Name,Column Name\n0,A,"T,1",a\n1,A,T2,b\n')
    got = files.schema_sheet(spark, str(tmp_path / "s.csv"), "x")
    assert rows(got, "sheet_id", "table_name", "column_name", "row_no") == [("x", "T,1", "a", 0), ("x", "T2", "b", 1)]
    (tmp_path / "t.csv").write_text("row_no,Schema Name,Table Name\n0,A,T\n")
    assert rows(files.schema_sheet(spark, str(tmp_path / "t.csv")), "column_name") == [(None,)]


def test_script_corpus(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.sql").write_bytes("SELECT 'é'".encode())
    (tmp_path / "sub" / "b.txt").write_bytes("SELECT 'é'".encode("utf-16"))
    (tmp_path / "c.md").write_text("no")
    got = files.script_corpus(spark, str(tmp_path), "T-SQL")
    assert [r[0] for r in rows(got, "text")] == ["SELECT 'é'"] * 2


def test_glossary_round_trip(spark, tmp_path):
    data = [(1, " conn", " s.t", 'Said "x",\nthen more', "id", "It's | a key"), (2, None, " s.t", None, "b", "c")]
    df = spark.createDataFrame(data, "row_no long, " + ", ".join(f"{c} string" for c in K.GLOSSARY_COLUMNS))
    path = str(tmp_path / "g")
    sinks.write_glossary(df, path)
    back = files.read_glossary(spark, path)
    assert rows(back, "row_no", *K.GLOSSARY_COLUMNS) == rows(df, "row_no", *K.GLOSSARY_COLUMNS)
    header = next((tmp_path / "g").glob("*.csv")).read_text().splitlines()[0]
    assert header.startswith('"Tablespace","Table","Table Description","Column","Definition"')


def test_sheet_glossary_and_documentation(spark, tmp_path):
    df = spark.createDataFrame([(1, "T", "d", "c", "x")], "row_no long, " + ", ".join(f"{c} string" for c in K.SHEET_GLOSSARY_COLUMNS))
    sinks.write_sheet_glossary(df, str(tmp_path / "s"))
    assert rows(files.glossary_sheet(spark, str(tmp_path / "s")), "table_name", "row_no") == [("T", 1)]
    cells = "|" + "|".join(f"v{i}" for i in range(14)) + "|"
    doc = parse.lineage_parse(spark.createDataFrame([("a", f"h\nh\n{cells}")], "script_id string, text string"))
    sinks.write_documentation(doc, str(tmp_path / "d"))
    back = spark.read.csv(str(tmp_path / "d"), header=True)
    assert back.columns == ["script_id", "row_no", *K.LINEAGE_HEADERS] and back.first()["Layer"] == "v0"


def test_lines_and_appended_text(spark, tmp_path):
    df = spark.range(1000).select(F.col("id"), F.concat(F.lit("line "), F.col("id")).alias("text")).repartition(7)
    sinks.write_lines(df, str(tmp_path / "l"), ["id"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "l").glob("part-*")))
    assert text.split("\n")[:-1] == [f"line {i}" for i in range(1000)]
    for _ in range(2):
        sinks.append_text(df.limit(1), str(tmp_path / "a"))
    assert spark.read.text(str(tmp_path / "a")).count() == 2


def test_texts_parse_back(spark):
    """Rows written as pipe text and parsed again are the same rows."""
    data = [(d, i, f" c{d}", f" s.t{d}", f"About {d}", f"col{i}", f"def {i}") for d in range(5) for i in range(4)]
    names = ("tablespace", "table_name", "table_description", "column_name", "definition")
    df = spark.createDataFrame(data, "doc_id int, i int, " + ", ".join(f"{c} string" for c in names))
    head = F.concat(F.lit("Tablespace:"), "tablespace", F.lit("\nTable:"), "table_name", F.lit("\n"), "table_description")
    line = F.concat_ws(" | ", "column_name", "definition")
    texts = df.groupBy("doc_id", head.alias("h")).agg(F.sort_array(F.collect_list(F.struct("i", line.alias("t")))).alias("l"))
    texts = texts.select("doc_id", F.concat("h", F.lit("\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n"), F.lit("\n------")).alias("text"))
    assert rows(parse.glossary_parse(texts), "doc_id", *names) == rows(df, "doc_id", *names)


def test_session_catalog_and_comments(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    spark.sql("DROP TABLE IF EXISTS shop.orders")
    spark.sql("CREATE TABLE shop.orders (id BIGINT NOT NULL, note STRING) USING parquet")
    try:
        assert ("spark_catalog",) in rows(session_catalog.list_catalogs(spark), "catalog_name")
        assert ("shop",) in rows(session_catalog.list_schemas(spark), "schema_name")
        assert rows(session_catalog.list_tables(spark, "shop"), "schema_name", "table_name") == [("shop", "orders")]
        columns = catalog.catalog_columns(session_catalog.table_columns(spark, "shop", "orders", "here"))
        assert [r[0] for r in rows(columns, "column_name")] == ["id", "note"]
        glossary = spark.createDataFrame(
            [
                (1, " shop.orders", "All 'orders'", "id", "It's the key"),
                (2, " shop.orders", "All 'orders'", "absent", "x"),
                (3, " shop.nothing", "Gone", "a", "x"),
            ],
            "row_no long, table_name string, table_description string, column_name string, definition string",
        )
        ddl = publish.comment_ddl(glossary, "spark_catalog", ["shop"])
        done = publish.apply_in_session(spark, ddl, str(tmp_path / "status"), rows_per_write=2)
        assert rows(publish.publish_summary(done), "succeeded", "failed") == [(1, 3)]
        again = publish.apply_in_session(spark, ddl, str(tmp_path / "status"), rows_per_write=2)
        assert rows(publish.publish_summary(again), "succeeded", "failed") == [(1, 3)]
        assert publish.failure_lines(done).count() == 3
        described = {r.col_name: r.comment for r in spark.sql("DESCRIBE shop.orders").collect()}
        assert described["id"] == "It's the key"
        extended = {r.col_name: r.data_type for r in spark.sql("DESCRIBE EXTENDED shop.orders").collect()}
        assert extended["Comment"] == "All 'orders'"
    finally:
        spark.sql("DROP DATABASE shop CASCADE")


def connect():
    def execute(statement):
        if "`bad`" in statement:
            raise RuntimeError("no such column\nmore")

    return execute


def test_comments_on_a_server(spark):
    glossary = spark.createDataFrame(
        [(1, "s.t", "d", "id", "x"), (2, "s.t", "d", "bad", "y")],
        "row_no long, table_name string, table_description string, column_name string, definition string",
    )
    done = publish.apply_comments(publish.comment_ddl(glossary, None, ["s"]), connect, num_connections=2)
    assert rows(done, "level", "column_name", "error") == [
        ("COLUMN", "bad", "no such column"),
        ("COLUMN", "id", None),
        ("TABLE", None, None),
    ]
    out = flows.publish_comments(glossary, None, ["s"], connect)
    assert rows(out["summary"], "succeeded", "failed") == [(1, 1)] and out["failures"].count() == 1


def test_asset_list_cap(spark):
    df = spark.createDataFrame(
        [(f"g{i:03d}", f"n{i}", "azure_sql_table" if i % 2 else "other") for i in range(200)],
        "id string, name string, entityType string",
    )
    assert assets.asset_list(df).count() == 100
    assert assets.asset_list(df, cap=50).count() == 50
    assert assets.asset_list(df, "other", cap=3).count() == 3


def test_durable_uses_the_named_folder(spark, tmp_path):
    named = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_dir(spark) == named
    kept = durable(spark.range(10))
    assert kept.count() == 10 and "range" not in kept._jdf.queryExecution().toString().lower()


def test_stream_equals_batch(spark, tmp_path):
    schema = "conv_id string, seq int, agent string, msg_type string, msg_name string, content string"
    data = [(c, e[0] + 10 * i, *e[1:4], e[4] + (f" {i}" if e[0] == 2 else "")) for c in "abc" for i in range(4) for e in EVENTS]
    for i in range(4):
        part = spark.createDataFrame(data[i::4], schema)
        part.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    latest = {}

    def sink(df, batch_id):
        for r in df.collect():
            latest[r.conv_id] = (r.content, r.agent)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = fold.fold_stream(stream, sink, str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = chat.fold_events(spark.createDataFrame(data, schema)).collect()
    assert latest == {r.conv_id: (r.content, r.agent) for r in batch} and len(latest) == 3


@pytest.mark.parametrize("column", ["row_no", None])
def test_written_glossary_without_numbers(spark, tmp_path, column):
    names = ", ".join(f"{c} string" for c in K.GLOSSARY_COLUMNS)
    df = spark.createDataFrame([("a", "b", "c", "d", "e")], names)
    if column:
        df = df.withColumn(column, F.lit(1).cast("long"))
    sinks.write_glossary(df, str(tmp_path / "g"))
    assert files.read_glossary(spark, str(tmp_path / "g")).columns == [*K.GLOSSARY_COLUMNS, *([column] if column else [])]


def test_a_bucketed_table_is_not_dealt_again(spark):
    rows = spark.range(400).select((F.col("id") * 7).alias("k"), F.col("id").cast("string").alias("t"))
    table = session.bucketed(rows, "k")
    with_small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in with_small}
    for name, value in with_small.items():
        spark.conf.set(name, value)
    try:
        joined = table.join(spark.range(0, 2_800, 14).withColumnRenamed("id", "k"), "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and joined.count() == 200
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lexline_")]
    assert sorted(table.collect()) == sorted(rows.collect())


def test_scratch_tables_go_and_kept_ones_stay(spark):
    scratch = session.Scratch(spark)
    scratch.remove()
    small = scratch.keep(spark.range(10))
    kept = session.durable(small.groupBy((F.col("id") % 3).alias("m")).count())
    assert Path(scratch.folder).exists()
    scratch.remove()
    assert not Path(scratch.folder).exists()
    assert sorted(kept.collect()) == [(0, 4), (1, 3), (2, 3)]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
