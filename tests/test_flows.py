"""Streams with bounded state, listings by tasks, versions, whole sheets and diagrams in rounds."""

import json
import os
import sys
import time

import pytest
from pyspark import cloudpickle

from lexline import constants as K
from lexline import sinks
from lexline.operators import catalog, chat, chunking, spans
from lexline.plans import flows
from lexline.sources import catalog_listing, relational, versions
from lexline.streaming import fold, turns

# Functions of this module go to the tasks with the plan: tasks do not import tests.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write_files(folder, files):
    """JSON files in the order of their modification."""
    folder.mkdir()
    begin = time.time() - 1_000
    for i, rows in enumerate(files):
        path = folder / f"{i:03d}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(path, (begin + i, begin + i))
    return str(folder)


def event(conv, seq, minute, content, msg_type="ai"):
    at = f"2024-05-01T{10 + minute // 60:02d}:{minute % 60:02d}:00Z"
    return {"conv_id": conv, "seq": seq, "agent": "DefineAgent", "msg_type": msg_type, "msg_name": "", "content": content, "ts": at}


EVENTS = "conv_id string, seq long, agent string, msg_type string, msg_name string, content string, ts timestamp"


@pytest.fixture
def timers(spark):
    before = spark.conf.get(fold.STATE_STORE)
    spark.conf.set(fold.STATE_STORE, fold.ROCKS_DB)
    yield
    spark.conf.set(fold.STATE_STORE, before)


def run_stream(df, tmp_path, mode):
    """Rows of each batch of a stream that ends when its input does."""
    batches = []

    def sink(rows, batch_id):
        batches.append([r.asDict() for r in rows.collect()])

    query = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .foreachBatch(sink)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(240)
    assert query.exception() is None
    return batches


def test_a_conversation_goes_after_its_time(spark, tmp_path, timers):
    files = [
        [event("a", 5, 0, "first"), event("a", 6, 1, "DefineAgent"), event("b", 1, 0, "of b")],
        [event("a", 4, 2, "older"), event("c", 1, 50, "of c")],  # within a's time; c moves the watermark past it
        [event("c", 2, 55, "again c")],
        [event("a", 1, 60, "anew"), event("d", 1, 100, "of d")],
        [event("d", 2, 101, "last")],
    ]
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(write_files(tmp_path / "in", files))
    got = [r for batch in run_stream(fold.fold_with_expiry(stream, "30 minutes", "1 minute"), tmp_path, "update") for r in batch]
    a = [(r["content"], r["closed"]) for r in got if r["conv_id"] == "a"]
    # The lower seq does not replace the first reply while its state is there; afterwards it opens anew.
    assert a[:3] == [("first", False), ("first", False), ("first", True)]
    assert a[3:] == [("anew", False), ("anew", True)]
    assert [(r["content"], r["closed"]) for r in got if r["conv_id"] == "b"] == [("of b", False), ("of b", True)]
    assert ("last", True) not in [(r["content"], r["closed"]) for r in got]


def test_state_with_timers_needs_its_store(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        fold.fold_with_expiry(spark.createDataFrame([], EVENTS))
    assert fold.milliseconds("90 seconds") == 90_000 and fold.milliseconds("2 hours") == 7_200_000
    with pytest.raises(ValueError):
        fold.milliseconds("soon")


REQUESTS = "conv_id string, question string, path string, agent string, asked_at timestamp"


def request(conv, minute, question="Go"):
    return {"conv_id": conv, "question": question, "path": "", "agent": "", "asked_at": event("", 0, minute, "")["ts"]}


def test_turns_as_a_stream(spark, tmp_path):
    asked = [[request("a", 0), request("b", 1)], [request("c", 2), request("d", 30)], [request("later", 200)], [request("later", 300)]]
    said = [
        [event("a", 1, 1, "Working"), event("a", 3, 2, "saved to: out/x.csv"), event("b", 1, 2, "DefineAgent")],
        [event("a", 2, 3, "between"), event("c", 1, 2, "Give path [upload_required]"), event("c", 9, 40, "too late")],
        [event("later", 1, 200, "x")],
        [event("later", 2, 300, "x")],
    ]
    messages = spark.createDataFrame(
        [("a", 0, "user", "Hi"), ("a", 1, "assistant", "Hello"), ("b", 0, "system", "rules")],
        "conv_id string, turn int, role string, content string",
    )
    r_path, e_path = write_files(tmp_path / "requests", asked), write_files(tmp_path / "events", said)

    def read(reader):
        return reader.schema(REQUESTS).json(r_path), reader.schema(EVENTS).json(e_path)

    requests = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).json(r_path)
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(e_path)
    rows = [r for b in run_stream(turns.chat_turn_stream(requests, events, messages), tmp_path, "append") for r in b]
    streamed = {r["conv_id"]: r for r in rows if r["conv_id"] != "later"}
    assert len([r for r in rows if r["conv_id"] != "later"]) == len(streamed) == 4

    table = turns.chat_turn_stream(spark.read.schema(REQUESTS).json(r_path), spark.read.schema(EVENTS).json(e_path), messages)
    batch = {r["conv_id"]: r.asDict() for r in table.where("conv_id <> 'later'").collect()}
    assert streamed == batch
    # The plain batch flow has the same replies where all events lie in time.
    plain = flows.chat_turns(
        spark.read.schema(REQUESTS).json(r_path), spark.read.schema(EVENTS).json(e_path).where("content <> 'too late'"), messages
    )
    for r in plain.where("conv_id <> 'later'").collect():
        assert {k: streamed[r["conv_id"]][k] for k in r.asDict()} == r.asDict()
    assert streamed["a"]["response_type"] == "FILE" and streamed["b"]["content"] == K.FALLBACK_REPLY
    assert streamed["c"]["content"] == "Give path" and streamed["d"]["content"] == K.FALLBACK_REPLY
    assert [tuple(m) for m in streamed["a"]["messages"]] == [("human", "Hi"), ("ai", "Hello"), ("human", "Go")]
    assert [tuple(m) for m in streamed["b"]["messages"]] == [("human", "Go")]


def test_a_batch_that_runs_again_replaces_its_own(spark, tmp_path):
    path = str(tmp_path / "texts")
    for _ in range(2):
        sinks.append_text(spark.createDataFrame([("one",), ("two",)], "text string"), path, 0)
        sinks.append_text(spark.createDataFrame([("three",)], "text string"), path, 1)
    assert sorted(r[0] for r in spark.read.text(path).select("value").collect()) == ["one", "three", "two"]


class Shop:
    """A server with a catalog that fails, one without schemas, and a schema whose tables can't be listed."""

    def catalogs(self):
        return ["main", "broken", "bare", "System"]

    def schemas(self, catalog):
        if catalog == "broken":
            raise PermissionError("no access\nto it")
        return {"main": ["sales", "hidden"], "System": ["x"]}.get(catalog, [])

    def tables(self, catalog, schema):
        if schema == "hidden":
            raise OSError("gone")
        return ["orders", "items"]


def test_a_server_is_listed_by_tasks(spark):
    listing = catalog_listing.list_server(spark, Shop, "shop", tables=True)
    assert listing.rdd.getNumPartitions() == 4
    got = [tuple(r)[2:] for r in listing.orderBy("catalog_no", "schema_no", "table_no").collect()]
    assert got == [
        ("main", 0, "sales", 0, "orders", None),
        ("main", 0, "sales", 1, "items", None),
        ("main", 1, "hidden", None, None, "OSError: gone"),
        ("broken", None, None, None, None, "PermissionError: no access"),
        ("bare", None, None, None, None, None),
        ("System", 0, "x", 0, "orders", None),
        ("System", 0, "x", 1, "items", None),
    ]
    report = catalog.structure_report(*catalog_listing.report_inputs(listing)).orderBy("catalog_no", "line_no")
    assert [r["text"] for r in report.collect()][1:-1] == [
        "\nCatalog: `main`", "  - Schema: `sales`", "  - Schema: `hidden`",
        "\nCatalog: `broken`", "  - (Could not fetch schemas)",
        "\nCatalog: `bare`", "  - (No schemas found in this catalog)",
    ]
    assert catalog_listing.list_server(spark, Shop, "shop").where("table_name IS NOT NULL").count() == 0


def test_a_dictionary_is_read_by_groups_of_schemas():
    names = [f"s{i}" for i in range(10)] + ["it's"]
    parts = relational.schema_predicates(names, 4)
    assert len(parts) == 5 and parts[-1].startswith("schema_name IS NULL OR schema_name NOT IN (")
    listed = [n.strip() for p in parts[:-1] for n in p.removeprefix("schema_name IN (").removesuffix(")").split(",")]
    assert sorted(listed) == sorted([*(f"'{n}'" for n in names[:-1]), "'it''s'"])
    assert relational.schema_predicates([], 4) == ["1 = 1"] and len(relational.schema_predicates(["a"], 4)) == 2


def test_a_registry_takes_each_name_once(spark, tmp_path):
    path = str(tmp_path / "registry")
    asked = spark.createDataFrame([("Sales", 1), ("SALES", 2), ("New", 3)], "name string, pos int")
    first = {r["name"]: r for r in versions.register_glossaries(spark, asked, path).collect()}
    assert set(first) == {"Sales", "New"} and all(r["created"] for r in first.values())
    again = {r["name"]: r for r in versions.register_glossaries(spark, asked, path).collect()}
    assert {k: r["guid"] for k, r in again.items()} == {k: r["guid"] for k, r in first.items()}
    assert not any(r["created"] for r in again.values()) and versions.latest(spark, path) == 1
    versions.register_glossaries(spark, spark.createDataFrame([("Third", 1), ("new", 2)], "name string, pos int"), path)
    rows = versions.read(spark, path).collect()
    assert sorted(r["name"] for r in rows) == ["New", "Sales", "Third"] and len({r["pos"] for r in rows}) == 3
    assert versions.read(spark, path, version=1).count() == 2


def test_a_slower_writer_reads_again(spark, tmp_path):
    path, calls = str(tmp_path / "registry"), []

    def made(rows):
        calls.append(rows.count())
        if len(calls) == 1:  # another session is faster
            versions.register_glossaries(spark, spark.createDataFrame([("other", 1)], "name string, pos int"), path)
        return rows.unionByName(spark.createDataFrame([("mine", "g", 9)], versions.REGISTRY))

    assert versions.change(spark, path, made) == 2 and calls == [0, 1]
    assert sorted(r["name"] for r in versions.read(spark, path).collect()) == ["mine", "other"]


def test_push_of_a_glossary(spark, tmp_path):
    glossary = spark.createDataFrame(
        [("sales", 1, "s.t", "id", "key"), ("SALES", 2, "s.t", "id", "again")],
        "glossary_name string, row_no long, table_name string, column_name string, definition string",
    )
    names = spark.createDataFrame([("s.t", "guid-t", 1)], "name string, guid string, pos long")
    existing = spark.createDataFrame([], "glossary_guid string, name string")
    asked = spark.createDataFrame([("Sales", 1)], "name string, pos int")
    for created in (True, False):
        out = flows.push_glossary(spark, asked, glossary, str(tmp_path / "r"), names, existing)
        assert [r["created"] for r in out["glossaries"].collect()] == [created]
        assert sorted(r["term"] for r in out["terms"].collect()) == ["id", "s_t_id"]


def test_sheet_rows_run_over_chunks(spark):
    rows = [("x", c, p, t) for c, p, t in [(0, 3, "A"), (0, 7, "A"), (2, 0, "A"), (2, 4, "B"), (10, 1, "B"), (10, 2, None), (11, 0, None)]]
    df = spark.createDataFrame([*rows, ("y", 0, 0, "A")], "sheet_id string, chunk_no long, pos int, table_name string")
    for size in (1, 2, 1_000_000):
        numbered = spans.sheet_rows(df, rows_per_block=size).where("sheet_id = 'x'").orderBy("sheet_row")
        assert [(r["sheet_row"], r["table_name"]) for r in numbered.collect()] == [(i + 2, r[3]) for i, r in enumerate(rows)]
        got = spans.sheet_spans(df, rows_per_block=size).orderBy("first_row").collect()
        assert [(r["table_name"], r["first_row"], r["last_row"]) for r in got] == [("A", 2, 4), ("B", 5, 6)]


def two_columns(prompt, so_far):
    return "Table: T\nDescription: one\n- a: x\n- b: y\n------"


def test_spans_of_a_defined_glossary_are_over_the_sheet(spark):
    sheet = spark.createDataFrame(
        [("x", "S", t, f"c{i}", 10 * n + i) for n, t in enumerate("ABC") for i in range(2)],
        "sheet_id string, schema_name string, table_name string, column_name string, row_no long",
    )
    out = flows.define_glossary(sheet, two_columns, max_rounds=1)
    assert out["texts"].count() == 2  # a chunk closes when it holds more than one slice
    assert [(r["first_row"], r["last_row"]) for r in out["spans"].collect()] == [(2, 5)]
    assert sorted(r["sheet_row"] for r in out["sheet"].collect()) == [2, 3, 4, 5]
    assert {r["doc_id"] for r in out["glossary"].collect()} == {"x/000000000000", "x/000000000001"}


def test_sections_of_a_sheet(spark):
    rows = [("S1", "A", f"c{i}") for i in range(13)] + [("S2", "C", "x"), ("S1", "B", "y")]
    sheet = spark.createDataFrame(
        [("x", *r, i) for i, r in enumerate(rows)],
        "sheet_id string, schema_name string, table_name string, column_name string, row_no long",
    )

    def text(df, *order):
        return "".join(r["text"] for r in df.orderBy(*order).collect())

    first = ", ".join(f"c{i}" for i in range(12))
    whole = text(chunking.sheet_sections(sheet), "schema_row", "table_no", "line_no")
    assert whole == (
        f"\nSCHEMA: S1\nTable: A\nColumns:\n{first},\nc12\n\nTable: B\nColumns:\ny\n\nSCHEMA: S2\nTable: C\nColumns:\nx\n"
    )
    names = text(chunking.table_sections(sheet), "schema_row", "table_no")
    assert names == "\nSCHEMA: S1\nTable: A\nTable: B\nSCHEMA: S2\nTable: C"
    chunk = text(chunking.chunk_sections(sheet, 1).where("schema_name = 'S1' AND chunk_no = 0"), "table_no", "line_no")
    assert chunk == f"\nSCHEMA: S1\n\nTable: A\nColumns: {first},\nc12\n"
    assert text(chunking.chunk_sections(sheet, 1).where("chunk_no = 1"), "table_no", "line_no") == "\nTable: B\nColumns: y\n"


def drawing(prompt, so_far):
    """Three lines a call, cut off in the middle of a line until the end; the prompt has what was drawn."""
    script, drawn = prompt.split("Diagram:\n")
    assert "Documentation:\n" in script
    have = [line for line in drawn.split("\n") if line]
    lines = ["digraph {", "a -> b", "b -> c", "c -> d", "d -> e", "}"]
    if "broken" in script:
        raise RuntimeError("no model")
    more = lines[len(have) : len(have) + 3]
    return "\n".join(more) + ("\nc -" if more[-1] != "}" else "")


def documentation(spark, scripts):
    """Rows with a word in each cell but those of the rows' own purpose."""
    rows = []
    for script, n, purpose in scripts:
        for i in range(n):
            rows.append((script, i, *["w"] * (len(K.LINEAGE_COLUMNS) - 1), purpose))
    columns = ", ".join(f"`{c}` string" for c in K.LINEAGE_COLUMNS)
    return spark.createDataFrame(rows, f"script_id int, row_no long, {columns}")


def test_diagrams_in_rounds(spark):
    rows = documentation(spark, [(1, 2, "load"), (2, 3, "broken")])
    got = {r["script_id"]: r for r in flows.diagram_rounds(rows, drawing, max_rounds=5).collect()}
    assert got[1]["text"] == "digraph {\na -> b\nb -> c\nc -> d\nd -> e\n}" and got[1]["complete"] and got[1]["rounds"] == 2
    assert got[2]["error"] == "RuntimeError: no model" and got[2]["rounds"] == 1 and not got[2]["complete"]
    once = {r["script_id"]: r for r in flows.diagram_rounds(rows, drawing, max_rounds=1).collect()}
    assert once[1]["text"] == "digraph {\na -> b\nb -> c" and not once[1]["complete"]
    # Beyond its budget a script is not asked at all.
    none = {r["script_id"]: r for r in flows.diagram_rounds(rows, drawing, max_rounds=5, budget=10).collect()}
    assert none[1]["rounds"] == 0 and none[1]["text"] == ""


def counting(prompt, so_far):
    return f"rows {prompt.count('about ')}\nrows\nrows\nx [label=<y>]"


def test_a_diagram_that_nearly_spends_its_budget(spark):
    """Rows of 28 words, 4,100 of them: less than 6,000 of 116,800 tokens are left, so rows go in front."""
    rows = documentation(spark, [(1, 4_100, "about it")])
    words = 4_100 * (2 * len(K.LINEAGE_COLUMNS))
    assert K.DIAGRAM_TOKENS - K.DIAGRAM_LOW_WATER < words < K.DIAGRAM_TOKENS
    got = flows.diagram_rounds(rows, counting, max_rounds=3).first()
    dropped = (K.DIAGRAM_RESERVE_TOKENS - words) // 100
    # A last line that closes an edge needs nothing but the brace.
    assert got["text"] == f"rows {4_100 - dropped}\nrows\nrows\nx [label=<y>]\n}}" and got["complete"] and got["rounds"] == 1
