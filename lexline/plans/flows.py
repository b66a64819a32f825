"""Whole flows, from dictionary, sheet, script or chat request to result rows.

Generated texts are costly and feed several results, so they are written to shared storage once
(``keep``) instead of being generated again for each use or lost executor.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexline import constants as K
from lexline import sinks
from lexline.functions import text as X
from lexline.operators import catalog, chat, chunking, generate, lineage, parse, publish, scripts, spans
from lexline.operators.ordered import merge_spans
from lexline.session import durable
from lexline.sources import assets, versions

Keep = Callable[[DataFrame], DataFrame]


def _split(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts that are whole, and those that failed or have no end."""
    whole = F.col("complete") & F.col("error").isNull()
    return texts.where(whole), texts.where(~whole)


def glossary_results(texts: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """Answered table prompts to glossary rows. Unfinished texts stand apart and are not parsed."""
    whole, unfinished = _split(texts)
    responses = whole.withColumn("doc_id", F.concat_ws("/", *keys))
    return {
        "texts": texts,
        "unfinished": unfinished,
        "glossary": parse.glossary_parse(responses),
        "rejected": parse.rejected_responses(responses),
    }


def discover_glossary(
    labels: DataFrame,
    generator: generate.Generator,
    *,
    max_rounds: int | None,
    keys: Sequence[str] = catalog.TABLE_KEY,
    keep: Keep = durable,
    num_partitions: int | None = None,
) -> dict[str, DataFrame]:
    """Labelled columns to glossary rows: overview, chunks, generation, parse."""
    chunks = catalog.table_chunks(catalog.table_overview(labels, keys=keys))
    texts = generate.enrich(chunks, generator, max_rounds=max_rounds, num_partitions=num_partitions)
    return glossary_results(keep(texts), keys)


def selected_labels(
    columns: DataFrame,
    constraints: DataFrame,
    usage: DataFrame,
    connections: DataFrame,
    schemas: DataFrame,
    tables: DataFrame,
) -> DataFrame:
    """Labels of the chosen tables of a dictionary, as ``relational.read_dictionary`` reads it.

    The kind of a connection (see ``catalog.with_connections``) decides whether keys are noted.
    """
    rows = catalog.with_connections(
        catalog.catalog_columns(catalog.select_columns(columns, schemas, tables)), connections
    )
    plain = F.coalesce(F.col("db_kind").isin(*K.PLAIN_LABEL_KINDS), F.lit(False))
    keys = catalog.catalog_constraints(constraints, usage)
    return catalog.column_labels(rows.where(~plain), keys).unionByName(catalog.plain_labels(rows.where(plain)))


def discover_selected(
    dictionary: tuple[DataFrame, DataFrame, DataFrame],
    connections: DataFrame,
    schemas: DataFrame,
    tables: DataFrame,
    generator: generate.Generator,
    path: str,
    *,
    max_rounds: int | None,
    keep: Keep = durable,
    num_partitions: int | None = None,
) -> dict[str, DataFrame]:
    """From a dictionary and a choice of schemas and tables to the glossary file at ``path``."""
    labels = selected_labels(*dictionary, connections, schemas, tables)
    out = discover_glossary(labels, generator, max_rounds=max_rounds, keep=keep, num_partitions=num_partitions)
    sinks.write_glossary(out["glossary"], path)
    return out


def publish_comments(
    glossary: DataFrame,
    catalog_name: str | None,
    schemas: Sequence[str],
    connect: Callable[[], Callable[[str], object]],
    *,
    keep: Keep = durable,
    num_connections: int | None = None,
) -> dict[str, DataFrame]:
    """A glossary with ``row_no``, as ``files.read_glossary`` reads it, to comments on a server: outcomes,
    counts and failure lines. Statements run once, their outcomes are kept."""
    ddl = publish.comment_ddl(glossary, catalog_name, schemas)
    outcomes = keep(publish.apply_comments(ddl, connect, num_connections))
    return {
        "outcomes": outcomes,
        "summary": publish.publish_summary(outcomes),
        "failures": publish.failure_lines(outcomes),
    }


def asset_table_labels(
    listed: DataFrame, details: DataFrame, selection: str = "all", conn_id: str = "live_connection"
) -> DataFrame:
    """Labels of the columns of chosen assets: listed (``guid, name``) and their exported JSON.

    Assets of one name stay apart by ``guid``; they have no schema.
    """
    chosen = catalog.select_tables(listed, selection, "name").select(
        "guid", F.col("name").alias("table_name")
    )
    labels = assets.asset_labels(assets.asset_columns(details), notes=False)
    return labels.join(chosen, "guid").select(
        F.lit(conn_id).alias("conn_id"),
        F.lit("").alias("schema_name"),
        "table_name",
        "guid",
        (F.col("pos") + F.lit(1)).alias("pos"),
        F.col("name").alias("column_name"),
        "label",
    )


def asset_prompts(listed: DataFrame, details: DataFrame, selection: str = "all") -> DataFrame:
    """Prompt text of each chosen asset of a catalog service."""
    labels = asset_table_labels(listed, details, selection)
    return catalog.table_chunks(catalog.table_overview(labels, keys=[*catalog.TABLE_KEY, "guid"]))


def discover_assets(
    listed: DataFrame,
    details: DataFrame,
    generator: generate.Generator,
    selection: str = "all",
    *,
    max_rounds: int | None,
    keep: Keep = durable,
    num_partitions: int | None = None,
) -> dict[str, DataFrame]:
    """Chosen assets of a catalog service to glossary rows."""
    return discover_glossary(
        asset_table_labels(listed, details, selection),
        generator,
        max_rounds=max_rounds,
        keys=[*catalog.TABLE_KEY, "guid"],
        keep=keep,
        num_partitions=num_partitions,
    )


def sheet_prompts(
    sheet: DataFrame,
    chunk_size: int = 1,
    batch_size: int = 1,
    description: str = K.NOT_APPLICABLE,
    excerpts: DataFrame | None = None,
) -> DataFrame:
    """Prompt inputs of a sheet, one row per chunk: its ``text``, the sheet's ``description`` and the
    dictionary ``excerpt`` of the chunk (``sheet_id, chunk_no, excerpt``), ``N/A`` where there is none."""
    slices = chunking.schema_batches(sheet, chunk_size, batch_size)
    # At most chunk_size + 1 tables share a chunk.
    pieces = F.array_sort(
        F.collect_list(F.struct("table_no", "slice_no", "schema_name", "schema_header", "text"))
    )
    text = F.transform(
        pieces,
        lambda p: F.concat(
            F.when(p["schema_header"], F.concat(F.lit("\nSCHEMA: "), p["schema_name"], F.lit("\n"))).otherwise(""),
            p["text"],
        ),
    )
    prompts = slices.groupBy("sheet_id", "batch_no", "chunk_no").agg(F.array_join(text, "").alias("text"))
    if excerpts is None:
        prompts = prompts.withColumn("excerpt", F.lit(K.NOT_APPLICABLE))
    else:
        found = excerpts.select("sheet_id", "chunk_no", "excerpt")
        prompts = prompts.join(found, ["sheet_id", "chunk_no"], "left").withColumn(
            "excerpt", F.coalesce("excerpt", F.lit(K.NOT_APPLICABLE))
        )
    return prompts.withColumn("description", F.lit(description))


def define_results(texts: DataFrame, keys: Sequence[str], keep: Keep = durable) -> dict[str, DataFrame]:
    """Answered sheet prompts to glossary rows and the spans of merged descriptions.

    ``keys`` are a text's sheet and, if the sheet came in several texts, its chunk. ``sheet`` has the rows with
    their place in the written sheet, and ``spans`` are over its rows, across chunks.
    """
    whole, unfinished = _split(texts)
    rows = keep(parse.define_parse(whole.select(F.to_json(F.struct(*keys)).alias("doc_id"), "text")))
    types = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    key = F.from_json("doc_id", ", ".join(f"`{k}` {types[k]}" for k in keys))
    chunk = key[keys[1]] if len(keys) > 1 else F.lit(0)
    placed = spans.sheet_rows(
        rows.select(
            key[keys[0]].alias("sheet_id"),
            chunk.cast("long").alias("chunk_no"),
            *[c for c in rows.columns if c != "doc_id"],
        )
    )
    return {
        "texts": texts,
        "unfinished": unfinished,
        "glossary": rows.withColumn("doc_id", F.concat_ws("/", *[key[k] for k in keys])),
        "sheet": placed,
        "spans": spans.glossary_spans(placed, ("sheet_id",), "sheet_row"),
    }


def define_glossary(
    sheet: DataFrame,
    generator: generate.Generator,
    *,
    max_rounds: int | None,
    chunk_size: int = 1,
    batch_size: int = 1,
    description: str = K.NOT_APPLICABLE,
    excerpts: DataFrame | None = None,
    keep: Keep = durable,
    num_partitions: int | None = None,
) -> dict[str, DataFrame]:
    """Schema sheet to glossary rows and the spans of merged descriptions.

    The generator is given the description, the excerpt and the chunk, each after its heading.
    """
    prompts = sheet_prompts(sheet, chunk_size, batch_size, description, excerpts)
    asked = prompts.select(
        "sheet_id",
        F.lpad(F.col("chunk_no").cast("string"), 12, "0").alias("chunk"),
        _headed(Description=F.col("description"), Dictionary=F.col("excerpt"), Schema=F.col("text")).alias("text"),
    )
    texts = generate.enrich(asked, generator, max_rounds=max_rounds, num_partitions=num_partitions)
    return define_results(keep(texts), ["sheet_id", "chunk"], keep)


def _headed(**parts: Column) -> Column:
    return F.concat_ws("\n\n", *[F.concat(F.lit(f"{name}:\n"), part) for name, part in parts.items()])


def script_contexts(corpus: DataFrame, glossary: DataFrame) -> DataFrame:
    """(script_id, context): what a glossary sheet says of the tables that each script reads or fills."""
    named = scripts.script_table_refs(corpus).where(F.col("role") != "cte").select("script_id", "name").distinct()
    members, contexts = shared_contexts(named, glossary)
    return scripts.with_contexts(members, members, contexts).select("script_id", "context")


def shared_contexts(tables: DataFrame, glossary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members`` (script_id, context_id) and the ``contexts`` that they share, each once.

    ``contexts`` has the ``context_id`` as its ``script_id``. ``tables``: ``script_id, name``.
    """
    members = durable(scripts.context_members(tables, glossary))
    lines = scripts.glossary_context(scripts.member_tables(members), glossary)
    return members, scripts.script_contexts(lines)


def script_prompts(
    corpus: DataFrame,
    contexts: DataFrame | None = None,
    dialect: str | None = None,
    members: DataFrame | None = None,
) -> DataFrame:
    """``text`` of each script, with the ``dialect`` and with its own lines of context before it.

    ``contexts`` has ``script_id`` and ``context``, what the glossary says of the script's tables;
    scripts without any have ``N/A``. ``script_contexts`` makes them. With ``members``, both are those of
    ``shared_contexts``, so that long contexts are not dealt for each script.
    """
    rows = corpus.select("script_id", "text")
    before = "" if dialect is None else f"Dialect: {dialect}\n\n"
    if members is not None or contexts is not None:
        if members is not None:
            found = scripts.with_contexts(rows.join(members, "script_id"), members, contexts)
            without = rows.join(members, "script_id", "left_anti").withColumn("context", F.lit(K.NOT_APPLICABLE))
            rows = found.select("script_id", "text", "context").unionByName(without)
        else:
            rows = rows.join(contexts.select("script_id", "context"), "script_id", "left")
        # One concatenation, as each makes a copy of a context that may be long.
        context = F.coalesce("context", F.lit(K.NOT_APPLICABLE))
        script = F.coalesce(F.concat(F.lit("\n\nScript:\n"), F.col("text")), F.lit(""))
        rows = rows.withColumn("text", F.concat(F.lit(f"{before}Context:\n"), context, script))
    elif dialect is not None:
        rows = rows.withColumn("text", F.concat(F.lit(before), F.col("text")))
    return rows.select("script_id", "text")


def script_results(texts: DataFrame, corpus: DataFrame) -> dict[str, DataFrame]:
    """Documented scripts to documentation rows, spans, edges and nodes.

    ``documentation`` keeps entities as written, for diagrams; ``sheet`` has them normalised, with the row
    of the written sheet, over which ``spans`` go.
    """
    whole, unfinished = _split(texts)
    # The rows of a script come from one generated text.
    filled = parse.fill_same_as_above(
        parse.lineage_parse(whole.select("script_id", "text")),
        ["script_id"],
        "row_no",
        list(K.LINEAGE_COLUMNS),
        bounded=True,
    )
    ctes = (
        scripts.script_table_refs(corpus).where(F.col("role") == "cte").select("script_id", "name")
    )
    # Rows of the written sheet: those of a script in order, below the header.
    place = F.row_number().over(Window.partitionBy("script_id").orderBy("row_no")) + F.lit(spans.HEADER_ROWS)
    sheet = lineage.normalise_entities(filled).withColumn("sheet_row", place.cast("long"))
    return {
        "texts": texts,
        "unfinished": unfinished,
        "documentation": filled,
        "sheet": sheet,
        "spans": merge_spans(sheet, ["script_id"], "sheet_row", list(K.LINEAGE_COLUMNS), bounded=True),
        "edges": lineage.lineage_edges(filled, bounded=True),
        "nodes": lineage.lineage_nodes(filled, ctes, bounded=True),
    }


def script_lineage(
    corpus: DataFrame,
    generator: generate.Generator,
    *,
    max_rounds: int | None,
    contexts: DataFrame | None = None,
    dialect: str | None = None,
    keep: Keep = durable,
    num_partitions: int | None = None,
) -> dict[str, DataFrame]:
    """Scripts to documentation rows, spans, edges and nodes."""
    texts = generate.enrich(
        script_prompts(corpus, contexts, dialect),
        generator,
        max_rounds=max_rounds,
        ending=generate.documentation_ending(),
        num_partitions=num_partitions,
    )
    return script_results(keep(texts), corpus)


def diagram_rounds(
    documentation: DataFrame,
    generator: generate.Generator,
    *,
    max_rounds: int,
    budget: int = K.DIAGRAM_TOKENS,
    keep: Keep = durable,
    num_partitions: int | None = None,
) -> DataFrame:
    """(script_id, text, rounds, complete, error): diagrams that a generator writes, round after round.

    In each round all scripts whose diagram has no closing brace yet, and whose rows and text are below
    ``budget`` words, are asked at once, with their rows and the diagram so far. Where little of the
    budget is left, leading rows are taken out of the prompt (``drop_leading_rows``). An unfinished text
    loses its last line and what repeats at its end (``drop_repeated_tail``) before it is gone on with; one
    whose last line closes an edge is closed as it stands. A script that fails is asked no more.
    ``documentation`` has the rows of ``script_results``; those of one script fit into one prompt.
    """
    line = F.concat_ws(" | ", *[F.coalesce(F.col(c), F.lit("")) for c in K.LINEAGE_COLUMNS])
    rows = keep(documentation.select("script_id", "row_no", line.alias("line")))
    closed = F.endswith("text", F.lit(generate.DIAGRAM_END))
    state = rows.select("script_id").distinct().select(
        "script_id", F.lit("").alias("text"), F.lit(0).alias("rounds"), F.lit(None).cast("string").alias("error")
    )
    state = keep(state)
    for _ in range(max_rounds):
        begun = state.where(F.col("error").isNull() & ~closed)
        spent = rows.groupBy("script_id").agg(F.sum(X.token_count(F.col("line"))).alias("_words"))
        used = (F.col("_words") + X.token_count(F.col("text"))).cast("long").alias("used_tokens")
        open_scripts = keep(
            begun.join(spent, "script_id").select("script_id", "text", "rounds", used).where(F.col("used_tokens") < budget)
        )
        if open_scripts.isEmpty():
            break
        asked_rows = rows.join(open_scripts.select("script_id", "used_tokens"), "script_id")
        rows = keep(
            chunking.drop_leading_rows(keep(asked_rows), ["script_id"], "row_no", "used_tokens").drop("used_tokens")
        )
        lines = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda r: r["line"])
        prompts = rows.groupBy("script_id").agg(F.array_join(lines, "\n").alias("_rows")).join(open_scripts, "script_id")
        asked = prompts.select(
            "script_id",
            F.col("text").alias("_begun"),
            (F.col("rounds") + 1).alias("_round"),
            _headed(Documentation=F.col("_rows"), Diagram=F.col("text")).alias("text"),
        )
        answers = generate.enrich(
            asked, generator, max_rounds=1, ending=generate.diagram_ending(), num_partitions=num_partitions
        )
        text = F.concat("_begun", F.when(F.col("_begun") != "", F.lit("\n")).otherwise(F.lit("")), F.coalesce("text", F.lit("")))
        now = answers.select("script_id", F.rtrim(text, F.lit(" \n\r\t")).alias("text"), F.col("_round").alias("rounds"), "error")
        settled = now.withColumn("text", F.when(closed, F.col("text")).otherwise(lineage.resumed_diagram(F.col("text"))))
        rest = state.join(open_scripts.select("script_id"), "script_id", "left_anti")
        state = keep(rest.unionByName(keep(settled)))
    return state.withColumn("complete", closed & F.col("error").isNull())


def script_diagram(corpus: DataFrame, documentation: DataFrame) -> DataFrame:
    """Diagram lines of documented scripts, in ``section, item, line_no`` order per script."""
    ctes = (
        scripts.script_table_refs(corpus).where(F.col("role") == "cte").select("script_id", "name")
    )
    return lineage.dot_text(documentation, ctes, bounded=True)


def publish_terms(
    glossary: DataFrame, asset_names: DataFrame, existing: DataFrame
) -> dict[str, DataFrame]:
    """Glossary rows with ``glossary_guid`` and ``row_no`` to terms and their summary."""
    terms = publish.assign_terms(glossary, asset_names, existing)
    return {"terms": terms, "summary": publish.publish_summary(terms, ["glossary_guid"])}


def push_glossary(
    spark: SparkSession,
    requests: DataFrame,
    glossary: DataFrame,
    registry_path: str,
    asset_names: DataFrame,
    existing: DataFrame,
) -> dict[str, DataFrame]:
    """Glossary rows to terms of the glossaries that are asked for by name.

    ``requests`` (``name, pos``) are found in the registry at ``registry_path``, ignoring case, or written to it;
    ``glossary`` has ``glossary_name``, ``row_no`` and the columns of ``assign_terms``.
    """
    glossaries = versions.register_glossaries(spark, requests, registry_path)
    guids = glossaries.select(F.lower("name").alias("_low"), F.col("guid").alias("glossary_guid"))
    rows = glossary.withColumn("_low", F.lower("glossary_name")).join(guids, "_low").drop("_low", "glossary_name")
    return {"glossaries": glossaries, **publish_terms(rows, asset_names, existing)}


def chat_turns(requests: DataFrame, events: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """Requests and their step events to classified replies with the prompt that was asked, and with
    ``messages`` all that the model is given: what was said before and the prompt.

    ``streaming.turns`` has the same as a stream.
    """
    replies = chat.with_fallback(requests, chat.fold_events(events))
    prompts = chat.chat_prompt(requests).select("conv_id", "prompt")
    turns = chat.classify_response(replies).join(prompts, "conv_id")
    return turns if messages is None else chat.with_history(turns, messages)
