"""Documentation rows to table-level lineage: edges, nodes, legend, layers, diagram text.

``filled`` is read several times here; hand over a table or a frame made durable. ``bounded=True``
says that the rows of a script cannot be many, as when they come from one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexline import constants as K
from lexline.functions import text as X
from lexline.operators.joins import salted_join
from lexline.operators.ordered import ROWS_PER_BLOCK, number_rows
from lexline.session import durable

KEY = "script_id"
DROPPED_FOR_DIAGRAM = (
    "description",
    "table_description",
    "data_type",
    "column_description",
    "join_statement",
    "filter_statement",
)


def diagram_rows(filled: DataFrame) -> DataFrame:
    """Documentation without the columns a diagram does not need."""
    return filled.drop(*DROPPED_FOR_DIAGRAM)


def normalise_entities(filled: DataFrame, overwrite_sources: bool = False) -> DataFrame:
    """Entities without ``@`` and in upper case.

    Each column is made from itself; ``overwrite_sources`` puts the derived table into the source
    columns instead.
    """
    table = X.entity(F.col("table_name"))
    join, filter_ = ("table_name",) * 2 if overwrite_sources else ("join_table", "filter_table")
    return filled.withColumns(
        {
            "join_table": X.entity(F.col(join)),
            "filter_table": X.entity(F.col(filter_)),
            "table_name": table,
        }
    )


def _is_value(c: Column) -> Column:
    return c.isNotNull() & ~c.isin("", K.NOT_APPLICABLE, K.SAME_AS_ABOVE)


def _sources(filled: DataFrame, *more: str) -> DataFrame:
    """One row per source named in a documentation row, with ``more`` of its columns.

    Cells are stripped once for each row: a filter of the derived table would strip it again, and a plain
    ``explode`` all sources, as both look at them below.
    """

    def items(column: str, from_join: bool) -> Column:
        return F.transform(
            F.coalesce(F.split(column, ","), F.expr("cast(array() as array<string>)")),
            lambda s: F.struct(X.entity(X.strip(s)).alias("src"), F.lit(from_join).alias("from_join")),
        )

    found = filled.select(
        KEY,
        "row_no",
        F.col("derivation_purpose").alias("purpose"),
        *more,
        X.entity(X.strip(F.col("table_name"))).alias("dst"),
        F.concat(items("join_table", True), items("filter_table", False)).alias("_sources"),
    )
    each = found.select(KEY, "row_no", "purpose", *more, "dst", F.explode_outer(F.when(_is_value(F.col("dst")), F.col("_sources"))).alias("s"))
    return each.where(_is_value(F.col("s.src"))).select(KEY, "row_no", "dst", "purpose", *more, "s.src", "s.from_join")


def _edge_rows(filled: DataFrame) -> DataFrame:
    """Each pair of a source and a derived table, per purpose."""
    return _sources(filled).groupBy(KEY, "src", "dst", "purpose").agg(
        (~F.max("from_join")).alias("filter_only"), F.min("row_no").alias("first_row")
    )


def _named(filled: DataFrame, *more: str) -> DataFrame:
    """Rows that derive an entity: its name and whether it is marked as temporary, with ``more`` columns."""

    def entity(raw: Column) -> Column:
        return F.struct(X.entity(raw).alias("name"), F.substring(raw, 1, 1).isin("@", "#").alias("marked"))

    found = F.filter(F.transform(F.array(X.strip(F.col("table_name"))), entity), lambda e: _is_value(e["name"]))
    return (
        filled.select(KEY, "row_no", *more, F.explode_outer(found).alias("e"))
        .where(F.col("e").isNotNull())
        .select(KEY, "row_no", *more, "e.name", "e.marked")
    )


def _placed(filled: DataFrame) -> DataFrame:
    """Each derived entity with the layers that derive it and the first row of each."""
    return _named(filled, "layer").groupBy(KEY, "name", "layer").agg(
        F.min("row_no").alias("first_row"), F.max("marked").alias("marked")
    )


def _few(kept: DataFrame, rows_per_block: int) -> bool:
    """Whether no script has more than ``rows_per_block`` of the rows, so that each can go to one task."""
    counts = kept.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    return (counts.agg(F.max("n")).first()[0] or 0) <= rows_per_block


def _joined(
    rows: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread: list[str],
    how: str,
    rows_per_block: int,
    bounded: bool,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join within a script; without a bound on its rows no key may go to one task.

    ``counted`` has as many rows of each key as ``rows`` and is read instead of them to count.
    """
    if bounded:
        return rows.join(lookup, on, how)
    counts = None if counted is None else counted.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    return salted_join(rows, lookup, on, spread, how, rows_per_block, counts)


def _numbered(first: DataFrame, out: str, rows_per_block: int, bounded: bool) -> DataFrame:
    """Number the items of each script by their first row."""
    if not bounded:
        first = durable(first)
        bounded = _few(first, rows_per_block)
    return number_rows(first, [KEY], "first_row", out, rows_per_block=rows_per_block, bounded=bounded)


def purpose_legend(filled: DataFrame, rows_per_block: int = ROWS_PER_BLOCK, bounded: bool = False) -> DataFrame:
    """Derivation purposes of each script, numbered in first-seen order."""
    first = (
        filled.where(_is_value(F.col("derivation_purpose")))
        .groupBy(KEY, F.col("derivation_purpose").alias("purpose"))
        .agg(F.min("row_no").alias("first_row"))
    )
    return _numbered(first, "purpose_no", rows_per_block, bounded)


def _edges_of_short(filled: DataFrame) -> DataFrame:
    """``lineage_edges`` of scripts that have few rows each: all of a script in one task, read once.

    Windows stand for the joins with the legend and with the sources, so rows that are dealt by script
    are not dealt again. A script without a key has no legend, and none of its tables is known to feed another.
    """
    purpose, known = F.col("derivation_purpose"), F.col(KEY).isNotNull()
    seen = F.when(_is_value(purpose), F.min("row_no").over(Window.partitionBy(KEY, purpose)))
    place = F.dense_rank().over(Window.partitionBy(KEY).orderBy(F.col("_seen").asc_nulls_last(), purpose))
    number = F.when(known & _is_value(purpose), place.cast("long"))
    numbered = filled.withColumn("_seen", seen).withColumn("purpose_no", number)
    edges = _sources(numbered, "purpose_no").groupBy(KEY, "src", "dst", "purpose").agg(
        F.first("purpose_no").alias("purpose_no"),
        (~F.max("from_join")).alias("filter_only"),
        F.min("row_no").alias("first_row"),
    )
    feeding = F.collect_set("src").over(Window.partitionBy(KEY))
    to_final = ~(known & F.array_contains(feeding, F.col("dst")))
    return edges.select(KEY, "src", "dst", "purpose", "purpose_no", "filter_only", to_final.alias("to_final"), "first_row")


def lineage_edges(
    filled: DataFrame,
    rows_per_block: int = ROWS_PER_BLOCK,
    bounded: bool = False,
    legend: DataFrame | None = None,
    edges: DataFrame | None = None,
) -> DataFrame:
    """Unique table-level edges per purpose: number, filter-only mark and to-final mark.

    ``legend`` is the result of ``purpose_legend`` where it is at hand, ``edges`` that of ``_edge_rows``, kept.
    """
    if bounded:
        return _edges_of_short(filled)
    if edges is None:
        edges = durable(_edge_rows(filled))
    if legend is None:
        legend = purpose_legend(filled, rows_per_block)
    legend = legend.select(KEY, "purpose", "purpose_no")
    inner = edges.select(KEY, F.col("src").alias("dst")).distinct().withColumn("_inner", F.lit(True))
    few = _few(edges, rows_per_block)
    numbered = _joined(edges, legend, [KEY, "purpose"], ["src", "dst"], "left", rows_per_block, few)
    return (
        _joined(numbered, inner, [KEY, "dst"], ["src", "purpose"], "left", rows_per_block, few, edges)
        .select(
            KEY,
            "src",
            "dst",
            "purpose",
            "purpose_no",
            "filter_only",
            F.col("_inner").isNull().alias("to_final"),
            "first_row",
        )
    )


def layer_alignment(
    filled: DataFrame,
    rows_per_block: int = ROWS_PER_BLOCK,
    bounded: bool = False,
    placed: DataFrame | None = None,
) -> DataFrame:
    """Each derived entity with the first layer that derives it.

    Layers are numbered as first seen, without gaps: one that places no entity of its own, or is not
    applicable, has no number. ``placed`` is the result of ``_placed`` where it is at hand, kept.
    """
    if placed is None:
        placed = _placed(filled)
        if not bounded:
            placed = durable(placed)
    rows = placed.where(F.col("layer").isNotNull())
    first = rows.groupBy(KEY, "name").agg(F.min_by("layer", "first_row").alias("layer"))
    if not bounded:
        first = durable(first)
    shown = first.where(_is_value(F.col("layer"))).select(KEY, "layer").distinct()
    seen = rows.groupBy(KEY, "layer").agg(F.min("first_row").alias("first_row")).join(shown, [KEY, "layer"], "left_semi")
    layers = _numbered(seen, "layer_no", rows_per_block, bounded).select(KEY, "layer", "layer_no")
    few = bounded or _few(first, rows_per_block)
    return _joined(first, layers, [KEY, "layer"], ["name"], "left", rows_per_block, few).select(
        KEY, "name", "layer", "layer_no"
    )


def lineage_nodes(
    filled: DataFrame,
    ctes: DataFrame | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
    bounded: bool = False,
    placed: DataFrame | None = None,
    edges: DataFrame | None = None,
) -> DataFrame:
    """Entities of each script with kind and layer.

    A source is never derived, a final entity never feeds another, ``ctes`` (``script_id, name``)
    marks common table expressions, and the rest is temporary, as is any entity whose raw name
    starts with ``@`` or ``#``. ``placed`` and ``edges`` are the results of ``_placed`` and ``_edge_rows``
    where they are at hand, kept.
    """
    if placed is None:
        placed = _placed(filled)
        if not bounded:
            placed = durable(placed)
    if edges is None:
        edges = _sources(filled)

    def ends(rows: DataFrame, name: str, feeds: bool, marked: Column) -> DataFrame:
        return rows.select(
            KEY, F.col(name).alias("name"), F.lit(feeds).alias("feeds"), F.lit(not feeds).alias("derived"), marked.alias("marked")
        )

    # What a source feeds is derived in the same row, so it is among the derived ones.
    both = ends(edges, "src", True, F.lit(False)).unionByName(ends(placed, "name", False, F.col("marked")))
    nodes = both.groupBy(KEY, "name").agg(
        F.max("feeds").alias("feeds"), F.max("derived").alias("derived"), F.max("marked").alias("marked")
    )
    is_cte = F.lit(False)
    if ctes is not None:
        flagged = ctes.select(KEY, F.upper("name").alias("name")).distinct().withColumn("_cte", F.lit(True))
        nodes = nodes.join(flagged, [KEY, "name"], "left")
        is_cte = F.col("_cte").isNotNull()
    kind = (
        F.when(is_cte, "cte")
        .when(F.col("marked"), "temp")
        .when(~F.col("derived"), "source")
        .when(~F.col("feeds"), "final")
        .otherwise("temp")
    )
    layers = layer_alignment(filled, rows_per_block, bounded, placed).select(KEY, "name", "layer", "layer_no")
    return nodes.select(KEY, "name", kind.alias("kind")).join(layers, [KEY, "name"], "left")


def node_columns(filled: DataFrame) -> DataFrame:
    """Distinct columns of each derived entity, ``first_row`` gives their order."""
    return (
        _named(filled, "column_name")
        .where(_is_value(F.col("column_name")))
        .groupBy(KEY, "name", "column_name")
        .agg(F.min("row_no").alias("first_row"))
    )


def _dot_string(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), _dot_string(text), F.lit('"'))


def dot_text(
    filled: DataFrame,
    ctes: DataFrame | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
    bounded: bool = False,
) -> DataFrame:
    """Diagram text as ordered lines: read each script by ``section, item, line_no``.

    Node labels carry one column per line, joined by the backslash that ends a line inside a quoted
    string, so no label is ever held as one value.
    """
    placed, kept_edges = (None, None) if bounded else (durable(_placed(filled)), durable(_edge_rows(filled)))
    nodes = durable(lineage_nodes(filled, ctes, rows_per_block, bounded, placed, kept_edges))
    legend = purpose_legend(filled, rows_per_block, bounded)
    if not bounded:
        legend = durable(legend)
    edges = lineage_edges(filled, rows_per_block, bounded, legend, kept_edges)
    columns = node_columns(filled)
    scripts = nodes.select(KEY).distinct()

    def line(section: int, item: Column, line_no: Column, text: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"),
            item.cast("string").alias("item"),
            line_no.cast("long").alias("line_no"),
            text.alias("text"),
        )

    def rows(df: DataFrame, *lines: Column) -> DataFrame:
        """The lines that each row of ``df`` gives, without those that are null, from one reading of it."""
        if len(lines) == 1:
            return df.select(KEY, *[lines[0].getField(c).alias(c) for c in ("section", "item", "line_no", "text")])
        each = df.select(KEY, F.explode_outer(F.array(*lines)).alias("_line")).where(F.col("_line").isNotNull())
        return each.select(KEY, "_line.*")

    none, zero = F.lit(""), F.lit(0)
    fill = F.lit(None).cast("string")
    border = F.lit(None).cast("string")
    for kind, (f, b) in K.NODE_COLOURS.items():
        fill = F.when(F.col("kind") == kind, f).otherwise(fill)
        border = F.when(F.col("kind") == kind, b).otherwise(border)
    node_legend = [
        ("Source Table", "source"),
        ("Temp Tables, Cursors, Functions", "temp"),
        ("CTE", "cte"),
        ("Final Table/Report", "final"),
    ]
    edge_legend = [
        ("Data flow (source tables, temporary tables, CTEs)", K.EDGE_COLOUR, "solid"),
        ("Data flow to final report (aggregation)", K.FINAL_EDGE_COLOUR, "solid"),
        ("Filters only (dashed)", K.EDGE_COLOUR, "dashed"),
    ]
    fixed = [line(0, none, zero, F.lit("digraph lineage {"))]
    fixed += [
        line(
            1,
            F.lit(f"{i}"),
            zero,
            F.lit(
                f'  "legend {title}" [label="{title}", shape=box, style=filled, '
                f'fillcolor="{K.NODE_COLOURS[kind][0]}", color="{K.NODE_COLOURS[kind][1]}"];'
            ),
        )
        for i, (title, kind) in enumerate(node_legend)
    ]
    fixed += [
        line(
            2,
            F.lit(f"{i}"),
            zero,
            F.lit(f'  "edge {i} from" -> "edge {i} to" [label="{title}", color="{colour}", style={style}];'),
        )
        for i, (title, colour, style) in enumerate(edge_legend)
    ]
    fixed.append(line(9, none, zero, F.lit("}")))
    number = F.col("purpose_no").cast("string")
    purpose = line(
        3,
        F.lpad(number, 20, "0"),
        zero,
        F.concat(
            F.lit('  "purpose '),
            number,
            F.lit('" [shape=plaintext, label="'),
            number,
            F.lit(". "),
            _dot_string(F.col("purpose")),
            F.lit('"];'),
        ),
    )
    name, place, aligned = F.col("name"), F.col("layer_no").cast("string"), F.col("layer_no").isNotNull()
    opened = F.concat(
        F.lit("  "),
        _quoted(name),
        F.lit(' [shape=box, style="rounded, filled", fontname="Arial", fillcolor="'),
        fill,
        F.lit('", color="'),
        border,
        F.lit('", label="'),
        _dot_string(name),
        F.lit(" \\"),
    )
    ranked = F.concat(F.lit("  { rank=same; label"), place, F.lit("; "), _quoted(name), F.lit(" }"))
    of_node = [
        line(4, name, F.lit(-1), opened),
        line(4, name, F.lit((1 << 62)), F.lit('"];')),
        F.when(aligned, line(7, F.concat_ws("\t", F.lpad(place, 20, "0"), "name"), zero, ranked)),
    ]
    column = F.concat(F.lit("\\n- "), _dot_string(F.col("column_name")), F.lit("\\"))
    colour = F.when(F.col("to_final"), K.FINAL_EDGE_COLOUR).otherwise(K.EDGE_COLOUR)
    edge = line(
        5,
        F.concat_ws("\t", "src", "dst"),
        F.coalesce("purpose_no", F.lit(0)),
        F.concat(
            F.lit("  "),
            _quoted(F.col("src")),
            F.lit(" -> "),
            _quoted(F.col("dst")),
            F.lit(' [label="'),
            F.coalesce(number, F.lit("")),
            F.lit('", color="'),
            colour,
            F.when(F.col("filter_only"), '", style=dashed];').otherwise('"];'),
        ),
    )
    layers = nodes.where(aligned).select(KEY, "layer", "layer_no").distinct()
    label = F.concat(
        F.lit("  label"),
        place,
        F.lit(' [shape=box, style=filled, fillcolor=yellow, fontcolor=black, fontsize=12, label="'),
        _dot_string(F.col("layer")),
        F.lit('"];'),
    )
    below = F.concat(
        F.lit("  label"), (F.col("layer_no") - F.lit(1)).cast("string"), F.lit(" -> label"), place, F.lit(" [style=invis];")
    )
    of_layer = [
        line(6, F.lpad(place, 20, "0"), F.lit(-1), label),
        F.when(F.col("layer_no") > 1, line(8, F.lpad(place, 20, "0"), zero, below)),
    ]
    parts = [
        rows(scripts, *fixed),
        rows(legend, purpose),
        rows(nodes, *of_node),
        rows(columns, line(4, name, F.col("first_row"), column)),
        rows(edges, edge),
        rows(layers, *of_layer),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drop_repeated_tail(text: Column) -> Column:
    """Unfinished diagram text without its last line and without repeats at the new end."""
    kept = F.slice(F.split(text, "\n"), F.lit(1), F.greatest(F.size(F.split(text, "\n")) - F.lit(1), F.lit(0)))
    # Last index whose line differs from the one before it: everything after repeats it.
    changes = F.transform(
        kept, lambda line, i: F.when((i == 0) | (line != F.get(kept, i - F.lit(1))), i)
    )
    return F.array_join(F.slice(kept, F.lit(1), F.coalesce(F.array_max(changes) + F.lit(1), F.lit(0))), "\n")


#: A last line with this closes the label of an edge, so only the closing brace is missing.
EDGE_CLOSED = ">]"


def resumed_diagram(text: Column) -> Column:
    """Unfinished diagram text as it is gone on with: closed if its last line closes an edge, else
    without its last line and repeats."""
    last = F.substring_index(text, "\n", -1)
    return F.when(F.contains(last, F.lit(EDGE_CLOSED)), F.concat(text, F.lit("\n}"))).otherwise(drop_repeated_tail(text))
