"""Column functions on names, labels and generated texts. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexline import constants as K


def strip(text: Column) -> Column:
    """Drop white space of every kind at both ends (``trim`` alone only drops blanks)."""
    return F.btrim(text, F.lit(K.WHITESPACE))


def lines(text: Column) -> Column:
    """The lines of a text whose ends were stripped."""
    return F.split(strip(text), "\n")


def count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def normalize_name(name: Column) -> Column:
    """Asset name for matching: stripped, lower case, no leading dots, no double quotes."""
    return F.replace(F.ltrim(F.lower(strip(name)), F.lit(".")), F.lit('"'), F.lit(""))


def sanitize_term(name: Column) -> Column:
    """Glossary term name made of ASCII letters, digits and single underscores."""
    spaced = F.translate(strip(name), " @.,()", "______")
    ascii_only = F.regexp_replace(spaced, "[^A-Za-z0-9_]", "")
    return F.btrim(F.regexp_replace(ascii_only, "_+", "_"), F.lit("_"))


def sql_quote_body(text: Column) -> Column:
    """Text as the inside of a single-quoted SQL literal."""
    return F.replace(text, F.lit("'"), F.lit("''"))


def short_description(text: Column) -> Column:
    return F.substring(text, 1, K.SHORT_DESCRIPTION_CHARS)


def term_name(text: Column) -> Column:
    return F.substring(text, 1, K.TERM_NAME_CHARS)


def constraint_text(nullable: Column, default: Column | None = None) -> Column:
    """``NULL`` or ``NOT NULL``, then the default where one exists."""
    base = F.when(nullable, "NULL").otherwise("NOT NULL")
    if default is None:
        return base
    has_default = default.isNotNull() & (default != "")
    return F.concat(base, F.when(has_default, F.concat(F.lit(", DEFAULT "), default)).otherwise(""))


def column_label(
    name: Column,
    type_: Column,
    constraints: Column,
    is_primary: Column | None = None,
    foreign: Column | None = None,
    is_unique: Column | None = None,
) -> Column:
    """``name: (type)`` and its key and constraint notes, in that order.

    ``foreign`` is an array of ``table.column`` targets; a null target has no text after the note.
    """
    parts = [F.concat(name, F.lit(": ("), type_, F.lit(")"))]
    if is_primary is not None:
        parts.append(F.when(is_primary, " [Primary Key]").otherwise(""))
    if foreign is not None:
        notes = F.transform(
            foreign,
            lambda t: F.when(t == "", " [Foreign Key]").otherwise(
                F.concat(F.lit(" [Foreign Key references "), t, F.lit("]"))
            ),
        )
        parts.append(F.coalesce(F.array_join(notes, ""), F.lit("")))
    if is_unique is not None:
        parts.append(F.when(is_unique, " [Unique]").otherwise(""))
    parts.append(F.concat(F.lit(" ["), constraints, F.lit("]")))
    return F.concat(*parts)


def asset_label(name: Column, type_: Column, nullable: Column, description: Column) -> Column:
    """``name: (type)`` with ``NOT NULL`` and the description in brackets when present."""
    notes = F.concat_ws(
        " | ",
        F.when(~nullable, F.lit("NOT NULL")),
        F.when(description != "", description),
    )
    return F.concat(
        name,
        F.lit(": ("),
        type_,
        F.lit(")"),
        F.when(notes != "", F.concat(F.lit(" ["), notes, F.lit("]"))).otherwise(""),
    )


def qualified_table(schema: Column, table: Column) -> Column:
    """``schema.table``, or the bare table when the schema is empty or a stand-in."""
    bare = (
        schema.isNull() | (schema == "") | F.lower(schema).isin(*K.PLACEHOLDER_SCHEMAS)
    )
    return F.when(bare, table).otherwise(F.concat_ws(".", schema, table))


def quoted_item(item: Column) -> Column:
    """One list item in quotes; double quotes when it holds single ones only."""
    double = F.contains(item, F.lit("'")) & ~F.contains(item, F.lit('"'))
    escaped = F.replace(item, F.lit("\\"), F.lit("\\\\"))
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def quoted_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted_item), ", "), F.lit("]"))


def resolve_table(raw: Column, schemas: Sequence[str]) -> tuple[Column, Column]:
    """(schema, table) of a raw name: the first selected schema it starts with, else the first."""
    name = strip(raw)
    lowered = F.lower(name)
    schema = F.lit(None).cast("string")
    for candidate in reversed(schemas):
        schema = F.when(F.startswith(lowered, F.lit(candidate.lower() + ".")), F.lit(candidate)).otherwise(schema)
    rest = F.substring(name, F.instr(name, ".") + F.lit(1), F.length(name))
    return (
        F.coalesce(schema, F.lit(schemas[0])),
        F.when(schema.isNotNull(), rest).otherwise(name),
    )


def entity(name: Column) -> Column:
    """Table entity of a documentation cell: no ``@`` at the ends, upper case."""
    return F.upper(F.btrim(name, F.lit("@")))


def answer_items(answer: Column) -> Column:
    """Items of a ``label: a, b, c`` answer."""
    body = strip(F.substring(answer, F.instr(answer, ":") + F.lit(1), F.length(answer)))
    return F.split(body, ", ")


def strip_fences(text: Column) -> Column:
    """Text without code fences and outer backticks."""
    for fence in ("```plaintext", "```graphviz", "```dot"):
        text = F.replace(text, F.lit(fence), F.lit(""))
    return strip(F.btrim(text, F.lit("`")))


def words(text: Column) -> Column:
    return F.split(strip(text), "\\s+")


def truncate_statement(text: Column, n: int = 8) -> Column:
    """The first ``n`` words of a statement and an ellipsis."""
    return F.concat(F.array_join(F.slice(words(text), 1, n), " "), F.lit(" ..."))


def token_count(text: Column) -> Column:
    """Words of a text, the stand-in for model tokens."""
    return F.when(strip(text) == "", 0).otherwise(F.size(words(text)))


def report_file(script: Column, suffix: str) -> Column:
    """Report name of a script file: ``.txt`` and ``.sql`` replaced by a suffix."""
    return F.concat(F.regexp_replace(script, "\\.txt|\\.sql", ""), F.lit(suffix))
