"""Column functions on chat messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexline import constants as K
from lexline.functions.text import strip

# Fixed value: a path announced after "saved to:", with or without backticks.
_WS = "[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
SAVED_PATH = "(?i)saved to:" + _WS + "*`?([^`]+?\\.(?:xlsx|csv|png|txt))`?"


HUMAN, AI = "human", "ai"


def message_role(role: Column) -> Column:
    """``human``, ``ai``, or null for roles that take no part in a conversation."""
    r = F.lower(F.coalesce(role, F.lit("user")))
    return F.when(r == "user", HUMAN).when(r.isin("ai", "assistant"), AI)


def prompt(question: Column, path: Column, agent: Column) -> Column:
    """The question with its notes; no space stands before the first note."""
    note = F.when(
        path != "",
        F.concat(F.lit("(Note: I have just uploaded a file available at path: "), path, F.lit(")")),
    )
    intent = F.when(
        agent != "",
        F.concat(F.lit("(User has specified intent for agent: "), agent, F.lit(")")),
    )
    return F.concat(question, F.concat_ws(" ", note, intent))


def response_type(content: Column) -> Column:
    """Kind of a reply by ordered rules; the first tag test heeds case, the others do not."""
    low = F.lower(content)

    def has(text: Column, *needles: str) -> Column:
        out = F.contains(text, F.lit(needles[0]))
        for needle in needles[1:]:
            out = out | F.contains(text, F.lit(needle))
        return out

    return (
        F.when(
            has(content, "[upload_required]") | has(low, "provide the file", "connection details"),
            "DATASOURCE_FORM",
        )
        .when(has(low, "[lineage_file_upload_required]", "lineage form"), "LINEAGE_FORM")
        .when(has(low, "[discover_db_details_required]", "discover form"), "DISCOVER_FORM")
        .when(has(low, "saved to:", "download link"), "FILE")
        .otherwise("CHAT")
    )


def cleaned_content(content: Column, kind: Column) -> Column:
    """Reply without the tag of its kind; tags in another case stay."""

    def without(tag: str) -> Column:
        return strip(F.replace(content, F.lit(tag), F.lit("")))

    return (
        F.when(kind == "DATASOURCE_FORM", without("[upload_required]"))
        .when(kind == "LINEAGE_FORM", without("[lineage_file_upload_required]"))
        .when(kind == "DISCOVER_FORM", without("[discover_db_details_required]"))
        .otherwise(content)
    )


def saved_path(content: Column) -> Column:
    """Path announced in a reply, null when there is none."""
    return F.nullif(strip(F.regexp_extract(content, SAVED_PATH, 1)), F.lit(""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def agent_short_name(agent: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, short in reversed(K.AGENTS):
        out = F.when(F.contains(agent, F.lit(name)), short).otherwise(out)
    return out
