"""Run an injected text generator over chunks, one partition at a time.

A generator is a picklable callable ``(prompt, text_so_far) -> text``; the library has none of its
own. It is called inside ``mapInPandas``, may be called again when a task is retried, and must not
write anything. A call that raises gives a row with ``error`` set, a text that was not brought to
its end a row with ``complete`` false; no row is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexline import constants as K

Generator = Callable[[str, str], str]
RESULT = "text string, rounds int, complete boolean, error string"


def _last_line(text: str) -> str:
    return text.strip().rpartition("\n")[2]


def whole_rows(table: str) -> str:
    """Text of a documentation table up to its last complete row (see ``parse.trim_partial_rows``)."""
    rows = table.strip().split("\n")
    end = len(rows)
    while end > 2 and K.END_MARK not in rows[end - 1] and rows[end - 1].count("|") < 14:
        end -= 1
    if end > 2 and K.END_MARK in rows[end - 1]:
        return table
    return "\n".join(rows[:end])


@dataclass(frozen=True)
class Ending:
    """How a kind of text ends: ``reached`` (text, rounds) tells whether it has, ``resumed`` gives what
    the next call goes on from, ``added`` what of that call's answer is taken over, and ``spent``
    (prompt, text) whether no more may be asked for."""

    reached: Callable[[str, int], bool]
    resumed: Callable[[str], str]
    added: Callable[[str], str] = lambda answer: answer
    spent: Callable[[str, str], bool] = lambda prompt, text: False


def glossary_ending() -> Ending:
    """The end mark closes the text; a call goes on after the last line feed."""
    return Ending(lambda text, _: text.endswith(K.END_MARK), lambda text: text.rpartition("\n")[0])


def documentation_ending(budget: int = K.ANALYSIS_TOKENS) -> Ending:
    """The end mark in the last line closes the table, as does a shorter rule after the first answer;
    partial rows are cut, and ``budget`` counts the words of script and table."""
    return Ending(
        lambda text, rounds: (K.END_MARK if rounds == 1 else K.END_MARK[:3]) in _last_line(text),
        whole_rows,
        whole_rows,
        lambda prompt, text: len(prompt.split()) + len(text.split()) >= budget,
    )


#: What the text of a whole diagram ends with.
DIAGRAM_END = "}"


def diagram_ending() -> Ending:
    """A closing brace ends the diagram; rounds are counted by ``flows.diagram_rounds``, one call each."""
    return Ending(lambda text, _: text.rstrip().endswith(DIAGRAM_END), lambda text: text)


def ask_until_end(
    generator: Generator, prompt: str, ending: Ending, max_rounds: int | None
) -> tuple[str, int, bool]:
    """Text, number of calls, and whether the text is complete."""
    text = generator(prompt, "")
    for rounds in range(1, max_rounds + 1) if max_rounds else _counted():
        complete = ending.reached(text, rounds)
        if complete or rounds == max_rounds or ending.spent(prompt, text):
            return text, rounds, complete
        begun = ending.resumed(text)
        text = "\n".join([begun, ending.added(generator(prompt, begun))])
    raise ValueError("max_rounds must be positive or None")


def _counted() -> Iterator[int]:
    n = 0
    while True:
        n += 1
        yield n


def enrich(
    chunks: DataFrame,
    generator: Generator,
    *,
    max_rounds: int | None,
    ending: Ending | None = None,
    prompt: str = "text",
    num_partitions: int | None = None,
) -> DataFrame:
    """Replace the ``prompt`` column by the generated text; adds ``rounds``, ``complete`` and ``error``.

    ``max_rounds`` is the caller's bound on calls for one text, None for as many as it takes. There are
    ``num_partitions`` parallel callers, by default as many as the session has cores, however few
    partitions short prompts would be put together to. Each text is given out when it is finished.
    """
    how = ending or glossary_ending()
    keys = [c for c in chunks.columns if c != prompt]
    callers = num_partitions or chunks.sparkSession.sparkContext.defaultParallelism
    chunks = chunks.repartition(callers, *keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(len(pdf)):
                row = pdf.iloc[i : i + 1]
                try:
                    text, rounds, complete = ask_until_end(generator, row[prompt].iloc[0], how, max_rounds)
                    error = None
                except Exception as e:  # a failed call is a value, not a failed job
                    text, rounds, complete, error = None, 0, False, f"{type(e).__name__}: {e}"
                yield row[keys].assign(text=[text], rounds=[rounds], complete=[complete], error=[error])

    types = dict(chunks.dtypes)
    return chunks.mapInPandas(run, ", ".join([*(f"`{c}` {types[c]}" for c in keys), RESULT]))


def ends_with_mark(text: Column) -> Column:
    return F.endswith(text, F.lit(K.END_MARK))


def mark_in_last_line(text: Column) -> Column:
    lines = F.split(F.regexp_replace(text, "\\s+$", ""), "\n")
    return F.contains(F.element_at(lines, -1), F.lit(K.END_MARK))


def answered(
    prompts: DataFrame, answers: DataFrame, keys: Sequence[str], complete: Callable[[Column], Column] = ends_with_mark
) -> DataFrame:
    """Prompts with answers that a batch service gave elsewhere, in the form that ``enrich`` has.

    ``answers`` has ``keys`` and ``text``. A prompt without an answer has an error.
    """
    found = answers.select(*keys, F.col("text").alias("_answer"))
    kept = [c for c in prompts.columns if c != "text"]
    return prompts.join(found, list(keys), "left").select(
        *kept,
        F.col("_answer").alias("text"),
        F.when(F.col("_answer").isNull(), 0).otherwise(1).alias("rounds"),
        F.coalesce(complete(F.col("_answer")), F.lit(False)).alias("complete"),
        F.when(F.col("_answer").isNull(), F.lit("no answer")).alias("error"),
    )


def chunk_dictionary(chunks: DataFrame, excerpts: DataFrame) -> DataFrame:
    """Give each chunk the dictionary excerpt of its number, ``N/A`` where there is none."""
    on = ["run_id", "chunk_no"]
    return chunks.join(excerpts.select(*on, "excerpt"), on, "left").withColumn(
        "excerpt", F.coalesce("excerpt", F.lit(K.NOT_APPLICABLE))
    )
