"""Writers. Each run writes to its own folder, so a repeated run replaces its own output only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexline import constants as K


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).options(
        header="true",
        quote='"',
        escape='"',
        quoteAll="true",
        ignoreLeadingWhiteSpace="false",
        ignoreTrailingWhiteSpace="false",
    ).csv(path)


def glossary_frame(glossary: DataFrame, *extra: str) -> DataFrame:
    """Glossary rows under the headers of the five-column file."""
    return glossary.select(
        *[F.col(c).alias(h) for c, h in zip(K.GLOSSARY_COLUMNS, K.GLOSSARY_HEADERS)], *extra
    )


def write_glossary(glossary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Five-column glossary CSV; ``row_no`` is written too when the rows have one."""
    extra = ["row_no"] if "row_no" in glossary.columns else []
    write_csv(glossary_frame(glossary, *extra), path, mode)


def write_sheet_glossary(glossary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Four-column glossary CSV with the key columns its spans refer to."""
    named = [F.col(c).alias(h) for c, h in zip(K.SHEET_GLOSSARY_COLUMNS, K.SHEET_GLOSSARY_HEADERS)]
    keys = [c for c in ("doc_id", "row_no") if c in glossary.columns]
    write_csv(glossary.select(*keys, *named), path, mode)


def write_documentation(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Fourteen-column documentation CSV per script."""
    named = [F.col(c).alias(h) for c, h in zip(K.LINEAGE_COLUMNS, K.LINEAGE_HEADERS)]
    write_csv(rows.select("script_id", "row_no", *named), path, mode)


def write_lines(lines: DataFrame, path: str, order: Sequence[str], mode: str = "overwrite") -> None:
    """Text lines in a global order, over as many files as the sort has ranges."""
    lines.orderBy(*order).select("text").write.mode(mode).text(path)


def append_text(texts: DataFrame, path: str, batch_id: int | str | None = None) -> None:
    """Append generated texts of a batch.

    With a ``batch_id`` the batch has a folder of its own below ``path``, which the same batch replaces when it
    is run again, as a stream's batch may be; ``spark.read.text(path)`` then reads each text once.
    """
    if batch_id is None:
        texts.select("text").write.mode("append").text(path)
    else:
        texts.select("text").write.mode("overwrite").text(f"{path.rstrip('/')}/batch_id={batch_id}")
