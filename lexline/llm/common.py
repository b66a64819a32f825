"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that goes to a Python task, one row more at most.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Let Spark send texts to Python tasks in batches of a few megabytes, whatever their number of rows.

    The session's limit is lowered to ``BATCH_BYTES``; a lower one stays. Results are the same.
    """
    if _bytes(spark.conf.get(_LIMIT)) > BATCH_BYTES:
        spark.conf.set(_LIMIT, f"{BATCH_BYTES}b")


def _bytes(size: str) -> int:
    found = re.fullmatch(r"(-?\d+)([kmgt]?)b?", size.strip().lower())
    number = int(found[1]) << 10 * " kmgt".index(found[2] or " ")
    return number if number > 0 else 1 << 62


def uniform(*parts: Column | int) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone, so a task that runs again draws it again."""
    columns = [F.lit(p) if isinstance(p, int) else p for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) * F.lit(2.0**-53)


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(divisor)).cast("int")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
