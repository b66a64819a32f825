"""Small shared tables kept as numbered versions, such as the glossaries of a catalog.

A version is a folder of Parquet files. It counts once its number is taken: an entry of that number in
the log, which names the folder and is created only if there is none yet. Of two writers who start from the same
version one gets the number; the other reads what is there now and tries again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexline.operators import publish

REGISTRY = "name string, guid string, pos long"


def _files(spark: SparkSession, path: str):
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), fs.Path


def _entry(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/log/{version:012d}"


def latest(spark: SparkSession, path: str) -> int:
    """The newest version, 0 if there is none."""
    files, make = _files(spark, path)
    folder = make(f"{path.rstrip('/')}/log")
    if not files.exists(folder):
        return 0
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def read(spark: SparkSession, path: str, schema: str = REGISTRY, version: int | None = None) -> DataFrame:
    """The rows of a version, of the newest by default; none before the first."""
    number = latest(spark, path) if version is None else version
    if number == 0:
        return spark.createDataFrame([], schema)
    folder = spark.read.text(_entry(path, number)).first()[0]
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/data/{folder}")


def _take(spark: SparkSession, path: str, version: int, folder: str) -> bool:
    """Whether this writer got the number."""
    files, make = _files(spark, path)
    try:
        out = files.create(make(_entry(path, version)), False)
    except Exception as e:
        if files.exists(make(_entry(path, version))):
            return False
        raise e
    out.write(bytearray(folder.encode()))
    out.close()
    return True


def change(
    spark: SparkSession, path: str, made: Callable[[DataFrame], DataFrame | None], schema: str = REGISTRY, attempts: int = 5
) -> int:
    """Write ``made(rows)`` as the next version and return its number; None for no change.

    ``made`` is called again with the newest rows if another writer was faster.
    """
    for _ in range(attempts):
        number = latest(spark, path)
        rows = made(read(spark, path, schema, number))
        if rows is None:
            return number
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{path.rstrip('/')}/data/{folder}")
        if _take(spark, path, number + 1, folder):
            return number + 1
    raise RuntimeError(f"{attempts} other writers were faster at {path}")


def register_glossaries(spark: SparkSession, requests: DataFrame, path: str) -> DataFrame:
    """Result of ``publish.find_or_create_glossary`` with the new entries written to the registry at ``path``.

    Names that are there already, whatever their case, are not written again, so the same requests give one
    entry each however often, and from however many sessions, they come. ``created`` is true for entries
    that this call has written.
    """
    asked: list[DataFrame] = []

    def made(rows: DataFrame) -> DataFrame | None:
        asked[:] = [publish.find_or_create_glossary(requests, rows)]
        new = asked[0].where("created")
        if new.isEmpty():
            return None
        places = publish.new_entries(new, rows)
        return rows.unionByName(places)

    number = change(spark, path, made)
    now = read(spark, path, version=number).select("guid").distinct()
    return asked[0].join(now, "guid", "left_semi").select("name", "guid", "created")
