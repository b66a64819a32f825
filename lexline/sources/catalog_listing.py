"""Catalogs of a server listed by tasks: a data source whose partitions are catalogs.

The reader plans one partition for each catalog, and tasks list the schemas of their own ones, so a
server with many catalogs is listed in parallel and the driver gives one call. A catalog that can't be
listed is a row with its error and stops nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "catalog_no int, catalog_name string, schema_no int, schema_name string, table_no int, table_name string, error string"


class Server(Protocol):
    """What a connection can list."""

    def catalogs(self) -> Iterable[str]: ...

    def schemas(self, catalog: str) -> Iterable[str]: ...

    def tables(self, catalog: str, schema: str) -> Iterable[str]: ...


class _Catalog(InputPartition):
    def __init__(self, number: int, name: str):
        super().__init__(number)
        self.name = name


def _told(e: Exception) -> str:
    return f"{type(e).__name__}: {e}".split("\n")[0]


class _Reader(DataSourceReader):
    def __init__(self, connect: Callable[[], Server], tables: bool):
        self.connect, self.tables = connect, tables

    def partitions(self) -> list[InputPartition]:
        return [_Catalog(i, name) for i, name in enumerate(self.connect().catalogs())]

    def read(self, partition: _Catalog) -> Iterator[tuple]:
        at = (partition.value, partition.name)
        try:
            server = self.connect()
            schemas = list(server.schemas(partition.name))
        except Exception as e:  # a catalog that can't be listed is a row, not a failed job
            yield (*at, None, None, None, None, _told(e))
            return
        if not schemas:
            yield (*at, None, None, None, None, None)
        for i, schema in enumerate(schemas):
            names: list[str] = []
            error = None
            if self.tables:
                try:
                    names = list(server.tables(partition.name, schema))
                except Exception as e:
                    error = _told(e)
            if not names:
                yield (*at, i, schema, None, None, error)
            for k, table in enumerate(names):
                yield (*at, i, schema, k, table, None)


def list_server(spark: SparkSession, connect: Callable[[], Server], conn_id: str, tables: bool = False) -> DataFrame:
    """(conn_id, catalog_no, catalog_name, schema_no, schema_name, table_no, table_name, error).

    ``connect`` is picklable and called once for the plan and once in each task. A catalog without schemas has
    one row without a schema, a schema without tables (or where ``tables`` are not asked for) one without a
    table; a failure is a row with ``error``.
    """

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return "server_listing"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(connect, tables)

    spark.dataSource.register(Listing)
    found = spark.read.format("server_listing").load()
    return found.select(F.lit(conn_id).alias("conn_id"), "*")


def report_inputs(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalogs and schemas of a listing as ``catalog.structure_report`` takes them."""
    keys = ["conn_id", "catalog_no", "catalog_name"]
    failed = F.max(F.col("error").isNotNull() & F.col("schema_name").isNull())
    catalogs = listing.groupBy(*keys).agg(failed.alias("failed"))
    schemas = listing.where(F.col("schema_name").isNotNull()).select("conn_id", "catalog_name", "schema_no", "schema_name")
    return catalogs, schemas.distinct()
