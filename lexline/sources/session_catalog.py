"""The session's own catalogs as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexline.operators.catalog import user_schemas


def list_catalogs(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW CATALOGS").select(F.col("catalog").alias("catalog_name"))


def list_schemas(spark: SparkSession, catalog: str = "spark_catalog") -> DataFrame:
    found = spark.sql(f"SHOW SCHEMAS IN `{catalog}`").select(F.col("namespace").alias("schema_name"))
    return user_schemas(found)


def list_tables(spark: SparkSession, schema: str, catalog: str = "spark_catalog") -> DataFrame:
    return (
        spark.sql(f"SHOW TABLES IN `{catalog}`.`{schema}`")
        .where(~F.col("isTemporary"))
        .select(F.col("namespace").alias("schema_name"), F.col("tableName").alias("table_name"))
    )


def table_columns(spark: SparkSession, schema: str, table: str, conn_id: str) -> DataFrame:
    """Dictionary rows of one table, from its schema alone; no data is read."""
    rows = [
        (conn_id, schema, table, i, f.name, f.dataType.simpleString().upper(), "YES" if f.nullable else "NO", None)
        for i, f in enumerate(spark.table(f"`{schema}`.`{table}`").schema.fields, start=1)
    ]
    return spark.createDataFrame(
        rows,
        "conn_id string, schema_name string, table_name string, pos int, column_name string, "
        "data_type string, is_nullable string, column_default string",
    )
