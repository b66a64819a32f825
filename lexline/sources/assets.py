"""Assets exported from a catalog service as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexline import constants as K
from lexline.functions.text import asset_label

ENTITY_SCHEMA = (
    "referredEntities map<string, struct<typeName: string, attributes: struct<"
    "name: string, data_type: string, is_nullable: boolean, description: string>>>"
)


def asset_list(assets: DataFrame, type_name: str = K.ASSET_TABLE_TYPE, cap: int | None = None) -> DataFrame:
    """Name and guid of assets (``id, name, entityType``) of one type.

    All are listed unless ``cap`` asks for as many as one search answer holds.
    """
    found = assets.where(F.col("entityType") == type_name).select("name", F.col("id").alias("guid"))
    return found if cap is None else found.orderBy("guid").limit(cap)


def asset_columns(details: DataFrame, type_name: str = K.ASSET_COLUMN_TYPE) -> DataFrame:
    """Columns of each asset (``guid, json``) with defaults: nullable, empty description."""
    attributes = F.col("entity.attributes")
    return (
        details.select(
            "guid",
            F.posexplode(F.map_entries(F.from_json("json", ENTITY_SCHEMA)["referredEntities"])).alias(
                "pos", "e"
            ),
        )
        .select("guid", "pos", F.col("e.key").alias("column_guid"), F.col("e.value").alias("entity"))
        .where(F.col("entity.typeName") == type_name)
        .select(
            "guid",
            "pos",
            "column_guid",
            attributes["name"].alias("name"),
            attributes["data_type"].alias("type"),
            F.coalesce(attributes["is_nullable"], F.lit(True)).alias("nullable"),
            F.coalesce(attributes["description"], F.lit("")).alias("description"),
        )
    )


def asset_labels(columns: DataFrame, notes: bool = True) -> DataFrame:
    """Labels of asset columns; without ``notes`` they stop after the type."""
    label = (
        asset_label(F.col("name"), F.col("type"), F.col("nullable"), F.col("description"))
        if notes
        else F.concat("name", F.lit(": ("), "type", F.lit(")"))
    )
    return columns.select("guid", "pos", "name", label.alias("label"))
