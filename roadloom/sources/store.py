"""Extracted networks on disk: one Parquet table each, ordered so that a lookup by way or node reads few row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sorting column of each table; reading by it prunes by the statistics of row groups.
ORDER = {"ways": "way", "nodes": "node", "way_nodes": "way", "node_ways": "node", "geometry": "way", "restrictions": "node"}


def save(tables: dict[str, DataFrame], path: str) -> None:
    """Writes what extract() gives; each table is ranged by its key, so files and row groups hold a stretch of it."""
    for name, table in tables.items():
        key = ORDER[name]
        table.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """The tables that were saved, or those named."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in names or ORDER}
