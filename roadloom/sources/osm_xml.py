"""OpenStreetMap XML as tables. Schemas are given, as inference reads a lone tag as a struct instead of a list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import tag_map

_TAG = "tag array<struct<_k:string,_v:string>>"
NODE = f"_id bigint, _lat double, _lon double, {_TAG}"
WAY = f"_id bigint, nd array<struct<_ref:bigint>>, {_TAG}"
RELATION = f"_id bigint, member array<struct<_type:string,_ref:bigint,_role:string>>, {_TAG}"


def _rows(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", kind).schema(schema).load(path)


def nodes(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, "node", NODE).select(F.col("_id").alias("node"), F.col("_lat").alias("lat"), F.col("_lon").alias("lng"), tag_map(F.col("tag")).alias("tags"))


def ways(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, "way", WAY).select(F.col("_id").alias("way"), F.transform("nd", lambda n: n["_ref"]).alias("refs"), tag_map(F.col("tag")).alias("tags"))


def relations(spark: SparkSession, path: str) -> DataFrame:
    member = F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role")))
    return _rows(spark, path, "relation", RELATION).select(F.col("_id").alias("relation"), member.alias("members"), tag_map(F.col("tag")).alias("tags"))


def tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {"nodes": nodes(spark, path), "ways": ways(spark, path), "relations": relations(spark, path)}
