"""Platforms: names from several tags, level from the first reference, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags that name a platform, in order.
NAME_TAGS = ("ref", "ref:IFOPT", "ref:operator", "ref_name", "local_ref", "name", "alt_name", "description")


def names(tags: Column) -> Column:
    """All names, split at semicolons, without blanks."""
    parts = F.flatten(F.array(*[F.split(F.coalesce(F.try_element_at(tags, F.lit(t)), F.lit("")), ";") for t in NAME_TAGS]))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def platforms(objects: DataFrame) -> DataFrame:
    """Objects (id, refs, tags) with their names; nameless ones are dropped."""
    return objects.withColumn("names", names(F.col("tags"))).filter(F.size("names") > 0)


def levels(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, level: of the first reference."""
    return found.select("id", F.element_at("refs", 1).alias("node")).join(nodes.select("node", "level"), "node").select("id", "level")


def boxes(found: DataFrame, nodes: DataFrame) -> DataFrame:
    at = found.select("id", F.explode("refs").alias("node")).join(nodes.select("node", "lat", "lng"), "node")
    return at.groupBy("id").agg(F.min("lat").alias("lat_low"), F.max("lat").alias("lat_high"), F.min("lng").alias("lng_low"), F.max("lng").alias("lng_high"))
