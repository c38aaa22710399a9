"""Ways, nodes and platforms as GeoJSON features, one a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature(kind: str, coordinates: Column, properties: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties")))


def ways(table: DataFrame, geometry: DataFrame) -> DataFrame:
    """way, json: the line of all points with every property of the way."""
    line = geometry.groupBy("way").agg(F.array_sort(F.collect_list(F.struct("seq", F.array("lng", "lat").alias("at")))).alias("points"))
    properties = F.struct(F.lit("geometry").alias("type"), *[F.col(c) for c in table.columns])
    return table.join(line, "way").select("way", feature("LineString", F.transform("points", lambda p: p["at"]), properties).alias("json"))


def way_edges(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """way, pos, json: each piece between two graph nodes with its own distance."""
    from .lookup import way_segments

    rows = way_segments(way_nodes, nodes)
    line = F.array(F.array("lng_a", "lat_a"), F.array("lng_b", "lat_b"))
    return rows.select("way", "pos", feature("LineString", line, F.struct(F.lit("edge").alias("type"), F.col("way").alias("osm_way_id"), F.col("a").alias("from"), F.col("b").alias("to"), F.col("dist").alias("distance"))).alias("json"))


def nodes(table: DataFrame, labels: DataFrame | None = None, restrictions: DataFrame | None = None) -> DataFrame:
    """node, json: the point with properties, what a search has found there, and its turn restrictions."""
    rows, extra = table, []
    if labels is not None:
        found = labels.groupBy(F.col("state").alias("node")).agg(F.array_sort(F.collect_list(F.struct("query", "cost"))).alias("labels"))
        rows, extra = rows.join(found, "node", "left"), [*extra, F.col("labels")]
    if restrictions is not None:
        found = restrictions.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("from_way", "to_way"))).alias("restrictions"))
        rows, extra = rows.join(found, "node", "left"), [*extra, F.col("restrictions")]
    return rows.select("node", feature("Point", F.array("lng", "lat"), F.struct(*[F.col(c) for c in table.columns if c not in ("lat", "lng")], *extra)).alias("json"))


def platforms(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, json: a platform's names and level at its first reference."""
    at = nodes.select(F.col("node").alias("first"), "lat", "lng", "level")
    return found.withColumn("first", F.element_at("refs", 1)).join(at, "first").select("id", feature("Point", F.array("lng", "lat"), F.struct("names", "level")).alias("json"))
