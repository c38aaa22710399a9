"""From tagged objects (nodes, ways, relations) to the tables of a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.access import Tags
from ..functions.scalars import osm_order
from ..plans.tables import kept
from . import graph


def tag_map(tags: Column) -> Column:
    """A list of (_k, _v) as a map; the last of repeated keys holds."""
    last = F.aggregate(tags, F.array().cast("array<struct<key:string,value:string>>"), lambda a, t: F.concat(F.filter(a, lambda x: x["key"] != t["_k"]), F.array(F.struct(t["_k"].alias("key"), t["_v"].alias("value")))))
    return F.map_from_entries(F.coalesce(last, F.array().cast("array<struct<key:string,value:string>>")))


def merged_relations(members: DataFrame) -> DataFrame:
    """way, in_route, detour (of any relation) and the first relation, of (relation, way, in_route, detour)."""
    return members.groupBy("way").agg(F.bool_or("in_route").alias("in_route"), F.bool_or("detour").alias("detour"), F.min("relation").alias("first_relation"))


def blocking_nodes(nodes: DataFrame) -> DataFrame:
    """Tagged nodes that bar some way of travel, lifts and platforms: they split ways like crossings do."""
    t = Tags(F.col("tags"), "node")
    return nodes.filter((F.size("tags") > 0) & (~(t.foot & t.bike & t.car) | t.elevator | t.platform)).select("node")


def admission() -> Column:
    """Whether a way (refs, tags) is worth keeping: two nodes or more, lifts only as loops, not mere land use, and open to someone."""
    t = Tags(F.col("tags"))
    shaped = (F.size("refs") >= 2) & (~t.elevator | (F.element_at("refs", 1) == F.element_at("refs", -1))) & ~(t.landuse & (t["highway"] == "") & ~t.parking)
    return shaped & (t.foot | t.bike | t.car | t.bus_access | t.bus_penalty | t.railway | t.railway_penalty | t.ferry_access | t.platform)


def described(ways: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Ways (way, refs, tags) with their properties."""
    t = Tags(F.col("tags"))
    trucks = {"access_forward": "hgv_access_forward", "access_backward": "hgv_access_backward", "maxspeed_kmh": "hgv_maxspeed_kmh"}
    rows = ways.select("way", "refs", "tags", *[c.alias(n) for n, c in t.way_properties().items()], *[c.alias(trucks.get(n, n)) for n, c in t.hgv_info().items()])
    if relations is not None:
        extra = relations.select("way", F.col("in_route").alias("_in_route"), F.col("detour").alias("_detour"))
        rows = rows.join(extra, "way", "left").withColumn("in_route", F.col("in_route") | F.coalesce("_in_route", F.lit(False))).withColumn("detour", F.col("detour") | F.coalesce("_detour", F.lit(False))).drop("_in_route", "_detour")
    return rows


def admitted_ways(ways: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Ways (way, refs, tags) worth keeping, with their properties."""
    return described(ways.filter(admission()), relations)


def geometry(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """way, seq, node, lat, lng of every point of a way whose place is known."""
    points = ways.select("way", F.posexplode("refs").alias("seq", "node"))
    return points.join(nodes.select("node", "lat", "lng"), "node").select("way", "seq", "node", "lat", "lng")


def turn_relations(relations: DataFrame, vehicle: str | None = None) -> DataFrame:
    """node, from_way, to_way, kind of turn restrictions (relation, members, tags) over a node; those that except the vehicle
    are left out, and every from way is paired with every to way."""
    t = Tags(F.col("tags"), "relation")
    rule = F.coalesce(F.nullif(t["restriction"], F.lit("")), F.when(F.lit(vehicle == "hgv"), F.nullif(t["restriction:hgv"], F.lit(""))))
    rows = relations.filter(t["type"] == "restriction").withColumn("_rule", rule).filter("_rule is not null")
    if vehicle:
        spared = F.transform(F.split(t["except"], ";"), lambda x: F.trim(x))
        rows = rows.filter(~F.array_contains(spared, vehicle) & ~(F.array_contains(spared, "psv") & F.lit(vehicle == "bus")))
    role = lambda r, kind: F.transform(F.filter("members", lambda m: (m["role"] == r) & (m["type"] == kind)), lambda m: m["ref"])
    kind = F.when(F.col("_rule").startswith("no_"), "no").when(F.col("_rule").startswith("only_"), "only")
    rows = rows.select(role("from", "way").alias("f"), role("to", "way").alias("t"), role("via", "node").alias("v"), kind.alias("kind")).filter("kind is not null and size(v) = 1")
    return rows.select(F.element_at("v", 1).alias("node"), F.explode("f").alias("from_way"), "t", "kind").select("node", "from_way", F.explode("t").alias("to_way"), "kind")


def extract(nodes: DataFrame, ways: DataFrame, relations: DataFrame | None = None) -> dict[str, DataFrame]:
    """ways, nodes, way_nodes, node_ways, geometry, restrictions of tagged tables: nodes (node, lat, lng, tags), ways (way, refs,
    tags), relations (relation, members, tags). Each is worked out as it is
    read: keep what is read often."""
    merged = None
    if relations is not None:
        t = Tags(F.col("tags"), "relation")
        members = relations.select("relation", t.in_route.alias("in_route"), t.detour.alias("detour"), F.explode("members").alias("m")).filter("m.type = 'way'")
        merged = merged_relations(members.select("relation", F.col("m.ref").alias("way"), "in_route", "detour"))
    # a flag, as a filter would be pushed down to where the tags are made and make them anew for every rule
    flagged = ways.select("way", admission().alias("_kept"), "refs", "tags")
    flagged = flagged.select("way", "_kept", *[F.when(F.col("_kept"), F.col(c)).alias(c) for c in ("refs", "tags")])
    kept_ways = kept(flagged, "ways", long=True).filter("_kept").drop("_kept")
    shape = kept(geometry(kept_ways, nodes), "geometry")
    crossings = kept(graph.graph_nodes(shape, blocking_nodes(nodes)), "crossings")
    way_nodes = graph.connected_way_nodes(shape, crossings)
    t = Tags(F.col("tags"), "node")
    properties = nodes.join(crossings.select("node"), "node", "left_semi").select("node", "lat", "lng", *[c.alias(n) for n, c in t.node_properties().items()])
    out = {"ways": described(kept_ways, merged).drop("refs", "tags"), "nodes": properties, "way_nodes": way_nodes.select("way", "pos", "node", "dist"), "geometry": shape, "node_ways": graph.node_ways(way_nodes)}
    if relations is not None:
        out["restrictions"] = graph.restrictions(turn_relations(relations), way_nodes)
    return out


def dense_ids(nodes: DataFrame) -> DataFrame:
    """node, idx in order of id: 0, negative ids by size, positive ones. One partition orders a bucket of ids; offsets join them."""
    from pyspark.sql import Window

    ranged = nodes.select("node").distinct().withColumn("_order", osm_order(F.col("node"))).withColumn("_bucket", F.struct(F.col("_order.col1"), F.col("_order.col2"), F.floor(F.abs("node") / 65536)))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_order"))
    counts = ranged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("_bucket", F.coalesce(F.sum("n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranged.withColumn("_inside", inside).join(offsets, "_bucket").select("node", (F.col("before") + F.col("_inside") - 1).alias("idx"))
