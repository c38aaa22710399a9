"""The synthetic street network over the test tables: a way is an order, a node a part, a line joins them in order.

Every query and its SQL twin use the same definitions: NETWORK_SQL is the twin of network()."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import regions
from .tables import broadcasts, file_bytes, shares

# Name and SQL expression (the same in both engines) of each property of a way and of a node.
WAY_PROPERTIES = {
    "speed": "case substr(o_orderpriority, 1, 1) when '1' then 100 when '2' then 80 when '3' then 50 when '4' then 30 else 10 end",
    "big_street": "substr(o_orderpriority, 1, 1) in ('1', '2')",
    "oneway": "o_orderstatus = 'F' and o_orderkey % 3 = 0",
    "destination": "o_orderstatus = 'P'",
    "foot": "o_orderkey % 11 <> 3",
    "bike": "o_orderkey % 7 <> 2",
    "car": "o_orderkey % 5 <> 1",
    "bus": "o_orderkey % 6 <> 1",
    "bus_penalty": "o_orderkey % 12 = 1",
    "railway": "o_orderkey % 4 = 0",
    "railway_penalty": "o_orderkey % 8 = 2",
    "ferry": "o_orderkey % 9 <> 0",
    "sidewalk_separate": "o_orderkey % 13 = 5",
    "steps": "o_orderkey % 17 = 4",
    "motor_vehicle_no": "o_orderkey % 5 = 1",
    "in_route": "o_orderkey % 10 = 0",
    "parking": "o_orderkey % 23 = 0",
    "hgv_access": "case o_orderkey % 7 when 0 then 'designated' when 1 then 'destination' when 2 then 'no' when 3 then 'delivery' when 4 then 'yes' end",
    "maxweight_100kg": "case when o_orderkey % 3 = 0 then 35 + o_orderkey % 400 end",
    "lez": "o_orderkey % 29 = 0",
    "detour": "o_orderkey % 31 = 0",
}
NODE_PROPERTIES = {
    "lat": "48.0 + (p_partkey % 1000) * 0.001",
    "lng": "9.0 + floor(p_partkey / 1000) * 0.001",
    "foot": "p_partkey % 29 <> 7",
    "bike": "p_partkey % 31 <> 9",
    "car": "p_partkey % 37 <> 11",
    "bus": "p_partkey % 41 <> 13",
    "elevator": "p_size % 10 = 0",
    "parking": "p_size % 7 = 0",
    "level": "p_size % 5",
}
_duck = {"lat": "48.0::double + (p_partkey % 1000) * 0.001::double", "lng": "9.0::double + (p_partkey // 1000) * 0.001::double"}

NETWORK_SQL = f"""
way_nodes as (
  select l_orderkey as way, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as pos,
         l_partkey as node, l_quantity::bigint as dist from lineitem),
ways as (select o_orderkey as way, {', '.join(f'{e} as {n}' for n, e in WAY_PROPERTIES.items())} from orders),
nodes as (select p_partkey as node, {', '.join(f'{_duck.get(n, e)} as {n}' for n, e in NODE_PROPERTIES.items())} from part),
segments as (select way, pos, node as a, lead(node) over (partition by way order by pos) as b, dist from way_nodes),
edges as (
  select way, pos, a as src, b as dst, pos + 1 as to_pos, true as forward, dist from segments where b is not null
  union all select way, pos + 1, b, a, pos, false, dist from segments where b is not null)
"""


@dataclass
class Network:
    """Tables of a network: ways with properties, nodes with properties, and which nodes a way passes in which order."""

    ways: DataFrame
    nodes: DataFrame
    way_nodes: DataFrame
    #: partitions of places, and of edges that meet nodes; null where Spark broadcasts the nodes or the session's number does
    parts: int | None = None
    #: way and node of all places, as the table lies; null: those of way_nodes
    places: DataFrame | None = None
    #: way_nodes of some ways (way; whether they are few) only, chosen before places are put in order
    within: Callable[[DataFrame, bool], DataFrame] | None = None

    def around(self, starts: DataFrame, extra: DataFrame | None = None) -> Network:
        """The network of the regions that starts (node) lie in, told from the places alone, before anything is priced. extra: edges
        (src, dst) beside those of the ways."""
        near = regions.ways_around(self.way_nodes.select("way", "node") if self.places is None else self.places, starts, extra)
        ways, at = (near.filter(F.col("kind") == k).select(F.col("id").alias(name)) for k, name in ((0, "way"), (1, "node")))
        few = file_bytes(near) <= 16 << 20
        ways, at = (F.broadcast(t) if few else t for t in (ways, at.union(starts.select("node")).distinct()))
        lines = self.within(ways, few) if self.within else self.way_nodes.join(ways, "way", "left_semi")
        return Network(self.ways, self.nodes.join(at, "node", "left_semi"), lines, None if few else self.parts)

    @property
    def edges(self) -> DataFrame:
        """Directed neighbours along each way, with the distance between them."""
        order = Window.partitionBy("way").orderBy("pos")
        line = self.way_nodes.select("way", "pos", F.col("node").alias("a"), F.lead("node").over(order).alias("b"), "dist").filter("b is not null")
        both = F.array(
            F.struct(F.col("pos").alias("pos"), F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("pos") + 1).alias("to_pos"), F.lit(True).alias("forward")),
            F.struct((F.col("pos") + 1).alias("pos"), F.col("b").alias("src"), F.col("a").alias("dst"), F.col("pos").alias("to_pos"), F.lit(False).alias("forward")),
        )
        return line.select("way", "dist", F.explode(both).alias("e")).select("way", "e.pos", "e.src", "e.dst", "e.to_pos", "e.forward", "dist")


def network(spark: SparkSession, sf_dir: str) -> Network:
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    # a way's places lie together in partitions whose number grows with the table, not their size
    lines = table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    many, least = shares(spark, f"{sf_dir}/lineitem.parquet"), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def along(ways: DataFrame | None = None, few: bool = False) -> DataFrame:
        rows = lines if ways is None else lines.join(ways.select(F.col("way").alias("l_orderkey")), "l_orderkey", "left_semi")
        rows = rows.repartition(many, "l_orderkey") if many > least and not few else rows
        return rows.select(F.col("l_orderkey").alias("way"), (F.row_number().over(order) - 1).cast("long").alias("pos"), F.col("l_partkey").alias("node"), F.col("l_quantity").cast("long").alias("dist"))

    exact = {"lat": "48.0d + (p_partkey % 1000) * 0.001d", "lng": "9.0d + floor(p_partkey / 1000) * 0.001d"}
    ways = table("orders").select(F.col("o_orderkey").alias("way"), *[F.expr(e).alias(n) for n, e in WAY_PROPERTIES.items()])
    nodes = table("part").select(F.col("p_partkey").alias("node"), *[F.expr(exact.get(n, e)).alias(n) for n, e in NODE_PROPERTIES.items()])
    large = many > least and not broadcasts(spark, f"{sf_dir}/part.parquet")
    places = lines.select(F.col("l_orderkey").alias("way"), F.col("l_partkey").alias("node"))
    return Network(ways, nodes, along(), many if large else None, places, along)
