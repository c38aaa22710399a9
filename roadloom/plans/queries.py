"""Network queries and their SQL twins: graph, costs, search, paths, spatial lookup, matching."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import costs, scalars
from ..operators import graph, levels, lookup, matching, modes, paths, regions, search
from .network import NETWORK_SQL, Network, network

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LIMIT = scalars.INFEASIBLE


def query(name: str, sql: str | None = None, plain: bool = False):
    """Registers a function of (network); its SQL follows the network's definitions unless plain."""

    def add(function: Callable[[Network], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function(network(spark, sf_dir))
        if sql:
            SQL[name] = sql if plain else f"with recursive {NETWORK_SQL}{'' if sql.lstrip().startswith('select') else ', '}{sql}"
        return function

    return add


# graph


@query("node_use_count", "select node, count(*) as uses from way_nodes group by node")
def _(n):
    return graph.node_use_count(n.way_nodes)


@query("graph_nodes", "select node, count(*) as uses from way_nodes group by node having count(*) >= 2")
def _(n):
    return graph.graph_nodes(n.way_nodes)


@query("way_nodes", "select way, pos, node, dist from way_nodes")
def _(n):
    return n.way_nodes


@query("node_ways", "select node, row_number() over (partition by node order by way, pos) - 1 as way_pos, way, pos from way_nodes")
def _(n):
    return graph.node_ways(n.way_nodes)


@query("directed_edges", "select way, pos, src, dst, to_pos, forward, dist from edges")
def _(n):
    return n.edges


@query("way_loops", "select way, arg_min(node, pos) = arg_max(node, pos) as is_loop from way_nodes group by way")
def _(n):
    return graph.is_loop(n.way_nodes)


@query("way_positions", "nw as (select node, way, row_number() over (partition by node order by way, pos) - 1 as way_pos from way_nodes) select node, way, min(way_pos) as way_pos from nw group by all")
def _(n):
    return graph.way_positions(graph.node_ways(n.way_nodes))


_SIGNS = "signs as (select node, way as from_way, lead(way) over (partition by node order by way, pos) as to_way, node % 7 as k from way_nodes), rel as (select distinct node, from_way, to_way, case k when 0 then 'no' when 1 then 'only' end as kind from signs where to_way is not null and k < 2)"


def _signs(n: Network) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("node").orderBy("way", "pos")
    rows = n.way_nodes.select("node", F.col("way").alias("from_way"), F.lead("way").over(order).alias("to_way"), (F.col("node") % 7).alias("k"))
    return rows.filter("to_way is not null and k < 2").select("node", "from_way", "to_way", F.when(F.col("k") == 0, "no").otherwise("only").alias("kind")).distinct()


_FORBIDDEN = _SIGNS + """, forbidden as (
  select node, from_way, to_way from rel where kind = 'no'
  union select r.node, r.from_way, w.way from rel r join way_nodes w on w.node = r.node where r.kind = 'only' and w.way <> r.to_way)"""


@query("turn_restrictions", _FORBIDDEN + " select node, from_way, to_way from forbidden")
def _(n):
    return graph.restrictions(_signs(n), n.way_nodes)


@query("turn_pairs_allowed", _FORBIDDEN + ", p as (select distinct node, way from way_nodes) select a.node, a.way as from_way, b.way as to_way from p a join p b using (node) where not exists (select 1 from forbidden f where f.node = a.node and f.from_way = a.way and f.to_way = b.way)")
def _(n):
    return graph.allowed_turns(n.way_nodes, graph.restrictions(_signs(n), n.way_nodes))


_BEARING = "(degrees(atan2(sin(radians({b}.lng - {a}.lng)) * cos(radians({b}.lat)), cos(radians({a}.lat)) * sin(radians({b}.lat)) - sin(radians({a}.lat)) * cos(radians({b}.lat)) * cos(radians({b}.lng - {a}.lng)))) + 360) % 360"


@query(
    "way_bearings",
    f"spots as (select way, pos, node, lat, lng from way_nodes join nodes using (node)) select c.way, c.pos, c.node, coalesce(round({_BEARING.format(a='c', b='p')} * 256 / 360)::int % 256, 0)::int as to_prev, coalesce(round({_BEARING.format(a='c', b='x')} * 256 / 360)::int % 256, 0)::int as to_next from spots c left join spots p on p.way = c.way and p.pos = c.pos - 1 left join spots x on x.way = c.way and x.pos = c.pos + 1",
)
def _(n):
    return graph.bearings(n.way_nodes, n.nodes)


@query("big_street_neighbors", "big as (select distinct node from way_nodes join ways using (way) where big_street) select way, big_street or way in (select way from way_nodes join big using (node)) as big_street from ways")
def _(n):
    return graph.big_streets(n.ways, n.way_nodes)


@query(
    "components",
    """wn as materialized (select distinct way, node from way_nodes),
low as (select node, min(way) as low from wn group by node),
pairs as (select distinct way as u, low as v from wn join low using (node) where way <> low),
adj as materialized (select u, v from pairs union all select v, u from pairs),
r(way, component) using key (way) as (
  select distinct way, way from wn
  union
  select a.v, min(r.component) from r join adj a on a.u = r.way left join recurring.r as b on b.way = a.v
  group by a.v having min(r.component) < min(b.component))
select way, component from r""",
)
def _(n):
    return graph.components(n.way_nodes)


def _relation_merge(spark, sf_dir):
    from ..operators import extract

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    even = orders.filter("o_custkey % 2 = 0").select(F.col("o_custkey").alias("relation"), F.col("o_orderkey").alias("way"), F.expr("o_custkey % 3 = 0").alias("in_route"), F.expr("o_custkey % 5 = 0").alias("detour"))
    more = orders.select((F.col("o_custkey") + 1000000).alias("relation"), (F.col("o_orderkey") + 1).alias("way"), F.expr("o_custkey % 4 = 0").alias("in_route"), F.lit(False).alias("detour"))
    return extract.merged_relations(even.union(more))


QUERIES["relation_merge"] = _relation_merge
SQL["relation_merge"] = "with members as (select o_custkey as relation, o_orderkey as way, o_custkey % 3 = 0 as in_route, o_custkey % 5 = 0 as detour from orders where o_custkey % 2 = 0 union all select o_custkey + 1000000, o_orderkey + 1, o_custkey % 4 = 0, false from orders) select way, bool_or(in_route) as in_route, bool_or(detour) as detour, min(relation) as first_relation from members group by way"


# costs


def _priced(n: Network, profile: costs.Profile) -> DataFrame:
    return costs.priced(n.edges, n.ways, n.nodes, profile, n.parts)


_JOINED = "e as (select e.*, w.* exclude (way), n.foot as node_foot, n.bike as node_bike, n.car as node_car, n.bus as node_bus, n.elevator as node_elevator from edges e join ways w using (way) join nodes n on n.node = e.dst)"
_DURATION = "least(greatest({}, 0), 65535)::bigint"
_COSTS = {
    "foot": ("case when foot or bike then (case when foot then 0 else 90 end + case when sidewalk_separate then 45 else 0 end + round(dist / (1.2::double + case when big_street then -0.2::double else 0 end + case when motor_vehicle_no then 0.1::double else 0 end)))::bigint end", "round(dist / 1.2::double)", "case when node_foot then case when node_elevator then 90 else 0 end end"),
    "wheelchair": ("case when (foot or bike) and not steps then (case when foot then 0 else 90 end + case when sidewalk_separate then 45 else 0 end + round(dist / (0.8::double + case when big_street then -0.2::double else 0 end + case when motor_vehicle_no then 0.1::double else 0 end)))::bigint end", "round(dist / 0.8::double)", "case when node_foot then case when node_elevator then 90 else 0 end end"),
    "bike": ("case when bike and (forward or not oneway) then round(dist / (4.2::double + (case when big_street then -0.7::double else 0 end + case when motor_vehicle_no then 0.5::double else 0 end)))::bigint end", "round(dist / 4.2::double)", "case when node_bike then 0 end"),
    "bike_fast": ("case when bike and (forward or not oneway) then round(dist / 4.2::double)::bigint end", "round(dist / 4.2::double)", "case when node_bike then 0 end"),
    "car": ("case when car and (forward or not oneway) then (round_even(dist * (3.6::double / speed), 0) * case when destination then 5 else 1 end + case when destination then 120 else 0 end)::bigint end", "round_even(dist * (3.6::double / speed), 0)", "case when node_car then 0 end"),
    "bus": ("case when (bus or bus_penalty) and (forward or not oneway) then (round_even(case when in_route or not car then 1.0::double else 1.5::double end * dist * (3.6::double / case when in_route then greatest(speed, 50) else speed end), 0) * case when parking then 2 else 1 end * case when bus_penalty then case when in_route then 2 else 4 end else 1 end)::bigint end", "round_even(dist * (3.6::double / case when in_route then greatest(speed, 50) else speed end), 0)", "case when node_bus then 0 else 60 end"),
    "hgv": (
        "case when coalesce(hgv_access <> 'no', car) and coalesce(maxweight_100kg >= 75, true) and (forward or not oneway) and not lez then round((case when hgv_access = 'designated' then 0.8::double when hgv_access in ('destination', 'delivery') or destination then 5.0::double else 1.0::double end * case when detour then 0.9::double else 1.0::double end) * dist * (3.6::double / greatest(least(80, speed), 1)))::bigint + case when hgv_access = 'designated' then 0 when hgv_access in ('destination', 'delivery') or destination then 120 else 0 end end",
        "round(dist * (3.6::double / greatest(least(80, speed), 1)))", "case when node_car then 0 end"),
    "railway": ("case when (railway or railway_penalty) and (forward or not oneway) then dist * case when railway_penalty then case when in_route then 2 else 4 end else 1 end end", "dist", "0"),
    "ferry": ("case when ferry then dist // 10 end", "dist // 10", "0"),
}


def _cost_sql(profile: str) -> str:
    cost, duration, node = _COSTS[profile]
    return f"{_JOINED}, priced as (select way, pos, src, dst, to_pos, forward, dist, ({cost} + {node})::bigint as cost, {_DURATION.format(duration)} as duration from e where {cost} + {node} is not null)"


for _name in _COSTS:
    query(f"cost_{_name}", _cost_sql(_name) + " select * from priced")(lambda n, p=_name: _priced(n, costs.profiles()[p]))


@query("bike_elevation_cost", "select way, pos, (case when way % 40 > 0 then floor(570 * pow((way % 40)::double / dist, 2.1::double)) else 0 end)::bigint as low, (case when way % 40 > 0 then floor(3700 * pow((way % 40)::double / dist, 2.1::double)) else 0 end)::bigint as high from way_nodes where dist > 0")
def _(n):
    up = F.col("way") % 40
    return n.way_nodes.filter("dist > 0").select("way", "pos", costs.climb_cost(570, up, F.col("dist")).alias("low"), costs.climb_cost(3700, up, F.col("dist")).alias("high"))


# search


def _near(n: Network, extra: DataFrame | None = None) -> Network:
    """What the search from the first node can reach: only this is priced."""
    return n.around(n.nodes.agg(F.min("node").alias("node")), extra)


def _starts(n: Network, condition: str) -> DataFrame:
    rows = n.nodes.filter(condition) if condition else n.nodes.agg(F.min("node").alias("node"))
    return rows.select(F.col("node").alias("query"), F.col("node").alias("state"), F.lit(0).cast("long").alias("cost"))


def _search_sql(edge: str, starts: str, extra: str = "", bound: str = "") -> str:
    """Fixpoint of least costs by (query, state) over the table `steps`."""
    return f"""{edge}, steps as materialized (select src, dst, min(cost)::bigint as cost from moves group by all), starts as materialized ({starts}){extra},
r(query, state, cost) using key (query, state) as (
  select query, state, min(cost)::bigint from starts group by all
  union
  select r.query, s.dst, min(r.cost + s.cost)::bigint from r join steps s on r.state = s.src left join recurring.r as b on b.query = r.query and b.state = s.dst
  where true {bound} group by r.query, s.dst having min(r.cost + s.cost) < coalesce(min(b.cost), {LIMIT}))"""


_FIRST = "select min(node) as query, min(node) as state, 0 as cost from nodes"
_MANY = "select node as query, node as state, 0 as cost from nodes where node % 500 = 0"
_FOOT = _cost_sql("foot") + ", moves as (select src, dst, cost from priced)"


@query("sssp_foot", _search_sql(_FOOT, _FIRST) + " select query, state, cost from r")
def _(n):
    n = _near(n)
    return search.search(search.node_states(_priced(n, costs.foot())), _starts(n, ""))


@query("sssp_bike_backward", _search_sql(_cost_sql("bike") + ", moves as (select dst as src, src as dst, cost from priced)", _FIRST) + " select query, state, cost from r")
def _(n):
    n = _near(n)
    return search.search(search.reverse(search.node_states(_priced(n, costs.bike()))), _starts(n, ""))


@query("sssp_blocked", _search_sql(_cost_sql("foot") + ", moves as (select src, dst, cost from priced where dst % 4 <> 1)", _FIRST) + " select query, state, cost from r")
def _(n):
    n = _near(n)
    return search.search(search.without(search.node_states(_priced(n, costs.foot())), n.nodes.filter("node % 4 = 1")), _starts(n, ""))


@query("sssp_bounded", _search_sql(_FOOT, _MANY, bound="and r.cost + s.cost < 30") + " select query, state, cost from r")
def _(n):
    return search.search(search.node_states(_priced(n, costs.foot())), _starts(n, "node % 500 = 0"), max_cost=30)


@query("one_to_many", _search_sql(_FOOT, _MANY) + " select query, state as node, cost from r where state % 3 = 0")
def _(n):
    starts = _starts(n, "node % 500 = 0")
    goals = n.nodes.filter("node % 3 = 0").select(F.col("node").alias("state"))
    found = search.search(search.node_states(_priced(n, costs.foot())), starts, targets=goals)
    return found.filter("state % 3 = 0").select("query", F.col("state").alias("node"), "cost")


@query("point_to_point", _search_sql(_FOOT, _MANY) + " select query, state as target, cost from r where state = query + 7")
def _(n):
    starts = _starts(n, "node % 500 = 0")
    targets = starts.select("query", (F.col("query") + 7).alias("node"))
    return search.one_to_many(search.node_states(_priced(n, costs.foot())), starts, targets).withColumnRenamed("node", "target")


@query("bidirectional_cost", _search_sql(_FOOT, _MANY) + " select query, cost from r where state = query + 11 and cost < 7200")
def _(n):
    pairs = n.nodes.filter("node % 500 = 0").select(F.col("node").alias("query"), F.col("node").alias("source"), (F.col("node") + 11).alias("target"))
    return search.bidirectional(search.node_states(_priced(n, costs.foot())), pairs, 7200)


_CAR_EDGES = _FORBIDDEN + ", " + _cost_sql("car")
_CAR_MOVES = f"""{_CAR_EDGES}, drive as (select *, (way << 21) | (to_pos << 1) | forward::int as id from priced),
moves as (
  select a.id as src, b.id as dst, b.cost + case when a.way = b.way and a.to_pos = b.pos and a.forward <> b.forward then 120 else 0 end as cost
  from drive a join drive b on a.dst = b.src where not exists (select 1 from forbidden f where f.node = b.src and f.from_way = a.way and f.to_way = b.way))"""


@query("sssp_car_turns", _search_sql(_CAR_MOVES, "select src as query, id as state, cost from drive where src = (select min(node) from nodes)") + " select r.query, d.dst as node, min(r.cost) as cost from r join drive d on d.id = r.state group by all")
def _(n):
    profile = costs.car()
    first = n.nodes.agg(F.min("node").alias("node")).select(F.col("node").alias("query"), "node", F.lit(0).cast("long").alias("cost"))
    edges = _kept(_priced(n, profile))
    near = _kept(regions.around(edges, first))  # pairs of edges are far more than edges: only those of the start's region are made
    edges = _kept(edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi"))
    here = Network(n.ways, n.nodes, n.way_nodes.join(near, "node", "left_semi"), n.parts)
    states = search.turn_states(edges, profile, graph.restrictions(_signs(here), here.way_nodes))
    found = search.search(states, search.turn_starts(edges, first))
    return search.by_node(found, edges)


def _kept(df: DataFrame) -> DataFrame:
    from .tables import kept

    return kept(df, "edges")


_PARK = f"""{_JOINED}, walk as (select src, dst, ({_COSTS['foot'][0]} + {_COSTS['foot'][2]})::bigint as cost from e), ride as (select src, dst, ({_COSTS['car'][0]} + {_COSTS['car'][2]})::bigint as cost from e),
moves as (
  select src * 2 as src, dst * 2 as dst, cost from ride where cost is not null
  union all select src * 2 + 1, dst * 2 + 1, cost from walk where cost is not null
  union all select node * 2, node * 2 + 1, 200 from nodes where parking)"""


@query("car_parking_sssp", _search_sql(_PARK, "select min(node) as query, min(node) * 2 as state, 0 as cost from nodes") + " select query, state // 2 as node, state % 2 = 1 as walking, cost from r")
def _(n):
    n = _near(n)
    ride, walk = (search.node_states(_priced(n, p)) for p in (costs.car(), costs.foot()))
    starts = n.nodes.agg(F.min("node").alias("query")).select("query", (F.col("query") * 2).alias("state"), F.lit(0).cast("long").alias("cost"))
    found = modes.parts_of(search.search(modes.ride_then_walk(ride, walk, n.nodes.filter("parking")), starts), 2)
    return found.select("query", "node", (F.col("part") == 1).alias("walking"), "cost")


_SHARE = f"""{_JOINED}, walk as (select src, dst, ({_COSTS['foot'][0]} + {_COSTS['foot'][2]})::bigint as cost from e), ride as (select src, dst, ({_COSTS['bike'][0]} + {_COSTS['bike'][2]})::bigint as cost from e),
moves as (
  select src * 3 as src, dst * 3 as dst, cost from walk where cost is not null
  union all select src * 3 + 1, dst * 3 + 1, cost from ride where cost is not null
  union all select src * 3 + 2, dst * 3 + 2, cost from walk where cost is not null
  union all select node * 3, node * 3 + 1, 30 from nodes where node % 5 = 0
  union all select node * 3 + 1, node * 3 + 2, 30 from nodes where node % 3 = 0)"""


@query("sharing_sssp", _search_sql(_SHARE, "select min(node) as query, min(node) * 3 as state, 0 as cost from nodes") + " select query, state // 3 as node, state % 3 as phase, cost from r")
def _(n):
    n = _near(n)
    walk, ride = _kept(search.node_states(_priced(n, costs.foot()))), search.node_states(_priced(n, costs.bike()))  # walks are of two parts
    edges = modes.shared(walk, ride, n.nodes.filter("node % 5 = 0"), n.nodes.filter("node % 3 = 0"))
    starts = n.nodes.agg(F.min("node").alias("query")).select("query", (F.col("query") * 3).alias("state"), F.lit(0).cast("long").alias("cost"))
    return modes.parts_of(search.search(edges, starts), 3).withColumnRenamed("part", "phase")


_CLOSED = _SHARE.replace("from ride where cost is not null", "from ride where cost is not null and dst % 6 <> 1")
_DROPPED = _PARK.replace("from nodes where parking)", "from nodes)")


@query("sharing_closed_sssp", _search_sql(_CLOSED, "select min(node) as query, min(node) * 3 as state, 0 as cost from nodes") + " select query, state // 3 as node, state % 3 as phase, cost from r")
def _(n):
    n = _near(n)
    walk, ride = _kept(search.node_states(_priced(n, costs.foot()))), search.node_states(_priced(n, costs.bike()))  # walks are of two parts
    edges = modes.shared(walk, ride, n.nodes.filter("node % 5 = 0"), n.nodes.filter("node % 3 = 0"), n.nodes.filter("node % 6 = 1"))
    starts = n.nodes.agg(F.min("node").alias("query")).select("query", (F.col("query") * 3).alias("state"), F.lit(0).cast("long").alias("cost"))
    return modes.parts_of(search.search(edges, starts), 3).withColumnRenamed("part", "phase")


@query("car_dropoff_sssp", _search_sql(_DROPPED, "select min(node) as query, min(node) * 2 as state, 0 as cost from nodes") + " select query, state // 2 as node, state % 2 = 1 as walking, cost from r")
def _(n):
    n = _near(n)
    ride, walk = (search.node_states(_priced(n, p)) for p in (costs.car(), costs.foot()))
    starts = n.nodes.agg(F.min("node").alias("query")).select("query", (F.col("query") * 2).alias("state"), F.lit(0).cast("long").alias("cost"))
    found = modes.parts_of(search.search(modes.ride_then_walk(ride, walk, n.nodes), starts), 2)
    return found.select("query", "node", (F.col("part") == 1).alias("walking"), "cost")


@query("virtual_edges_sssp", _search_sql(_cost_sql("foot") + ", moves as (select src, dst, cost from priced union all select node, node + 13, 5 from nodes where node % 50 = 1)", _FIRST) + " select query, state, cost from r")
def _(n):
    extra = n.nodes.filter("node % 50 = 1").select(F.col("node").alias("src"), (F.col("node") + 13).alias("dst"), F.lit(5).alias("cost"))
    n = _near(n, extra)
    extra = extra.join(n.nodes.select(F.col("node").alias("src")), "src", "left_semi")
    return search.search(modes.with_extra(search.node_states(_priced(n, costs.foot())), extra), _starts(n, ""))


# Codes of levels: none, ground and four quarters of a level apart; lifts stop at two levels of their own.
_LEVEL_WAYS = "lw as (select way, case when way % 4 = 0 then 0 else 33 + way % 3 * 4 end as fl, case when way % 4 = 0 then 0 else 33 + (way % 3 + case when steps or way % 19 = 0 then 1 else 0 end) * 4 end as tl, steps or way % 19 = 0 as swaps, case when way % 53 = 0 then (select min(w.node) from way_nodes w where w.way = ways.way) end as first from ways)"
_LIFTS = "lifts as (select node, [33 + level * 4, 33 + (level + 1) * 4] as stops from nodes where elevator)"
_SERVES = "({l} is not null and ({c} = 0 or coalesce(list_contains({l}, {c}), false)))"
_LEVEL_MOVES = f"""{_cost_sql('foot')}, {_LEVEL_WAYS}, {_LIFTS},
le as (select p.src, p.dst, p.cost, lw.*, f.stops as way_lift, s.stops as src_lift, d.stops as dst_lift from priced p join lw using (way) left join lifts f on f.node = lw.first left join lifts s on s.node = p.src left join lifts d on d.node = p.dst),
stands as (select distinct src as node, unnest([fl, tl, 0]) as lvl from le union select node, unnest(stops) from lifts),
told as (select le.*, lvl, case when swaps then case when fl = 0 and tl = 0 then 0 when lvl = 0 then case when fl = 33 then tl else fl end when fl = lvl then tl when tl = lvl then fl end
  else case when {_SERVES.format(l='way_lift', c='lvl')} then lvl when {_SERVES.format(l='src_lift', c='fl')} and {_SERVES.format(l='src_lift', c='lvl')} then fl when fl = lvl or fl = 0 or lvl = 0 then fl end end as after from le join stands on stands.node = le.src),
spread as (select src, dst, cost, lvl, unnest(case when {_SERVES.format(l='dst_lift', c='lvl')} then dst_lift else [after] end) as target from told),
moves as (select src * 64 + lvl as src, dst * 64 + target as dst, cost from spread where target is not null)"""


@query("sssp_foot_levels", _search_sql(_LEVEL_MOVES, "select min(node) as query, min(node) * 64 + 33 as state, 0 as cost from nodes") + " select query, state // 64 as node, state % 64 as level, cost from r")
def _(n):
    flights = F.expr("steps or way % 19 = 0")
    first = n.way_nodes.groupBy("way").agg(F.min("node").alias("first"))
    code = lambda more: F.when(F.col("way") % 4 == 0, 0).otherwise(33 + (F.col("way") % 3 + more) * 4).cast("int")
    ways = n.ways.join(first, "way").select("way", code(F.lit(0)).alias("from_level"), code(flights.cast("int")).alias("to_level"), flights.alias("swaps"), F.when(F.col("way") % 53 == 0, F.col("first")).alias("first"))
    lifts = n.nodes.filter("elevator").select("node", F.array(33 + F.col("level") * 4, 33 + (F.col("level") + 1) * 4).cast("array<int>").alias("stops"))
    starts = n.nodes.agg(F.min("node").alias("query")).select("query", (F.col("query") * levels.CODES + levels.GROUND).alias("state"), F.lit(0).cast("long").alias("cost"))
    priced = _kept(_priced(n, costs.foot()))
    near = _kept(regions.around(priced, starts.select(F.col("query").alias("node"))))  # levels make many states of an edge: only those of the start's region are made
    priced = priced.join(near.withColumnRenamed("node", "src"), "src", "left_semi")
    found = search.search(levels.level_states(priced, ways, lifts.join(near, "node", "left_semi")), starts)
    return found.select("query", F.floor(F.col("state") / levels.CODES).alias("node"), (F.col("state") % levels.CODES).alias("level"), "cost")


# paths


_PATH = _search_sql(_FOOT, _MANY)


@query("path_totals", _PATH + " select query, state as target, cost from r where state % 100 = 3 and state <> query")
def _(n):
    priced = _kept(_priced(n, costs.foot()))
    goals = n.nodes.filter("node % 100 = 3").select(F.col("node").alias("state"))
    labels = _kept(search.search(search.node_states(priced), _starts(n, "node % 500 = 0"), targets=goals, came=True))
    targets = labels.filter("state % 100 = 3 and state <> query").select("query", F.col("state").alias("node"))
    found = paths.totals(paths.segments(paths.chain(labels, targets), priced))
    return found.select("query", "target", "cost")


@query("path_geojson")
def _(n):
    priced = _kept(_priced(n, costs.foot()))
    goals = n.nodes.filter("node % 100 = 3").select(F.col("node").alias("state"))
    labels = _kept(search.search(search.node_states(priced), _starts(n, "node % 500 = 0"), targets=goals, came=True))
    targets = labels.filter("state % 100 = 3 and state <> query").select("query", F.col("state").alias("node"))
    return paths.geojson(paths.segments(paths.chain(labels, targets), priced), n.nodes)


# lookup

_SEGMENTS = "pieces as (select s.way, s.pos, s.a, s.b, s.dist, p.lat as lat_a, p.lng as lng_a, q.lat as lat_b, q.lng as lng_b from segments s join nodes p on p.node = s.a join nodes q on q.node = s.b where s.b is not null and s.way % 20 = 0)"
_POINTS = "points as (select event_id as point, 48.0::double + (event_id % 1000) * 0.001::double + 0.0003::double as lat, 9.0::double + (event_id % 3) * 0.001::double as lng from events where event_id % 400 = 0)"
_M = repr(scalars.METRES_A_DEGREE) + "::double"
_NEAR = f"""{_SEGMENTS}, {_POINTS},
flat as (select point, way, pos, a, b, dist, (lng_a - lng) * cos(radians(lat)) * {_M} as ax, (lat_a - lat) * {_M} as ay, (lng_b - lng) * cos(radians(lat)) * {_M} as bx, (lat_b - lat) * {_M} as by_ from points, pieces),
along as (select *, (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) as l from flat),
placed as (select *, case when l = 0 then 0.0::double else greatest(0.0::double, least(1.0::double, -(ax * (bx - ax) + ay * (by_ - ay)) / l)) end as t from along),
measured as (select point, way, pos, a, b, dist, t, sqrt((ax + t * (bx - ax)) * (ax + t * (bx - ax)) + (ay + t * (by_ - ay)) * (ay + t * (by_ - ay))) as distance from placed),
near as (select point, way, min(distance) as distance, arg_min(struct_pack(pos := pos, t := t, a := a, b := b, dist := dist), (distance, pos)) as s from measured where distance <= {{radius}} group by point, way),
ranked as (select *, row_number() over (partition by point order by round(distance, 6), way) as rank from near)"""


def _points(n: Network, spark: SparkSession, sf_dir: str, each: int = 400) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").filter(f"event_id % {each} = 0").select(F.col("event_id").alias("point"), F.expr("48.0d + (event_id % 1000) * 0.001d + 0.0003d").alias("lat"), F.expr("9.0d + (event_id % 3) * 0.001d").alias("lng"))


def _segments(n: Network) -> DataFrame:
    return lookup.way_segments(n.way_nodes.filter("way % 20 = 0"), n.nodes)


def _nearest(spark, sf_dir):
    n = network(spark, sf_dir)
    found = lookup.candidates(_points(n, spark, sf_dir, 50), lookup.way_segments(n.way_nodes, n.nodes), 500.0, most=5)
    return found.select("point", "way", "rank", F.round("distance", 3).alias("distance"))


QUERIES["nearest_way_topk"] = _nearest
SQL["nearest_way_topk"] = f"with recursive {NETWORK_SQL}, {_NEAR.format(radius=500).replace(' and s.way % 20 = 0', '').replace('event_id % 400 = 0', 'event_id % 50 = 0')} select point, way, rank, round(distance, 3) as distance from ranked where rank <= 5"


def _match_sides(spark, sf_dir):
    n = network(spark, sf_dir)
    found = lookup.sides(lookup.candidates(_points(n, spark, sf_dir), _segments(n), 200.0, most=1))
    return found.select("point", "way", "left_node", F.round("left_dist", 3).alias("left_dist"), "right_node", F.round("right_dist", 3).alias("right_dist"))


QUERIES["match_left_right"] = _match_sides
SQL["match_left_right"] = f"with recursive {NETWORK_SQL}, {_NEAR.format(radius=200)} select point, way, s.a as left_node, round(distance + s.t * s.dist, 3) as left_dist, s.b as right_node, round(distance + (1 - s.t) * s.dist, 3) as right_dist from ranked where rank = 1"


def _radius_doubling(spark, sf_dir):
    n = network(spark, sf_dir)
    found = lookup.match(_points(n, spark, sf_dir), _segments(n).filter("way % 400 = 0"), 50.0)
    return found.groupBy("point").agg(F.max("need").alias("need"), F.count(F.lit(1)).alias("ways"))


QUERIES["radius_doubling"] = _radius_doubling
SQL["radius_doubling"] = f"with recursive {NETWORK_SQL}, {_NEAR.format(radius=800)}, d as (select point, distance, greatest(ceil(log2(greatest(distance / 50.0::double, 1e-9::double))), 0)::int as doubling from near where way % 400 = 0), m as (select point, min(doubling) as need from d group by point) select point, need, count(*) as ways from d join m using (point) where doubling <= need group by all"


@query("bbox_ways", "pieces as (select s.way, p.lat as lat_a, p.lng as lng_a, q.lat as lat_b, q.lng as lng_b from segments s join nodes p on p.node = s.a join nodes q on q.node = s.b where s.b is not null) select way from pieces group by way having min(least(lat_a, lat_b)) <= 48.1 and max(greatest(lat_a, lat_b)) >= 48.0 and min(least(lng_a, lng_b)) <= 9.0 and max(greatest(lng_a, lng_b)) >= 9.0")
def _(n):
    return lookup.ways_in_box(lookup.way_segments(n.way_nodes, n.nodes), 48.0, 48.1, 9.0, 9.0)


@query("levels_in_bbox", "select distinct level from nodes where lat between 48.1 and 48.3 and lng between 9.0 and 9.5")
def _(n):
    return lookup.levels(lookup.nodes_in_box(n.nodes, 48.1, 48.3, 9.0, 9.5))


@query("elevators_in_bbox", "select node, level from nodes where elevator and lat between 48.1 and 48.3 and lng between 9.0 and 9.5")
def _(n):
    return lookup.nodes_in_box(n.nodes.filter("elevator"), 48.1, 48.3, 9.0, 9.5).select("node", "level")


# matching

_TRACE = "trace as (select user_id as trace, row_number() over (partition by user_id order by ts, event_id) - 1 as seq, event_id % (select count(*) from part) as point from events)"


def _trace(spark, sf_dir, users="user_id is not null"):
    from pyspark.sql import Window

    n = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").filter(users).select(F.col("user_id").alias("trace"), (F.row_number().over(order) - 1).cast("long").alias("seq"), (F.col("event_id") % n).alias("point"))


QUERIES["trace_pairs"] = lambda spark, sf_dir: matching.trace_pairs(_trace(spark, sf_dir))
SQL["trace_pairs"] = f"with {_TRACE}, p as (select trace, seq as segment, point as \"from\", lead(point) over (partition by trace order by seq) as \"to\" from trace) select * from p where \"to\" is not null"

_CANDIDATES = "cands as (select trace, seq, c as candidate, abs(point * 7 + c * 13) % 40 as distance from trace, range(3) t(c))"


def _candidates(spark, sf_dir, users="user_id is not null"):
    rows = _trace(spark, sf_dir, users).withColumn("candidate", F.explode(F.array(*[F.lit(c).cast("long") for c in range(3)])))
    return rows.select("trace", "seq", "point", "candidate", (F.abs(F.col("point") * 7 + F.col("candidate") * 13) % 40).alias("distance"))


QUERIES["emission_penalty"] = lambda spark, sf_dir: matching.emission(_candidates(spark, sf_dir), 4.0).select("trace", "seq", "candidate", "penalty")
SQL["emission_penalty"] = f"with {_TRACE}, {_CANDIDATES} select trace, seq, candidate, round((distance / 4.0::double) * (distance / 4.0::double))::bigint + case when row_number() over (partition by trace, seq order by distance, candidate) = 1 then 0 else 30 end as penalty from cands"


def _viterbi(spark, sf_dir):
    states = matching.emission(_candidates(spark, sf_dir), 4.0).select("trace", "seq", "candidate", "penalty")
    moves = states.select("trace", "seq", "candidate").join(states.select("trace", (F.col("seq") - 1).alias("seq"), F.col("candidate").alias("next")), ["trace", "seq"])
    moves = moves.withColumn("cost", (F.col("trace") + F.col("candidate") * 5 + F.col("next") * 3 + F.col("seq")) % 17).filter("(trace + seq) % 11 <> 0")
    return matching.viterbi(states, moves)


QUERIES["viterbi_match"] = _viterbi
# A step holds the three candidates' costs and paths so far; of equal costs the least candidate is the one before.
_REACH = "list_min([struct_pack(c := costs[1] + {m0}, k := 0), struct_pack(c := costs[2] + {m1}, k := 1), struct_pack(c := costs[3] + {m2}, k := 2)])"
_MOVE = "(r.trace + {c} * 5 + {n} * 3 + r.seq) % 17"
_BEST = "list_min([struct_pack(c := costs[1], k := 0), struct_pack(c := costs[2], k := 1), struct_pack(c := costs[3], k := 2)])"
_INTO = ", ".join(f"case when (r.trace + r.seq) % 11 <> 0 then {_REACH.format(**{f'm{c}': _MOVE.format(c=c, n=n) for c in range(3)})} else {_BEST} end as b{n}" for n in range(3))
SQL["viterbi_match"] = f"""with recursive {_TRACE}, {_CANDIDATES},
scored as (select trace, seq, candidate, round((distance / 4.0::double) * (distance / 4.0::double))::bigint + case when row_number() over (partition by trace, seq order by distance, candidate) = 1 then 0 else 30 end as penalty from cands),
points as materialized (select trace, seq, list(penalty order by candidate) as p from scored group by trace, seq),
r(trace, seq, costs, paths) as (
  select trace, seq, p, [[0], [1], [2]] from points where seq = 0
  union all
  select trace, seq, [b0.c + p[1], b1.c + p[2], b2.c + p[3]], [list_append(paths[b0.k + 1], 0), list_append(paths[b1.k + 1], 1), list_append(paths[b2.k + 1], 2)]
  from (select r.trace, n.seq, n.p, r.paths, {_INTO} from r join points n on n.trace = r.trace and n.seq = r.seq + 1)),
ends as (select *, {_BEST} as b from r where (trace, seq) in (select trace, max(seq) from points group by trace))
select trace, unnest(range(seq + 1)) as seq, unnest(paths[b.k + 1]) as candidate from ends"""


def _quantiles(spark, sf_dir):
    """The values at fixed shares of the sorted list, as percentile ranks without a list: counts of values, then running sums."""
    values = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_totalprice").alias("value"))
    return matching.quantiles(values, {f"q{int(q * 100)}": q for q in (0.1, 0.5, 0.9, 0.99)})


QUERIES["query_quantiles"] = _quantiles
SQL["query_quantiles"] = "select " + ", ".join(f"quantile_disc(o_totalprice, {q}) as q{int(q * 100)}" for q in (0.1, 0.5, 0.9, 0.99)) + " from orders"
