"""From tags to routes on small networks, trips of several parts, levels, stored tables, and what search and paths must keep."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.functions import conditional, costs, names
from roadloom.operators import extract, graph, levels, matching, modes, paths, search
from roadloom.plans.network import Network
from roadloom.sources import osm_pbf, store

#: Node: place. Ways 10 and 20 both lead from 2 to 3, 20 by a detour over 5.
PLACES = {1: (48.0, 9.0), 2: (48.0, 9.001), 3: (48.0, 9.009), 4: (48.0, 9.01), 5: (48.0003, 9.005)}


def tables(spark, tags10=None, tags20=None, relations=None):
    road = {"highway": "primary"}
    fast = road | {"maxspeed": "80"}
    ways = [(1, [1, 2], road), (2, [3, 4], road), (10, [2, 3], fast | (tags10 or {})), (20, [2, 5, 3], fast | (tags20 or {}))]
    nodes = spark.createDataFrame([(n, *at, {}) for n, at in PLACES.items()], "node long, lat double, lng double, tags map<string,string>")
    related = spark.createDataFrame(relations, "relation long, members array<struct<type:string,ref:bigint,role:string>>, tags map<string,string>") if relations else None
    # ends of ways are graph nodes as well: a way of one piece each marks them
    ways += [(30, [1, 1], {"highway": "footway"}), (40, [4, 4], {"highway": "footway"})]
    return extract.extract(nodes, spark.createDataFrame(ways, "way long, refs array<bigint>, tags map<string,string>"), related)


def route(spark, found, profile, source=1, target=4):
    """The ways from source to target, or None."""
    network = Network(found["ways"], found["nodes"], found["way_nodes"])
    priced = costs.priced(network.edges, found["ways"], found["nodes"], profile)
    starts = spark.createDataFrame([(0, source, 0)], "query long, state long, cost long")
    labels = search.predecessors(search.search(search.node_states(priced), starts), priced)
    steps = paths.segments(paths.chain(labels, spark.createDataFrame([(0, target)], "query long, node long")), priced)
    return [r.way for r in steps.orderBy(F.desc("back")).collect()] or None


@pytest.mark.parametrize(
    ("tags", "profile", "forward", "backward"),
    [
        ({}, "car", 10, 10),
        ({"oneway": "-1"}, "car", 20, 10),
        ({"oneway": "-1"}, "hgv", 20, 10),
        ({"hgv:forward": "no", "hgv:backward": "yes"}, "hgv", 20, 10),
        ({"maxheight": "2.5"}, "tall", 20, 20),
        ({"hazmat": "no"}, "hazmat", 20, 20),
    ],
)
def test_two_routes(spark, tags, profile, forward, backward):
    own = {"tall": costs.hgv(costs.Truck(height_cm=400)), "hazmat": costs.hgv(costs.Truck(hazmat=True))}
    found = tables(spark, tags)
    p = own.get(profile) or costs.profiles()[profile]
    assert route(spark, found, p) == [1, forward, 2] and route(spark, found, p, 4, 1) == [2, backward, 1]


def test_every_profile_prices_an_extracted_network(spark):
    found = tables(spark, {"hgv": "designated", "maxspeed:hgv": "60"})
    edges = Network(found["ways"], found["nodes"], found["way_nodes"]).edges
    many = {n: costs.priced(edges, found["ways"], found["nodes"], p).count() for n, p in costs.profiles().items()}
    assert many["car"] == many["bike"] == many["bus"] == many["hgv"] == 8 and many["ferry"] == many["railway"] == 0


def test_detour_relation_draws_trucks(spark):
    found = tables(spark, {"access": "private"}, relations=[(7, [("way", 20, "")], {"type": "route", "route": "detour"})])
    assert found["ways"].filter("way = 20").first().detour and route(spark, found, costs.hgv()) == [1, 20, 2]


def test_stored_network(spark, tmp_path):
    found = {k: v for k, v in tables(spark).items()}
    store.save(found, str(tmp_path))
    again = store.load(spark, str(tmp_path), "ways", "nodes", "way_nodes")
    assert route(spark, found | again, costs.car()) == [1, 10, 2] and sorted(again) == ["nodes", "way_nodes", "ways"]


def test_unknown_zone_is_ignored(spark):
    at = F.lit("2024-06-03 10:00:00").cast("timestamp")
    got = spark.range(1).select(*[conditional.wall_time(at, F.lit(z)).cast("string").alias(n) for n, z in (("a", "Nowhere/Atall"), ("b", None), ("c", "Europe/Berlin"))]).first()
    assert got.a == got.b == "2024-06-03 10:00:00" and got.c == "2024-06-03 12:00:00"


def test_conditions_as_columns(spark):
    clauses = conditional.parse_tag("hgv:conditional", "no @ (weight>7.5 and Mo-Fr 06:00-10:00); yes @ (trailer)")
    rows = [("2024-06-03 07:00:00", 80, False, "no"), ("2024-06-03 07:00:00", 75, False, "open"), ("2024-06-08 07:00:00", 80, False, "open"), ("2024-06-03 07:00:00", 80, True, "yes"), (None, 80, False, "open")]
    table = spark.createDataFrame(rows, "at string, w int, t boolean, want string").withColumn("at", F.col("at").cast("timestamp"))
    got = table.select("want", conditional.conditional_value(clauses, F.col("at"), {"weight": F.col("w"), "trailer": F.col("t")}, F.lit("open")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_polyline_bearings(spark):
    points = [(1, 0, 1, 48.0, 9.0), (1, 1, 2, 48.0, 9.0), (1, 2, 3, 48.1, 9.0), (1, 3, 4, 48.1, 9.1)]
    shape = spark.createDataFrame(points, "way long, seq long, node long, lat double, lng double")
    kept = spark.createDataFrame([(1, 0, 1, 0), (1, 1, 2, 1), (1, 2, 4, 3)], "way long, pos long, node long, seq long")
    got = {r.node: (r.to_prev, r.to_next) for r in graph.polyline_bearings(shape, kept).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 4: (192, 0)}


def test_components_by_union_find(spark):
    rng = np.random.default_rng(2)
    rows = [(int(w), int(n)) for w in range(300) for n in rng.integers(0, 420, rng.integers(1, 3))] + [(1000 + k, 5000 + k + j) for k in range(60) for j in (0, 1)]
    root = {w: w for w, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    at = {}
    for w, n in rows:
        a, b = sorted((top(w), top(at.setdefault(n, w))))
        root[b] = a
    got = {r.way: r.component for r in graph.components(spark.createDataFrame(rows, "way long, node long")).collect()}
    assert got == {w: top(w) for w in root}


def test_targets_end_a_search(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(0, 80, 400), rng.integers(0, 80, 400), rng.integers(1, 30, 400), strict=True)]
    table = spark.createDataFrame(edges, "src long, dst long, cost long")
    starts = spark.createDataFrame([(q, q, 0) for q in (0, 1, 2)], "query long, state long, cost long")
    whole = {(r.query, r.state): r.cost for r in search.search(table, starts).collect()}
    best = {0: 0}
    for _ in range(80):
        for a, b, c in edges:
            if a in best and best[a] + c < best.get(b, 10**9):
                best[b] = best[a] + c
    assert {s: c for (q, s), c in whole.items() if q == 0} == best
    wanted = [(q, t) for q in (0, 1, 2) for t in (5, 40, 79)] + [(0, 999)]
    got = search.one_to_many(table, starts, spark.createDataFrame(wanted, "query long, node long")).collect()
    assert {(r.query, r.node): r.cost for r in got} == {k: whole[k] for k in wanted if k in whole}


def test_chain_of_a_long_path(spark):
    labels = spark.createDataFrame([(0, k, 3 * k, max(k - 1, 0)) for k in range(101)], "query long, state long, cost long, pred long")
    steps = paths.chain(labels, spark.createDataFrame([(0, 100), (0, 1), (0, 0), (0, 777)], "query long, node long")).collect()
    assert sorted((r.back, r.src, r.dst) for r in steps if r.target == 100) == [(k, 99 - k, 100 - k) for k in range(100)]
    assert [(r.src, r.dst) for r in steps if r.target == 1] == [(0, 1)] and len(steps) == 101


def test_levels(spark):
    """Ground 33, first floor 37: steps 5 lead up from 1 to 2, a lift stands at 3, way 8 is on the first floor."""
    edges = spark.createDataFrame([(5, 1, 2, 10), (8, 2, 4, 10), (8, 1, 4, 10), (9, 1, 3, 10), (8, 3, 4, 10)], "way long, src long, dst long, cost long")
    ways = spark.createDataFrame([(5, 33, 37, True, None), (8, 37, 37, False, None), (9, 33, 33, False, None)], "way long, from_level int, to_level int, swaps boolean, first long")
    lifts = spark.createDataFrame([(3, [33, 37])], "node long, stops array<int>")
    starts = spark.createDataFrame([(0, 1 * 64 + 33, 0)], "query long, state long, cost long")
    got = {divmod(r.state, 64): r.cost for r in search.search(levels.level_states(edges, ways, lifts), starts).collect()}
    assert got == {(1, 33): 0, (2, 37): 10, (4, 37): 20, (3, 33): 10, (3, 37): 10}


def test_trip_of_three_parts(spark):
    line = lambda cost: spark.createDataFrame([(k, k + 1, cost) for k in range(10)], "src long, dst long, cost long")
    at = lambda *ns: spark.createDataFrame([(n,) for n in ns], "node long")
    starts = spark.createDataFrame([(0, 0, 0)], "query long, state long, cost long")
    cost = lambda edges, parts, node, part: modes.parts_of(search.search(edges, starts), parts).filter((F.col("node") == node) & (F.col("part") == part)).select(F.min("cost")).first()[0]
    assert cost(modes.shared(line(100), line(10), at(2), at(7)), 3, 10, 2) == 200 + 30 + 50 + 30 + 300
    assert cost(modes.shared(line(100), line(10), at(2), at(7), at(5)), 3, 10, 2) is None
    assert cost(modes.ride_then_walk(line(10), line(100), at(7)), 2, 10, 1) == 70 + 200 + 300
    assert cost(modes.part(modes.with_extra(line(10), spark.createDataFrame([(0, 9, 1)], "src long, dst long, cost int")), 0, 1), 1, 10, 0) == 11


def test_viterbi_by_brute_force(spark):
    from itertools import product

    rng = np.random.default_rng(7)
    states = [(t, s, c, int(rng.integers(0, 50))) for t in range(4) for s in range(5) for c in range(3)]
    moves = [(t, s, a, b, int(rng.integers(0, 40))) for t in range(4) for s in range(4) for a in range(3) for b in range(3) if rng.random() < 0.6 and (t, s) != (2, 1)]
    price, step = {(t, s, c): p for t, s, c, p in states}, {(t, s, a, b): c for t, s, a, b, c in moves}
    got = {}
    for r in matching.viterbi(spark.createDataFrame(states, "trace long, seq long, candidate long, penalty long"), spark.createDataFrame(moves, "trace long, seq long, candidate long, next long, cost long")).collect():
        got.setdefault(r.trace, {})[r.seq] = r.candidate

    def cost(t, path):
        total = price[t, 0, path[0]]
        for s in range(4):
            if (t, s) != (2, 1) and (t, s, path[s], path[s + 1]) not in step:
                return None
            total += step.get((t, s, path[s], path[s + 1]), 0) + price[t, s + 1, path[s + 1]]
        return total

    for t in range(4):
        best = min(c for c in (cost(t, p) for p in product(range(3), repeat=5)) if c is not None)
        assert cost(t, [got[t][s] for s in range(5)]) == best


def test_packed_numbers():
    values = [0, 1, 127, 128, 300, 2**31, 2**62, 5]
    data = b"".join(bytes([*(v >> 7 * k & 127 | 128 for k in range(max((v.bit_length() - 1) // 7, 0))), v >> 7 * max((v.bit_length() - 1) // 7, 0)]) for v in values)
    assert osm_pbf.packed(data) == values and osm_pbf.packed(data, True) == [(v >> 1) ^ -(v & 1) for v in values] and osm_pbf.packed(b"") == []
    assert osm_pbf.summed([3, -1, 2**40]) == [3, 2, 2 + 2**40]


def test_id_codes(spark):
    ids = [0, 5, -1, -7, 2**45, -(2**45)]
    got = spark.createDataFrame([(i,) for i in ids], "id long").select("id", names.id_code(F.col("id")).alias("c"), names.id_of_code(names.id_code(F.col("id"))).alias("b")).collect()
    assert all(r.b == r.id and r.c % (1 << 64) == names.encode_id(r.id) for r in got)


def test_regions_equal_supersteps(spark, monkeypatch):
    """Searches in memory, by supersteps and where a region is too large for a task agree, also in predecessors and targets."""
    rng = np.random.default_rng(5)
    rows = [(int(a) + part * 1000, int(b) + part * 1000, int(c)) for part in range(3) for a, b, c in zip(rng.integers(0, 60, 150), rng.integers(0, 60, 150), rng.integers(0, 9, 150), strict=True)]
    edges = spark.createDataFrame(rows, "src long, dst long, cost long")
    starts = spark.createDataFrame([(1, 5, 0), (1, 1007, 4), (1, 9, 3), (2, 11, 0), (3, 2030, 2), (4, 77777, 1), (5, 77777, 99)], "query long, state long, cost long")
    told = lambda found, *more: sorted((r.query, r.state, r.cost, *(r[m] for m in more)) for r in found.collect())
    want = told(search.supersteps(edges, starts))
    assert {q for q, *_ in want} == {1, 2, 3, 4, 5} and told(search.search(edges, starts)) == want
    assert told(search.search(edges, starts, 12)) == told(search.supersteps(edges, starts, 12))
    back = told(search.predecessors(search.supersteps(edges, starts), edges), "pred")
    assert told(search.search(edges, starts, came=True), "pred") == back
    goals = spark.createDataFrame([(s,) for s in (20, 1020, 2020, 77777)], "state long")
    some = told(search.search(edges, starts, targets=goals))
    assert [r for r in some if r[1] in (20, 1020, 2020)] == [r for r in want if r[1] in (20, 1020, 2020)] and len(some) < 12
    paths_to = told(search.search(edges, starts, targets=goals, came=True), "pred")
    assert set(paths_to) <= set(back) and {(q, p) for q, _, _, p in paths_to} <= {(q, s) for q, s, _, _ in paths_to}
    pairs = spark.createDataFrame([(7, 5, 20), (8, 5, 1020), (9, 1007, 1020), (10, 77777, 77777)], "query long, source long, target long")
    met = sorted(map(tuple, search.bidirectional(edges, pairs, 1000).collect()))
    monkeypatch.setattr(search.regions, "MOST", 100)
    assert told(search.search(edges, starts)) == want and told(search.search(edges, starts, came=True), "pred") == back
    assert sorted(map(tuple, search.bidirectional(edges, pairs, 1000).collect())) == met


def test_rounds_do_not_follow_a_path(spark):
    line = spark.createDataFrame([(k, k + 1, 1) for k in range(400)], "src long, dst long, cost long")
    starts = spark.createDataFrame([(0, 0, 0)], "query long, state long, cost long")
    spark.sparkContext.setJobGroup("line", "line")
    assert search.search(line, starts).agg(F.max("cost")).first()[0] == 400
    spark.sparkContext.setJobGroup("other", "other")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("line")) < 40


def test_chunks_are_linked(spark):
    from roadloom.operators import regions

    pairs = spark.createDataFrame([(w, (w * 7) % 90) for w in range(300)] + [(w, 1000 + w // 2) for w in range(200)], "way long, node long").repartition(3)
    for few in (regions.FEW, 0):
        got = {r.id: r.region for r in regions.regions(pairs, False, 40, few).filter("kind = 0").collect()}
        want = {r.id: r.region for r in regions.regions(pairs.coalesce(1), False).filter("kind = 0").collect()}
        assert got == want and len(got) == 300 and set(want.values()) < set(want)


def test_angles_are_dealt_to_as_many_partitions_as_asked_for(spark):
    import re

    rows = [(w, p, (w * 3 + p * 5) % 11, 48 + (w * 3 + p * 5) % 11 / 100, 9 + p % 2 / 100) for w in range(9) for p in range(6)]
    shape = spark.createDataFrame(rows, "way long, seq long, node long, lat double, lng double")
    crossings = shape.filter("node % 2 = 0").select("node").distinct()

    def found(parts):
        angles = graph.polyline_bearings(shape, graph.connected_way_nodes(shape, crossings, parts), parts)
        passes = graph.dealt(angles.select("way", "pos", "node", F.lit(1).alias("dist")), parts, "way")
        return graph.turns(Network(None, None, passes).edges, angles, parts)

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = found(7)._jdf.queryExecution().executedPlan().toString()
        dealt = [keys for keys, many in re.findall(r"hashpartitioning\((.*?), (\d+)\)", plan) if many != "7"]
        assert {re.sub(r"#.*", "", keys) for keys in dealt} <= {"node"}  # the crossings themselves
        assert sorted(map(tuple, found(7).collect())) == sorted(map(tuple, found(None).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_edges_of_a_node_lie_in_lists(spark):
    from roadloom.operators import regions

    rows = [(0, k % 500, k % 7) for k in range(1000)] + [(k, k + 1, 2) for k in range(1, 400)]
    found = regions.split(spark.createDataFrame(rows, "src long, dst long, cost long"), spark.createDataFrame([(1, 0, 0)], "query long, state long, cost long"))
    edges = found.groups.filter("kind = 0")
    lists = edges.selectExpr("src", "size(dst) as many", "size(step) as steps").collect()
    assert all(r.many == r.steps <= regions.PACKED for r in lists) and len(lists) < 500
    assert sorted(map(tuple, edges.selectExpr("src", "inline(arrays_zip(dst, step))").collect())) == sorted(rows)


@pytest.mark.parametrize("most", [None, 9, 25])
def test_sides_meet_at_the_least_cost(most):
    """In memory: targets of queries, met from both sides or from one, have the costs of the whole search."""
    import pyarrow as pa

    from roadloom.operators import regions

    rng = np.random.default_rng(8)
    src, dst, step = rng.integers(0, 70, 260), rng.integers(0, 70, 260), rng.integers(0, 9, 260)
    names = ["kind", "query", "src", "dst", "step"]
    listed = lambda values: pa.array([[int(v)] for v in values], pa.list_(pa.int64()))

    def rows(kind, query, start, ends, costs):
        whole = lambda v: pa.array([None if x is None else int(x) for x in v], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(ends), pa.int32()), whole(query), whole(start), listed(ends), listed(costs)], names)

    none = lambda n: [None] * n
    given = [rows(0, none(260), src, dst, step), rows(1, range(12), none(12), range(12), [k % 3 for k in range(12)])]
    told = lambda more, **how: {(q, s): c for b in regions._walk(**{"max_cost": most, "came": False, "chosen": False, "two": False} | how)(iter(given + more)) for q, s, c in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)}
    whole = told([])
    assert len(whole) > 12
    one, several = [(q, (q * 5 + 3) % 75) for q in range(12)], [(q, (q * 5 + k) % 75) for q in range(9) for k in (3, 40, 66)]
    for pairs in (one, several):
        goals = [rows(2, [q for q, _ in pairs], none(len(pairs)), [t for _, t in pairs], [0] * len(pairs))]
        want = {p: whole[p] for p in pairs if p in whole}
        assert told(goals, chosen=True) == want
        met = {q: c for (q, _), c in told(goals, chosen=True, two=True).items()}
        assert met == {q: min(c for (p, _), c in want.items() if p == q) for q in {p for p, _ in want}}
