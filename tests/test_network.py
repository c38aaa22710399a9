"""Scalar golden values, small inline graphs, and invariants of the operators."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from roadloom.functions import access, conditional, costs, scalars
from roadloom.operators import elevation, extract, graph, lookup, matching, paths, platforms, search
from roadloom.sources import osm_pbf, osm_xml, rasters


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def way(spark, **properties):
    """An edge of a way with these properties, as one row."""
    row = {"dist": 1, "forward": True, "foot": False, "bike": False, "car": False, "bus": False, "bus_penalty": False, "railway": False, "railway_penalty": False, "ferry": False, "sidewalk_separate": False, "steps": False, "big_street": False, "motor_vehicle_no": False, "oneway": False, "destination": False, "in_route": False, "parking": False, "speed": 10, "hgv_access": None, "maxweight_100kg": None, "lez": False, "detour": False} | properties
    kinds = {"dist": "long", "speed": "int", "hgv_access": "string", "maxweight_100kg": "int"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'boolean')}" for k in row))


@pytest.mark.parametrize(("flags", "cost"), [((0, 0, 0), None), ((0, 0, 1), None), ((0, 1, 0), 91), ((0, 1, 1), 136), ((1, 0, 0), 1), ((1, 0, 1), 46), ((1, 1, 0), 1), ((1, 1, 1), 46)])
def test_foot_cost(spark, flags, cost):
    foot, bike, separate = map(bool, flags)
    assert way(spark, foot=foot, bike=bike, sidewalk_separate=separate).select(costs.foot().cost).first()[0] == cost


@pytest.mark.parametrize(("sign", "cost"), [("yes", 45), ("designated", 36), ("delivery", 345), ("destination", 345), ("no", None)])
def test_truck_cost(spark, sign, cost):
    assert way(spark, dist=1000, speed=80, hgv_access=sign).select(costs.hgv().cost).first()[0] == cost


def test_truck_zone(spark):
    rows = way(spark, dist=1000, speed=80, hgv_access="yes", lez=True)
    assert rows.select(costs.hgv().cost).first()[0] is None and rows.select(costs.hgv(costs.Truck(lez_access=True)).cost).first()[0] == 45


def test_levels(spark):
    got = one(spark, *[scalars.level_value(scalars.level_code(F.lit(v).cast("double"))) for v in (0.1, -4, 4, -3, None)])
    assert tuple(got) == (0.0, -4.0, 4.0, -3.0, 0.0)


def test_saturation(spark):
    got = one(spark, scalars.add_costs(F.lit(scalars.INFEASIBLE), F.lit(5)), scalars.clamp_duration(F.lit(70000)), scalars.to_integer(F.lit(2.5), 255), scalars.to_integer(F.lit(-1.0), 255), scalars.to_integer(F.lit(999.0), 255))
    assert tuple(got) == (scalars.INFEASIBLE, 65535, 3, None, 255)


def test_turns(spark):
    got = one(spark, scalars.quantized_angle(F.lit(65.0)), scalars.quantized_angle(F.lit(110.0)), scalars.quantized_angle(F.lit(25.0)), scalars.quantized_angle(F.lit(90.0)), scalars.turn_angle(F.lit(128), F.lit(0)), scalars.turn_angle(F.lit(0), F.lit(0)))
    assert tuple(got) == (46, 78, 18, 64, 0, 128)


def test_osm_order(spark):
    rows = spark.createDataFrame([(i,) for i in (5, -3, 0, 2, -1)], "id long").orderBy(scalars.osm_order(F.col("id"))).collect()
    assert [r.id for r in rows] == [0, -1, -3, 2, 5]


def test_dense_ids(spark):
    rows = spark.createDataFrame([(i,) for i in (70000, -3, 0, 2, -1, 2)], "node long")
    assert {r.node: r.idx for r in extract.dense_ids(rows).collect()} == {0: 0, -1: 1, -3: 2, 2: 3, 70000: 4}


TWO_ROUTES = {"nodes": [(1, 48.0, 9.0), (2, 48.0, 9.001), (3, 48.0, 9.009), (4, 48.0, 9.01), (5, 48.0003, 9.005)], "ways": [(1, [1, 2]), (2, [3, 4]), (10, [2, 3]), (20, [2, 5, 3])]}


def two_routes(spark, tags=None):
    tags = {1: {"highway": "primary"}, 2: {"highway": "primary"}, 10: {"highway": "primary", "maxspeed": "80"}, 20: {"highway": "primary", "maxspeed": "80"}} | (tags or {})
    nodes = spark.createDataFrame([(*n, {}) for n in TWO_ROUTES["nodes"]], "node long, lat double, lng double, tags map<string,string>")
    ways = spark.createDataFrame([(w, refs, tags[w]) for w, refs in TWO_ROUTES["ways"]], "way long, refs array<long>, tags map<string,string>")
    return nodes, ways


def test_extract(spark):
    nodes, ways = two_routes(spark)
    relations = spark.createDataFrame([(7, [("way", 1, "from"), ("node", 2, "via"), ("way", 10, "to")], {"type": "restriction", "restriction": "only_straight_on"})], "relation long, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>")
    found = extract.extract(nodes, ways, relations)
    assert {r.node for r in found["nodes"].collect()} == {2, 3}
    assert {(r.way, r.pos, r.node) for r in found["way_nodes"].collect()} == {(1, 0, 2), (2, 0, 3), (10, 0, 2), (10, 1, 3), (20, 0, 2), (20, 1, 3)}
    lengths = {r.way: r.dist for r in found["way_nodes"].collect() if r.dist is not None}
    assert lengths[10] == pytest.approx(595, abs=3) and lengths[20] > lengths[10]
    assert {(r.node, r.from_way, r.to_way) for r in found["restrictions"].collect()} == {(2, 1, 1), (2, 1, 20)}
    row = found["ways"].filter("way = 10").first()
    assert row.car and row.foot and row.speed == 80 and row.big_street


def test_admission(spark):
    rows = [(1, [1, 2], {"landuse": "forest"}), (2, [1, 2], {"highway": "elevator"}), (3, [1, 2, 1], {"highway": "elevator"}), (4, [1], {"highway": "primary"}), (5, [1, 2], {"highway": "proposed"}), (6, [1, 2], {"route": "ferry"})]
    ways = spark.createDataFrame(rows, "way long, refs array<long>, tags map<string,string>")
    assert {r.way for r in extract.admitted_ways(ways).collect()} == {3, 6}


def test_extract_works_out_what_is_read(spark):
    found = extract.extract(*two_routes(spark, {1: {"highway": "proposed"}}))
    assert {r.way for r in found["ways"].collect()} == {2, 10, 20}
    written = spark.read.parquet(*found["ways"].inputFiles())
    assert set(written.columns) == {"way", "_kept", "refs", "tags"}
    assert [(r.refs, r.tags) for r in written.filter("not _kept").collect()] == [(None, None)]
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535"


def test_ramp(spark):
    rows = [({"highway": "footway", "incline": "up"},), ({"highway": "footway"},), ({"highway": "path", "incline": "up"},)]
    t = access.Tags(F.col("tags"))
    assert [r[0] for r in spark.createDataFrame(rows, "tags map<string,string>").select(t.ramp).collect()] == [True, False, False]


def test_truck_signs(spark):
    t = access.Tags(F.col("tags"))
    tags = {"hgv": "destination", "hgv:forward": "no", "maxweight": "7.5 t", "maxheight": "3.8", "maxlength": "12", "maxlength:hgv": "10", "maxspeed:hgv": "30 mph", "maxaxles": "3"}
    got = spark.createDataFrame([(tags,)], "tags map<string,string>").select(*[c.alias(n) for n, c in t.hgv_info().items()]).first()
    assert (got.access_forward, got.access_backward, got.maxweight_100kg, got.maxheight_cm, got.maxlength_cm, got.maxspeed_kmh, got.maxaxles, got.hazmat) == ("no", "destination", 75, 380, 1000, 48, 3, None)


def test_bidirectional_equals_one_way(spark):
    rows = [(i, (i * 7 + k) % 40, 1 + (i * 13 + k * 5) % 9) for i in range(40) for k in (1, 3, 8)]
    edges = spark.createDataFrame(rows, "src long, dst long, cost long")
    pairs = spark.createDataFrame([(q, q, (q * 11 + 5) % 40) for q in range(6)], "query long, source long, target long")
    forward = search.search(edges, pairs.select("query", F.col("source").alias("state"), F.lit(0).cast("long").alias("cost")))
    want = {r["query"]: r["cost"] for r in forward.join(pairs.select("query", F.col("target").alias("state")), ["query", "state"]).collect()}
    assert {r["query"]: r["cost"] for r in search.bidirectional(edges, pairs, 1000).collect()} == want
    labels = search.predecessors(forward, edges)
    steps = paths.chain(labels, pairs.select("query", F.col("target").alias("node")))
    least = {(a, b): min(c for x, y, c in rows if (x, y) == (a, b)) for a, b, _ in rows}
    sums = {}
    for r in steps.collect():
        sums[r["query"]] = sums.get(r["query"], 0) + least[r.src, r.dst]
    assert sums == {q: c for q, c in want.items() if c}


def test_components_are_reachability(spark):
    way_nodes = spark.createDataFrame([(w, p, n) for w, nodes in enumerate([[1, 2], [2, 3], [3, 4], [7, 8], [8, 9], [11, 12]]) for p, n in enumerate(nodes)], "way long, pos long, node long")
    assert {r.way: r.component for r in graph.components(way_nodes).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}


def test_transpose(spark):
    way_nodes = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, 6), (2, 1, 5), (2, 2, 6)], "way long, pos long, node long")
    back = graph.node_ways(way_nodes)
    assert {(r.way, r.pos, r.node) for r in back.collect()} == {(r.way, r.pos, r.node) for r in way_nodes.collect()}
    assert [r.way_pos for r in back.filter("node = 6").orderBy("way", "pos").collect()] == [0, 1, 2]


def test_allowed_turns_deal_no_pairs(spark):
    passes = spark.createDataFrame([(n, w) for n in range(6) for w in range(n, n + 4)], "node long, way long")
    forbidden = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (5, 8, 8), (9, 1, 1)], "node long, from_way long, to_way long")
    found = graph.allowed_turns(passes, forbidden)
    want = {(n, a, b) for n in range(6) for a in range(n, n + 4) for b in range(n, n + 4)} - {(1, 1, 2), (1, 1, 3), (5, 8, 8)}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    joined = graph.allowed_turns(passes.hint("shuffle_merge"), forbidden.hint("shuffle_merge"))
    assert not any("hashpartitioning" in line and "to_way" in line and "from_way" in line for line in joined._jdf.queryExecution().executedPlan().toString().splitlines())


KEY = conditional.Key("access")


@pytest.mark.parametrize(
    ("text", "yes", "no"),
    [
        ("Mo-Fr 06:00-10:00", ["2024-06-03 06:00", "2024-06-05 08:00", "2024-06-07 09:59"], ["2024-06-03 05:00", "2024-06-03 10:00", "2024-06-08 08:00", "2024-06-09 08:00"]),
        ("2024-2026 May 01-Oct 31 week 01-53/2 Su[1] 08:00-12:00,13:00-17:00", ["2024-07-07 10:00"], ["2024-04-30 10:00", "2024-05-01 10:00", "2024-07-07 07:00", "2024-07-07 12:30"]),
        ("Mo-Fr 09:00-17:00 open; Sa 10:00-14:00 closed; Su unknown", ["2024-06-03 10:00", "2024-06-09 12:00"], ["2024-06-03 08:00", "2024-06-08 12:00", "2024-06-08 09:00"]),
        ("Fr-Sa 22:00-04:00", ["2024-06-07 23:00", "2024-06-08 03:59", "2024-06-09 01:00"], ["2024-06-07 03:00", "2024-06-10 01:00", "2024-06-08 04:00"]),
        ("24/7", ["2024-06-07 23:00"], []),
        ("Nov 01-Feb 15", ["2024-12-31 10:00", "2024-02-15 10:00"], ["2024-02-16 10:00", "2024-10-31 10:00"]),
    ],
)
def test_opening_hours(spark, text, yes, no):
    rules = conditional.parse_opening_hours(text)
    plain = [conditional.asdict(r) for r in rules]
    times = spark.createDataFrame([(datetime.fromisoformat(t),) for t in yes + no], "at timestamp")
    got = {r.at: r.ok for r in times.select("at", conditional.hours(conditional.rules_column(rules), F.col("at")).alias("ok")).collect()}
    for t in yes + no:
        at = datetime.fromisoformat(t)
        assert got[at] == (t in yes) == conditional.hours_match(plain, at), t


def test_conditional_tags():
    parse = conditional.parse_tag
    assert [c["value"] for c in parse("access:conditional", "no @ (Mo-Fr 07:00-09:00); yes @ (PH)")] == ["no"]
    assert parse("access:conditional", "no @ (Mo-Fr 07:00-09:00);") == [] and parse("access:conditional", "no @ (bad hours)") == [] and parse("name", "x") == []
    got = parse("maxheight:hgv:forward:conditional", "3.8 @ (weight>7.5 AND Mo-Fr)")[0]
    assert got["value"] == 380 and (got["mode"], got["direction"]) == ("hgv", "forward") and [c["kind"] for c in got["conditions"]] == ["compare", "hours"] and got["conditions"][0]["number"] == 75
    assert parse("oneway:conditional", "-1 @ (24/7)")[0]["value"] == "backward"
    assert parse("access:conditional", "delivery @ destination && hazmat")[0]["conditions"] == [{"kind": "purpose", "name": "destination"}, {"kind": "usage", "name": "hazmat"}]
    assert conditional.parse_turn_restriction("no_left_turn @ (Mo-Fr 07:00-09:00)")[0] == "no" and conditional.parse_turn_restriction("give_way @ x") is None
    assert not conditional.conditions_match([{"kind": "purpose", "name": "delivery"}], None) and conditional.conditions_match([{"kind": "compare", "name": "weight", "op": ">", "number": 75}], None, {"weight": 80})


def test_wall_time_across_clock_change(spark):
    times = [("2024-03-31 00:30", "2024-03-31 01:30"), ("2024-03-31 01:30", "2024-03-31 03:30"), ("2024-10-27 00:30", "2024-10-27 02:30"), ("2024-10-27 01:30", "2024-10-27 02:30")]
    for utc, local in times:
        assert one(spark, F.date_format(conditional.wall_time(F.lit(utc).cast("timestamp"), F.lit("Europe/Berlin")), "yyyy-MM-dd HH:mm"))[0] == local


def test_candidates_equal_brute_force(spark):
    segments = spark.createDataFrame([(w, 0, w, w + 1, 48 + w * 0.003, 9 + w * 0.001, 48 + w * 0.002, 9.02 - w * 0.001, 100) for w in range(30)], "way long, pos long, a long, b long, lat_a double, lng_a double, lat_b double, lng_b double, dist long")
    points = spark.createDataFrame([(p, 48 + p * 0.007, 9 + p * 0.0015) for p in range(10)], "point long, lat double, lng double")
    distance, _ = lookup.distance_to_segment(F.col("lat"), F.col("lng"))
    want = {(r.point, r.way) for r in points.crossJoin(segments).withColumn("d", distance).filter("d <= 300").collect()}
    for size in (0.001, 0.01, 1.0):
        got = [(r.point, r.way) for r in lookup.candidates(points, segments, 300.0, size).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_viterbi_equals_enumeration(spark):
    from itertools import product

    states = [(t, s, c, (t * 7 + s * 5 + c * 11) % 13) for t in range(3) for s in range(4) for c in range(3)]
    moves = [(t, s, a, b, (t + s * 3 + a * 5 + b * 7) % 10) for t in range(3) for s in range(3) for a in range(3) for b in range(3)]
    got = matching.viterbi(spark.createDataFrame(states, "trace long, seq long, candidate long, penalty long"), spark.createDataFrame(moves, "trace long, seq long, candidate long, next long, cost long")).collect()
    penalty, cost = {x[:3]: x[3] for x in states}, {x[:4]: x[4] for x in moves}
    price = lambda t, p: sum(penalty[t, s, c] for s, c in enumerate(p)) + sum(cost[t, s, p[s], p[s + 1]] for s in range(3))
    for t in range(3):
        path = tuple(r.candidate for r in sorted((r for r in got if r.trace == t), key=lambda r: r.seq))
        assert price(t, path) == min(price(t, p) for p in product(range(3), repeat=4))


def test_viterbi_match_has_every_point(spark, tmp_path):
    from roadloom.plans.queries import QUERIES

    spark.range(3).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(16).selectExpr("id as event_id", "timestamp_seconds(id) as ts", "1 + 9 * (id % 2) as user_id").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["viterbi_match"](spark, str(tmp_path)).collect()
    assert sorted((r.trace, r.seq) for r in got) == [(trace, seq) for trace in (1, 10) for seq in range(8)]


def test_viterbi_beeline(spark):
    states = spark.createDataFrame([(1, s, c, c) for s in range(3) for c in range(2)], "trace long, seq long, candidate long, penalty long")
    moves = spark.createDataFrame([(1, 0, 0, 0, 5)], "trace long, seq long, candidate long, next long, cost long")
    assert matching.viterbi(states, moves).count() == 3


def test_counters(spark):
    rows = spark.createDataFrame([(1, 0, False, 1), (1, 1, True, 10), (1, 2, True, 4), (2, 0, False, 1)], "trace long, segment long, routed boolean, parts long")
    got = {r.trace: (r.routed, r.beelined, r.segments, r.offsets) for r in matching.counters(rows).collect()}
    assert got == {1: (2, 1, 15, [0, 1, 11, 15]), 2: (0, 1, 1, [0, 1])}


def test_elevation(spark):
    got = one(spark, *[scalars.elevation_decoded(scalars.elevation_code(F.lit(m))) for m in (0, 1, 3, 5, 48, 500)])
    assert tuple(got) == (0, 1, 4, 6, 48, 48)
    segments = spark.createDataFrame([(1, 0, 48.0, 9.0, 48.0, 9.003)], "way long, pos long, lat_a double, lng_a double, lat_b double, lng_b double")
    raster = spark.createDataFrame([(0, c, m) for c, m in enumerate((10, 14, 12, 20))], "row long, col long, metres long")
    found = elevation.climbs(elevation.samples(segments, 0.001), raster, 0.001, 48.0, 9.0)
    assert found.select("up", "down").first() == (12, 2)
    edges = spark.createDataFrame([(1, 0, 1, True), (1, 1, 0, False), (2, 0, 1, True)], "way long, pos long, to_pos long, forward boolean")
    assert {(r.way, r.forward): (r.up, r.down) for r in elevation.read(edges, elevation.stored(found)).collect()} == {(1, True): (14, 2), (1, False): (2, 14), (2, True): (0, 0)}


def test_climbs_along_equal_climbs(spark):
    rows = [(w, p, 48 + w * 0.05, 9 + p * 0.03, 48 + (w * 7 % 20) * 0.04, 9 + (p * 3 % 5) * 0.02) for w in range(20) for p in range(5)]
    segments = spark.createDataFrame(rows, "way long, pos long, lat_a double, lng_a double, lat_b double, lng_b double")
    raster = spark.range(1000).withColumnRenamed("id", "row").crossJoin(spark.range(60).withColumnRenamed("id", "col")).filter("(row + col) % 9 <> 0").withColumn("metres", F.expr("row * 7 + col * 13") % 50)
    for shift in (0.0, 0.013):
        want = {(r.way, r.pos): (r.up, r.down) for r in elevation.climbs(elevation.samples(segments, 0.001), raster, 0.001, 49.0, 9.0, shift).collect()}
        assert {(r.way, r.pos): (r.up, r.down) for r in elevation.climbs_along(segments, raster, 0.001, 49.0, 9.0, shift).collect()} == want


def small_network(spark, path, parts, lines):
    """Tables of a network: part keys and, by order, the parts it joins."""
    spark.createDataFrame([(p, 10) for p in parts], "p_partkey long, p_size int").write.parquet(f"{path}/part.parquet")
    rows = [(o, p, 1, k + 1, 5.0, 1.0) for o, refs in lines.items() for k, p in enumerate(refs)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(o, "F", "1-URGENT") for o in lines], "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{path}/orders.parquet")


def against_sql(spark, name, path):
    """Rows of a query and of its SQL."""
    import duckdb

    import __spark_entry__

    found, c = __spark_entry__.queries()[name](spark, str(path)), duckdb.connect()
    for t in (t.name[:-8] for t in path.iterdir()):
        c.execute(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    want = c.execute(f"select {', '.join(chr(34) + n + chr(34) for n in found.columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, found.collect())), sorted(want)


@pytest.mark.parametrize("name", ["way_climbs", "edge_climbs"])
def test_climbs_of_all_pieces(spark, tmp_path, name):
    small_network(spark, tmp_path, [1, 5, 900, 26500, 95007], {1: [1, 5, 900], 2: [26500, 95007], 3: [5, 95007, 900]})
    got, want = against_sql(spark, name, tmp_path)
    assert got == want and len(got) == (5 if name == "way_climbs" else 10)


def test_areas_hold_at_all_longitudes_and_borders(spark, tmp_path):
    middles = {k: [(50 if k % 2 else 100) - k, (50 if k % 2 else 100) + 1 + k] for k in range(10)}
    small_network(spark, tmp_path, [*range(120), 950210, 950300, 950650, 950390, 950360], middles | {20: [950210, 950300], 21: [950650, 950390], 22: [950300, 950360], 23: [950360, 950210]})
    for name in ("way_timezones", "ways_in_areas"):
        got, want = against_sql(spark, name, tmp_path)
        assert got == want and want, name


def test_nearest_ways_are_of_all_ways(spark, tmp_path):
    small_network(spark, tmp_path, range(120), {w: [w, 99 - w, w + 20] for w in range(1, 40)})
    spark.range(500).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")
    for name in ("nearest_way_topk", "match_left_right"):
        got, want = against_sql(spark, name, tmp_path)
        assert got == want
        assert name != "nearest_way_topk" or ({r[0] for r in got} == {0, 50, 100} and any(r[1] % 20 for r in got))


def test_partitions_follow_the_table(spark, tmp_path):
    from roadloom.plans.tables import shares

    small_network(spark, tmp_path, range(50), {w: [w, w + 1] for w in range(40)})
    assert shares(spark, f"{tmp_path}/lineitem.parquet") == 4 and shares(spark, f"{tmp_path}/lineitem.parquet", 100) > 20


def test_platforms(spark):
    rows = spark.createDataFrame([(1, [5], {"name": "A; B ", "ref": "1"}), (2, [6], {"highway": "x"})], "id long, refs array<long>, tags map<string,string>")
    assert [sorted(r.names) for r in platforms.platforms(rows).collect()] == [["1", "A", "B"]]


def test_osm_xml(spark, tmp_path):
    (tmp_path / "a.osm").write_text("<osm><node id='-1' lat='1.5' lon='2.5'/><node id='35184372088823' lat='1' lon='2'><tag k='barrier' v='gate'/></node><way id='-10'><nd ref='-1'/><nd ref='35184372088823'/><tag k='highway' v='path'/></way><relation id='3'><member type='way' ref='-10' role='from'/><tag k='type' v='route'/></relation></osm>")
    found = osm_xml.tables(spark, str(tmp_path / "a.osm"))
    assert {r.node: r.tags for r in found["nodes"].collect()} == {-1: {}, 35184372088823: {"barrier": "gate"}}
    assert found["ways"].first().refs == [-1, 35184372088823] and found["relations"].first().members[0].role == "from"


def _varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def _field(number, value):
    return _varint(number << 3) + _varint(value) if isinstance(value, int) else _varint(number << 3 | 2) + _varint(len(value)) + value


def test_osm_pbf(tmp_path):
    import zlib

    zig = lambda n: (n << 1) ^ (n >> 63)
    many = lambda ns: b"".join(map(_varint, ns))
    strings = b"".join(_field(1, s) for s in (b"", b"highway", b"path"))
    dense = _field(1, many([zig(5), zig(-7)])) + _field(8, many([zig(480000000), zig(10)])) + _field(9, many([zig(90000000), zig(20)])) + _field(10, many([0, 1, 2, 0]))
    line = _field(1, 9) + _field(2, many([1])) + _field(3, many([2])) + _field(8, many([zig(5), zig(-7)]))
    block = _field(1, strings) + _field(2, _field(2, dense)) + _field(2, _field(3, line))
    blob = _field(2, len(block)) + _field(3, zlib.compress(block))
    header = _field(1, b"OSMData") + _field(3, len(blob))
    (tmp_path / "a.pbf").write_bytes(len(header).to_bytes(4, "big") + header + blob)

    def read(kind):
        reader = osm_pbf.PbfReader(str(tmp_path / "a.pbf"), kind)
        return [r for p in reader.partitions() for r in reader.read(p)]

    assert [(i, round(y, 6), round(x, 6), t) for i, y, x, t in read("node")] == [(5, 48.0, 9.0, {}), (-2, 48.000001, 9.000002, {"highway": "path"})]
    assert read("way") == [(9, [5, -2], {"highway": "path"})]


def test_rasters(spark, tmp_path):
    import numpy as np

    (tmp_path / "t.hdr").write_text("NROWS 2\nNCOLS 3\nULXMAP 8.5\nULYMAP 49.5\nXDIM 0.5\nYDIM 0.5\nNODATA -32767\nBYTEORDER I\n")
    (tmp_path / "t.bil").write_bytes(np.array([[1, 2, -32767], [4, 5, 6]], "<i2").tobytes())
    got = rasters.read_bil(spark, str(tmp_path))
    assert {(r.row, r.col): r.metres for r in got.collect()} == {(0, 0): 1, (0, 1): 2, (1, 0): 4, (1, 1): 5, (1, 2): 6}
    with pytest.raises(ValueError, match="NCOLS"):
        rasters.parse_header("NROWS 2")
    assert rasters.hgt_corner("N48E009.hgt") == (48, 9) and rasters.hgt_corner("S01W120.hgt") == (-1, -120)


def test_edges_meet_nodes_in_parts(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 0, 5, 6, 1, True, 12), (1, 1, 6, 5, 0, False, 12), (2, 0, 5, 7, 1, True, 12)], "way long, pos long, src long, dst long, to_pos long, forward boolean, dist long")
    ways = spark.createDataFrame([(1, True, False), (2, False, False)], "way long, foot boolean, bike boolean")
    nodes = spark.createDataFrame([(n, n != 6, False) for n in (5, 6, 7)], "node long, foot boolean, elevator boolean")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = costs.priced(edges, ways, nodes, costs.foot(), 9)
        assert found.rdd.getNumPartitions() == 9
        assert [tuple(r) for r in found.collect()] == [(1, 1, 6, 5, 0, False, 12, 10, 10)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_quantiles_by_ranges(spark):
    rows = [(float(v * 7 % 101),) for v in range(1000)] + [(None,)] * 5
    got = matching.quantiles(spark.createDataFrame(rows, "value double"), {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}, 9).first()
    order = sorted(v for (v,) in rows if v is not None)
    assert tuple(got) == (order[0], order[99], order[499], order[989], order[999])
    assert tuple(matching.quantiles(spark.createDataFrame([], "value double"), {"a": 0.5}).first()) == (None,)


@pytest.mark.parametrize(("name", "ways"), [("sssp_blocked", 10), ("sharing_sssp", 10), ("virtual_edges_sssp", 16)])
def test_only_the_region_of_the_start_is_priced(spark, tmp_path, monkeypatch, name, ways):
    """Regions 0 to 12, 14 to 20 (which only an edge of the query's own leads to) and 40 to 70 that no search gets to."""
    from roadloom.plans import queries

    lines = {w: [w, w + 2, w + 3] for w in range(10)} | {10 + k: [14 + k, 15 + k] for k in range(6)} | {20 + k: [40 + k, 41 + k] for k in range(30)}
    small_network(spark, tmp_path, range(75), lines)
    seen, real = [], queries.costs.priced
    monkeypatch.setattr(queries.costs, "priced", lambda edges, *more: seen.append(edges) or real(edges, *more))
    got, want = against_sql(spark, name, tmp_path)
    assert got == want and len(got) > 5
    assert all({r.way for r in edges.select("way").distinct().collect()} == set(range(ways)) for edges in seen) and seen
