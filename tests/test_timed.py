"""Time-dependent search against a heap search, and GeoJSON rows."""

import heapq
import json
from dataclasses import asdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from roadloom.functions import conditional
from roadloom.operators import geojson, timed


def test_timed_search(spark):
    closing = conditional.parse_opening_hours("Mo-Su 08:00-08:01")
    rows = [(i, (i + k) % 8, 3 + (i * k) % 4, 20 + 15 * k, (i + k) % 3 == 0) for i in range(8) for k in (1, 3)]
    plain = spark.createDataFrame(rows, "src long, dst long, cost long, duration long, limited boolean")
    edges = plain.withColumn("closed", F.when(F.col("limited"), conditional.rules_column(closing)))
    at = datetime(2024, 6, 3, 7, 59, 30)
    starts = spark.createDataFrame([(1, 0, 0, at), (2, 3, 0, at + timedelta(minutes=5))], "query long, state long, cost long, at timestamp")
    want = {}
    for query, state, _, begin in [(1, 0, 0, at), (2, 3, 0, at + timedelta(minutes=5))]:
        heap, done = [(0, 0, state)], set()
        while heap:
            cost, passed, here = heapq.heappop(heap)
            if here in done:
                continue
            done.add(here)
            want[query, here] = (cost, passed)
            for s, d, c, t, limited in rows:
                if s == here and not (limited and conditional.hours_match([asdict(r) for r in closing], begin + timedelta(seconds=passed))):
                    heapq.heappush(heap, (cost + c, passed + t, d))
    assert {(r["query"], r["state"]): (r["cost"], r["duration"]) for r in timed.timed_search(edges, starts).collect()} == want


def test_geojson(spark):
    nodes = spark.createDataFrame([(1, 48.0, 9.0, 0), (2, 48.1, 9.1, 1)], "node long, lat double, lng double, level int")
    way_nodes = spark.createDataFrame([(5, 0, 1, 70), (5, 1, 2, 0)], "way long, pos long, node long, dist long")
    got = json.loads(geojson.way_edges(way_nodes, nodes).first().json)
    assert got["geometry"]["coordinates"] == [[9.0, 48.0], [9.1, 48.1]] and got["properties"]["distance"] == 70
    labels = spark.createDataFrame([(1, 2, 9)], "query long, state long, cost long")
    rows = {r.node: json.loads(r.json)["properties"] for r in geojson.nodes(nodes, labels).collect()}
    assert rows[2]["labels"] == [{"query": 1, "cost": 9}] and "labels" not in rows[1]
    ways = spark.createDataFrame([(5, True)], "way long, foot boolean")
    shape = spark.createDataFrame([(5, 1, 48.1, 9.1), (5, 0, 48.0, 9.0)], "way long, seq long, lat double, lng double")
    assert json.loads(geojson.ways(ways, shape).first().json)["geometry"]["coordinates"][0] == [9.0, 48.0]
    found = spark.createDataFrame([(3, [2], ["A"])], "id long, refs array<long>, names array<string>")
    assert json.loads(geojson.platforms(found, nodes).first().json)["properties"] == {"names": ["A"], "level": 1}
