"""From coordinates to the network: a spatial join by grid cells, then exact distances to way segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import METRES_A_DEGREE
from ..plans.tables import kept, sized

DOUBLINGS = 4
#: Degrees that cells are widened by, so that rounding loses none, and a rise too slight to tell where a row is entered.
SLACK, FLAT = 1e-9, 1e-7


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def cells_of_box(lat_low: Column, lat_high: Column, lng_low: Column, lng_high: Column, size: float) -> Column:
    """All cells that a box touches."""
    rows = F.sequence(cell(lat_low, size), cell(lat_high, size))
    return F.flatten(F.transform(rows, lambda y: F.transform(F.sequence(cell(lng_low, size), cell(lng_high, size)), lambda x: F.struct(y.alias("cy"), x.alias("cx")))))


def way_segments(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """way, pos, a, b and the ends' coordinates of each piece between two nodes."""
    order = Window.partitionBy("way").orderBy("pos")
    rows = way_nodes.join(nodes.select("node", "lat", "lng"), "node")
    return rows.select("way", "pos", F.col("node").alias("a"), F.lead("node").over(order).alias("b"), F.col("lat").alias("lat_a"), F.col("lng").alias("lng_a"), F.lead("lat").over(order).alias("lat_b"), F.lead("lng").over(order).alias("lng_b"), "dist").filter("b is not null")


def distance_to_segment(lat: Column, lng: Column, prefix: tuple[str, str] = ("a", "b")) -> tuple[Column, Column]:
    """Metres from a point to a segment, and how far along the nearest place lies (0 to 1), on the plane at the point."""
    a, b = prefix
    east = F.cos(F.radians(lat)) * METRES_A_DEGREE
    ax, ay = (F.col(f"lng_{a}") - lng) * east, (F.col(f"lat_{a}") - lat) * METRES_A_DEGREE
    bx, by = (F.col(f"lng_{b}") - lng) * east, (F.col(f"lat_{b}") - lat) * METRES_A_DEGREE
    length = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    at = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * (bx - ax) + ay * (by - ay)) / length)))
    x, y = ax + at * (bx - ax), ay + at * (by - ay)
    return F.sqrt(x * x + y * y), at


def on_cells(segments: DataFrame, size: float, box: tuple[int, int, int, int]) -> DataFrame:
    """Segments once for each cell (cy, cx) they pass, within a box of cells (rows low and high, columns low and high): in each
    row of cells those between where the line enters and leaves it."""
    near = (F.greatest("lat_a", "lat_b") >= box[0] * size - SLACK) & (F.least("lat_a", "lat_b") <= (box[1] + 1) * size + SLACK) & (F.greatest("lng_a", "lng_b") >= box[2] * size - SLACK) & (F.least("lng_a", "lng_b") <= (box[3] + 1) * size + SLACK)
    # dealt anew, so that a task's share is small however few rows there were before their cells are listed
    rows = segments.filter(near).repartition(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def times(first, last):
        """Which row each number of the ranges from first to last belongs to, and the numbers."""
        many = np.maximum(last - first + 1, 0)
        of = np.repeat(np.arange(len(many)), many)
        return of, first[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)

    def listed(batch):
        lat_a, lng_a, lat_b, lng_b = (batch[c].to_numpy() for c in ("lat_a", "lng_a", "lat_b", "lng_b"))
        up, whole = lat_a <= lat_b, lambda x: np.floor(x / size).astype(np.int64)
        lat0, lng0, lat1, lng1 = np.where(up, lat_a, lat_b), np.where(up, lng_a, lng_b), np.where(up, lat_b, lat_a), np.where(up, lng_b, lng_a)
        of, cy = times(np.maximum(whole(lat0 - SLACK), box[0]), np.minimum(whole(lat1 + SLACK), box[1]))
        lat0, lng0, lat1, lng1 = (x[of] for x in (lat0, lng0, lat1, lng1))
        steep = lat1 - lat0 > FLAT
        slope = (lng1 - lng0) / np.where(steep, lat1 - lat0, 1.0)
        one = np.where(steep, lng0 + slope * (np.clip(cy * size - SLACK, lat0, lat1) - lat0), lng0)
        two = np.where(steep, lng0 + slope * (np.clip((cy + 1) * size + SLACK, lat0, lat1) - lat0), lng1)
        by, cx = times(np.maximum(whole(np.minimum(one, two) - SLACK), box[2]), np.minimum(whole(np.maximum(one, two) + SLACK), box[3]))
        rows = batch.take(pa.array(of[by]))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(cy[by]), pa.array(cx)], [*rows.schema.names, "cy", "cx"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                yield listed(batch.slice(k, 1000))

    return rows.mapInArrow(work, T.StructType([*rows.schema.fields, T.StructField("cy", T.LongType()), T.StructField("cx", T.LongType())]))


def measured(rows: DataFrame, radius_m: float) -> DataFrame:
    """Points (lat, lng) with segments, those within the radius: distance and at, as distance_to_segment() has them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lat, lng, lat_a, lng_a, lat_b, lng_b = (batch[c].to_numpy() for c in ("lat", "lng", "lat_a", "lng_a", "lat_b", "lng_b"))
            east = np.cos(np.radians(lat)) * METRES_A_DEGREE
            ax, ay, bx, by = (lng_a - lng) * east, (lat_a - lat) * METRES_A_DEGREE, (lng_b - lng) * east, (lat_b - lat) * METRES_A_DEGREE
            length = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
            at = np.where(length == 0, 0.0, np.clip(-(ax * (bx - ax) + ay * (by - ay)) / np.where(length == 0, 1.0, length), 0.0, 1.0))
            x, y = ax + at * (bx - ax), ay + at * (by - ay)
            distance = np.sqrt(x * x + y * y)
            found = pa.RecordBatch.from_arrays([*batch.columns, pa.array(distance), pa.array(at)], [*batch.schema.names, "distance", "at"])
            yield found.filter(pa.array(distance <= radius_m))

    return rows.mapInArrow(work, T.StructType([*rows.schema.fields, T.StructField("distance", T.DoubleType()), T.StructField("at", T.DoubleType())]))


def candidates(points: DataFrame, segments: DataFrame, radius_m: float, size: float = 0.01, most: int | None = None) -> DataFrame:
    """point, way, pos, distance, at: ways within the radius of each point (point, lat, lng), each by its nearest segment,
    with rank by distance (up to `most`, if given). Points at one place are searched once. Segments lie in every cell they pass
    and places in their radius' cells, so the join is on cells, of which only those around places are listed."""
    degrees = radius_m / METRES_A_DEGREE
    wide = F.lit(degrees) / F.cos(F.radians("lat"))
    points = points.select("point", "lat", "lng")
    low, high = lambda n: F.least(f"{n}_a", f"{n}_b"), lambda n: F.greatest(f"{n}_a", f"{n}_b")
    around = (cell(F.col("lat") - degrees, size), cell(F.col("lat") + degrees, size), cell(F.col("lng") - wide, size), cell(F.col("lng") + wide, size))
    places = points.select("lat", "lng").distinct()
    box = places.agg(F.min(around[0]), F.max(around[1]), F.min(around[2]), F.max(around[3])).first()
    cells = F.explode(cells_of_box(F.col("lat") - degrees, F.col("lat") + degrees, F.col("lng") - wide, F.col("lng") + wide, size))
    near = kept(places.withColumn("c", cells).select("lat", "lng", "c.cy", "c.cx"), "places")
    placed = on_cells(segments, size, tuple(b or 0 for b in box))
    rows = placed.join(sized(near), ["cy", "cx"]).filter((F.col("lat") >= low("lat") - degrees) & (F.col("lat") <= high("lat") + degrees))
    rows = measured(rows.drop("cy", "cx"), radius_m)
    best = rows.groupBy("lat", "lng", "way").agg(F.min_by(F.struct("pos", "at", "a", "b", "dist"), F.struct("distance", "pos")).alias("s"), F.min("distance").alias("distance"))
    order = Window.partitionBy("lat", "lng").orderBy(F.round("distance", 6), "way")
    best = best.select("lat", "lng", "way", "s.pos", "s.at", "s.a", "s.b", "s.dist", "distance", F.row_number().over(order).alias("rank"))
    if most is not None:
        best = best.filter(F.col("rank") <= most)
    return points.join(best, ["lat", "lng"]).select("point", "way", "pos", "at", "a", "b", "dist", "distance", "rank")


def match(points: DataFrame, segments: DataFrame, radius_m: float, size: float = 0.01, enough=None) -> DataFrame:
    """Candidates within the least doubling of the radius, up to DOUBLINGS times, at which there are any (or at which `enough`,
    an aggregate over candidates, holds): all are found once at the largest radius and the doubling is derived."""
    widest = radius_m * 2**DOUBLINGS
    found = candidates(points, segments, widest, size)
    step = F.greatest(F.ceil(F.log2(F.greatest(F.col("distance") / radius_m, F.lit(1e-9)))), F.lit(0)).cast("int")
    found = found.withColumn("doubling", step)
    need = found.groupBy("point").agg((F.min("doubling") if enough is None else enough).alias("need"))
    return found.join(need, "point").filter(F.col("doubling") <= F.coalesce("need", F.lit(DOUBLINGS)))


def all_covered(*properties: str):
    """For match(): the least doubling at which each property has a candidate way."""
    return F.greatest(*[F.coalesce(F.min(F.when(F.col(p), F.col("doubling"))), F.lit(DOUBLINGS)) for p in properties])


def sides(found: DataFrame) -> DataFrame:
    """Each candidate's next node either way, with distance to it: to the way, then along it."""
    return found.select("point", "way", "rank", "distance", F.col("a").alias("left_node"), (F.col("distance") + F.col("at") * F.col("dist")).alias("left_dist"), F.col("b").alias("right_node"), (F.col("distance") + (1 - F.col("at")) * F.col("dist")).alias("right_dist"))


def nodes_in_box(nodes: DataFrame, lat_low: float, lat_high: float, lng_low: float, lng_high: float) -> DataFrame:
    return nodes.filter(F.col("lat").between(lat_low, lat_high) & F.col("lng").between(lng_low, lng_high))


def ways_in_box(segments: DataFrame, lat_low: float, lat_high: float, lng_low: float, lng_high: float) -> DataFrame:
    """Ways whose bounding box meets the box."""
    box = segments.groupBy("way").agg(F.min(F.least("lat_a", "lat_b")).alias("lat0"), F.max(F.greatest("lat_a", "lat_b")).alias("lat1"), F.min(F.least("lng_a", "lng_b")).alias("lng0"), F.max(F.greatest("lng_a", "lng_b")).alias("lng1"))
    return box.filter((F.col("lat0") <= lat_high) & (F.col("lat1") >= lat_low) & (F.col("lng0") <= lng_high) & (F.col("lng1") >= lng_low)).select("way")


def levels(nodes: DataFrame) -> DataFrame:
    return nodes.select("level").filter("level is not null").distinct().orderBy(F.desc("level"))


def cut_off(found: DataFrame, beeline_m: Column) -> DataFrame:
    """Candidates beyond the fifth are dropped where they lie further than a third of the beeline."""
    return found.filter(~((F.col("rank") > 6) & (F.col("distance") * F.col("distance") > beeline_m * beeline_m / 9)))
