"""Elevation along ways: sampled at the raster's resolution, climbs and descents summed, stored as lossy codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import elevation_code, elevation_decoded

#: Bytes of a raster that is sent to every executor, and samples that are worked on at a time.
MOST_RASTER, SAMPLES = 64 << 20, 1 << 16


def samples(segments: DataFrame, resolution: float) -> DataFrame:
    """way, pos, step, lat, lng: points from one end of a segment to the other, no further apart than the resolution."""
    span = F.greatest(F.abs(F.col("lat_b") - F.col("lat_a")), F.abs(F.col("lng_b") - F.col("lng_a")))
    steps = F.greatest(F.ceil(1.000001 * span / resolution), F.lit(1)).cast("int")
    rows = segments.select("way", "pos", "lat_a", "lng_a", "lat_b", "lng_b", steps.alias("steps")).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    part = F.col("step") / F.col("steps")
    return rows.select("way", "pos", "step", (F.col("lat_a") + part * (F.col("lat_b") - F.col("lat_a"))).alias("lat"), (F.col("lng_a") + part * (F.col("lng_b") - F.col("lng_a"))).alias("lng"))


def climbs(points: DataFrame, raster: DataFrame, resolution: float, lat0: float, lng0: float, shift: float = 0.0) -> DataFrame:
    """way, pos, up, down of sampled points over a raster (row, col, metres), the first row at lat0 and rows going south, all
    moved north-west by a share (shift) of a step. Points without a value are skipped."""
    row = F.round((F.lit(lat0) - F.col("lat")) / resolution - shift).cast("long")
    col = F.round((F.col("lng") - F.lit(lng0)) / resolution + shift).cast("long")
    order = Window.partitionBy("way", "pos").orderBy("step")
    seen = points.withColumn("row", row).withColumn("col", col).join(raster, ["row", "col"]).withColumn("rise", F.col("metres") - F.lag("metres").over(order))
    return seen.groupBy("way", "pos").agg(F.coalesce(F.sum(F.greatest("rise", F.lit(0))), F.lit(0)).alias("up"), F.coalesce(F.sum(F.greatest(-F.col("rise"), F.lit(0))), F.lit(0)).alias("down"))


def _grid(raster: DataFrame) -> tuple[np.ndarray, int, int] | None:
    """The raster's values by row and column (NaN: none) with its first row and column, unless that takes too many bytes."""
    low = raster.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if low[0] is None or (low[1] - low[0] + 1) * (low[3] - low[2] + 1) * 4 > MOST_RASTER:
        return None
    cells = raster.select((F.col("row") - low[0]).cast("int").alias("row"), (F.col("col") - low[2]).cast("int").alias("col"), F.col("metres").cast("double").alias("metres"), (F.col("metres").cast("float").cast("double") == F.col("metres").cast("double")).alias("short"))
    table = cells.filter("metres is not null").toArrow()
    grid = np.full((low[1] - low[0] + 1, low[3] - low[2] + 1), np.nan, np.float32 if pc.all(table["short"]).as_py() else np.float64)
    grid[table["row"].to_numpy(), table["col"].to_numpy()] = table["metres"].to_numpy()
    return grid, low[0], low[2]


def climbs_along(segments: DataFrame, raster: DataFrame, resolution: float, lat0: float, lng0: float, shift: float = 0.0) -> DataFrame:
    """climbs() of the samples() of segments: over a raster that fits in MOST_RASTER no sample becomes a row, a larger one is
    joined to them."""
    told = _grid(raster)
    if told is None:
        return climbs(samples(segments, resolution), raster, resolution, lat0, lng0, shift)
    sent, row0, col0 = segments.sparkSession.sparkContext.broadcast(told[0]), told[1], told[2]

    def nearest(x):  # halves away from zero
        whole = np.trunc(x)
        return (whole + np.where(np.abs(x - whole) >= 0.5, np.sign(x), 0)).astype(np.int64)

    def summed(lat_a, lng_a, lat_b, lng_b, steps):
        grid = sent.value
        of = np.repeat(np.arange(len(steps)), steps + 1)
        part = (np.arange(len(of)) - np.repeat(np.cumsum(steps + 1) - steps - 1, steps + 1)) / steps[of]
        row = nearest((lat0 - (lat_a[of] + part * (lat_b - lat_a)[of])) / resolution - shift) - row0
        col = nearest((lng_a[of] + part * (lng_b - lng_a)[of] - lng0) / resolution + shift) - col0
        on = (row >= 0) & (row < grid.shape[0]) & (col >= 0) & (col < grid.shape[1])
        of = of[on]
        metres = grid[row[on], col[on]].astype(np.float64)
        on = ~np.isnan(metres)
        of, metres = of[on], metres[on]
        rise = np.where(of[1:] == of[:-1], metres[1:] - metres[:-1], 0.0)
        total = lambda r: np.bincount(of[1:], np.maximum(r, 0.0), len(steps))
        return np.bincount(of, minlength=len(steps)) > 0, total(rise), total(-rise)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [batch[c].to_numpy() for c in ("lat_a", "lng_a", "lat_b", "lng_b")]
            span = np.maximum(np.abs(ends[2] - ends[0]), np.abs(ends[3] - ends[1]))
            steps = np.maximum(np.ceil(1.000001 * span / resolution), 1).astype(np.int64)
            upto, start = np.cumsum(steps + 1), 0
            while start < len(steps):
                stop = max(int(np.searchsorted(upto, (upto[start - 1] if start else 0) + SAMPLES, "right")), start + 1)
                seen, up, down = summed(*(e[start:stop] for e in ends), steps[start:stop])
                rows = pa.RecordBatch.from_arrays([batch["way"].slice(start, stop - start), batch["pos"].slice(start, stop - start), pa.array(up), pa.array(down)], ["way", "pos", "up", "down"])
                yield rows.filter(pa.array(seen))
                start = stop

    return segments.select(F.col("way").cast("long"), F.col("pos").cast("long"), "lat_a", "lng_a", "lat_b", "lng_b").mapInArrow(work, "way long, pos long, up double, down double")


def stored(found: DataFrame) -> DataFrame:
    """Codes of up and down; rows of two zeros are not kept, as a missing row reads as zero."""
    return found.select("way", "pos", elevation_code(F.col("up")).alias("up"), elevation_code(F.col("down")).alias("down")).filter("up > 0 or down > 0")


def read(edges: DataFrame, codes: DataFrame) -> DataFrame:
    """Edges (way, pos, to_pos, forward) with up and down in the direction of travel."""
    at = F.least("pos", "to_pos")
    rows = edges.withColumn("_at", at).join(codes.select("way", F.col("pos").alias("_at"), F.col("up").alias("_up"), F.col("down").alias("_down")), ["way", "_at"], "left")
    up, down = (elevation_decoded(F.coalesce(c, F.lit(0))) for c in ("_up", "_down"))
    return rows.withColumn("up", F.when(F.col("forward"), up).otherwise(down)).withColumn("down", F.when(F.col("forward"), down).otherwise(up)).drop("_at", "_up", "_down")
