"""Map matching of traces: candidates by point, transitions between neighbours, and the best chain (Viterbi). Traces are read as
streams of their points in order, many a task, so no work waits for the longest trace and a task holds one trace's choices."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import kept

NOT_NEAREST = 30
#: Straight-line distance in metres up to which a limit factor holds, and the factor; the last is for all beyond.
LIMITS = ((2000.0, 10.0), (10000.0, 4.0), (None, 3.0))


def trace_pairs(points: DataFrame) -> DataFrame:
    """trace, segment, from, to of consecutive points (trace, seq, point)."""
    order = Window.partitionBy("trace").orderBy("seq")
    return points.select("trace", (F.row_number().over(order) - 1).cast("long").alias("segment"), F.col("point").alias("from"), F.lead("point").over(order).alias("to")).filter("`to` is not null")


def emission(found: DataFrame, pace: float) -> DataFrame:
    """Penalty of each candidate: the square of the time to reach it at the pace, and more unless it is the nearest."""
    order = Window.partitionBy("trace", "seq").orderBy("distance", "candidate")
    time = F.col("distance") / pace
    return found.withColumn("penalty", F.round(time * time).cast("long") + F.when(F.row_number().over(order) == 1, 0).otherwise(NOT_NEAREST))


def limit_m(beeline):
    """How long a route between points at that distance may be."""
    out = None
    for upto, factor in LIMITS:
        value = F.greatest(beeline * factor, F.lit(500.0))
        out = F.when(beeline < upto, value) if out is None else out.when(beeline < upto, value) if upto else out.otherwise(value)
    return out


def viterbi(states: DataFrame, transitions: DataFrame) -> DataFrame:
    """trace, seq, candidate of the cheapest chain. states: trace, seq, candidate, penalty; transitions: trace, seq (of the
    earlier point), candidate, next, cost. A point that no transition reaches starts anew (a beeline), so each trace gets
    through; ties go to the least candidate. The candidates and moves of a point are one row; points of a trace meet in one
    task in order, which keeps the cost of each candidate and, for the way back, whence each was reached."""
    points = states.groupBy("trace", "seq").agg(F.array_sort(F.collect_list(F.struct("candidate", "penalty"))).alias("here"))
    moves = transitions.groupBy("trace", (F.col("seq") + 1).alias("seq")).agg(F.collect_list(F.struct("candidate", "next", "cost")).alias("moves"))
    rows = points.join(moves, ["trace", "seq"], "left").select(F.col("trace").cast("long"), F.col("seq").cast("long"), "here.candidate", "here.penalty", F.col("moves.candidate").alias("came"), F.col("moves.next").alias("goes"), F.col("moves.cost").alias("cost"))
    ordered = rows.repartition("trace").sortWithinPartitions("trace", "seq")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trace, costs, back = None, {}, []

        def chosen() -> pa.RecordBatch:
            at, path = min((c, k) for k, c in costs.items())[1], []
            for _, came in reversed(back):
                path.append(at)
                at = came.get(at)
            return pa.RecordBatch.from_arrays([pa.array([trace] * len(back), pa.int64()), pa.array([seq for seq, _ in back], pa.int64()), pa.array(path[::-1], pa.int64())], names=["trace", "seq", "candidate"])

        for batch in batches:
            for of, seq, candidates, penalties, came, goes, price in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != trace:
                    if back:
                        yield chosen()
                    trace, costs, back = of, {}, []
                reach: dict = {}
                for a, b, c in zip(came or (), goes or (), price or (), strict=True):
                    if a in costs and b in candidates and (b not in reach or (costs[a] + c, a) < reach[b]):
                        reach[b] = (costs[a] + c, a)
                if not reach:  # the first point, or a gap: any candidate, from the cheapest before
                    start = min(((c, k) for k, c in costs.items()), default=(0, None))
                    reach = dict.fromkeys(candidates, start)
                costs = {k: reach[k][0] + p for k, p in zip(candidates, penalties, strict=True) if k in reach}
                back.append((seq, {k: reach[k][1] for k in costs}))
        if back:
            yield chosen()

    return ordered.mapInArrow(walk, "trace long, seq long, candidate long")


def counters(segments: DataFrame) -> DataFrame:
    """trace, routed, beelined, segments, offsets: of segments (trace, segment, routed, parts) how many were routed or drawn
    straight, and where each begins in the trace's list of parts."""
    order = Window.partitionBy("trace").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    rows = segments.withColumn("offset", F.coalesce(F.sum("parts").over(order), F.lit(0)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("segment", "offset"))), lambda x: x["offset"])
    return rows.groupBy("trace").agg(F.count_if(F.col("routed")).alias("routed"), F.count_if(~F.col("routed")).alias("beelined"), F.sum("parts").alias("segments"), F.concat(ordered, F.array(F.sum("parts"))).alias("offsets"))


def quantiles(values: DataFrame, shares: dict[str, float], each: int = 1 << 17) -> DataFrame:
    """One row: by name, the least value (of the column value, nulls aside) that has the share of all values at or below it. Counts
    of values are dealt by ranges, only the ranges' sums come to the driver, and a task orders one range."""
    counts = kept(values.filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("many")), "values")
    parts = max(1, -(-counts.count() // each))
    counts = kept(counts.repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id()), "values")
    sums = counts.groupBy("part").agg(F.sum("many").alias("many")).orderBy("part").collect()
    total, before, wanted = sum(r.many for r in sums), 0, {}
    for r in sums:
        for name, share in shares.items():
            rank = max(1, math.ceil(total * share))
            if before < rank <= before + r.many:
                wanted[name] = (r.part, rank - before)
        before += r.many
    rows = counts.filter(F.col("part").isin([p for p, _ in wanted.values()]))
    rows = rows.withColumn("upto", F.sum("many").over(Window.partitionBy("part").orderBy("value")))
    at = lambda name: (F.col("part") == wanted[name][0]) & (F.col("upto") >= wanted[name][1]) if name in wanted else F.lit(False)
    return rows.agg(*[F.min(F.when(at(name), F.col("value"))).alias(name) for name in shares])
