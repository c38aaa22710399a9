"""Search where ways open and close by time: labels are settled in order of cost, so no way is entered at a time that a
cheaper label would have changed. A round settles, for all queries at once, every open label below the least open one plus the
least step, which nothing can undercut any more, and moves on from those only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.conditional import hours
from ..functions.scalars import MAX_DURATION
from ..plans.tables import drop, kept, sized

_SHIFT = MAX_DURATION + 1


def arrival(at, duration, backward: bool = False):
    """The time at a state: start plus or minus what has passed."""
    return F.timestamp_seconds(F.unix_timestamp(at) + (-duration if backward else duration))


def timed_search(edges: DataFrame, starts: DataFrame, max_cost: int | None = None) -> DataFrame:
    """query, state, cost, duration. edges: src, dst, cost, duration, closed (rules of opening hours, local time, that bar the
    edge while they hold, or null). starts: query, state, cost, at (local time). Ties in cost go to the shorter duration."""
    steps = sized(kept(edges.select("src", "dst", F.col("cost").alias("step"), F.col("duration").alias("lasts"), "closed"), "edges"))
    window = max(steps.agg(F.min("step")).first()[0] or 0, 1)
    times = kept(starts.groupBy("query").agg(F.min("at").alias("at")), "times")
    best = kept(starts.groupBy("query", "state").agg((F.min("cost") * _SHIFT).cast("long").alias("label")).withColumn("settled", F.lit(False)), "labels")
    while True:
        least = best.filter("not settled").groupBy("query").agg(F.min("label").alias("low"))
        ripe = best.filter("not settled").join(least, "query").filter(F.floor(F.col("label") / _SHIFT) < F.floor(F.col("low") / _SHIFT) + window).drop("low")
        ripe = kept(ripe, "ripe")
        if ripe.isEmpty():
            return best.select("query", "state", F.floor(F.col("label") / _SHIFT).alias("cost"), (F.col("label") % _SHIFT).alias("duration"))
        cost, duration = F.floor(F.col("label") / _SHIFT), F.col("label") % _SHIFT
        moved = ripe.join(steps, ripe.state == steps.src).join(times, "query")
        barred = F.col("closed").isNotNull() & hours(F.col("closed"), arrival(F.col("at"), duration))
        moved = moved.filter(~barred).select("query", F.col("dst").alias("state"), ((cost + F.col("step")) * _SHIFT + F.least(duration + F.col("lasts"), F.lit(MAX_DURATION))).alias("label"), F.lit(False).alias("settled"))
        if max_cost is not None:
            moved = moved.filter(F.col("label") < max_cost * _SHIFT)
        both = best.union(ripe.withColumn("settled", F.lit(True)).select(*best.columns)).union(moved)
        settled = F.min(F.when(F.col("settled"), F.col("label")))
        new = both.groupBy("query", "state").agg(settled.alias("done"), F.min("label").alias("open"))
        new = kept(new.select("query", "state", F.coalesce("done", "open").alias("label"), F.col("done").isNotNull().alias("settled")), "labels")
        drop(best)
        best = new
