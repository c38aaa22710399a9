"""Walking by level: a state is a node and the code of a level (0: none known). Steps and ramps lead from one of their levels to
the other, lifts reach all of their own, and any other way is entered at its level, or from no level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes are below this, so a state is node * CODES + code.
CODES = 64
#: The code of level 0.
GROUND = 33


def _serves(lift: Column, code: Column) -> Column:
    """Whether a lift (an array of codes, null for none) stops at a level; it serves whoever is at no known level."""
    return lift.isNotNull() & ((code == 0) | F.coalesce(F.array_contains(lift, code), F.lit(False)))


def level_on(way: str, at: Column, here: Column) -> Column:
    """The level after the columns from_level, to_level, swaps (steps or ramp) and lift of a way, for someone at `at` on a node
    with the lift `here`; null where the way can't be entered."""
    low, high = F.col(f"{way}.from_level"), F.col(f"{way}.to_level")
    swapped = F.when((low == 0) & (high == 0), 0).when(at == 0, F.when(low == GROUND, high).otherwise(low)).when(low == at, high).when(high == at, low)
    plain = F.when(_serves(F.col(f"{way}.lift"), at), at).when(_serves(here, low) & _serves(here, at), low).when((low == at) | (low == 0) | (at == 0), low)
    return F.when(F.col(f"{way}.swaps"), swapped).otherwise(plain)


def level_states(edges: DataFrame, ways: DataFrame, lifts: DataFrame) -> DataFrame:
    """src, dst, cost between states, for search(). edges: way, src, dst, cost; ways: way, from_level, to_level, swaps, first
    (the node of a way that is itself a lift, else null); lifts: node, stops (an array of codes)."""
    stops = lambda name: lifts.select(F.col("node").alias(name), F.col("stops").alias(f"{name}_lift"))
    own = ways.join(stops("first"), "first", "left").select("way", F.struct("from_level", "to_level", "swaps", F.col("first_lift").alias("lift")).alias("w"))
    rows = edges.join(own, "way")
    stands = rows.select("src", F.explode(F.array("w.from_level", "w.to_level", F.lit(0))).alias("at")).union(lifts.select("node", F.explode("stops"))).distinct()
    rows = rows.join(stands, "src").join(stops("src"), "src", "left").join(stops("dst"), "dst", "left")
    after = F.when(_serves(F.col("dst_lift"), F.col("at")), F.col("dst_lift")).otherwise(F.array(level_on("w", F.col("at"), F.col("src_lift"))))
    rows = rows.select((F.col("src") * CODES + F.col("at")).alias("src"), "dst", F.explode(after).alias("to"), "cost").filter("to is not null")
    return rows.select("src", (F.col("dst") * CODES + F.col("to")).alias("dst"), "cost")
