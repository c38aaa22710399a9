"""Least-cost search: in memory where a region of the graph fits into a task, else by supersteps, where all queries of a batch
move on together and a round is a join and a minimum.

States are whatever an edge table leads between: nodes, or a way position with a direction for profiles that mind turns.
With non-negative costs that don't change over time the fixpoint has the costs of a settled-order search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.costs import Profile, turn_cost
from ..plans.tables import drop, file_bytes, kept, sized
from . import regions

LEAST_BUDGET = 900
#: Steps that a round takes before its labels are written, while these are so few bytes that a round's jobs cost more than
#: working out a step twice; with more labels a round is one step.
HOPS, FEW = 3, 2 << 20


def reverse(edges: DataFrame) -> DataFrame:
    """Edges for searches that start at the destination."""
    return edges.withColumnRenamed("src", "_src").withColumnRenamed("dst", "src").withColumnRenamed("_src", "dst")


def without(edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """Edges that don't lead to a blocked node."""
    return edges.join(blocked.select(F.col("node").alias("dst")), "dst", "left_anti")


def search(edges: DataFrame, starts: DataFrame, max_cost: int | None = None, bound: Column | None = None, targets: DataFrame | None = None, came: bool = False) -> DataFrame:
    """query, state, cost: the least cost of every state within reach.

    edges: src, dst, cost. starts: query, state, cost. Only costs below max_cost are kept. bound, over state and cost, drops
    labels that cannot matter, as a goal-directed search does. With targets (state, and query unless they hold for all) only their
    labels are told for certain. came adds pred, as predecessors() does; with targets, of the states on their paths at least.
    Regions that a task can hold are searched in memory, larger ones and bounded searches by supersteps."""
    if bound is not None:
        found = supersteps(edges, starts, max_cost, bound, targets if targets is not None and "query" in targets.columns and not came else None)
        return predecessors(found, edges) if came else found
    parts = regions.split(edges, starts, targets)
    found = parts.walk(max_cost, came, targets is not None)
    alone = parts.alone.groupBy("query", "state").agg(F.min("cost").alias("cost"))
    alone = alone.filter(F.col("cost") < max_cost) if max_cost is not None else alone
    found = found.union(alone.withColumn("pred", F.col("state")) if came else alone)
    if parts.rest is not None:
        some = targets if targets is not None and "query" in targets.columns and not came else None
        rest = supersteps(*parts.rest, max_cost, targets=some)
        found = found.union(predecessors(rest, parts.rest[0]) if came else rest)
    return found


def supersteps(edges: DataFrame, starts: DataFrame, max_cost: int | None = None, bound: Column | None = None, targets: DataFrame | None = None) -> DataFrame:
    """search() by rounds over tables. With targets (query, state) labels move on only while some target
    of their query is unreached or could still get a lesser cost. A round is one join and one hash aggregate over plain numbers;
    labels that move are broadcast while they are few, so that the edges stay where they lie;
    which state stands before another is told afterwards, by predecessors()."""
    steps = sized(kept(edges.groupBy("src", "dst").agg(F.min("cost").alias("step")), "edges"))
    reach = lambda rows: rows.filter(F.col("cost") < max_cost) if max_cost is not None else rows
    keep = lambda rows: reach(rows).filter(bound) if bound is not None else reach(rows)
    wanted = kept(targets.select("query", "state").distinct(), "targets") if targets is not None else None
    first = keep(starts.groupBy("query", "state").agg(F.min("cost").cast("long").alias("cost")))
    best = kept(first.withColumn("moved", F.lit(True)), "labels")
    while not best.filter("moved").isEmpty():
        new = best
        if wanted is not None:
            told = best.join(wanted, ["query", "state"]).groupBy("query").agg(F.max("cost").alias("far"), F.count(F.lit(1)).alias("have"))
            done = told.join(wanted.groupBy("query").agg(F.count(F.lit(1)).alias("want")), "query").filter("have = want").select("query", "far")
            new = best.join(done, "query", "left").withColumn("moved", F.col("moved") & (F.col("far").isNull() | (F.col("cost") < F.col("far")))).drop("far")
        small = file_bytes(best) <= FEW
        for _ in range(HOPS if small else 1):
            frontier = new.filter("moved")
            frontier = F.broadcast(frontier) if small else frontier
            found = frontier.join(steps, frontier.state == steps.src).select("query", F.col("dst").alias("state"), (F.col("cost") + F.col("step")).alias("cost"), F.lit(None).cast("long").alias("known"))
            both = keep(found).union(new.select("query", "state", "cost", F.col("cost").alias("known")))
            new = both.groupBy("query", "state").agg(F.min("cost").alias("cost"), F.min("known").alias("known"))
            new = new.select("query", "state", "cost", (F.col("known").isNull() | (F.col("cost") < F.col("known"))).alias("moved"))
        new = kept(new, "labels")
        drop(best)
        best = new
    return best.drop("moved")


def predecessors(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels with pred: of the states from which an edge leads here at the very cost, the one of least cost, then least id; the
    state itself where the search began."""
    steps = edges.groupBy("src", "dst").agg(F.min("cost").alias("step"))
    came = labels.select("query", F.col("state").alias("src"), F.col("cost").alias("before")).join(steps, "src")
    came = came.select("query", F.col("dst").alias("state"), (F.col("before") + F.col("step")).alias("cost"), F.struct("before", "src").alias("came")).filter("came.before < cost")
    pred = came.join(labels, ["query", "state", "cost"]).groupBy("query", "state").agg(F.min("came")["src"].alias("pred"))
    return labels.join(pred, ["query", "state"], "left").withColumn("pred", F.coalesce("pred", "state"))


def node_states(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "cost")


def state_id(way: Column, pos: Column, forward: Column) -> Column:
    """A way position reached in a direction, as one number."""
    return F.shiftleft(way.cast("long"), 21).bitwiseOR(F.shiftleft(pos.cast("long"), 1)).bitwiseOR(F.when(forward, 1).otherwise(0).cast("long"))


def turn_states(edges: DataFrame, profile: Profile, forbidden: DataFrame | None = None, angles: DataFrame | None = None) -> DataFrame:
    """src, dst, cost between states of a turn-aware profile: an edge out of a node follows any edge into it; turning back on
    the spot costs the penalty, forbidden pairs of ways are left out, and turns cost by their angle."""
    into = edges.select(F.col("dst").alias("node"), F.col("way").alias("from_way"), F.col("to_pos").alias("from_pos"), F.col("forward").alias("from_forward"))
    out = edges.select(F.col("src").alias("node"), F.col("way").alias("to_way"), F.col("pos").alias("at_pos"), F.col("to_pos").alias("to_pos"), F.col("forward").alias("to_forward"), "cost")
    pairs = into.join(out, "node")
    if forbidden is not None:
        pairs = pairs.join(forbidden, ["node", "from_way", "to_way"], "left_anti")
    back = (F.col("from_way") == F.col("to_way")) & (F.col("from_pos") == F.col("at_pos")) & (F.col("from_forward") != F.col("to_forward"))
    cost = F.col("cost") + F.when(back, profile.uturn).otherwise(0)
    if angles is not None:
        turn = angles.select("node", "from_way", "from_pos", "from_forward", "to_way", F.col("to_pos").alias("at_pos"), "to_forward", "angle")
        pairs = pairs.join(turn, ["node", "from_way", "from_pos", "from_forward", "to_way", "at_pos", "to_forward"], "left")
        cost = cost + F.when(back, 0).otherwise(turn_cost(F.coalesce("angle", F.lit(0)), profile.turn))
    return pairs.select(state_id(F.col("from_way"), F.col("from_pos"), F.col("from_forward")).alias("src"), state_id(F.col("to_way"), F.col("to_pos"), F.col("to_forward")).alias("dst"), cost.alias("cost"))


def turn_starts(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Starts (query, node, cost) as states: every edge out of the node begins a search at its far end."""
    out = edges.select("src", state_id(F.col("way"), F.col("to_pos"), F.col("forward")).alias("state"), F.col("cost").alias("step"))
    return starts.join(out, starts.node == out.src).select("query", "state", (F.col("cost") + F.col("step")).alias("cost"))


def by_node(found: DataFrame, edges: DataFrame) -> DataFrame:
    """query, node, cost: the least over the states of a node."""
    where = edges.select(state_id(F.col("way"), F.col("to_pos"), F.col("forward")).alias("state"), F.col("dst").alias("node")).distinct()
    return found.join(where, "state").groupBy("query", "node").agg(F.min("cost").alias("cost"))


def one_to_many(edges: DataFrame, starts: DataFrame, targets: DataFrame, max_cost: int | None = None) -> DataFrame:
    """query, node, cost of each wanted node that is reached."""
    wanted = targets.select("query", F.col("node").alias("state"))
    return search(edges, starts, max_cost, targets=wanted).join(wanted, ["query", "state"]).select("query", F.col("state").alias("node"), "cost")


def bidirectional(edges: DataFrame, pairs: DataFrame, max_cost: int) -> DataFrame:
    """query, cost by meeting: the best sum over a node that both sides reach is the cost; pairs: query, source, target. In memory
    both sides go on until no open path can be cheaper. By supersteps each side searches half the budget (at least LEAST_BUDGET in
    all); a path is found if either half fits its budget, so half of the budget, rounded up, plus the longest single step is searched."""
    half = max(max_cost, LEAST_BUDGET) // 2 + 1
    zero = F.lit(0).cast("long").alias("cost")
    starts, ends = (pairs.select("query", F.col(side).alias("state"), zero) for side in ("source", "target"))
    parts = regions.split(edges, starts, ends)
    met = parts.walk(max_cost, chosen=True, two=True).select("query", "cost")
    met = met.union(parts.alone.join(ends.select("query", "state"), ["query", "state"]).select("query", "cost"))
    if parts.rest is not None:
        edges, starts = parts.rest
        half += edges.agg(F.max("cost")).first()[0] or 0
        out = supersteps(edges, starts, half).select("query", "state", F.col("cost").alias("a"))
        back = supersteps(reverse(edges), ends.join(starts.select("query"), "query", "left_semi"), half).select("query", "state", F.col("cost").alias("b"))
        met = met.union(out.join(back, ["query", "state"]).groupBy("query").agg(F.min(F.col("a") + F.col("b")).alias("cost")))
    return met.groupBy("query").agg(F.min("cost").alias("cost")).filter(F.col("cost") < max_cost)


def by_start_rank(found: DataFrame) -> DataFrame:
    """query, target, rank, cost: of searches per start candidate (query, rank, target, cost), the first rank that reaches
    the target wins, whatever later ones cost."""
    return found.groupBy("query", "target").agg(F.min_by(F.struct("rank", "cost"), "rank").alias("w")).select("query", "target", "w.rank", "w.cost")


def best_candidate(sides: DataFrame) -> DataFrame:
    """query, candidate, cost: of destination candidates (query, candidate, cost of a side or null), the first in order with
    any reachable side, by the lesser of its sides."""
    return sides.filter("cost is not null").groupBy("query", "candidate").agg(F.min("cost").alias("cost")).groupBy("query").agg(F.min_by(F.struct("candidate", "cost"), "candidate").alias("w")).select("query", "w.candidate", "w.cost")


DIRECT_METRES, DIRECT_COST = 8.0, 60


def direct(distance: Column) -> Column:
    """The cost of going straight where both ends lie next to one another, else null."""
    return F.when(distance < DIRECT_METRES, DIRECT_COST)
