"""Costs of ways, nodes and turns by profile, as Columns over the properties of a way. Null is infeasible.

An edge has dist (metres), forward (travel along the way's own direction) and the way's properties as columns, under the names
that extraction gives them; what a table of ways lacks reads as not signed."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import clamp_cost, clamp_duration

C = F.col


def _flag(name: str) -> Column:
    return F.coalesce(C(name), F.lit(False))


@dataclass(frozen=True)
class Profile:
    """cost and duration of passing an edge, cost of entering a node, of a turn back; turn-aware profiles tell apart by which way and direction a node is reached."""

    name: str
    cost: Column
    duration: Column
    node_cost: Column
    uturn: int = 0
    turn_aware: bool = False
    turn: tuple = ()
    oneway: str = "oneway_car"


def _direction(oneway: str) -> Column:
    """Both ways, or only along the sign: forward is told along it, see priced()."""
    return ~_flag(oneway) | C("forward")


def foot(wheelchair: bool = False, speed: float | None = None) -> Profile:
    metres = speed or (0.8 if wheelchair else 1.2)
    usable = (_flag("foot") | _flag("bike")) & (~_flag("steps") if wheelchair else F.lit(True))
    pace = F.lit(metres) + F.when(_flag("big_street"), -0.2).otherwise(0.0) + F.when(_flag("motor_vehicle_no"), 0.1).otherwise(0.0)
    cost = F.when(_flag("foot"), 0).otherwise(90) + F.when(_flag("sidewalk_separate"), 45).otherwise(0) + F.round(C("dist") / pace).cast("long")
    node = F.when(_flag("node_foot"), F.when(_flag("node_elevator"), 90).otherwise(0))
    return Profile("wheelchair" if wheelchair else "foot", F.when(usable, cost), F.when(usable, clamp_duration(F.round(C("dist") / metres))), node)


def bike(fast: bool = False, climb: int = 0) -> Profile:
    """climb: the weight of metres up over distance, 570 or 3700 for the two hill-shy costings."""
    usable = _flag("bike") & _direction("oneway")
    pace = F.lit(4.2) + (F.lit(0.0) if fast else F.when(_flag("big_street"), -0.7).otherwise(0.0) + F.when(_flag("motor_vehicle_no"), 0.5).otherwise(0.0))
    cost = F.round(C("dist") / pace).cast("long")
    if climb:
        cost = cost + climb_cost(climb, C("up"), C("dist"))
    return Profile("bike", F.when(usable, cost), F.when(usable, clamp_duration(F.round(C("dist") / 4.2))), F.when(_flag("node_bike"), 0), oneway="oneway_bike")


def climb_cost(weight: int, up: Column, dist: Column) -> Column:
    return F.when((up > 0) & (dist > 0), F.floor(weight * F.pow(up / dist, 2.1))).otherwise(0).cast("long")


def seconds_a_metre(kmh: Column) -> Column:
    return F.lit(3.6) / kmh


def car() -> Profile:
    usable = _flag("car") & _direction("oneway")
    base = F.rint(C("dist") * seconds_a_metre(C("speed"))).cast("long")
    cost = clamp_cost(F.when(_flag("destination"), base * 5 + 120).otherwise(base))
    return Profile("car", F.when(usable, cost), F.when(usable, clamp_duration(base)), F.when(_flag("node_car"), 0), uturn=120, turn_aware=True)


def bus() -> Profile:
    usable = (_flag("bus") | _flag("bus_penalty")) & _direction("oneway")
    kmh = F.when(_flag("in_route"), F.greatest(C("speed"), F.lit(50))).otherwise(C("speed"))
    base = F.rint(C("dist") * seconds_a_metre(kmh)).cast("long")
    cost = F.rint(F.when(_flag("in_route") | ~_flag("car"), 1.0).otherwise(1.5) * C("dist") * seconds_a_metre(kmh)).cast("long")
    cost = cost * F.when(_flag("parking"), 2).otherwise(1) * F.when(_flag("bus_penalty"), F.when(_flag("in_route"), 2).otherwise(4)).otherwise(1)
    return Profile("bus", F.when(usable, cost), F.when(usable, clamp_duration(base)), F.when(_flag("node_bus"), 0).otherwise(60), uturn=120, turn_aware=True, turn=((46, 10), (78, 25)), oneway="oneway_bus_psv")


def railway() -> Profile:
    usable = (_flag("railway") | _flag("railway_penalty")) & _direction("oneway")
    cost = C("dist") * F.when(_flag("railway_penalty"), F.when(_flag("in_route"), 2).otherwise(4)).otherwise(1)
    return Profile("railway", F.when(usable, cost), F.when(usable, clamp_duration(C("dist"))), F.lit(0), uturn=1000, turn_aware=True)


def ferry() -> Profile:
    cost = F.floor(C("dist") / 10).cast("long")
    return Profile("ferry", F.when(_flag("ferry"), cost), F.when(_flag("ferry"), clamp_duration(cost)), F.lit(0))


#: What is signed as a limit, and the truck's measure that must not exceed it.
LIMITS = {
    "maxlength_cm": "length_cm", "maxweightrating_100kg": "weight_rating_100kg", "maxheight_cm": "height_cm", "maxwidth_cm": "width_cm",
    "maxweight_100kg": "weight_100kg", "maxaxleload_100kg": "axle_load_100kg", "maxaxles": "axles",
}
#: What is signed for some trucks only, and the truck's trait it holds for.
TRAITS = {"hazmat": "hazmat", "hazmat_water": "hazmat_water", "trailer": "trailer"}
CLOSED, LIMITED = ("no", "private"), ("destination", "delivery")


@dataclass(frozen=True)
class Truck:
    """Dimensions of a truck and what it carries; null dimensions pass every limit."""

    weight_100kg: int | None = 75
    top_speed_kmh: int = 80
    lez_access: bool = False
    length_cm: int | None = None
    weight_rating_100kg: int | None = None
    height_cm: int | None = None
    width_cm: int | None = None
    axle_load_100kg: int | None = None
    axles: int | None = None
    hazmat: bool = False
    hazmat_water: bool = False
    trailer: bool = False


def hgv(truck: Truck = Truck()) -> Profile:
    """Signs for trucks go before those for cars, by direction; a sign for what the truck carries goes for it as well."""
    access = F.coalesce(C("hgv_access"), F.lit(""))
    signs = [access, *[F.coalesce(C(sign), F.lit("")) for sign, trait in TRAITS.items() if getattr(truck, trait)]]
    some = lambda *values: reduce(Column.__or__, [s.isin(*values) for s in signs])
    fits = [F.coalesce(C(limit) >= getattr(truck, own), F.lit(True)) for limit, own in LIMITS.items() if getattr(truck, own) is not None]
    allowed = F.when(some(*CLOSED), False).when(access != "", True).otherwise(_flag("car"))
    usable = reduce(Column.__and__, fits, allowed & _direction("oneway") & (F.lit(True) if truck.lez_access else ~_flag("lez")))
    kmh = F.greatest(F.least(F.lit(truck.top_speed_kmh), C("speed")), F.lit(1))
    limited = some(*LIMITED) | (~some("designated") & _flag("destination"))
    factor = F.when(limited, 5.0).when(some("designated"), 0.8).otherwise(1.0) * F.when(_flag("detour"), 0.9).otherwise(1.0)
    base = F.round(C("dist") * seconds_a_metre(kmh)).cast("long")
    cost = clamp_cost(F.round(factor * C("dist") * seconds_a_metre(kmh)).cast("long") + F.when(limited, 120).otherwise(0))
    return Profile("hgv", F.when(usable, cost), F.when(usable, clamp_duration(base)), F.when(_flag("node_car"), 0), uturn=2000, turn_aware=True, turn=((46, 10), (78, 25)))


def turn_cost(angle: Column, bands: tuple) -> Column:
    """Penalties of all bands that the angle exceeds add up."""
    out = F.lit(0)
    for limit, penalty in bands:
        out = out + F.when(angle > limit, penalty).otherwise(0)
    return out


def railway_turn_cost(angle: Column) -> Column:
    """One band holds: each bin of a slight bend counts 1."""
    return F.when(angle > 64, 1000).when(angle > 43, 200).when(angle > 18, 17).otherwise(angle)


def profiles() -> dict[str, Profile]:
    return {"foot": foot(), "wheelchair": foot(wheelchair=True), "bike": bike(), "bike_fast": bike(fast=True), "car": car(), "bus": bus(), "hgv": hgv(), "railway": railway(), "ferry": ferry()}


_FLAGS = "foot bike car bus bus_penalty railway railway_penalty ferry steps big_street motor_vehicle_no sidewalk_separate destination in_route parking detour lez oneway oneway_reverse".split()
_WORDS = ("hgv_access", "hgv_access_forward", "hgv_access_backward", *TRAITS)


def settled(ways):
    """Ways with every property that a profile may ask for. A oneway sign for all holds for each kind of vehicle that has none
    of its own; limits, words and flags that are missing are not signed; a missing speed is the least class."""
    have = set(ways.columns)
    ways = ways.withColumns({n: F.lit(False) for n in _FLAGS if n not in have} | {n: F.lit(None).cast("string") for n in _WORDS if n not in have} | {n: F.lit(None).cast("int") for n in ("hgv_maxspeed_kmh", *LIMITS) if n not in have})
    return ways.withColumns({n: C("oneway") for n in ("oneway_car", "oneway_bike", "oneway_bus_psv") if n not in have} | ({} if "speed" in have else {"speed": F.lit(10)}))


def priced(edges, ways, nodes, profile: Profile, parts: int | None = None):
    """Edges with properties of their way and of the node they lead to, with cost (of way and node) and duration; infeasible
    ones are dropped. What depends on direction is settled first: the oneway sign for the profile's kind of vehicle, forward
    along that sign (which may point against the way), and the access and speed that are signed for trucks. parts: into how many
    partitions edges are dealt to meet nodes that are too many to broadcast."""
    to = nodes.select(C("node").alias("dst"), *[C(n).alias(f"node_{n}") for n in ("foot", "bike", "car", "bus", "elevator") if n in nodes.columns])
    rows = edges.join(settled(ways), "way").withColumn("_forward", C("forward"))
    access = F.coalesce(F.when(C("_forward"), C("hgv_access_forward")).otherwise(C("hgv_access_backward")), C("hgv_access"))
    speed = F.coalesce(C("hgv_maxspeed_kmh"), C("speed")) if profile.name == "hgv" else C("speed")
    rows = rows.withColumns({"oneway": _flag(profile.oneway), "forward": C("_forward") != _flag("oneway_reverse"), "hgv_access": access, "speed": speed})
    rows = rows.withColumn("cost", profile.cost).withColumn("duration", profile.duration).filter("cost is not null")
    rows = rows.select("way", "pos", "src", "dst", "to_pos", C("_forward").alias("forward"), "dist", "cost", "duration")  # what the way says goes no further
    rows = (rows.repartition(parts, "dst") if parts else rows).join(to, "dst").withColumn("cost", C("cost") + profile.node_cost)
    return rows.filter("cost is not null").select("way", "pos", "src", "dst", "to_pos", "forward", "dist", "cost", "duration")
