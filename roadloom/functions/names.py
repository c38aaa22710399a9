"""Names of profiles, algorithms, directions and modes; ids with a sign bit."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from .costs import Profile, bike, bus, car, ferry, foot, hgv, railway

# Profile names, and what each is built from.
PROFILES = {
    "foot": foot, "wheelchair": lambda: foot(wheelchair=True), "bike": bike, "bike_fast": lambda: bike(fast=True), "bike_elevation_low": lambda: bike(climb=570), "bike_elevation_high": lambda: bike(climb=3700),
    "bus": bus, "car": car, "hgv": hgv, "railway": railway, "ferry": ferry,
}
#: Profiles of two parts: the vehicle's profile, the one on foot, and whether leaving the vehicle needs a parking place.
TWO_PART = {"car_dropoff": ("car", "foot", False), "car_dropoff_wheelchair": ("car", "wheelchair", False), "car_parking": ("car", "foot", True), "car_parking_wheelchair": ("car", "wheelchair", True)}
#: Profiles of three parts: on foot, by shared vehicle, on foot again.
SHARED = {"bike_sharing": "bike", "car_sharing": "car"}
ALGORITHMS = ("dijkstra", "astar", "bidirectional")
SIGN = 1 << 63


class Direction(Enum):
    FORWARD = "forward"
    BACKWARD = "backward"

    def flipped(self) -> Direction:
        return Direction.BACKWARD if self is Direction.FORWARD else Direction.FORWARD


def profile(name: str) -> Profile:
    if name not in PROFILES:
        raise ValueError(f"{name} is no profile of one part; known: {', '.join([*PROFILES, *TWO_PART, *SHARED])}")
    return PROFILES[name]()


def algorithm(name: str) -> str:
    """All algorithms give the same costs, so the name picks how a search is bounded, never what it finds."""
    if name not in ALGORITHMS:
        raise ValueError(f"{name} is no algorithm; known: {', '.join(ALGORITHMS)}")
    return name


def direction(name: str) -> Direction:
    return Direction(name)


def encode_id(osm_id: int) -> int:
    """Negative ids as their complement with the sign bit set."""
    return osm_id if osm_id >= 0 else SIGN | (-(osm_id + 1))


def id_code(osm_id: Column) -> Column:
    """encode_id as a Column: the code's bits as a signed number."""
    return F.when(osm_id >= 0, osm_id).otherwise(F.bitwise_not(osm_id).bitwiseOR(F.lit(-SIGN).cast("long")))


def id_of_code(code: Column) -> Column:
    return F.when(code >= 0, code).otherwise(F.bitwise_not(code.bitwiseAND(F.lit(SIGN - 1).cast("long"))))


def decode_id(code: int) -> int:
    return -(code & (SIGN - 1)) - 1 if code & SIGN else code
