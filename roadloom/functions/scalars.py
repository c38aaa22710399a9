"""Scalar rules as Column expressions: measures with units, levels, speeds, angles, elevations, saturating costs, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The largest cost stands for "infeasible"; durations saturate at 16 bits.
INFEASIBLE = 4294967295
MAX_DURATION = 65535
MIN_LEVEL, LEVEL_STEP, LEVELS = -8.0, 0.25, 63
SPEED_CLASSES = (10, 20, 30, 50, 60, 80, 100, 120)
ELEVATION_STEPS = (0, 1, 2, 4, 6, 8, 11, 14, 17, 21, 25, 29, 34, 38, 43, 48)
LENGTH_M = {"": 1.0, "m": 1.0, "metre": 1.0, "metres": 1.0, "meter": 1.0, "meters": 1.0, "km": 1000.0, "kilometre": 1000.0, "kilometres": 1000.0, "kilometer": 1000.0, "kilometers": 1000.0, "mi": 1609.344, "mile": 1609.344, "miles": 1609.344, "nmi": 1852.0, "yd": 0.9144, "yds": 0.9144, "ft": 0.3048, "in": 0.0254, '"': 0.0254}
WEIGHT_T = {"": 1.0, "t": 1.0, "kg": 0.001, "st": 0.9071847, "ton": 0.9071847, "tons": 0.9071847, "lt": 1.016047, "lb": 0.00045359237, "lbs": 0.00045359237, "cwt": 0.0508}
SPEED_KMH = {"": 1.0, "km/h": 1.0, "kph": 1.0, "kmh": 1.0, "kmph": 1.0, "mph": 1.609344, "knots": 1.852}
NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*(.*?)\s*$"


def clamp_cost(value: Column) -> Column:
    return F.least(F.greatest(value.cast("long"), F.lit(0)), F.lit(INFEASIBLE))


def add_costs(*parts: Column) -> Column:
    """A saturating sum: one infeasible part makes it infeasible."""
    total = parts[0].cast("long")
    for part in parts[1:]:
        total = F.least(total + part.cast("long"), F.lit(INFEASIBLE))
    return total


def clamp_duration(value: Column) -> Column:
    return F.least(F.greatest(value.cast("long"), F.lit(0)), F.lit(MAX_DURATION))


def measure(text: Column) -> tuple[Column, Column]:
    """The number a text starts with (null if none) and the trimmed rest in lower case."""
    return F.nullif(F.regexp_extract(text, NUMBER, 1), F.lit("")).try_cast("double"), F.lower(F.regexp_extract(text, NUMBER, 2))


def _scaled(text: Column, units: dict[str, float]) -> Column:
    number, unit = measure(text)
    factors = F.create_map(*[F.lit(x) for pair in units.items() for x in pair])
    return number * F.try_element_at(factors, unit)


def parse_length_m(text: Column) -> Column:
    """Metres; also feet and inches as in 5'7\" and 5'."""
    feet = F.regexp_extract(text, r"^\s*([+-]?\d+\.?\d*)\s*'\s*(?:(\d+\.?\d*)\s*\")?\s*$", 1)
    inches = F.regexp_extract(text, r"^\s*([+-]?\d+\.?\d*)\s*'\s*(?:(\d+\.?\d*)\s*\")?\s*$", 2)
    as_feet = (feet.try_cast("double") * 12.0 + F.coalesce(F.nullif(inches, F.lit("")).try_cast("double"), F.lit(0.0))) * 0.0254
    return F.when(feet != "", as_feet).otherwise(_scaled(text, LENGTH_M))


def parse_weight_t(text: Column) -> Column:
    return _scaled(text, WEIGHT_T)


def parse_speed_kmh(text: Column) -> Column:
    return _scaled(text, SPEED_KMH)


def parse_unitless(text: Column) -> Column:
    number, unit = measure(text)
    return F.when(unit == "", number)


def to_integer(value: Column, most: int, factor: float = 1.0) -> Column:
    """Rounded half away from zero and saturated; negative values give null."""
    return F.when(value >= 0, F.least(F.round(value * factor).cast("long"), F.lit(most)))


def level_code(level: Column) -> Column:
    """0 is no level; other codes are quarter steps from -8, truncated."""
    inside = F.least(F.greatest(level, F.lit(MIN_LEVEL)), F.lit(MIN_LEVEL + LEVEL_STEP * (LEVELS - 1)))
    return F.when(level.isNull(), 0).otherwise(((inside - MIN_LEVEL) / LEVEL_STEP + 1).cast("int"))


def level_value(code: Column) -> Column:
    return F.when(code == 0, F.lit(0.0)).otherwise((code - 1) * LEVEL_STEP + MIN_LEVEL)


def level_codes(text: Column) -> Column:
    """The codes of a list such as 0;1.5, sorted, each once."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, ";"), lambda x: level_code(F.trim(x).try_cast("double"))), lambda c: c > 0)))


def level_bits(text: Column) -> Column:
    return F.aggregate(level_codes(text), F.lit(0).cast("long"), lambda a, c: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), c)))


def levels_of_bits(bits: Column) -> Column:
    """from and to (the least and greatest code; the least again if alone) and whether there are more than two. The bits are bound
    once: as a plain expression they would be worked out anew for each code."""

    def told(b: Column) -> Column:
        codes = F.filter(F.sequence(F.lit(0), F.lit(LEVELS)), lambda c: F.call_function("shiftright", b, c).bitwiseAND(1) == 1)
        return F.when(b == 0, F.struct(F.lit(0).alias("from"), F.lit(0).alias("to"), F.lit(False).alias("multi"))).otherwise(F.struct(F.try_element_at(codes, F.lit(1)).alias("from"), F.try_element_at(codes, F.lit(-1)).alias("to"), (F.bit_count(b) > 2).alias("multi")))

    return F.element_at(F.transform(F.array(bits), told), 1)


def speed_class(kmh: Column) -> Column:
    """The greatest class that isn't above the speed; the least class for slower ones."""
    out = F.lit(SPEED_CLASSES[0])
    for c in SPEED_CLASSES[1:]:
        out = F.when(kmh >= c, F.lit(c)).otherwise(out)
    return out


def quantized_angle(degrees: Column) -> Column:
    return F.pmod(F.round(degrees * 256 / 360).cast("int"), F.lit(256))


def turn_angle(bearing_from: Column, bearing_to: Column) -> Column:
    """0 is straight on, 128 a full turn: of the reversed approach and the departure, the lesser way round."""
    diff = F.abs(F.pmod(bearing_from + 128, F.lit(256)) - bearing_to)
    return F.least(diff, 256 - diff)


def elevation_code(metres: Column) -> Column:
    """The first step that isn't below the metres; the last for all above."""
    steps = F.array(*[F.lit(s) for s in ELEVATION_STEPS])
    return F.least(F.size(F.filter(steps, lambda s: s < metres)), F.lit(len(ELEVATION_STEPS) - 1))


def elevation_decoded(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in ELEVATION_STEPS]), code + 1)


def osm_order(osm_id: Column) -> Column:
    """Sort key of ids: 0, then negative ids by size, then positive ones."""
    return F.struct(osm_id != 0, osm_id > 0, F.abs(osm_id))


def distance_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * 6371000.0 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


METRES_A_DEGREE = 111319.49079327358


def flat_xy(lat: Column, lng: Column, lat0: Column) -> tuple[Column, Column]:
    """Metres east and north on the plane that touches at lat0."""
    return lng * METRES_A_DEGREE * F.cos(F.radians(lat0)), lat * METRES_A_DEGREE


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    y = F.sin(F.radians(lng2 - lng1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lng2 - lng1))
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def potential_distance(dy: Column, dx: Column) -> Column:
    """A cheap bound of a planar distance, for search potentials."""
    return F.greatest(dy, dx, (dy + dx) / 1.42)


def morton(x: Column, y: Column, bits: int = 16) -> Column:
    """Bits of two small whole numbers, interleaved."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x.cast("long"), b).bitwiseAND(1), 2 * b)).bitwiseOR(F.shiftleft(F.shiftright(y.cast("long"), b).bitwiseAND(1), 2 * b + 1))
    return out
