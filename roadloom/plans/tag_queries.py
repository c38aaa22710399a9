"""Queries on tags, units, levels and times, with their SQL twins; tag bags are derived from the orders by modulus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import access, conditional, scalars
from ..operators import platforms, search
from .tables import shares

QUERIES: dict = {}
SQL: dict = {}

# Key: values in turn (None: absent), and the divisor that decides how fast they turn.
BAGS = {
    "highway": (["primary", "track", None, "footway", "residential", "motorway", "cycleway", "steps", "busway", "service", "pedestrian", "elevator", "tertiary"], 1),
    "foot": ([None, "no", "yes", None, "use_sidepath", None, None], 3),
    "bicycle": ([None, "designated", None, "private", None], 5),
    "access": ([None, None, "private", None, "yes", "bus", None, "no", None, "customers", None], 7),
    "vehicle": ([None, None, "no", "destination", None, None, "yes"], 11),
    "motor_vehicle": ([None, "no", None, None, "destination", None, "yes", None, "delivery"], 13),
    "barrier": ([None, None, "gate", None, None, "wall", None, "bollard", None, "bus_trap"], 17),
    "railway": ([None, "rail", None, "tram", "construction", None, None], 19),
    "service": ([None, "yard", None, "crossover", None], 23),
    "route": ([None, None, None, "ferry", None, None, None, None], 29),
    "psv": ([None, None, "yes", None, "no"], 31),
    "sidewalk": ([None, None, None, "separate"], 37),
    "maxspeed": ([None, "50", "30 mph", "walk", "100 km/h", None, "20 knots"], 2),
    "name": ([None, "Long Lane"], 43),
    "oneway": ([None, "yes", "-1", "no", None], 47),
    "junction": ([None, None, "roundabout", "circular"], 41),
    "parking": ([None] * 11 + ["surface"], 53),
}


def bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda key: F.element_at(F.array(*[F.lit(v) for v in BAGS[key][0]]), (F.floor(F.col("o_orderkey") / BAGS[key][1]) % len(BAGS[key][0]) + 1).cast("int"))
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), value(k).alias("v")) for k in BAGS])
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("way"), F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("tags"))


def _sql_value(key: str) -> str:
    values, divisor = BAGS[key]
    return f"([{', '.join('null' if v is None else repr(v) for v in values)}])[(o_orderkey // {divisor}) % {len(values)} + 1] as {key}"


TAGS_SQL = f"t as (select o_orderkey as way, {', '.join(map(_sql_value, BAGS))} from orders)"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_DENIED = f"coalesce(access in {_in(access.ACCESS_DENY)}, false)"
_VEHICLE = f"case when vehicle in {_in(access.VEHICLE_DENY)} then 'deny' when vehicle in {_in(access.VEHICLE_ALLOW)} then 'allow' end"
_MOTOR = f"case when motor_vehicle in {_in(access.MOTOR_DENY)} then 'deny' when motor_vehicle in {_in(access.MOTOR_ALLOW)} then 'allow' end"
_CAR_RULE = f"""case when {_DENIED} or coalesce(route = 'ferry', false) or highway is null then 'deny' when access in {_in(access.ACCESS_ALLOW)} then 'allow'
  when barrier is not null and barrier not in {_in(access.OPEN_BARRIERS)} then 'deny' else coalesce({_MOTOR}, case when parking is not null then 'allow' end, {_VEHICLE}) end"""
_CAR_DEFAULT = f"coalesce(highway in {_in(access.CAR_HIGHWAYS)}, false)"
_BUS_OWN = "case when access in ('psv', 'bus') then 'allow' when psv = 'no' then 'deny' when psv is not null then 'allow' end"
_BUS_DEFAULT = f"(coalesce(highway in {_in(access.BUS_ONLY_HIGHWAYS)}, false) or {_CAR_DEFAULT})"
_RULES = {
    "foot": (
        f"case when coalesce(sidewalk = 'separate', false) or coalesce(route = 'ferry', false) or coalesce(barrier in {_in(access.CLOSED_BARRIERS)}, false) or coalesce(foot in {_in(access.FOOT_DENY)}, false) then 'deny' when foot in {_in(access.FOOT_ALLOW)} or parking is not null then 'allow' when {_DENIED} then 'deny' end",
        f"(coalesce(highway = 'elevator', false) or parking is not null or coalesce(highway in {_in(access.FOOT_HIGHWAYS)}, false))"),
    "bike": (
        f"case when coalesce(route = 'ferry', false) or coalesce(barrier in {_in(access.CLOSED_BARRIERS)}, false) or coalesce(bicycle in {_in(access.BIKE_DENY)}, false) then 'deny' when bicycle in {_in(access.FOOT_ALLOW)} then 'allow' when {_DENIED} then 'deny' else {_VEHICLE} end",
        f"coalesce(highway in {_in(access.BIKE_HIGHWAYS)}, false)"),
    "car": (_CAR_RULE, _CAR_DEFAULT),
    "bus": (
        f"case when highway is null or highway not in {_in(access.CAR_HIGHWAYS + access.BUS_ONLY_HIGHWAYS + access.BUS_POSSIBLE_HIGHWAYS)} then 'deny' when {_BUS_OWN} is not null then {_BUS_OWN} when access in {_in(access.ACCESS_ALLOW)} then 'allow' when {_DENIED} or coalesce(route = 'ferry', false) then 'deny' when barrier = 'bus_trap' then 'allow' else {_CAR_RULE} end",
        _BUS_DEFAULT),
    "rail": ("null", f"(coalesce(railway in {_in(access.RAILWAYS)}, false) and not coalesce(service in ('yard', 'spur'), false))"),
    "ferry": ("null", "coalesce(route = 'ferry', false)"),
}
_PENALTY = {
    "bus": f"(coalesce(access = 'private', false) and {_BUS_DEFAULT}) or ((coalesce({_BUS_OWN} = 'allow', false) or not {_DENIED}) and coalesce(highway = 'track', false))",
    "rail": f"coalesce(railway = 'construction', false) or (coalesce(railway in {_in(access.RAILWAYS)}, false) and coalesce(service in ('yard', 'spur', 'crossover'), false))",
}

for _name, (_rule, _default) in _RULES.items():

    def _access(spark, sf_dir, name=_name):
        t = access.Tags(F.col("tags"))
        own = {"foot": t.foot, "bike": t.bike, "car": t.car, "bus": t.bus_access, "rail": t.railway, "ferry": t.ferry_access}[name]
        penalty = {"bus": t.bus_penalty, "rail": t.railway_penalty}.get(name, F.lit(False))
        return bags(spark, sf_dir).select("way", own.alias("accessible"), penalty.alias("with_penalty"))

    QUERIES[f"access_{_name}"] = _access
    SQL[f"access_{_name}"] = f"with {TAGS_SQL} select way, coalesce(({_rule}) = 'allow', false) or ({_default} and coalesce(({_rule}) <> 'deny', true)) as accessible, {_PENALTY.get(_name, 'false')} as with_penalty from t"


def _speed_class(spark, sf_dir):
    t = access.Tags(F.col("tags"))
    return bags(spark, sf_dir).select("way", t.speed.alias("speed"), t.big_street.alias("big_street"), t.oneway.alias("oneway"), t.oneway_reverse.alias("oneway_reverse"), t.motor_vehicle_no.alias("motor_vehicle_no"), t.destination.alias("destination"))


QUERIES["speed_class"] = _speed_class
_USUAL = "case " + " ".join(f"when highway = '{k}' then {v}" for k, v in access.SPEEDS.items()) + " " + " ".join(f"when highway = '{k}' then case when name is null then {a} else {b} end" for k, (a, b) in access.SPEEDS_BY_NAME.items()) + " " + " ".join(f"when railway = '{k}' then {v}" for k, v in access.RAIL_SPEEDS.items()) + " else 10 end"
SQL["speed_class"] = f"""with {TAGS_SQL}, k as (select *, coalesce(floor(case maxspeed when '50' then 50 when '30 mph' then 30 * 1.609344 when '100 km/h' then 100 when '20 knots' then 20 * 1.852 end), {_USUAL}) as kmh from t)
select way, (select max(c) from (values (10), (20), (30), (50), (60), (80), (100), (120)) v(c) where c <= greatest(kmh, 10)) as speed,
  coalesce(highway in {_in(access.BIG_STREETS)}, false) as big_street, coalesce(oneway in ('yes', '-1'), false) or coalesce(junction = 'roundabout', false) or (coalesce(junction = 'circular', false) and oneway is null) as oneway,
  coalesce(oneway = '-1', false) as oneway_reverse, coalesce(motor_vehicle = 'no', false) or coalesce(vehicle in {_in(access.VEHICLE_DENY)}, false) as motor_vehicle_no,
  coalesce(motor_vehicle = 'destination', false) or coalesce(vehicle = 'destination', false) as destination from k"""


def _values(name: str, function, texts: list[tuple[str, float | None]]):
    """A query that parses texts, with the results as SQL values."""
    QUERIES[name] = lambda spark, sf_dir: spark.createDataFrame([(t,) for t, _ in texts], "input string").select("input", F.round(function(F.col("input")), 6).alias("value"))
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    SQL[name] = "select input, round(value, 6) as value from (values " + ", ".join(f"({quoted(t)}, {'null' if v is None else v}::double)" for t, v in texts) + ") t(input, value)"


_values("parse_length", scalars.parse_length_m, [("3.5", 3.5), (" 3.5 m ", 3.5), ("2 km", 2000), ("1mi", 1609.344), ("10 yd", 9.144), ("12 ft", 3.6576), ("5'7\"", 1.7018), ("6'", 1.8288), ("72 in", 1.8288), ("2 nmi", 3704), ("default", None), ("", None), ("3 parsecs", None)])
_values("parse_weight", scalars.parse_weight_t, [("7.5", 7.5), ("7.5 t", 7.5), ("3500 kg", 3.5), ("2 st", 1.8143694), ("1 lt", 1.016047), ("2000 lbs", 0.90718474), ("10 cwt", 0.508), ("none", None), ("5 stones", None)])
_values("parse_speed", scalars.parse_speed_kmh, [("50", 50), ("30 mph", 48.28032), ("100 km/h", 100), ("20 knots", 37.04), ("80kmh", 80), ("walk", None), ("DE:urban", None)])


def _level_codes(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", ((F.col("p_partkey") % 80 - 40) * 0.25).alias("level"))
    code = scalars.level_code(F.col("level"))
    return rows.select("p_partkey", code.alias("code"), scalars.level_value(code).alias("level"))


QUERIES["level_codes"] = _level_codes
SQL["level_codes"] = "with c as (select p_partkey, trunc((least(greatest((p_partkey % 80 - 40) * 0.25::double, -8), 7.5) + 8) / 0.25 + 1)::int as code from part) select p_partkey, code, (code - 1) * 0.25::double - 8 as level from c"


def _level_lists(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat_ws(";", (F.col("p_partkey") % 5).cast("string"), (F.col("p_partkey") % 3 - 1).cast("string"), (F.col("p_partkey") % 2).cast("string")).alias("text"))
    rows = rows.repartition(shares(spark, f"{sf_dir}/part.parquet", 1 << 18))  # lists are slow to read, and a file of many rows is small
    found = scalars.levels_of_bits(scalars.level_bits(F.col("text")))
    return rows.select("p_partkey", scalars.level_value(found["from"]).alias("lowest"), scalars.level_value(found["to"]).alias("highest"), found["multi"].alias("multi"))


QUERIES["level_lists"] = _level_lists
SQL["level_lists"] = "select p_partkey, least(p_partkey % 5, p_partkey % 3 - 1, p_partkey % 2)::double as lowest, greatest(p_partkey % 5, p_partkey % 3 - 1, p_partkey % 2)::double as highest, len(list_distinct([p_partkey % 5, p_partkey % 3 - 1, p_partkey % 2])) > 2 as multi from part"


def _elevation_code(spark, sf_dir):
    code = scalars.elevation_code(F.col("p_partkey") % 60)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", code.alias("code"), scalars.elevation_decoded(code).alias("metres"))


QUERIES["elevation_code"] = _elevation_code
_STEPS = ", ".join(f"({i}, {s})" for i, s in enumerate(scalars.ELEVATION_STEPS))
SQL["elevation_code"] = f"with s as (select * from (values {_STEPS}) v(code, metres)) select p_partkey, c.code, c.metres from part, lateral (select coalesce(min(code), 15) as code, coalesce(min(metres), 48) as metres from s where metres >= p_partkey % 60) c"

# times

_HOURS = {
    "cond_weekday_time": ("Mo-Fr 06:00-10:00", "isodow(t) between 1 and 5 and m >= 360 and m < 600"),
    "cond_midnight": ("Fr-Sa 22:00-04:00", "(isodow(t) in (5, 6) and m >= 1320) or (isodow(t - interval 1 day) in (5, 6) and m < 240)"),
    "cond_iso_week": ("week 01-53/2 Su 08:00-12:00,13:00-17:00", "week(t) % 2 = 1 and isodow(t) = 7 and ((m >= 480 and m < 720) or (m >= 780 and m < 1020))"),
    "cond_first_rule": ("Mo-Fr 09:00-17:00 open; Sa 10:00-14:00 closed; Su unknown", "(isodow(t) < 6 and m >= 540 and m < 1020) or isodow(t) = 7"),
    "cond_dates": ("2024-2026 Nov 01-Feb 15", "year(t) between 2024 and 2026 and (month(t) * 32 + day(t) >= 353 or month(t) * 32 + day(t) <= 79)"),
}
for _name, (_text, _sql) in _HOURS.items():

    def _cond(spark, sf_dir, text=_text):
        rules = conditional.rules_column(conditional.parse_opening_hours(text))
        at = conditional.wall_time(F.col("ts"), F.lit("Europe/Berlin"))
        return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", conditional.hours(rules, at).alias("matches"))

    QUERIES[_name] = _cond
    SQL[_name] = f"with e as (select event_id, timezone('Europe/Berlin', timezone('UTC', ts::timestamp)) as t from events), m as (select *, hour(t) * 60 + minute(t) as m from e) select event_id, {_sql} as matches from m"


# candidates and platforms


def _best_candidate(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").cast("long").alias("candidate"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("long")).alias("cost"))
    return search.best_candidate(rows)


QUERIES["best_candidate"] = _best_candidate
SQL["best_candidate"] = "with s as (select l_orderkey as query, l_linenumber::bigint as candidate, min(l_quantity::bigint) as cost from lineitem where l_returnflag <> 'R' group by all) select query, min(candidate) as candidate, arg_min(cost, candidate) as cost from s group by query"


def _start_rank(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("query"), (F.col("l_partkey") % 3).alias("target"), F.col("l_linenumber").cast("long").alias("rank"), F.col("l_quantity").cast("long").alias("cost"))
    return search.by_start_rank(rows.groupBy("query", "target", "rank").agg(F.min("cost").alias("cost")))


QUERIES["first_start_that_hits"] = _start_rank
SQL["first_start_that_hits"] = "with s as (select l_orderkey as query, l_partkey % 3 as target, l_linenumber::bigint as rank, min(l_quantity::bigint) as cost from lineitem where l_returnflag <> 'R' group by all) select query, target, min(rank) as rank, arg_min(cost, rank) as cost from s group by query, target"


def _direct(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr("48.0d + (p_partkey % 10) * 0.00001d").alias("lat"))
    metres = scalars.distance_m(F.lit(48.0), F.lit(9.0), F.col("lat"), F.lit(9.0))
    return rows.select("p_partkey", F.round(metres, 3).alias("metres"), F.coalesce(search.direct(metres), F.lit(-1)).cast("long").alias("cost"))


QUERIES["direct_route"] = _direct
SQL["direct_route"] = "with d as (select p_partkey, 2 * 6371000.0::double * asin(sqrt(pow(sin(radians(48.0::double + (p_partkey % 10) * 0.00001::double - 48.0::double) / 2), 2))) as metres from part) select p_partkey, round(metres, 3) as metres, (case when metres < 8 then 60 else -1 end)::bigint as cost from d"


def _platform_names(spark, sf_dir):
    tags = F.map_from_arrays(F.array(F.lit("name"), F.lit("ref")), F.array(F.concat(F.lit("Platform "), F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, " ; North").otherwise("")), F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise((F.col("p_partkey") % 9).cast("string"))))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), tags.alias("tags"))
    return platforms.platforms(rows).select("id", F.explode("names").alias("name"))


QUERIES["platform_names"] = _platform_names
SQL["platform_names"] = "with p as (select p_partkey as id, 'Platform ' || p_brand || case when p_partkey % 2 = 0 then ' ; North' else '' end as name, case when p_partkey % 3 = 0 then '' else (p_partkey % 9)::varchar end as ref from part), n as (select id, trim(unnest(string_split(ref, ';') || string_split(name, ';'))) as name from p) select id, name from n where name <> ''"
