"""Conditional restrictions: the grammar of their keys and values, opening hours, and evaluation at a time.

Parsing is small-text work on few tags, done in Python and offered as an Arrow UDF; the parsed form is nested data, and
evaluation is Column expressions over it (or plain Python for tests), so a scan of ways never leaves the JVM for time tests."""

from __future__ import annotations

import re
from functools import reduce
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The grammar's words.
ACCESS_FIELDS = "access vehicle motor_vehicle motorcar hgv goods bus psv foot bicycle hazmat hazmat:water trailer".split()
NUMERIC_FIELDS = {"maxspeed": ("speed", 1.0), "maxlength": ("length", 100.0), "maxheight": ("length", 100.0), "maxwidth": ("length", 100.0), "maxweight": ("weight", 10.0), "maxweightrating": ("weight", 10.0), "maxaxleload": ("weight", 10.0), "maxaxles": ("none", 1.0)}
MODES = "hgv goods trailer hazmat bus psv motor_vehicle vehicle".split()
ACCESS_VALUES = "yes designated permissive private delivery destination no discouraged".split()
ONEWAY_VALUES = {"yes": "forward", "1": "forward", "true": "forward", "-1": "backward", "reverse": "backward", "no": "no", "0": "no", "false": "no"}
WEEKDAYS = ("mo", "tu", "we", "th", "fr", "sa", "su")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
UNSUPPORTED = re.compile(r"\b(PH|SH|easter|sunrise|sunset|dawn|dusk)\b|\"", re.I)
PURPOSES = ("destination", "delivery", "private")
USAGES = ("hazmat", "hazmat:water", "trailer")
PROPERTIES = "weight weightrating length height width axleload axles".split()

_FACTORS = {
    "speed": {"": 1.0, "km/h": 1.0, "kph": 1.0, "kmh": 1.0, "kmph": 1.0, "mph": 1.609344, "knots": 1.852},
    "length": {"": 1.0, "m": 1.0, "km": 1000.0, "ft": 0.3048, "in": 0.0254},
    "weight": {"": 1.0, "t": 1.0, "kg": 0.001, "st": 0.9071847, "lbs": 0.00045359237, "cwt": 0.0508},
    "none": {"": 1.0},
}


class Ignored(ValueError):
    """A clause that is well formed but not supported: it is dropped alone."""


class Malformed(ValueError):
    """A clause that cannot be read: the whole tag is dropped."""


@dataclass
class Rule:
    """One rule of opening hours; empty lists match always. Times are minutes, past 1440 on the next day."""

    years: list = field(default_factory=list)  # (from, to, step)
    weeks: list = field(default_factory=list)
    days: list = field(default_factory=list)  # month * 32 + day, from and to
    weekdays: list = field(default_factory=list)  # 1 to 7, from and to
    times: list = field(default_factory=list)
    state: str = "open"


@dataclass
class Key:
    field: str
    mode: str = ""
    direction: str = ""


def parse_key(key: str) -> Key | None:
    """field[:mode][:forward or :backward]:conditional of a known field."""
    parts = key.lower().split(":")
    if len(parts) < 2 or parts.pop() != "conditional":
        return None
    direction = parts.pop() if parts[-1] in ("forward", "backward") else ""
    for cut in (2, 1):
        name, rest = ":".join(parts[:cut]), parts[cut:]
        if (name in ACCESS_FIELDS or name in NUMERIC_FIELDS or name == "oneway") and (not rest or (len(rest) == 1 and rest[0] in MODES)):
            return Key(name, rest[0] if rest else "", direction)
    return None


def split_clauses(value: str) -> list[str]:
    """At semicolons outside parentheses."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(value):
        depth += (c == "(") - (c == ")")
        if c == ";" and depth <= 0:
            out.append(value[start:k])
            start = k + 1
    return [*out, value[start:]]


def split_and(condition: str) -> list[str]:
    return [p.strip() for p in re.split(r"&&|\s+and\s+", condition, flags=re.I)]


def parse_value(key: Key, text: str):
    """The value a clause sets: access word, one-way sense, or a number in the field's unit (None where it lifts a limit)."""
    text = text.strip().lower()
    if key.field in ACCESS_FIELDS:
        if text not in ACCESS_VALUES:
            raise Ignored(text)
        return text
    if key.field == "oneway":
        if text not in ONEWAY_VALUES:
            raise Ignored(text)
        return ONEWAY_VALUES[text]
    if text in ("none", "no", "unknown"):
        return None
    unit, factor = NUMERIC_FIELDS[key.field]
    m = re.fullmatch(r"([+-]?\d+\.?\d*|\.\d+)\s*(.*)", text)
    if not m or m[2] not in _FACTORS[unit]:
        raise Malformed(text)
    return int(float(m[1]) * _FACTORS[unit][m[2]] * factor + 0.5)


def _minute(text: str) -> int:
    m = re.fullmatch(r"(\d{1,2}):(\d{2})", text)
    if not m or int(m[1]) > 48 or int(m[2]) > 59:
        raise Malformed(text)
    return int(m[1]) * 60 + int(m[2])


_TIME = re.compile(r"^\d{1,2}:\d{2}(?:\s*-\s*\d{1,2}:\d{2}|\+)?(?:\s*,\s*\d{1,2}:\d{2}(?:\s*-\s*\d{1,2}:\d{2}|\+)?)*")
_DAYS = re.compile(r"^(?:mo|tu|we|th|fr|sa|su)(?![a-z])(?:\[[^\]]*\])?(?:\s*-\s*(?:mo|tu|we|th|fr|sa|su))?(?:\s*,\s*(?:mo|tu|we|th|fr|sa|su)(?![a-z])(?:\[[^\]]*\])?(?:\s*-\s*(?:mo|tu|we|th|fr|sa|su))?)*", re.I)
_WEEK = re.compile(r"^week\s*(\d{1,2}(?:\s*-\s*\d{1,2}(?:/\d+)?)?(?:\s*,\s*\d{1,2}(?:\s*-\s*\d{1,2}(?:/\d+)?)?)*)", re.I)
_YEAR = re.compile(r"^(\d{4})(?:\s*-\s*(\d{4})(?:/(\d+))?|(\+))?(?!\d|:)")
_MONTH = re.compile(r"^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s*(\d{1,2}(?![\d:]))?(?:\s*-\s*(?:(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s*)?(\d{1,2}(?![\d:]))?)?", re.I)


def parse_rule(text: str) -> Rule:
    rule, rest = Rule(), text.strip()
    m = re.search(r"(?:^|\s)(open|on|off|closed|unknown)$", rest, re.I)
    if m:
        rule.state = {"on": "open", "off": "closed"}.get(m[1].lower(), m[1].lower())
        rest = rest[: m.start()].strip()
    if not rest and not m:
        raise Malformed(text)
    while rest:
        rest = rest.lstrip(" ,:") if not rest.startswith("24/7") else rest
        if rest.startswith("24/7"):
            rest = rest[4:]
        elif m := _TIME.match(rest):
            for span in m[0].split(","):
                a, _, b = (x.strip() for x in span.partition("-"))
                begin = _minute(a.rstrip("+"))
                end = _minute(b) if b else 1440 if a.endswith("+") else begin + 1
                rule.times.append((begin, end + 1440 if end <= begin else end))
            rest = rest[m.end() :]
        elif m := _WEEK.match(rest):
            for span in m[1].split(","):
                w = re.fullmatch(r"\s*(\d+)(?:\s*-\s*(\d+)(?:/(\d+))?)?\s*", span)
                low, high = int(w[1]), int(w[2] or w[1])
                if not 1 <= low <= 53 or not 1 <= high <= 53:
                    raise Malformed(text)
                rule.weeks.append((low, high, int(w[3] or 1)))
            rest = rest[m.end() :]
        elif m := _YEAR.match(rest):
            rule.years.append((int(m[1]), 9999 if m[4] else int(m[2] or m[1]), int(m[3] or 1)))
            rest = rest[m.end() :]
        elif m := _DAYS.match(rest):
            for span in re.sub(r"\[[^\]]*\]", "", m[0]).lower().split(","):
                a, _, b = (x.strip() for x in span.partition("-"))
                rule.weekdays.append((WEEKDAYS.index(a) + 1, WEEKDAYS.index(b or a) + 1))
            rest = rest[m.end() :]
        elif m := _MONTH.match(rest):
            first = MONTHS.index(m[1].lower()) + 1
            second = MONTHS.index(m[3].lower()) + 1 if m[3] else first
            low = int(m[2] or 1)
            high = int(m[4]) if m[4] else (31 if m[3] or not m[2] else low)
            if low > 31 or high > 31:
                raise Malformed(text)
            rule.days.append((first * 32 + low, second * 32 + high))
            rest = rest[m.end() :]
        else:
            raise Malformed(text)
        rest = rest.strip()
    return rule


def parse_opening_hours(text: str) -> list[Rule]:
    if UNSUPPORTED.search(text):
        raise Ignored(text)
    return [parse_rule(part) for part in text.split(";")]


def parse_condition(text: str) -> dict:
    """One part of a conjunction: a purpose, a usage, a comparison of a vehicle's property, or opening hours."""
    text = text.strip()
    if text.lower() in PURPOSES:
        return {"kind": "purpose", "name": text.lower()}
    if text.lower() in USAGES:
        return {"kind": "usage", "name": text.lower()}
    m = re.fullmatch(r"([a-z]+)\s*(<=|>=|<|>|=)\s*([+-]?\d+\.?\d*)\s*(\S*)", text, re.I)
    if m:
        name = m[1].lower()
        if name not in PROPERTIES:
            raise Ignored(text)
        unit = "weight" if name in ("weight", "weightrating", "axleload") else "none" if name == "axles" else "length"
        if m[4].lower() not in _FACTORS[unit]:
            raise Malformed(text)
        scale = {"weight": 10.0, "length": 100.0, "none": 1.0}[unit]
        return {"kind": "compare", "name": name, "op": m[2], "number": int(float(m[3]) * _FACTORS[unit][m[4].lower()] * scale + 0.5)}
    if re.match(r"[a-z_]+$", text, re.I) and text.lower()[:2] not in WEEKDAYS and text.lower()[:3] not in MONTHS and text.lower() not in ("open", "on", "off", "closed", "unknown"):
        raise Ignored(text)
    return {"kind": "hours", "rules": [asdict(r) for r in parse_opening_hours(text)]}


def parse_clause(key: Key, text: str) -> dict:
    value, at, condition = text.partition("@")
    if not at or not condition.strip():
        raise Malformed(text)
    condition = condition.strip()
    if condition.startswith("(") and condition.endswith(")"):
        condition = condition[1:-1].strip()
    if not condition:
        raise Malformed(text)
    return {"value": parse_value(key, value), "conditions": [parse_condition(c) for c in split_and(condition)]}


def parse_tag(key: str, value: str) -> list[dict]:
    """The clauses of a conditional tag, in order. Unsupported clauses are dropped; one that cannot be read, or an empty one,
    drops the whole tag."""
    known = parse_key(key)
    if known is None:
        return []
    out = []
    for clause in split_clauses(value):
        if not clause.strip():
            return []
        try:
            out.append(asdict(known) | parse_clause(known, clause))
        except Ignored:
            continue
        except Malformed:
            return []
    return out


def parse_turn_restriction(value: str) -> tuple[str, list[dict]] | None:
    """Kind and conditions of a conditional turn restriction such as no_left_turn @ (Mo-Fr 07:00-09:00)."""
    kind, at, condition = value.partition("@")
    kind = kind.strip()
    if not at or not kind.startswith(("no_", "only_")):
        return None
    condition = condition.strip().removeprefix("(").removesuffix(")")
    try:
        return ("no" if kind.startswith("no_") else "only"), [parse_condition(c) for c in split_and(condition)]
    except ValueError:
        return None


# Evaluation in Python


def _within(value: int, low: int, high: int) -> bool:
    return low <= value <= high if low <= high else value >= low or value <= high


def rule_matches(rule: dict, at: datetime) -> bool:
    def date_fits(day: datetime) -> bool:
        week = day.isocalendar()[1]
        return (
            (not rule["years"] or any(a <= day.year <= b and (day.year - a) % s == 0 for a, b, s in rule["years"]))
            and (not rule["weeks"] or any(a <= week <= b and (week - a) % s == 0 for a, b, s in rule["weeks"]))
            and (not rule["days"] or any(_within(day.month * 32 + day.day, a, b) for a, b in rule["days"]))
            and (not rule["weekdays"] or any(_within(day.isoweekday(), a, b) for a, b in rule["weekdays"]))
        )

    minute = at.hour * 60 + at.minute
    if not rule["times"]:
        return date_fits(at)
    today, before = date_fits(at), date_fits(at - timedelta(days=1))
    return any((today and a <= minute < b) or (before and a <= minute + 1440 < b) for a, b in rule["times"])


def hours_match(rules: list[dict], at: datetime | None) -> bool:
    """The first rule that fits decides; no time, or no rule, is no match."""
    if at is None:
        return False
    for rule in rules:
        if rule_matches(rule, at):
            return rule["state"] != "closed"
    return False


def conditions_match(conditions: list[dict], at: datetime | None, vehicle: dict | None = None) -> bool:
    """A conjunction; purposes never match a truck in transit."""
    vehicle = vehicle or {}
    for c in conditions:
        if c["kind"] == "hours":
            ok = hours_match(c["rules"], at)
        elif c["kind"] == "compare":
            have = vehicle.get(c["name"], 0)
            ok = {"<": have < c["number"], "<=": have <= c["number"], ">": have > c["number"], ">=": have >= c["number"], "=": have == c["number"]}[c["op"]]
        else:
            ok = c["kind"] == "usage" and bool(vehicle.get(c["name"]))
        if not ok:
            return False
    return True


# Evaluation as Columns, over rules as structs of arrays of structs (low, high, step)


def wall_time(at: Column, zone: Column) -> Column:
    """The local time of a UTC time; UTC where no zone is given, or one that is not known."""
    names = list(SparkSession.active()._jvm.java.time.ZoneId.getAvailableZoneIds())
    return F.from_utc_timestamp(at, F.when(zone.isin(*names), zone).otherwise("UTC"))


def _in(value: Column, low: Column, high: Column) -> Column:
    return F.when(low <= high, (value >= low) & (value <= high)).otherwise((value >= low) | (value <= high))


def _any(spans: Column, test) -> Column:
    return (F.size(spans) == 0) | F.exists(spans, test)


def date_matches(rule: Column, day: Column) -> Column:
    stepped = lambda value: lambda s: (value >= s["low"]) & (value <= s["high"]) & ((value - s["low"]) % s["step"] == 0)
    span = lambda value: lambda s: _in(value, s["low"], s["high"])
    return _any(rule["years"], stepped(F.year(day))) & _any(rule["weeks"], stepped(F.weekofyear(day))) & _any(rule["days"], span(F.month(day) * 32 + F.dayofmonth(day))) & _any(rule["weekdays"], span(F.weekday(day) + 1))


def time_matches(rule: Column, at: Column) -> Column:
    """Spans end before their last minute; what runs past midnight belongs to the day it began on."""
    minute = F.hour(at) * 60 + F.minute(at)
    today, before = date_matches(rule, at), date_matches(rule, at - F.expr("interval 1 day"))
    return F.when(F.size(rule["times"]) == 0, today).otherwise(
        (today & F.exists(rule["times"], lambda s: (minute >= s["low"]) & (minute < s["high"]))) | (before & F.exists(rule["times"], lambda s: (minute + 1440 >= s["low"]) & (minute + 1440 < s["high"])))
    )


def hours(rules: Column, at: Column) -> Column:
    """The first of the rules that fits decides."""
    first = F.get(F.filter(rules, lambda r: time_matches(r, at)), F.lit(0))
    return F.coalesce(at.isNotNull() & (first["state"] != "closed"), F.lit(False))


SPAN = "array<struct<low:int,high:int,step:int>>"
RULES = f"array<struct<years:{SPAN},weeks:{SPAN},days:{SPAN},weekdays:{SPAN},times:{SPAN},state:string>>"


def rules_column(rules: list[Rule]) -> Column:
    """Parsed rules as a literal."""
    span = lambda s: F.struct(F.lit(s[0]).alias("low"), F.lit(s[1]).alias("high"), F.lit(s[2] if len(s) > 2 else 1).alias("step"))
    spans = lambda xs: F.array(*[span(x) for x in xs]).cast(SPAN)
    return F.array(*[F.struct(spans(r.years).alias("years"), spans(r.weeks).alias("weeks"), spans(r.days).alias("days"), spans(r.weekdays).alias("weekdays"), spans(r.times).alias("times"), F.lit(r.state).alias("state")) for r in rules]).cast(RULES)


def overridden(values: Column, default: Column) -> Column:
    """Clauses apply in order, later ones override: of structs (matches, value) the value of the last that matches."""
    return F.coalesce(F.try_element_at(F.filter(values, lambda v: v["matches"]), F.lit(-1))["value"], default)


def condition_holds(condition: dict, at: Column, vehicle: dict[str, Column]) -> Column:
    """A parsed condition as a Column: opening hours at a local time, a measure of the vehicle against a number, or a use that
    the vehicle has. A measure that is not known counts as 0, a use that is not known as none."""
    if condition["kind"] == "hours":
        rules = [r if isinstance(r, Rule) else Rule(**r) for r in condition["rules"]]
        return hours(rules_column(rules), at)
    if condition["kind"] == "compare":
        have, number = F.coalesce(vehicle.get(condition["name"], F.lit(0)).cast("double"), F.lit(0.0)), F.lit(float(condition["number"]))
        return {"<": have < number, "<=": have <= number, ">": have > number, ">=": have >= number, "=": have == number}[condition["op"]]
    return F.coalesce(vehicle.get(condition["name"], F.lit(False)), F.lit(False)) if condition["kind"] == "usage" else F.lit(False)


def conditional_value(clauses: list[dict], at: Column, vehicle: dict[str, Column], default: Column) -> Column:
    """What the clauses of a tag set at a time for a vehicle: the value of the last whose conditions all hold, else the default."""
    if not clauses:
        return default
    both = lambda c: reduce(Column.__and__, [condition_holds(x, at, vehicle) for x in c["conditions"]], F.lit(True))
    return overridden(F.array(*[F.struct(both(c).alias("matches"), F.lit(c["value"]).alias("value")) for c in clauses]), default)
