"""Access and property rules over a map of tags, one Column each. As a map has no order, repeated keys have one value; where
several keys set one property, the more specific key wins (bus over psv, motor_vehicle:forward over motor_vehicle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import level_bits, levels_of_bits, parse_length_m, parse_speed_kmh, parse_unitless, parse_weight_t, speed_class, to_integer

ALLOW, DENY = "allow", "deny"
# Tag values by rule.
FOOT_HIGHWAYS = "primary primary_link secondary secondary_link tertiary tertiary_link unclassified residential road living_street service track path steps pedestrian platform corridor footway pier".split()
BIKE_HIGHWAYS = "cycleway primary primary_link secondary secondary_link tertiary tertiary_link residential unclassified living_street road service track path".split()
CAR_HIGHWAYS = "motorway motorway_link trunk trunk_link primary primary_link secondary secondary_link tertiary tertiary_link residential living_street unclassified service".split()
BUS_ONLY_HIGHWAYS = "busway bus_guideway".split()
BUS_POSSIBLE_HIGHWAYS = "pedestrian track".split()
RAILWAYS = "rail light_rail monorail narrow_gauge subway tram funicular".split()
CLOSED_BARRIERS = "yes wall fence".split()
OPEN_BARRIERS = "cattle_grid border_control toll_booth sally_port gate lift_gate no entrance coupure height_restrictor arch".split()
GATES = "gate lift_gate swing_gate".split()
FOOT_DENY, FOOT_ALLOW = "no private use_sidepath".split(), "yes permissive designated".split()
BIKE_DENY = "no private optional_sidepath use_sidepath".split()
MOTOR_DENY = ["private", "optional_sidepath", "agricultural", "forestry", "agricultural;forestry", "permit", "customers", "delivery", "no"]
MOTOR_ALLOW = "designated permissive yes".split()
ACCESS_DENY = "no agricultural forestry emergency delivery private psv bus".split()
ACCESS_ALLOW = "designated dismount customers permissive yes".split()
VEHICLE_DENY, VEHICLE_ALLOW = "private delivery no".split(), "destination permissive yes".split()
ACCESS_VALUES = "yes designated permissive private delivery destination no discouraged".split()
PUBLIC_ROUTES = "bus trolleybus minibus share_taxi train light_rail subway tram monorail ferry funicular".split()
BIG_STREETS = "motorway motorway_link trunk trunk_link primary primary_link secondary secondary_link tertiary tertiary_link unclassified".split()
SPEEDS = {"motorway": 100, "motorway_link": 45, "trunk": 85, "trunk_link": 40, "primary_link": 30, "secondary_link": 25, "tertiary_link": 20, "unclassified": 40, "residential": 20, "living_street": 10, "service": 20, "track": 12, "path": 13, "bus_guideway": 50, "busway": 50}
SPEEDS_BY_NAME = {"primary": (80, 40), "secondary": (80, 60), "tertiary": (60, 40)}
RAIL_SPEEDS = {"rail": 80, "narrow_gauge": 80, "light_rail": 50, "subway": 50, "tram": 30}
PARKING_AMENITIES = "parking parking_entrance".split()
PLATFORMS = "platform stop_position".split()


class Tags:
    """Rules over one map column; kind is way, node or relation."""

    def __init__(self, tags: Column, kind: str = "way"):
        self.tags, self.kind = tags, kind

    def __getitem__(self, key: str) -> Column:
        return F.coalesce(F.try_element_at(self.tags, F.lit(key)), F.lit(""))

    def has(self, *keys: str) -> Column:
        out = F.lit(False)
        for key in keys:
            out = out | F.coalesce(F.map_contains_key(self.tags, F.lit(key)), F.lit(False))
        return out

    # properties

    @property
    def route(self) -> Column:
        return (self["type"] == "route") if self.kind == "relation" else F.lit(False)

    @property
    def ferry(self) -> Column:
        return self["route"] == "ferry"

    @property
    def in_route(self) -> Column:
        return self.route & self["route"].isin(PUBLIC_ROUTES)

    @property
    def detour(self) -> Column:
        return self.route & (self["route"] == "detour")

    @property
    def elevator(self) -> Column:
        return self["highway"] == "elevator"

    @property
    def parking(self) -> Column:
        return self.has("parking") | self["amenity"].isin(PARKING_AMENITIES) | (self["building"] == "parking")

    @property
    def platform(self) -> Column:
        return (self.has("platform_edge") | self["public_transport"].isin(PLATFORMS) | (self["highway"] == "bus_stop")) & ~self.has("construction")

    @property
    def landuse(self) -> Column:
        return self.has("landuse", "building") | (self["railway"] == "station_area")

    @property
    def sidewalk_separate(self) -> Column:
        return (self["sidewalk"] == "separate") | (self["sidewalk:both"] == "separate") | (self["sidewalk:left"] == "separate") | (self["sidewalk:right"] == "separate")

    @property
    def oneway(self) -> Column:
        circular = (self["junction"] == "circular") & ~self.has("oneway")
        return self["oneway"].isin("yes", "-1") | (self["junction"] == "roundabout") | circular

    @property
    def oneway_reverse(self) -> Column:
        return self["oneway"] == "-1"

    @property
    def oneway_bike(self) -> Column:
        return self.oneway & (self["oneway:bicycle"] != "no")

    @property
    def oneway_bus(self) -> Column:
        free = (self["oneway:bus"] == "no") | (self["oneway:psv"] == "no")
        for key in ("busway", "busway:left", "busway:right", "busway:both"):
            free = free | (self[key] == "opposite_lane")
        return self.oneway & ~free

    @property
    def motor_vehicle(self) -> Column:
        return F.coalesce(F.nullif(self["motor_vehicle:forward"], F.lit("")), self["motor_vehicle"])

    @property
    def destination(self) -> Column:
        return (self["motor_vehicle"] == "destination") | (self["motor_vehicle:forward"] == "destination") | (self["motorcar"] == "destination") | (self["vehicle"] == "destination")

    @property
    def private(self) -> Column:
        return self["access"] == "private"

    @property
    def steps(self) -> Column:
        return self["highway"] == "steps"

    @property
    def incline_down(self) -> Column:
        return (self["incline"] == "down") | self["incline"].startswith("-")

    @property
    def ramp(self) -> Column:
        return (self.has("ramp") & (self["ramp"] != "no")) | ((self["highway"] == "footway") & self.has("incline"))

    @property
    def motor_vehicle_no(self) -> Column:
        return (self.motor_vehicle == "no") | self["vehicle"].isin(VEHICLE_DENY)

    @property
    def toll(self) -> Column:
        return self["toll"] == "yes"

    @property
    def big_street(self) -> Column:
        return self["highway"].isin(BIG_STREETS)

    @property
    def name(self) -> Column:
        """The name, or else the reference number."""
        return F.coalesce(F.nullif(self["name"], F.lit("")), F.nullif(self["ref"], F.lit("")))

    @property
    def conditional_closure(self) -> Column:
        """The condition of a conditional closure, as written."""
        return F.nullif(F.regexp_extract(self["access:conditional"], r"(?s)^no @ \((.*)\)$", 1), F.lit(""))

    @property
    def level_bits(self) -> Column:
        return level_bits(F.concat_ws(";", F.try_element_at(self.tags, F.lit("level")), F.try_element_at(self.tags, F.lit("indoor:level"))))

    @property
    def speed(self) -> Column:
        """The class of the signed speed, or of the road's usual one."""
        usual = F.lit(10)
        for kind, kmh in RAIL_SPEEDS.items():
            usual = F.when(self["railway"] == kind, kmh).otherwise(usual)
        for kind, (without, with_name) in SPEEDS_BY_NAME.items():
            usual = F.when(self["highway"] == kind, F.when(self["name"] == "", without).otherwise(with_name)).otherwise(usual)
        for kind, kmh in SPEEDS.items():
            usual = F.when(self["highway"] == kind, kmh).otherwise(usual)
        return speed_class(F.coalesce(F.floor(parse_speed_kmh(self["maxspeed"])), usual))

    # overrides by rule: allow, deny or null

    @property
    def access(self) -> Column:
        return F.when(self["access"].isin(ACCESS_DENY), DENY).when(self["access"].isin(ACCESS_ALLOW), ALLOW)

    @property
    def vehicle(self) -> Column:
        return F.when(self["vehicle"].isin(VEHICLE_DENY), DENY).when(self["vehicle"].isin(VEHICLE_ALLOW), ALLOW)

    @property
    def bus(self) -> Column:
        own = lambda key: F.when(self.has(key), F.when(self[key] == "no", DENY).otherwise(ALLOW))
        return F.coalesce(F.when(self["access"].isin("psv", "bus"), ALLOW), own("bus"), own("psv"))

    def _accessible(self, override: Column, default: Column) -> Column:
        return F.coalesce(override == ALLOW, F.lit(False)) | (default & F.coalesce(override != DENY, F.lit(True)))

    def _is_way(self) -> bool:
        return self.kind != "node"

    @property
    def foot(self) -> Column:
        rule = (
            F.when(self.route | self.sidewalk_separate | self.ferry | self["barrier"].isin(CLOSED_BARRIERS) | self["foot"].isin(FOOT_DENY), DENY)
            .when(self["foot"].isin(FOOT_ALLOW) | self.platform | self.parking, ALLOW)
            .when(self.access == DENY, DENY)
        )
        return self._accessible(rule, self.elevator | self.parking | self["highway"].isin(FOOT_HIGHWAYS) if self._is_way() else F.lit(True))

    @property
    def bike(self) -> Column:
        rule = (
            F.when(self.route | self.ferry | self["barrier"].isin(CLOSED_BARRIERS) | self["bicycle"].isin(BIKE_DENY), DENY)
            .when(self["bicycle"].isin(FOOT_ALLOW), ALLOW)
            .when(self.access == DENY, DENY)
            .otherwise(self.vehicle)
        )
        return self._accessible(rule, self["highway"].isin(BIKE_HIGHWAYS) if self._is_way() else F.lit(True))

    @property
    def _car_rule(self) -> Column:
        motor = lambda value: F.when(value.isin(MOTOR_DENY), DENY).when(value.isin(MOTOR_ALLOW), ALLOW)
        nowhere = (self["highway"] == "") if self.kind == "way" else F.lit(False)
        return (
            F.when((F.coalesce(self.access, F.lit("")) == DENY) | self.route | self.ferry | nowhere, DENY)
            .when(self.access == ALLOW, ALLOW)
            .when((self["barrier"] != "") & ~self["barrier"].isin(OPEN_BARRIERS), DENY)
            .otherwise(F.coalesce(motor(self.motor_vehicle), motor(self["motorcar"]), F.when(self.parking, ALLOW), self.vehicle))
        )

    @property
    def _car_default(self) -> Column:
        return self["highway"].isin(CAR_HIGHWAYS) if self._is_way() else F.lit(True)

    @property
    def car(self) -> Column:
        return self._accessible(self._car_rule, self._car_default)

    @property
    def _bus_default(self) -> Column:
        return self["highway"].isin(BUS_ONLY_HIGHWAYS) | self._car_default

    @property
    def bus_access(self) -> Column:
        if self.kind == "relation":
            return F.lit(False)
        possible = self["highway"].isin(CAR_HIGHWAYS + BUS_ONLY_HIGHWAYS + BUS_POSSIBLE_HIGHWAYS) if self.kind == "way" else F.lit(True)
        access = F.coalesce(self.access, F.lit(""))
        rule = F.when(~possible, DENY).when(self.bus.isNotNull(), self.bus).when(access == ALLOW, ALLOW).when((access == DENY) | self.route | self.ferry, DENY).when(self["barrier"] == "bus_trap", ALLOW).otherwise(self._car_rule)
        return self._accessible(rule, self._bus_default)

    @property
    def bus_penalty(self) -> Column:
        if self.kind == "node":
            return self.private & self["barrier"].isin(GATES)
        if self.kind == "relation":
            return F.lit(False)
        usable = (F.coalesce(self.bus, F.lit("")) == ALLOW) | (F.coalesce(self.access, F.lit("")) != DENY)
        return (self.private & self._bus_default) | (usable & (self["highway"] == "track"))

    @property
    def railway(self) -> Column:
        if self.kind == "node":
            return F.lit(True)
        return F.lit(False) if self.kind == "relation" else self["railway"].isin(RAILWAYS) & ~self["service"].isin("yard", "spur")

    @property
    def railway_penalty(self) -> Column:
        if self.kind != "way":
            return F.lit(False)
        return (self["railway"] == "construction") | (self["railway"].isin(RAILWAYS) & self["service"].isin("yard", "spur", "crossover"))

    @property
    def ferry_access(self) -> Column:
        return self.ferry if self._is_way() else F.lit(True)

    def way_properties(self) -> dict[str, Column]:
        levels = levels_of_bits(self.level_bits)
        return {
            "foot": self.foot, "bike": self.bike, "car": self.car, "bus": self.bus_access, "bus_penalty": self.bus_penalty, "railway": self.railway, "railway_penalty": self.railway_penalty, "ferry": self.ferry_access,
            "destination": self.destination, "oneway_car": self.oneway, "oneway_bike": self.oneway_bike, "oneway_bus_psv": self.oneway_bus, "oneway_reverse": self.oneway_reverse,
            "elevator": self.elevator, "steps": self.steps, "ramp": self.ramp, "parking": self.parking, "platform": self.platform, "sidewalk_separate": self.sidewalk_separate, "motor_vehicle_no": self.motor_vehicle_no,
            "toll": self.toll, "big_street": self.big_street, "in_route": self.in_route, "incline_down": self.incline_down, "detour": self.detour, "speed": self.speed, "from_level": levels["from"], "to_level": levels["to"], "name": self.name,
        }

    def node_properties(self) -> dict[str, Column]:
        levels = levels_of_bits(self.level_bits)
        return {"foot": self.foot, "bike": self.bike, "car": self.car, "bus": self.bus_access, "bus_penalty": self.bus_penalty, "elevator": self.elevator, "entrance": self.has("entrance"), "parking": self.parking, "multi_level": levels["multi"], "from_level": levels["from"], "to_level": levels["to"], "level_bits": self.level_bits}

    def hgv_info(self) -> dict[str, Column]:
        """What is signed for trucks; null where nothing is. Tags for trucks go before those for all."""
        known = lambda value: F.when(value.isin(ACCESS_VALUES), value)
        own = lambda key: F.coalesce(F.nullif(self[f"{key}:hgv"], F.lit("")), self[key])
        wide = 65535
        return {
            "access_forward": F.coalesce(known(self["hgv:forward"]), known(self["hgv"])),
            "access_backward": F.coalesce(known(self["hgv:backward"]), known(self["hgv"])),
            "maxspeed_kmh": to_integer(parse_speed_kmh(self["maxspeed:hgv"]), 255),
            "maxlength_cm": to_integer(parse_length_m(own("maxlength")), wide, 100.0),
            "maxweightrating_100kg": to_integer(parse_weight_t(own("maxweightrating")), wide, 10.0),
            "maxheight_cm": to_integer(parse_length_m(self["maxheight"]), wide, 100.0),
            "maxwidth_cm": to_integer(parse_length_m(self["maxwidth"]), wide, 100.0),
            "maxweight_100kg": to_integer(parse_weight_t(self["maxweight"]), wide, 10.0),
            "maxaxleload_100kg": to_integer(parse_weight_t(self["maxaxleload"]), wide, 10.0),
            "maxaxles": to_integer(parse_unitless(self["maxaxles"]), 255),
            "hazmat": known(self["hazmat"]),
            "hazmat_water": known(self["hazmat:water"]),
            "trailer": known(self["hgv:trailer"]),
        }
