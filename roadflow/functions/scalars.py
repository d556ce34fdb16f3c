"""Scalar rules of the traffic model as Column expressions.

All of them stay inside whole-stage code generation.  Rounding follows three
different rules on purpose: half-to-even for clocks and report frames, half-up
for speeds and lengths, integer centring for aggregation frames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")

# Speed classes of the reports, km/h.
SPEED_CLASSES_KPH = [0, 20, 40, 60]

# Road classes in rank order.
HIGHWAY_RANK = [
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary",
    "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street",
    "service", "track", "road", "path", "footway", "steps", "cycleway", "bridleway", "pedestrian",
    "construction", "proposed", "bus_guideway", "escape", "raceway", "services", "rest_area", "platform",
    "crossing", "elevator", "corridor", "abandoned", "planned", "no", "disused", "razed", "historic:",
    "busway",
]

# Map scale thresholds of the zoom levels and the classes drawn at each level.
ZOOM_THRESHOLDS = {"one": 320000, "two": 161000, "three": 40000, "four": 0}
_MAIN = ["motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link"]
_SECONDARY = ["secondary", "secondary_link"]
_TERTIARY = ["tertiary", "tertiary_link"]
_LOCAL = ["unclassified", "residential", "service", "living_street", "road", "track"]
ZOOM_CLASSES = {
    "one": _MAIN,
    "two": _MAIN + _SECONDARY,
    "three": _MAIN + _SECONDARY + _TERTIARY,
    "four": _MAIN + _SECONDARY + _TERTIARY + _LOCAL,
}


def mps_to_kph(speed: Column) -> Column:
    return speed * 3.6


def kph_to_mps(speed: Column) -> Column:
    return speed * (1000 / 3600)


def round_speed(value: Column) -> Column:
    """Half-up to a whole number; inputs are never negative."""
    return F.floor(value + 0.5).cast("int")


def round_to_step(value_us: Column, step_us: Column | int) -> Column:
    """Nearest multiple of ``step_us``, ties to the even multiple."""
    step = F.lit(step_us) if isinstance(step_us, int) else step_us
    return (F.bround(value_us / step) * step).cast("bigint")


def round_datetime(ts: Column, step_s: int) -> Column:
    """Snap the minute-and-second part (or the second part) of a timestamp to ``step_s`` seconds."""
    if step_s > 3600:
        raise ValueError("rounding step above one hour")
    if step_s <= 1:
        raise ValueError("rounding step of one second or less")
    unit = "HOUR" if step_s > 60 else "MINUTE"
    base = F.date_trunc(unit, ts).cast("timestamp_ntz")
    rest_us = F.timestamp_diff("MICROSECOND", base, ts)
    return F.timestamp_add("MICROSECOND", round_to_step(rest_us, step_s * 1000000), base).cast("timestamp_ntz")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp read as UTC."""
    zero = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return F.timestamp_diff("MICROSECOND", zero, ts) / 1000000


def report_frame(timestamp_s: Column, speed: float = 1, fps: float = 1) -> Column:
    """Frame number of the pandas-style reports (ties to even)."""
    interval = speed / fps
    return F.bround((timestamp_s * 1000) / (1000 * interval)).cast("bigint")


def centred_frame(timestamp_s: Column, interval_s: int) -> Column:
    """Frame number of the aggregation: integer centring, ties go up."""
    return F.floor((timestamp_s + interval_s // 2) / interval_s).cast("bigint")


def first_half(offset_m: Column, length_m: Column) -> Column:
    """True when the offset lies in the first half of the segment, compared in single precision."""
    ratio = F.try_divide(offset_m.cast("float"), length_m.cast("float")).cast("float")
    return F.when(length_m > 0, ratio < F.lit(0.5).cast("float")).otherwise(F.lit(True))


def travel_time(length_m: Column, speed_kph: Column) -> Column:
    """Seconds to pass a segment; infinite where it is closed."""
    return F.when(speed_kph == 0, F.lit(INFINITY)).otherwise(
        length_m.cast("double") / (F.nullif(speed_kph, F.lit(0)).cast("double") / 3.6)
    )


def segment_weight(length_m: Column, node_from: Column, node_to: Column) -> Column:
    """Length with the node digits as a fractional tie-breaker."""
    return length_m + F.concat(F.lit("0."), node_from.cast("string"), node_to.cast("string")).cast("double")


def segment_label(node_from: Column, node_to: Column) -> Column:
    return F.concat(F.lit("OSM"), node_from.cast("string"), F.lit("T"), node_to.cast("string"))


def route_segment_labels(route: Column) -> Column:
    """Labels of the n-1 segments of a route of n nodes."""
    return F.zip_with(
        F.slice(route, 1, F.greatest(F.size(route) - 1, F.lit(0))),
        F.slice(route, 2, F.greatest(F.size(route) - 1, F.lit(0))),
        segment_label,
    )


def drop_repeats(route: Column) -> Column:
    """Collapse equal neighbours of a route."""
    return F.filter(route, lambda node, i: (i == 0) | (node != F.get(route, i - 1)))


def week_offset_ms(start: Column, offset_us: Column) -> Column:
    """Milliseconds since Monday 00:00 of the start week, modulo one week.

    The Monday keeps the microseconds of the start, so they cancel out.
    """
    monday = F.date_trunc("WEEK", start).cast("timestamp_ntz")
    since = F.timestamp_diff("MICROSECOND", monday, F.date_trunc("SECOND", start).cast("timestamp_ntz"))
    return F.pmod(since + offset_us, F.lit(7 * 86400 * 1000000)) / 1000


def coord_to_int(value: Column) -> Column:
    return F.bround(value * 1000000).cast("int")


def speed_or_default(current: Column, limit: Column, tag: Column) -> Column:
    """Current speed, else limit, else the first digits of the tag, else 50."""
    digits = F.nullif(F.regexp_extract(tag, r"(\d+)", 1), F.lit("")).cast("int")
    return F.coalesce(current.cast("int"), limit.cast("int"), digits, F.lit(50))


def lanes_per_direction(lanes: Column, oneway: Column) -> Column:
    """Lane count of one direction from a list of tag values.

    A list of several values takes the largest numeric one; anything unusable
    counts as one lane; two-way roads share their lanes.
    """
    numeric = F.filter(lanes, lambda v: v.rlike(r"^\d+$"))
    largest = F.coalesce(F.array_max(F.transform(numeric, lambda v: v.cast("int"))), F.lit(1))
    shared = F.when(~oneway & (largest > 1), F.floor((largest + 1) / 2).cast("int")).otherwise(largest)
    return F.greatest(shared, F.lit(1)).cast("int")


def first_speed(tags: Column) -> Column:
    """First tag value as a number, -1 where there is none."""
    return F.coalesce(F.get(tags, 0).try_cast("double"), F.lit(-1.0))


def first_class(tags: Column) -> Column:
    return F.coalesce(F.get(tags, 0), F.lit("unknown"))


def sort_classes(tags: Column) -> Column:
    """Sort a multi-valued class list by rank."""
    rank = F.array(*[F.lit(c) for c in HIGHWAY_RANK])
    ranked = F.transform(tags, lambda c: F.struct(F.array_position(rank, c).alias("r"), c.alias("c")))
    return F.transform(F.array_sort(ranked), lambda s: s["c"])


def wkt_numbers(wkt: Column) -> Column:
    return F.transform(F.regexp_extract_all(wkt, F.lit(r"(-?\d+(?:\.\d+)?(?:[eE]-?\d+)?)"), 1), lambda v: v.cast("double"))


def wkt_bounds(wkt: Column) -> Column:
    """Envelope of a planar WKT geometry as a struct."""
    numbers = wkt_numbers(wkt)
    xs = F.filter(numbers, lambda v, i: i % 2 == 0)
    ys = F.filter(numbers, lambda v, i: i % 2 == 1)
    return F.struct(
        F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"),
        F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"),
    )


def box_centre(bounds: Column) -> Column:
    return F.struct(
        ((bounds["min_x"] + bounds["max_x"]) / 2).alias("x"), ((bounds["min_y"] + bounds["max_y"]) / 2).alias("y")
    )


def coordinate_text(value: Column) -> Column:
    """Shortest digits of a coordinate that round-trip, without an exponent from 1e-4 on.

    Spark writes an exponent below 1e-3 already.  Digits are moved as text, so none is lost.
    """
    text = value.cast("string")
    digits = F.replace(F.regexp_replace(text, r"^-|(\.0)?E-4$", ""), F.lit("."), F.lit(""))
    small = F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), F.lit("0.000"), digits)
    return F.when(text.endswith("E-4"), small).otherwise(text)


def straight_line(lon_from: Column, lat_from: Column, lon_to: Column, lat_to: Column) -> Column:
    """WKT of a straight edge; the number text is the shortest one that round-trips."""
    lon_from, lat_from, lon_to, lat_to = (coordinate_text(c) for c in (lon_from, lat_from, lon_to, lat_to))
    return F.concat(
        F.lit("LINESTRING ("), lon_from, F.lit(" "), lat_from, F.lit(", "), lon_to, F.lit(" "), lat_to, F.lit(")"),
    )


def zoned_time(text: Column) -> Column:
    """Timestamp from text whose zone has only an hour part, such as ``+02``."""
    return F.to_timestamp(F.concat(text, F.lit("00")), "yyyy-MM-dd HH:mm:ssZ")


def clock_seconds(text: Column) -> Column:
    """Seconds since midnight of an ``H:MM:SS`` text."""
    parts = F.transform(F.split(text, ":"), lambda v: v.cast("bigint"))
    return F.get(parts, 0) * 3600 + F.get(parts, 1) * 60 + F.get(parts, 2)


def box_name(north: Column, west: Column, south: Column, east: Column) -> Column:
    joined = F.concat_ws("-", *[c.cast("string") for c in (north, west, south, east)])
    return F.replace(joined, F.lit("."), F.lit("_"))


def admin_road_filter(admin_level: Column) -> Column:
    """Regular expression of the road classes kept at an administrative level; null keeps all."""
    return F.when(admin_level <= 2, F.lit("motorway|trunk|primary")).when(
        admin_level <= 6, F.lit("motorway|trunk|primary|secondary")
    )


def zoom_level(map_width_deg: Column, window_width_in: Column) -> Column:
    """Zoom level from the ratio of map inches to screen inches."""
    ratio = map_width_deg / window_width_in * 111 * 39370.0787
    level = F.lit(None).cast("string")
    for name, threshold in reversed(ZOOM_THRESHOLDS.items()):
        level = F.when(ratio > threshold, F.lit(name)).otherwise(level)
    return level


def drawn_at(highway: Column, level: str) -> Column:
    return highway.isin(ZOOM_CLASSES[level])


def speed_colour(speed_kph: Column) -> Column:
    """Colour bucket of a segment speed; null below zero."""
    return (
        F.when(speed_kph < 0, F.lit(None).cast("string"))
        .when(speed_kph < 20, F.lit("red")).when(speed_kph < 40, F.lit("orange")).otherwise(F.lit("green"))
    )


def percentage(value: Column, total: Column) -> Column:
    return F.bround(F.try_divide(value, total) * 100, 2)


def decimal_comma(value: Column) -> Column:
    """Shortest text of a double with a decimal comma."""
    return F.replace(value.cast("string"), F.lit("."), F.lit(","))


def interpolate_array(values: Column, points: Column) -> Column:
    """Resample an array of part values to ``points`` positions by linear interpolation.

    Position ``i`` reads the array at ``i * n / points``; past the last part the
    value stays constant.
    """
    n = F.size(values)

    def at(i: Column) -> Column:
        x = i * n / points
        low = F.least(F.floor(x).cast("int"), n - 1)
        high = F.least(low + 1, n - 1)
        share = F.least(x - low, F.lit(1.0))
        a, b = F.get(values, low), F.get(values, high)
        return a + (b - a) * share

    return F.when((points > 0) & (n > 0), F.transform(F.sequence(F.lit(0), points - 1), at))


def drawn_parts(densities: Column, speeds: Column, points: Column, delete_unseen: Column) -> Column:
    """Values along a drawn segment: array of ``(point, density, speed)``.

    Parts without a speed (-1) are either left out before resampling, so their
    neighbours spread over the segment, or resampled as they are, and points
    that come out below zero deleted.  Null where no part has a speed and none
    is to be deleted.
    """
    seen = F.when(delete_unseen, speeds).otherwise(F.filter(speeds, lambda v: v != -1))
    density, speed = interpolate_array(densities, points), interpolate_array(seen, points)
    rows = F.zip_with(F.zip_with(F.sequence(F.lit(0), points - 1), density, lambda i, d: F.struct(i.alias("i"), d.alias("d"))), speed,
                      lambda a, v: F.struct(a["i"].alias("point"), a["d"].alias("density"), v.alias("speed")))
    return F.when(speed.isNotNull(), F.when(delete_unseen, F.filter(rows, lambda r: r["speed"] >= 0)).otherwise(rows))


def duration_text(seconds: Column) -> Column:
    """Whole seconds as ``H:MM:SS``, with days in front where there are any."""
    whole = F.bround(seconds, 0).cast("bigint")
    days, rest = F.floor(whole / 86400), whole % 86400
    clock = F.format_string("%d:%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    return F.concat(F.when(days == 0, F.lit("")).when(days == 1, F.lit("1 day, ")).otherwise(F.concat(days.cast("string"), F.lit(" days, "))), clock)


def totals_text(metres: Column, seconds: Column) -> Column:
    """Two lines on driving time and distance; a null time counts as none."""
    km = F.regexp_replace(F.bround(metres / 1000, 2).cast("decimal(30,2)").cast("string"), "0$", "")
    # The wording of the two lines.
    return F.concat(
        F.lit("Total driving time (sum of all cars): "), duration_text(F.coalesce(seconds, F.lit(0.0))),
        F.lit("\nTotal KMs driven: "), km, F.lit(" km\n"),
    )


def finished_text(finished: Column, vehicles: Column, active: Column) -> Column:
    # The wording of the two lines.
    return F.concat(
        F.lit("Finished vehicles: "), finished.cast("string"), F.lit(" / "), vehicles.cast("string"),
        F.lit("\nActive vehicles: "), active.cast("string"),
    )


def polyline_point(line: Column, fraction: Column) -> Column:
    """Point at a length fraction of a polyline given as an array of ``(x, y)`` structs."""
    legs = F.zip_with(
        F.slice(line, 1, F.size(line) - 1),
        F.slice(line, 2, F.size(line) - 1),
        lambda a, b: F.struct(
            a["x"].alias("x"), a["y"].alias("y"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"),
            F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("d"),
        ),
    )
    total = F.aggregate(legs, F.lit(0.0), lambda acc, s: acc + s["d"])
    target = total * F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0))
    start = F.struct(F.lit(0.0).alias("done"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))

    def walk(acc: Column, leg: Column) -> Column:
        here = acc["x"].isNull() & (acc["done"] + leg["d"] >= target)
        share = F.coalesce(F.try_divide(target - acc["done"], leg["d"]), F.lit(0.0))
        return F.struct(
            (acc["done"] + leg["d"]).alias("done"),
            F.when(here, leg["x"] + leg["dx"] * share).otherwise(acc["x"]).alias("x"),
            F.when(here, leg["y"] + leg["dy"] * share).otherwise(acc["y"]).alias("y"),
        )

    found = F.aggregate(legs, start, walk)
    last = F.element_at(line, -1)
    return F.struct(F.coalesce(found["x"], last["x"]).alias("x"), F.coalesce(found["y"], last["y"]).alias("y"))
