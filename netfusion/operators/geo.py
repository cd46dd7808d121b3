"""Towers, trajectories, hotspots and coordinates of places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Place, latitude, longitude, zone, tower id.
COORDINATES = (
    ("Dockside Ward", 18.9438, 72.8423, "South Coast Docks", "TOW-001"),
    ("Old Market Circle", 18.9512, 72.8315, "Central Commercial", "TOW-002"),
    ("Riverside Colony", 19.0178, 72.8478, "Riverfront Sector", "TOW-003"),
    ("Industrial Estate Road", 19.0024, 72.8310, "Industrial Zone", "TOW-004"),
    ("Central Junction", 19.0760, 72.8777, "Transit Hub", "TOW-005"),
    ("Eastgate", 19.0596, 72.8295, "Coastal Gateway", "TOW-006"),
    ("Hilltop Society", 19.0688, 72.8350, "Uptown Sector", "TOW-007"),
    ("Station Road", 18.9700, 72.8180, "Terminal Sector", "TOW-008"),
    ("New Colony", 19.1136, 72.8697, "North Industrial", "TOW-009"),
    ("Warehouse District", 19.0330, 72.8600, "Freight Yards", "TOW-010"),
    ("North Bypass", 19.1726, 72.8566, "Highway Arterial", "TOW-011"),
    ("Lakeview Chowk", 19.1250, 72.9050, "Eastern Periphery", "TOW-012"),
)
CENTER = (19.0450, 72.8550)
CORE_CELLS = ("A", "B", "C")


def coordinates(place: Column) -> Column:
    """struct(lat, lng, zone, tower_id) of a place name: the first known place of which either name holds the other, else a point near the
    centre derived from the name's md5. Null or empty has no coordinates."""
    kinds = "struct<lat:double,lng:double,zone:string,tower_id:string>"
    point = lambda lat, lng, zone, tower: F.struct(F.lit(lat).cast("double").alias("lat"), F.lit(lng).cast("double").alias("lng"), F.lit(zone).alias("zone"), F.lit(tower).alias("tower_id"))
    out = F.when(place.isNull() | (F.trim(place) == ""), F.lit(None).cast(kinds))
    for name, lat, lng, zone, tower in COORDINATES:
        low = name.lower()
        out = out.when(F.contains(F.lower(place), F.lit(low)) | F.contains(F.lit(low), F.lower(place)), point(lat, lng, zone, tower))
    h = F.conv(F.substring(F.md5(place.cast("binary")), 1, 6), 16, 10).cast("long")
    off = lambda digits: (digits / 1000.0 - 0.5) * 0.15
    far = F.struct(
        F.round(F.lit(CENTER[0]) + off(h % 1000), 4).alias("lat"),
        F.round(F.lit(CENTER[1]) + off(F.floor(h / 1000) % 1000), 4).alias("lng"),
        F.lit("Peripheral Zone").alias("zone"),
        F.concat(F.lit("TOW-"), (h % 900 + 100).cast("string")).alias("tower_id"),
    )
    return out.otherwise(far)


def tower_stats(calls: DataFrame, people: DataFrame, cells: Sequence[str] = CORE_CELLS, cross_least: int = 3) -> DataFrame:
    """Per tower: call_count, total_duration, n_callers, n_callees, n_suspects, days_active, dominant_cell, n_<cell> for each of ``cells``
    (both ends of each call), is_cross_cell (two cells with ``cross_least`` or more), intensity (share of the busiest tower)."""
    of = lambda end: people.select(F.col("id").alias(end), F.col("cell").alias(f"{end}_cell"))
    known = calls.select(F.coalesce("tower", F.lit("Unknown")).alias("tower"), "caller", "callee", "duration", "day").join(of("caller"), "caller", "left").join(of("callee"), "callee", "left")
    end = lambda c: F.count_if(F.col("caller_cell") == c) + F.count_if(F.col("callee_cell") == c)
    stats = known.groupBy("tower").agg(
        F.count("*").alias("call_count"), F.sum("duration").alias("total_duration"), F.count_distinct("caller").alias("n_callers"), F.count_distinct("callee").alias("n_callees"),
        F.count_distinct("day").alias("days_active"), *(end(c).alias(f"n_{c}") for c in cells),
    )
    suspects = known.select("tower", F.explode(F.array("caller", "callee")).alias("id")).distinct().groupBy("tower").agg(F.count("*").alias("n_suspects"))
    best = F.greatest(*(F.col(f"n_{c}") for c in cells))
    dominant = F.when(best == 0, F.lit("Unknown"))
    for c in cells:
        dominant = dominant.when(F.col(f"n_{c}") == best, c)
    crossing = sum((F.when(F.col(f"n_{c}") >= cross_least, 1).otherwise(0) for c in cells), F.lit(0))
    busiest = F.max("call_count").over(Window.partitionBy())  # a row for each tower
    return stats.join(suspects, "tower").select("*", dominant.alias("dominant_cell"), (crossing >= 2).alias("is_cross_cell"), F.round(F.col("call_count") / busiest, 3).alias("intensity"))


def tower_schematic(calls: DataFrame, people: DataFrame, cells: Sequence[str] = CORE_CELLS) -> DataFrame:
    """tower, tower_label (TWR-01 on by name), call_count, co_location_count: how many of ``cells`` call there."""
    cell = people.select(F.col("id").alias("caller"), "cell")
    per = calls.join(cell, "caller", "left").groupBy("tower").agg(F.count("*").alias("call_count"), F.count_distinct(F.when(F.col("cell").isin(*cells), F.col("cell"))).alias("co_location_count"))
    number = F.row_number().over(Window.orderBy("tower"))
    return per.select("tower", F.format_string("TWR-%02d", number).alias("tower_label"), "call_count", "co_location_count")


def hotspots(events: DataFrame, people: DataFrame, cells: Sequence[str] = (*CORE_CELLS, "Bridge"), least_suspects: int = 3, least_cells: int = 2) -> DataFrame:
    """place, n_suspects, n_cells, n_days, total_events, risk_tier of places where suspects of several cells meet.

    events: id, place, day, weight (1 for a call, 2 for a sighting), event; an event with several ids counts its weight once."""
    known = events.join(people.select("id", "cell"), "id")
    weights = known.select("place", "event", "weight").distinct().groupBy("place").agg(F.sum("weight").alias("total_events"))
    meets = known.groupBy("place").agg(F.count_distinct("id").alias("n_suspects"), F.count_distinct(F.when(F.col("cell").isin(*cells), F.col("cell"))).alias("n_cells"), F.count_distinct("day").alias("n_days"))
    hot = meets.where((F.col("n_suspects") >= least_suspects) & (F.col("n_cells") >= least_cells))
    return hot.join(weights, "place").select("place", "n_suspects", "n_cells", "n_days", "total_events", F.when(F.col("n_cells") >= 3, "CRITICAL").otherwise("HIGH").alias("risk_tier"))


def trajectories(calls: DataFrame, first_day: int | None = None, last_day: int | None = None, persons: DataFrame | None = None) -> DataFrame:
    """person, waypoints, first_place, last_place, path: each person's call places in order of day, time and call, both ends of a call;
    of ``persons`` (id) only, if given."""
    span = F.lit(True)
    if first_day is not None:
        span &= F.col("day") >= first_day
    if last_day is not None:
        span &= F.col("day") <= last_day
    ends = calls.where(span).select(F.explode(F.array("caller", "callee")).alias("person"), F.struct("day", "ts", "call_id", "tower").alias("e"))
    if persons is not None:
        ends = ends.join(persons.select(F.col("id").alias("person")).distinct(), "person", "left_semi")
    paths = ends.groupBy("person").agg(F.array_sort(F.collect_list("e")).alias("path"))
    return paths.select("person", F.size("path").alias("waypoints"), F.col("path")[0]["tower"].alias("first_place"), F.element_at("path", -1)["tower"].alias("last_place"), "path")
