"""Observation-to-field collocation.

Readings carry their settings as columns (``with_settings``), so one setting,
a sweep, or a search over frames is the same job. Cheap gates run first; only
rows that pass them reach the shuffle joins with the field.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinefield.functions.geo import EARTH_RADIUS_KM, haversine_km, haversine_text
from brinefield.functions.qc import strict_coordinates, strict_value
from brinefield.functions.scalars import hours_between
from brinefield.operators.axes import AxisText, axis_index
from brinefield.operators.axes import barrier as row_barrier
from brinefield.runtime import cut
from brinefield.sources.fields import column_packed

SALTS = 4096


@dataclass(frozen=True)
class MatchSettings:
    """Limits of one comparison; the defaults are the published project settings."""

    it: int = 0
    time_window_hours: float = 6.0
    distance_km: float = 5.0
    max_vertical_gap_m: float = 500.0
    good_only: bool = False
    setting_id: int = 0


def with_settings(readings: DataFrame, settings: Sequence[MatchSettings]) -> DataFrame:
    """One copy of every reading per setting."""
    items = ", ".join(
        f"named_struct('setting_id', {s.setting_id}, 'it', {s.it}, 'time_window_hours', {float(s.time_window_hours)!r}D, 'distance_limit_km', {float(s.distance_km)!r}D, "
        f"'max_vertical_gap_m', {float(s.max_vertical_gap_m)!r}D, 'good_only', {str(s.good_only).lower()})" for s in settings)
    return readings.selectExpr("*", f"inline(array({items}))")


def nearest_column(points: DataFrame, tie_km: float = 0.0, when: str = "") -> DataFrame:
    """Nearest grid column of each ``(lat, lon)`` row carrying ``axis_index``.

    Exact pruning instead of a full search. The longitude is first shifted by
    whole turns to the copy nearest the axis. Along one latitude row distance
    grows with the longitude gap, so only the bracketing longitudes (and both
    ends, when the point lies outside or the axis spans over half a turn) can
    win. Distance is at least the latitude gap, so rows farther than the best
    bracketing distance cannot win. Ties take the first latitude-major column;
    with ``tie_km`` every candidate within that margin counts as tied. Rows that
    fail ``when`` (SQL text) stay, with null results and none of the work.
    """
    y, x = AxisText("lat"), AxisText("lon")

    def far(row, col):
        return haversine_text("lat", "lon", y.at(row), x.at(col))

    def barrier(df, columns):
        return row_barrier(df, {n: f"CASE WHEN {when} THEN {t} END" for n, t in columns.items()} if when else columns)

    p = barrier(points, {"_lon": f"lon + 360D * floor((({x.first} + {x.last}) / 2 - lon) / 360D + 0.5D)"})
    p = barrier(p, {"_x0": x.floor_index("_lon"), "_y0": y.floor_index("lat")})
    p = p.selectExpr("*", f"least(_x0 + 1, {x.size} - 1) AS _x1", f"least(_y0 + 1, {y.size} - 1) AS _y1")
    corners = [(r, c) for r in ("_y0", "_y1") for c in ("_x0", "_x1")]
    p = barrier(p, {"_four": "array(" + ", ".join(f"named_struct('d', {far(r, c)}, 'iy', {r}, 'ix', {c})" for r, c in corners) + ")"})
    p = barrier(p, {"_best": "array_min(_four)"})
    p = barrier(p, {"_reach": f"degrees((_best.d + {tie_km!r}D) / {EARTH_RADIUS_KM!r}D) * (1 + 1e-9D) + 1e-9D",
                    "_wide": f"NOT {x.covers('_lon')} OR {x.last} - {x.first} > 180"})
    p = barrier(p, {"_from": y.ceil_index("(lat - _reach)"), "_to": y.floor_index("(lat + _reach)")})
    pairs = (f"flatten(transform(sequence(_from, _to), r -> transform(CASE WHEN _wide THEN array(_x0, _x1, 0, {x.size} - 1) ELSE array(_x0, _x1) END, "
             f"c -> named_struct('d', {far('r', 'c')}, 'iy', r, 'ix', c))))")
    if not tie_km:
        # On most grids no row beyond the bracketing two is in reach, and the four corners decide.
        p = barrier(p, {"_near": f"CASE WHEN _from >= _y0 AND _to <= _y1 AND NOT _wide THEN _best ELSE array_min({pairs}) END"})
    else:
        p = barrier(barrier(p, {"_pairs": pairs}), {"_near": f"array_min(transform(filter(_pairs, s -> s.d <= array_min(_pairs).d + {tie_km!r}D), "
                                                             "s -> named_struct('iy', s.iy, 'ix', s.ix, 'd', s.d)))"})
    return p.selectExpr(*points.columns, "_near.iy AS iy", "_near.ix AS ix", "_near.d AS distance_km")


def vertical_bracket(points: DataFrame, z: str = "depth_m", when: str = "true") -> DataFrame:
    """C4: levels around a depth; an exact level is both; null outside the axis and where ``when`` fails."""
    axis = AxisText("depth")
    inside = f"({when} AND {axis.covers(z)})"
    marked = row_barrier(points, {"iz_lower": f"CASE WHEN {inside} THEN {axis.floor_index(z)} END", "iz_upper": f"CASE WHEN {inside} THEN {axis.ceil_index(z)} END"})
    return marked.selectExpr("*", f"{axis.at('iz_lower')} AS lower_depth_m", f"{axis.at('iz_upper')} AS upper_depth_m")


def attach_bracket(rows: DataFrame, field: DataFrame) -> DataFrame:
    """Field values at both levels: one join with the water column, two array reads.

    Rows without a bracket get scattered keys no column has, so they neither
    match nor pile up in one partition.
    """
    spread = (-1 - F.pmod(F.xxhash64("sample_index"), F.lit(SALTS))).cast("int")
    columns = column_packed(field).select("case_id", "it", F.col("iy").alias("_y"), F.col("ix").alias("_x"), F.col("value").alias("_column"))
    keyed = rows.withColumns({"_y": F.when(F.col("iz_lower").isNull(), spread).otherwise(F.col("iy")), "_x": F.coalesce("ix", F.lit(-1))})
    return keyed.join(columns, ["case_id", "it", "_y", "_x"], "left").selectExpr(
        *rows.columns, "get(_column, iz_lower) AS model_lower_value", "get(_column, iz_upper) AS model_upper_value")


def early_reason() -> Column:
    """C8, first part: gates that need no field value, in fixed order."""
    inside = f"coalesce({AxisText('lat').covers('lat')} AND {AxisText('lon').covers('lon')}, false)"
    strict = F.col("good_only")
    narrow = ~strict_coordinates(F.col("scheme"), F.col("pressure_qc"), F.col("position_qc"), F.col("time_qc"))
    return (F.when(F.col("held"), "source_review").when(F.expr("NOT has_variable"), "variable_unavailable")
            .when(F.expr("NOT compatible"), "incompatible_variable")
            .when(F.expr("NOT coordinate_eligible") | (strict & narrow), "coordinate_qc").when(F.expr("value IS NULL"), "missing_value")
            .when(F.expr("NOT value_accepted") | (strict & ~strict_value(F.col("scheme"), F.col("qc"))), "observation_qc")
            .when(F.expr("depth_m IS NULL OR depth_m < 0"), "invalid_depth").when(F.expr(f"NOT {inside}"), "outside_domain")
            .when(~within_time_window(), "time_window"))


def within_time_window() -> Column:
    """Inclusive on both sides of the frame."""
    return F.expr("abs(time_offset_hours) <= time_window_hours")


def late_reason() -> Column:
    """C8, second part: C7 limits and bracket support, inclusive, in fixed order."""
    return F.expr("""CASE WHEN distance_km > distance_limit_km THEN 'distance' WHEN iz_lower IS NULL THEN 'depth_outside'
        WHEN model_lower_value IS NULL OR model_upper_value IS NULL THEN 'masked_bracket'
        WHEN upper_depth_m - lower_depth_m > max_vertical_gap_m THEN 'vertical_gap' ELSE 'accepted' END""")


def gated(readings: DataFrame, axes: DataFrame, frames: DataFrame) -> DataFrame:
    """Readings with settings, axis lookups, time offset and early reason."""
    times = frames.selectExpr("case_id", "it", "ts AS frame_time")
    return (readings.join(times, ["case_id", "it"]).join(axis_index(axes), "case_id")
            .withColumn("time_offset_hours", hours_between(F.col("ts"), F.col("frame_time")))
            .withColumn("early", early_reason()))


MODEL_SIDE = ["distance_km", "model_latitude", "model_longitude", "iy", "ix", "lower_depth_m", "upper_depth_m", "model_lower_value", "model_upper_value",
              "upper_weight", "model", "model - value AS residual"]
OBSERVED_SIDE = ["setting_id", "case_id", "profile_id", "it", "sample_index", "ts AS observation_time", "lat AS latitude", "lon AS longitude",
                 "depth_m", "value AS observed", "qc", "mode", "time_offset_hours"]
LEVELS = ["iz_lower", "iz_upper", "lower_depth_m", "upper_depth_m"]


def positioned(rows: DataFrame, when: str) -> DataFrame:
    """Nearest column and depth bracket of the gated rows that pass ``when``: what a position decides, whatever the frame.

    The bracket is null beyond the distance limit; other rows have nulls throughout.
    """
    near = vertical_bracket(nearest_column(rows, when=when), when=when)
    close = [f"CASE WHEN distance_km <= distance_limit_km THEN {n} END AS {n}" for n in LEVELS]
    return near.selectExpr("setting_id", "case_id", "profile_id", "it", "sample_index", "ts", "lat", "lon", "depth_m", "value", "qc", "mode", "time_offset_hours", "early",
                           "distance_km", "iy", "ix", f"{AxisText('lat').at('iy')} AS model_latitude", f"{AxisText('lon').at('ix')} AS model_longitude", *close,
                           "distance_limit_km", "max_vertical_gap_m")


def collocate(readings: DataFrame, field: DataFrame, axes: DataFrame, frames: DataFrame, used_frames: Collection[int] | None = None) -> DataFrame:
    """One match row per reading and setting, with exactly one reason.

    One pass over the readings and one join with the field, which is given as cells or,
    better, as stored water columns. The model side of a rejected row is null from its
    gate on: rejected rows skip the geometry and enter the join under scattered keys.
    ``used_frames`` names the frames the settings use, so other frames of the field are
    pruned at the scan.
    """
    if used_frames is not None:
        field = field.filter(F.col("it").isin(*used_frames))
    near = positioned(gated(readings, axes, frames), "early IS NULL")
    met = attach_bracket(near, field).withColumn("reason", F.coalesce("early", late_reason())).selectExpr("*", "reason = 'accepted' AS accepted")
    met = met.selectExpr("*", "CASE WHEN accepted THEN CASE WHEN lower_depth_m = upper_depth_m THEN 0D "
                         "ELSE (depth_m - lower_depth_m) / (upper_depth_m - lower_depth_m) END END AS upper_weight")
    met = met.selectExpr("*", "model_lower_value + (model_upper_value - model_lower_value) * upper_weight AS model")
    return met.selectExpr(*OBSERVED_SIDE, *MODEL_SIDE, "reason", "accepted")


def frame_candidates(late: DataFrame, frames: DataFrame, window_hours: float) -> DataFrame:
    """(case, profile, frame) triples whose frame could rescue a row ``(case_id, profile_id, it, ts)`` that its own frame's window excludes.

    Rows and frames meet in time buckets one window wide, so each row sees only
    frames near its own time.
    """
    width = max(float(window_hours), 1 / 3600) * 3600
    def seconds(c):
        return F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    buckets = F.sequence(F.floor((seconds("ts") - width) / width), F.floor((seconds("ts") + width) / width))
    f = frames.select("case_id", F.col("it").alias("frame"), F.col("ts").alias("frame_time"), F.explode(buckets).alias("_bucket"))
    near = late.select("case_id", "profile_id", "it", "ts", F.floor(seconds("ts") / width).alias("_bucket")).join(f, ["case_id", "_bucket"]).filter(
        (F.col("frame") != F.col("it")) & (F.abs(hours_between(F.col("ts"), F.col("frame_time"))) <= window_hours))
    return near.select("case_id", "profile_id", F.col("frame").alias("it")).distinct()


def suggest_snapshot(readings: DataFrame, field: DataFrame, axes: DataFrame, frames: DataFrame, settings: MatchSettings) -> DataFrame:
    """Best other frame for profiles without an accepted row but with time-excluded rows.

    Which column and levels a reading meets depends on its position alone. So the readings
    that pass every other gate are placed in one pass and kept as a table; the own frame and
    all candidate frames are then equi-joins of that table with the field.
    """
    rows = gated(with_settings(readings, [settings]), axes, frames)
    placed = cut(positioned(rows.filter("early IS NULL OR early = 'time_window'"), "true").selectExpr(
        "case_id", "profile_id", "it", "sample_index", "ts", "depth_m", "iy", "ix", "distance_km", *LEVELS, "distance_limit_km", "max_vertical_gap_m", "early IS NOT NULL AS late"))

    def accepted(rows):
        return attach_bracket(rows, field).filter(late_reason() == "accepted")

    own = accepted(placed.filter("NOT late")).select("case_id", "profile_id").distinct()
    wanted = frame_candidates(placed.filter("late"), frames, settings.time_window_hours).join(own, ["case_id", "profile_id"], "left_anti")
    times = frames.select("case_id", "it", F.col("ts").alias("frame_time"))
    trial = (placed.drop("it").join(wanted.join(times, ["case_id", "it"]), ["case_id", "profile_id"])
             .withColumn("offset", F.abs(hours_between(F.col("ts"), F.col("frame_time")))).filter(F.col("offset") <= settings.time_window_hours))
    per_frame = accepted(trial).groupBy("case_id", "profile_id", "it").agg(
        F.min("offset").alias("offset"), F.min("distance_km").alias("distance"), F.count("*").alias("matched"))
    best = F.min(F.struct("offset", "distance", "it", "matched"))
    return per_frame.groupBy("case_id", "profile_id").agg(best.alias("_b")).select(
        "case_id", "profile_id", F.col("_b.it").alias("suggested_it"), F.col("_b.matched").alias("suggested_matched"),
        F.col("_b.offset").alias("suggested_offset_hours"), F.col("_b.distance").alias("suggested_distance_km"))


def event_context(profiles: DataFrame, events: DataFrame, columns: DataFrame, bounds: DataFrame) -> DataFrame:
    """C11: profiles inside the case box and an event's dates, with distance and hours to the event's column.

    ``events(case_id, event_id, start, end)``, ``columns(case_id, event_id, lat, lon, model_time)``. Events
    spread over the months they touch and profiles look up their own month.
    """
    months = F.sequence(F.trunc("start", "MM"), F.trunc("end", "MM"), F.expr("INTERVAL 1 MONTH"))
    spans = events.select("case_id", "event_id", "start", "end", F.explode(months).alias("_month")).join(
        columns.select("case_id", "event_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "model_time"), ["case_id", "event_id"])
    p = profiles.join(bounds, "case_id").filter(
        F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north")))
    day = F.to_date("ts")
    return (p.withColumn("_month", F.trunc(day, "MM")).join(spans, ["case_id", "_month"])
            .filter(day.between(F.col("start"), F.col("end")))
            .select("case_id", "event_id", "profile_id", haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")).alias("distance_km"),
                    hours_between(F.col("ts"), F.col("model_time")).alias("time_offset_hours")))


def profiles_in_months(profiles: DataFrame, months: DataFrame) -> DataFrame:
    """Profiles whose first time falls in a set of ``yyyy-MM`` months.

    The months are written first, so that Catalyst knows how few they are: a join that
    shuffles and sorts by month would put all profiles of one month into one task.
    """
    return profiles.withColumn("month", F.date_format("ts", "yyyy-MM")).join(cut(months.select("month").distinct()), "month", "left_semi")


def contrast_pair(a: DataFrame, b: DataFrame, keys: Sequence[str], tol: float) -> DataFrame:
    """The column pair with close surface values and the largest contrast at depth.

    ``a`` and ``b`` carry ``(keys, flat, surface, deep)``. For one column of
    ``a`` the best partner is an extreme of ``deep`` over ``b``'s band, so no
    pair list is built: both sides fold to one row per surface value, values
    fall in buckets one tolerance wide, and a band is one whole bucket plus a
    running extreme from each neighbour. Ties take the first ``a`` then ``b`` index.
    """
    keys = list(keys)

    def fold(df):
        ok = df.filter(F.col("surface").isNotNull() & F.col("deep").isNotNull())
        return ok.groupBy(*keys, "surface").agg(
            F.max(F.struct("deep", (-F.col("flat")).alias("neg"))).alias("hi"), F.min(F.struct("deep", "flat")).alias("lo"))

    left = fold(a).withColumn("_b", F.floor(F.col("surface") / tol))
    right = fold(b).withColumn("_b", F.floor(F.col("surface") / tol))

    def extremes(hi, lo):
        return F.max(hi).alias("bhi"), F.min(lo).alias("blo")

    middle = left.join(right.groupBy(*keys, "_b").agg(*extremes("hi", "lo")), [*keys, "_b"])
    parts = [middle.select(*keys, "surface", F.col("hi").alias("ahi"), F.col("lo").alias("alo"), "bhi", "blo")]
    for step, edge in ((-1, F.col("surface") - tol), (1, F.col("surface") + tol)):
        asks = left.select(*keys, (F.col("_b") + step).alias("_b"), edge.alias("_at"), F.lit(1).alias("_ask"),
                           F.col("hi").alias("ahi"), F.col("lo").alias("alo"), "surface")
        gives = right.select(*keys, "_b", F.col("surface").alias("_at"), F.lit(0).alias("_ask"), F.col("hi").alias("bhi"), F.col("lo").alias("blo"))
        both = asks.unionByName(gives, allowMissingColumns=True)
        order = F.col("_at").asc() if step > 0 else F.col("_at").desc()
        run = Window.partitionBy(*keys, "_b").orderBy(order, "_ask").rowsBetween(Window.unboundedPreceding, 0)
        seen = both.withColumns({"bhi": F.max("bhi").over(run), "blo": F.min("blo").over(run)})
        parts.append(seen.filter((F.col("_ask") == 1) & F.col("bhi").isNotNull()).select(*keys, "surface", "ahi", "alo", "bhi", "blo"))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    down = F.struct((F.col("ahi.deep") - F.col("blo.deep")).alias("contrast"), F.col("ahi.neg").alias("na"), (-F.col("blo.flat")).alias("nb"))
    up = F.struct((F.col("bhi.deep") - F.col("alo.deep")).alias("contrast"), (-F.col("alo.flat")).alias("na"), F.col("bhi.neg").alias("nb"))
    best = every.groupBy(*keys).agg(F.max(F.greatest(down, up)).alias("_p"))
    return best.select(*keys, F.col("_p.contrast").alias("contrast"), (-F.col("_p.na")).alias("a_flat"), (-F.col("_p.nb")).alias("b_flat"))
