"""Quality control, collocation and coverage queries (Q, C, A rows)."""

from pyspark.sql import functions as F

from brinefield.functions import qc
from brinefield.functions.geo import haversine_km
from brinefield.operators import collocate as co
from brinefield.operators import coverage as cov
from brinefield.registry.core import query
from brinefield.registry.projections import register_cte
from brinefield.runtime import cut

BASE = co.MatchSettings(it=3, time_window_hours=36, distance_km=15, max_vertical_gap_m=70)
SWEEP = [BASE, co.MatchSettings(3, 72, 15, 500, False, 1), co.MatchSettings(3, 36, 10, 70, True, 2)]
R9 = lambda *names: {n: F.round(n, 9) for n in names}
R6 = lambda *names: {n: F.round(n, 6) for n in names}


def readings(i):
    rows = i.obs.withColumn("coordinate_eligible", qc.coordinate_eligible(
        F.col("scheme"), F.col("depth_m"), F.col("pressure_qc"), F.col("position_qc"), F.col("time_qc")))
    verdict = qc.qc_reading(F.col("value"), F.col("qc"), F.col("scheme"), F.col("coordinate_eligible"), F.col("mode"), F.col("instrument") == "bgc")
    return rows.withColumn("qc_verdict", verdict).withColumn("value_accepted", F.col("qc_verdict") == "accepted")


def matches(i, settings=(BASE,)):
    return co.collocate(co.with_settings(readings(i), settings), i.columns, i.index, i.frames, {s.it for s in settings})


GOOD = "CASE scheme WHEN 'qartod' THEN {0} = '1' WHEN 'woce' THEN {0} = '2' ELSE {0} IN ('1', '2') END"
register_cte("obs_qc", f"""
SELECT *, CASE WHEN value IS NULL THEN 'missing' WHEN NOT coordinate_eligible THEN 'coordinate' WHEN NOT {GOOD.format('qc')} THEN 'flag'
   WHEN instrument = 'bgc' AND mode = 'R' THEN 'inspect_only' ELSE 'accepted' END AS qc_verdict
FROM (SELECT *, CASE WHEN scheme IN ('argo', 'declared') THEN pressure_qc IN ('1', '2') AND position_qc IN ('1', '2') AND time_qc IN ('1', '2')
   ELSE {GOOD.format('pressure_qc')} END AS coordinate_eligible FROM obs) t""", ("obs",))


def register_match(name, settings_sql, source="obs_qc", needs=()):
    register_cte(f"{name}_early", f"""
SELECT o.*, s.*, (epoch_us(o.ts) - epoch_us(f.ts)) / 3.6e9 AS off, CASE WHEN held THEN 'source_review' WHEN NOT has_variable THEN 'variable_unavailable'
  WHEN NOT compatible THEN 'incompatible_variable'
  WHEN NOT coordinate_eligible OR (good_only AND scheme IN ('argo', 'declared') AND NOT (pressure_qc = '1' AND position_qc = '1' AND time_qc = '1')) THEN 'coordinate_qc'
  WHEN value IS NULL THEN 'missing_value'
  WHEN qc_verdict <> 'accepted' OR (good_only AND scheme IN ('argo', 'declared') AND qc <> '1') THEN 'observation_qc'
  WHEN depth_m < 0 THEN 'invalid_depth' WHEN NOT (lat BETWEEN 10 AND 12.75 AND lon BETWEEN 85 AND 88.5) THEN 'outside_domain'
  WHEN abs((epoch_us(o.ts) - epoch_us(f.ts)) / 3.6e9) > window_h THEN 'time_window' END AS early
FROM {source} o, ({settings_sql}) s, frames f WHERE f.case_id = o.case_id AND f.it = s.it""", (source, "frames", *needs))
    register_cte(f"{name}_near", f"""
SELECT case_id, lat, lon, b.d AS distance_km, b.iy, b.ix FROM (
SELECT p.case_id, p.lat, p.lon, min(struct_pack(d := 2 * 6371.0088 * asin(sqrt(least(1, greatest(0, pow(sin(radians(y.lat - p.lat) / 2), 2)
  + cos(radians(p.lat)) * cos(radians(y.lat)) * pow(sin(radians(x.lon - p.lon) / 2), 2))))), iy := y.idx, ix := x.idx)) AS b
FROM (SELECT DISTINCT case_id, lat, lon FROM {name}_early WHERE early IS NULL) p
JOIN ax_lat y ON y.case_id = p.case_id JOIN ax_lon x ON x.case_id = p.case_id GROUP BY 1, 2, 3) q""", (f"{name}_early", "ax_lat", "ax_lon"))
    register_cte(f"{name}_met", f"""
SELECT e.*, n.distance_km, n.iy, n.ix, y.lat AS model_latitude, x.lon AS model_longitude, zl.idx AS zlo, zu.idx AS zup, zl.depth AS lower_depth_m,
  zu.depth AS upper_depth_m, gl.value AS lo, gu.value AS hi
FROM {name}_early e JOIN {name}_near n ON e.case_id = n.case_id AND e.lat = n.lat AND e.lon = n.lon AND early IS NULL
JOIN ax_lat y ON y.case_id = e.case_id AND y.idx = n.iy JOIN ax_lon x ON x.case_id = e.case_id AND x.idx = n.ix
LEFT JOIN ax_depth zl ON zl.case_id = e.case_id AND distance_km <= dist_km AND depth_m BETWEEN 0 AND 250
  AND zl.depth = (SELECT max(depth) FROM ax_depth q WHERE q.case_id = e.case_id AND q.depth <= e.depth_m)
LEFT JOIN ax_depth zu ON zu.case_id = e.case_id AND distance_km <= dist_km AND depth_m BETWEEN 0 AND 250
  AND zu.depth = (SELECT min(depth) FROM ax_depth q WHERE q.case_id = e.case_id AND q.depth >= e.depth_m)
LEFT JOIN grid gl ON gl.case_id = e.case_id AND gl.it = e.it AND gl.iz = zl.idx AND gl.iy = n.iy AND gl.ix = n.ix
LEFT JOIN grid gu ON gu.case_id = e.case_id AND gu.it = e.it AND gu.iz = zu.idx AND gu.iy = n.iy AND gu.ix = n.ix""",
                 (f"{name}_near", "grid", "ax_depth"))
    register_cte(name, f"""
WITH r AS (SELECT *, CASE WHEN distance_km > dist_km THEN 'distance' WHEN zlo IS NULL THEN 'depth_outside' WHEN lo IS NULL OR hi IS NULL THEN 'masked_bracket'
   WHEN upper_depth_m - lower_depth_m > gap_m THEN 'vertical_gap' ELSE 'accepted' END AS reason FROM {name}_met),
 w AS (SELECT *, CASE WHEN reason = 'accepted' THEN CASE WHEN zlo = zup THEN 0 ELSE (depth_m - lower_depth_m) / (upper_depth_m - lower_depth_m) END END AS wt FROM r),
 m AS (SELECT *, lo + (hi - lo) * wt AS model FROM w)
SELECT setting_id, case_id, profile_id, it, sample_index, lat AS latitude, lon AS longitude, depth_m, value AS observed, qc, mode, off AS time_offset_hours,
  distance_km, model_latitude, model_longitude, iy, ix, lower_depth_m, upper_depth_m, lo AS model_lower_value, hi AS model_upper_value, wt AS upper_weight,
  model, model - value AS residual, reason, reason = 'accepted' AS accepted, ts AS observation_time FROM m
UNION ALL BY NAME
SELECT setting_id, case_id, profile_id, it, sample_index, lat AS latitude, lon AS longitude, depth_m, value AS observed, qc, mode, off AS time_offset_hours,
  early AS reason, false AS accepted, ts AS observation_time FROM {name}_early WHERE early IS NOT NULL""", (f"{name}_met",))


def _row(sid, it, w, d, g, good):
    return f"SELECT {sid} AS setting_id, {it} AS it, {w}e0 AS window_h, {d}e0 AS dist_km, {g}e0 AS gap_m, {good} AS good_only"


register_match("match", _row(0, 3, 36, 15, 70, "false"))
register_match("match_sweep", " UNION ALL ".join([_row(0, 3, 36, 15, 70, "false"), _row(1, 3, 72, 15, 500, "false"), _row(2, 3, 36, 10, 70, "true")]))
register_match("match_frames", " UNION ALL ".join(_row(0, k, 36, 15, 70, "false") for k in range(7)))


@query("Q1_qc_reading", "SELECT sample_index, qc_verdict, qc_verdict = 'accepted' AS accepted FROM obs_qc", ("obs_qc",))
def q1(i):
    return readings(i).select("sample_index", "qc_verdict", F.col("value_accepted").alias("accepted"))


@query("Q2_coordinate_eligible", """
SELECT case_id, profile_id, scheme, count(*) AS n, count(*) FILTER (WHERE coordinate_eligible) AS eligible FROM obs_qc GROUP BY 1, 2, 3""", ("obs_qc",))
def q2(i):
    return readings(i).groupBy("case_id", "profile_id", "scheme").agg(F.count("*").alias("n"), F.count_if("coordinate_eligible").alias("eligible"))


@query("Q3_strict_good_only", """
SELECT scheme, count(*) AS n, count(*) FILTER (WHERE scheme NOT IN ('argo', 'declared') OR (pressure_qc = '1' AND position_qc = '1' AND time_qc = '1')) AS strict_coordinates,
  count(*) FILTER (WHERE scheme NOT IN ('argo', 'declared') OR qc = '1') AS strict_values FROM obs GROUP BY 1""", ("obs",))
def q3(i):
    strict = qc.strict_coordinates(F.col("scheme"), F.col("pressure_qc"), F.col("position_qc"), F.col("time_qc"))
    return i.obs.groupBy("scheme").agg(F.count("*").alias("n"), F.count_if(strict).alias("strict_coordinates"),
                                       F.count_if(qc.strict_value(F.col("scheme"), F.col("qc"))).alias("strict_values"))


QUANTITY = """SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'temperature' ELSE 'salinity' END AS variable,
  CASE event_id % 3 WHEN 0 THEN 'In-situ sea-water temperature' WHEN 1 THEN 'Practical salinity, PSS-78; not absolute salinity' ELSE 'Nitrate per mass of sea water' END AS definition,
  CASE WHEN event_id % 5 = 0 THEN '°C' ELSE 'psu' END AS units, CASE WHEN event_id % 7 < 4 THEN 'sea_water_temperature' ELSE 'sea_water_practical_salinity' END AS standard_name,
  CASE WHEN event_id % 11 < 8 THEN '°C' ELSE 'K' END AS field_units, CASE user_id % 4 WHEN 3 THEN 'ctd' ELSE 'argo' END AS instrument,
  CASE WHEN user_id % 8 = 3 THEN 'ITS-90' END AS temperature_scale FROM {events}"""


@query("Q4_quantity_compatible", f"""
SELECT event_id, ((variable = 'temperature' AND definition = 'In-situ sea-water temperature' AND units = '°C' AND standard_name = 'sea_water_temperature' AND field_units = '°C'
    AND (instrument <> 'ctd' OR coalesce(temperature_scale, '') = 'ITS-90'))
  OR (variable = 'salinity' AND definition = 'Practical salinity, PSS-78; not absolute salinity' AND units = 'psu'
    AND standard_name IN ('sea_water_salinity', 'sea_water_practical_salinity'))) AS compatible FROM ({QUANTITY.format(events='events')}) t""")
def q4(i):
    c = [F.col(n) for n in ("variable", "definition", "units", "standard_name", "field_units", "instrument", "temperature_scale")]
    return i.sql(QUANTITY, "events").select("event_id", qc.quantity_compatible(*c).alias("compatible"))


@query("Q5_valid_position", """
SELECT event_id, coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, false) AS position_ok, coalesce(p BETWEEN 0 AND 12000, false) AS pressure_ok
FROM (SELECT event_id, CAST(event_id * 7 % 250 AS DOUBLE) - 125 AS lat, CASE WHEN event_id % 50 > 0 THEN CAST(event_id * 11 % 500 AS DOUBLE) - 250 END AS lon,
  CAST(event_id * 13 % 15000 AS DOUBLE) - 1000 AS p FROM events) t""")
def q5(i):
    e = F.col("event_id")
    lat, p = (e * 7 % 250).cast("double") - 125, (e * 13 % 15000).cast("double") - 1000
    lon = F.when(e % 50 > 0, (e * 11 % 500).cast("double") - 250)
    return i.table("events").select("event_id", qc.valid_position(lat, lon).alias("position_ok"), qc.valid_pressure(p).alias("pressure_ok"))


@query("Q6_pressure_to_depth", """
SELECT event_id, round(CASE WHEN p BETWEEN 0 AND 12000 THEN greatest(0, (9.72659 * p - 2.2512e-5 * p * p + 2.279e-10 * pow(p, 3) - 1.82e-15 * pow(p, 4))
  / (9.780318 * (1 + 5.2788e-3 * pow(sin(radians(lat)), 2) + 2.36e-5 * pow(sin(radians(lat)), 4)) + 1.092e-6 * p)) END, 5) AS depth_m
FROM (SELECT event_id, CAST(event_id * 13 % 13000 AS DOUBLE) - 500 AS p, CAST(event_id * 7 % 160 AS DOUBLE) - 80 AS lat FROM events) t""")
def q6(i):
    e = F.col("event_id")
    depth = qc.pressure_to_depth((e * 13 % 13000).cast("double") - 500, (e * 7 % 160).cast("double") - 80)
    return i.table("events").select("event_id", F.round(depth, 5).alias("depth_m"))


@query("Q7_value_range_check", """
SELECT event_id, CASE WHEN t IS NULL OR s IS NULL THEN 'missing_source' WHEN t BETWEEN -3 AND 45 AND s BETWEEN 0 AND 50 THEN 'valid' ELSE 'unsupported_source_range' END AS status
FROM (SELECT event_id, CASE WHEN event_id % 17 > 0 THEN value END AS t, CAST(event_id % 60 AS DOUBLE) - 5 AS s FROM events) x""")
def q7(i):
    e = F.col("event_id")
    return i.table("events").select("event_id", qc.range_status(F.when(e % 17 > 0, F.col("value")), (e % 60).cast("double") - 5).alias("status"))


@query("C1_haversine_km", """
SELECT sample_index, round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(11.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(11.5)) * pow(sin(radians(86.8 - lon) / 2), 2))), 6) AS km
FROM obs""", ("obs",))
def c1(i):
    return i.obs.select("sample_index", F.round(haversine_km(F.col("lat"), F.col("lon"), F.lit(11.5), F.lit(86.8)), 6).alias("km"))


WIDE_POINTS = """SELECT event_id, CAST(floor(event_id / 3334e0) AS BIGINT) AS case_id, 84 + CAST(event_id * 53 % 551 AS DOUBLE) / 100 AS lon,
  9 + CAST(event_id * 37 % 4760 AS DOUBLE) / 1000 AS lat FROM {events}"""
_NEAR = f"""WITH p AS ({WIDE_POINTS.format(events='events')}), d AS (SELECT event_id, y.idx AS iy, x.idx AS ix,
  2 * 6371.0088 * asin(sqrt(least(1, greatest(0, pow(sin(radians(y.lat - p.lat) / 2), 2)
  + cos(radians(p.lat)) * cos(radians(y.lat)) * pow(sin(radians(x.lon - p.lon) / 2), 2))))) AS d
  FROM p JOIN ax_lat y USING (case_id) JOIN ax_lon x USING (case_id)), m AS (SELECT event_id, min(d) AS dmin FROM d GROUP BY 1)"""


@query("C2_nearest_column", _NEAR + """ SELECT event_id, min(struct_pack(d := d, iy := iy, ix := ix)).iy AS iy, min(struct_pack(d := d, iy := iy, ix := ix)).ix AS ix,
  round(min(d), 6) AS distance_km FROM d GROUP BY 1""", ("ax_lat", "ax_lon"))
def c2(i):
    points = i.sql(WIDE_POINTS, "events").join(i.index, "case_id")
    return co.nearest_column(points).select("event_id", "iy", "ix", F.round("distance_km", 6).alias("distance_km"))


@query("C3_nearest_column_eps", _NEAR + """ SELECT event_id, min(iy * 15 + ix) // 15 AS iy, min(iy * 15 + ix) % 15 AS ix FROM d JOIN m USING (event_id)
  WHERE d <= dmin + 1e-10 GROUP BY 1""", ("ax_lat", "ax_lon"))
def c3(i):
    points = i.sql(WIDE_POINTS, "events").join(i.index, "case_id")
    return co.nearest_column(points, 1e-10).select("event_id", "iy", "ix")


@query("C4_vertical_bracket", """
SELECT sample_index, (SELECT max(idx) FROM ax_depth z WHERE z.case_id = o.case_id AND depth <= depth_m AND depth_m <= 250) AS iz_lower,
  (SELECT min(idx) FROM ax_depth z WHERE z.case_id = o.case_id AND depth >= depth_m) AS iz_upper FROM obs o""", ("obs", "ax_depth"))
def c4(i):
    return co.vertical_bracket(i.obs.join(i.index, "case_id")).select("sample_index", "iz_lower", "iz_upper")


@query("C5_interp_depth", """
SELECT profile_id, sample_index, lower_depth_m, upper_depth_m, model_lower_value, model_upper_value, round(upper_weight, 6) AS upper_weight, round(model, 6) AS model
FROM match WHERE reason IN ('accepted', 'masked_bracket', 'vertical_gap')""", ("match",))
def c5(i):
    return matches(i).filter(F.col("reason").isin("accepted", "masked_bracket", "vertical_gap")).select(
        "profile_id", "sample_index", "lower_depth_m", "upper_depth_m", "model_lower_value", "model_upper_value",
        F.round("upper_weight", 6).alias("upper_weight"), F.round("model", 6).alias("model"))


@query("C6_time_window_gate", """
SELECT sample_index, round((epoch_us(o.ts) - epoch_us(f.ts)) / 3.6e9, 6) AS time_offset_hours, abs((epoch_us(o.ts) - epoch_us(f.ts)) / 3.6e9) <= 36 AS inside
FROM obs o JOIN frames f ON f.case_id = o.case_id AND f.it = 3""", ("obs", "frames"))
def c6(i):
    rows = co.gated(co.with_settings(readings(i), [BASE]), i.index, i.frames)
    return rows.select("sample_index", F.round("time_offset_hours", 6).alias("time_offset_hours"), co.within_time_window().alias("inside"))


@query("C7_limit_gates", """
SELECT case_id, reason, count(*) AS n FROM match WHERE reason IN ('distance', 'depth_outside', 'vertical_gap', 'outside_domain', 'invalid_depth') GROUP BY 1, 2""", ("match",))
def c7(i):
    gates = ("distance", "depth_outside", "vertical_gap", "outside_domain", "invalid_depth")
    return matches(i).filter(F.col("reason").isin(*gates)).groupBy("case_id", "reason").agg(F.count("*").alias("n"))


@query("C8_first_failed_reason", "SELECT sample_index, reason FROM match", ("match",))
def c8(i):
    return matches(i).select("sample_index", "reason")


MATCH_OUT = ("distance_km", "upper_weight", "model", "residual", "time_offset_hours")


@query("C9_collocate", f"""
SELECT * EXCLUDE ({', '.join(MATCH_OUT)}, observation_time), epoch_us(observation_time) AS t_us, {', '.join(f'round({c}, 6) AS {c}' for c in MATCH_OUT)} FROM match""", ("match",))
def c9(i):
    return matches(i).withColumns(R6(*MATCH_OUT)).withColumn("t_us", F.unix_micros("observation_time")).drop("observation_time")


@query("C10_suggest_snapshot", """
WITH none AS (SELECT case_id, profile_id FROM match_frames WHERE it = 3 GROUP BY 1, 2 HAVING count(*) FILTER (WHERE accepted) = 0 AND count(*) FILTER (WHERE reason = 'time_window') > 0),
 cand AS (SELECT DISTINCT m.case_id, m.profile_id, f.it FROM match_frames m JOIN none USING (case_id, profile_id) JOIN frames f ON f.case_id = m.case_id AND f.it <> 3
   AND abs(epoch_us(f.ts) - epoch_us(m.observation_time)) / 3.6e9 <= 36 WHERE m.it = 3 AND m.reason = 'time_window'),
 s AS (SELECT case_id, profile_id, it, min(abs(time_offset_hours)) AS o, min(distance_km) AS d, count(*) AS n FROM match_frames JOIN cand USING (case_id, profile_id, it)
   WHERE accepted GROUP BY 1, 2, 3),
 b AS (SELECT case_id, profile_id, min(struct_pack(o := o, d := d, it := it, n := n)) AS b FROM s GROUP BY 1, 2)
SELECT case_id, profile_id, b.it AS suggested_it, b.n AS suggested_matched, round(b.o, 6) AS suggested_offset_hours, round(b.d, 6) AS suggested_distance_km FROM b""",
       ("match_frames",))
def c10(i):
    return co.suggest_snapshot(readings(i), i.columns, i.index, i.frames, BASE).withColumns(R6("suggested_offset_hours", "suggested_distance_km"))


PROFILES = "SELECT case_id, profile_id, min(ts) AS ts, arg_min(lat, sample_index) AS lat, arg_min(lon, sample_index) AS lon FROM obs GROUP BY 1, 2"
register_cte("profiles", PROFILES, ("obs",))


def profiles(i):
    return i.obs.groupBy("case_id", "profile_id").agg(F.min("ts").alias("ts"), F.min_by("lat", "sample_index").alias("lat"), F.min_by("lon", "sample_index").alias("lon"))


EVENT_ROWS = """SELECT case_id, concat('ev', CAST(it AS VARCHAR(9))) AS event_id, CAST(ts AS DATE) AS {q}start{q}, CAST(ts AS DATE) + 3 + 2 * it AS {q}end{q},
  10.5 + 0.25 * it AS lat, 86 + 0.25 * it AS lon, ts AS model_time FROM frames"""


@query("C11_event_context_join", f"""
WITH e AS ({EVENT_ROWS.format(q='"')})
SELECT p.case_id, e.event_id, p.profile_id, round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(e.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(e.lat))
  * pow(sin(radians(e.lon - p.lon) / 2), 2))), 6) AS distance_km, round((epoch_us(p.ts) - epoch_us(model_time)) / 3.6e9, 6) AS time_offset_hours
FROM profiles p JOIN e ON e.case_id = p.case_id AND CAST(p.ts AS DATE) BETWEEN e."start" AND e."end"
WHERE p.lon BETWEEN 85 AND 88.5 AND p.lat BETWEEN 10 AND 12.75""", ("profiles", "frames"))
def c11(i):
    it = F.col("it")
    events = i.frames.select("case_id", F.concat(F.lit("ev"), it.cast("string")).alias("event_id"), F.to_date("ts").alias("start"),
                             F.date_add(F.to_date("ts"), 3 + 2 * it).alias("end"), (10.5 + 0.25 * it).alias("lat"), (86 + 0.25 * it).alias("lon"),
                             F.col("ts").alias("model_time"))
    bounds = i.axes.groupBy("case_id").agg(*[f(F.when(F.col("axis") == a, F.col("coord"))).alias(n) for a, f, n in (
        ("lon", F.min, "west"), ("lon", F.max, "east"), ("lat", F.min, "south"), ("lat", F.max, "north"))])
    return co.event_context(profiles(i), events, events, bounds).withColumns(R6("distance_km", "time_offset_hours"))


@query("C12_profiles_in_calendar_window", """
SELECT case_id, profile_id, strftime(ts, '%Y-%m') AS month FROM profiles WHERE strftime(ts, '%Y-%m') IN ('2023-12', '2024-01')""", ("profiles",))
def c12(i):
    months = i.spark.createDataFrame([("2023-12",), ("2024-01",)], "month string")
    return co.profiles_in_months(profiles(i), months).select("case_id", "profile_id", "month")


COLUMN_PAIRS = """SELECT case_id, it, iy * 15 + ix AS flat, max(CASE WHEN iz = 0 THEN value END) AS surface, max(CASE WHEN iz = 4 THEN value END) AS deep
  FROM grid WHERE iz IN (0, 4) GROUP BY 1, 2, 3"""


@query("C13_contrast_pair", f"""
WITH c AS ({COLUMN_PAIRS}), p AS (SELECT a.case_id, max(struct_pack(k := abs(b.deep - a.deep), na := -a.flat, nb := -b.flat)) AS m
  FROM c a JOIN c b ON a.case_id = b.case_id AND a.it = 1 AND b.it = 2 AND abs(b.surface - a.surface) <= 0.5 AND a.deep IS NOT NULL AND b.deep IS NOT NULL GROUP BY 1)
SELECT case_id, m.k AS contrast, -m.na AS a_flat, -m.nb AS b_flat FROM p""", ("grid",))
def c13(i):
    level = lambda z: F.max(F.when(F.col("iz") == z, F.col("value")))
    columns = i.cells.filter(F.col("iz").isin(0, 4)).groupBy("case_id", "it", (F.col("iy") * 15 + F.col("ix")).alias("flat")).agg(
        level(0).alias("surface"), level(4).alias("deep"))
    return co.contrast_pair(columns.filter("it = 1"), columns.filter("it = 2"), ["case_id"], 0.5)


@query("C19_settings_sweep", """
WITH m AS (SELECT setting_id, case_id, count(residual) AS matched, avg(residual) AS bias, sqrt(avg(residual * residual)) AS rmse FROM match_sweep GROUP BY 1, 2)
SELECT m.setting_id, m.case_id, m.matched, round(m.bias, 6) AS bias, round(m.rmse, 6) AS rmse, m.matched - b.matched AS matched_change,
  round(m.bias - b.bias, 6) AS bias_change, round(m.rmse - b.rmse, 6) AS rmse_change FROM m JOIN m b ON b.case_id = m.case_id AND b.setting_id = 0""", ("match_sweep",))
def c19(i):
    return cov.sweep_difference(matches(i, SWEEP), 0).withColumns(R6("bias", "rmse", "bias_change", "rmse_change"))


METRICS = """count(residual) AS matched, round(avg(residual), 9) AS bias, round(sqrt(avg(residual * residual)), 9) AS rmse, round(avg(abs(residual)), 9) AS mae,
  round(max(abs(residual)), 9) AS max_abs_residual"""


@query("A1_residual_metrics", f"SELECT case_id, profile_id, {METRICS} FROM match GROUP BY 1, 2", ("match",))
def a1(i):
    return cov.residual_metrics(matches(i), "case_id", "profile_id").withColumns(R9("bias", "rmse", "mae", "max_abs_residual"))


@query("A2_exclusion_counts", "SELECT case_id, profile_id, reason, count(*) AS n FROM match WHERE NOT accepted GROUP BY 1, 2, 3", ("match",))
def a2(i):
    return cov.exclusion_counts(matches(i), "case_id", "profile_id")


@query("A2_exclusion_map", """SELECT case_id, profile_id, '{' || string_agg('"' || reason || '":' || CAST(n AS VARCHAR), ',' ORDER BY reason) || '}' AS exclusion_counts FROM (
  SELECT case_id, profile_id, reason, count(*) AS n FROM match WHERE NOT accepted GROUP BY 1, 2, 3) q GROUP BY 1, 2""", ("match",))
def a2b(i):
    """The nested form, as the guarded table output writes it."""
    from brinefield.sources.tables import guarded
    return guarded(cov.exclusion_map(matches(i), "case_id", "profile_id"))


@query("A3_eligible_depths", "SELECT setting_id, case_id, profile_id, sample_index, depth_m FROM match WHERE accepted", ("match",))
def a3c(i):
    return cov.eligible_depths(matches(i))


COVER = f"""SELECT setting_id, case_id, profile_id, count(*) AS total, {METRICS}, count(*) FILTER (WHERE NOT accepted) AS excluded,
  round(coalesce(min(time_offset_hours) FILTER (WHERE accepted), min(time_offset_hours)), 6) AS offset_min,
  round(coalesce(max(time_offset_hours) FILTER (WHERE accepted), max(time_offset_hours)), 6) AS offset_max,
  round(min(abs(time_offset_hours)) FILTER (WHERE accepted), 6) AS min_abs_offset, round(min(distance_km) FILTER (WHERE accepted), 6) AS distance_min,
  round(max(distance_km) FILTER (WHERE accepted), 6) AS distance_max, min(depth_m) FILTER (WHERE accepted) AS depth_min, max(depth_m) FILTER (WHERE accepted) AS depth_max
  FROM match GROUP BY 1, 2, 3"""
register_cte("cover", COVER, ("match",))
COVER_ROUND = ("offset_min", "offset_max", "min_abs_offset", "distance_min", "distance_max")


@query("A3_coverage_profiles", "SELECT * FROM cover", ("cover",))
def a3(i):
    return cov.profile_coverage(matches(i)).withColumns({**R6(*COVER_ROUND), **R9("bias", "rmse", "mae", "max_abs_residual")})


@query("A3_coverage_total", """SELECT setting_id, case_id, count(*) AS total_profiles, count(*) FILTER (WHERE matched > 0) AS matched_profiles, CAST(sum(total) AS BIGINT) AS total_samples,
  CAST(sum(matched) AS BIGINT) AS matched_samples, CAST(sum(excluded) AS BIGINT) AS excluded_samples FROM cover GROUP BY 1, 2""", ("cover",))
def a3b(i):
    return cov.library_coverage(cov.profile_coverage(matches(i)))


@query("W23_rank_profiles", """
SELECT case_id, profile_id, row_number() OVER (PARTITION BY case_id ORDER BY min_abs_offset, distance_min, profile_id) AS rank FROM cover WHERE matched > 0""", ("cover",))
def w23(i):
    return cov.rank_profiles(cov.profile_coverage(matches(i))).select("case_id", "profile_id", "rank")


@query("W23_rank_by_residual", """
SELECT case_id, profile_id, row_number() OVER (PARTITION BY case_id ORDER BY max_abs_residual DESC, profile_id) AS rank FROM cover WHERE matched > 0""", ("cover",))
def w23b(i):
    c = cov.profile_coverage(matches(i)).withColumns(R9("max_abs_residual"))
    return cov.rank_profiles(c, "residual").select("case_id", "profile_id", "rank")


CHECKS = ("rows_consistent", "accepted_plus_excluded_is_total", "accepted_counts_agree", "reason_counts_add_up", "bias_recomputes")


@query("E15_accounting_check", f"""
SELECT setting_id, case_id, c."check", true AS passed FROM (SELECT DISTINCT setting_id, case_id FROM match) m,
(VALUES {', '.join(f"('{c}')" for c in CHECKS)}) c("check")""", ("match",))
def e15(i):
    return cov.accounted(matches(i))[1]


@query("E15_accounting_broken", """
WITH r AS (SELECT *, CASE WHEN sample_index % 7 = 0 THEN residual + 0.5 ELSE residual END AS told FROM match),
 n AS (SELECT setting_id, case_id, count(*) AS n, count(*) FILTER (WHERE accepted) AS ok, count(*) FILTER (WHERE accepted AND sample_index % 7 = 0) AS off,
   count(*) FILTER (WHERE NOT accepted AND reason <> 'time_window') AS r, avg(told) AS bias FROM r GROUP BY 1, 2),
 c AS (SELECT setting_id, case_id, sum(total) AS t, sum(matched) AS m, sum(excluded) AS x, sum(bias * matched) / nullif(sum(matched), 0) AS b FROM cover
   WHERE profile_id NOT LIKE '%7' GROUP BY 1, 2)
SELECT setting_id, case_id, unnest(['rows_consistent', 'accepted_plus_excluded_is_total', 'accepted_counts_agree', 'reason_counts_add_up', 'bias_recomputes']) AS "check",
  unnest([off = 0, m + x = t AND t = n, ok = m, r = x, coalesce(abs(bias - b) <= 1e-7 * greatest(1, abs(bias), abs(b)), bias IS NULL AND b IS NULL)]) AS passed FROM n JOIN c USING (setting_id, case_id)""",
       ("match", "cover"))
def e15b(i):
    """Residuals that were changed, profiles and a reason that were left out: the checks that must fail do."""
    m = cut(matches(i))
    told = m.withColumn("residual", F.when(F.col("sample_index") % 7 == 0, F.col("residual") + 0.5).otherwise(F.col("residual")))
    coverage = cov.profile_coverage(m).filter("profile_id NOT LIKE '%7'")
    return cov.accounting_check(told, coverage, cov.exclusion_counts(m, "setting_id", "case_id").filter("reason != 'time_window'"))
