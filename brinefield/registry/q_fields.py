"""Column diagnostics, gradients, tracks and reproducible sums."""

from pyspark.sql import functions as F

from brinefield.functions import digest
from brinefield.operators import columns as wc
from brinefield.operators import tracks as tk
from brinefield.registry.core import query
from brinefield.registry.projections import register_cte

register_cte("column10", "SELECT g.*, z.depth FROM dense g JOIN ax_depth z ON z.case_id = g.case_id AND z.idx = g.iz WHERE z.depth >= 10", ("dense", "ax_depth"))


def _mld(thr, absolute):
    size = "abs(value - v0)" if absolute else "value - v0"
    target = f"CASE WHEN value - v0 < 0 THEN -{thr} ELSE {thr} END" if absolute else f"{thr}"
    return f"""
WITH c AS (SELECT *, first_value(value) OVER w AS v0, lag(depth) OVER w AS pd, lag(value) OVER w AS pv FROM column10 WINDOW w AS (PARTITION BY case_id, it, iy, ix ORDER BY iz)),
 e AS (SELECT *, depth > 10 AND (value IS NULL OR {size} >= {thr}) AS hit FROM c),
 f AS (SELECT case_id, it, iy, ix, min(iz) FILTER (WHERE hit) AS k, any_value(v0) AS v0 FROM e GROUP BY 1, 2, 3, 4),
 j AS (SELECT f.*, e.value, e.depth, e.pd, e.pv FROM f LEFT JOIN e ON e.case_id = f.case_id AND e.it = f.it AND e.iy = f.iy AND e.ix = f.ix AND e.iz = f.k)
SELECT case_id, it, iy, ix, v0 AS reference_value, CASE WHEN v0 IS NULL THEN 'reference_unavailable' WHEN k IS NULL THEN 'no_crossing' WHEN value IS NULL THEN 'missing_support' ELSE 'crossing' END AS status,
  round(CASE WHEN v0 IS NOT NULL AND value IS NOT NULL THEN pd + (depth - pd) * ({target} - (pv - v0)) / ((value - v0) - (pv - v0)) END, 6) AS depth_m,
  CASE WHEN v0 IS NULL THEN NULL WHEN k IS NULL THEN 250 WHEN value IS NULL THEN pd ELSE depth END AS supported_to_m FROM j"""


_ALL_COLS = " WHERE EXISTS (SELECT 1 FROM grid g WHERE g.case_id = j.case_id AND g.it = j.it AND g.iy = j.iy AND g.ix = j.ix)"


@query("W13_mixed_layer", _mld(6, False) + _ALL_COLS, ("column10", "grid"))
def w13(i):
    return wc.mixed_layer(i.cells, i.axes, 6.0).withColumn("depth_m", F.round("depth_m", 6))


@query("W13_mixed_layer_absolute", _mld(10, True) + _ALL_COLS, ("column10", "grid"))
def w13b(i):
    return wc.mixed_layer(i.cells, i.axes, 10.0, True).withColumn("depth_m", F.round("depth_m", 6))


@query("W14_layer_gradient", """
WITH n AS (SELECT g.case_id, it, iy, ix, g.iz, z.depth AS top_m, b.depth AS bottom_m, g.value, (SELECT h.value FROM grid h WHERE h.case_id = g.case_id AND h.it = g.it AND h.iy = g.iy AND h.ix = g.ix AND h.iz = g.iz + 1) AS below
 FROM grid g JOIN ax_depth z ON z.case_id = g.case_id AND z.idx = g.iz JOIN ax_depth b ON b.case_id = g.case_id AND b.idx = g.iz + 1)
SELECT case_id, it, iy, ix, iz, top_m, bottom_m, round((below - value) / (bottom_m - top_m), 6) AS gradient FROM n""", ("grid", "ax_depth"))
def w14(i):
    return wc.layer_gradient(i.cells, i.axes).withColumn("gradient", F.round("gradient", 6))


@query("W15_column_integral", """
WITH p AS (SELECT g.case_id, g.it, g.iy, g.ix, z.depth, g.value, lead(g.value) OVER w AS nv, lead(z.depth) OVER w AS nd FROM dense g JOIN ax_depth z ON z.case_id = g.case_id AND z.idx = g.iz
  WHERE z.depth <= 100 WINDOW w AS (PARTITION BY g.case_id, g.it, g.iy, g.ix ORDER BY z.depth))
SELECT case_id, it, iy, ix, CASE WHEN count(value) = 5 THEN sum((value + nv) / 2 * (nd - depth)) END AS integral, CASE WHEN count(value) = 5 THEN 'available' ELSE 'missing_support' END AS status
FROM p j WHERE EXISTS (SELECT 1 FROM grid g JOIN ax_depth z ON z.case_id = g.case_id AND z.idx = g.iz AND z.depth <= 100 WHERE g.case_id = j.case_id AND g.it = j.it AND g.iy = j.iy AND g.ix = j.ix) GROUP BY 1, 2, 3, 4""",
       ("dense", "grid", "ax_depth"))
def w15(i):
    return wc.column_integral(i.cells, i.axes, 100.0)


_HAV = "(2 * 6371.0088 * asin(sqrt(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))))"
_LAT, _LON = "(10 + 0.25 * {})", "(85 + 0.25 * {})"
_KX = _HAV.format(y1=_LAT.format("g.iy"), y2=_LAT.format("g.iy"), x1=_LON.format("greatest(g.ix - 1, 0)"), x2=_LON.format("least(g.ix + 1, 14)"))
_KY = _HAV.format(y1=_LAT.format("greatest(g.iy - 1, 0)"), y2=_LAT.format("least(g.iy + 1, 11)"), x1=_LON.format("g.ix"), x2=_LON.format("g.ix"))
_AT = "(SELECT value FROM ok h WHERE h.case_id = g.case_id AND h.it = g.it AND h.iz = g.iz AND h.iy = {} AND h.ix = {})"


@query("W16_field_gradient", f"""
WITH ok AS (SELECT * FROM grid WHERE value IS NOT NULL), d AS (SELECT g.*, ({_AT.format('g.iy', 'least(g.ix + 1, 14)')} - {_AT.format('g.iy', 'greatest(g.ix - 1, 0)')}) / {_KX} AS a,
  ({_AT.format('least(g.iy + 1, 11)', 'g.ix')} - {_AT.format('greatest(g.iy - 1, 0)', 'g.ix')}) / {_KY} AS b FROM ok g)
SELECT case_id, it, iz, iy, ix, round(a, 6) AS d_lon, round(b, 6) AS d_lat, round(sqrt(a * a + b * b), 6) AS gradient FROM d""", ("grid",))
def w16(i):
    g = wc.field_gradient(i.cells, i.axes)
    return g.select("case_id", "it", "iz", "iy", "ix", *[F.round(c, 6).alias(c) for c in ("d_lon", "d_lat", "gradient")])


# Tracks: whole minutes since each particle's first point

register_cte("paths", """SELECT particle_id, event_id AS point_id, lon, lat, CAST(floor((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY particle_id))) / 6e7) AS BIGINT) * 60 AS elapsed_s FROM tracks""", ("tracks",))
register_cte("steps", """SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, lag(elapsed_s) OVER w AS ps FROM paths WINDOW w AS (PARTITION BY particle_id ORDER BY elapsed_s, point_id)""", ("paths",))


def paths(i):
    t = i.tracks
    start = t.groupBy("particle_id").agg(F.min("ts").alias("_t0"))
    minutes = F.floor((F.unix_micros("ts") - F.unix_micros("_t0")) / 6e7)
    return t.join(start, "particle_id").select("particle_id", F.col("event_id").alias("point_id"), "lon", "lat", (minutes * 60).alias("elapsed_s"))


_STEP = "sqrt(pow((lon - plon) * cos(radians((lat + plat) * 0.5)), 2) + pow(lat - plat, 2)) * 111.12"


@query("W17_step_distance", f"""SELECT particle_id, point_id, elapsed_s, round(coalesce({_STEP}, 0), 5) AS step_km,
  round(sum(coalesce({_STEP}, 0)) OVER (PARTITION BY particle_id ORDER BY elapsed_s, point_id ROWS UNBOUNDED PRECEDING), 5) AS path_km FROM steps""", ("steps",))
def w17(i):
    return tk.path_length(paths(i)).select("particle_id", "point_id", "elapsed_s", F.round("step_km", 5).alias("step_km"), F.round("path_km", 5).alias("path_km"))


@query("W18_resample_track", """SELECT particle_id, point_id, elapsed_s, lon, lat FROM (SELECT *, row_number() OVER (PARTITION BY particle_id ORDER BY elapsed_s DESC, point_id DESC) AS r FROM paths) t
WHERE elapsed_s % 1800 = 0 OR r = 1""", ("paths",))
def w18(i):
    return tk.resample_track(paths(i), 1800).select("particle_id", "point_id", "elapsed_s", "lon", "lat")


BOX = (86.0, 10.8, 86.6, 11.3)


def _span(a, b, lo, hi):
    d = f"({b} - {a})"
    return (f"CASE WHEN {d} = 0 THEN 0 ELSE least(({lo} - {a}) / {d}, ({hi} - {a}) / {d}) END", f"CASE WHEN {d} = 0 THEN 1 ELSE greatest(({lo} - {a}) / {d}, ({hi} - {a}) / {d}) END",
            f"({d} = 0 AND NOT {a} BETWEEN {lo} AND {hi})")


_X, _Y = _span("plon", "lon", BOX[0], BOX[2]), _span("plat", "lat", BOX[1], BOX[3])


@query("W19_target_entry", f"""
WITH c AS (SELECT *, greatest(0, {_X[0]}, {_Y[0]}) AS lo, least(1, {_X[1]}, {_Y[1]}) AS hi, {_X[2]} OR {_Y[2]} AS miss FROM steps)
SELECT particle_id, round(min(CASE WHEN ps IS NULL THEN CASE WHEN lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]} THEN 0 END
  WHEN NOT miss AND lo <= hi THEN ps + (elapsed_s - ps) * lo END), 4) AS entry_s FROM c GROUP BY 1""", ("steps",))
def w19(i):
    return tk.target_entry(paths(i), BOX).withColumn("entry_s", F.round("entry_s", 4))


SEGMENTS = """SELECT event_id AS segment_id, CAST(floor(event_id / 3334e0) AS BIGINT) AS case_id, 1704844800e0 + event_id % 500000 * 0.5e0 AS t0, 1704844800e0 + event_id % 500000 * 0.5e0 + 3600 AS t1,
  85 + CAST(event_id * 53 % 341 AS DOUBLE) / 100 AS lon0, 10 + CAST(event_id * 37 % 266 AS DOUBLE) / 100 AS lat0,
  85 + CAST(event_id * 53 % 341 + event_id % 10 AS DOUBLE) / 100 AS lon1, 10 + CAST(event_id * 37 % 266 + event_id % 7 AS DOUBLE) / 100 AS lat1 FROM {events}"""
register_cte("wet", """SELECT case_id, it, iy - b AS cy, ix - a AS cx FROM grid, (VALUES (0), (1)) q(a), (VALUES (0), (1)) r(b) WHERE iz = 1 AND u IS NOT NULL AND v IS NOT NULL GROUP BY ALL HAVING count(*) = 4""", ("grid",))


@query("W20_segment_support", f"""
WITH s AS ({SEGMENTS.format(events='events')}), f AS (SELECT case_id, it, epoch_us(ts) / 1e6 AS t FROM frames),
 n AS (SELECT segment_id, s.case_id, f.it, y.idx AS cy, x.idx AS cx FROM s JOIN f ON f.case_id = s.case_id AND f.t >= coalesce((SELECT max(t) FROM f g WHERE g.case_id = s.case_id AND g.t <= t0), 0)
   AND f.t <= coalesce((SELECT min(t) FROM f g WHERE g.case_id = s.case_id AND g.t >= t1), 9e99)
  JOIN ax_lon x ON x.case_id = s.case_id AND x.idx BETWEEN least(13, floor((lon0 - 85) * 4 + 1e-9)) AND least(13, floor((lon1 - 85) * 4 + 1e-9))
  JOIN ax_lat y ON y.case_id = s.case_id AND y.idx BETWEEN least(10, floor((lat0 - 10) * 4 + 1e-9)) AND least(10, floor((lat1 - 10) * 4 + 1e-9)))
SELECT n.segment_id, count(*) AS cells_needed, count(w.cy) AS cells_wet, count(*) = count(w.cy) AS supported FROM n LEFT JOIN wet w USING (case_id, it, cy, cx) GROUP BY 1""", ("frames", "wet", "ax_lon", "ax_lat"))
def w20(i):
    return tk.segment_support(i.sql(SEGMENTS, "events"), i.grid, i.index, i.frames, 1, "segment_id")


PARTICLES = """SELECT user_id % 5 AS run_id, event_id, CASE event_id % 7 WHEN 0 THEN 'invalid_release' WHEN 1 THEN 'left_domain' WHEN 2 THEN 'missing_velocity' ELSE 'completed' END AS status,
  CASE WHEN event_id % 3 = 0 AND event_id % 7 > 0 THEN CAST(event_id % 7200 AS DOUBLE) END AS arrival_s, CAST(event_id % 400 AS DOUBLE) / 4 AS distance_km FROM {events}"""


@query("A11_drift_run_summary", f"""
SELECT run_id, count(*) AS released, count(*) FILTER (WHERE status <> 'invalid_release') AS valid_releases, count(*) FILTER (WHERE status = 'completed') AS completed,
  count(*) FILTER (WHERE status = 'invalid_release') AS invalid_release, count(*) FILTER (WHERE status = 'left_domain') AS left_domain, count(*) FILTER (WHERE status = 'missing_velocity') AS missing_velocity,
  count(arrival_s) AS arrived, round(count(arrival_s) / count(*), 6) AS arrival_fraction, min(arrival_s) AS earliest_arrival_s, max(arrival_s) AS latest_arrival_s,
  round(avg(distance_km) FILTER (WHERE status <> 'invalid_release'), 6) AS mean_distance_km FROM ({PARTICLES.format(events='events')}) t GROUP BY 1""")
def a11(i):
    return tk.run_summary(i.sql(PARTICLES, "events")).withColumns({"arrival_fraction": F.round("arrival_fraction", 6), "mean_distance_km": F.round("mean_distance_km", 6)})


RELEASES = """SELECT s_suppkey AS release_id, s_suppkey * 77777 % 100000 AS seed, 5 + s_suppkey % 40 AS count, 85e0 AS west, 10e0 AS south, 88.5e0 AS east, 12.75e0 AS north FROM {supplier}"""


@query("F9_seeded_points_in_box", f"""
WITH RECURSIVE r AS ({RELEASES.format(supplier='supplier')}), s(release_id, k, state, n) AS (SELECT release_id, 0, CAST(seed AS HUGEINT), count FROM r
 UNION ALL SELECT release_id, k + 1, (state * 1664525 + 1013904223) % 4294967296, n FROM s WHERE k < 2 * n)
SELECT a.release_id, (a.k + 1) // 2 AS point, round((a.state::DOUBLE + 0.5) / 4294967296 * 3.5 + 85, 9) AS lon, round((b.state::DOUBLE + 0.5) / 4294967296 * 2.75 + 10, 9) AS lat
FROM s a JOIN s b ON b.release_id = a.release_id AND b.k = a.k + 1 WHERE a.k % 2 = 1""")
def f9(i):
    return tk.seeded_points(i.sql(RELEASES, "supplier")).withColumns({"lon": F.round("lon", 9), "lat": F.round("lat", 9)})


@query("A5_ordered_sum", """SELECT case_id, it, iz, sum(value) AS total, sum(CAST(round(value * 1000000) AS HUGEINT))::DOUBLE / 1000000 AS exact_total FROM grid GROUP BY 1, 2, 3""", ("grid",))
def a5(i):
    return i.cells.groupBy("case_id", "it", "iz").agg(F.sum("value").alias("total"), digest.exact_sum(F.col("value"), 6).alias("exact_total"))
