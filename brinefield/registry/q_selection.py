"""Selection, projection and sampling queries (P rows, S14-S16, S20, C20)."""

from pyspark.sql import functions as F

from brinefield.operators import axes as ax
from brinefield.operators import selection as sel
from brinefield.registry.core import query
from brinefield.registry.projections import NX, NY, NZ, register_cte

BBOX = (85.5, 10.5, 87.25, 12.0)
KEYS = ["case_id", "it", "iz", "iy", "ix"]

AX3 = ("ax_depth", "ax_lat", "ax_lon")
COORDS = ("JOIN ax_depth zd ON zd.case_id = g.case_id AND zd.idx = g.iz JOIN ax_lat yd ON yd.case_id = g.case_id AND yd.idx = g.iy "
          "JOIN ax_lon xd ON xd.case_id = g.case_id AND xd.idx = g.ix")


@query("P1_subset", f"""
SELECT g.case_id, g.it, g.iz, g.iy, g.ix, depth, lat, lon, g.value FROM grid g {COORDS}
WHERE g.it = 2 AND lon BETWEEN 85.5 AND 87.25 AND lat BETWEEN 10.5 AND 12.0""", ("grid", *AX3))
def p1(i):
    return sel.subset(i.cells, i.axes, 2, BBOX)


@query("P1_subset_slice", f"""
SELECT g.case_id, g.it, g.iz, g.iy, g.ix, depth, lat, lon, g.value FROM grid g {COORDS} WHERE g.it = 4 AND g.iz = 3""", ("grid", *AX3))
def p1b(i):
    return sel.subset(i.cells, i.axes, 4, None, depth_index=3)


@query("P1_subset_status", """
SELECT case_id, (SELECT count(*) FROM ax_depth z WHERE z.case_id = c.case_id)
  * (SELECT count(*) FROM ax_lat y WHERE y.case_id = c.case_id AND lat BETWEEN 10.5 AND 12.0)
  * (SELECT count(*) FROM ax_lon x WHERE x.case_id = c.case_id AND lon BETWEEN 84 AND 87.25) AS "values",
  'outside_coverage' AS status FROM cases c""", ("cases", *AX3))
def p1c(i):
    return sel.subset_status(i.axes.join(i.cells.select("case_id").distinct(), "case_id", "left_semi"), (84.0, 10.5, 87.25, 12.0))


CYC = "85 + (((lon - 85.75) % 360 + 360) % 360) + 0.75"


@query("P2_subset_cyclic", f"""
WITH lonx AS (SELECT case_id, idx, {CYC} AS u FROM ax_lon),
 kept AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY u) - 1 AS jx FROM lonx WHERE u <= 85.75 + ((87.5 - 85.75 + 360) % 360) + 1e-10)
SELECT g.case_id, g.iz, g.iy, g.ix, k.jx, depth, lat, k.u AS lon, g.value FROM grid g
JOIN kept k ON k.case_id = g.case_id AND k.idx = g.ix JOIN ax_lat y ON y.case_id = g.case_id AND y.idx = g.iy
JOIN ax_depth z ON z.case_id = g.case_id AND z.idx = g.iz
WHERE g.it = 1 AND lat BETWEEN 10.5 AND 12.25 AND depth BETWEEN 10 AND 160""", ("grid", *AX3))
def p2(i):
    return sel.subset_cyclic(i.cells, i.axes, 1, 85.75, 87.5, 10.5, 12.25, 10, 160)


@query("P3_preview", """
SELECT c.case_id, x.nx, x.west, x.east, y.ny, y.south, y.north, z.nz, z.level_min, z.level_max,
  nx * ny * nz AS native_values, nx * ny * nz * 24 AS estimated_bytes, false AS crosses_date_line
FROM (SELECT DISTINCT case_id FROM grid) c
JOIN (SELECT case_id, count(*) nx, min(lon) west, max(lon) east FROM ax_lon WHERE lon BETWEEN 85.75 AND 87.5 GROUP BY 1) x USING (case_id)
JOIN (SELECT case_id, count(*) ny, min(lat) south, max(lat) north FROM ax_lat WHERE lat BETWEEN 10.5 AND 12.25 GROUP BY 1) y USING (case_id)
JOIN (SELECT case_id, count(*) nz, min(depth) level_min, max(depth) level_max FROM ax_depth WHERE depth BETWEEN 10 AND 160 GROUP BY 1) z USING (case_id)
""", ("grid", *AX3))
def p3(i):
    axes = i.axes.join(i.cells.select("case_id").distinct(), "case_id", "left_semi")
    return sel.preview(axes, 85.75, 87.5, 10.5, 12.25, 10, 160)


@query("P4_validate_and_scale", """
SELECT case_id, it, iz, iy, ix, CASE WHEN value IS NOT NULL AND value <> 25 AND value BETWEEN 1 AND 24 THEN value * 2 - 3.5e0 END AS value,
  false AS suspect FROM grid""", ("grid",))
def p4(i):
    return sel.validate_and_scale(i.cells, 25.0, 1.0, 24.0, 2.0, -3.5)


@query("P5_nearest_profile", """
WITH bx AS (SELECT case_id, arg_min(idx, (abs(lon - 86.37), idx)) ix FROM ax_lon GROUP BY 1),
     byy AS (SELECT case_id, arg_min(idx, (abs(lat - 11.125), idx)) iy FROM ax_lat GROUP BY 1)
SELECT g.case_id, g.iz, g.iy, g.ix, depth, lat, lon, g.value FROM grid g JOIN bx USING (case_id, ix) JOIN byy USING (case_id, iy)
JOIN ax_depth zd ON zd.case_id = g.case_id AND zd.idx = g.iz JOIN ax_lat yd ON yd.case_id = g.case_id AND yd.idx = g.iy
JOIN ax_lon xd ON xd.case_id = g.case_id AND xd.idx = g.ix WHERE g.it = 3""", ("grid", *AX3))
def p5(i):
    return sel.nearest_profile(i.cells, i.axes, 3, 86.37, 11.125)


@query("P6_pack_with_uncertainty", "SELECT case_id, it, iz, iy, ix, value, abs(u) AS uncertainty FROM grid", ("grid",))
def p6(i):
    return sel.pack_with_uncertainty(i.grid.select(*KEYS, "value"), i.grid.select(*KEYS, F.abs("u").alias("value")))


@query("P7_native_column", """
SELECT g.case_id, it, iz, depth, value, u, v, round(sqrt(u*u + v*v), 6) AS speed FROM grid g
JOIN ax_depth z ON z.case_id = g.case_id AND z.idx = g.iz WHERE ix = 4 AND iy = 7""", ("grid", "ax_depth"))
def p7(i):
    return sel.native_column(i.grid, i.axes, 4, 7, ["value", "u", "v"]).withColumn("speed", F.round("speed", 6))


@query("P8_derived_product", """
SELECT case_id, it, iz, iy, ix, round(sqrt(u*u + v*v), 6) AS product FROM grid""", ("grid",))
def p8(i):
    return sel.derived_product(i.grid, "horizontal_speed", "product").select(*KEYS, F.round("product", 6).alias("product"))


@query("P9_kinetic_energy", "SELECT case_id, it, iz, iy, ix, (u*u + v*v)/2 AS ke FROM grid", ("grid",))
def p9(i):
    return sel.derived_product(i.grid, "horizontal_kinetic_energy", "ke").select(*KEYS, "ke")


@query("P10_horizontal_speed", """
SELECT case_id, it, iz, count(sqrt(u*u+v*v)) AS n, round(max(sqrt(u*u + v*v)), 6) AS fastest, round(avg(sqrt(u*u + v*v)), 6) AS mean_speed
FROM grid GROUP BY 1, 2, 3""", ("grid",))
def p10(i):
    speed = sel.horizontal_speed(F.col("u"), F.col("v"))
    return i.grid.groupBy("case_id", "it", "iz").agg(F.count(speed).alias("n"), F.round(F.max(speed), 6).alias("fastest"),
                                                     F.round(F.avg(speed), 6).alias("mean_speed"))


@query("P11_depth_window", """
SELECT g.case_id, it, iz, iy, ix, value, depth FROM grid g JOIN ax_depth z ON z.case_id = g.case_id AND z.idx = g.iz WHERE depth <= 60""",
       ("grid", "ax_depth"))
def p11(i):
    return sel.depth_window(i.cells, i.axes, 60)


@query("P12_depth_coverage", f"""
WITH n AS (SELECT case_id, it, iz, count(value) k FROM grid GROUP BY 1, 2, 3),
 f AS (SELECT DISTINCT case_id, it FROM grid),
 a AS (SELECT f.case_id, f.it, z.idx AS iz, depth, coalesce(k, 0) AS valid FROM f JOIN ax_depth z USING (case_id)
       LEFT JOIN n ON n.case_id = f.case_id AND n.it = f.it AND n.iz = z.idx)
SELECT case_id, it, iz, depth, valid, CASE WHEN valid = 0 THEN 'empty' WHEN valid < {NY * NX} THEN 'partial' ELSE 'full' END AS state,
  max(CASE WHEN valid > 0 THEN depth END) OVER (PARTITION BY case_id, it) AS deepest FROM a""", ("grid", "ax_depth"))
def p12(i):
    return sel.depth_coverage(i.cells, i.axes)


SAMPLE_POINTS = """
SELECT event_id, CAST(floor(event_id / 3334e0) AS BIGINT) AS case_id, CAST(event_id % 7 AS INT) AS it,
  85 + CAST(event_id * 53 % 351 AS DOUBLE) / 100 AS lon, 10 + CAST(event_id * 37 % 276 AS DOUBLE) / 100 AS lat,
  CAST(event_id * 17 % 2600 AS DOUBLE) / 10 AS depth_m, CAST(ts AS TIMESTAMP) AS ts FROM {events}"""
register_cte("spots", SAMPLE_POINTS.format(events="events"))
for _axis, _v in (("lon", "lon"), ("lat", "lat"), ("depth", "depth")):
    register_cte(f"cells_{_axis}", f"""SELECT case_id, idx AS i0, {_v} AS a, lead({_v}) OVER w AS b,
      row_number() OVER (PARTITION BY case_id ORDER BY idx DESC) = 2 AS last_cell FROM ax_{_axis} WINDOW w AS (PARTITION BY case_id ORDER BY idx)""",
                 (f"ax_{_axis}",))


def _in(c, value):
    return f"{value} >= {c}.a AND ({value} < {c}.b OR ({c}.last_cell AND {value} = {c}.b))"


@query("P13_trilinear_sample", f"""
WITH br AS (SELECT p.*, x.i0 AS i, y.i0 AS j, z.i0 AS k, (lon - x.a) / (x.b - x.a) AS fx, (lat - y.a) / (y.b - y.a) AS fy,
    (depth_m - z.a) / (z.b - z.a) AS fz FROM spots p
  JOIN cells_lon x ON x.case_id = p.case_id AND {_in('x', 'lon')} JOIN cells_lat y ON y.case_id = p.case_id AND {_in('y', 'lat')}
  JOIN cells_depth z ON z.case_id = p.case_id AND {_in('z', 'depth_m')}),
 bits AS (SELECT a, b, c FROM (VALUES (0), (1)) q(a), (VALUES (0), (1)) r(b), (VALUES (0), (1)) s(c)),
 w AS (SELECT event_id, case_id, it, i + a AS ix, j + b AS iy, k + c AS iz,
    (CASE a WHEN 1 THEN fx ELSE 1 - fx END) * (CASE b WHEN 1 THEN fy ELSE 1 - fy END) * (CASE c WHEN 1 THEN fz ELSE 1 - fz END) AS w
  FROM br, bits),
 s AS (SELECT w.event_id, CASE WHEN count(*) = count(g.value) THEN sum(w.w * g.value) END AS sampled FROM w
  LEFT JOIN grid g USING (case_id, it, iz, iy, ix) WHERE w.w > 1e-12 GROUP BY 1)
SELECT p.event_id, p.case_id, p.it, p.lon, p.lat, p.depth_m, round(s.sampled, 6) AS sampled FROM spots p LEFT JOIN s USING (event_id)
""", ("grid", "spots", "cells_lon", "cells_lat", "cells_depth"))
def p13(i):
    points = i.sql(SAMPLE_POINTS, "events").drop("ts")
    return sel.trilinear_sample(points, i.columns, i.index, "event_id").withColumn("sampled", F.round("sampled", 6))


@query("P14_normalize_longitude", """
SELECT event_id, lon, CASE WHEN lon >= -180 AND lon < 180 THEN lon ELSE ((lon + 180) % 360 + 360) % 360 - 180 END AS normalized,
  lon + 360 * floor((87.5 - lon) / 360 + 0.5) AS on_axis
FROM (SELECT event_id, CAST(event_id * 13 % 8000 AS DOUBLE) / 8 - 400 AS lon FROM events) t""")
def p14(i):
    lon = (F.col("event_id") * 13 % 8000).cast("double") / 8 - 400
    rows = i.table("events").select("event_id", lon.alias("lon"))
    return rows.select("event_id", "lon", sel.normalize_longitude(F.col("lon")).alias("normalized"),
                       sel.longitude_on_axis(F.col("lon"), F.lit(85.0), F.lit(90.0)).alias("on_axis"))


ARC_POINTS = """SELECT user_id % 50 AS grp, CAST((user_id * 53 + event_id % 40) % 2000 AS DOUBLE) / 8 - 100 AS lon FROM {events}"""


@query("P15_smallest_longitude_arc", f"""
WITH p AS (SELECT grp, (lon % 360 + 360) % 360 AS l FROM ({ARC_POINTS.format(events='events')}) t),
 d AS (SELECT DISTINCT grp, l FROM p),
 n AS (SELECT grp, l, coalesce(lead(l) OVER w, first_value(l) OVER w + 360) AS nx, coalesce(lead(l) OVER w, first_value(l) OVER w) AS st
       FROM d WINDOW w AS (PARTITION BY grp ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 s AS (SELECT grp, arg_max(st, (nx - l, -l)) AS st FROM n GROUP BY 1),
 u AS (SELECT p.grp, CASE WHEN l < st THEN l + 360 ELSE l END AS u FROM p JOIN s USING (grp)),
 c AS (SELECT grp, avg(u) AS c, min(u) AS a, max(u) AS z FROM u GROUP BY 1)
SELECT grp, round(CASE WHEN c >= -180 AND c < 180 THEN c ELSE (c + 180) % 360 - 180 END, 6) AS center, round(greatest(c - a, z - c), 6) AS half_span FROM c""")
def p15(i):
    out = sel.smallest_longitude_arc(i.sql(ARC_POINTS, "events"), ["grp"])
    return out.select("grp", F.round("center", 6).alias("center"), F.round("half_span", 6).alias("half_span"))


CONTEXTS = """
SELECT concat('ctx-', CAST(s_suppkey AS VARCHAR(20))) AS context_id, CAST(s_suppkey * 37 % 350 AS DOUBLE) - 175 AS west,
  CASE WHEN s_suppkey * 37 % 350 - 175 + 12 >= 180 THEN CAST(s_suppkey * 37 % 350 AS DOUBLE) - 175 + 12 - 360
       ELSE CAST(s_suppkey * 37 % 350 AS DOUBLE) - 175 + 12 END AS east,
  CAST(s_suppkey * 23 % 120 AS DOUBLE) - 60 AS south, CAST(s_suppkey * 23 % 120 AS DOUBLE) - 45 AS north,
  CAST('2024-01-05 00:00:00' AS TIMESTAMP) AS time_start, CAST('2024-01-20 00:00:00' AS TIMESTAMP) AS time_end FROM {supplier}"""
GLOBAL_POINTS = """SELECT event_id, CAST(event_id * 53 % 3600 AS DOUBLE) / 10 - 180 AS lon, CAST(event_id * 37 % 1400 AS DOUBLE) / 10 - 70 AS lat,
  CAST(ts AS TIMESTAMP) AS ts FROM {events}"""


@query("P16_points_in_cases", f"""
WITH c AS (SELECT *, CASE WHEN east < west THEN east + 360 ELSE east END AS e FROM ({CONTEXTS.format(supplier='supplier')}) t),
 p AS ({GLOBAL_POINTS.format(events='events')}),
 h AS (SELECT event_id, context_id, ts BETWEEN time_start AND time_end AS time_overlap FROM p JOIN c
  ON lon + 360 * floor(((west + e) / 2 - lon) / 360 + 0.5) BETWEEN west AND e AND lat BETWEEN south AND north)
SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY time_overlap DESC, context_id) AS rank FROM h""")
def p16(i):
    return sel.points_in_cases(i.sql(GLOBAL_POINTS, "events"), i.sql(CONTEXTS, "supplier"), "event_id")


@query("P17_first_eligible_position", """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY case_id, profile_id ORDER BY sample_index) AS rn FROM obs
  WHERE pressure_qc IN ('1','2') AND position_qc IN ('1','2') AND time_qc IN ('1','2') AND value IS NOT NULL AND lat <= 12.75 AND lon <= 88.5)
SELECT case_id, profile_id, sample_index, lon, lat, epoch_us(ts) AS t_us FROM e WHERE rn = 1""", ("obs",))
def p17(i):
    good = lambda c: F.col(c).isin("1", "2")
    rows = i.obs.withColumn("coordinate_eligible", good("pressure_qc") & good("position_qc") & good("time_qc"))
    return sel.first_eligible_position(rows, i.index).select("case_id", "profile_id", "sample_index", "lon", "lat", F.unix_micros("ts").alias("t_us"))


def _fx(c):
    return f"(CASE {c} WHEN 1 THEN f{{0}} ELSE 1 - f{{0}} END)"


@query("C20_space_time_sample", f"""
WITH tc AS (SELECT case_id, it AS i0, epoch_us(ts) / 1e6 AS a, lead(epoch_us(ts)) OVER w / 1e6 AS b,
   row_number() OVER (PARTITION BY case_id ORDER BY it DESC) = 2 AS last_cell FROM frames WINDOW w AS (PARTITION BY case_id ORDER BY it)),
 p AS (SELECT event_id, case_id, lon, lat, epoch_us(ts) / 1e6 AS t FROM spots),
 br AS (SELECT p.*, x.i0 AS i, y.i0 AS j, z.i0 AS k, (lon - x.a) / (x.b - x.a) AS fx, (lat - y.a) / (y.b - y.a) AS fy, (t - z.a) / (z.b - z.a) AS ft
  FROM p JOIN tc z ON z.case_id = p.case_id AND {_in('z', 't')} JOIN cells_lon x ON x.case_id = p.case_id AND {_in('x', 'lon')}
  JOIN cells_lat y ON y.case_id = p.case_id AND {_in('y', 'lat')}),
 w AS (SELECT event_id, case_id, k + c AS it, j + b AS iy, i + a AS ix,
   (CASE a WHEN 1 THEN fx ELSE 1 - fx END) * (CASE b WHEN 1 THEN fy ELSE 1 - fy END) * (CASE c WHEN 1 THEN ft ELSE 1 - ft END) AS w,
   CASE c WHEN 1 THEN ft ELSE 1 - ft END AS wt
  FROM br, (VALUES (0), (1)) q(a), (VALUES (0), (1)) r(b), (VALUES (0), (1)) s(c)),
 s AS (SELECT w.event_id, sum(w.w * g.u) AS u, sum(w.w * g.v) AS v, count(g.u + g.v) = count(*) AS ok FROM w
  LEFT JOIN grid g ON g.case_id = w.case_id AND g.it = w.it AND g.iy = w.iy AND g.ix = w.ix AND g.iz = 1 WHERE wt <> 0 GROUP BY 1)
SELECT p.event_id, CASE WHEN t NOT BETWEEN (SELECT min(a) FROM tc) AND (SELECT max(b) FROM tc) THEN 'forcing_exhausted'
   WHEN s.event_id IS NULL THEN 'outside' WHEN ok THEN 'ok' ELSE 'missing' END AS status,
   round(CASE WHEN ok THEN s.u END, 6) AS u, round(CASE WHEN ok THEN s.v END, 6) AS v
FROM p LEFT JOIN s USING (event_id)""", ("grid", "frames", "spots", "cells_lon", "cells_lat"))
def c20(i):
    points = i.sql(SAMPLE_POINTS, "events").select("event_id", "case_id", "lon", "lat", "ts")
    out = sel.space_time_sample(points, i.columns, i.index, i.frames, "event_id", 1)
    return out.select("event_id", "status", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


@query("S20_nearest_axis_location", """
WITH b AS (SELECT x.case_id, min(lon) w, max(lon) e, (SELECT min(lat) FROM ax_lat y WHERE y.case_id = x.case_id) s,
   (SELECT max(lat) FROM ax_lat y WHERE y.case_id = x.case_id) n FROM ax_lon x JOIN (SELECT DISTINCT case_id FROM grid) USING (case_id) GROUP BY 1),
 q AS (SELECT case_id, location, w + (e - w) * f AS lon, (s + n) / 2 AS lat FROM b, (VALUES ('west', .25e0), ('center', .5e0), ('east', .75e0)) v(location, f))
SELECT q.case_id, location, q.lon, q.lat, arg_min(x.idx, (abs(x.lon - q.lon), x.lon)) AS ix, arg_min(y.idx, (abs(y.lat - q.lat), y.lat)) AS iy,
  arg_min(x.lon, (abs(x.lon - q.lon), x.lon)) AS grid_lon, arg_min(y.lat, (abs(y.lat - q.lat), y.lat)) AS grid_lat
FROM q JOIN ax_lon x USING (case_id) JOIN ax_lat y USING (case_id) GROUP BY ALL""", ("grid", "ax_lat", "ax_lon"))
def s20(i):
    axes = i.axes.join(i.cells.select("case_id").distinct(), "case_id", "left_semi")
    return sel.nearest_axis_location(sel.quartile_positions(axes), axes)


@query("W1_midpoint_edges", """
SELECT case_id, axis, idx, coord, coalesce((lag(coord) OVER w + coord) / 2, coord) AS edge_low, coalesce((lead(coord) OVER w + coord) / 2, coord) AS edge_high
FROM axes JOIN (SELECT DISTINCT case_id FROM grid) USING (case_id) WINDOW w AS (PARTITION BY case_id, axis ORDER BY idx)""", ("axes", "grid"))
def w1(i):
    return ax.midpoint_edges(i.axes.join(i.cells.select("case_id").distinct(), "case_id", "left_semi"))


register_cte("edges", """SELECT case_id, axis, idx, coord, coalesce((lag(coord) OVER w + coord) / 2, coord) AS lo,
  coalesce((lead(coord) OVER w + coord) / 2, coord) AS hi FROM axes WINDOW w AS (PARTITION BY case_id, axis ORDER BY idx)""", ("axes",))
for _k, (_zmin, _zmax) in {"full": (0, 250), "window": (10, 160)}.items():
    register_cte(f"vol_{_k}", f"""
SELECT z.case_id, z.idx AS iz, y.idx AS iy, x.idx AS ix, z.coord AS depth,
  (pow(6371008.8 - z.lo2, 3) - pow(6371008.8 - z.hi2, 3)) / 3 * (sin(radians(y.hi)) - sin(radians(y.lo))) * radians(x.hi - x.lo) / 1e9 AS vol
FROM (SELECT *, least(greatest(lo, {_zmin}), {_zmax}) AS lo2, least(greatest(hi, {_zmin}), {_zmax}) AS hi2 FROM edges WHERE axis = 'depth') z
JOIN edges y ON y.case_id = z.case_id AND y.axis = 'lat' JOIN edges x ON x.case_id = z.case_id AND x.axis = 'lon'""", ("edges",))


@query("W2_cell_volumes", """
SELECT g.case_id, g.it, g.iz, g.iy, g.ix, round(vol, 4) AS volume_km3 FROM grid g JOIN vol_window v USING (case_id, iz, iy, ix)""",
       ("grid", "vol_window"))
def w2(i):
    geometry = ax.grid_geometry(i.index, 10.0, 160.0)
    rows = i.cells.join(geometry, "case_id")
    return rows.select("case_id", "it", "iz", "iy", "ix", F.round(ax.cell_volume(), 4).alias("volume_km3"))


assert (NZ, NY, NX) == (7, 12, 15)
