"""Station planning queries."""

from pyspark.sql import functions as F

from brinefield.operators import columns as wc
from brinefield.operators import planning as pl
from brinefield.registry.core import query
from brinefield.registry.projections import register_cte
from brinefield.runtime import cut

LEVEL, BUDGET, SPACING, FRAMES = 1, 5, 40.0, (2, 4, 6)
DESIGNS = [pl.Design("selected", "gradient"), pl.Design("uniform", "coverage")] + [pl.Design(f"random-{k}", "random", k) for k in range(5)]
STEP = 3
LAT, LON = "(10 + 0.25 * iy)", "(85 + 0.25 * ix)"


def prior(i):
    return i.cells.filter((F.col("it") == 0) & (F.col("iz") == LEVEL))


def split(i):
    g = wc.field_gradient(prior(i), i.axes).select("case_id", "iy", "ix", "value", "lat", "lon", "gradient")
    return pl.lattice_split(g, pl.grid_sizes(i.axes), STEP)


def candidates(i):
    return split(i).filter(F.col("role") == "candidate").select("case_id", "flat", "lon", "lat", "value", "gradient")


register_cte("roles", f"""SELECT case_id, iy, ix, value, iy * 15 + ix AS flat, CASE WHEN (iy % {STEP} = 0 OR iy = 11) AND (ix % {STEP} = 0 OR ix = 14) THEN 'candidate' ELSE 'evaluation' END AS role
FROM grid WHERE it = 0 AND iz = {LEVEL} AND value IS NOT NULL""", ("grid",))


@query("F6_lattice_split", "SELECT case_id, iy, ix, flat, role FROM roles", ("roles",))
def f6(i):
    return split(i).select("case_id", "iy", "ix", "flat", "role")


@query("F8_seeded_permutation", """SELECT case_id, flat, row_number() OVER (PARTITION BY case_id ORDER BY md5('7:' || CAST(flat AS VARCHAR)), flat) AS place FROM roles WHERE role = 'candidate'""", ("roles",))
def f8(i):
    return pl.seeded_order(candidates(i), 7).select("case_id", "flat", "place")


_D = "(2 * 6371.0088 * asin(sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"


def _far(a, b):
    return _D.format(a=f"{a}.lat", b=f"{b}.lat", c=f"{a}.lon", d=f"{b}.lon")


_PREVIOUS = "(SELECT value FROM ok h WHERE h.case_id = g.case_id AND h.iy = {} AND h.ix = {})"
_KX = _D.format(a="g.lat", b="g.lat", c="(85 + 0.25 * greatest(g.ix - 1, 0))", d="(85 + 0.25 * least(g.ix + 1, 14))")
_KY = _D.format(a="(10 + 0.25 * greatest(g.iy - 1, 0))", b="(10 + 0.25 * least(g.iy + 1, 11))", c="g.lon", d="g.lon")
register_cte("candidates", f"""
WITH ok AS (SELECT *, {LAT} AS lat, {LON} AS lon FROM roles), g AS (SELECT case_id, flat, lat, lon, value,
   coalesce(sqrt(pow(({_PREVIOUS.format('g.iy', 'least(g.ix + 1, 14)')} - {_PREVIOUS.format('g.iy', 'greatest(g.ix - 1, 0)')}) / {_KX}, 2)
     + pow(({_PREVIOUS.format('least(g.iy + 1, 11)', 'g.ix')} - {_PREVIOUS.format('greatest(g.iy - 1, 0)', 'g.ix')}) / {_KY}, 2)), 0) AS gradient FROM ok g WHERE role = 'candidate'),
 w AS (SELECT a.case_id, max({_far('a', 'b')}) AS diameter FROM g a JOIN g b USING (case_id) GROUP BY 1),
 m AS (SELECT case_id, avg(lat) AS lat, avg(lon) AS lon, max(gradient) AS top FROM g GROUP BY 1)
SELECT g.*, gradient / greatest(top, 1e-15) AS grad, {_far('g', 'm')} AS centre, greatest(diameter, 1e-15) AS diameter FROM g JOIN w USING (case_id) JOIN m USING (case_id)""", ("roles",))


def register_plan(name, design):
    """A design's greedy rounds as a recursive query: one station a step."""
    first, later = {"gradient": ("grad", "0.65 * grad + 0.35 * near / diameter"), "coverage": ("-centre", "near / diameter"), "random": ("0", "0")}[design.strategy]
    order = f"md5('{design.seed}:' || CAST(flat AS VARCHAR))" if design.strategy == "random" else "''"
    at = "struct_pack(lat := 10 + 0.25 * (f // 15), lon := 85 + 0.25 * (f % 15))"
    near = f"list_min(list_transform(s.flats, lambda f: {_D.format(a='c.lat', b=f'{at}.lat', c='c.lon', d=f'{at}.lon')}))"
    register_cte(name, f"""/*recursive*/ SELECT case_id, 1 AS n, [flat] AS flats, flat, CAST(NULL AS DOUBLE) AS near
 FROM (SELECT case_id, arg_min(flat, (-round({first}, 12), {order}, flat)) AS flat FROM candidates GROUP BY 1)
 UNION ALL SELECT s.case_id, s.n + 1, list_append(s.flats, p.b.flat), p.b.flat, p.b.near FROM {name} s, LATERAL (
  SELECT arg_min(struct_pack(flat := flat, near := near), (-round({later}, 12), {order}, flat)) AS b FROM (SELECT c.*, {near} AS near FROM candidates c WHERE c.case_id = s.case_id AND NOT list_contains(s.flats, c.flat))
  WHERE near + 1e-10 >= {SPACING}) p WHERE s.n < {BUDGET} AND p.b IS NOT NULL""", ("candidates",))


for _k, _design in enumerate(DESIGNS):
    register_plan(f"plan{_k}", _design)
_PLANS = tuple(f"plan{k}" for k in range(len(DESIGNS)))
register_cte("plans", f"""SELECT p.*, p.lat0 + 0.25 * (flat // 15) AS lat, p.lon0 + 0.25 * (flat % 15) AS lon, max(n) OVER (PARTITION BY case_id, design) AS planned, c.value AS prior
FROM ({' UNION ALL '.join(f"SELECT '{d.name}' AS design, 10 AS lat0, 85 AS lon0, case_id, n, flat, near FROM {p}" for p, d in zip(_PLANS, DESIGNS))}) p JOIN candidates c USING (case_id, flat)""", (*_PLANS, "candidates"))
_PLAN = f"""SELECT case_id, design, planned = {BUDGET} AS fulfilled, n AS station, flat, lon, lat, prior, round(near, 6) AS nearest_km FROM plans"""


@query("F7_farthest_point_select", f"{_PLAN} WHERE design IN ('selected', 'uniform')", ("plans",))
def f7(i):
    return pl.station_plan(pl.select_stations(candidates(i), DESIGNS[:2], BUDGET, SPACING)).withColumn("nearest_km", F.round("nearest_km", 6))


_RANDOM = f"""
WITH RECURSIVE c AS (SELECT case_id, flat, {LAT} AS lat, {LON} AS lon, md5('0:' || CAST(flat AS VARCHAR)) AS k FROM roles WHERE role = 'candidate'),
 s(case_id, n, flats, flat) AS (SELECT case_id, 1, [arg_min(flat, (k, flat))], arg_min(flat, (k, flat)) FROM c GROUP BY 1
 UNION ALL SELECT s.case_id, s.n + 1, list_append(s.flats, p.flat), p.flat FROM s, LATERAL (SELECT arg_min(c.flat, (c.k, c.flat)) AS flat FROM c WHERE c.case_id = s.case_id
   AND NOT list_contains(s.flats, c.flat) AND list_min(list_transform(s.flats, lambda f: 2 * 6371.0088 * asin(sqrt(pow(sin(radians(10 + 0.25 * (f // 15) - c.lat) / 2), 2)
     + cos(radians(c.lat)) * cos(radians(10 + 0.25 * (f // 15))) * pow(sin(radians(85 + 0.25 * (f % 15) - c.lon) / 2), 2))))) + 1e-10 >= {SPACING}) p
 WHERE s.n < {BUDGET} AND p.flat IS NOT NULL)
SELECT case_id, n AS station, flat FROM s"""


@query("F7_random_baseline", _RANDOM, ("roles",))
def f7b(i):
    plan = pl.station_plan(pl.select_stations(candidates(i), [pl.Design("random-0", "random", 0)], BUDGET, SPACING))
    return plan.select("case_id", "station", "flat")


@query("F10_idw_reconstruct", f"""
WITH st AS (SELECT case_id, flat, {LAT} AS lat, {LON} AS lon, row_number() OVER (PARTITION BY case_id ORDER BY flat) AS k, value FROM roles WHERE role = 'candidate'),
 s AS (SELECT st.*, g.value - st.value AS r FROM st JOIN grid g ON g.case_id = st.case_id AND g.it = 2 AND g.iz = {LEVEL} AND g.iy * 15 + g.ix = st.flat WHERE g.value IS NOT NULL),
 t AS (SELECT case_id, flat, {LAT} AS lat, {LON} AS lon, value AS prior FROM roles),
 p AS (SELECT t.case_id, t.flat, t.prior, s.r, s.k, {_D.format(a='t.lat', b='s.lat', c='t.lon', d='s.lon')} AS d FROM t JOIN s USING (case_id))
SELECT case_id, flat, round(any_value(prior) + CASE WHEN min(d) = 0 THEN arg_min(r, d) ELSE sum(r / (d * d)) / sum(1 / (d * d)) END, 6) AS reconstructed FROM (SELECT *, min(d) OVER (PARTITION BY case_id, flat) AS dm FROM p) q
WHERE dm > 0 OR d = 0 GROUP BY 1, 2""", ("roles", "grid"))
def f10(i):
    rows = split(i)
    st = rows.filter("role = 'candidate'").withColumn("station", F.col("flat"))
    later = i.cells.filter(f"it = 2 and iz = {LEVEL} and value is not null").select("case_id", "iy", "ix", F.col("value").alias("truth"))
    stations = st.join(later, ["case_id", "iy", "ix"]).select("case_id", "station", "lon", "lat", (F.col("truth") - F.col("value")).alias("residual"))
    targets = rows.select("case_id", "flat", "lat", "lon", F.col("value").alias("prior"))
    return pl.reconstruct(targets, stations, ["case_id"]).select("case_id", "flat", F.round("reconstructed", 6).alias("reconstructed"))


def experiment(i):
    rows = cut(split(i))
    pool = rows.filter("role = 'candidate'").select("case_id", "flat", "lon", "lat", "value", "gradient")
    chosen = pl.select_stations(pool, DESIGNS, BUDGET, SPACING)
    evaluation = rows.filter("role = 'evaluation'").select("case_id", "flat", "lat", "lon", F.col("value").alias("prior"))
    sizes = pl.grid_sizes(i.axes).select("case_id", "nx")
    truth = i.cells.filter(F.col("iz") == LEVEL).join(sizes, "case_id").select("case_id", "it", (F.col("iy") * F.col("nx") + F.col("ix")).cast("bigint").alias("flat"), "value")
    return pl.holdout_evaluation(chosen, evaluation, truth, FRAMES, BUDGET)


@query("F11_holdout_evaluation", f"""
WITH later AS (SELECT case_id, it, iy * 15 + ix AS flat, value AS truth FROM grid WHERE iz = {LEVEL} AND it IN {FRAMES} AND value IS NOT NULL),
 t AS (SELECT r.case_id, l.it, r.flat, {LAT} AS lat, {LON} AS lon, r.value AS prior, l.truth FROM roles r JOIN later l USING (case_id, flat) WHERE r.role = 'evaluation'),
 c AS (SELECT case_id, it, count(*) AS evaluation_count FROM t GROUP BY 1, 2),
 s AS (SELECT p.*, f.it, l.truth - p.prior AS r FROM plans p CROSS JOIN (SELECT unnest({list(FRAMES)}) AS it) f LEFT JOIN later l ON l.case_id = p.case_id AND l.it = f.it AND l.flat = p.flat),
 o AS (SELECT case_id, design, it, any_value(planned) AS planned, count(r) AS observed FROM s GROUP BY 1, 2, 3),
 runs AS (SELECT o.case_id, o.design, o.it, o.planned, coalesce(c.evaluation_count, 0) AS evaluation_count, CASE WHEN planned <> {BUDGET} THEN 'short_design' WHEN observed <> planned THEN 'missing_station'
   WHEN c.evaluation_count IS NULL THEN 'no_targets' END AS reason FROM o LEFT JOIN c USING (case_id, it)),
 d AS (SELECT s.design, t.case_id, t.it, t.flat, any_value(t.prior) + sum(s.r / pow({_far('t', 's')}, 2)) / sum(1 / pow({_far('t', 's')}, 2)) - any_value(t.truth) AS e
   FROM t JOIN s USING (case_id, it) JOIN runs USING (case_id, design, it) WHERE runs.reason IS NULL GROUP BY 1, 2, 3, 4
   UNION ALL SELECT 'persistence', case_id, it, flat, prior - truth FROM t),
 e AS (SELECT design, case_id, it, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(avg(e), 6) AS bias FROM d GROUP BY 1, 2, 3)
SELECT a.*, e.rmse, e.mae, e.bias, CASE WHEN reason IS NULL THEN 'ok' ELSE 'failed' END AS status
FROM (SELECT * FROM runs UNION ALL SELECT case_id, 'persistence', it, 0, evaluation_count, NULL FROM c) a LEFT JOIN e USING (case_id, design, it)""", ("plans", "grid"))
def f11(i):
    """All designs and persistence at the held-out frames."""
    return experiment(i).withColumns({c: F.round(c, 6) for c in ("rmse", "mae", "bias")})


@query("F11_persistence", f"""
SELECT r.case_id, g.it, count(*) AS evaluation_count, round(sqrt(avg(pow(r.value - g.value, 2))), 6) AS rmse, round(avg(abs(r.value - g.value)), 6) AS mae, round(avg(r.value - g.value), 6) AS bias
FROM roles r JOIN grid g ON g.case_id = r.case_id AND g.iz = {LEVEL} AND g.iy = r.iy AND g.ix = r.ix AND g.it IN {FRAMES} AND g.value IS NOT NULL WHERE r.role = 'evaluation' GROUP BY 1, 2""", ("roles", "grid"))
def f11b(i):
    return experiment(i).filter("design = 'persistence'").select("case_id", "it", "evaluation_count", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "bias")])


@query("F12_station_plan", _PLAN, ("plans",))
def f12(i):
    return pl.station_plan(pl.select_stations(candidates(i), DESIGNS, BUDGET, SPACING)).withColumn("nearest_km", F.round("nearest_km", 6))


RUNS = """SELECT user_id % 4 AS strategy, event_id, CASE WHEN event_id % 5 = 0 OR user_id % 40 = 3 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN event_id % 5 > 0 THEN CAST(event_id % 64 AS DOUBLE) / 8 END AS rmse FROM {events}"""


@query("A12_strategy_summary", f"""SELECT strategy, count(rmse) FILTER (WHERE status = 'ok') AS successful_runs, count(*) FILTER (WHERE status <> 'ok') AS failed_runs,
  round(avg(rmse) FILTER (WHERE status = 'ok'), 6) AS mean_rmse, min(rmse) FILTER (WHERE status = 'ok') AS min_rmse, max(rmse) FILTER (WHERE status = 'ok') AS max_rmse FROM ({RUNS.format(events='events')}) t GROUP BY 1""")
def a12(i):
    return pl.strategy_summary(i.sql(RUNS, "events"), "strategy").withColumn("mean_rmse", F.round("mean_rmse", 6))
