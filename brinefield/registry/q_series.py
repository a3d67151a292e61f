"""Daily, seasonal and monthly series queries."""

from pyspark.sql import functions as F

from brinefield.operators import climate as cl
from brinefield.operators import seasons as se
from brinefield.operators import series as ts
from brinefield.plans.event_comparison import compare_events
from brinefield.registry.core import query
from brinefield.registry.projections import register_cte
from brinefield.functions.scalars import SEASONS

Y0, Y1 = 1995, 1999
DOY = "datediff('day', DATE '2000-01-01', make_date(2000, month({0}), day({0})))"
D = lambda c="d": F.col(c).cast("string").alias(c)

register_cte("pool", f"""
WITH b AS (SELECT * FROM daily WHERE year(d) BETWEEN {Y0} AND {Y1}),
 p AS (SELECT a.loc, {DOY.format('c.d')} AS doy, a.v FROM b a JOIN b c ON c.loc = a.loc AND a.d BETWEEN c.d - 5 AND c.d + 5)
SELECT loc, doy, avg(v) AS mean, quantile_cont(v, 0.9) AS threshold, count(*) AS pool_count FROM p WHERE doy <> 59 GROUP BY 1, 2""", ("daily",))
register_cte("filled", """SELECT * FROM pool UNION ALL SELECT loc, 59, sum(mean) / 2, sum(threshold) / 2, 0 FROM pool WHERE doy IN (58, 60) GROUP BY loc""", ("pool",))
register_cte("clim", """SELECT a.loc, a.doy, sum(b.mean) / 31 AS mean, sum(b.threshold) / 31 AS threshold, any_value(a.pool_count) AS pool_count FROM filled a JOIN filled b
  ON b.loc = a.loc AND least((b.doy - a.doy + 366) % 366, (a.doy - b.doy + 366) % 366) <= 15 GROUP BY 1, 2""", ("filled",))
register_cte("marked", f"""SELECT g.*, c.mean, c.threshold, g.v > c.threshold AS above FROM gappy g JOIN clim c ON c.loc = g.loc AND c.doy = {DOY.format('g.d')}
  WHERE g.d >= DATE '2000-01-01'""", ("gappy", "clim"))
register_cte("runs5", """WITH a AS (SELECT loc, d, d - CAST(row_number() OVER (PARTITION BY loc ORDER BY d) AS INT) AS g FROM marked WHERE above)
  SELECT loc, min(d) AS s, max(d) AS e, count(*) AS days FROM a GROUP BY loc, g HAVING count(*) >= 5""", ("marked",))
register_cte("evs", """
WITH l AS (SELECT *, lag(e) OVER (PARTITION BY loc ORDER BY s) AS pe FROM runs5),
 f AS (SELECT *, CASE WHEN s - pe - 1 <= 2 AND (SELECT count(v) FROM marked m WHERE m.loc = l.loc AND m.d > pe AND m.d < s) = s - pe - 1 THEN 0 ELSE 1 END AS brk FROM l),
 k AS (SELECT *, sum(brk) OVER (PARTITION BY loc ORDER BY s) AS ev FROM f),
 v AS (SELECT loc, min(s) AS s, max(e) AS e, count(*) AS runs FROM k GROUP BY loc, ev)
SELECT loc, 'mhw-' || CAST(s AS VARCHAR) || '-' || CAST(e AS VARCHAR) AS event_id, s, e, runs,
  coalesce((SELECT m.v IS NULL FROM marked m WHERE m.loc = v.loc AND m.d = v.s - 1), true) AS left_unknown,
  coalesce((SELECT m.v IS NULL FROM marked m WHERE m.loc = v.loc AND m.d = v.e + 1), true) AS right_unknown FROM v""", ("runs5",))


def analysis(i):
    return ts.exceedance(i.gappy.filter("d >= DATE '2000-01-01'"), ts.climatology(i.daily, Y0, Y1))


@query("A8_seasonal_pool_climatology", "SELECT loc, doy, round(mean, 6) AS mean, round(threshold, 6) AS threshold, pool_count FROM pool", ("pool",))
def a8(i):
    return ts.seasonal_pool(i.daily, Y0, Y1).withColumns({"mean": F.round("mean", 6), "threshold": F.round("threshold", 6)})


@query("A9_percentile90", "SELECT loc, year(d) AS y, round(quantile_cont(v, 0.9), 6) AS p90 FROM daily GROUP BY 1, 2", ("daily",))
def a9(i):
    return i.daily.groupBy("loc", F.year("d").alias("y")).agg(F.round(F.percentile("v", F.lit(0.9)), 6).alias("p90"))


@query("W4_feb29_fill", "SELECT loc, doy, round(mean, 6) AS mean, round(threshold, 6) AS threshold, pool_count FROM filled WHERE doy BETWEEN 57 AND 61", ("filled",))
def w4(i):
    return ts.feb29_fill(ts.seasonal_pool(i.daily, Y0, Y1)).filter("doy between 57 and 61").withColumns({"mean": F.round("mean", 6), "threshold": F.round("threshold", 6)})


@query("W3_circular_smooth", "SELECT loc, doy, round(mean, 6) AS mean, round(threshold, 6) AS threshold, pool_count FROM clim", ("clim",))
def w3(i):
    return ts.climatology(i.daily, Y0, Y1).withColumns({"mean": F.round("mean", 6), "threshold": F.round("threshold", 6)})


@query("W5_exceedance", "SELECT loc, CAST(d AS VARCHAR) AS d, v, above FROM marked", ("marked",))
def w5(i):
    return analysis(i).select("loc", D(), "v", "above")


@query("W6_runs", 'SELECT loc, CAST(s AS VARCHAR) AS "start", CAST(e AS VARCHAR) AS "end", days FROM runs5', ("runs5",))
def w6(i):
    return ts.runs(analysis(i)).select("loc", D("start"), D("end"), "days")


@query("W7_merge_runs", 'SELECT loc, event_id, CAST(s AS VARCHAR) AS "start", CAST(e AS VARCHAR) AS "end", runs, left_unknown, right_unknown FROM evs', ("evs",))
def w7(i):
    return ts.merge_runs(ts.runs(analysis(i))).select("loc", "event_id", D("start"), D("end"), "runs", "left_unknown", "right_unknown")


_METRIC = """
WITH x AS (SELECT v.*, m.d, m.above, m.v - m.mean AS a FROM evs v JOIN marked m ON m.loc = v.loc AND m.d BETWEEN v.s AND v.e)
SELECT loc, event_id, count(*) AS duration_days, count(*) FILTER (WHERE above) AS exceedance_days, count(*) - count(*) FILTER (WHERE above) AS bridged_days,
  CAST(arg_min(d, (-round(a, 9), d)) AS VARCHAR) AS peak_date, round(avg(a), 6) AS mean_intensity, round(max(a), 6) AS max_intensity, round(sum(a), 6) AS cumulative_intensity,
  NOT (any_value(left_unknown) OR any_value(right_unknown)) AS complete_boundaries FROM x GROUP BY 1, 2"""


@query("W8_event_metrics", _METRIC, ("evs",))
def w8(i):
    m = analysis(i)
    out = ts.event_metrics(m, ts.merge_runs(ts.runs(m)))
    return out.select("loc", "event_id", "duration_days", "exceedance_days", "bridged_days", D("peak_date"), "complete_boundaries",
                      *[F.round(c, 6).alias(c) for c in ("mean_intensity", "max_intensity", "cumulative_intensity")])


@query("W9_daily_membership", """SELECT m.loc, CAST(d AS VARCHAR) AS d, round(v - mean, 6) AS anomaly, event_id FROM marked m
LEFT JOIN evs e ON e.loc = m.loc AND m.d BETWEEN e.s AND e.e""", ("evs",))
def w9(i):
    m = analysis(i)
    return ts.daily_membership(m, ts.merge_runs(ts.runs(m))).select("loc", D(), F.round("anomaly", 6).alias("anomaly"), "event_id")


@query("W10_consecutive_daily", """SELECT loc, count(*) AS days, count(*) = max(d) - min(d) + 1 AS consecutive FROM (SELECT * FROM daily WHERE NOT (loc % 2 = 1 AND day(d) = 13)) t GROUP BY 1""", ("daily",))
def w10(i):
    return ts.consecutive_daily(i.daily.filter("not (loc % 2 = 1 and day(d) = 13)"))


_EV_Y = """
WITH fd AS (SELECT loc, k AS it, DATE '2000-01-05' + CAST(k AS INT) * 11 + CAST(loc AS INT) * 5 AS d FROM (SELECT DISTINCT loc FROM daily), generate_series(0, 30) g(k)),
 y AS (SELECT *, s < DATE '2000-01-01' AS starts_before_year, e > DATE '2000-12-31' AS ends_after_year,
   EXISTS (SELECT 1 FROM fd WHERE fd.loc = evs.loc AND fd.d BETWEEN s AND e) AS depth_overlap FROM evs WHERE s <= DATE '2000-12-31' AND e >= DATE '2000-01-01')"""


def frame_days(i):
    k = F.col("it")
    locs = i.sql("SELECT DISTINCT CAST(floor(o_custkey / 500e0) AS BIGINT) AS loc FROM {orders}", "orders")
    return locs.select("loc", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("it")).withColumn(
        "d", F.date_add(F.lit("2000-01-05").cast("date"), (k * 11 + F.col("loc") * 5).cast("int")))


def events_2000(i):
    m = analysis(i)
    return ts.year_events(ts.merge_runs(ts.runs(m)), 2000, frame_days(i))


@query("F13_year_events", _EV_Y + " SELECT loc, event_id, starts_before_year, ends_after_year, depth_overlap FROM y", ("evs", "daily"))
def f13(i):
    return events_2000(i).select("loc", "event_id", "starts_before_year", "ends_after_year", "depth_overlap")


@query("F13_link_frames", _EV_Y + """, c AS (SELECT loc, arg_min(struct_pack(event_id := event_id, s := s, e := e), (NOT depth_overlap, s)) AS c FROM y GROUP BY 1),
 a AS (SELECT fd.loc, count(*) AS n, bool_or(it = 7) AS now FROM fd JOIN c ON c.loc = fd.loc AND fd.d BETWEEN c.c.s AND c.c.e GROUP BY 1)
SELECT l.loc, c.c.event_id AS event_id, coalesce(n, 0) AS available_frames, CASE WHEN c.c IS NULL THEN 'no_event' WHEN n IS NULL THEN 'outside_model_period' WHEN NOT now THEN 'time_outside_event'
  ELSE 'available' END AS status FROM (SELECT DISTINCT loc FROM daily) l LEFT JOIN c USING (loc) LEFT JOIN a USING (loc)""", ("evs", "daily"))
def f13b(i):
    return ts.link_frames(frame_days(i).select("loc").distinct(), events_2000(i), frame_days(i), 7)


_TWO = {"a": "SELECT loc, d, v, 'first' AS source FROM daily WHERE day(d) % 4 > 0",
        "b": "SELECT loc, d, CASE WHEN day(d) = 9 THEN v + 0.25 WHEN day(d) = 10 THEN NULL ELSE v END AS v, 'second' AS source FROM daily WHERE day(d) % 3 > 0"}


def two(i):
    day = F.dayofmonth("d")
    a = i.daily.filter(day % 4 > 0).withColumn("source", F.lit("first"))
    b = i.daily.filter(day % 3 > 0).withColumn("v", F.when(day == 9, F.col("v") + 0.25).when(day == 10, None).otherwise(F.col("v"))).withColumn("source", F.lit("second"))
    return a, b


@query("S17_merge_sources", f"""WITH u AS (SELECT *, 0 AS p FROM ({_TWO['a']}) UNION ALL SELECT *, 1 FROM ({_TWO['b']})),
 r AS (SELECT *, row_number() OVER (PARTITION BY loc, d ORDER BY p) AS k FROM u) SELECT loc, CAST(d AS VARCHAR) AS d, v, source FROM r WHERE k = 1""", ("daily",))
def s17(i):
    return ts.merge_sources(*two(i)).select("loc", D(), "v", "source")


@query("S17_merge_conflicts", f"""SELECT a.loc, CAST(a.d AS VARCHAR) AS d, 'first' AS first_source, a.v AS first_value, 'second' AS second_source, b.v AS second_value
  FROM ({_TWO['a']}) a JOIN ({_TWO['b']}) b USING (loc, d) WHERE a.v IS DISTINCT FROM b.v""", ("daily",))
def s17b(i):
    return ts.merge_checked(*two(i), conflicts="quarantine")[1].withColumn("d", D())


@query("S17_merge_quarantined", f"""WITH u AS (SELECT *, 0 AS p FROM ({_TWO['a']}) UNION ALL SELECT *, 1 FROM ({_TWO['b']})),
 c AS (SELECT a.loc, a.d FROM ({_TWO['a']}) a JOIN ({_TWO['b']}) b USING (loc, d) WHERE a.v IS DISTINCT FROM b.v),
 r AS (SELECT *, row_number() OVER (PARTITION BY loc, d ORDER BY p) AS k FROM u)
SELECT loc, CAST(d AS VARCHAR) AS d, v, source FROM r WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM c WHERE c.loc = r.loc AND c.d = r.d)""", ("daily",))
def s17c(i):
    return ts.merge_checked(*two(i), conflicts="quarantine")[0].select("loc", D(), "v", "source")


_AUD = f"""SELECT loc, d, a.v AS a, b.v AS b, abs(a.v - b.v) AS difference, CASE WHEN a.v IS NULL OR b.v IS NULL THEN a.v IS NULL AND b.v IS NULL ELSE a.v = b.v END AS agrees
  FROM ({_TWO['a']}) a JOIN ({_TWO['b']}) b USING (loc, d)"""


@query("S18_overlap_audit", f"SELECT loc, CAST(d AS VARCHAR) AS d, a, b, difference, agrees FROM ({_AUD}) t", ("daily",))
def s18(i):
    return ts.overlap_audit(*two(i)).select("loc", D(), "a", "b", "difference", "agrees")


@query("S18_overlap_summary", f"""SELECT loc, count(*) AS overlaps, count(*) FILTER (WHERE NOT agrees) AS conflicts, count(*) FILTER (WHERE a IS DISTINCT FROM b) AS differing,
  max(difference) AS largest FROM ({_AUD}) t GROUP BY 1""", ("daily",))
def s18b(i):
    return ts.overlap_summary(ts.overlap_audit(*two(i)))


@query("S19_missing_dates", """WITH k AS (SELECT loc, CAST(o AS DATE) AS d FROM (SELECT DISTINCT CAST(floor(o_custkey / 500e0) AS BIGINT) AS loc, CAST(o_orderdate AS DATE) AS o FROM orders) t),
 s AS (SELECT loc, min(d) a, max(d) z FROM k GROUP BY 1)
SELECT s.loc, CAST(CAST(g.d AS DATE) AS VARCHAR) AS d FROM s, generate_series(s.a, s.z, INTERVAL 1 DAY) g(d) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.loc = s.loc AND k.d = CAST(g.d AS DATE))""")
def s19(i):
    seen = i.sql("SELECT DISTINCT CAST(floor(o_custkey / 500e0) AS BIGINT) AS loc, CAST(o_orderdate AS DATE) AS d FROM {orders}", "orders")
    return ts.missing_dates(seen).select("loc", D())


# Seasons

register_cte("qual", """
WITH s AS (SELECT *, y * 12 + m AS k, CASE WHEN value_c >= 0.5 THEN 1 WHEN value_c <= -0.5 THEN -1 ELSE 0 END AS sign FROM seasons),
 g AS (SELECT *, k - row_number() OVER (PARTITION BY index_id, sign ORDER BY k) AS island FROM s), n AS (SELECT *, count(*) OVER (PARTITION BY index_id, sign, island) AS n FROM g)
SELECT *, CASE WHEN sign <> 0 AND n >= 5 THEN CASE sign WHEN 1 THEN 'el_nino' ELSE 'la_nina' END ELSE 'neutral' END AS phase FROM n""", ("seasons",))
_NAMES = "[" + ", ".join(f"'{s}'" for s in SEASONS) + "]"


@query("W11_qualify_runs", "SELECT index_id, y, m, value_c, phase FROM qual", ("qual",))
def w11(i):
    return se.qualify_runs(i.seasons).select("index_id", "y", "m", "value_c", "phase")


@query("W12_qualifying_run", f"""
WITH w AS (SELECT index_id, sign, island, y AS wanted_y, m AS wm FROM qual WHERE phase <> 'neutral' AND m IN (1, 10))
SELECT index_id, wanted_y, {_NAMES}[wm] AS wanted_season, phase, arg_min(y, k) AS first_y, {_NAMES}[arg_min(m, k)] AS first_season, arg_max(y, k) AS last_y,
  {_NAMES}[arg_max(m, k)] AS last_season, count(*) AS season_count, string_agg(CAST(CAST(round(value_c * 1000) AS INT) AS VARCHAR), ',' ORDER BY k) AS vals
FROM qual JOIN w USING (index_id, sign, island) WHERE phase <> 'neutral' GROUP BY index_id, wanted_y, wm, phase""", ("qual",))
def w12(i):
    q = se.qualify_runs(i.seasons)
    wanted = i.seasons.filter(F.col("m").isin(1, 10)).select("index_id", "y", se.season_name(F.col("m")).alias("season"))
    milli = F.array_join(F.transform("values", lambda s: F.round(s["value_c"] * 1000).cast("int").cast("string")), ",")
    return se.qualifying_run(q, wanted).select("index_id", "wanted_y", "wanted_season", "phase", F.col("first.y").alias("first_y"), F.col("first.season").alias("first_season"),
                                               F.col("last.y").alias("last_y"), F.col("last.season").alias("last_season"), "season_count", milli.alias("vals"))


@query("W21_season_months", f"""
SELECT index_id, y, {_NAMES}[m] AS season, strftime(make_date(y, m, 1) - INTERVAL 1 MONTH, '%Y-%m') AS before, strftime(make_date(y, m, 1), '%Y-%m') AS centre,
  strftime(make_date(y, m, 1) + INTERVAL 1 MONTH, '%Y-%m') AS after FROM seasons""", ("seasons",))
def w21(i):
    season = se.season_name(F.col("m"))
    before, centre, after = se.season_months(F.col("y"), season)
    return i.seasons.select("index_id", "y", season.alias("season"), before.alias("before"), centre.alias("centre"), after.alias("after"))


@query("W22_season_mean", f"""
WITH h AS (SELECT index_id, y, m, CASE WHEN (y * 12 + m) % 17 > 0 THEN value_c END AS v, y * 12 + m AS k FROM seasons)
SELECT a.index_id, a.y, a.m, {_NAMES}[a.m] AS season, round(CASE WHEN count(b.v) = 3 THEN sum(b.v) / 3 END, 6) AS mean_c FROM h a JOIN h b ON b.index_id = a.index_id AND abs(b.k - a.k) <= 1
GROUP BY ALL""", ("seasons",))
def w22(i):
    holes = i.seasons.withColumn("value_c", F.when((F.col("y") * 12 + F.col("m")) % 17 > 0, F.col("value_c")))
    return se.season_mean(holes).withColumn("mean_c", F.round("mean_c", 6))


@query("E9_series_integrity", """
WITH k AS (SELECT index_id, y, m, count(*) AS n FROM (SELECT * FROM seasons WHERE NOT (index_id % 2 = 1 AND y = 1997) UNION ALL SELECT * FROM seasons WHERE index_id = 0 AND m = 3) GROUP BY ALL),
 y AS (SELECT index_id, y, count(*) AS months, count(*) FILTER (WHERE n > 1) AS dups FROM k GROUP BY 1, 2),
 w AS (SELECT *, lag(y) OVER (PARTITION BY index_id ORDER BY y) AS p, lead(y) OVER (PARTITION BY index_id ORDER BY y) AS x FROM y)
SELECT index_id, CAST(sum(dups) AS BIGINT) AS duplicate_keys, count(*) FILTER (WHERE y - p > 1) AS year_gaps, count(*) FILTER (WHERE months < 12 AND x IS NOT NULL) AS partial_years,
  sum(dups) + count(*) FILTER (WHERE y - p > 1) + count(*) FILTER (WHERE months < 12 AND x IS NOT NULL) = 0 AS ok FROM w GROUP BY 1""", ("seasons",))
def e9(i):
    s = i.seasons
    return se.series_integrity(s.filter("not (index_id % 2 = 1 and y = 1997)").unionByName(s.filter("index_id = 0 and m = 3")))


@query("E8_cross_source_agreement", """
WITH a AS (SELECT index_id, y, m, value_c AS a FROM seasons WHERE NOT (y = 1996 AND m = 2)), b AS (SELECT index_id, y, m, CASE WHEN m = 5 AND y = 1998 THEN value_c + 0.25 ELSE value_c END AS b
  FROM seasons WHERE NOT (y = 1999 AND m = 7))
SELECT index_id, y, m, a, b, CASE WHEN a IS NULL THEN 'only_b' WHEN b IS NULL THEN 'only_a' ELSE 'value' END AS mismatch FROM a FULL JOIN b USING (index_id, y, m) WHERE a IS DISTINCT FROM b""", ("seasons",))
def e8(i):
    s = i.seasons
    b = s.filter("not (y = 1999 and m = 7)").withColumn("value_c", F.when(F.expr("m = 5 and y = 1998"), F.col("value_c") + 0.25).otherwise(F.col("value_c")))
    return se.cross_source_agreement(s.filter("not (y = 1996 and m = 2)"), b)


@query("E14_event_index_context", f"""
WITH e AS (SELECT DISTINCT 'son-' || CAST(y AS VARCHAR) AS event_id, y FROM seasons WHERE m = 10), m AS (SELECT e.*, k AS m FROM e, generate_series(9, 11) g(k))
SELECT m.event_id, m.y, 'SON' AS season, m.m, a.value_c AS index_0, b.value_c AS index_1, q.phase AS season_phase, {_NAMES}[m.m] AS centred_season,
  CASE WHEN m.y % 3 = 0 THEN 'positive' ELSE 'unassigned' END AS episode FROM m LEFT JOIN seasons a ON a.index_id = 0 AND a.y = m.y AND a.m = m.m
  LEFT JOIN seasons b ON b.index_id = 1 AND b.y = m.y AND b.m = m.m LEFT JOIN qual q ON q.index_id = 0 AND q.y = m.y AND q.m = m.m""", ("qual", "seasons"))
def e14(i):
    ev = i.seasons.filter("m = 10").select("y").distinct().select(F.concat(F.lit("son-"), F.col("y").cast("string")).alias("event_id"), "y", F.lit("SON").alias("season"),
                                                                   F.sequence(F.lit(9), F.lit(11)).alias("months"))
    labels = ev.filter("y % 3 = 0").select("event_id", F.lit("positive").alias("episode"))
    return se.event_index_context(ev, i.seasons, [0, 1], labels)


# Monthly fields

@query("A6_month_baseline", """SELECT cell, m, count(value) AS n, round(CASE WHEN count(value) = 5 THEN avg(value) END, 6) AS baseline FROM monthly WHERE y BETWEEN 1995 AND 1999 GROUP BY 1, 2""", ("monthly",))
def a6(i):
    return cl.month_baseline(i.monthly, Y0, Y1).withColumn("baseline", F.round("baseline", 6))


@query("A7_complete_month_mean", """SELECT cell, y, round(CASE WHEN count(value) = 3 THEN sum(value) / 3 END, 6) AS value FROM monthly WHERE m IN (9, 10, 11) GROUP BY 1, 2""", ("monthly",))
def a7(i):
    return cl.complete_month_mean(i.monthly, [9, 10, 11], ["cell", "y"]).withColumn("value", F.round("value", 6))


@query("F1_signed_difference", """SELECT cell, m, a.value AS a, b.value AS b, a.value - b.value AS difference FROM (SELECT * FROM monthly WHERE y = 2000) a FULL JOIN (SELECT * FROM monthly WHERE y = 1999 AND cell % 7 > 0) b USING (cell, m)""",
       ("monthly",))
def f1(i):
    return cl.signed_difference(i.monthly.filter("y = 2000"), i.monthly.filter("y = 1999 and cell % 7 > 0"), ["cell", "m"])


@query("F2_anomaly", """
WITH b AS (SELECT cell, m, CASE WHEN count(value) = 5 THEN avg(value) END AS baseline FROM monthly WHERE y BETWEEN 1995 AND 1999 GROUP BY 1, 2)
SELECT cell, m, value, round(baseline, 6) AS baseline, round(value - baseline, 6) AS anomaly FROM monthly LEFT JOIN b USING (cell, m) WHERE y = 2000""", ("monthly",))
def f2(i):
    base = cl.month_baseline(i.monthly, Y0, Y1).select("cell", "m", "baseline")
    return cl.anomaly(i.monthly.filter("y = 2000").drop("y"), base, ["cell", "m"]).withColumns({"baseline": F.round("baseline", 6), "anomaly": F.round("anomaly", 6)})


MFIELD = """
SELECT case_id, y, m, iz, iy, ix, CASE WHEN s % 13 = 0 THEN NULL ELSE CAST(s * 7 % 101 AS DOUBLE) / 4 END AS value
FROM (SELECT CAST(floor(l_orderkey / 5000e0) AS BIGINT) AS case_id, CAST(year(l_shipdate) AS INT) AS y, CAST(month(l_shipdate) AS INT) AS m, CAST((l_linenumber - 1) % 3 AS INT) AS iz,
   CAST(l_suppkey % 3 AS INT) AS iy, CAST(l_partkey % 4 AS INT) AS ix, sum(CAST(l_quantity AS BIGINT)) AS s FROM {lineitem} GROUP BY 1, 2, 3, 4, 5, 6) t"""
register_cte("mfield", MFIELD.format(lineitem="lineitem"))
LATS, LONS, LEVELS = (-1.5, -0.5, 0.5), (140.5, 150.5, 160.5, 170.5), (5.0, 15.0, 25.0)


def map_axes(i):
    rows = [("depth", k, v) for k, v in enumerate(LEVELS)] + [("lat", k, v) for k, v in enumerate(LATS)] + [("lon", k, v) for k, v in enumerate(LONS)]
    entries = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(k).alias("idx"), F.lit(v).alias("coord")) for a, k, v in rows])
    return i._small("map_axes", lambda: i.cases.select("case_id", F.inline(entries)))


_SEC = """SELECT case_id, y, m, iz, iy, ix, value, -0.5 AS lat, [140.5, 150.5, 160.5, 170.5][ix + 1] AS lon, [5.0, 15.0, 25.0][iz + 1] AS depth FROM mfield WHERE iy = 1 AND ix BETWEEN 1 AND 3"""


@query("F3_latitude_section", f"SELECT case_id, y, m, iz, ix, value, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, CAST(depth AS DOUBLE) AS depth FROM ({_SEC}) t", ("mfield",))
def f3(i):
    return cl.latitude_section(i.sql(MFIELD, "lineitem"), map_axes(i), 145, 175).drop("iy")


@query("F4_profile_from_section", f"SELECT case_id, y, m, iz, CAST(depth AS DOUBLE) AS depth, value FROM ({_SEC}) t WHERE ix = 2", ("mfield",))
def f4(i):
    return cl.profile_from_section(cl.latitude_section(i.sql(MFIELD, "lineitem"), map_axes(i), 145, 175), 1).select("case_id", "y", "m", "iz", "depth", "value")


@query("A10_common_scale", f"""SELECT case_id, m, min(value) AS low, max(value) AS high FROM ({_SEC}) t GROUP BY 1, 2""", ("mfield",))
def a10(i):
    return cl.common_scale(cl.latitude_section(i.sql(MFIELD, "lineitem"), map_axes(i), 145, 175), "value", ["case_id", "m"])


register_cte("panels", """
WITH b AS (SELECT case_id, m, iz, iy, ix, CASE WHEN count(value) = 5 THEN avg(value) END AS b FROM mfield WHERE y BETWEEN 1995 AND 1999 GROUP BY ALL),
 bb AS (SELECT case_id, iz, iy, ix, CASE WHEN count(b) = 3 THEN sum(b) / 3 END AS baseline FROM b WHERE m IN (9, 10, 11) GROUP BY ALL),
 e AS (SELECT case_id, y, iz, iy, ix, CASE WHEN count(value) = 3 THEN sum(value) / 3 END AS value FROM mfield WHERE m IN (9, 10, 11) AND y IN (1998, 2000) GROUP BY ALL)
SELECT e.case_id, y, s.basin, iz, ix, value, baseline, value - baseline AS anomaly FROM e LEFT JOIN bb USING (case_id, iz, iy, ix)
JOIN (VALUES ('east', 1, 3), ('west', 0, 1)) s(basin, a, z) ON ix BETWEEN a AND z WHERE iy = 1""", ("mfield",))


def comparison(i):
    return compare_events(i.sql(MFIELD, "lineitem"), map_axes(i), (2000, 1998), [9, 10, 11], (Y0, Y1), {"east": (145, 175), "west": (135, 155)}, 1, 1)


@query("F5_compare_events", "SELECT case_id, y, basin, iz, ix, round(value, 6) AS value, round(baseline, 6) AS baseline, round(anomaly, 6) AS anomaly FROM panels", ("panels",))
def f5(i):
    return comparison(i).panels.select("case_id", "y", "basin", "iz", "ix", *[F.round(c, 6).alias(c) for c in ("value", "baseline", "anomaly")])


@query("F5_event_difference", """SELECT case_id, basin, iz, ix, round(a.value, 6) AS a, round(b.value, 6) AS b, round(a.value - b.value, 6) AS difference
FROM (SELECT * FROM panels WHERE y = 2000) a FULL JOIN (SELECT * FROM panels WHERE y = 1998) b USING (case_id, basin, iz, ix)""", ("panels",))
def f5b(i):
    return comparison(i).difference.withColumns({c: F.round(c, 6) for c in ("a", "b", "difference")})


@query("F5_scales", """
WITH d AS (SELECT case_id, basin, a.value - b.value AS difference FROM (SELECT * FROM panels WHERE y = 2000) a FULL JOIN (SELECT * FROM panels WHERE y = 1998) b USING (case_id, basin, iz, ix)),
 r AS (SELECT case_id, basin, min(value) AS low, max(value) AS high, 'value' AS scale FROM panels GROUP BY ALL
 UNION ALL SELECT case_id, basin, -max(abs(anomaly)), max(abs(anomaly)), 'anomaly' FROM panels GROUP BY ALL
 UNION ALL SELECT case_id, basin, -max(abs(difference)), max(abs(difference)), 'difference' FROM d GROUP BY ALL)
SELECT case_id, basin, round(low, 6) AS low, round(high, 6) AS high, scale FROM r""", ("panels",))
def f5c(i):
    return comparison(i).scales.withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query("F5_selected_point", """
SELECT case_id, 15.0::DOUBLE AS depth, (-0.5)::DOUBLE AS lat, 160.5::DOUBLE AS lon, round(max(value) FILTER (WHERE y = 2000), 6) AS value_selected, round(max(anomaly) FILTER (WHERE y = 2000), 6) AS anomaly_selected,
  round(max(value) FILTER (WHERE y = 1998), 6) AS value_reference, round(max(anomaly) FILTER (WHERE y = 1998), 6) AS anomaly_reference,
  round(max(value) FILTER (WHERE y = 2000) - max(value) FILTER (WHERE y = 1998), 6) AS difference FROM panels WHERE basin = 'east' AND iz = 1 AND ix = 2 GROUP BY 1""", ("panels",))
def f5d(i):
    return comparison(i).selected_point.withColumns({c: F.round(c, 6) for c in ("value_selected", "anomaly_selected", "value_reference", "anomaly_reference", "difference")})
