"""Region, section and region-correspondence queries (R rows, A4, A13, C14-C18)."""

from pyspark.sql import functions as F

from brinefield.operators import evolution as ev
from brinefield.operators import regions as rg
from brinefield.plans.region_runs import evolve, label_regions
from brinefield.registry import q_collocation as qco
from brinefield.registry.core import query
from brinefield.registry.projections import register_cte
from brinefield.registry.q_selection import AX3
from brinefield.runtime import cut

BASE = rg.thresholds("at_least", 18.0)
SHIFTED = rg.thresholds("at_least", 18.0, offsets=(-1.0, 0.0, 1.0))
ZMIN, ZMAX = 10.0, 160.0
K3 = "case_id, threshold_id, it"


def digest_sql(text):
    lanes = " || ':' || ".join(f"CAST(sum(CAST(CAST('0x' || substr(sha256({text}), {1 + 15 * k}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)" for k in range(4))
    return f"CAST(count({text}) AS VARCHAR) || ':' || {lanes}"


def register_regions(name, rules):
    register_cte(f"{name}_mask", f"""
SELECT g.case_id, r.k AS threshold_id, g.it, g.iz, g.iy, g.ix, (g.iz * 12 + g.iy) * 15 + g.ix AS flat, g.value, v.vol
FROM grid g JOIN (VALUES {rules}) r(k, lo) ON g.value >= r.lo JOIN vol_window v USING (case_id, iz, iy, ix) WHERE v.depth BETWEEN 10 AND 160 AND v.vol > 0""",
                 ("grid", "vol_window"))
    register_cte(f"{name}_adj", " UNION ALL ".join(
        f"SELECT a.case_id, a.threshold_id, a.it, a.flat AS a, b.flat AS b FROM {name}_mask a JOIN {name}_mask b USING (case_id, threshold_id, it) "
        f"WHERE b.flat = a.flat + {s * step} AND abs(b.ix - a.ix) + abs(b.iy - a.iy) + abs(b.iz - a.iz) = 1" for step in (1, 15, 180) for s in (1, -1)), (f"{name}_mask",))
    register_cte(f"{name}_reach", f"""/*recursive*/ SELECT {K3}, flat, flat AS root FROM {name}_mask
UNION SELECT r.case_id, r.threshold_id, r.it, e.b, r.root FROM {name}_reach r JOIN {name}_adj e
  ON e.case_id = r.case_id AND e.threshold_id = r.threshold_id AND e.it = r.it AND e.a = r.flat AND r.root < e.b""", (f"{name}_adj",))
    register_cte(f"{name}_labels", f"""SELECT m.*, l.label FROM {name}_mask m JOIN (SELECT {K3}, flat, min(root) AS label FROM {name}_reach GROUP BY ALL) l
  USING (case_id, threshold_id, it, flat)""", (f"{name}_reach",))
    register_cte(f"{name}_regions", f"SELECT {K3}, label, count(*) AS cells, sum(vol) AS volume_km3 FROM {name}_labels GROUP BY ALL", (f"{name}_labels",))
    register_cte(f"{name}_steps", """SELECT *, CASE WHEN next_it = it + 1 AND elapsed_hours = 12 THEN 'compared' ELSE 'gap' END AS status FROM (
  SELECT case_id, it, lead(it) OVER w AS next_it, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 3.6e9 AS elapsed_hours FROM frames_gap WINDOW w AS (PARTITION BY case_id ORDER BY it)) q
  WHERE next_it IS NOT NULL""", ("frames_gap",))
    register_cte(f"{name}_pairs", f"""SELECT a.case_id, a.threshold_id, a.it, s.next_it, a.label AS source, b.label AS target, count(*) AS shared_cells, sum(a.vol) AS overlap_km3
  FROM {name}_labels a JOIN {name}_steps s ON s.case_id = a.case_id AND s.it = a.it AND s.status = 'compared'
  JOIN {name}_labels b ON b.case_id = a.case_id AND b.threshold_id = a.threshold_id AND b.it = s.next_it AND b.flat = a.flat GROUP BY ALL""", (f"{name}_labels", f"{name}_steps"))
    register_cte(f"{name}_links", f"""SELECT p.*, overlap_km3 / a.volume_km3 AS source_fraction, overlap_km3 / b.volume_km3 AS target_fraction,
  overlap_km3 / least(a.volume_km3, b.volume_km3) AS coefficient FROM {name}_pairs p
  JOIN {name}_regions a ON a.case_id = p.case_id AND a.threshold_id = p.threshold_id AND a.it = p.it AND a.label = p.source
  JOIN {name}_regions b ON b.case_id = p.case_id AND b.threshold_id = p.threshold_id AND b.it = p.next_it AND b.label = p.target
  WHERE overlap_km3 / least(a.volume_km3, b.volume_km3) >= {MIN_OVERLAP}""", (f"{name}_pairs", f"{name}_regions"))
    register_cte(f"{name}_lreach", f"""/*recursive*/ SELECT {K3}, next_it, source AS s0, source, target FROM {name}_links
UNION SELECT r.case_id, r.threshold_id, r.it, r.next_it, r.s0, l2.source, l2.target FROM {name}_lreach r
  JOIN {name}_links l1 ON l1.case_id = r.case_id AND l1.threshold_id = r.threshold_id AND l1.it = r.it AND l1.target = r.target
  JOIN {name}_links l2 ON l2.case_id = l1.case_id AND l2.threshold_id = l1.threshold_id AND l2.it = l1.it AND l2.source = l1.source""", (f"{name}_links",))
    register_cte(f"{name}_groups", f"""SELECT {K3}, next_it, s0 AS source, min(source) AS grp, CASE WHEN count(DISTINCT source) = 1 AND count(DISTINCT target) = 1 THEN 'continuation'
  WHEN count(DISTINCT source) = 1 THEN 'split' WHEN count(DISTINCT target) = 1 THEN 'merge' ELSE 'ambiguous' END AS classification FROM {name}_lreach GROUP BY {K3}, next_it, s0""",
                 (f"{name}_lreach",))
    alone = []
    for own, other, end, relation in (("it", "next_it", "source", "no_successor"), ("next_it", "it", "target", "no_predecessor")):
        alone.append(f"""SELECT r.case_id, r.threshold_id, r.it, r.label, s.{other} AS other_it, '{relation}' AS relation,
  (SELECT count(*) FROM {name}_labels m WHERE m.case_id = r.case_id AND m.threshold_id = r.threshold_id AND m.it = r.it AND m.label = r.label)
  - (SELECT count(g.value) FROM {name}_labels m JOIN grid g ON g.case_id = m.case_id AND g.iz = m.iz AND g.iy = m.iy AND g.ix = m.ix
     WHERE g.it = s.{other} AND m.case_id = r.case_id AND m.threshold_id = r.threshold_id AND m.it = r.it AND m.label = r.label) AS missing_cells
  FROM {name}_regions r JOIN {name}_steps s ON s.case_id = r.case_id AND s.{own} = r.it AND s.status = 'compared'
  WHERE NOT EXISTS (SELECT 1 FROM {name}_links l WHERE l.case_id = r.case_id AND l.threshold_id = r.threshold_id AND l.{own} = r.it AND l.{end} = r.label)""")
    register_cte(f"{name}_alone", " UNION ALL ".join(alone), (f"{name}_links", f"{name}_labels"))
    gr = f"SELECT case_id, threshold_id, it, classification, count(DISTINCT grp) AS n FROM {name}_groups GROUP BY ALL"
    one = lambda c: f"coalesce((SELECT n FROM gr WHERE gr.case_id = b.case_id AND gr.threshold_id = b.threshold_id AND gr.it = b.it AND classification = '{c}'), 0)"
    who = lambda cond: f"(SELECT count(*) FROM {name}_alone u WHERE u.case_id = b.case_id AND u.threshold_id = b.threshold_id AND least(u.it, u.other_it) = b.it AND {cond})"
    reg = lambda t: f"(SELECT count(*) FROM {name}_regions r WHERE r.case_id = b.case_id AND r.threshold_id = b.threshold_id AND r.it = b.{t})"
    register_cte(f"{name}_transitions", f"""
WITH gr AS ({gr}), b AS (SELECT s.*, k.threshold_id FROM {name}_steps s JOIN (SELECT DISTINCT case_id, threshold_id FROM {name}_regions) k USING (case_id))
SELECT b.case_id, b.threshold_id, b.it, b.next_it, b.elapsed_hours, b.status,
  (SELECT count(*) FROM {name}_links l WHERE l.case_id = b.case_id AND l.threshold_id = b.threshold_id AND l.it = b.it) AS link_count,
  {one('split')} AS split_count, {one('merge')} AS merge_count, {one('ambiguous')} AS ambiguous_count,
  {who("relation = 'no_predecessor' AND missing_cells = 0")} AS appeared_count, {who("relation = 'no_successor' AND missing_cells = 0")} AS disappeared_count,
  CASE WHEN status = 'gap' THEN {reg('it')} + {reg('next_it')} ELSE {who('missing_cells > 0')} END AS unresolved_count FROM b""", (f"{name}_alone", f"{name}_groups"))


MIN_OVERLAP = 0.3
register_regions("rb", "(0, 18)")
register_regions("rs", "(0, 17), (1, 18), (2, 19)")


def labels(i, rules=BASE):
    return label_regions(i.cells, i.index, rules, ZMIN, ZMAX)


def run(i, rules=BASE):
    return evolve(cut(i.cells), i.index, i.frames_gap, rules, ZMIN, ZMAX, MIN_OVERLAP)


@query("R1_threshold_mask", f"SELECT {K3}, iz, iy, ix, flat, value, round(vol, 4) AS volume FROM rs_mask", ("rs_mask",))
def r1(i):
    return rg.threshold_mask(i.cells, i.index, SHIFTED, ZMIN, ZMAX).withColumn("volume", F.round("volume", 4))


@query("R2_connected_regions", f"SELECT {K3}, iz, iy, ix, label FROM rb_labels", ("rb_labels",))
def r2(i):
    return labels(i).select(*rg.REGION, *rg.CELL)


@query("A4_region_stats", f"""
WITH s AS (SELECT {K3}, label, count(*) AS cell_count, round(sum(vol), 3) AS volume_km3, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean,
  round(sum(value * vol) / sum(vol), 6) AS volume_weighted_mean, {digest_sql('CAST(flat AS VARCHAR)')} AS membership,
  min(iz) AS iz_lo, max(iz) AS iz_hi, min(iy) AS iy_lo, max(iy) AS iy_hi, min(ix) AS ix_lo, max(ix) AS ix_hi FROM rb_labels GROUP BY ALL)
SELECT s.*, z0.coord AS center_depth_min, z1.coord AS center_depth_max, z0.lo AS cell_depth_min, z1.hi AS cell_depth_max, y0.coord AS center_lat_min, y1.coord AS center_lat_max,
  y0.lo AS cell_lat_min, y1.hi AS cell_lat_max, x0.coord AS center_lon_min, x1.coord AS center_lon_max, x0.lo AS cell_lon_min, x1.hi AS cell_lon_max FROM s
{' '.join(f"JOIN edges {a}{n} ON {a}{n}.case_id = s.case_id AND {a}{n}.axis = '{axis}' AND {a}{n}.idx = s.i{a}_{e}" for a, axis in (("z", "depth"), ("y", "lat"), ("x", "lon")) for n, e in ((0, "lo"), (1, "hi")))}
""", ("rb_labels", "edges"))
def a4(i):
    s = rg.region_stats(labels(i), i.index)
    return s.withColumns({"volume_km3": F.round("volume_km3", 3), "mean": F.round("mean", 6), "volume_weighted_mean": F.round("volume_weighted_mean", 6)})


@query("R3_rank_regions", f"""
WITH r AS (SELECT {K3}, label, volume_km3, row_number() OVER (PARTITION BY {K3} ORDER BY round(volume_km3, 3) DESC, label) AS rank, count(*) OVER (PARTITION BY {K3}) AS total_regions FROM rb_regions)
SELECT {K3}, label, rank, total_regions FROM r WHERE rank <= 20""", ("rb_regions",))
def r3(i):
    s = rg.region_stats(labels(i), i.index).withColumn("volume_km3", F.round("volume_km3", 3))
    return rg.rank_regions(s, limit=20).select(*rg.REGION, "rank", "total_regions")


@query("R4_plan_footprint", f"SELECT {K3}, iy, ix, arg_min(label, iz) AS label FROM rb_labels GROUP BY ALL", ("rb_labels",))
def r4(i):
    return rg.plan_footprint(labels(i))


@query("R4_region_footprint", f"SELECT DISTINCT {K3}, label, iy, ix FROM rb_labels", ("rb_labels",))
def r4b(i):
    return rg.region_footprint(labels(i))


@query("R5_exposed_faces", " UNION ALL ".join(f"""SELECT {K3}, label, iz, iy, ix, '{a}' AS axis, {s} AS side FROM rb_labels a WHERE NOT EXISTS (SELECT 1 FROM rb_labels b
  WHERE b.case_id = a.case_id AND b.threshold_id = a.threshold_id AND b.it = a.it AND b.iz = a.iz + {s if a == 'iz' else 0} AND b.iy = a.iy + {s if a == 'iy' else 0} AND b.ix = a.ix + {s if a == 'ix' else 0})"""
                                              for a in ("iz", "iy", "ix") for s in (-1, 1)), ("rb_labels",))
def r5(i):
    return rg.exposed_faces(labels(i))


def _missing(dz, dy, dx):
    return (f"(a.iz + {dz} BETWEEN 0 AND 6 AND a.iy + {dy} BETWEEN 0 AND 11 AND a.ix + {dx} BETWEEN 0 AND 14 AND NOT EXISTS (SELECT 1 FROM ok g WHERE g.case_id = a.case_id "
            f"AND g.it = a.it AND g.iz = a.iz + {dz} AND g.iy = a.iy + {dy} AND g.ix = a.ix + {dx}))")


@query("R6_region_contacts", f"""
WITH ok AS (SELECT * FROM grid WHERE value IS NOT NULL), f AS (SELECT {K3}, label, iz = 0 AS shallow, iz = 6 AS deep, iy = 0 AS south, iy = 11 AS north, ix = 0 AS west, ix = 14 AS east,
  {' OR '.join(_missing(*d) for d in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)))} AS miss FROM rb_labels a)
SELECT {K3}, label, bool_or(shallow) AS shallow, bool_or(deep) AS deep, bool_or(south) AS south, bool_or(north) AS north, bool_or(west) AS west, bool_or(east) AS east,
  bool_or(miss) AS touches_missing, bool_or(shallow OR deep OR south OR north OR west OR east) AS touches_boundary FROM f GROUP BY ALL""", ("rb_labels",))
def r6(i):
    return rg.region_contacts(labels(i), i.columns, i.index)


@query("R7_depth_selection_contacts", f"SELECT {K3}, label, bool_or(iz = 1) AS touches_first, bool_or(iz = 5) AS touches_last FROM rb_labels GROUP BY ALL", ("rb_labels",))
def r7(i):
    return rg.depth_selection_contacts(labels(i), i.index, ZMIN, ZMAX)


@query("R8_overlap_pairs", f"SELECT {K3}, next_it, source, target, shared_cells, round(overlap_km3, 3) AS overlap_km3 FROM rb_pairs", ("rb_pairs",))
def r8(i):
    return ev.overlap_pairs(labels(i), ev.frame_steps(i.frames_gap)).withColumn("overlap_km3", F.round("overlap_km3", 3))


FRACTIONS = ("source_fraction", "target_fraction", "coefficient")


@query("R9_overlap_links", f"SELECT {K3}, next_it, source, target, shared_cells, {', '.join(f'round({c}, 6) AS {c}' for c in FRACTIONS)} FROM rb_links", ("rb_links",))
def r9(i):
    lab = labels(i)
    links = ev.overlap_links(ev.overlap_pairs(lab, ev.frame_steps(i.frames_gap)), rg.region_stats(lab, i.index), MIN_OVERLAP)
    return links.drop("overlap_km3").withColumns({c: F.round(c, 6) for c in FRACTIONS})


@query("R10_classify_links", f"SELECT {K3}, next_it, source, target, classification FROM rb_links JOIN rb_groups USING (case_id, threshold_id, it, next_it, source)", ("rb_groups",))
def r10(i):
    return run(i).links.select(*ev.PAIR, "source", "target", "classification")


@query("R11_frame_gaps", "SELECT case_id, it, next_it, elapsed_hours, status FROM rb_steps", ("rb_steps",))
def r11(i):
    return ev.frame_steps(i.frames_gap)


@query("R11_gap_nodes", f"""
SELECT r.case_id, r.threshold_id, r.it, label, 'source' AS side FROM rb_regions r JOIN rb_steps s ON s.case_id = r.case_id AND s.it = r.it AND status = 'gap'
UNION ALL SELECT r.case_id, r.threshold_id, r.it, label, 'target' FROM rb_regions r JOIN rb_steps s ON s.case_id = r.case_id AND s.next_it = r.it AND status = 'gap'""", ("rb_regions", "rb_steps"))
def r11b(i):
    return ev.gap_nodes(rg.region_stats(labels(i), i.index), ev.frame_steps(i.frames_gap))


@query("R12_unmatched_nodes", f"""SELECT {K3}, label, other_it, relation, missing_cells, CASE WHEN missing_cells > 0 THEN 'incomplete_support' ELSE 'no_qualifying_overlap' END AS reason
FROM rb_alone""", ("rb_alone",))
def r12(i):
    return run(i).unmatched


@query("R13_evolution", "SELECT * FROM rb_transitions", ("rb_transitions",))
def r13(i):
    return run(i).transitions


@query("R14_threshold_sensitivity", "SELECT * FROM rs_transitions", ("rs_transitions",))
def r14(i):
    return run(i, SHIFTED).transitions


@query("R14_sensitivity_frames", f"SELECT {K3}, count(*) AS region_count, CAST(sum(cells) AS BIGINT) AS qualified_cells, round(sum(volume_km3), 2) AS volume_km3 FROM rs_regions GROUP BY ALL", ("rs_regions",))
def r14b(i):
    return ev.frame_summary(rg.region_stats(labels(i, SHIFTED), i.index)).withColumn("volume_km3", F.round("volume_km3", 2))


_SUMS = ("link", "split", "merge", "ambiguous", "appeared", "disappeared", "unresolved")


@query("A13_evolution_summary", f"""
SELECT case_id, threshold_id, count(*) AS transition_count, count(*) FILTER (WHERE status = 'gap') AS gap_count, {', '.join(f'CAST(sum({c}_count) AS BIGINT) AS {c}_count' for c in _SUMS)},
  (SELECT count(*) FROM rb_regions r WHERE r.case_id = t.case_id AND r.threshold_id = t.threshold_id) AS node_count,
  (SELECT count(*) FROM frames f WHERE f.case_id = t.case_id) AS frame_count FROM rb_transitions t GROUP BY 1, 2""", ("rb_transitions", "frames"))
def a13(i):
    return run(i).summary


START, END, N = (85.1, 10.2), (88.2, 12.6), 12
_ST = f"""SELECT c.case_id, CAST(k AS INT) AS station, CASE WHEN k = {N - 1} THEN {END[0]}e0 ELSE {START[0]}e0 + k * {(END[0] - START[0]) / (N - 1)!r}e0 END AS lon,
  CASE WHEN k = {N - 1} THEN {END[1]}e0 ELSE {START[1]}e0 + k * {(END[1] - START[1]) / (N - 1)!r}e0 END AS lat FROM cases c, generate_series(0, {N - 1}) g(k)"""
_H = "2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
register_cte("stations", f"""
WITH s AS ({_ST}), n AS (SELECT s.case_id, s.station, min(struct_pack(d := 2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(y.lat - s.lat) / 2), 2)
  + cos(radians(s.lat)) * cos(radians(y.lat)) * pow(sin(radians(x.lon - s.lon) / 2), 2)))), iy := y.idx, ix := x.idx)) AS b
  FROM s JOIN ax_lat y USING (case_id) JOIN ax_lon x USING (case_id) GROUP BY 1, 2),
 st AS (SELECT a.*, CASE WHEN p.lat IS NULL THEN 0 ELSE {_H.format(a='p', b='a')} END AS step FROM s a LEFT JOIN s p ON p.case_id = a.case_id AND p.station = a.station - 1)
SELECT st.case_id, st.station, st.lon, st.lat, n.b.iy AS iy, n.b.ix AS ix, n.b.d AS offset_km, sum(step) OVER (PARTITION BY st.case_id ORDER BY st.station) AS along_km,
  10 + 0.25e0 * n.b.iy AS model_lat, 85 + 0.25e0 * n.b.ix AS model_lon FROM st JOIN n USING (case_id, station)""", AX3 + ("cases",))
KM = lambda: {c: F.round(c, 6) for c in ("offset_km", "along_km", "lon", "lat")}
_KM = "round(offset_km, 6) AS offset_km, round(along_km, 6) AS along_km, round(s.lon, 6) AS lon, round(s.lat, 6) AS lat"


@query("C14_section_sample", f"""
SELECT s.case_id, s.station, s.iy, s.ix, s.model_lat, s.model_lon, {_KM}, z.idx AS iz, z.depth, g.value, l.label FROM stations s
JOIN ax_depth z ON z.case_id = s.case_id AND z.depth BETWEEN 10 AND 160 LEFT JOIN grid g ON g.case_id = s.case_id AND g.it = 2 AND g.iz = z.idx AND g.iy = s.iy AND g.ix = s.ix
LEFT JOIN rb_labels l ON l.case_id = s.case_id AND l.it = 2 AND l.iz = z.idx AND l.iy = s.iy AND l.ix = s.ix
WHERE s.case_id IN (SELECT case_id FROM cases)""", ("stations", "rb_labels", "grid"))
def c14(i):
    st = rg.stations_along(i.index, START, END, N)
    return rg.section_sample(i.cells, labels(i), i.axes, st, 2, ZMIN, ZMAX).withColumns(KM())


@query("C15_section_observations", f"""
WITH d AS (SELECT m.case_id, m.profile_id, m.sample_index, m.depth_m, m.observed, s.station, {_H.replace('{a}.lat', 'm.latitude').replace('{a}.lon', 'm.longitude').format(b='s')} AS d
  FROM match m JOIN stations s USING (case_id) WHERE accepted AND depth_m BETWEEN 10 AND 160),
 b AS (SELECT case_id, profile_id, sample_index, depth_m, observed, min(struct_pack(d := d, s := station)) AS b FROM d GROUP BY ALL)
SELECT case_id, profile_id, sample_index, depth_m, observed, b.s AS station, round(b.d, 6) AS distance_to_station_km FROM b WHERE b.d <= 25""", ("match", "stations"))
def c15(i):
    st = rg.stations_along(i.index, START, END, N)
    return rg.section_observations(qco.matches(i), st, ZMIN, ZMAX, 25.0).withColumn("distance_to_station_km", F.round("distance_to_station_km", 6))


@query("C16_survey_sample", f"""
SELECT s.case_id, s.station, s.iy, s.ix, s.model_lat, s.model_lon, {_KM}, g.value, u.n AS unique_columns FROM stations s
LEFT JOIN grid g ON g.case_id = s.case_id AND g.it = 5 AND g.iz = 2 AND g.iy = s.iy AND g.ix = s.ix
JOIN (SELECT case_id, count(DISTINCT iy * 15 + ix) AS n FROM stations GROUP BY 1) u ON u.case_id = s.case_id""", ("stations", "grid"))
def c16(i):
    return rg.survey_sample(i.cells, rg.stations_along(i.index, START, END, N, 1e-10), 5, 2).withColumns(KM())


register_cte("linked", """
WITH m AS (SELECT *, (SELECT max(idx) FROM edges e WHERE e.case_id = m.case_id AND axis = 'depth' AND e.lo <= m.depth_m) AS iz FROM match m WHERE accepted AND depth_m BETWEEN 10 AND 160)
SELECT m.case_id, l.threshold_id, m.it, l.label, l.iz, l.iy, l.ix, m.profile_id, m.sample_index, m.depth_m FROM m
JOIN rb_labels l ON l.case_id = m.case_id AND l.it = m.it AND l.iz = m.iz AND l.iy = m.iy AND l.ix = m.ix""", ("match", "rb_labels", "edges"))


def linked(i, lab):
    return rg.obs_to_region(qco.matches(i), lab, i.index, ZMIN, ZMAX)


@query("C17_obs_to_region", "SELECT * FROM linked", ("linked",))
def c17(i):
    return linked(i, labels(i)).select(*rg.REGION, *rg.CELL, "profile_id", "sample_index", "depth_m")


@query("C17_region_observations", f"SELECT {K3}, label, profile_id, count(*) AS samples FROM linked GROUP BY ALL", ("linked",))
def c17b(i):
    return rg.region_observations(linked(i, labels(i)))


_IN = "l.case_id = r.case_id AND l.threshold_id = r.threshold_id AND l.it = r.it AND l.label = r.label"


@query("C18_region_support", f"""
WITH q AS (SELECT r.*, (SELECT count(*) FROM linked l WHERE {_IN}) AS eligible_samples, (SELECT count(DISTINCT profile_id) FROM linked l WHERE {_IN}) AS eligible_profiles,
  (SELECT count(DISTINCT (iz * 12 + iy) * 15 + ix) FROM linked l WHERE {_IN}) AS supported_cells, (SELECT count(DISTINCT iy * 15 + ix) FROM linked l WHERE {_IN}) AS supported_columns,
  (SELECT count(DISTINCT iy * 15 + ix) FROM rb_labels l WHERE {_IN}) AS cols,
  (SELECT count(*) FROM match m WHERE m.case_id = r.case_id AND m.it = r.it AND accepted) AS ok, (SELECT count(*) FROM match m WHERE m.case_id = r.case_id AND m.it = r.it AND NOT accepted) AS excluded_samples
  FROM rb_regions r)
SELECT {K3}, label, cells AS region_cells, supported_cells, cells - supported_cells AS unsupported_cells, eligible_samples, eligible_profiles, supported_columns,
  cols - supported_columns AS unsupported_columns, ok - eligible_samples AS accepted_outside, excluded_samples FROM q""", ("linked", "rb_regions"))
def c18(i):
    lab, m = labels(i), cut(qco.matches(i))
    return rg.region_support(lab, rg.obs_to_region(m, lab, i.index, ZMIN, ZMAX), m)


@query("R3_rank_by_observations", f"""
WITH e AS (SELECT {K3}, label, count(*) AS n FROM linked GROUP BY ALL), r AS (SELECT r.*, coalesce(e.n, 0) AS eligible_samples FROM rb_regions r LEFT JOIN e USING (case_id, threshold_id, it, label)),
 k AS (SELECT *, row_number() OVER (PARTITION BY {K3} ORDER BY eligible_samples DESC, round(volume_km3, 3) DESC, label) AS rank FROM r)
SELECT {K3}, label, eligible_samples, rank FROM k WHERE rank <= 10""", ("linked", "rb_regions"))
def r3b(i):
    lab = labels(i)
    counts = linked(i, lab).groupBy(*rg.REGION).agg(F.count("*").alias("n"))
    r = rg.region_stats(lab, i.index).withColumn("volume_km3", F.round("volume_km3", 3)).join(counts, rg.REGION, "left")
    return rg.rank_regions(r.withColumn("eligible_samples", F.coalesce("n", F.lit(0))), "observations", 10).select(*rg.REGION, "eligible_samples", "rank")
