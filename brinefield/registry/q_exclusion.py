"""Leave-out analysis and table equality queries."""

from pyspark.sql import functions as F

from brinefield.operators import audit as au
from brinefield.operators import coverage as cov
from brinefield.operators import exclusion as ex
from brinefield.registry import q_collocation as qco
from brinefield.registry.core import query
from brinefield.registry.projections import register_cte
from brinefield.runtime import cut

CHOICES = {"profile": ["0-8", "1-15", "no-such"], "instrument": ["bgc"], "platform": ["pf4", "pf404"], "collection": []}
_SEL = ", ".join(f"('{k}', '{n}')" for k, names in CHOICES.items() for n in names)
register_cte("people", "SELECT DISTINCT case_id, profile_id, instrument, platform, collection FROM obs", ("obs",))
register_cte("tagged", " UNION ALL ".join(f"SELECT case_id, profile_id, '{k}' AS kind, {c} AS name, {p} AS o FROM people" for p, (k, c) in enumerate(ex.FIELDS.items())), ("people",))
register_cte("excluded", f"""SELECT case_id, profile_id, string_agg(kind || ':' || name, ',' ORDER BY o) AS selected_by FROM tagged JOIN (VALUES {_SEL}) s(kind, name) USING (kind, name) GROUP BY 1, 2""", ("tagged",))
register_cte("states", """
WITH r AS (SELECT m.*, 'baseline' AS state FROM match m UNION ALL SELECT m.*, 'modified' FROM match m WHERE NOT EXISTS (SELECT 1 FROM excluded e WHERE e.case_id = m.case_id AND e.profile_id = m.profile_id))
SELECT case_id, state, count(DISTINCT profile_id) AS total_profiles, count(DISTINCT profile_id) FILTER (WHERE accepted) AS matched_profiles, count(*) AS total_samples,
  count(*) FILTER (WHERE NOT accepted) AS excluded_samples, count(residual) AS matched, avg(residual) AS bias, sqrt(avg(residual * residual)) AS rmse, avg(abs(residual)) AS mae, max(abs(residual)) AS max_abs_residual
FROM r GROUP BY 1, 2""", ("match", "excluded"))


def people(i):
    return i.obs.select("case_id", "profile_id", "instrument", "platform", "collection").distinct()


def excluded(i):
    return ex.resolve_exclusions(people(i), ex.selector_table(i.spark, CHOICES))


@query("E1_resolve_exclusions", "SELECT * FROM excluded", ("excluded",))
def e1(i):
    return excluded(i)


@query("E2_unknown_selectors", f"SELECT kind, name FROM (VALUES {_SEL}) s(kind, name) WHERE NOT EXISTS (SELECT 1 FROM tagged t WHERE t.kind = s.kind AND t.name = s.name)", ("tagged",))
def e2(i):
    return ex.unknown_selectors(people(i), ex.selector_table(i.spark, CHOICES))


NUM = ("bias", "rmse", "mae", "max_abs_residual")


@query("E3_exclude_and_recompute", f"SELECT * EXCLUDE ({', '.join(NUM)}), {', '.join(f'round({c}, 9) AS {c}' for c in NUM)} FROM states", ("states",))
def e3(i):
    return ex.exclude_and_recompute(qco.matches(i), excluded(i)).withColumns({c: F.round(c, 9) for c in NUM})


@query("E4_profile_effects", """
SELECT m.case_id, m.profile_id, e.selected_by IS NOT NULL AS excluded_by_user, coalesce(e.selected_by, '') AS selected_by, count(residual) AS baseline_matched,
  CASE WHEN e.selected_by IS NULL THEN count(residual) ELSE 0 END AS remaining_matched, CASE WHEN e.selected_by IS NULL THEN 0 ELSE count(residual) END AS removed_eligible
FROM match m LEFT JOIN excluded e USING (case_id, profile_id) GROUP BY m.case_id, m.profile_id, e.selected_by""", ("match", "excluded"))
def e4(i):
    return ex.profile_effects(qco.matches(i), excluded(i))


@query("E4_removed_samples", "SELECT case_id, profile_id, sample_index FROM match JOIN excluded USING (case_id, profile_id) WHERE accepted", ("match", "excluded"))
def e4b(i):
    return ex.removed_samples(qco.matches(i), excluded(i))


_S = "CASE WHEN matched > 0 THEN 'Model minus observed: bias ' || g(bias) || ' °C, RMSE ' || g(rmse) || ' °C, MAE ' || g(mae) || ' °C; equal weight per eligible sample.' ELSE 'No eligible model-observation pairs remain; residual statistics are unavailable.' END"
for _c in ("bias", "rmse", "mae"):
    _S = _S.replace(f"g({_c})", f"format('{{:.6g}}', {_c})")


@query("E5_statements_changed", f"""
WITH t AS (SELECT case_id, state, 'eligible_profiles' AS id, matched_profiles || ' profiles supply eligible comparisons under the selected matching rules.' AS x, NULL AS m FROM states
 UNION ALL SELECT case_id, state, 'eligible_samples', matched || ' eligible model-observation pairs are available.', NULL FROM states
 UNION ALL SELECT case_id, state, 'residual_statistics', {_S}, round(bias + rmse * 1000, 7) FROM states
 UNION ALL SELECT case_id, state, 'model_state', 'The original ocean model and observation quality flags are unchanged.', NULL FROM states)
SELECT a.case_id, a.id, a.x AS baseline, b.x AS modified, a.x <> b.x OR a.m IS DISTINCT FROM b.m AS changed FROM t a JOIN t b ON b.case_id = a.case_id AND b.id = a.id AND a.state = 'baseline' AND b.state = 'modified'""",
       ("states",))
def e5(i):
    return ex.statements_changed(ex.exclude_and_recompute(qco.matches(i), excluded(i)), "°C")


@query("E6_consistency_checks", """
WITH p AS (SELECT DISTINCT case_id, CAST(split_part(profile_id, '-', 2) AS INT) AS u FROM match),
 b AS (SELECT case_id, bool_or(case_id % 2 = 0 AND u % 11 = 5) AS twice, bool_or(case_id % 2 = 0 AND u % 7 = 3) AS off FROM p GROUP BY 1)
SELECT case_id, c."check", CASE c."check" WHEN 'profile_ids_unique' THEN NOT twice WHEN 'counts_agree' THEN NOT (twice OR off) ELSE true END AS passed
FROM b, (VALUES ('profile_ids_unique'), ('same_library'), ('one_setting'), ('counts_agree')) c("check")""", ("match",))
def e6(i):
    """Even cases get a coverage table with repeated profiles and wrong counts."""
    m = cut(qco.matches(i))
    table = cut(cov.profile_coverage(m))
    user, even = F.element_at(F.split("profile_id", "-"), 2).cast("int"), F.col("case_id") % 2 == 0
    wrong = table.withColumn("matched", F.col("matched") + (even & (user % 7 == 3)).cast("long"))
    return ex.consistency_checks(m, wrong.unionByName(table.filter(even & (user % 11 == 5))))


@query("E7_tables_equal", """
WITH a AS (SELECT * FROM grid), b AS (SELECT case_id, it, iz, iy, ix, CASE WHEN it = 2 AND ix = 3 THEN value + 0.25 WHEN it = 3 AND iy = 1 THEN NULL ELSE value END AS value FROM grid WHERE NOT (it = 4 AND iz = 6)
   UNION ALL SELECT case_id, 5, 90, iy, ix, value FROM grid WHERE it = 5 AND iz = 0)
SELECT case_id, it, count(*) AS keys, count(*) FILTER (WHERE x IS NULL) AS only_b, count(*) FILTER (WHERE y IS NULL) AS only_a,
  count(*) FILTER (WHERE x AND y AND va IS DISTINCT FROM vb) AS different, bool_and(coalesce(x AND y AND va IS NOT DISTINCT FROM vb, false)) AS equal
FROM (SELECT case_id, it, iz, iy, ix, value AS va, true AS x FROM a) FULL JOIN (SELECT case_id, it, iz, iy, ix, value AS vb, true AS y FROM b) USING (case_id, it, iz, iy, ix) GROUP BY 1, 2""", ("grid",))
def e7(i):
    a = i.cells
    value = F.when(F.expr("it = 2 and ix = 3"), F.col("value") + 0.25).when(F.expr("it = 3 and iy = 1"), None).otherwise(F.col("value"))
    b = a.filter("not (it = 4 and iz = 6)").withColumn("value", value)
    extra = a.filter("it = 5 and iz = 0").withColumn("iz", F.lit(90))
    return au.tables_equal(a, b.unionByName(extra), ["case_id", "it", "iz", "iy", "ix"], ["value"], ["case_id", "it"])


@query("A14_group_membership", """SELECT case_id, kind, name, profile_id, count(*) OVER (PARTITION BY case_id, kind, name) AS members FROM tagged WHERE kind <> 'profile'""", ("tagged",))
def a14(i):
    return ex.group_membership(people(i))
