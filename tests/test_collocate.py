"""Nearest column, gates, brackets, support bins and residuals on hand-made frames."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brinefield.operators import collocate as co
from brinefield.operators import coverage as cov
from brinefield.operators import exclusion as ex
from brinefield.operators import regions as rg
from brinefield.operators import selection as sel
from brinefield.operators.axes import axis_index

T0 = datetime(2024, 1, 7, 12)


def km(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, max(0.0, a))))


@pytest.mark.parametrize("west,span", [(-170, 20), (-170, 170), (-170, 330), (0, 350), (0, 360), (150, 60)])
def test_nearest_column_matches_full_search(spark, make_axes, west, span):
    rng = random.Random(span)
    lats = sorted(rng.uniform(-80, 80) for _ in range(14))
    lons = sorted(rng.uniform(west, west + span) for _ in range(17))
    points = [(k, rng.uniform(-89, 89), rng.uniform(-180, 180)) for k in range(400)]
    rows = spark.createDataFrame([(0, *p) for p in points], "case_id long, k int, lat double, lon double").join(axis_index(make_axes([0, 1], lats, lons)), "case_id")
    for got in co.nearest_column(rows).collect():
        best = min(km(got["lat"], got["lon"], y, x) for y in lats for x in lons)
        assert km(got["lat"], got["lon"], lats[got["iy"]], lons[got["ix"]]) <= best + 1e-9


def test_lookup_follows_the_axis_not_its_spacing(spark, make_axes):
    from pyspark.sql import functions as F

    from brinefield.operators.axes import AxisText
    depth = AxisText("depth")
    index = axis_index(make_axes([0, 1, 1, 1e9], [5], [0, 1e-9, 300]))
    sizes = index.select(F.size("ax_depth_steps"), F.size("ax_lat_steps"), F.size("ax_lon_steps")).first()
    assert tuple(sizes) == (3, 1, 3)
    rows = spark.createDataFrame([(0, v) for v in (-1.0, 0.0, 0.5, 1.0, 2.0, 1e9, 2e9)], "case_id long, v double").join(index, "case_id")
    got = rows.selectExpr("v", f"{depth.floor_index('v')} AS f", f"{depth.ceil_index('v')} AS c").orderBy("v").collect()
    assert [(r["f"], r["c"]) for r in got] == [(0, 0), (0, 0), (0, 1), (2, 2), (2, 3), (3, 3), (3, 3)]


def test_nearest_column_ties_take_first_index(spark, make_axes):
    index = axis_index(make_axes([0, 1], [-1.0, 1.0], [10.0, 12.0]))
    point = spark.createDataFrame([(0, 1.0, 11.0), (0, 0.0, 11.0)], "case_id long, lat double, lon double").join(index, "case_id")
    assert sorted((r["lat"], r["iy"], r["ix"]) for r in co.nearest_column(point, 1e-10).collect()) == [(0.0, 0, 0), (1.0, 1, 0)]


def readings(spark, rows):
    base = dict(case_id=0, profile_id="p", mode="R", scheme="argo", qc="1", pressure_qc="1", position_qc="1", time_qc="1", held=False, has_variable=True,
                compatible=True, coordinate_eligible=True, value_accepted=True, value=25.0, lat=10.0, lon=80.0, depth_m=5.0, ts=T0)
    data = [{**base, "sample_index": k, **r} for k, r in enumerate(rows)]
    schema = ("case_id long, profile_id string, sample_index long, ts timestamp, lat double, lon double, depth_m double, value double, qc string, mode string, scheme string, "
              "pressure_qc string, position_qc string, time_qc string, held boolean, has_variable boolean, compatible boolean, coordinate_eligible boolean, value_accepted boolean")
    return spark.createDataFrame([tuple(d[c.split()[0]] for c in schema.split(", ")) for d in data], schema)


@pytest.fixture(scope="module")
def case(spark, make_axes):
    axes = make_axes([0, 10, 100], [10, 11], [80, 81])
    cells = [(0, 0, z, y, x, None if (z, y, x) == (1, 1, 1) else 26.0 + z) for z in range(3) for y in range(2) for x in range(2)]
    return (axes, spark.createDataFrame(cells, "case_id long, it int, iz int, iy int, ix int, value double"), spark.createDataFrame([(0, 0, T0)], "case_id long, it int, ts timestamp"))


def reasons(spark, case, rows, **settings):
    axes, cells, frames = case
    out = co.collocate(co.with_settings(readings(spark, rows), [co.MatchSettings(**settings)]), cells, axes, frames)
    return {r["sample_index"]: r for r in out.collect()}


def test_one_reason_in_gate_order(spark, case):
    rows = [dict(held=True, has_variable=False), dict(has_variable=False, compatible=False), dict(compatible=False, coordinate_eligible=False),
            dict(coordinate_eligible=False, value=None), dict(value=None, value_accepted=False), dict(value_accepted=False, depth_m=None), dict(depth_m=-1.0, lat=50.0),
            dict(lat=9.0, ts=T0 + timedelta(days=9)), dict(ts=T0 + timedelta(hours=7), lat=10.4), dict(lat=10.4, depth_m=500.0), dict(depth_m=101.0),
            dict(lat=11.0, lon=81.0), dict(depth_m=50.0), dict()]
    got = reasons(spark, case, rows, max_vertical_gap_m=89)
    assert [got[k]["reason"] for k in range(len(rows))] == [
        "source_review", "variable_unavailable", "incompatible_variable", "coordinate_qc", "missing_value", "observation_qc", "invalid_depth", "outside_domain",
        "time_window", "distance", "depth_outside", "masked_bracket", "vertical_gap", "accepted"]
    assert got[13]["model"] == 26.5 and got[13]["residual"] == 1.5 and got[13]["upper_weight"] == 0.5
    assert all(got[k]["model"] is None and got[k]["residual"] is None for k in range(13))


def test_limits_are_inclusive(spark, case):
    rows = [dict(ts=T0 + timedelta(hours=6)), dict(ts=T0 - timedelta(hours=6)), dict(ts=T0 + timedelta(hours=6, seconds=1)), dict(depth_m=50.0), dict(depth_m=10.0), dict(depth_m=100.0)]
    got = reasons(spark, case, rows, max_vertical_gap_m=90)
    assert [got[k]["reason"] for k in range(6)] == ["accepted", "accepted", "time_window", "accepted", "accepted", "accepted"]
    assert got[4]["lower_depth_m"] == got[4]["upper_depth_m"] == 10 and got[4]["upper_weight"] == 0 and got[4]["model"] == 27


def test_strict_flags_narrow_argo_only(spark, case):
    rows = [dict(qc="2"), dict(pressure_qc="2"), dict(qc="2", pressure_qc="2", scheme="woce")]
    assert [r["reason"] for _, r in sorted(reasons(spark, case, rows, good_only=True).items())] == ["observation_qc", "coordinate_qc", "accepted"]
    assert {r["reason"] for r in reasons(spark, case, rows).values()} == {"accepted"}


def match_rows(spark, rows):
    schema = "setting_id int, case_id long, profile_id string, it int, sample_index long, depth_m double, iy int, ix int, residual double, accepted boolean, reason string, model double, observed double, upper_weight double, time_offset_hours double, distance_km double"
    full = [(0, 0, p, 0, k, float(z), 0, 0, r, r is not None, "accepted" if r is not None else "observation_qc", r, 0.0, 0.5, 1.0, 1.0) for k, (p, z, r) in enumerate(rows)]
    return spark.createDataFrame(full, schema)


def test_support_bins(spark, case):
    """Region is the 10 m cell; its bin is [5, 55)."""
    axes = case[0]
    matches = match_rows(spark, [("source", z, 1.0) for z in (4.999, 5, 10, 54.999, 55, 100)] + [("source", 1, None)] * 2)
    labels = spark.createDataFrame([(0, 0, 0, 1, 0, 0, 4, 27.0, 1.0, 4)], "case_id long, threshold_id int, it int, iz int, iy int, ix int, flat long, value double, volume double, label long")
    linked = rg.obs_to_region(matches, labels, axes, 0, 100)
    assert sorted(r["sample_index"] for r in linked.collect()) == [1, 2, 3]
    s = rg.region_support(labels, linked, matches).first()
    assert (s["eligible_samples"], s["supported_cells"], s["unsupported_cells"], s["accepted_outside"], s["excluded_samples"]) == (3, 1, 0, 3, 2)
    assert rg.obs_to_region(matches, labels, axes, 11, 100).count() == 0


def test_leave_out_metrics(spark):
    matches = match_rows(spark, [("a", 1, 1.0), ("a", 2, 2.0), ("b", 3, -3.0), ("b", 4, None), ("c", 5, None)])
    row = cov.residual_metrics(matches, "case_id").first()
    assert (row["matched"], row["bias"], row["mae"], row["max_abs_residual"]) == (3, 0.0, 2.0, 3.0) and row["rmse"] == pytest.approx(math.sqrt(14 / 3))
    people = spark.createDataFrame([(0, p, i, "pf", "lib") for p, i in (("a", "argo"), ("b", "ctd"), ("c", "ctd"))], "case_id long, profile_id string, instrument string, platform string, collection string")
    out = ex.resolve_exclusions(people, ex.selector_table(spark, {"profile": ["b"], "instrument": ["ctd"]}))
    assert {r["profile_id"]: r["selected_by"] for r in out.collect()} == {"b": "profile:b,instrument:ctd", "c": "instrument:ctd"}
    states = {r["state"]: r for r in ex.exclude_and_recompute(matches, out).collect()}
    assert (states["modified"]["total_profiles"], states["modified"]["matched"], states["modified"]["bias"]) == (1, 2, 1.5)
    said = {r["id"]: r["changed"] for r in ex.statements_changed(ex.exclude_and_recompute(matches, out), "psu").collect()}
    assert said == {"eligible_profiles": True, "eligible_samples": True, "residual_statistics": True, "model_state": False}


def test_accounting_flags_a_wrong_residual(spark):
    good = match_rows(spark, [("a", 1, 1.0), ("a", 2, None)])
    broken = good.withColumn("residual", F.col("residual") + 0.5)
    def check(m):
        return {r["check"]: r["passed"] for r in cov.accounting_check(m, cov.profile_coverage(m), cov.exclusion_counts(m, "setting_id", "case_id")).collect()}
    assert all(check(good).values()) and not check(broken)["rows_consistent"]


def test_contrast_pair_matches_all_pairs(spark):
    rng = random.Random(3)
    a, b = [[(0, k, rng.randrange(160) / 8, rng.randrange(400) / 8) for k in range(120)] for _ in range(2)]
    schema = "g int, flat long, surface double, deep double"
    got = co.contrast_pair(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["g"], 0.5).first()
    want = max((abs(y[3] - x[3]), -x[1], -y[1]) for x in a for y in b if abs(x[2] - y[2]) <= 0.5)
    assert (got["contrast"], got["a_flat"], got["b_flat"]) == (want[0], -want[1], -want[2])


def test_cyclic_grid_crosses_the_date_line(spark, make_axes):
    axes = make_axes([5, 15, 25], [-2, -1, 0, 1, 2], [170, 175, 179, 181, 185, 190])
    def lons(w, e):
        return [(r["ix"], r["unwrapped"]) for r in sel.cyclic_axis(axes, w, e).orderBy("jx").collect()]
    assert lons(170, -170) == list(enumerate([170, 175, 179, 181, 185, 190]))
    assert lons(-180, -170) == [(3, -179), (4, -175), (5, -170)]
    cells = spark.createDataFrame([(0, 0, 0, 0, k, v) for k, v in enumerate([280.0, -9.96921e36, float("nan"), 400.0])], "case_id long, it int, iz int, iy int, ix int, value double")
    assert [r["value"] for r in sel.validate_and_scale(cells, -9.96921e36, 200, 330, 1, -273.15).orderBy("ix").collect()] == [pytest.approx(6.85), None, None, None]


def test_trilinear_needs_every_heavy_corner(spark, make_axes):
    axes = make_axes([0, 10], [0, 1], [0, 1])
    cells = [(0, 0, z, y, x, float(z * 4 + y * 2 + x)) for z in (0, 1) for y in (0, 1) for x in (0, 1) if (z, y, x) != (1, 1, 1)]
    points = spark.createDataFrame([(0, 0, 0, 0.5, 0.0, 5.0), (1, 0, 0, 0.5, 0.5, 5.0), (2, 0, 0, 2.0, 0.0, 5.0), (3, 0, 0, 0.0, 1.0, 10.0)], "k int, case_id long, it int, lon double, lat double, depth_m double")
    got = {r["k"]: r["sampled"] for r in sel.trilinear_sample(points, spark.createDataFrame(cells, "case_id long, it int, iz int, iy int, ix int, value double"), axes, "k").collect()}
    assert got == {0: 2.5, 1: None, 2: None, 3: 6.0}


def test_smallest_arc_over_the_date_line(spark):
    rows = spark.createDataFrame([(0, v) for v in (178.0, -178.0, 179.0, -179.0)] + [(1, 10.0)], "g int, lon double")
    got = {r["g"]: (r["center"], r["half_span"]) for r in sel.smallest_longitude_arc(rows, ["g"]).collect()}
    assert got == {0: (-180.0, 2.0), 1: (10.0, 0.0)}


def test_learned_products_need_provenance():
    assert sel.product_problems() == []
    bad = [*sel.PRODUCTS, ("x", ("u",), "u", {"model": "m", "validation": "v"}), ("horizontal_speed", ("u", "u"), "u", None)]
    assert sel.product_problems(bad) == [("horizontal_speed", "name_used_twice"), ("horizontal_speed", "inputs_missing_or_repeated"), ("x", "no_training_data")]


def test_months_are_no_shuffle_key(spark):
    """Profiles of few months stay where they are: no sort by month in one task."""
    profiles = spark.range(50, numPartitions=4).selectExpr("id AS profile_id", "timestamp_seconds(1704412800 + id * 3600) AS ts")
    got = co.profiles_in_months(profiles, spark.createDataFrame([("2023-12",), ("2024-01",), ("2024-01",)], "month string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 50 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
