"""File inputs, mappings, guards, digests and audits."""

import datetime

import pytest
from pyspark.sql import functions as F

from brinefield.functions.scalars import guard_text
from brinefield.operators import audit as au
from brinefield.sources import observations as ob
from brinefield.sources import tables
from brinefield.sources.grids import block_problems, explode_blocks, explode_field, field_shape_check

HEAD = "profile_id,instrument,platform,time,latitude,longitude,pressure_dbar,pressure_qc,position_qc,time_qc,temperature_c,temperature_qc"


def test_csv_width_time_and_missing(spark, tmp_path):
    good = "p1,argo,pf,2024-01-05T10:00:00Z,10,80,5,1,1,1,25.5,1"
    lines = [HEAD, good, "p1,argo,pf,2024-01-05T10:00:00,10,80,,1,1,1,,1", "p2,argo,pf,2024-01-05T10:00:00Z,10,80,5,1,1,1,25.5", "p3,boat,pf,2024-01-05T10:00:00Z,10,80,5,1,1,1,25.5,1",
             "p4,argo,a,2024-01-05T10:00:00Z,10,80,5,1,1,1,25.5,1", "p4,argo,b,2024-01-05T10:00:00Z,99,80,5,1,1,1,25.5,1",
             "p5,argo,pf,2024-01-05T10:00:00Z,10,80,deep,1,1,1,25.5,1", "p5,argo,pf,2024-01-05T10:00:00Z,10,80, ,1,1,1,warm,1", "p6,argo,pf,2024-01-05T10:00:00Z,10,80,5,1,1,1,NaN,1"]
    path = tmp_path / "obs.csv"
    path.write_text("\n".join(lines) + "\n")
    rows = ob.read_observation_csv(spark, str(path), ["temperature_c"])
    assert {(r["profile_id"], r["problem"]) for r in ob.csv_problems(rows).collect()} == {
        ("p1", "invalid_time"), ("p2", "invalid_csv"), ("p3", "unsupported_instrument"), ("p4", "inconsistent_metadata"), ("p4", "invalid_position"), ("p5", "invalid_number")}
    got = ob.csv_readings(rows, ["temperature_c"]).filter("profile_id = 'p1'").orderBy("pressure_dbar").collect()
    assert [(r["value"], r["pressure_dbar"], r["depth_m"] is None, r["ts"] is None) for r in got] == [(None, None, True, True), (25.5, 5.0, False, False)]


def test_ctd_exchange_files(spark, tmp_path):
    head = "CTD,20240101\n#note = skip\nEXPOCODE = X1\nSTNNBR = 7\nCASTNO = 2\nDATE = 20240105\nTIME = 930\nLATITUDE = 10.5\nLONGITUDE = 86\n"
    table = "CTDPRS,CTDPRS_FLAG_W,CTDTMP,CTDTMP_FLAG_W\nDBAR,,DEG_C,\n1,2,28.5,2\n2,3,-999,9\n"
    (tmp_path / "a.csv").write_text(head + table + "END_DATA\n")
    (tmp_path / "b.csv").write_text(head + table)
    (tmp_path / "c.csv").write_text("CTD,1\nEXPOCODE = X1\n")
    end = table + "END_DATA\n"
    (tmp_path / "d.csv").write_text(head + end.replace("DEG_C", "K"))
    (tmp_path / "e.csv").write_text(head + end.replace(",CTDTMP_FLAG_W", ""))
    (tmp_path / "f.csv").write_text(head + end.replace("CTDPRS,CTDPRS_FLAG_W,CTDTMP,CTDTMP_FLAG_W\nDBAR,,DEG_C,", "CTDPRS,CTDPRS_FLAG_W\nDBAR,"))
    (tmp_path / "g.csv").write_text(head.replace("10.5", "95") + end)
    (tmp_path / "h.csv").write_text(head.replace("= 930", "= 2460") + end)
    rows = ob.parse_ctd(ob.read_ctd_exchange(spark, str(tmp_path))).collect()
    good = sorted((r["sample_index"], r["value"], r["qc"], r["pressure_qc"], str(r["ts"])) for r in rows if r["problem"] is None)
    assert good == [(0, 28.5, "2", "2", "2024-01-05 09:30:00"), (1, None, "9", "3", "2024-01-05 09:30:00")]
    assert sorted(r["problem"] for r in rows if r["problem"]) == [
        "incompatible_units", "incompatible_units", "incomplete_file", "invalid_position", "invalid_time", "missing_metadata", "missing_variable"]


def test_mapping_rules(spark):
    df = spark.createDataFrame([("300",), ("NaN",), ("",), ("hot",)], "kelvin string")
    out = ob.map_columns(df, [("temperature_c", "kelvin", "K")])
    assert [(None if r[0] is None else round(r[0], 2), r[1]) for r in out.collect()] == [(26.85, False), (None, False), (None, False), (None, True)]
    assert [tuple(r) for r in ob.mapping_plan(df, [("temperature_c", "kelvin", "K")]).collect()] == [("temperature_c", "kelvin", "K", 1.0, -273.15, None)]
    asked = [("temperature_c", "kelvin", "psu"), ("time", "kelvin", "s"), ("nothing", "kelvin", None), ("platform", "absent", None), ("instrument", "kelvin", None)]
    assert {r["target"]: r["problem"] for r in ob.mapping_plan(df, asked).collect()} == {
        "temperature_c": "unsupported_unit", "time": "unit_on_plain_column", "nothing": "unknown_target", "platform": "absent_source", "instrument": "source_used_twice"}
    with pytest.raises(ValueError, match="nothing <- kelvin: unknown_target"):
        ob.map_columns(df, asked)
    own = spark.createDataFrame([("20", "30")], "temperature_c string, salinity_psu string")
    assert {r["target"]: r["problem"] for r in ob.mapping_plan(own, [("oxygen_umol_kg", "salinity_psu", "umol/kg")]).collect()}["oxygen_umol_kg"] == "relabelled_measurement"


def test_numbers_in_digests_are_exact(spark):
    from brinefield.operators import audit as au
    def mark(values, kind="double"):
        return au.fingerprint(spark.createDataFrame([(v,) for v in values], f"v {kind}")).first()["fingerprint"]
    values = [1e-10, 2e-10, 1e30, 1e30 * (1 + 2 ** -52), 5e-324, 1.7976931348623157e308, 0.1, 0.1 + 1e-17, 0.1 + 2 ** -56, 1.0, 3.0, -3.0]
    assert len({mark([v]) for v in values}) == len({*values})
    assert mark([0.0]) == mark([-0.0]) == mark([0], "int") and mark([3.0]) == mark([3], "long") != mark([None], "long")
    assert mark([2 ** 60], "long") == mark([2.0 ** 60]) and mark([2 ** 60 + 1], "long") != mark([2 ** 60], "long")
    with pytest.raises(Exception, match="non-finite"):
        mark([float("nan")])


def test_field_arrays(spark):
    rows = spark.createDataFrame([(0, 1, 2, 2, [1.0, float("nan"), 3.0, 4.0]), (1, 1, 2, 2, [1.0])], "it int, nz int, ny int, nx int, values array<double>")
    assert [(r["iy"], r["ix"], r["value"]) for r in explode_field(rows, "it").orderBy("iy", "ix").collect()] == [(0, 0, 1.0), (0, 1, None), (1, 0, 3.0), (1, 1, 4.0)]
    assert [(r["it"], r["found"], r["expected"]) for r in field_shape_check(rows, "it").collect()] == [(1, 1, 4)]


def test_blocks_of_a_frame(spark):
    def frame(it, *blocks):
        return [(it, 1, 2, 3, offset, [float(offset + k) for k in range(n)]) for offset, n in blocks]
    rows = [*frame(0, (0, 4), (4, 2)), *frame(1, (0, 4)), *frame(2, (0, 4), (3, 3)), *frame(3, (1, 5)), *frame(4, (0, 6), (6, 1)), *frame(5, (0, 6), (0, 6)), *frame(6, (0, 0), (0, 6))]
    blocks = spark.createDataFrame(rows, "it int, nz int, ny int, nx int, offset long, values array<double>").repartition(3)
    assert sorted((r["it"], r["offset"], r["problem"]) for r in block_problems(blocks, "it").collect()) == [
        (1, 0, "missing_after"), (2, 3, "overlapping"), (3, 1, "missing_before"), (4, 6, "beyond_frame"), (5, 0, "overlapping")]
    cells = {(r["it"], r["iy"], r["ix"]): r["value"] for r in explode_blocks(blocks, "it").collect()}
    assert cells == {(it, y, x): float(y * 3 + x) for it in (0, 6) for y in range(2) for x in range(3)}


def test_profiles_are_numbered_in_source_order(spark):
    rows = [(0, "7.0"), (1, "3"), (2, "7"), (3, "NaN"), (4, None), (5, "x"), (6, "3.0"), (7, "-2.9"), (8, "7")]
    numbered, refused = ob.number_profiles(spark.createDataFrame(rows, "k int, profile_id string").repartition(3), "k")
    assert sorted((r.k, r.profile_id, r.place, r.profile_no) for r in numbered.collect()) == [(0, 7, 0, 0), (1, 3, 0, 1), (2, 7, 1, 0), (6, 3, 1, 1), (7, -2, 0, 2), (8, 7, 2, 0)]
    assert sorted((r.k, r.problem) for r in refused.collect()) == [(k, "missing_profile_id") for k in (3, 4, 5)]


def test_cases_over_the_seam_and_half_open_months(spark):
    d = datetime.date
    cases = spark.createDataFrame([(0, 350.0, 5.0, -10.0, 10.0, d(2024, 1, 1), d(2024, 3, 1), 5.0, 100.0), (1, -20.0, -15.0, 0.0, 5.0, d(2024, 2, 1), d(2024, 3, 1), 5.0, 100.0)],
                                  "case_id long, west double, east double, south double, north double, start date, end date, depth_min double, depth_max double")
    t = lambda m, day, h=0: datetime.datetime(2024, m, day, h)
    rows = [("a", 0, -10.0, 10.0, t(1, 1)), ("b", 0, 365.0, 0.0, t(2, 29, 23)), ("c", 0, 5.5, 0.0, t(2, 1)), ("d", 0, 0.0, 0.0, t(3, 1)), ("e", 1, 343.0, 5.0, t(2, 1)), ("f", 1, 343.0, 5.0, t(1, 31, 23)), ("g", 1, None, 5.0, None)]
    p = spark.createDataFrame([(*r, 0.0, 4.0 if r[0] == "a" else 50.0) for r in rows], "profile_id string, case_id long, lon double, lat double, time timestamp, depth_min double, depth_max double")
    flags = {r.profile_id: (r.spatial, r.temporal, r.vertical) for r in tables.cyclic_overlap(p, cases).collect()}
    assert flags == {"a": (True, True, False), "b": (True, True, True), "c": (False, True, True), "d": (True, False, True), "e": (True, True, True), "f": (True, False, True), "g": (False, False, True)}
    assert sorted(tuple(r) for r in tables.cases_met(p, cases).collect()) == [("a", 0), ("b", 0), ("e", 1)]


def test_guard_and_csv_output(spark, tmp_path):
    rows = spark.createDataFrame([("=1",), (" +1",), ("ok",), ("-",), ("@x",), (None,)], "t string")
    assert [r[0] for r in rows.select(guard_text(F.col("t"))).collect()] == ["'=1", "' +1", "ok", "'-", "'@x", None]
    out = str(tmp_path / "t")
    tables.write_table_csv(rows.select("t", F.lit(-1.5).alias("n"), F.array(F.lit(1)).alias("a")).coalesce(1), out, {"method": "m"})
    assert spark.read.text(out).filter("value like '%=1%'").first()[0] == "m,'=1,-1.5,[1]"


def test_fingerprint_canonical_form(spark):
    a = spark.createDataFrame([(1, 0.0, "x"), (2, 1.5, None)], "k int, v double, s string")
    b = spark.createDataFrame([(2.0, 1.5, None), (1.0, -0.0, "x")], "k double, v double, s string").repartition(3)
    def fp(df):
        return au.fingerprint(df).first()["fingerprint"]
    assert fp(a) == fp(b) and fp(a) != fp(a.filter("k = 1")) and fp(a) != fp(a.union(a)) and fp(a) != fp(a.withColumn("s", F.lit("x")))


def test_replay_names_the_first_mismatch(spark):
    schema = "run_id string, recipe_sha string, method string, source_sha string, result_sha string"
    saved = spark.createDataFrame([(k, "r", "m", "s", "x") for k in "abcd"], schema)
    now = spark.createDataFrame([("a", "r", "m", "s", "x"), ("b", "r", "n", "t", "y"), ("c", "r", "m", "s", "y")], schema)
    assert {r["run_id"]: r["outcome"] for r in au.replay(saved, now).collect()} == {"a": "matched", "b": "method_mismatch", "c": "result_mismatch", "d": "source_unavailable"}


def test_tree_inventory(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("abc")
    got = au.read_tree(spark, str(tmp_path)).first()
    assert got["path"].endswith("in/a.txt") and got["bytes"] == 3 and got["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
