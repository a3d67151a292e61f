"""Event runs, gaps, climatology, seasons and windows."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from brinefield.operators import seasons as se
from brinefield.operators import series as ts
from brinefield.operators import tracks as tk
from brinefield.operators.windows import ranged, split_lag, split_row_number, split_running_sum

D0 = date(2023, 3, 1)


@pytest.fixture(scope="module")
def flat(spark):
    return spark.range(366).select(F.lit(0).alias("loc"), F.col("id").cast("int").alias("doy"), F.lit(20.0).alias("mean"), F.lit(25.0).alias("threshold"))


def detect(spark, flat, values):
    rows = spark.createDataFrame([(0, D0 + timedelta(days=k), v) for k, v in enumerate(values)], "loc int, d date, v double")
    events, series = ts.detect_events(rows, flat)
    return [((r["start"] - D0).days, (r["end"] - D0).days, r) for r in events.orderBy("start").collect()]


H, C = 26.0, 20.0


@pytest.mark.parametrize("length,found", [(4, 0), (5, 1), (6, 1)])
def test_run_length(spark, flat, length, found):
    assert len(detect(spark, flat, [C] + [H] * length + [C])) == found


@pytest.mark.parametrize("gap,spans", [(1, [(1, 11)]), (2, [(1, 12)]), (3, [(1, 5), (9, 13)])])
def test_gap_joining(spark, flat, gap, spans):
    assert [e[:2] for e in detect(spark, flat, [C] + [H] * 5 + [C] * gap + [H] * 5 + [C])] == spans


def test_missing_day_splits_and_opens_boundaries(spark, flat):
    got = detect(spark, flat, [C] + [H] * 5 + [None] + [H] * 5)
    assert [e[:2] for e in got] == [(1, 5), (7, 11)]
    assert [(e[2]["left_unknown"], e[2]["right_unknown"]) for e in got] == [(False, True), (True, True)]


def test_strict_threshold_and_first_peak(spark, flat):
    assert detect(spark, flat, [25.0] * 8) == []
    e = detect(spark, flat, [C, H, 28.0, H, 28.0, H, C])[0][2]
    assert (e["peak_date"] - D0).days == 2 and e["max_intensity"] == 8.0 and e["cumulative_intensity"] == 34.0 and e["duration_days"] == 5


def test_value_on_a_smoothed_threshold_is_no_exceedance(spark):
    curve = spark.range(366).select(F.lit(0).alias("loc"), F.col("id").cast("int").alias("doy"), F.lit(0.0).alias("mean"), F.lit(4.6).alias("threshold"))
    day = spark.createDataFrame([(0, D0, 4.6), (0, D0 + timedelta(days=1), 4.7)], "loc int, d date, v double")
    rows = ts.exceedance(day, ts.circular_smooth(curve)).orderBy("d").collect()
    assert [r["above"] for r in rows] == [False, True]


def test_equal_peaks_take_the_first_day(spark):
    curve = spark.range(366).selectExpr("0 AS loc", "cast(id AS int) AS doy", "CASE WHEN id = 62 THEN 0.1D ELSE 0.2D END AS mean", "0.25D AS threshold")
    e = detect(spark, curve, [0.0, 0.5, 0.4, 0.3, 0.3, 0.3, 0.0])[0][2]
    assert 0.4 - 0.1 > 0.5 - 0.2 and (e["peak_date"] - D0).days == 1


def test_incomplete_baseline_is_refused(spark):
    days = [D0.replace(year=2000, month=1, day=1) + timedelta(days=k) for k in range(731)]
    rows = [(loc, d, 1.0) for loc in (0, 1) for d in days if not (loc == 1 and d == days[40])]
    daily = spark.createDataFrame(rows, "loc int, d date, v double")
    assert {r["loc"]: r["status"] for r in ts.baseline_status(daily, 2000, 2001).collect()} == {0: "complete", 1: "incomplete_baseline"}
    clim = ts.climatology(daily, 2000, 2001)
    assert clim.count() == 366 and clim.filter("mean <> 1 or threshold <> 1").count() == 0
    assert {r["doy"]: r["pool_count"] for r in clim.filter("doy in (0, 59, 100)").collect()} == {0: 17, 59: 0, 100: 22}


def seasons(spark, values, start=24000):
    return spark.createDataFrame([(0, (start + k) // 12, (start + k) % 12 + 1, v) for k, v in enumerate(values)], "index_id int, y int, m int, value_c double")


@pytest.mark.parametrize("values,phases", [
    ([0.5] * 5, ["el_nino"] * 5), ([0.5] * 4, ["neutral"] * 4), ([-0.5] * 5 + [0.5], ["la_nina"] * 5 + ["neutral"]),
    ([0.6] * 3 + [None] + [0.6] * 3, ["neutral"] * 3 + ["unavailable"] + ["neutral"] * 3), ([0.6] * 3 + [0.49] + [0.6] * 5, ["neutral"] * 4 + ["el_nino"] * 5)])
def test_season_runs(spark, values, phases):
    assert [r["phase"] for r in se.qualify_runs(seasons(spark, values)).orderBy("y", "m").collect()] == phases


def test_season_runs_need_consecutive_months(spark):
    rows = seasons(spark, [0.9] * 8).filter("m <> 4")
    assert [r["phase"] for r in se.qualify_runs(rows).orderBy("y", "m").collect()] == ["neutral"] * 7


def test_split_windows_equal_plain_windows(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", k, rng.randrange(1000), float(rng.randrange(8))) for k in range(800)]
    df = spark.createDataFrame(rows, "g string, id long, t long, x double")
    w = Window.partitionBy("g").orderBy("t", "id")
    plain = df.select("*", F.lag("x").over(w).alias("p"), F.lead("id").over(w).alias("n"), F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    chunk = F.floor(F.col("t") / 37)
    split = split_lag(df, ["g"], ["t", "id"], {"p": "x"}, chunk)
    split = split_lag(split, ["g"], ["t", "id"], {"n": "id"}, chunk, lead=True)
    split = split_running_sum(split, ["g"], ["t", "id"], "x", "s", chunk)
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, split.select(*plain.columns).collect()), key=repr)


def test_sampled_ranges_split_a_crowded_group(spark):
    """All rows of one group lie inside one minute; its ranges are many and its windows right."""
    rng = random.Random(6)
    rows = [("hot", k, k % 50, float(rng.randrange(8))) for k in range(3000)] + [("cold", k, k, 1.0) for k in range(20)]
    df = spark.createDataFrame(rows, "g string, id long, t long, x double")
    cut_up = ranged(df, ["g"], ["t", "id"])
    assert cut_up.filter("g = 'hot'").select("_chunk").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy("g").orderBy("t", "id")
    plain = df.select("*", F.lag("x").over(w).alias("p"), F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.row_number().over(w).alias("k"))
    split = split_running_sum(split_lag(df, ["g"], ["t", "id"], {"p": "x"}), ["g"], ["t", "id"], "x", "s")
    split = split_row_number(split, ["g"], [F.col("t"), F.col("id")], "k")
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, split.select(*plain.columns).collect()), key=repr)
    down = split_row_number(df, ["g"], [F.col("x").desc(), F.col("id")], "k").filter("g = 'hot'").orderBy("k").collect()
    assert [(r["x"], r["id"]) for r in down] == sorted([(x, k) for g, k, _, x in rows if g == "hot"], key=lambda r: (-r[0], r[1]))


def test_merge_stops_or_leaves_conflicts_out(spark):
    schema = "loc string, d date, v double, source string"
    day = lambda k: date(2024, 1, k)
    a = spark.createDataFrame([("x", day(1), 1.0, "a"), ("x", day(2), 2.0, "a"), ("x", day(3), None, "a"), ("x", day(4), 1.0, "a")], schema)
    b = spark.createDataFrame([("x", day(1), 1.0, "b"), ("x", day(2), 2.5, "b"), ("x", day(3), 3.0, "b"), ("x", day(5), 7.0, "b")], schema)
    merged, against = ts.merge_checked(a, b, conflicts="quarantine")
    assert sorted((r.d.day, r.v, r.source) for r in merged.collect()) == [(1, 1.0, "a"), (4, 1.0, "a"), (5, 7.0, "b")]
    assert sorted((r.d.day, r.first_value, r.second_value) for r in against.collect() if r.first_source == "a") == [(2, 2.0, 2.5), (3, None, 3.0)]
    with pytest.raises(ValueError, match="2 records differ"):
        ts.merge_checked(a, b)
    merged, against = ts.merge_checked(a, a.withColumn("source", F.lit("again")))
    assert merged.count() == 4 and against.count() == 0


def test_target_entry_cases(spark):
    rows = [(1, 0, 0, 0.0, 0.0), (1, 1, 100, 4.0, 0.0), (2, 0, 0, 2.5, 0.0), (2, 1, 100, 9.0, 9.0), (3, 0, 0, 0.0, 5.0), (3, 1, 100, 4.0, 5.0), (4, 0, 0, 2.5, -2.0), (4, 1, 100, 2.5, 2.0)]
    tracks = spark.createDataFrame(rows, "particle_id int, point_id int, elapsed_s long, lon double, lat double")
    got = {r["particle_id"]: r["entry_s"] for r in tk.target_entry(tracks, (2.0, -1.0, 3.0, 1.0)).collect()}
    assert got == {1: 50.0, 2: 0.0, 3: None, 4: 25.0}


def test_seeded_points_follow_the_generator(spark):
    box = spark.createDataFrame([(7, 12345, 300, 10.0, -5.0, 20.0, 5.0)], "release_id long, seed long, count long, west double, south double, east double, north double")
    state, want = 12345, []
    for _ in range(600):
        state = (1664525 * state + 1013904223) & 0xFFFFFFFF
        want.append((state + 0.5) / 4294967296.0)
    got = tk.seeded_points(box).orderBy("point").collect()
    assert [(r["lon"], r["lat"]) for r in got] == [(want[2 * k] * 10 + 10, want[2 * k + 1] * 10 - 5) for k in range(300)]


def test_a_month_met_twice_does_not_split_a_run(spark):
    from brinefield.operators import seasons as sn
    rows = [(0, 2000, m, 1.0) for m in (1, 2, 3, 3, 4, 5)] + [(1, 2000, m, 1.0) for m in (1, 2, 2, 3, 4)]
    got = sn.qualify_runs(spark.createDataFrame(rows, "index_id int, y int, m int, value_c double")).groupBy("index_id", "phase").count().collect()
    assert {(r["index_id"], r["phase"]): r["count"] for r in got} == {(0, "el_nino"): 6, (1, "neutral"): 5}


def test_numbers_in_statements(spark):
    from pyspark.sql import functions as F

    from brinefield.operators.exclusion import six_digits
    values = [0.0, 1.0, -1.5, 1234567.0, 999999.5, 123456.0, 1.234e-5, -0.00012345678, 0.1 + 0.2, 1e300, 2 / 3, 100.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", six_digits(F.col("v")).alias("t")).collect()
    assert {r["v"]: r["t"] for r in got} == {v: f"{v:.6g}" for v in values}


def test_calendar_of_each_location_stays_spread(spark, tmp_path):
    """Few bytes of locations become a calendar each, so they are not merged into one task."""
    from brinefield.registry.projections import Inputs
    spark.range(4000).selectExpr("id AS o_orderkey", "id * 125 AS o_custkey", "timestamp_ntz'1996-01-01 00:00:00' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    days = Inputs(spark, str(tmp_path)).daily.select("loc", "d").withColumn("_p", F.spark_partition_id()).groupBy("_p").agg(F.count_distinct("loc").alias("n")).collect()
    assert sum(r["n"] for r in days) == 1000 and max(r["n"] for r in days) < 400
