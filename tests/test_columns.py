"""Water columns, and what reads them: brackets, corners, frames that rescue a profile."""

import random
from datetime import timedelta

import numpy as np
import pytest
from test_collocate import T0, readings

from brinefield.operators import collocate as co
from brinefield.operators import selection as sel
from brinefield.sources.fields import column_packed, read_columns, read_field, write_field

CELLS = "case_id long, it int, iz int, iy int, ix int, value double, u double"



def test_columns_hold_every_level(spark, tmp_path):
    rows = [(0, 0, 0, 0, 0, 1.0, 9.0), (0, 0, 1, 0, 0, None, 8.0), (0, 0, 2, 0, 0, 3.0, None), (0, 0, 2, 1, 0, 5.0, 6.0), (0, 0, 0, 1, 0, 4.0, 7.0), (7, 3, 1, 2, 2, 2.5, None)]
    cells = spark.createDataFrame(rows, CELLS)
    want = {(0, 0, 0, 0): ([1.0, None, 3.0], [9.0, 8.0, None]), (0, 0, 1, 0): ([4.0, None, 5.0], [7.0, None, 6.0]), (7, 3, 2, 2): ([None, 2.5], [None, None])}
    assert {tuple(r)[:4]: (r.value, r.u) for r in column_packed(cells).collect()} == want
    assert column_packed(cells.filter("false")).count() == 0
    packed = column_packed(cells)
    assert column_packed(packed) is packed
    write_field(cells, str(tmp_path / "field"))
    stored = read_columns(spark, str(tmp_path / "field"))
    assert {(r.case_id, r.it, r.iy, r.ix): (r.value, r.u) for r in stored.collect()} == want
    assert sorted(map(tuple, read_field(spark, str(tmp_path / "field"), cells.schema).fillna(-1).collect())) == sorted(map(tuple, cells.fillna(-1).collect()))


@pytest.fixture(scope="module")
def field(spark, make_axes):
    """Two frames twelve hours apart, missing cells here and there."""
    rng = random.Random(4)
    cells = [(0, it, z, y, x, None if rng.random() < 0.2 else float(rng.randrange(90)), 0.0)
             for it in range(4) for z in range(3) for y in range(3) for x in range(3) if rng.random() < 0.9]
    frames = [(0, k, T0 + timedelta(hours=12 * k)) for k in range(4)]
    return make_axes([0, 10, 100], [10, 11, 12], [80, 81, 82]), spark.createDataFrame(cells, CELLS), spark.createDataFrame(frames, "case_id long, it int, ts timestamp"), rng


def test_snapshot_equals_trying_every_frame(spark, field):
    axes, cells, frames, rng = field
    rows = [dict(profile_id=f"p{rng.randrange(25)}", lat=10 + rng.randrange(3) + 0.01, lon=80.0 + rng.randrange(3), depth_m=float(rng.randrange(110)),
                 ts=T0 + timedelta(hours=rng.randrange(-20, 60)), held=rng.random() < 0.1) for _ in range(160)]
    settings = co.MatchSettings(it=0, time_window_hours=8, distance_km=5, max_vertical_gap_m=95)
    given = readings(spark, rows)
    tried = {it: co.collocate(co.with_settings(given, [co.MatchSettings(it, 8, 5, 95)]), cells, axes, frames).collect() for it in range(4)}
    profiles = {r.profile_id for r in tried[0] if r.reason == "time_window"} - {r.profile_id for r in tried[0] if r.accepted}
    want = {}
    for p in profiles:
        times = [r.observation_time for r in tried[0] if r.profile_id == p and r.reason == "time_window"]
        frames_near = [it for it in range(1, 4) if any(abs((t - T0).total_seconds() / 3600 - 12 * it) <= 8 for t in times)]
        options = [(min(abs(r.time_offset_hours) for r in ok), min(r.distance_km for r in ok), it, len(ok)) for it in frames_near
                   if (ok := [r for r in tried[it] if r.profile_id == p and r.accepted])]
        if options:
            want[p] = min(options)
    got = {r.profile_id: (r.suggested_offset_hours, r.suggested_distance_km, r.suggested_it, r.suggested_matched)
           for r in co.suggest_snapshot(given, column_packed(cells), axes, frames, settings).collect()}
    assert got == want and len(want) > 4


def test_readings_and_field_are_read_once(spark, field, tmp_path):
    axes, cells, frames, rng = field
    readings(spark, [dict(profile_id="p")]).write.parquet(str(tmp_path / "readings"))
    write_field(cells, str(tmp_path / "field"))
    given, packed = spark.read.parquet(str(tmp_path / "readings")), read_columns(spark, str(tmp_path / "field"))
    plan = co.collocate(co.with_settings(given, [co.MatchSettings()]), packed, axes, frames)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2


def test_points_take_their_columns_along(spark, make_axes):
    axes = make_axes([0, 10], [0, 1], [0, 1])
    cells = spark.createDataFrame([(0, 0, z, y, x, float(z * 4 + y * 2 + x), 1.0) for z in (0, 1) for y in (0, 1) for x in (0, 1)], CELLS)
    points = spark.createDataFrame([(k, 0, 0, lon, lat, z, f"n{k}") for k, (lon, lat, z) in enumerate([(0.5, 0.5, 5.0), (None, 0.5, 5.0), (0.5, 9.0, 5.0), (1.0, 1.0, 10.0)])] + [(9, 5, 0, 0.5, 0.5, 5.0, "no case")],
                                   "k int, case_id long, it int, lon double, lat double, depth_m double, name string")
    got = {r.k: (r.name, r.sampled) for r in sel.trilinear_sample(points, cells, axes, "k").collect()}
    assert got == {0: ("n0", 3.5), 1: ("n1", None), 2: ("n2", None), 3: ("n3", 7.0), 9: ("no case", None)}
    assert sel.trilinear_sample(points, cells, axes, "k").columns == [*points.columns, "sampled"]


def test_velocity_between_frames(spark, make_axes):
    axes = make_axes([0, 10], [0, 1], [0, 1])
    cells = spark.createDataFrame([(0, it, 0, y, x, 10.0 * it + x, None if (it, y, x) == (2, 1, 1) else 1.0) for it in range(3) for y in (0, 1) for x in (0, 1)],
                                  "case_id long, it int, iz int, iy int, ix int, u double, v double")
    frames = spark.createDataFrame([(0, k, T0 + timedelta(hours=12 * k)) for k in range(3)], "case_id long, it int, ts timestamp")
    points = spark.createDataFrame([(k, 0, x, y, T0 + timedelta(hours=h)) for k, (x, y, h) in enumerate([(0.5, 0.5, 6), (0.0, 0.0, 12), (0.5, 0.5, 18), (3.0, 0.5, 6), (0.5, 0.5, 99)])],
                                   "k int, case_id long, lon double, lat double, ts timestamp")
    got = {r.k: (r.status, r.u) for r in sel.space_time_sample(points, cells, axes, frames, "k", 0).collect()}
    assert got == {0: ("ok", 5.5), 1: ("ok", 10.0), 2: ("missing", None), 3: ("outside", None), 4: ("forcing_exhausted", None)}


def test_points_are_ranked_in_their_tile(spark):
    """P16 by brute force: chunks of cases, groups of points, ids and keys that repeat, unknown times, the date line; no window over pairs."""
    rng = random.Random(16)
    span = lambda: sorted(T0 + timedelta(days=rng.randrange(20)) for _ in range(2))
    cases = []
    for k in range(60):
        west, south = rng.randrange(-180, 180, 5), rng.randrange(-60, 50, 5)
        cases.append((f"c{k % 50}", float(west), float((west + rng.choice([12, 200, 340]) + 180) % 360 - 180), float(south), float(south + 35), *span()))
    cases.append(("c3", -180.0, 180.0, -90.0, 90.0, None, T0 + timedelta(days=9)))
    points = [(k, float(rng.randrange(-180, 180)), float(rng.randrange(-70, 70)), T0 + timedelta(days=rng.randrange(20)) if k % 11 else None) for k in range(150)]
    again = [(7, 10.0, 20.0, T0), (None, 10.0, 20.0, T0), (None, -170.0, 5.0, T0)]

    def brute(rows):
        pairs = {}
        for key, lon, lat, ts in rows:
            for name, west, east, south, north, start, end in cases:
                east += 360 if east < west else 0
                if not any(west <= lon + 360 * turn <= east for turn in (-1, 0, 1)) or not south <= lat <= north:
                    continue
                out = ts is not None and (start is not None and ts < start or end is not None and ts > end)
                overlap = False if out else None if None in (ts, start, end) else True
                pairs.setdefault(key, []).append(({True: 0, False: 1, None: 2}[overlap], name, overlap))
        return sorted(((str(key), name, str(overlap), rank) for key, found in pairs.items()
                       for rank, (_, name, overlap) in enumerate(sorted(found, key=lambda r: r[:2]), 1)))

    c = spark.createDataFrame(cases, "context_id string, west double, east double, south double, north double, time_start timestamp, time_end timestamp")
    p = spark.createDataFrame(points, "event_id long, lon double, lat double, ts timestamp")
    whole = sel.points_in_cases(p, c, "event_id")
    assert "Window" not in whole._jdf.queryExecution().executedPlan().toString()
    assert whole.schema.simpleString() == "struct<event_id:bigint,context_id:string,time_overlap:boolean,rank:int>"
    chunks = sel.points_in_cases(p.union(spark.createDataFrame(again, p.schema)), c, "event_id", 2, 3)
    for got, rows in ((whole, points), (chunks, points + again)):
        assert sorted((str(r.event_id), r.context_id, str(r.time_overlap), r["rank"]) for r in got.collect()) == brute(rows)
    assert sel.points_in_cases(p, c.filter("false"), "event_id").count() == 0


def test_pairs_of_alike_points_are_written_in_blocks(spark, tmp_path):
    """Points of one position and standing share their list of cases, so a written pair takes a fraction of a byte; three bytes before, when each point wrote its own."""
    points = spark.range(600).selectExpr("id AS event_id", "id % 2 + 1.5D AS lon", "2.0D AS lat", "timestamp_seconds(1704067200 + id) AS ts")
    cases = spark.range(3001).selectExpr("concat('ctx-', id) AS context_id", "0.0D AS west", "12.0D AS east", "0.0D AS south", "15.0D AS north",
                                         "timestamp_seconds(1704067200 + 300) AS time_start", "timestamp_seconds(1704067200 + 900) AS time_end")
    sel.points_in_cases(points, cases, "event_id").write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    each = got.groupBy("event_id", "time_overlap").agg({"rank": "min", "context_id": "approx_count_distinct"}).count()
    ordered = got.groupBy("context_id").agg({"rank": "max"}).sort("context_id").collect()
    assert (got.count(), each, [r[1] for r in ordered]) == (600 * 3001, 600, list(range(1, 3002)))
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.5 * 600 * 3001


def test_blocks_hold_each_pair_once():
    counts, pairs = np.array([1, 7, 8, 9, 600, 5, 3]), np.array([3, 0, 40000, 5, 129, 1, 20000])
    stand, first, size, low, deep = sel._blocks(counts, pairs)
    assert (size * deep).max() <= sel.CELLS and size[stand == 4].max() == sel.BROAD and set(size[size > 1] % 8) == {0}
    for k, (n, m) in enumerate(zip(counts, pairs)):
        seen = np.zeros((n, m), int)
        for b in np.flatnonzero(stand == k):
            seen[first[b]:first[b] + size[b], low[b]:low[b] + deep[b]] += 1
        assert (seen == 1).all()


def test_copies_of_points_are_ranked_in_their_tile(spark):
    """Points that repeat with their key, as the window ranks them, without a window over pairs; keys with several places still need one."""
    rng = random.Random(61)
    cases = [(f"c{k % 25}", float(w := rng.randrange(-20, 20, 5)), w + 12.0, float(s := rng.randrange(-20, 10, 5)), s + 15.0, T0 + timedelta(days=rng.randrange(9)), T0 + timedelta(days=9)) for k in range(30)]
    c = spark.createDataFrame(cases, "context_id string, west double, east double, south double, north double, time_start timestamp, time_end timestamp")
    points = [(k, float(rng.randrange(-20, 20)), float(rng.randrange(-20, 20)), T0 + timedelta(days=rng.randrange(12)) if k % 5 else None) for k in range(40)]
    schema = "event_id long, lon double, lat double, ts timestamp"
    copies, others = [p for p in points for _ in range(1 + p[0] % 4)], [(3, 1.0, 1.0, T0), (6, *points[6][1:3], T0 + timedelta(days=40)), (None, 1.0, 1.0, T0), (None, 1.0, 1.0, T0)]
    for rows, sizes in ((copies, ()), (copies, (3, 2)), (copies + others, (3, 2))):
        p = spark.createDataFrame(rows, schema)
        got = sel.points_in_cases(p, c, "event_id", *sizes)
        if not sizes:
            assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
        p.createOrReplaceTempView("p16_points")
        c.createOrReplaceTempView("p16_cases")
        want = spark.sql("""SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY time_overlap DESC, context_id) AS rank FROM (
            SELECT event_id, context_id, ts BETWEEN time_start AND time_end AS time_overlap FROM p16_points JOIN p16_cases ON lon BETWEEN west AND east AND lat BETWEEN south AND north)""")
        key = lambda r: (str(r.event_id), r["rank"], r.context_id, str(r.time_overlap))
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
