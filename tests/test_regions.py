"""Components, labels, correspondence classes and gaps."""

import random
from datetime import datetime, timedelta


from brinefield.operators import components as cc
from brinefield.operators.axes import axis_index
from brinefield.operators import evolution as ev
from brinefield.operators import regions as rg
from brinefield.plans.region_runs import evolve

CELLS = "case_id long, it int, iz int, iy int, ix int, value double"


def brute_components(edges):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in parent if find(n) != n}


def test_components_match_union_find(spark):
    rng = random.Random(11)
    graphs = {0: [(k, k + 1) for k in range(40)], 1: [(0, k) for k in range(1, 60)], 2: [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]}
    rows = [(g, a, b) for g, edges in graphs.items() for a, b in edges]
    got = cc.components(spark.createDataFrame(rows, "g int, a long, b long"), ["g"]).collect()
    for g, edges in graphs.items():
        assert {r["node"]: r["root"] for r in got if r["g"] == g} == brute_components([e for e in edges if e[0] != e[1]])


def test_no_edges_give_no_components(spark):
    assert cc.components(spark.createDataFrame([], "g int, a long, b long"), ["g"]).count() == 0


def label_sets(spark, axes, values, rules, zmax=20.0):
    nz, ny, nx = len(values), len(values[0]), len(values[0][0])
    rows = [(0, 0, z, y, x, values[z][y][x]) for z in range(nz) for y in range(ny) for x in range(nx)]
    mask = rg.threshold_mask(spark.createDataFrame(rows, CELLS), axes, rules, 0.0, zmax)
    return {r["flat"]: r["label"] for r in rg.connected_regions(mask).collect()}


def test_labels_are_face_connected_and_inclusive(spark, make_axes):
    axes = make_axes([0, 20], [0, 1, 2], [0, 1, 2])
    top = [[5, 0, 5], [0, 5, 0], [5, None, 5]]
    low = [[5, 5, 0], [0, 5, 0], [0, 0, 0]]
    as_float = lambda p: [[None if v is None else float(v) for v in row] for row in p]
    got = label_sets(spark, axes, [as_float(top), as_float(low)], rg.thresholds("at_least", 5.0))
    assert got == {0: 0, 9: 0, 10: 0, 13: 0, 4: 0, 2: 2, 6: 6, 8: 8}
    assert set(label_sets(spark, axes, [as_float(top), as_float(low)], rg.thresholds("between", -1.0, 4.9))) == {1, 3, 5, 11, 12, 14, 15, 16, 17}
    assert set(label_sets(spark, axes, [as_float(top), as_float(low)], rg.thresholds("at_most", 0.0))) == {1, 3, 5, 11, 12, 14, 15, 16, 17}


def link_frame(spark, pairs):
    return spark.createDataFrame([(0, 0, 0, 1, s, t) for s, t in pairs], "case_id long, threshold_id int, it int, next_it int, source long, target long")


def test_whole_groups_are_classified(spark):
    pairs = [(1, 1), (2, 10), (2, 11), (3, 20), (4, 20), (5, 30), (6, 30), (6, 31), (0, 0)]
    got = {(r["source"], r["target"]): r["classification"] for r in ev.classify_links(link_frame(spark, pairs)).collect()}
    assert got == {(1, 1): "continuation", (0, 0): "continuation", (2, 10): "split", (2, 11): "split", (3, 20): "merge", (4, 20): "merge",
                   (5, 30): "ambiguous", (6, 30): "ambiguous", (6, 31): "ambiguous"}


def test_gap_and_unresolved_nodes(spark, make_axes):
    axes = make_axes([0, 10], [0, 1], [0, 1, 2, 3])
    frames = [[9, 9, 0, 9], [9, 0, 0, None], [9, 0, 0, 9]]
    rows = [(0, t, z, y, x, None if (v := frames[t][x]) is None else float(v)) for t in range(3) for z in (0, 1) for y in (0, 1) for x in range(4)]
    start = datetime(2024, 1, 7)
    times = spark.createDataFrame([(0, 0, start), (0, 1, start + timedelta(hours=12)), (0, 2, start + timedelta(hours=36))], "case_id long, it int, ts timestamp")
    e = evolve(spark.createDataFrame(rows, CELLS), axes, times, rg.thresholds("at_least", 9.0), 0.0, 10.0, 0.5)
    t = {r["it"]: r for r in e.transitions.collect()}
    assert (t[0]["status"], t[0]["link_count"], t[0]["unresolved_count"], t[0]["disappeared_count"]) == ("compared", 1, 1, 0)
    assert (t[1]["status"], t[1]["link_count"], t[1]["unresolved_count"]) == ("gap", 0, 3)
    alone = e.unmatched.collect()
    assert [(r["it"], r["label"], r["reason"], r["missing_cells"]) for r in alone] == [(0, 3, "incomplete_support", 4)]
    s = e.summary.first()
    assert (s["node_count"], s["gap_count"], s["link_count"], s["frame_count"]) == (5, 1, 1, 3)


def test_levels_match_union_find_in_blocks(spark):
    rng = random.Random(8)
    edges = [(g, rng.randrange(90), rng.randrange(90), rng.randrange(3)) for g in range(4) for _ in range(25 * g)]
    rows = spark.createDataFrame(edges, "g int, a long, b long, level int").repartition(3)
    for block in (1 << 16, 10):
        got = cc.nested_components(rows, ["g"], 3, block).collect()
        assert len(got) == len({(r["g"], r["level"], r["node"]) for r in got})
        for g in range(4):
            for t in range(3):
                want = brute_components([(a, b) for k, a, b, w in edges if k == g and w <= t and a != b])
                assert {r["node"]: r["root"] for r in got if (r["g"], r["level"]) == (g, t)} == want


def random_field(spark, make_axes, seed):
    rng = random.Random(seed)
    axes = make_axes([0, 10, 20, 30], list(range(9)), list(range(11)))
    smooth = [[[rng.random() * 4 + (z + y + x) % 5 for x in range(11)] for y in range(9)] for z in range(4)]
    rows = [(0, t, z, y, x, float(int(smooth[z][y][x] + t)) if rng.random() < 0.93 else None) for t in range(2) for z in range(4) for y in range(9) for x in range(11)]
    return axes, spark.createDataFrame(rows, CELLS), {(r[1], r[2], r[3], r[4]): r[5] for r in rows if r[5] is not None}


def flooded(values, low, high):
    """Labels by flooding from the smallest flat index."""
    inside = {k for k, v in values.items() if low <= v <= high}
    labels = {}
    for start in sorted(inside, key=lambda k: (k[0], (k[1] * 9 + k[2]) * 11 + k[3])):
        if start in labels:
            continue
        todo = [start]
        while todo:
            k = todo.pop()
            if k in labels or k not in inside:
                continue
            labels[k] = (start[1] * 9 + start[2]) * 11 + start[3]
            t, z, y, x = k
            todo += [(t, z + 1, y, x), (t, z - 1, y, x), (t, z, y + 1, x), (t, z, y - 1, x), (t, z, y, x + 1), (t, z, y, x - 1)]
    return labels


def test_nested_rules_label_as_each_alone(spark, make_axes):
    axes, cells, values = random_field(spark, make_axes, 2)
    rules = rg.thresholds("at_least", 4.0, offsets=(0.0, -1.0, 1.0, 2.0, 2.0))
    order = rg.nested_order(rules)
    assert [r["threshold_id"] for r in order] in ([3, 4, 2, 0, 1], [4, 3, 2, 0, 1])
    index = axis_index(axes)
    for block in (1 << 16, 25):
        got = rg.nested_regions(cells, index, order, 0.0, 30.0, block).collect()
        for rule in rules:
            own = {(r["it"], r["iz"], r["iy"], r["ix"]): r["label"] for r in got if r["threshold_id"] == rule["threshold_id"]}
            assert own == flooded(values, rule["low"], rule["high"])
    alone = rg.connected_regions(rg.threshold_mask(cells, index, rules, 0.0, 30.0), 25)
    assert sorted(map(tuple, alone.select(*rg.REGION, *rg.CELL).collect())) == sorted(map(tuple, rg.nested_regions(cells, index, order, 0.0, 30.0).select(*rg.REGION, *rg.CELL).collect()))
    assert rg.nested_regions(cells.filter("false"), index, order, 0.0, 30.0).count() == 0


def test_rules_that_do_not_nest(spark):
    assert rg.nested_order(rg.thresholds("between", 3.0, 5.0, offsets=(0.0, 1.0))) is None
    assert [r["threshold_id"] for r in rg.nested_order(rg.thresholds("at_most", 3.0, offsets=(1.0, 0.0)))] == [1, 0]


def test_contacts_look_at_all_neighbours(spark, make_axes):
    axes, cells, values = random_field(spark, make_axes, 5)
    labels = rg.connected_regions(rg.threshold_mask(cells, axis_index(axes), rg.thresholds("at_least", 5.0), 0.0, 30.0))
    got = {(r["it"], r["label"]): r for r in rg.region_contacts(labels, cells, axis_index(axes)).collect()}
    regions = {}
    for k, label in flooded(values, 5.0, float("inf")).items():
        regions.setdefault((k[0], label), []).append(k)
    assert set(got) == set(regions)
    for region, members in regions.items():
        near = [(t, z + a, y + b, x + c) for t, z, y, x in members for a, b, c in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]
        inside = [k for k in near if 0 <= k[1] < 4 and 0 <= k[2] < 9 and 0 <= k[3] < 11]
        assert got[region]["touches_missing"] == any(k not in values for k in inside)
        assert got[region]["shallow"] == any(k[1] == 0 for k in members) and got[region]["east"] == any(k[3] == 10 for k in members)
        assert got[region]["touches_boundary"] == (len(inside) < len(near))


def test_regions_store_no_water_columns(spark):
    """R3 reads cells alone; the second form of the field is stored when a query first asks for it, and is the same field."""
    from pathlib import Path

    from brinefield.registry import projections as pj
    from brinefield.registry import queries
    folder = "/root/testdata/sf0.001"
    pj._settled.clear()
    assert queries()["R3_rank_regions"](spark, folder).count() > 0
    inputs = pj.Inputs(spark, folder)
    assert not Path(inputs._field, "columns").exists()
    assert inputs.columns.selectExpr("explode(value) AS v").filter("v IS NOT NULL").count() == inputs.grid.filter("value IS NOT NULL").count()
    assert Path(inputs._field, "columns").exists()
