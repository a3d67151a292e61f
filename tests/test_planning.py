"""Greedy selection, reconstruction and hold-out scores against brute force."""

import hashlib
import math

import numpy as np
import pytest

from brinefield.operators import columns as wc
from brinefield.operators import planning as pl

NY, NX, STEP, BUDGET, SPACING = 10, 13, 3, 5, 60.0
LAT, LON = [5 + 0.3 * y + 0.01 * y * y for y in range(NY)], [60 + 0.35 * x for x in range(NX)]


def km(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))


@pytest.fixture(scope="module")
def fields():
    rng = np.random.default_rng(4)
    prior, truth = rng.normal(20, 3, (NY, NX)).round(3), rng.normal(20, 3, (NY, NX)).round(3)
    prior[3, 3] = prior[0, 5] = truth[4, 4] = np.nan
    return prior, truth


@pytest.fixture(scope="module")
def frames(spark, make_axes, fields):
    rows = [(0, t, 0, y, x, None if np.isnan(f[y, x]) else float(f[y, x])) for t, f in enumerate(fields) for y in range(NY) for x in range(NX)]
    cells = spark.createDataFrame(rows, "case_id long, it int, iz int, iy int, ix int, value double")
    axes = make_axes([0, 10], LAT, LON)
    g = wc.field_gradient(cells.filter("it = 0"), axes).select("case_id", "iy", "ix", "value", "lat", "lon", "gradient")
    return cells, axes, pl.lattice_split(g, pl.grid_sizes(axes), STEP)


def lattice():
    return [(y, x) for y in range(NY) for x in range(NX) if (y % STEP == 0 or y == NY - 1) and (x % STEP == 0 or x == NX - 1)]


def gradient(f, y, x):
    out = []
    for dy, dx in ((0, 1), (1, 0)):
        lo, hi = (max(y - dy, 0), max(x - dx, 0)), (min(y + dy, NY - 1), min(x + dx, NX - 1))
        if np.isnan(f[lo]) or np.isnan(f[hi]):
            return None
        out.append((f[hi] - f[lo]) / km((LAT[lo[0]], LON[lo[1]]), (LAT[hi[0]], LON[hi[1]])))
    return math.hypot(*out)


def brute(prior, strategy, seed=0):
    pool = [(y, x) for y, x in lattice() if not np.isnan(prior[y, x])]
    at = {c: (LAT[c[0]], LON[c[1]]) for c in pool}
    grads = {c: gradient(prior, *c) or 0.0 for c in pool}
    top, wide = max(grads.values()), max(km(at[a], at[b]) for a in pool for b in pool)
    mid = (sum(v[0] for v in at.values()) / len(at), sum(v[1] for v in at.values()) / len(at))
    chosen = []
    while len(chosen) < BUDGET:
        near = {c: min((km(at[c], at[s]) for s in chosen), default=math.inf) for c in pool}
        free = [c for c in pool if c not in chosen and near[c] + 1e-10 >= SPACING]
        if not free:
            break
        flat = lambda c: c[0] * NX + c[1]
        if strategy == "random":
            pick = min(free, key=lambda c: (hashlib.md5(f"{seed}:{flat(c)}".encode()).hexdigest(), flat(c)))
        else:
            def score(c):
                if strategy == "gradient":
                    return grads[c] / top if not chosen else 0.65 * grads[c] / top + 0.35 * near[c] / wide
                return -km(at[c], mid) if not chosen else near[c] / wide
            pick = max(free, key=lambda c: (round(score(c), 12), -flat(c)))
        chosen.append(pick)
    return [c[0] * NX + c[1] for c in chosen]


DESIGNS = [pl.Design("selected", "gradient"), pl.Design("uniform", "coverage"), pl.Design("random-2", "random", 2)]


@pytest.fixture(scope="module")
def chosen(frames):
    pool = frames[2].filter("role = 'candidate'").select("case_id", "flat", "lon", "lat", "value", "gradient")
    return pl.select_stations(pool, DESIGNS, BUDGET, SPACING)


def test_selection_matches_brute_force(fields, chosen):
    got = {}
    for r in pl.station_plan(chosen).orderBy("station").collect():
        got.setdefault(r["design"], []).append(r["flat"])
    assert got == {"selected": brute(fields[0], "gradient"), "uniform": brute(fields[0], "coverage"), "random-2": brute(fields[0], "random", 2)}


def test_short_plans_are_reported(frames):
    pool = frames[2].filter("role = 'candidate'").select("case_id", "flat", "lon", "lat", "value", "gradient")
    row = pl.select_stations(pool, DESIGNS[1:2], BUDGET, 5000.0).first()
    assert not row["fulfilled"] and len(row["stations"]) == 1


def test_holdout_scores_match_brute_force(frames, fields, chosen):
    prior, truth = fields
    cells, _, rows = frames
    evaluation = rows.filter("role = 'evaluation'").selectExpr("case_id", "flat", "lat", "lon", "value AS prior")
    later = cells.selectExpr("case_id", "it", f"cast(iy * {NX} + ix as bigint) AS flat", "value")
    runs = {r["design"]: r for r in pl.holdout_evaluation(chosen, evaluation, later, [1], BUDGET).collect()}
    on = set(lattice())
    targets = [(y, x) for y in range(NY) for x in range(NX) if (y, x) not in on and not np.isnan(prior[y, x]) and not np.isnan(truth[y, x])]
    for name, strategy, seed in (("selected", "gradient", 0), ("uniform", "coverage", 0), ("random-2", "random", 2), ("persistence", None, 0)):
        stations = [divmod(f, NX) for f in brute(prior, strategy, seed)] if strategy else []
        run = runs[name]
        if any(np.isnan(truth[s]) for s in stations):
            assert run["reason"] == "missing_station" and run["rmse"] is None
            continue
        errors = []
        for y, x in targets:
            guess = prior[y, x]
            if stations:
                w = [1 / km((LAT[y], LON[x]), (LAT[a], LON[b])) ** 2 for a, b in stations]
                guess += sum(k * (truth[s] - prior[s]) for k, s in zip(w, stations)) / sum(w)
            errors.append(guess - truth[y, x])
        assert run["evaluation_count"] == len(targets)
        assert run["rmse"] == pytest.approx(math.sqrt(np.mean(np.square(errors)))) and run["bias"] == pytest.approx(np.mean(errors)) and run["mae"] == pytest.approx(np.mean(np.abs(errors)))


def test_exact_station_returns_its_residual(spark):
    targets = spark.createDataFrame([(0, 1.0, 2.0, 10.0), (0, 1.0, 3.0, 10.0)], "case_id long, lat double, lon double, prior double")
    stations = spark.createDataFrame([(0, 1, 2.0, 1.0, 5.0), (0, 2, 4.0, 1.0, 1.0)], "case_id long, station int, lon double, lat double, residual double")
    assert [r["reconstructed"] for r in pl.reconstruct(targets, stations, ["case_id"]).orderBy("lon").collect()] == [15.0, pytest.approx(13.0)]
