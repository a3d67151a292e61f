"""Station planning: lattice split, greedy selection, reconstruction and hold-out scores.

Designs run side by side under ``(case_id, design)``. A greedy round lowers each
candidate's distance to its nearest station by the newest one and takes the best
candidate of each design in one group-by.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinefield.functions.geo import EARTH_RADIUS_KM, haversine_km
from brinefield.operators.windows import split_row_number
from brinefield.runtime import cut, free

LATTICE = 6
GRADIENT_WEIGHT, DISTANCE_WEIGHT = 0.65, 0.35
DESIGN = ["case_id", "design"]
STATIONS = "array<struct<station:int,flat:bigint,lon:double,lat:double,prior:double,nearest_km:double>>"


@dataclass(frozen=True)
class Design:
    name: str
    strategy: str
    seed: int = 0


def on_lattice(axis: str, last: str, step: int = LATTICE) -> Column:
    """Every n-th index and the final one."""
    return (F.col(axis) % step == 0) | (F.col(axis) == F.col(last))


def lattice_split(field: DataFrame, sizes: DataFrame, step: int = LATTICE) -> DataFrame:
    """present cells marked as candidate or evaluation."""
    rows = field.filter(F.col("value").isNotNull()).join(sizes.select("case_id", (F.col("ny") - 1).alias("_y"), (F.col("nx") - 1).alias("_x"), "nx"), "case_id")
    both = on_lattice("iy", "_y", step) & on_lattice("ix", "_x", step)
    flat = (F.col("iy").cast("bigint") * F.col("nx") + F.col("ix")).alias("flat")
    return rows.select(*field.columns, flat, F.when(both, "candidate").otherwise("evaluation").alias("role"))


def grid_sizes(axes: DataFrame) -> DataFrame:
    return axes.groupBy("case_id").agg(F.count_if(F.col("axis") == "lat").alias("ny"), F.count_if(F.col("axis") == "lon").alias("nx"))


def seeded_key(seed: Column, ident: Column) -> Column:
    """F8: a fixed pseudo-random order of ids for a seed, chosen before any truth is read."""
    return F.md5(F.concat_ws(":", seed.cast("string"), ident.cast("string")))


def seeded_order(candidates: DataFrame, seed: int) -> DataFrame:
    """F8: place of every candidate in the seeded order, counted over sampled ranges of the key."""
    keyed = candidates.withColumn("_key", seeded_key(F.lit(seed), F.col("flat")))
    return split_row_number(keyed, ["case_id"], [F.col("_key"), F.col("flat")], "place").drop("_key")


def _pool_constants(candidates: DataFrame) -> DataFrame:
    """Per case: largest gradient, mean position and largest pairwise distance.

    Along a pair of latitude rows distance grows with the longitude gap, so only
    the end points of each row can form the diameter. Rows per case number at
    most the lattice's latitudes; no candidate pairs are formed.
    """
    rows = candidates.groupBy("case_id", "lat").agg(F.min("lon").alias("w"), F.max("lon").alias("e"))
    ends = rows.groupBy("case_id").agg(F.collect_list(F.struct("lat", "w", "e")).alias("_r"))

    def widest(a, b):
        return F.greatest(haversine_km(a["lat"], a["w"], b["lat"], b["e"]), haversine_km(a["lat"], a["e"], b["lat"], b["w"]))

    diameter = F.array_max(F.transform("_r", lambda a: F.array_max(F.transform("_r", lambda b: widest(a, b)))))
    means = candidates.groupBy("case_id").agg(F.max(F.coalesce("gradient", F.lit(0.0))).alias("_g"), F.avg("lon").alias("_mlon"), F.avg("lat").alias("_mlat"))
    return means.join(ends.select("case_id", F.greatest(diameter, F.lit(1e-15)).alias("_diameter")), "case_id")


def select_stations(candidates: DataFrame, designs: Sequence[Design], budget: int, spacing_km: float) -> DataFrame:
    """greedy selection of every design at once; a design may come out short.

    ``candidates(case_id, flat, lon, lat, value, gradient)``. Spacing is tested before
    scoring; scores equal to 12 digits tie, and ties take the lowest index. A candidate
    carries the distance to its nearest station. A round lowers it by the newest station,
    and only where the difference in latitude alone does not exceed it already; candidates
    that are chosen or too near never come back and leave the pool.
    """
    lat, lon = F.col("lat"), F.col("lon")
    listed = F.array(*[F.struct(F.lit(d.name).alias("design"), F.lit(d.strategy).alias("strategy"), F.lit(d.seed).alias("seed")) for d in designs])
    ready = (candidates.join(_pool_constants(candidates), "case_id")
             .withColumns({"_grad": F.coalesce("gradient", F.lit(0.0)) / F.greatest("_g", F.lit(1e-15)),
                           "_centre": haversine_km(lat, lon, F.col("_mlat"), F.col("_mlon"))})
             .select("case_id", "flat", "lon", "lat", "value", "_grad", "_centre", "_diameter", F.inline(listed)))
    order = F.when(F.col("strategy") == "random", seeded_key(F.col("seed"), F.col("flat"))).otherwise(F.lit(""))
    pool = cut(ready.withColumns({"_order": order, "_near": F.lit(None).cast("double")}))
    slots = cut(pool.select(*DESIGN).distinct())
    chosen = []
    for turn in range(budget):
        if chosen:
            newest = chosen[-1].select(*DESIGN, F.col("flat").alias("_f"), F.col("lon").alias("_x"), F.col("lat").alias("_y"))
            far = F.radians(F.abs(lat - F.col("_y"))) * EARTH_RADIUS_KM >= F.col("_near")
            lowered = F.when(far, F.col("_near")).otherwise(F.least("_near", haversine_km(lat, lon, F.col("_y"), F.col("_x"))))
            nearer = pool.join(newest, DESIGN).withColumn("_near", lowered).filter((F.col("_near") + 1e-10 >= spacing_km) & (F.col("flat") != F.col("_f")))
            before, pool = pool, cut(nearer.drop("_f", "_x", "_y"))
            free(before)
        apart = F.col("_near") / F.col("_diameter")
        first = F.when(F.col("strategy") == "gradient", F.col("_grad")).otherwise(-F.col("_centre"))
        later = F.when(F.col("strategy") == "gradient", GRADIENT_WEIGHT * F.col("_grad") + DISTANCE_WEIGHT * apart).otherwise(apart)
        score = F.when(F.col("strategy") == "random", F.lit(0.0)).otherwise(F.round(later if turn else first, 12))
        best = F.min_by(F.struct("flat", "lon", "lat", F.col("value").alias("prior"), F.col("_near").alias("nearest_km")), F.struct((-score).alias("s"), F.col("_order").alias("o"), "flat"))
        chosen.append(cut(pool.groupBy(*DESIGN).agg(best.alias("_b")).select(*DESIGN, F.lit(turn + 1).alias("station"), "_b.*")))
    placed = reduce(DataFrame.unionByName, chosen)
    stations = placed.groupBy(*DESIGN).agg(F.array_sort(F.collect_list(F.struct("station", "flat", "lon", "lat", "prior", "nearest_km"))).cast(STATIONS).alias("stations"))
    return slots.join(stations, DESIGN, "left").withColumn("fulfilled", F.coalesce(F.size("stations"), F.lit(0)) == budget)


def station_plan(chosen: DataFrame) -> DataFrame:
    """stations in order with the distance to the nearest earlier one."""
    return chosen.select(*DESIGN, "fulfilled", F.inline("stations"))


def reconstruct(targets: DataFrame, stations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """prior plus the inverse-distance-squared mean of station residuals at ``targets(keys, lat, lon, prior)``.

    ``stations(keys, station, lon, lat, residual)`` are the stations asked for, as rows.
    Weights are summed per target with map-side partial sums; an exact station (the first
    in order) gives its own residual. Targets without a station are left out.
    """
    keys = list(keys)
    own = targets.columns
    targets = targets.withColumn("_t", F.monotonically_increasing_id())
    marks = stations.select(*keys, F.col("station").alias("_s"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), F.col("residual").alias("_r"))
    pairs = targets.join(marks, keys).withColumn("_d", haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")))
    weight = F.lit(1.0) / (F.col("_d") * F.col("_d"))
    apart = F.col("_d") > 0
    summed = pairs.groupBy("_t", *own).agg(F.min(F.when(~apart, F.struct("_s", "_r"))).alias("_exact"), F.sum(F.when(apart, weight * F.col("_r"))).alias("_top"),
                                     F.sum(F.when(apart, weight)).alias("_bottom"))
    mean = F.when(F.col("_exact").isNotNull(), F.col("_exact")["_r"]).otherwise(F.col("_top") / F.col("_bottom"))
    return summed.select(*own, (F.col("prior") + mean).alias("reconstructed"))


def holdout_evaluation(chosen: DataFrame, evaluation: DataFrame, truth: DataFrame, frames: Sequence[int], budget: int) -> DataFrame:
    """scores of every design and of persistence at held-out frames.

    ``evaluation(case_id, flat, lat, lon, prior)`` are the non-lattice cells with a prior,
    ``truth(case_id, it, flat, value)`` the later fields. A run fails when its
    design is short, a station has no value, or no target is left.
    """
    later = truth.filter(F.col("it").isin(*frames) & F.col("value").isNotNull()).select("case_id", "it", "flat", F.col("value").alias("truth"))
    targets = evaluation.join(later, ["case_id", "flat"])
    counts = targets.groupBy("case_id", "it").agg(F.count("*").alias("evaluation_count"))
    plans = chosen.select(*DESIGN, F.coalesce(F.size("stations"), F.lit(0)).alias("planned"))
    slots = plans.withColumn("it", F.explode(F.array(*[F.lit(f) for f in frames])))
    placed = station_plan(chosen).select(*DESIGN, "station", "flat", "lon", "lat", "prior").withColumn("it", F.explode(F.array(*[F.lit(f) for f in frames])))
    seen = placed.join(later, ["case_id", "it", "flat"], "left").withColumn("residual", F.col("truth") - F.col("prior"))
    have = seen.groupBy(*DESIGN, "it").agg(F.count("truth").alias("observed"))
    runs = slots.join(have, [*DESIGN, "it"], "left").join(counts, ["case_id", "it"], "left").withColumn("evaluation_count", F.coalesce("evaluation_count", F.lit(0)))
    reason = (F.when(F.col("planned") != budget, "short_design").when(F.coalesce("observed", F.lit(0)) != F.col("planned"), "missing_station")
              .when(F.col("evaluation_count") == 0, "no_targets"))
    runs = runs.withColumn("reason", reason)
    good = runs.filter(F.col("reason").isNull()).select(*DESIGN, "it")
    spots = targets.join(good, ["case_id", "it"])
    predicted = reconstruct(spots, seen, [*DESIGN, "it"]).select(*DESIGN, "it", (F.col("reconstructed") - F.col("truth")).alias("_e"))
    still = targets.select("case_id", F.lit("persistence").alias("design"), "it", (F.col("prior") - F.col("truth")).alias("_e"))
    scores = predicted.unionByName(still).groupBy(*DESIGN, "it").agg(
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg(F.abs("_e")).alias("mae"), F.avg("_e").alias("bias"))
    base = counts.select("case_id", F.lit("persistence").alias("design"), "it", F.lit(0).alias("planned"), "evaluation_count", F.lit(None).cast("string").alias("reason"))
    every = runs.select(*DESIGN, "it", "planned", "evaluation_count", "reason").unionByName(base)
    return every.join(scores, [*DESIGN, "it"], "left").withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("failed"))


def strategy_summary(runs: DataFrame, *keys: str) -> DataFrame:
    """Successes, failures, and RMSE over successes only."""
    good = F.when(F.col("status") == "ok", F.col("rmse"))
    return runs.groupBy(*keys).agg(F.count(good).alias("successful_runs"), F.count_if(F.col("status") != "ok").alias("failed_runs"),
                                   F.avg(good).alias("mean_rmse"), F.min(good).alias("min_rmse"), F.max(good).alias("max_rmse"))
