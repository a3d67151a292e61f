"""Trajectory operators. Tracks are rows ``(particle_id, elapsed_s, lon, lat)``.

One particle may hold a large share of all rows, so neighbours along a track
come from the chunked windows, never from a window over a whole particle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinefield.functions.geo import step_distance_km
from brinefield.operators.axes import Axis, axis_index, frame_index
from brinefield.operators.windows import ranged, split_lag, split_running_sum

ORDER = ["elapsed_s", "point_id"]
PREVIOUS = {"prev_s": "elapsed_s", "prev_lon": "lon", "prev_lat": "lat"}


def with_previous(tracks: DataFrame) -> DataFrame:
    """Add the previous point of the same particle."""
    return split_lag(tracks, ["particle_id"], ORDER, PREVIOUS)


def path_length(tracks: DataFrame) -> DataFrame:
    """Length of each step and of the path so far; the points are ranged and written once for both."""
    rows = ranged(tracks, ["particle_id"], ORDER, "_range")
    steps = split_lag(rows, ["particle_id"], ORDER, PREVIOUS, F.col("_range")).withColumn("step_km", F.coalesce(
        step_distance_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon")), F.lit(0.0)))
    return split_running_sum(steps, ["particle_id"], ORDER, "step_km", "path_km", F.col("_range")).drop("_range")


def resample_track(tracks: DataFrame, cadence_s: int) -> DataFrame:
    """Points on multiples of the cadence, and each particle's last point."""
    last = tracks.groupBy("particle_id").agg(F.max(F.struct("elapsed_s", "point_id")).alias("_end"))
    at = F.struct("elapsed_s", "point_id")
    return tracks.join(last, "particle_id").filter((F.col("elapsed_s") % cadence_s == 0) | (at == F.col("_end"))).drop("_end")


def entry_fraction(box: tuple[float, float, float, float]) -> Column:
    """First fraction of the step that meets a closed rectangle; null if none (parametric line clipping)."""
    low, high, misses = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for a, b, lo, hi in (("prev_lon", "lon", box[0], box[2]), ("prev_lat", "lat", box[1], box[3])):
        delta = F.col(b) - F.col(a)
        still = delta == 0
        t1, t2 = (F.lit(lo) - F.col(a)) / F.when(~still, delta), (F.lit(hi) - F.col(a)) / F.when(~still, delta)
        low.append(F.coalesce(F.least(t1, t2), F.lit(0.0)))
        high.append(F.coalesce(F.greatest(t1, t2), F.lit(1.0)))
        misses = misses | (still & ~F.col(a).between(lo, hi))
    first = F.greatest(*low)
    return F.when(~misses & (first <= F.least(*high)), first)


def target_entry(tracks: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Earliest entry time of each particle, linear within the step; a start inside counts as 0."""
    west, south, east, north = box
    rows = with_previous(tracks)
    inside = F.col("lon").between(west, east) & F.col("lat").between(south, north)
    at = (F.when(F.col("prev_s").isNull(), F.when(inside, F.lit(0.0)))
          .otherwise(F.col("prev_s") + (F.col("elapsed_s") - F.col("prev_s")) * entry_fraction(box)))
    return rows.groupBy("particle_id").agg(F.min(at).alias("entry_s"))


def interpolation_cells(grid: DataFrame, iz: int) -> DataFrame:
    """Cells of one level whose four corners hold both velocity parts, as ``(case_id, it, cy, cx)``."""
    wet = grid.filter((F.col("iz") == iz) & F.col("u").isNotNull() & F.col("v").isNotNull())
    corners = F.array(*[F.struct((F.col("iy") - b).alias("cy"), (F.col("ix") - a).alias("cx")) for b in (0, 1) for a in (0, 1)])
    return wet.select("case_id", "it", F.inline(corners)).groupBy("case_id", "it", "cy", "cx").agg(F.count("*").alias("n")).filter("n = 4").drop("n")


def segment_support(segments: DataFrame, grid: DataFrame, index: DataFrame, frames: DataFrame, iz: int, key: str) -> DataFrame:
    """Whether every interpolation cell in the endpoints' rectangle has data over the time bracket.

    ``segments(key, case_id, t0, t1, lon0, lat0, lon1, lat1)`` with times in seconds. A
    step spans a few cells; the needed cells explode and meet the wet cells by key.
    """
    lon, lat, time = Axis("lon"), Axis("lat"), Axis("time")
    s = segments.join(axis_index(index, ["lat", "lon"]), "case_id").join(frame_index(frames), "case_id")
    s = s.withColumns({"_x0": lon.cell_index("lon0"), "_x1": lon.cell_index("lon1"), "_y0": lat.cell_index("lat0"),
                       "_y1": lat.cell_index("lat1"), "_k0": time.floor_index("t0"), "_k1": time.ceil_index("t1")})
    def span(a, b):
        return F.sequence(F.least(a, b), F.greatest(a, b))
    need = (s.select(key, "case_id", F.explode(span("_k0", "_k1")).alias("it"), "_x0", "_x1", "_y0", "_y1")
            .withColumn("cy", F.explode(span("_y0", "_y1"))).withColumn("cx", F.explode(span("_x0", "_x1"))))
    wet = interpolation_cells(grid, iz).withColumn("_wet", F.lit(1))
    return (need.join(wet, ["case_id", "it", "cy", "cx"], "left").groupBy(key)
            .agg(F.count("*").alias("cells_needed"), F.count("_wet").alias("cells_wet"))
            .withColumn("supported", F.col("cells_needed") == F.col("cells_wet")))


def run_summary(particles: DataFrame) -> DataFrame:
    """Status counts, arrivals over all releases, and mean path length of valid releases."""
    valid = F.col("status") != "invalid_release"
    return particles.groupBy("run_id").agg(
        F.count("*").alias("released"), F.count_if(valid).alias("valid_releases"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "invalid_release", "left_domain", "missing_velocity")],
        F.count("arrival_s").alias("arrived"), (F.count("arrival_s") / F.count("*")).alias("arrival_fraction"),
        F.min("arrival_s").alias("earliest_arrival_s"), F.max("arrival_s").alias("latest_arrival_s"),
        F.avg(F.when(valid, F.col("distance_km"))).alias("mean_distance_km"))


# The 32-bit linear congruential generator of the release points.
LCG_A, LCG_C, LCG_BITS = 1664525, 1013904223, 32


def _mul32(high: Column, low: Column, state: Column) -> Column:
    """(high * 2**16 + low) * state mod 2**32 without leaving 63-bit integers."""
    return (high * state % F.lit(1 << 16) * F.lit(1 << 16) + low * state) % F.lit(1 << LCG_BITS)


def seeded_points(releases: DataFrame) -> DataFrame:
    """uniform points of each ``(release_id, seed, count, west, south, east, north)`` box, two draws per point.

    Draws come by jump-ahead: advancing 2**k steps is again a linear map, and the
    set bits of a step number select which maps apply, so every point is computed
    on its own row and no sequence is folded in one task.
    """
    points = releases.withColumn("point", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("count").cast("bigint"))))
    maps, a, c = [], LCG_A, LCG_C
    for _ in range(LCG_BITS):
        maps.append(F.struct(F.lit(a >> 16).cast("bigint").alias("h"), F.lit(a & 0xFFFF).cast("bigint").alias("l"), F.lit(c).cast("bigint").alias("c")))
        a, c = (a * a) % (1 << LCG_BITS), (a * c + c) % (1 << LCG_BITS)
    step = F.col("point") * 2 - 1
    jumps = F.filter(F.array(*maps), lambda m, bit: (step / F.pow(F.lit(2.0), bit)).cast("bigint") % 2 == 1)
    points = points.withColumn("_sx", F.aggregate(jumps, F.col("seed").cast("bigint"), lambda s, m: (_mul32(m["h"], m["l"], s) + m["c"]) % F.lit(1 << LCG_BITS)))
    points = points.withColumn("_sy", (_mul32(F.lit(LCG_A >> 16), F.lit(LCG_A & 0xFFFF), F.col("_sx")) + F.lit(LCG_C)) % F.lit(1 << LCG_BITS))

    def unit(s):
        return (F.col(s) + 0.5) / F.lit(4294967296.0)
    return points.select("release_id", "point", (unit("_sx") * (F.col("east") - F.col("west")) + F.col("west")).alias("lon"),
                         (unit("_sy") * (F.col("north") - F.col("south")) + F.col("south")).alias("lat"))
