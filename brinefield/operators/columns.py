"""Water-column diagnostics and horizontal gradients over long-form cells.

Missing cells are absent or null; a break in the level index is a missing level,
so no dense lattice is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinefield.functions.geo import haversine_km
from brinefield.operators.climate import axis_of

COLUMN = ["case_id", "it", "iy", "ix"]
REFERENCE_M = 10.0


def mixed_layer(cells: DataFrame, axes: DataFrame, threshold: float, absolute: bool = False) -> DataFrame:
    """First downward crossing of a change from the 10 m value, interpolated in its layer.

    Status: reference_unavailable, missing_support, crossing or no_crossing. A
    window partition is one column, so at most one row per level.
    """
    levels = axis_of(axes, "depth")
    bottom = levels.groupBy("case_id").agg(F.max("iz").alias("_bottom"))
    rows = cells.filter(F.col("value").isNotNull()).join(levels, ["case_id", "iz"]).filter(F.col("depth") >= REFERENCE_M)
    w = Window.partitionBy(*COLUMN).orderBy("iz")
    rows = rows.withColumns({"_pz": F.lag("iz").over(w), "_pd": F.lag("depth").over(w), "_pv": F.lag("value").over(w),
                             "_d0": F.first("depth").over(w), "_v0": F.first("value").over(w)})
    change, before = F.col("value") - F.col("_v0"), F.col("_pv") - F.col("_v0")
    size = F.abs(change) if absolute else change
    target = F.when(F.lit(absolute) & (change < 0), F.lit(-threshold)).otherwise(F.lit(threshold))
    broken, crossed = F.col("iz") != F.col("_pz") + 1, size >= threshold
    found = F.when(broken, F.struct(F.lit("missing_support").alias("status"), F.lit(None).cast("double").alias("depth_m"), F.col("_pd").alias("supported_to_m"))).when(
        crossed, F.struct(F.lit("crossing").alias("status"),
                          (F.col("_pd") + F.try_divide((F.col("depth") - F.col("_pd")) * (target - before), change - before)).alias("depth_m"),
                          F.col("depth").alias("supported_to_m")))
    below = F.col("_pz").isNotNull()
    out = (rows.groupBy(*COLUMN).agg(
        F.min_by("_v0", "iz").alias("reference_value"), F.min_by("_d0", "iz").alias("_top"),
        F.min_by(F.when(below, found), F.when(below & found.isNotNull(), F.col("iz"))).alias("_f"),
        F.max("iz").alias("_last"), F.max("depth").alias("_deep")))
    every = cells.select(*COLUMN).distinct().join(out, COLUMN, "left").join(bottom, "case_id")
    ok = F.coalesce(F.col("_top") == REFERENCE_M, F.lit(False))
    end = F.when(F.col("_last") == F.col("_bottom"), "no_crossing").otherwise("missing_support")
    return every.select(*COLUMN, F.when(ok, F.col("reference_value")).alias("reference_value"),
                        F.when(~ok, "reference_unavailable").otherwise(F.coalesce("_f.status", end)).alias("status"),
                        F.when(ok, F.col("_f.depth_m")).alias("depth_m"),
                        F.when(ok, F.coalesce("_f.supported_to_m", "_deep")).alias("supported_to_m"))


def layer_gradient(cells: DataFrame, axes: DataFrame) -> DataFrame:
    """Signed change per metre between adjacent levels, null if either is missing."""
    levels = axis_of(axes, "depth")
    step = Window.partitionBy("case_id").orderBy("iz")
    layers = levels.select("case_id", "iz", F.col("depth").alias("top_m"), F.lead("depth").over(step).alias("bottom_m")).filter("bottom_m is not null")
    w = Window.partitionBy(*COLUMN).orderBy("iz")
    below = F.when(F.lead("iz").over(w) == F.col("iz") + 1, F.lead("value").over(w))
    return (cells.withColumn("_below", below).join(layers, ["case_id", "iz"])
            .select(*COLUMN, "iz", "top_m", "bottom_m", ((F.col("_below") - F.col("value")) / (F.col("bottom_m") - F.col("top_m"))).alias("gradient")))


def column_integral(cells: DataFrame, axes: DataFrame, limit_m: float) -> DataFrame:
    """Trapezoid from the surface to an exact native level; every level must be present.

    The trapezoid is a weighted sum whose weights depend on the axis only, so it
    is one group-by with partial sums and needs no window over cells.
    """
    levels = axis_of(axes, "depth").filter(F.col("depth") <= limit_m)
    w = Window.partitionBy("case_id").orderBy("iz")
    z = F.col("depth")
    weight = (F.coalesce(F.lead("depth").over(w), z) - F.coalesce(F.lag("depth").over(w), z)) / 2
    all_levels = Window.partitionBy("case_id")
    weights = (levels.withColumns({"_w": weight, "_need": F.count("*").over(all_levels), "_end": F.max("depth").over(all_levels), "_top": F.min("depth").over(all_levels)})
               .filter((F.col("_end") == limit_m) & (F.col("_top") == 0)))
    sums = cells.join(weights, ["case_id", "iz"]).groupBy(*COLUMN).agg(
        F.sum(F.col("value") * F.col("_w")).alias("_s"), F.count("value").alias("_n"), F.max("_need").alias("_need"))
    ok = F.col("_n") == F.col("_need")
    return sums.select(*COLUMN, F.when(ok, F.col("_s")).alias("integral"), F.when(ok, "available").otherwise("missing_support").alias("status"))


def field_gradient(cells: DataFrame, axes: DataFrame) -> DataFrame:
    """Central (one-sided at the edge) change per kilometre on both axes; never across a missing cell."""
    lat, lon = axis_of(axes, "lat"), axis_of(axes, "lon")
    size = axes.groupBy("case_id").agg(F.count_if(F.col("axis") == "lat").alias("ny"), F.count_if(F.col("axis") == "lon").alias("nx"))
    rows = cells.filter(F.col("value").isNotNull()).join(lat, ["case_id", "iy"]).join(lon, ["case_id", "ix"]).join(size, "case_id")
    out = rows
    for axis, line, n, name in (("ix", ["iz", "iy"], "nx", "d_lon"), ("iy", ["iz", "ix"], "ny", "d_lat")):
        w = Window.partitionBy("case_id", "it", *line).orderBy(axis)
        here = F.struct("value", "lat", "lon")
        low = F.when(F.col(axis) == 0, here).when(F.lag(axis).over(w) == F.col(axis) - 1, F.lag(here).over(w))
        high = F.when(F.col(axis) == F.col(n) - 1, here).when(F.lead(axis).over(w) == F.col(axis) + 1, F.lead(here).over(w))
        out = out.withColumns({"_lo": low, "_hi": high})
        km = haversine_km(F.col("_lo.lat"), F.col("_lo.lon"), F.col("_hi.lat"), F.col("_hi.lon"))
        out = out.withColumn("_km", km).withColumn(name, F.when(F.col("_km") > 0, (F.col("_hi.value") - F.col("_lo.value")) / F.col("_km"))).drop("_lo", "_hi", "_km")
    magnitude = F.sqrt(F.col("d_lon") * F.col("d_lon") + F.col("d_lat") * F.col("d_lat"))
    return out.select("case_id", "it", "iz", "iy", "ix", "value", "lat", "lon", "d_lon", "d_lat", magnitude.alias("gradient"))
