"""Gridded inputs: wire arrays, packed values, axis and frame checks, decimation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinefield.functions.scalars import finite
from brinefield.operators.axes import INDEX_OF

# Accepted axis units.
AXIS_UNITS = {"lat": ("degrees_north", "degree_north"), "lon": ("degrees_east", "degree_east"), "depth": ("m", "metre", "meter")}
AXIS_BOUNDS = {"lat": (-90.0, 90.0), "lon": (-180.0, 360.0), "depth": (0.0, 12000.0)}


def explode_field(arrays: DataFrame, *keys: str) -> DataFrame:
    """Flat depth-latitude-longitude arrays to cells; a wrong element count yields no cells, non-finite is null."""
    ny, nx = F.col("ny"), F.col("nx")
    good = arrays.filter(F.size("values") == F.col("nz") * ny * nx)
    rows = good.select(*keys, "ny", "nx", F.posexplode("values").alias("pos", "raw"))
    return rows.select(*keys, F.floor(F.col("pos") / (ny * nx)).cast("int").alias("iz"), (F.floor(F.col("pos") / nx) % ny).cast("int").alias("iy"),
                       (F.col("pos") % nx).cast("int").alias("ix"), finite(F.col("raw")).alias("value"))


def field_shape_check(arrays: DataFrame, *keys: str) -> DataFrame:
    """Arrays whose element count disagrees with their shape."""
    return arrays.filter(F.size("values") != F.col("nz") * F.col("ny") * F.col("nx")).select(*keys, F.size("values").alias("found"),
                                                                                             (F.col("nz") * F.col("ny") * F.col("nx")).alias("expected"))


def block_problems(blocks: DataFrame, *keys: str) -> DataFrame:
    """Where the blocks of a frame do not follow one another from 0 to its end: ``(keys, offset, problem)``.

    ``blocks(keys, nz, ny, nx, offset, values)`` hold a frame in pieces of any size. The
    window runs over a frame's block bounds, not its values.
    """
    along = Window.partitionBy(*keys).orderBy("offset", "_stop")
    bounds = blocks.select(*keys, (F.col("nz").cast("bigint") * F.col("ny") * F.col("nx")).alias("_all"), F.col("offset").cast("bigint").alias("offset"), (F.col("offset") + F.size("values")).alias("_stop"))
    before = F.coalesce(F.max("_stop").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.lead("offset").over(along).isNull()
    seen = bounds.select(*keys, "offset", F.array_compact(F.array(
        F.when(F.col("offset") > before, "missing_before"), F.when(F.col("offset") < before, "overlapping"), F.when(F.col("_stop") > F.col("_all"), "beyond_frame"),
        F.when(last & (F.greatest(F.col("_stop"), before) < F.col("_all")), "missing_after"))).alias("_p"))
    return seen.select(*keys, "offset", F.explode("_p").alias("problem"))


def explode_blocks(blocks: DataFrame, *keys: str) -> DataFrame:
    """Cells of the frames whose blocks are complete; no row ever holds a frame. Frames with a problem yield no cells."""
    ny, nx = F.col("ny"), F.col("nx")
    refused = block_problems(blocks, *keys).select(*keys).distinct()
    rows = blocks.join(refused, list(keys), "left_anti").select(*keys, "ny", "nx", "offset", F.posexplode("values").alias("_k", "raw")).withColumn("pos", F.col("offset") + F.col("_k"))
    return rows.select(*keys, F.floor(F.col("pos") / (ny * nx)).cast("int").alias("iz"), (F.floor(F.col("pos") / nx) % ny).cast("int").alias("iy"),
                       (F.col("pos") % nx).cast("int").alias("ix"), finite(F.col("raw")).alias("value"))


def cf_decode(packed: DataFrame, attrs: DataFrame) -> DataFrame:
    """Mask in packed space, then scale and offset once in float64.

    ``attrs(variable, fill_value, missing_value, valid_min, valid_max, scale_factor, add_offset)``;
    null attributes do not apply. A zero or non-finite scale gives status ``invalid_packing``.
    """
    p = F.col("packed").cast("double")
    rows = packed.join(attrs, "variable", "left")
    scale, offset = F.coalesce("scale_factor", F.lit(1.0)), F.coalesce("add_offset", F.lit(0.0))
    def no(c):
        return F.coalesce(c, F.lit(False))
    masked = finite(p).isNull() | no(p == F.col("fill_value")) | no(p == F.col("missing_value")) | no(p < F.col("valid_min")) | no(p > F.col("valid_max"))
    usable = finite(scale).isNotNull() & (scale != 0) & finite(offset).isNotNull()
    return rows.select(*packed.columns, F.when(usable & ~masked, p * scale + offset).alias("value"),
                       F.when(~usable, "invalid_packing").when(masked, "masked").otherwise("ok").alias("status"))


def check_grid(axes: DataFrame, variables: DataFrame, allowed: DataFrame) -> DataFrame:
    """One row per case and named check on its axes and variables.

    ``axes(case_id, axis, idx, coord, units)``, ``variables(case_id, variable, standard_name, units, axes_key)``,
    ``allowed(variable, standard_name, units)``.
    """
    before = F.lag("coord").over(_along())
    marked = axes.withColumn("_up", F.coalesce(F.col("coord") > before, F.lit(True)))
    checks = []
    for axis, units in AXIS_UNITS.items():
        here = F.col("axis") == axis
        low, high = AXIS_BOUNDS[axis]
        c = F.when(here, F.col("coord"))
        checks += [(f"{axis} present", F.count_if(here) > 0), (f"{axis} finite", F.count_if(here & finite(F.col("coord")).isNull()) == 0),
                   (f"{axis} unique", F.count_distinct(c) == F.count_if(here)), (f"{axis} strictly increasing", F.count_if(here & ~F.col("_up")) == 0),
                   (f"{axis} units", F.count_if(here & ~F.coalesce(F.col("units").isin(*units), F.lit(False))) == 0),
                   (f"{axis} bounds", F.count_if(here & ~F.coalesce(F.col("coord").between(low, high), F.lit(False))) == 0)]
    wide = marked.groupBy("case_id").agg(*[v.alias(n) for n, v in checks])
    axis_rows = wide.select("case_id", F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("passed")) for n, _ in checks])))
    known = variables.join(allowed.withColumn("_ok", F.lit(True)), ["variable", "standard_name", "units"], "left")
    var_rows = known.select("case_id", F.concat(F.col("variable"), F.lit(" definition and units")).alias("check"), F.coalesce("_ok", F.lit(False)).alias("passed"))
    shared = variables.groupBy("case_id").agg((F.count_distinct("axes_key") == 1).alias("passed")).select("case_id", F.lit("variables share axes").alias("check"), "passed")
    return axis_rows.unionByName(var_rows).unionByName(shared)


def _along():
    from pyspark.sql import Window
    return Window.partitionBy("case_id", "axis").orderBy("idx")


def check_frames(frame_axes: DataFrame, declared: DataFrame, frame_times: DataFrame) -> DataFrame:
    """Frames whose coordinates differ from frame 0 or whose time differs from the declared one.

    ``frame_axes(case_id, it, axis, idx, coord)``; each frame meets frame 0 on the axis position.
    """
    first = frame_axes.filter("it = 0").select("case_id", "axis", "idx", F.col("coord").alias("c0"))
    frames = frame_axes.select("case_id", "it").distinct()
    expected = frames.join(first, "case_id")
    both = expected.join(frame_axes, ["case_id", "it", "axis", "idx"], "full")
    bad = both.groupBy("case_id", "it").agg(F.count_if(~F.col("c0").eqNullSafe(F.col("coord"))).alias("coordinate_differences"))
    times = declared.select("case_id", "it", F.col("ts").alias("_d")).join(frame_times.select("case_id", "it", F.col("ts").alias("_t")), ["case_id", "it"], "full")
    clocks = times.select("case_id", "it", F.col("_d").eqNullSafe(F.col("_t")).alias("time_matches"))
    return bad.join(clocks, ["case_id", "it"], "full").withColumn("passed", (F.coalesce("coordinate_differences", F.lit(0)) == 0) & F.coalesce("time_matches", F.lit(False)))


def field_stats(cells: DataFrame, sizes: DataFrame, *keys: str) -> DataFrame:
    """Min, max, valid and missing counts; absent cells count as missing.

    ``sizes(case_id, cells)`` holds the lattice size, so the lattice itself is never built.
    """
    stats = cells.groupBy("case_id", *keys).agg(F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("valid"))
    return stats.join(sizes, "case_id").select("case_id", *keys, "min", "max", "valid", (F.col("cells") - F.col("valid")).alias("missing"))


def lattice_size(axes: DataFrame) -> DataFrame:
    n = [F.count_if(F.col("axis") == a) for a in ("depth", "lat", "lon")]
    return axes.groupBy("case_id").agg((n[0] * n[1] * n[2]).alias("cells"))


def decimate(cells: DataFrame, axes: DataFrame, step: int) -> DataFrame:
    """Every n-th horizontal index and the last, as float32."""
    ends = axes.groupBy("case_id").agg(F.max(F.when(F.col("axis") == "lat", F.col("idx"))).alias("_y"), F.max(F.when(F.col("axis") == "lon", F.col("idx"))).alias("_x"))
    def keep(c, last):
        return (F.col(c) % step == 0) | (F.col(c) == F.col(last))
    return cells.join(ends, "case_id").filter(keep("iy", "_y") & keep("ix", "_x")).select(*cells.columns, F.col("value").cast("float").alias("display"))


def rounding_error(decimated: DataFrame, *keys: str) -> DataFrame:
    """Largest absolute float32 rounding error."""
    return decimated.groupBy(*keys).agg(F.coalesce(F.max(F.abs(F.col("display").cast("double") - F.col("value"))), F.lit(0.0)).alias("max_error"))


def linspace_indices(axes: DataFrame, limits: dict[str, int]) -> DataFrame:
    """At most k evenly spaced indices per axis, rounded half to even, unique."""
    out = None
    for axis, k in limits.items():
        n = axes.filter(F.col("axis") == axis).groupBy("case_id").agg(F.count("*").cast("int").alias("n"))
        m = F.least(F.col("n"), F.lit(k))
        step = (F.col("n") - 1) / F.greatest(m - 1, F.lit(1))
        picks = F.array_distinct(F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.rint(j * step).cast("int")))
        part = n.select("case_id", F.lit(axis).alias("axis"), F.explode(picks).alias("idx"))
        out = part if out is None else out.unionByName(part)
    return out


def linspace_decimate(cells: DataFrame, axes: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Cells on the evenly spaced indices."""
    picks = linspace_indices(axes, limits)
    out = cells
    for axis in limits:
        keep = picks.filter(F.col("axis") == axis).select("case_id", F.col("idx").alias(INDEX_OF[axis]))
        out = out.join(keep, ["case_id", INDEX_OF[axis]], "left_semi")
    return out
