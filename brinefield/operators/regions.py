"""Threshold regions: labels, statistics, faces, sections and observation support.

Labels are rows ``(case_id, threshold_id, it, iz, iy, ix, flat, value, volume, label)``.
All frames, cases and thresholds run together under the key columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinefield.functions.digest import multiset_digest
from brinefield.functions.geo import haversine_km
from brinefield.operators.axes import Axis, AxisText, axis_index, barrier, cell_volume, flat_index, grid_geometry
from brinefield.operators.collocate import nearest_column
from brinefield.operators.components import BLOCK, nested_components
from brinefield.operators.windows import split_row_number
from brinefield.runtime import cut
from brinefield.sources.fields import column_packed

KEYS = ["case_id", "threshold_id", "it"]
REGION = [*KEYS, "label"]
CELL = ["iz", "iy", "ix"]


def thresholds(operator: str, threshold: float, upper: float | None = None, offsets: Sequence[float] = (0.0,)) -> list[dict]:
    """The base threshold shifted by each offset; both bounds of an interval shift."""
    if operator not in ("at_least", "at_most", "between"):
        raise ValueError(f"unknown operator {operator}")
    low, high = float("-inf"), float("inf")
    out = []
    for k, offset in enumerate(offsets):
        bounds = {"at_least": (threshold + offset, high), "at_most": (low, threshold + offset),
                  "between": (threshold + offset, (upper if upper is not None else threshold) + offset)}[operator]
        out.append({"threshold_id": k, "offset": float(offset), "low": float(bounds[0]), "high": float(bounds[1])})
    return out


def threshold_mask(cells: DataFrame, index: DataFrame, rules: Sequence[dict], depth_min: float, depth_max: float) -> DataFrame:
    """Cells inside each rule's inclusive bounds and the depth window, with flat index and volume."""
    geometry = grid_geometry(axis_index(index), depth_min, depth_max)
    rule = F.array(*[F.struct(F.lit(r["threshold_id"]).alias("threshold_id"), F.lit(r["low"]).alias("_lo"), F.lit(r["high"]).alias("_hi")) for r in rules])
    widest = (min(r["low"] for r in rules), max(r["high"] for r in rules))
    rows = (cells.filter(F.col("value").isNotNull() & F.col("value").between(*widest)).select("*", F.inline(rule))
            .filter(F.col("value").between(F.col("_lo"), F.col("_hi"))).join(geometry, "case_id"))
    centre = Axis("depth").at(F.col("iz"))
    return (rows.filter(centre.between(depth_min, depth_max))
            .select(*KEYS, *CELL, flat_index().alias("flat"), "value", cell_volume().alias("volume"))
            .filter(F.col("volume") > 0))


def _runs(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells with the first flat index of their run: neighbours along x that share a level. The one window over cells, one grid line a partition."""
    along = Window.partitionBy(*keys, "iz", "iy").orderBy("ix")
    starts = F.coalesce((F.col("ix") - F.lag("ix").over(along) != 1) | (F.lag("level").over(along) != F.col("level")), F.lit(True))
    run = F.last(F.when(F.col("_starts"), F.col("flat")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    return cells.withColumn("_starts", starts).withColumn("run", run).drop("_starts")


def run_edges(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges ``(keys, a, b, level)`` between runs ``(keys, iz, iy, x0, x1, run, level)`` that share a face; the level is the higher of the two.

    A sweep over the ends of runs: the runs of two neighbouring grid lines are sorted by
    x0, and each can only meet the last run of the other line that begins at or before it,
    because the runs of one line do not overlap. A line stands in four such pairs.
    """
    pairs = "inline(array({}))".format(", ".join(
        f"named_struct('_axis', {axis}, '_z', iz - {z}, '_y', iy - {y}, '_side', {side})" for axis, side, z, y in ((0, 0, 0, 0), (0, 1, 0, 1), (1, 0, 0, 0), (1, 1, 1, 0))))
    rows = runs.selectExpr(*keys, "x0", "x1", "run", "level", "iz", "iy", pairs)
    pair = Window.partitionBy(*keys, "_axis", "_z", "_y").orderBy("x0", "_side")
    so_far = pair.rowsBetween(Window.unboundedPreceding, -1)
    last = {side: F.last(F.when(F.col("_side") == side, F.struct("x1", "run", "level")), ignorenulls=True).over(so_far).alias(f"_last{side}") for side in (0, 1)}
    seen = rows.select(*keys, "x0", "run", "level", "_axis", "_side", *last.values())
    other = "CASE WHEN _side = 0 THEN _last1 ELSE _last0 END"
    touch = [f"CASE WHEN ({other}).x1 >= x0 THEN {other} END", "CASE WHEN _axis = 0 AND _side = 0 AND _last0.x1 = x0 - 1 THEN _last0 END"]
    return (seen.selectExpr(*keys, "run", "level", f"explode(array({', '.join(touch)})) AS _met").filter("_met IS NOT NULL")
            .selectExpr(*keys, "run AS a", "_met.run AS b", "greatest(level, _met.level) AS level"))


def _labelled(cells: DataFrame, keys: Sequence[str], levels: int, block: int) -> DataFrame:
    """Cells ``(keys, iz, iy, ix, flat, level, ...)`` once per level from their own upwards, each with the label it has there."""
    keys = list(keys)
    rows = cut(_runs(cells, keys))
    runs = rows.groupBy(*keys, "iz", "iy", "run", "level").agg(F.min("ix").alias("x0"), F.max("ix").alias("x1"))
    roots = nested_components(run_edges(runs, keys), keys, levels, block).select(*keys, "level", F.col("node").alias("run"), "root")
    spread = rows.withColumn("level", F.explode(F.sequence("level", F.lit(levels - 1)))) if levels > 1 else rows
    return spread.join(roots, [*keys, "level", "run"], "left").withColumn("label", F.coalesce("root", "run")).drop("run", "root")


def connected_regions(mask: DataFrame, block: int = BLOCK) -> DataFrame:
    """R2: six-neighbour regions; the label is the smallest flat index.

    Cells fold to runs along x, and all that follows is about runs. Runs that share a face
    merge within blocks of flat indices first; what crosses blocks enters the component rounds.
    """
    return _labelled(mask.withColumn("level", F.lit(0)), KEYS, 1, block).drop("level")


def nested_order(rules: Sequence[dict]) -> list[dict] | None:
    """The rules from the strictest to the loosest if each lies within the next, else None."""
    order = sorted(rules, key=lambda r: (-r["low"], r["high"]))
    inside = all(b["low"] <= a["low"] and a["high"] <= b["high"] for a, b in zip(order, order[1:]))
    return order if inside else None


def nested_regions(cells: DataFrame, index: DataFrame, order: Sequence[dict], depth_min: float, depth_max: float, block: int = BLOCK) -> DataFrame:
    """Regions of nested rules, strictest first, as ``connected_regions`` of each would label them.

    A cell enters once, with the strictest rule that it meets, and an edge counts from the
    looser one of its two runs on. So regions of a strict rule are merged upwards into those
    of the looser ones, and neither the mask nor the rounds multiply with the rules.
    """
    loosest = threshold_mask(cells, index, [order[-1]], depth_min, depth_max).drop("threshold_id")
    level = sum((~F.col("value").between(r["low"], r["high"])).cast("int") for r in order)
    ids = F.array(*[F.lit(r["threshold_id"]) for r in order])
    named = _labelled(loosest.withColumn("level", level), ["case_id", "it"], len(order), block)
    return named.withColumn("threshold_id", F.get(ids, F.col("level"))).select(*KEYS, *CELL, "flat", "value", "volume", "label")


def region_stats(labels: DataFrame, index: DataFrame) -> DataFrame:
    """A4: size, volume, bounds, value statistics and an order-free membership digest per region."""
    spans = [f(c).alias(f"{c}_{n}") for c in CELL for f, n in ((F.min, "lo"), (F.max, "hi"))]
    stats = labels.groupBy(*REGION).agg(
        F.count("*").alias("cell_count"), F.sum("volume").alias("volume_km3"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), (F.sum(F.col("value") * F.col("volume")) / F.sum("volume")).alias("volume_weighted_mean"),
        multiset_digest(F.col("flat").cast("string")).alias("membership"), *spans)
    geometry = grid_geometry(axis_index(index))
    bounds = {}
    for axis, c in (("depth", "iz"), ("lat", "iy"), ("lon", "ix")):
        a, e = Axis(axis), F.col(f"ed_{axis}")
        bounds |= {f"center_{axis}_min": a.at(F.col(f"{c}_lo")), f"center_{axis}_max": a.at(F.col(f"{c}_hi")),
                   f"cell_{axis}_min": F.get(e, F.col(f"{c}_lo")), f"cell_{axis}_max": F.get(e, F.col(f"{c}_hi") + 1)}
    kept = [c for c in stats.columns if c != "case_id"]
    return stats.join(geometry, "case_id").select("case_id", *kept, *[v.alias(k) for k, v in bounds.items()])


def rank_regions(regions: DataFrame, order: str = "volume", limit: int | None = None) -> DataFrame:
    """Regions of each frame in order, the first ``limit`` where one is asked for, with the full count kept beside them.

    With a limit the rank filter turns into a per-task group limit, so a frame with many
    regions ships only its leaders. Without one the ranks are counted over sampled ranges.
    """
    lead = {"volume": [], "observations": [F.col("eligible_samples").desc()]}[order]
    by = [*lead, F.col("volume_km3").desc(), F.col("label")]
    totals = regions.groupBy(*KEYS).agg(F.count("*").alias("total_regions"))
    if limit is None:
        return split_row_number(regions, KEYS, by, "rank").join(totals, KEYS)
    window = Window.partitionBy(*KEYS).orderBy(*by)
    return regions.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= limit).join(totals, KEYS)


def plan_footprint(labels: DataFrame) -> DataFrame:
    """Shallowest region of each column."""
    return labels.groupBy(*KEYS, "iy", "ix").agg(F.min_by("label", "iz").alias("label"))


def region_footprint(labels: DataFrame) -> DataFrame:
    """Columns under each region."""
    return labels.select(*REGION, "iy", "ix").distinct()


def exposed_faces(labels: DataFrame) -> DataFrame:
    """Unit faces between a member cell and a cell outside every region.

    A selected neighbour always shares the label, so the neighbour along a grid
    line is enough: one windowed pass per axis, no six-way explode.
    """
    out = None
    for axis, line in (("iz", ["iy", "ix"]), ("iy", ["iz", "ix"]), ("ix", ["iz", "iy"])):
        w = Window.partitionBy(*KEYS, *line).orderBy(axis)
        open_low = F.coalesce(F.lag(axis).over(w) != F.col(axis) - 1, F.lit(True))
        open_high = F.coalesce(F.lead(axis).over(w) != F.col(axis) + 1, F.lit(True))
        sides = F.array(F.struct(F.lit(-1).alias("side"), open_low.alias("_open")), F.struct(F.lit(1).alias("side"), open_high.alias("_open")))
        faces = (labels.withColumn("_sides", sides).select(*REGION, *CELL, F.lit(axis).alias("axis"), F.inline("_sides"))
                 .filter("_open").drop("_open"))
        out = faces if out is None else out.unionByName(faces)
    return out


def region_contacts(labels: DataFrame, field: DataFrame, index: DataFrame) -> DataFrame:
    """Domain sides a region touches, and whether it touches a missing neighbour.

    Starts from the regions' own columns (levels as one array, as long as the depth axis)
    and looks into the field's water columns there and at the four sides.
    """
    sizes = axis_index(index).selectExpr("case_id", "size(ax_depth) AS n_iz", "size(ax_lat) AS n_iy", "size(ax_lon) AS n_ix")
    feet = labels.groupBy(*REGION, "iy", "ix").agg(F.collect_list("iz").alias("_levels")).join(sizes, "case_id")
    sides = [("shallow", "exists(_levels, z -> z = 0)"), ("deep", "exists(_levels, z -> z = n_iz - 1)"), ("south", "iy = 0"), ("north", "iy = n_iy - 1"), ("west", "ix = 0"), ("east", "ix = n_ix - 1")]
    steps = ", ".join(f"named_struct('_y', iy + {y}, '_x', ix + {x}, '_own', {str(not (x or y)).lower()})" for y, x in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)))
    looks = feet.selectExpr("*", f"inline(filter(array({steps}), s -> s._y BETWEEN 0 AND n_iy - 1 AND s._x BETWEEN 0 AND n_ix - 1))")
    columns = column_packed(field).select("case_id", "it", F.col("iy").alias("_y"), F.col("ix").alias("_x"), F.col("value").alias("_column"))
    seen = looks.join(columns, ["case_id", "it", "_y", "_x"], "left")
    missing = ("CASE WHEN _own THEN exists(_levels, z -> (z > 0 AND get(_column, z - 1) IS NULL) OR (z < n_iz - 1 AND get(_column, z + 1) IS NULL)) "
               "ELSE exists(_levels, z -> get(_column, z) IS NULL) END")
    out = seen.groupBy(*REGION).agg(*[F.bool_or(F.expr(f"_own AND {test}")).alias(n) for n, test in sides], F.bool_or(F.expr(missing)).alias("touches_missing"))
    return out.withColumn("touches_boundary", F.expr(" OR ".join(n for n, _ in sides)))


def depth_selection_contacts(labels: DataFrame, index: DataFrame, depth_min: float, depth_max: float) -> DataFrame:
    """Regions touching the first or last selected level."""
    levels = grid_geometry(axis_index(index), depth_min, depth_max)
    usable = F.filter(F.sequence(F.lit(0), F.size("ax_depth") - 1),
                      lambda k: F.get("ax_depth", k).between(depth_min, depth_max) & (F.get("vf_depth", k) > 0))
    ends = levels.select("case_id", F.array_min(usable).alias("_first"), F.array_max(usable).alias("_last"))
    return labels.join(ends, "case_id").groupBy(*REGION).agg(
        F.bool_or(F.col("iz") == F.col("_first")).alias("touches_first"), F.bool_or(F.col("iz") == F.col("_last")).alias("touches_last"))


def stations_along(index: DataFrame, start: tuple[float, float], end: tuple[float, float], count: int, tie_km: float = 0.0) -> DataFrame:
    """Evenly spaced stations with nearest column, offset and cumulative distance (one small table per case)."""
    if start == end or count < 2:
        raise ValueError("a section needs two different ends and at least two stations")
    ix = axis_index(index)
    inside = F.lit(True)
    for x, y in (start, end):
        inside = inside & Axis("lon").covers(F.lit(float(x))) & Axis("lat").covers(F.lit(float(y)))
    k = F.col("station")

    def along(a, b):
        return F.when(k == count - 1, F.lit(float(b))).otherwise(F.lit(float(a)) + k * F.lit((b - a) / (count - 1)))

    points = (ix.filter(inside).withColumn("station", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
              .withColumns({"lon": along(start[0], end[0]), "lat": along(start[1], end[1])}))
    w = Window.partitionBy("case_id").orderBy("station")
    step = F.coalesce(haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    near = nearest_column(points, tie_km).withColumn("_step", step)
    return near.select("case_id", "station", "lon", "lat", "iy", "ix", F.col("distance_km").alias("offset_km"),
                       F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("along_km"),
                       Axis("lon").at(F.col("ix")).alias("model_lon"), Axis("lat").at(F.col("iy")).alias("model_lat"))


def section_sample(cells: DataFrame, labels: DataFrame, axes: DataFrame, stations: DataFrame, frame: int,
                   depth_min: float, depth_max: float, threshold_id: int = 0) -> DataFrame:
    """C14: native values and region labels at every station and selected level; missing stays null."""
    levels = axes.filter((F.col("axis") == "depth") & F.col("coord").between(depth_min, depth_max)).select(
        "case_id", F.col("idx").alias("iz"), F.col("coord").alias("depth"))
    spots = stations.join(levels, "case_id")
    values = cells.filter(F.col("it") == frame).select("case_id", *CELL, "value")
    marks = labels.filter((F.col("it") == frame) & (F.col("threshold_id") == threshold_id)).select("case_id", *CELL, "label")
    return spots.join(values, ["case_id", *CELL], "left").join(marks, ["case_id", *CELL], "left")


def survey_sample(cells: DataFrame, stations: DataFrame, frame: int, level: int) -> DataFrame:
    """One exact level along the stations, with the number of distinct columns visited."""
    values = cells.filter((F.col("it") == frame) & (F.col("iz") == level)).select("case_id", "iy", "ix", "value")
    unique = stations.select("case_id", "iy", "ix").distinct().groupBy("case_id").agg(F.count("*").alias("unique_columns"))
    return stations.join(values, ["case_id", "iy", "ix"], "left").join(unique, "case_id")


def section_observations(matches: DataFrame, stations: DataFrame, depth_min: float, depth_max: float, limit_km: float = 5.0) -> DataFrame:
    """Accepted samples whose nearest station is within the limit; stations travel as one array per case."""
    listed = stations.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("station", "lon", "lat"))).alias("_stations"))
    rows = matches.filter(F.col("accepted") & F.col("depth_m").between(depth_min, depth_max)).join(listed, "case_id")
    best = F.array_min(F.transform("_stations", lambda s: F.struct(
        haversine_km(F.col("latitude"), F.col("longitude"), s["lat"], s["lon"]).alias("d"), s["station"].alias("station"))))
    return (rows.withColumn("_best", best).filter(F.col("_best.d") <= limit_km)
            .select("case_id", "profile_id", "sample_index", "depth_m", "observed", F.col("_best.station").alias("station"),
                    F.col("_best.d").alias("distance_to_station_km")))


def depth_bin(z: str) -> str:
    """C17: midpoint bin of a depth; an exact midpoint goes deeper, the last bin is closed, -1 above the grid."""
    axis = AxisText("depth")
    low = axis.floor_index(z)
    mid = f"({axis.at(low)} + {axis.at(low + ' + 1')}) / 2"
    return f"cast(CASE WHEN {z} < {axis.first} THEN -1 WHEN {z} >= {mid} THEN {low} + 1 ELSE {low} END as int)"


def obs_to_region(matches: DataFrame, labels: DataFrame, index: DataFrame, depth_min: float, depth_max: float) -> DataFrame:
    """C17: every accepted sample that falls in a labelled cell, one row per (region, sample)."""
    rows = (matches.filter(F.col("accepted") & F.col("depth_m").between(depth_min, depth_max)).join(axis_index(index, ["depth"]), "case_id"))
    rows = barrier(rows, {"iz": depth_bin("depth_m")})
    rows = rows.filter(Axis("depth").at(F.col("iz")).between(depth_min, depth_max)).select(
        "case_id", "it", *CELL, "profile_id", "sample_index", "depth_m")
    return rows.join(labels.select(*REGION, *CELL), ["case_id", "it", *CELL])


def region_observations(linked: DataFrame) -> DataFrame:
    """C17: eligible samples per region and profile."""
    return linked.groupBy(*REGION, "profile_id").agg(F.count("*").alias("samples"))


def region_support(labels: DataFrame, linked: DataFrame, matches: DataFrame) -> DataFrame:
    """Supported and unsupported cells and columns of every region, with the accepted samples outside it."""
    size = labels.groupBy(*REGION).agg(F.count("*").alias("region_cells"))
    foot = region_footprint(labels).groupBy(*REGION).agg(F.count("*").alias("region_columns"))
    touched = linked.groupBy(*REGION, *CELL).agg(F.count("*").alias("n"))
    hit = touched.groupBy(*REGION).agg(F.sum("n").alias("eligible_samples"), F.count("*").alias("supported_cells"))
    columns = touched.select(*REGION, "iy", "ix").distinct().groupBy(*REGION).agg(F.count("*").alias("supported_columns"))
    people = linked.select(*REGION, "profile_id").distinct().groupBy(*REGION).agg(F.count("*").alias("eligible_profiles"))
    totals = matches.groupBy("case_id", "it").agg(F.count_if("accepted").alias("_ok"), F.count_if(~F.col("accepted")).alias("excluded_samples"))
    out = size.join(foot, REGION)
    for part in (hit, columns, people):
        out = out.join(part, REGION, "left")
    out = out.join(totals, ["case_id", "it"], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(*REGION, "region_cells", z("supported_cells").alias("supported_cells"),
                      (F.col("region_cells") - z("supported_cells")).alias("unsupported_cells"), z("eligible_samples").alias("eligible_samples"),
                      z("eligible_profiles").alias("eligible_profiles"), z("supported_columns").alias("supported_columns"),
                      (F.col("region_columns") - z("supported_columns")).alias("unsupported_columns"),
                      (z("_ok") - z("eligible_samples")).alias("accepted_outside"), z("excluded_samples").alias("excluded_samples"))
