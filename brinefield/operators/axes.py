"""Axis tables as per-case lookup rows.

An axis table has one row per coordinate: ``(case_id, axis, idx, coord)``. Its
size is set by the grid, never by the number of cells or samples.
``axis_index`` folds it to one row per case with sorted coordinate arrays and a
uniform-bucket lookup, so bracketing a value costs a few array reads instead of
a range join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinefield.functions.geo import EARTH_RADIUS_M

AXES = ("depth", "lat", "lon")
INDEX_OF = {"depth": "iz", "lat": "iy", "lon": "ix"}


class AxisText:
    """SQL text over the ``ax_<name>`` columns that ``axis_index`` attaches."""

    def __init__(self, name: str):
        self.coords, self.steps = f"ax_{name}", f"ax_{name}_steps"
        self.size = f"size({self.coords})"
        self.first, self.last = self.at("0"), self.at(f"{self.size} - 1")

    def at(self, index: str) -> str:
        return f"get({self.coords}, cast({index} as int))"

    def covers(self, value: str) -> str:
        return f"({value} >= {self.first} AND {value} <= {self.last})"

    def floor_index(self, value: str) -> str:
        """Index of the last coordinate <= value, clamped to the axis: steps of falling powers of two, each taken if it stays at or below."""
        return f"aggregate({self.steps}, 0, (p, s) -> p + CASE WHEN get({self.coords}, p + s) <= {value} THEN s ELSE 0 END)"

    def ceil_index(self, value: str) -> str:
        """Index of the first coordinate >= value, clamped to the axis."""
        low = self.floor_index(value)
        return f"cast(least({self.size} - 1, CASE WHEN {self.at(low)} >= {value} THEN {low} ELSE {low} + 1 END) as int)"

    def cell_index(self, value: str) -> str:
        """Lower index of the interpolation cell holding value (last cell closed)."""
        return f"cast(least({self.floor_index(value)}, {self.size} - 2) as int)"

    def nearest_index(self, value: str) -> str:
        """Nearest coordinate, the lower one on a tie."""
        low = self.floor_index(value)
        high = f"least({low} + 1, {self.size} - 1)"
        return f"cast(CASE WHEN abs({self.at(high)} - {value}) < abs({self.at(low)} - {value}) THEN {high} ELSE {low} END as int)"


class Axis:
    """The same expressions as columns; values are column names."""

    def __init__(self, name: str):
        self._text = AxisText(name)
        self.coords = F.col(f"ax_{name}")

    @property
    def size(self) -> Column:
        return F.expr(self._text.size)

    @property
    def first(self) -> Column:
        return F.expr(self._text.first)

    @property
    def last(self) -> Column:
        return F.expr(self._text.last)

    def at(self, index: Column) -> Column:
        return F.get(self.coords, index.cast("int"))

    def covers(self, value: str | Column) -> Column:
        if isinstance(value, str):
            return F.expr(self._text.covers(value))
        return (value >= self.first) & (value <= self.last)

    def floor_index(self, value: str) -> Column:
        return F.expr(self._text.floor_index(value))

    def ceil_index(self, value: str) -> Column:
        return F.expr(self._text.ceil_index(value))

    def cell_index(self, value: str) -> Column:
        return F.expr(self._text.cell_index(value))

    def nearest_index(self, value: str) -> Column:
        return F.expr(self._text.nearest_index(value))


def barrier(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add columns, given as SQL text, through a one-row generator.

    Later filters and null checks on these columns stay above the generator.
    Through a plain projection the optimizer would push them down by copying
    the whole expression, and stacked stages would multiply. The expressions
    themselves run in a projection below, where common parts are shared.
    """
    ready = df.selectExpr("*", *[f"{text} AS _b_{n}" for n, text in columns.items()])
    fields = ", ".join(f"'{n}', _b_{n}" for n in columns)
    return ready.selectExpr(*[f"`{c}`" for c in df.columns], f"inline(array(named_struct({fields})))")


def axis_index(axes: DataFrame, names: Sequence[str] = AXES) -> DataFrame:
    """One lookup row per case: the sorted coordinates ``ax_<name>`` and the search steps ``ax_<name>_steps``.

    The row is as long as the axis and the steps as its logarithm, whatever the spacing;
    equal coordinates (which ``check_grid`` reports) find the last of them. An index
    already built (and stored) passes through.
    """
    if f"ax_{names[0]}" in axes.columns:
        return axes.select("case_id", *[c for c in axes.columns if c.split("_")[:2] in [["ax", n] for n in names]])
    rows = axes.groupBy("case_id").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("axis") == n, F.struct("idx", "coord")))),
                    lambda s: s["coord"]).alias(f"ax_{n}") for n in names])
    return rows.selectExpr("*", *[f"transform(sequence(cast(ceil(log2(greatest(size(ax_{n}), 1))) as int), 0), k -> shiftleft(1, k)) AS ax_{n}_steps" for n in names])


def frame_index(frames: DataFrame) -> DataFrame:
    """Frame times of each case as an axis of whole seconds named ``time``."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    return axis_index(frames.select("case_id", F.lit("time").alias("axis"), F.col("it").alias("idx"),
                                    seconds.alias("coord")), ["time"])


def normalize_axes(axes: DataFrame) -> DataFrame:
    """S3: sign, cyclic shift and sort order of each axis, with the old index kept.

    ``axes`` also carries ``positive`` ('up'/'down', depth only). Result:
    ``(case_id, axis, idx, old_idx, coord)``.
    """
    coord = (F.when((F.col("axis") == "depth") & (F.col("positive") == "up"), -F.col("coord"))
             .when((F.col("axis") == "lon") & (F.col("coord") >= 180), F.col("coord") - 360.0)
             .otherwise(F.col("coord")))
    order = Window.partitionBy("case_id", "axis").orderBy("coord")
    return (axes.select("case_id", "axis", F.col("idx").alias("old_idx"), coord.alias("coord"))
            .withColumn("idx", (F.row_number().over(order) - 1).cast("int"))
            .select("case_id", "axis", "idx", "old_idx", "coord"))


def reindex_cells(cells: DataFrame, normalized: DataFrame) -> DataFrame:
    """S3: move cells to the sorted axes."""
    out = cells
    for axis in AXES:
        name = INDEX_OF[axis]
        moves = normalized.filter(F.col("axis") == axis).select("case_id", F.col("old_idx").alias(name), F.col("idx").alias("_new"))
        out = out.join(moves, ["case_id", name]).drop(name).withColumnRenamed("_new", name)
    return out.select(*cells.columns)


def midpoint_edges(axes: DataFrame) -> DataFrame:
    """Cell edges at midpoints, clipped to the first and last coordinate."""
    order = Window.partitionBy("case_id", "axis").orderBy("idx")
    c = F.col("coord")
    low = F.coalesce((F.lag(c).over(order) + c) / 2, c)
    high = F.coalesce((F.lead(c).over(order) + c) / 2, c)
    return axes.select("case_id", "axis", "idx", "coord", low.alias("edge_low"), high.alias("edge_high"))


def _edges(a: str) -> str:
    return f"concat(array(get({a}, 0)), transform(sequence(1, size({a}) - 1), i -> (get({a}, i - 1) + get({a}, i)) / 2), array(get({a}, size({a}) - 1)))"


def _pairs(edges: str, body: str) -> str:
    text = body.replace("<a>", f"get({edges}, i)").replace("<b>", f"get({edges}, i + 1)")
    return f"transform(sequence(0, size({edges}) - 2), i -> {text})"


def grid_geometry(index: DataFrame, depth_min: float | None = None, depth_max: float | None = None) -> DataFrame:
    """Add midpoint edges and the three factors of a spherical-shell cell volume.

    The shell factor is the expanded difference of cubes, which keeps precision
    when a thin layer sits under a large radius.
    """
    r = f"{EARTH_RADIUS_M!r}D"
    lo = f"{float(depth_min)!r}D" if depth_min is not None else "get(ax_depth, 0)"
    hi = f"{float(depth_max)!r}D" if depth_max is not None else "get(ax_depth, size(ax_depth) - 1)"
    out = index.selectExpr("*", f"transform({_edges('ax_depth')}, e -> least(greatest(e, {lo}), {hi})) AS ed_depth",
                           f"{_edges('ax_lat')} AS ed_lat", f"{_edges('ax_lon')} AS ed_lon")
    shell = f"(<b> - <a>) * (3 * {r} * {r} - 3 * {r} * (<a> + <b>) + <a> * <a> + <a> * <b> + <b> * <b>) / 3"
    return out.selectExpr("*", f"{_pairs('ed_depth', shell)} AS vf_depth", f"{_pairs('ed_lat', 'sin(radians(<b>)) - sin(radians(<a>))')} AS vf_lat",
                          f"{_pairs('ed_lon', 'radians(<b> - <a>)')} AS vf_lon")


def cell_volume() -> Column:
    """Volume in km3 of the cell ``(iz, iy, ix)`` on a row carrying ``grid_geometry``."""
    return F.expr("get(vf_depth, iz) * get(vf_lat, iy) * get(vf_lon, ix) / 1e9D")


def flat_index() -> Column:
    """Depth-major flat index of a cell on a row carrying ``axis_index``."""
    return F.expr("(cast(iz as bigint) * size(ax_lat) + iy) * size(ax_lon) + ix")
