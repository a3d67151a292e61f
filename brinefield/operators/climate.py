"""Monthly fields: complete-support baselines, anomalies, sections and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinefield.operators.axes import INDEX_OF

CELL = ["case_id", "iz", "iy", "ix"]


def month_baseline(monthly: DataFrame, first_year: int, last_year: int, keys: Sequence[str] = ("cell",)) -> DataFrame:
    """Mean per calendar month and cell over the baseline years, only with a value in every year."""
    years = last_year - first_year + 1
    rows = monthly.filter(F.col("y").between(first_year, last_year))
    return rows.groupBy(*keys, "m").agg(F.count("value").alias("n"), F.avg("value").alias("_mean")).select(
        *keys, "m", "n", F.when(F.col("n") == years, F.col("_mean")).alias("baseline"))


def complete_month_mean(monthly: DataFrame, months: Sequence[int], keys: Sequence[str], value: str = "value") -> DataFrame:
    """Equal-weight mean over the months, null unless all of them have a value."""
    rows = monthly.filter(F.col("m").isin(*months))
    return rows.groupBy(*keys).agg(F.when(F.count(value) == len(months), F.sum(value) / len(months)).alias(value))


def signed_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """a minus b per cell, null unless both are present."""
    keys = list(keys)
    left, right = a.select(*keys, F.col("value").alias("a")), b.select(*keys, F.col("value").alias("b"))
    return left.join(right, keys, "full").select(*keys, "a", "b", (F.col("a") - F.col("b")).alias("difference"))


def anomaly(field: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """value minus its baseline."""
    return field.join(baseline, [*keys], "left").withColumn("anomaly", F.col("value") - F.col("baseline"))


def latitude_section(cells: DataFrame, axes: DataFrame, west: float, east: float) -> DataFrame:
    """cells on the native latitude nearest 0 (first on a tie) within an inclusive longitude range."""
    rows = axes.filter(F.col("axis") == "lat")
    line = rows.groupBy("case_id").agg(F.min_by(F.struct(F.col("idx").alias("iy"), F.col("coord").alias("lat")), F.struct(F.abs("coord"), "idx")).alias("_l")).select("case_id", "_l.*")
    lon = axes.filter((F.col("axis") == "lon") & F.col("coord").between(west, east)).select("case_id", F.col("idx").alias("ix"), F.col("coord").alias("lon"))
    depth = axes.filter(F.col("axis") == "depth").select("case_id", F.col("idx").alias("iz"), F.col("coord").alias("depth"))
    return cells.join(line, ["case_id", "iy"]).join(lon, ["case_id", "ix"]).join(depth, ["case_id", "iz"])


def profile_from_section(section: DataFrame, position: int) -> DataFrame:
    """one column of a section by its position in the section, counted from the west."""
    cols = section.select("case_id", "ix").distinct().groupBy("case_id").agg(F.array_sort(F.collect_list("ix")).alias("_xs"))
    pick = cols.select("case_id", F.get("_xs", F.lit(position)).alias("ix"))
    return section.join(pick, ["case_id", "ix"], "left_semi")


def common_scale(sections: DataFrame, value: str, keys: Sequence[str], symmetric: bool = False) -> DataFrame:
    """A10: one scale for several sections; symmetric about zero on request."""
    low, high = F.min(value), F.max(value)
    if symmetric:
        extent = F.greatest(F.abs(low), F.abs(high))
        low, high = -extent, extent
    return sections.groupBy(*keys).agg(low.alias("low"), high.alias("high"))


def axis_of(axes: DataFrame, name: str) -> DataFrame:
    return axes.filter(F.col("axis") == name).select("case_id", F.col("idx").alias(INDEX_OF[name]), F.col("coord").alias(name))
