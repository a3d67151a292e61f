"""two event years against a shared baseline, with sections, differences and scales."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinefield.operators import climate as cl


@dataclass(frozen=True)
class Comparison:
    panels: DataFrame
    difference: DataFrame
    scales: DataFrame
    profiles: DataFrame
    selected_point: DataFrame


def compare_events(monthly: DataFrame, axes: DataFrame, years: tuple[int, int], months: Sequence[int], baseline_years: tuple[int, int],
                   basins: dict[str, tuple[float, float]], position: int, level: int) -> Comparison:
    """Both events read the table once; baseline and event means are one group-by each."""
    cells = cl.CELL
    base = cl.month_baseline(monthly, *baseline_years, keys=cells)
    baseline = cl.complete_month_mean(base, months, cells, "baseline")
    events = monthly.filter(F.col("y").isin(*years))
    fields = cl.complete_month_mean(events, months, [*cells, "y"])
    rows = cl.anomaly(fields, baseline, cells)
    sections = None
    for basin, (west, east) in basins.items():
        part = cl.latitude_section(rows, axes, west, east).withColumn("basin", F.lit(basin))
        sections = part if sections is None else sections.unionByName(part)
    keys = ["case_id", "basin", "iz", "ix"]
    pair = [sections.filter(F.col("y") == y).select(*keys, "value") for y in years]
    difference = cl.signed_difference(*pair, keys)
    scales = (cl.common_scale(sections, "value", ["case_id", "basin"]).withColumn("scale", F.lit("value"))
              .unionByName(cl.common_scale(sections, "anomaly", ["case_id", "basin"], True).withColumn("scale", F.lit("anomaly")))
              .unionByName(cl.common_scale(difference, "difference", ["case_id", "basin"], True).withColumn("scale", F.lit("difference"))))
    first = next(iter(basins))
    profiles = cl.profile_from_section(sections.filter(F.col("basin") == first), position)
    point = (profiles.filter(F.col("iz") == level).groupBy("case_id", "depth", "lat", "lon").agg(
        *[F.max(F.when(F.col("y") == y, F.col(c))).alias(f"{c}_{n}") for n, y in (("selected", years[0]), ("reference", years[1])) for c in ("value", "anomaly")]))
    return Comparison(sections, difference, scales, profiles, point.withColumn("difference", F.col("value_selected") - F.col("value_reference")))
