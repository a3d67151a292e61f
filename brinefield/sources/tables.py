"""Catalog, upsert and table output."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinefield.functions.scalars import guard_text
from brinefield.operators.axes import frame_index, Axis
from brinefield.operators.selection import cyclic_axis
from brinefield.operators.climate import axis_of


def profile_model_overlap(profiles: DataFrame, cases: DataFrame, frames: DataFrame) -> DataFrame:
    """Spatial, temporal and vertical overlap of each profile with its case, and the nearest frame.

    ``cases(case_id, west, south, east, north, depth_min, depth_max)``; frames travel as one lookup row per case.
    """
    time = Axis("time")
    p = profiles.join(cases.withColumnsRenamed({"depth_min": "_zmin", "depth_max": "_zmax"}), "case_id").join(frame_index(frames), "case_id")
    p = p.withColumn("_sec", F.unix_seconds(F.date_trunc("second", "time")).cast("double"))
    near = time.nearest_index("_sec")
    spatial = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    vertical = F.coalesce(F.greatest("depth_min", "_zmin") <= F.least("depth_max", "_zmax"), F.lit(False)) & F.col("depth_min").isNotNull()
    temporal = time.covers("_sec")
    return p.select("case_id", "profile_id", spatial.alias("spatial"), temporal.alias("temporal"), vertical.alias("vertical"),
                    (spatial & temporal & vertical & (F.col("eligible_samples") > 0)).alias("eligible"), near.alias("nearest_it"),
                    (F.col("_sec") - time.at(near)).cast("bigint").alias("offset_seconds"))


def _on_circle(lon: Column) -> Column:
    return F.pmod(lon, F.lit(360.0))


def cyclic_overlap(profiles: DataFrame, cases: DataFrame) -> DataFrame:
    """S13, monthly form: overlap flags of each profile with its case, longitudes modulo 360 and calendar months half open.

    ``cases(case_id, west, east, south, north, start, end, depth_min, depth_max)``; a case whose
    east lies west of its west crosses the seam; ``end`` is the first day after it. A month's
    mean is no match for a moment, so no profile is eligible for a residual.
    """
    p = profiles.join(cases.withColumnsRenamed({"depth_min": "_zmin", "depth_max": "_zmax"}), "case_id")
    deep = F.coalesce(F.greatest("depth_min", "_zmin") <= F.least("depth_max", "_zmax"), F.lit(False)) & F.col("depth_min").isNotNull()
    return p.select("case_id", "profile_id", _inside().alias("spatial"), _during().alias("temporal"), deep.alias("vertical"), F.lit(False).alias("eligible"))


def _inside() -> Column:
    lon, west, east = (_on_circle(F.col(c)) for c in ("lon", "west", "east"))
    across = F.when(west <= east, lon.between(west, east)).otherwise((lon >= west) | (lon <= east))
    return F.coalesce(F.col("lat").between(F.col("south"), F.col("north")) & across, F.lit(False))


def _during() -> Column:
    return F.coalesce((F.col("time") >= F.col("start")) & (F.col("time") < F.col("end")), F.lit(False))


def cases_met(profiles: DataFrame, cases: DataFrame, tile: float = 10.0) -> DataFrame:
    """Every (profile, case) pair that meets in space and month, over all cases.

    A cyclic interval index: a case that crosses the seam is two pieces, and a piece is
    listed under the tiles and months that it touches (as many as its extent has), so the
    search is an equi-join of the profile's own tile and month.
    """
    west, east = _on_circle(F.col("west")), _on_circle(F.col("east"))
    pieces = F.when(west <= east, F.array(F.struct(west.alias("a"), east.alias("b")))).otherwise(
        F.array(F.struct(west.alias("a"), F.lit(360.0).alias("b")), F.struct(F.lit(0.0).alias("a"), east.alias("b"))))
    months = F.sequence(F.trunc("start", "MM"), F.trunc(F.date_sub(F.to_date("end"), 1), "MM"), F.expr("INTERVAL 1 MONTH"))
    span = lambda a, b: F.sequence(F.floor(a / tile), F.floor(b / tile))
    listed = (cases.filter("start < end").withColumn("_p", F.explode(pieces)).withColumn("_x", F.explode(span(F.col("_p.a"), F.col("_p.b"))))
              .withColumn("_y", F.explode(span(F.col("south"), F.col("north")))).withColumn("_m", F.explode(months)).drop("_p").dropDuplicates(["case_id", "_x", "_y", "_m"]))
    p = profiles.drop("case_id").withColumns({"_x": F.floor(_on_circle(F.col("lon")) / tile), "_y": F.floor(F.col("lat") / tile), "_m": F.trunc("time", "MM")})
    return p.join(listed, ["_x", "_y", "_m"]).filter(_inside() & _during()).select("profile_id", "case_id")


def catalog(profiles: DataFrame, frames: DataFrame) -> DataFrame:
    """Per case, profile and frame counts and the time covered."""
    f = frames.groupBy("case_id").agg(F.count("*").alias("frames"), F.min("ts").alias("time_start"), F.max("ts").alias("time_end"))
    p = profiles.groupBy("case_id").agg(F.count("*").alias("profiles"), F.count_distinct("platform").alias("platforms"), F.count_distinct("instrument").alias("instruments"),
                                        F.count_distinct("collection").alias("collections"))
    return f.join(p, "case_id", "left")


def upsert_profiles(existing: DataFrame, incoming: DataFrame, key: str = "profile_id") -> DataFrame:
    """Union by profile id; the incoming version wins."""
    return existing.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def guarded(df: DataFrame, meta: Mapping[str, object] | None = None) -> DataFrame:
    """Metadata first, nested values as JSON, text guarded against formula reading, numbers untouched."""
    out = [F.lit(v).alias(k) for k, v in (meta or {}).items()]
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.StringType):
            c = guard_text(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_table_csv(df: DataFrame, path: str, meta: Mapping[str, object] | None = None) -> None:
    """Nulls are empty cells; the table stays partitioned, one part file per task."""
    guarded(df, meta).write.csv(path, header=True, nullValue="", emptyValue='""')


def export_tables(tables: Mapping[str, DataFrame], root: str, meta: Mapping[str, object], partition_by: Sequence[str] = ()) -> None:
    """One guarded table per name under ``root``."""
    for name, df in tables.items():
        guarded(df, meta).write.partitionBy(*partition_by).csv(f"{root.rstrip('/')}/{name}", header=True, nullValue="")


def read_exported(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """An exported table (one that was not partitioned) with the types it was written from."""
    return spark.read.csv(f"{root.rstrip('/')}/{name}", header=True, schema=schema)


def evolution_tables(result) -> dict[str, DataFrame]:
    """Region-correspondence tables; nodes are named ``t<frame>:r<label>``."""
    def node(it, label):
        return F.concat(F.lit("t"), F.col(it).cast("string"), F.lit(":r"), F.col(label).cast("string"))
    regions = result.regions.withColumn("node_id", node("it", "label"))
    links = result.links.withColumns({"source_node_id": node("it", "source"), "target_node_id": node("next_it", "target")}).drop("grp")
    return {"evolution-regions": regions, "evolution-links": links, "evolution-transitions": result.transitions,
            "evolution-unmatched": result.unmatched.withColumn("node_id", node("it", "label")), "evolution-sensitivity-frames": result.sensitivity,
            "evolution-summary": result.summary}


def exclusion_tables(states: DataFrame, effects: DataFrame, removed: DataFrame, statements: DataFrame) -> dict[str, DataFrame]:
    """Leave-out tables."""
    return {"blackout-coverage": states, "blackout-profiles": effects, "blackout-removed-sample-identifiers": removed, "blackout-statements": statements}


def series_tables(series: DataFrame, events: DataFrame, climatology: DataFrame) -> dict[str, DataFrame]:
    """Surface-event tables; calendar days count from 1."""
    return {"heat-surface-series": series, "heat-events": events, "heat-climatology": climatology.withColumn("leap_calendar_day", F.col("doy") + 1)}


def section_tables(comparison) -> dict[str, DataFrame]:
    """Event-comparison tables."""
    return {"climate-sections": comparison.panels, "climate-difference": comparison.difference, "climate-profiles": comparison.profiles,
            "climate-selected-point": comparison.selected_point}


def track_tables(tracks: DataFrame, particles: DataFrame) -> dict[str, DataFrame]:
    """Trajectory tables."""
    return {"drift-trajectories": tracks, "drift-particles": particles}


def regional_export(cells: DataFrame, axes: DataFrame, west: float, east: float, south: float, north: float, variable: str, units: str) -> DataFrame:
    """Cells with source indices, longitude unwrapped from the west bound, value and units."""
    lat = axis_of(axes, "lat").filter(F.col("lat").between(south, north))
    return (cells.join(cyclic_axis(axes, west, east), ["case_id", "ix"]).join(lat, ["case_id", "iy"]).join(axis_of(axes, "depth"), ["case_id", "iz"])
            .select("case_id", "it", F.col("ix").alias("source_longitude_index"), F.col("iy").alias("source_latitude_index"), F.col("iz").alias("source_level_index"),
                    F.col("unwrapped").alias("longitude_unwrapped_deg_east"), F.col("lat").alias("latitude_deg_north"), F.col("depth").alias("vertical_coordinate"),
                    F.col("value").alias(variable), F.lit(units).alias("units")))
