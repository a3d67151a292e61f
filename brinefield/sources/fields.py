"""Stored fields, in two forms under one path, both partitioned by frame.

``cells`` is the long form, sorted by case, level and position: a frame choice prunes
folders; case, level and box choices prune row groups. ``columns`` has one row per water
column ``(case_id, it, iy, ix)`` with every variable as an array over depth: a vertical
bracket or an interpolation corner is an array read after one join. Ranges of (frame, case)
deal the rows, so a frame of many cases is written by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = ["it", "case_id", "iz", "iy", "ix"]
COLUMN = ["case_id", "it", "iy", "ix"]


def column_packed(cells: DataFrame) -> DataFrame:
    """``(case_id, it, iy, ix)`` and each variable as an array by level; an absent level is null like a missing value.

    A field that is packed already passes through. The arrays are as long as the deepest level that the column holds.
    """
    if "iz" not in cells.columns:
        return cells
    variables = [c for c in cells.columns if c not in ORDER]
    rows = cells.groupBy(*COLUMN).agg(F.array_sort(F.collect_list(F.struct("iz", *variables))).alias("_l"), F.max("iz").alias("_deepest"))
    full = "CASE WHEN size(_l) = _deepest + 1 THEN _l ELSE transform(sequence(0, _deepest), k -> get(filter(_l, s -> s.iz = k), 0)) END"
    return rows.selectExpr(*COLUMN, f"{full} AS _l").selectExpr(*COLUMN, *[f"transform(_l, s -> s.`{v}`) AS `{v}`" for v in variables])


def write_field(cells: DataFrame, path: str) -> None:
    """Store ``cells(case_id, it, iz, iy, ix, ...)`` in both forms; every other column is a variable of the field."""
    write_cells(cells, path)
    write_columns(read_field(cells.sparkSession, path, cells.schema), path)


def write_cells(cells: DataFrame, path: str) -> None:
    """Store the long form alone."""
    cells.repartitionByRange("it", "case_id").sortWithinPartitions(*ORDER).write.partitionBy("it").parquet(f"{path}/cells")


def write_columns(cells: DataFrame, path: str) -> None:
    """Store the water columns beside the long form."""
    packed = column_packed(cells)
    packed.repartitionByRange("it", "case_id").sortWithinPartitions("it", "case_id", "iy", "ix").write.partitionBy("it").parquet(f"{path}/columns")


def read_field(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The stored cells; a filter on ``it`` reads only that frame's folder."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.parquet(f"{path}/cells")
    return rows if schema is None else rows.select(*schema.fieldNames())


def read_columns(spark: SparkSession, path: str) -> DataFrame:
    """The stored water columns; a filter on ``it`` reads only that frame's folder."""
    rows = spark.read.parquet(f"{path}/columns")
    return rows.select(*COLUMN, *[c for c in rows.columns if c not in COLUMN])
