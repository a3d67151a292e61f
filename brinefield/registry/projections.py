"""Field-shaped projections of the given tables, one SQL text for both engines.

Keys that stand for cases, locations and map cells are taken from row keys, so
the projected grids, series and observation sets grow with the tables.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinefield.operators.axes import axis_index
from brinefield.runtime import checkpoint_root, cut, spread
from brinefield.sources.fields import read_columns, read_field, write_cells, write_columns

# Axis values of every projected case (plain test data).
DEPTHS = (0.0, 10.0, 30.0, 60.0, 100.0, 160.0, 250.0)
NZ, NY, NX, NT = 7, 12, 15, 7
LAT0, LON0, STEP = 10.0, 85.0, 0.25

GRID = """
SELECT case_id, it, iz, iy, ix,
       CASE WHEN s % 13 = 0 THEN NULL ELSE CAST(s * 7 % 101 AS DOUBLE) / 4 END AS value,
       CASE WHEN s % 17 = 0 THEN NULL ELSE CAST(s * 11 % 41 AS DOUBLE) / 8 - 2.5e0 END AS u,
       CASE WHEN s % 19 = 0 THEN NULL ELSE CAST(s * 5 % 37 AS DOUBLE) / 8 - 2.25e0 END AS v
FROM (SELECT CAST(floor(l_orderkey / 5000e0) AS BIGINT) AS case_id,
             CAST((year(l_shipdate) - 1995) % 7 AS INT) AS it, CAST(l_linenumber - 1 AS INT) AS iz,
             CAST(l_suppkey % 12 AS INT) AS iy, CAST(l_partkey % 15 AS INT) AS ix,
             sum(CAST(l_quantity AS BIGINT)) AS s
      FROM {lineitem} GROUP BY 1, 2, 3, 4, 5) t
"""

GRID_SCHEMA = T.StructType([T.StructField("case_id", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in ("it", "iz", "iy", "ix")],
                            *[T.StructField(c, T.DoubleType()) for c in ("value", "u", "v")]])

CASES = "SELECT DISTINCT CAST(floor(o_orderkey / 5000e0) AS BIGINT) AS case_id FROM {orders}"

OBS = """
SELECT CAST(floor(event_id / 3334e0) AS BIGINT) AS case_id,
       concat(CAST(CAST(floor(event_id / 3334e0) AS BIGINT) AS VARCHAR(20)), '-', CAST(user_id AS VARCHAR(20))) AS profile_id,
       event_id AS sample_index, CAST(ts AS TIMESTAMP) AS ts, user_id,
       CASE user_id % 4 WHEN 0 THEN 'argo' WHEN 1 THEN 'bgc' WHEN 2 THEN 'glider' ELSE 'ctd' END AS instrument,
       CASE user_id % 4 WHEN 2 THEN 'qartod' WHEN 3 THEN 'woce' WHEN 0 THEN 'argo' ELSE 'declared' END AS scheme,
       concat('pf', CAST(user_id % 20 AS VARCHAR(20))) AS platform,
       concat('col', CAST(user_id % 3 AS VARCHAR(20))) AS collection,
       CASE user_id % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'A' ELSE 'D' END AS mode,
       10 + CAST(user_id * 37 % 276 AS DOUBLE) / 100 AS lat,
       85 + CAST(user_id * 53 % 351 AS DOUBLE) / 100 AS lon,
       CAST(event_id * 17 % 2600 AS DOUBLE) / 10 AS depth_m,
       CASE WHEN user_id % 4 = 3 AND event_id % 3 > 0 THEN '2' WHEN user_id % 4 = 2 AND event_id % 3 > 0 THEN '1'
            ELSE CAST(event_id % 5 AS VARCHAR(20)) END AS qc,
       CASE WHEN event_id % 11 = 0 THEN '4' WHEN event_id % 11 < 4 THEN '2' ELSE '1' END AS pressure_qc,
       CASE WHEN user_id % 41 = 3 THEN '3' ELSE '1' END AS position_qc,
       CASE WHEN event_id % 97 = 0 THEN '9' ELSE '1' END AS time_qc,
       user_id % 37 = 0 AS held, user_id % 31 <> 5 AS has_variable, user_id % 23 <> 7 AS compatible,
       CASE WHEN event_id % 29 = 0 THEN NULL ELSE value END AS value
FROM {events}
"""

DAILY_COUNTS = """
SELECT CAST(floor(o_custkey / 500e0) AS BIGINT) AS loc, CAST(o_orderdate AS DATE) AS d,
       count(*) AS n, sum(o_orderkey) % 4 AS m
FROM {orders} GROUP BY 1, 2
"""

MONTHLY = """
SELECT CAST(floor(o_custkey / 60e0) AS BIGINT) AS cell, CAST(year(o_orderdate) AS INT) AS y,
       CAST(month(o_orderdate) AS INT) AS m, CAST(count(*) AS DOUBLE) AS value
FROM {orders} GROUP BY 1, 2, 3
"""

SEASONS = """
SELECT index_id, y, m,
       CAST((y * 12 + m) % 24 - 12 AS DOUBLE) / 8 + CAST(k % 3 - 1 AS DOUBLE) / 4 AS value_c
FROM (SELECT CAST(floor(o_custkey / 500e0) AS BIGINT) AS index_id, CAST(year(o_orderdate) AS INT) AS y,
             CAST(month(o_orderdate) AS INT) AS m, sum(o_orderkey) AS k
      FROM {orders} GROUP BY 1, 2, 3) t
"""

TRACKS = """
SELECT user_id AS particle_id, event_id, CAST(ts AS TIMESTAMP) AS ts,
       85 + CAST((user_id * 53 + event_id * 7) % 351 AS DOUBLE) / 100 AS lon,
       10 + CAST((user_id * 37 + event_id * 11) % 276 AS DOUBLE) / 100 AS lat
FROM {events}
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _plain(text: str) -> str:
    return text.format(**{t: t for t in TABLES})


_AXIS_ROWS = ", ".join(
    [f"('depth', {i}, {v}e0)" for i, v in enumerate(DEPTHS)]
    + [f"('lat', {i}, {LAT0 + STEP * i}e0)" for i in range(NY)]
    + [f"('lon', {i}, {LON0 + STEP * i}e0)" for i in range(NX)])

CTES = {
    "cases": _plain(CASES),
    "grid": _plain(GRID),
    "axes": f"SELECT case_id, a.axis, a.idx, a.coord FROM cases CROSS JOIN (VALUES {_AXIS_ROWS}) a(axis, idx, coord)",
    "ax_depth": "SELECT case_id, idx, coord AS depth FROM axes WHERE axis = 'depth'",
    "ax_lat": "SELECT case_id, idx, coord AS lat FROM axes WHERE axis = 'lat'",
    "ax_lon": "SELECT case_id, idx, coord AS lon FROM axes WHERE axis = 'lon'",
    "frames": "SELECT case_id, CAST(k AS INT) AS it, TIMESTAMP '2024-01-10 00:00:00' + k * INTERVAL 12 HOUR "
              f"AS ts FROM cases CROSS JOIN generate_series(0, {NT - 1}) g(k)",
    "frames_gap": "SELECT case_id, it, ts + CASE WHEN it >= 5 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END AS ts FROM frames",
    "lattice": "SELECT case_id, CAST(t AS INT) AS it, CAST(z AS INT) AS iz, CAST(y AS INT) AS iy, CAST(x AS INT) AS ix "
               f"FROM cases, generate_series(0,{NT - 1}) a(t), generate_series(0,{NZ - 1}) b(z), "
               f"generate_series(0,{NY - 1}) c(y), generate_series(0,{NX - 1}) e(x)",
    "dense": "SELECT l.*, g.value, g.u, g.v FROM lattice l LEFT JOIN grid g USING (case_id, it, iz, iy, ix)",
    "obs": _plain(OBS),
    "calendar": "SELECT DISTINCT CAST(floor(o_custkey / 500e0) AS BIGINT) AS loc, CAST(k.d AS DATE) AS d FROM orders "
                "CROSS JOIN generate_series(DATE '1995-01-01', DATE '2001-07-31', INTERVAL 1 DAY) k(d)",
    "daily": "SELECT c.loc, c.d, CAST(coalesce(k.n, 0) AS DOUBLE) + 0.25e0 * CAST(coalesce(k.m, 0) AS DOUBLE) AS v "
             f"FROM calendar c LEFT JOIN ({_plain(DAILY_COUNTS)}) k ON c.loc = k.loc AND c.d = k.d",
    "gappy": "SELECT loc, d, CASE WHEN year(d) >= 2000 AND day(d) % 11 = 0 THEN NULL WHEN year(d) >= 2000 AND (k < 7 OR k BETWEEN 9 AND 15 OR k BETWEEN 18 AND 23) "
             "THEN v + 8 ELSE v END AS v FROM (SELECT *, (datediff('day', DATE '1999-01-01', d) + loc * 3) % 41 AS k FROM daily WHERE year(d) >= 1999 UNION ALL "
             "SELECT *, 0 FROM daily WHERE year(d) < 1999) t",
    "monthly": _plain(MONTHLY),
    "seasons": _plain(SEASONS),
    "tracks": _plain(TRACKS),
}
NEEDS = {"axes": ("cases",), "ax_depth": ("axes",), "ax_lat": ("axes",), "ax_lon": ("axes",), "frames": ("cases",), "frames_gap": ("frames",), "lattice": ("cases",),
         "dense": ("lattice", "grid"), "daily": ("calendar",), "gappy": ("daily",)}


def register_cte(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    CTES[name], NEEDS[name] = sql, needs


def with_ctes(body: str, names: tuple[str, ...]) -> str:
    order: list[str] = []

    def visit(name):
        for other in NEEDS.get(name, ()):
            visit(other)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    if not order:
        return body
    body = body.strip()
    recursive = any("/*recursive*/" in CTES[n] for n in order) or body.startswith("WITH RECURSIVE ")
    ctes = ",\n".join(f"{n} AS {'' if '/*recursive*/' in CTES[n] else 'MATERIALIZED '}({CTES[n]})" for n in order)
    own = next((body[len(w):] for w in ("WITH RECURSIVE ", "WITH ") if body.startswith(w)), None)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ctes + (",\n" + own if own is not None else "\n" + body)


_settled: dict[tuple[str, str, str], DataFrame | str] = {}


class Inputs:
    """Lazy access to the tables of one folder and their projections."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, str(sf_dir).rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str, *tables: str) -> DataFrame:
        return self.spark.sql(text, **{t: self.table(t) for t in tables})

    def _small(self, name: str, build) -> DataFrame:
        """Side tables are written once per session, as a user would store them."""
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _settled:
            _settled[key] = cut(build())
        return _settled[key]

    @cached_property
    def _field(self) -> str:
        """Path of the field, its long form stored once per session. Present cells only; an absent cell is a missing cell."""
        key = (self.spark.sparkContext.applicationId, self.dir, "field")
        if key not in _settled:
            path = f"{checkpoint_root(self.spark)}/field-{uuid.uuid4().hex}"
            write_cells(self.sql(GRID, "lineitem"), path)
            _settled[key] = path
        return _settled[key]

    @cached_property
    def grid(self) -> DataFrame:
        return read_field(self.spark, self._field, GRID_SCHEMA)

    @cached_property
    def columns(self) -> DataFrame:
        """The same field as water columns with arrays over depth, stored once per session when a query first asks for them."""
        key = (self.spark.sparkContext.applicationId, self.dir, "columns")
        if key not in _settled:
            write_columns(self.grid, self._field)
            _settled[key] = self._field
        return read_columns(self.spark, self._field)

    @property
    def cells(self) -> DataFrame:
        return self.grid.select("case_id", "it", "iz", "iy", "ix", "value")

    @cached_property
    def cases(self) -> DataFrame:
        return self._small("cases", lambda: self.sql(CASES, "orders"))

    @cached_property
    def axes(self) -> DataFrame:
        def build():
            rows = [("depth", i, v) for i, v in enumerate(DEPTHS)]
            rows += [("lat", i, LAT0 + STEP * i) for i in range(NY)]
            rows += [("lon", i, LON0 + STEP * i) for i in range(NX)]
            entries = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(i).alias("idx"), F.lit(c).alias("coord"))
                                for a, i, c in rows])
            return self.cases.select("case_id", F.inline(entries))
        return self._small("axes", build)

    @cached_property
    def index(self) -> DataFrame:
        """Axis lookup rows, stored like the axes."""
        return self._small("index", lambda: axis_index(self.axes))

    def _frames(self, extra_from_5: int) -> DataFrame:
        hours = F.col("it") * 12 + F.when(F.col("it") >= 5, extra_from_5).otherwise(0)
        start = F.lit("2024-01-10 00:00:00").cast("timestamp")
        return (self.cases.select("case_id", F.explode(F.sequence(F.lit(0), F.lit(NT - 1))).alias("it"))
                .select("case_id", "it", F.timestamp_seconds(F.unix_seconds(start) + hours * 3600).alias("ts")))

    @cached_property
    def frames(self) -> DataFrame:
        return self._small("frames", lambda: self._frames(0))

    @cached_property
    def frames_gap(self) -> DataFrame:
        return self._small("frames_gap", lambda: self._frames(12))

    @cached_property
    def dense(self) -> DataFrame:
        """Full lattice with null for absent cells."""
        axis = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
        lattice = (self.cases.withColumn("it", F.explode(axis(NT))).withColumn("iz", F.explode(axis(NZ)))
                   .withColumn("iy", F.explode(axis(NY))).withColumn("ix", F.explode(axis(NX))))
        return lattice.join(self.grid, ["case_id", "it", "iz", "iy", "ix"], "left")

    @cached_property
    def obs(self) -> DataFrame:
        return self.sql(OBS, "events")

    @cached_property
    def daily(self) -> DataFrame:
        counts = self.sql(DAILY_COUNTS, "orders")
        calendar = spread(counts.select("loc").distinct(), "loc").select("loc", F.explode(F.sequence(
            F.lit("1995-01-01").cast("date"), F.lit("2001-07-31").cast("date"))).alias("d"))
        total = F.coalesce("n", F.lit(0)).cast("double") + 0.25 * F.coalesce("m", F.lit(0)).cast("double")
        return calendar.join(counts, ["loc", "d"], "left").select("loc", "d", total.alias("v"))

    @cached_property
    def gappy(self) -> DataFrame:
        """Daily values with warm spells and missing days in the analysis years."""
        late = F.year("d") >= 2000
        k = (F.datediff("d", F.lit("1999-01-01").cast("date")) + F.col("loc") * 3) % 41
        warm = late & ((k < 7) | k.between(9, 15) | k.between(18, 23))
        value = F.when(late & (F.dayofmonth("d") % 11 == 0), None).when(warm, F.col("v") + 8).otherwise(F.col("v"))
        return self.daily.withColumn("v", value)

    @cached_property
    def monthly(self) -> DataFrame:
        return self.sql(MONTHLY, "orders")

    @cached_property
    def seasons(self) -> DataFrame:
        return self.sql(SEASONS, "orders")

    @cached_property
    def tracks(self) -> DataFrame:
        return self.sql(TRACKS, "events")
