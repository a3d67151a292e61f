"""Scalar function queries (survey section 2.10)."""

from pyspark.sql import functions as F

from brinefield.functions import scalars as sc
from brinefield.registry.core import query


@query("X1_leap_day_index", """SELECT CAST(d AS VARCHAR) AS d, datediff('day', DATE '2000-01-01', make_date(2000, month(d), day(d))) AS doy FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) t""")
def x1(i):
    days = i.sql("SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM {orders}", "orders")
    return days.select(F.col("d").cast("string").alias("d"), sc.leap_day_index(F.col("d")).alias("doy"))


STAMPS = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '2024-01-05T10:20:30Z' WHEN 1 THEN '2024-01-05T10:20:30.750+05:30' WHEN 2 THEN '2024-01-05T10:20:30' WHEN 3 THEN 'not a time'
  WHEN 4 THEN '2024-01-05 23:59:59-02:00' ELSE NULL END AS t FROM {events}"""


@query("X2_parse_zoned_time", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN epoch_us(TIMESTAMP '2024-01-05 10:20:30') WHEN 1 THEN epoch_us(TIMESTAMP '2024-01-05 04:50:30')
  WHEN 4 THEN epoch_us(TIMESTAMP '2024-01-06 01:59:59') END AS t_us FROM events""")
def x2(i):
    return i.sql(STAMPS, "events").select("event_id", F.unix_micros(sc.parse_zoned_time(F.col("t"))).alias("t_us"))


@query("X3_decode_numeric_time", """SELECT event_id, CASE WHEN event_id % 9 > 0 THEN CAST(round_even(CASE event_id % 3 WHEN 0 THEN value * 86400 WHEN 1 THEN value * 3600 ELSE value * 60 END, 0) AS BIGINT)
  + epoch_us(TIMESTAMP '1950-01-01 00:00:00') // 1000000 END AS t FROM events""")
def x3(i):
    k = F.col("event_id") % 3
    units = F.when(k == 0, "days since 1950-01-01 00:00:00").when(k == 1, "hours since 1950-01-01").otherwise("minutes since 1950-01-01T00:00:00Z")
    value = F.when(F.col("event_id") % 9 > 0, F.col("value")).otherwise(F.lit(float("nan")))
    return i.table("events").select("event_id", F.unix_seconds(sc.decode_numeric_time(value, units)).alias("t"))


@query("X4_finite_number", "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value END AS v FROM events WHERE event_id % 4 < 4")
def x4(i):
    k = F.col("event_id") % 6
    v = F.when(k == 0, F.lit(float("nan"))).when(k == 3, F.lit(float("-inf"))).otherwise(F.col("value"))
    return i.table("events").select("event_id", sc.finite(v).alias("v"))


@query("X5_month_interval", """SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month_start, CAST(CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS next_month FROM orders""")
def x5(i):
    start, end = sc.month_interval(F.col("o_orderdate"))
    return i.table("orders").select("o_orderkey", start.cast("string").alias("month_start"), end.cast("string").alias("next_month"))


_NAMES = "[" + ", ".join(f"'{s}'" for s in sc.SEASONS) + "]"


@query("X6_season_names", f"SELECT o_orderkey, {_NAMES}[month(o_orderdate)] AS season, month(o_orderdate) AS centre FROM orders")
def x6(i):
    season = sc.season_name(F.month("o_orderdate"))
    return i.table("orders").select("o_orderkey", season.alias("season"), sc.season_centre(season).alias("centre"))


_STEP = "CASE WHEN {0} = 0 THEN pow(2, -149) ELSE pow(2, floor(log2(CAST(CAST({0} AS FLOAT) AS DOUBLE) * (1 + 1e-12))) - 23) END"
_PAIR = """SELECT event_id, CASE WHEN event_id % 13 > 0 THEN value END AS a, CASE WHEN event_id % 17 > 0 THEN CASE event_id % 4 WHEN 0 THEN CAST(CAST(value AS FLOAT) AS DOUBLE) WHEN 1 THEN value
  WHEN 2 THEN value + 0.01e0 ELSE value + 1e-5 END END AS b FROM {events}"""


@query("X7_within_one_ulp", f"""SELECT event_id, CASE WHEN a IS NULL OR b IS NULL THEN a IS NULL AND b IS NULL
  ELSE abs(a - b) <= greatest({_STEP.format('a')}, {_STEP.format('b')}) AND round_even(a * 100, 0) = round_even(b * 100, 0) END AS agrees FROM ({_PAIR.format(events='events')}) t""")
def x7(i):
    return i.sql(_PAIR, "events").select("event_id", sc.within_one_ulp(F.col("a"), F.col("b")).alias("agrees"))
