"""Index seasons: runs, windows, integrity and event context.

An index has one row per month, so per-index windows stay a few thousand rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinefield.functions.scalars import season_centre, season_name

THRESHOLD = 0.5
MIN_SEASONS = 5


def serial(year: Column, month: Column) -> Column:
    return year * 12 + month


def qualify_runs(seasons: DataFrame, threshold: float = THRESHOLD, min_len: int = MIN_SEASONS) -> DataFrame:
    """Phase of each season; five consecutive same-sign seasons at or past the threshold qualify.

    A month that occurs twice counts once towards a run; ``series_integrity`` reports it.
    """
    sign = F.when(F.col("value_c") >= threshold, 1).when(F.col("value_c") <= -threshold, -1).otherwise(0)
    rows = seasons.withColumns({"sign": sign, "_s": serial(F.col("y"), F.col("m"))})
    island = F.col("_s") - F.dense_rank().over(Window.partitionBy("index_id", "sign").orderBy("_s"))
    rows = rows.withColumn("island", island)
    run = Window.partitionBy("index_id", "sign", "island")
    size = F.max("_s").over(run) - F.min("_s").over(run) + 1
    phase = (F.when(F.col("value_c").isNull(), "unavailable")
             .when((F.col("sign") != 0) & (F.col("_n") >= min_len), F.when(F.col("sign") == 1, "el_nino").otherwise("la_nina")).otherwise("neutral"))
    return rows.withColumn("_n", size).withColumn("phase", phase).drop("_s", "_n")


def qualifying_run(qualified: DataFrame, wanted: DataFrame) -> DataFrame:
    """The whole run that holds each wanted ``(index_id, y, season)``; a run's length is a number of months."""
    hits = qualified.filter(F.col("phase").isin("el_nino", "la_nina"))
    pick = hits.withColumn("season", season_name(F.col("m"))).join(wanted, ["index_id", "y", "season"]).select(
        "index_id", "sign", "island", F.col("y").alias("wanted_y"), F.col("season").alias("wanted_season"))
    order = serial(F.col("y"), F.col("m"))
    label = F.struct("y", season_name(F.col("m")).alias("season"), "value_c")
    return (hits.join(pick, ["index_id", "sign", "island"]).groupBy("index_id", "wanted_y", "wanted_season", "phase").agg(
        F.min_by(label, order).alias("first"), F.max_by(label, order).alias("last"), F.count("*").alias("season_count"),
        F.array_sort(F.collect_list(F.struct("y", "m", "value_c"))).alias("values")))


def season_months(year: Column, season: Column) -> list[Column]:
    """The three ``yyyy-MM`` months of a season, across the year end where needed."""
    base = year * 12 + season_centre(season) - 1
    out = []
    for step in (-1, 0, 1):
        at = base + step
        out.append(F.format_string("%04d-%02d", F.floor(at / 12).cast("int"), (F.pmod(at, F.lit(12)) + 1).cast("int")))
    return out


def season_mean(monthly: DataFrame) -> DataFrame:
    """Mean of a month and its neighbours, null if one of the three is missing."""
    w = Window.partitionBy("index_id").orderBy("_s").rangeBetween(-1, 1)
    rows = monthly.withColumn("_s", serial(F.col("y"), F.col("m")))
    return (rows.withColumn("mean_c", F.when(F.count("value_c").over(w) == 3, F.sum("value_c").over(w) / 3.0))
            .withColumn("season", season_name(F.col("m"))).select("index_id", "y", "m", "season", "mean_c"))


def series_integrity(seasons: DataFrame) -> DataFrame:
    """Duplicate seasons, year gaps, and partial years anywhere but at the end, per index."""
    keys = seasons.groupBy("index_id", "y", "m").agg(F.count("*").alias("n"))
    years = keys.groupBy("index_id", "y").agg(F.count("*").alias("months"), F.count_if(F.col("n") > 1).alias("dups"))
    w = Window.partitionBy("index_id").orderBy("y")
    marked = years.withColumns({"_gap": F.col("y") - F.lag("y").over(w) > 1, "_last": F.lead("y").over(w).isNull()})
    return marked.groupBy("index_id").agg(
        F.sum("dups").alias("duplicate_keys"), F.count_if("_gap").alias("year_gaps"),
        F.count_if((F.col("months") < 12) & ~F.col("_last")).alias("partial_years"),
        (F.sum("dups") + F.count_if("_gap") + F.count_if((F.col("months") < 12) & ~F.col("_last")) == 0).alias("ok"))


def cross_source_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Seasons where two tables disagree in key or value (null agrees with null)."""
    keys = ["index_id", "y", "m"]
    left = a.select(*keys, F.col("value_c").alias("a"), F.lit(True).alias("_a"))
    right = b.select(*keys, F.col("value_c").alias("b"), F.lit(True).alias("_b"))
    kind = (F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").otherwise("value"))
    return left.join(right, keys, "full").filter(F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("a").eqNullSafe(F.col("b"))).select(
        *keys, "a", "b", kind.alias("mismatch"))


def event_index_context(events: DataFrame, seasons: DataFrame, indices: list, labels: DataFrame) -> DataFrame:
    """Per event month the season value of every index, with the season's phase and the separate episode label.

    ``events(event_id, y, season, months)``, ``labels(event_id, episode)``.
    """
    months = events.select("event_id", "y", "season", F.explode("months").alias("m"))
    wide = seasons.groupBy("y", "m").pivot("index_id", indices).agg(F.first("value_c"))
    renamed = wide.select("y", "m", *[F.col(f"`{k}`").alias(f"index_{k}") for k in indices])
    phases = qualify_runs(seasons.filter(F.col("index_id") == indices[0])).select("y", "m", F.col("phase").alias("season_phase"))
    return (months.join(renamed, ["y", "m"], "left").join(phases, ["y", "m"], "left").join(labels, "event_id", "left")
            .withColumn("centred_season", season_name(F.col("m"))).withColumn("episode", F.coalesce("episode", F.lit("unassigned"))))
