"""Daily series: merging, climatology and event detection.

A series has one row per ``(loc, d)``, so a window over one location is bounded
by its calendar (about 16,000 days in 45 years) whatever the number of rows in
the table. Work spreads over locations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinefield.functions.scalars import leap_day_index, within_one_ulp
from brinefield.runtime import cut, observed

POOL_DAYS = 5
SMOOTH_DAYS = 15
CALENDAR = 366
PLACES = 12  # smoothed curves; sums of doubles differ in the last bits with their order
FEB29 = 59
MIN_RUN = 5
MAX_GAP = 2


def _union(sources: tuple[DataFrame, ...]) -> DataFrame:
    ranked = [s.select("loc", "d", "v", "source", F.lit(k).alias("_p")) for k, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, ranked)


def merge_sources(*sources: DataFrame) -> DataFrame:
    """Union of daily records; per day the first listed source wins, nothing is interpolated."""
    return _union(sources).groupBy("loc", "d").agg(F.min_by(F.struct("v", "source"), "_p").alias("_b")).select("loc", "d", "_b.v", "_b.source")


def merge_checked(*sources: DataFrame, conflicts: str = "stop") -> tuple[DataFrame, DataFrame]:
    """S17 with its gate: the merged days, and the records that differ from the winning one by more than a float32 step or in the hundredth.

    One group-by finds winner and dissenters of a day and is written once; the number of
    dissenters is observed on that write. ``stop`` refuses the merge if there is one,
    ``quarantine`` leaves such days out of the merged series.
    """
    if conflicts not in ("stop", "quarantine"):
        raise ValueError(f"unknown choice {conflicts}")
    entry = F.struct(F.col("_p").alias("p"), "v", "source")
    days = _union(sources).groupBy("loc", "d").agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    days = days.select("loc", "d", F.col("_all")[0].alias("_won"), F.filter(F.slice("_all", 2, F.size("_all")), lambda e: ~within_one_ulp(F.col("_all")[0]["v"], e["v"])).alias("_against"))
    written, seen = observed(days, conflicts=F.sum(F.size("_against")))
    if conflicts == "stop" and seen["conflicts"]:
        raise ValueError(f"{seen['conflicts']} records differ from the source that is listed before them")
    merged = written.filter(F.size("_against") == 0).select("loc", "d", F.col("_won.v").alias("v"), F.col("_won.source").alias("source"))
    against = written.select("loc", "d", F.col("_won.source").alias("first_source"), F.col("_won.v").alias("first_value"), F.explode("_against").alias("_e"))
    return merged, against.select("loc", "d", "first_source", "first_value", F.col("_e.source").alias("second_source"), F.col("_e.v").alias("second_value"))


def overlap_audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both values of every shared day, their difference and agreement within one float32 step."""
    both = a.select("loc", "d", F.col("v").alias("a")).join(b.select("loc", "d", F.col("v").alias("b")), ["loc", "d"])
    return both.withColumns({"difference": F.abs(F.col("a") - F.col("b")), "agrees": within_one_ulp(F.col("a"), F.col("b"))})


def overlap_summary(audit: DataFrame) -> DataFrame:
    """Counts and largest difference per location."""
    return audit.groupBy("loc").agg(F.count("*").alias("overlaps"), F.count_if(~F.col("agrees")).alias("conflicts"),
                                    F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing"), F.max("difference").alias("largest"))


def missing_dates(daily: DataFrame) -> DataFrame:
    """Calendar days without a record between the first and last day of each location."""
    spans = daily.groupBy("loc").agg(F.min("d").alias("a"), F.max("d").alias("z"))
    return spans.select("loc", F.explode(F.sequence("a", "z")).alias("d")).join(daily.select("loc", "d"), ["loc", "d"], "left_anti")


def consecutive_daily(daily: DataFrame) -> DataFrame:
    """Whether each series is strictly consecutive; n distinct days over an n-day span must be."""
    return daily.groupBy("loc").agg(F.count("*").alias("days"), (
        (F.count("*") == F.datediff(F.max("d"), F.min("d")) + 1) & (F.count("*") == F.count_distinct("d"))).alias("consecutive"))


def baseline_status(daily: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """A8 gate: a location needs every day of the baseline, with a value."""
    days = F.datediff(F.lit(f"{last_year}-12-31").cast("date"), F.lit(f"{first_year}-01-01").cast("date")) + 1
    inside = F.year("d").between(first_year, last_year)
    return daily.groupBy("loc").agg(F.count(F.when(inside, F.col("v"))).alias("_n")).select(
        "loc", F.when(F.col("_n") == days, "complete").otherwise("incomplete_baseline").alias("status"))


def seasonal_pool(daily: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Mean, 90th percentile and size of the +/-5 day pool of each calendar day.

    No self-join: a day belongs to the pools centred on the eleven days around
    it; centres outside the baseline or on 29 February drop out.
    """
    complete = baseline_status(daily, first_year, last_year).filter(F.col("status") == "complete").select("loc")
    base = daily.filter(F.year("d").between(first_year, last_year)).join(complete, "loc", "left_semi")
    centres = base.select("loc", "v", F.explode(F.sequence(F.date_sub("d", POOL_DAYS), F.date_add("d", POOL_DAYS))).alias("c"))
    kept = centres.filter(F.year("c").between(first_year, last_year)).withColumn("doy", leap_day_index(F.col("c"))).filter(F.col("doy") != FEB29)
    return kept.groupBy("loc", "doy").agg(F.avg("v").alias("mean"), F.percentile("v", F.lit(0.9)).alias("threshold"), F.count("*").alias("pool_count"))


def feb29_fill(pool: DataFrame) -> DataFrame:
    """29 February takes the mean of its neighbours, with an empty pool."""
    near = pool.filter(F.col("doy").isin(FEB29 - 1, FEB29 + 1)).groupBy("loc").agg(
        F.lit(FEB29).alias("doy"), (F.sum("mean") * 0.5).alias("mean"), (F.sum("threshold") * 0.5).alias("threshold"),
        F.lit(0).cast("bigint").alias("pool_count"))
    return pool.unionByName(near)


def circular_smooth(curve: DataFrame, columns: tuple[str, ...] = ("mean", "threshold")) -> DataFrame:
    """Centred 31-day mean around the 366-day circle; the ends are padded, then one row frame runs.

    Means are rounded to ``PLACES``, so that a day whose value equals its threshold is no exceedance
    by the last bits of a sum.
    """
    shift = F.when(F.col("doy") < SMOOTH_DAYS, CALENDAR).when(F.col("doy") >= CALENDAR - SMOOTH_DAYS, -CALENDAR)
    pads = curve.filter(shift.isNotNull()).withColumn("doy", F.col("doy") + shift)
    w = Window.partitionBy("loc").orderBy("doy").rowsBetween(-SMOOTH_DAYS, SMOOTH_DAYS)
    return (curve.unionByName(pads).withColumns({c: F.round(F.sum(c).over(w) / (2 * SMOOTH_DAYS + 1), PLACES) for c in columns})
            .filter(F.col("doy").between(0, CALENDAR - 1)))


def climatology(daily: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """A8 with W4 and W3: 366 smoothed means and thresholds per complete location.

    The small result is written once, because every later step reads it again.
    """
    return cut(circular_smooth(feb29_fill(cut(seasonal_pool(daily, first_year, last_year)))))


def exceedance(daily: DataFrame, clim: DataFrame) -> DataFrame:
    """Strict exceedance of the day's threshold; a missing value gives null."""
    curve = clim.select("loc", "doy", "mean", "threshold")
    return (daily.withColumn("doy", leap_day_index(F.col("d"))).join(curve, ["loc", "doy"])
            .withColumn("above", F.when(F.col("v").isNotNull(), F.col("v") > F.col("threshold"))))


def _with_neighbours(marked: DataFrame) -> DataFrame:
    w = Window.partitionBy("loc").orderBy("d")
    seen = F.col("v").isNotNull()
    return marked.withColumns({"_seen1": F.lag(seen, 1).over(w), "_seen2": F.lag(seen, 2).over(w), "_after": F.lead(seen).over(w)})


def runs(marked: DataFrame, min_len: int = MIN_RUN) -> DataFrame:
    """Maximal runs of consecutive exceedances of at least ``min_len`` days."""
    rows = _with_neighbours(marked).filter("above")
    w = Window.partitionBy("loc").orderBy("d")
    island = F.date_sub("d", F.row_number().over(w))
    return (rows.withColumn("_g", island).groupBy("loc", "_g").agg(
        F.min("d").alias("start"), F.max("d").alias("end"), F.count("*").alias("days"), F.min_by(F.struct("_seen1", "_seen2"), "d").alias("_left"),
        F.max_by("_after", "d").alias("_right")).filter(F.col("days") >= min_len).drop("_g"))


def merge_runs(run_rows: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """Join runs whose gap is at most two days, all of them observed; one row per event."""
    w = Window.partitionBy("loc").orderBy("start")
    gap = F.datediff("start", F.lag("end").over(w)) - 1
    observed = F.coalesce(F.col("_left._seen1"), F.lit(False)) & ((F.col("_gap") < 2) | F.coalesce(F.col("_left._seen2"), F.lit(False)))
    joins = F.coalesce((F.col("_gap") <= max_gap) & observed, F.lit(False))
    event = F.sum(F.when(joins, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (run_rows.withColumn("_gap", gap).withColumn("_event", event).groupBy("loc", "_event").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("runs"),
        F.min_by(F.col("_left._seen1"), "start").alias("_before"), F.max_by("_right", "start").alias("_after"))
        .select("loc", F.concat_ws("-", F.lit("mhw"), F.col("start").cast("string"), F.col("end").cast("string")).alias("event_id"), "start", "end", "runs",
                (~F.coalesce("_before", F.lit(False))).alias("left_unknown"), (~F.coalesce("_after", F.lit(False))).alias("right_unknown")))


def event_days(events: DataFrame) -> DataFrame:
    return events.select("loc", "event_id", F.explode(F.sequence("start", "end")).alias("d"))


def event_metrics(marked: DataFrame, events: DataFrame) -> DataFrame:
    """Duration, bridged days, first peak date, intensities and open boundaries of each event.

    Anomalies equal to nine places are one peak, dated by its first day.
    """
    anomaly = F.col("v") - F.col("mean")
    stats = marked.join(event_days(events), ["loc", "d"]).groupBy("loc", "event_id").agg(
        F.count("*").alias("duration_days"), F.count_if("above").alias("exceedance_days"), F.avg(anomaly).alias("mean_intensity"),
        F.max(anomaly).alias("max_intensity"), F.sum(anomaly).alias("cumulative_intensity"),
        F.min_by("d", F.struct((-F.round(anomaly, 9)).alias("a"), "d")).alias("peak_date"))
    return (events.join(stats, ["loc", "event_id"])
            .withColumns({"bridged_days": F.col("duration_days") - F.col("exceedance_days"), "complete_boundaries": ~(F.col("left_unknown") | F.col("right_unknown"))}))


def daily_membership(marked: DataFrame, events: DataFrame) -> DataFrame:
    """Every day with its anomaly and event."""
    return marked.join(event_days(events), ["loc", "d"], "left").select(
        "loc", "d", "v", "mean", "threshold", (F.col("v") - F.col("mean")).alias("anomaly"), "above", "event_id")


def detect_events(daily: DataFrame, clim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with metrics, daily series)."""
    marked = cut(exceedance(daily, clim))
    events = cut(merge_runs(runs(marked)))
    return event_metrics(marked, events), daily_membership(marked, events)


def year_events(events: DataFrame, year: int, frame_days: DataFrame) -> DataFrame:
    """events touching a year, with open ends and whether a frame day falls inside.

    ``frame_days(loc, d)`` meets events on the day, not by a range join.
    """
    first, last = F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date")
    touching = events.filter((F.col("start") <= last) & (F.col("end") >= first))
    hit = event_days(touching).join(frame_days.select("loc", "d").distinct(), ["loc", "d"], "left_semi").select("loc", "event_id").distinct()
    return (touching.join(hit.withColumn("_hit", F.lit(True)), ["loc", "event_id"], "left")
            .withColumns({"starts_before_year": F.col("start") < first, "ends_after_year": F.col("end") > last, "depth_overlap": F.coalesce("_hit", F.lit(False))})
            .drop("_hit"))


def link_frames(locations: DataFrame, year_rows: DataFrame, frame_days: DataFrame, chosen_frame: int) -> DataFrame:
    """default event per location (first with a frame inside, else first) and the status of one frame.

    ``frame_days(loc, it, d)`` lists the frames of each location.
    """
    order = F.struct((~F.col("depth_overlap")).alias("o"), "start")
    chosen = year_rows.groupBy("loc").agg(F.min_by(F.struct("event_id", "start", "end"), order).alias("_e"))
    inside = (frame_days.join(chosen, "loc").filter(F.col("d").between(F.col("_e.start"), F.col("_e.end")))
              .groupBy("loc").agg(F.count("*").alias("available_frames"), F.bool_or(F.col("it") == chosen_frame).alias("_now")))
    status = (F.when(F.col("_e").isNull(), "no_event").when(F.col("available_frames").isNull(), "outside_model_period")
              .when(~F.col("_now"), "time_outside_event").otherwise("available"))
    return (locations.select("loc").join(chosen, "loc", "left").join(inside, "loc", "left")
            .select("loc", F.col("_e.event_id").alias("event_id"), F.coalesce("available_frames", F.lit(0)).alias("available_frames"), status.alias("status")))
