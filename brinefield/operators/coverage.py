"""Statistics and accounting over match rows.

Everything here is a plain group-by with map-side partial sums; nothing lists
the rows of a profile, so one huge profile is just one more group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinefield.operators.windows import split_row_number
from brinefield.runtime import observed

PROFILE = ["setting_id", "case_id", "profile_id"]


def metrics() -> list[Column]:
    """A1: count, bias, RMSE, MAE and largest residual of accepted rows; null when there are none."""
    r = F.when(F.col("accepted"), F.col("residual"))
    return [F.count(r).alias("matched"), F.avg(r).alias("bias"), F.sqrt(F.avg(r * r)).alias("rmse"),
            F.avg(F.abs(r)).alias("mae"), F.max(F.abs(r)).alias("max_abs_residual")]


def residual_metrics(matches: DataFrame, *keys: str) -> DataFrame:
    return matches.groupBy(*keys).agg(*metrics())


def exclusion_counts(matches: DataFrame, *keys: str) -> DataFrame:
    """A2: rejected rows by reason."""
    return matches.filter(~F.col("accepted")).groupBy(*keys, "reason").agg(F.count("*").alias("n"))


def exclusion_map(matches: DataFrame, *keys: str) -> DataFrame:
    """A2 as one map per group; its size is the number of reasons."""
    return exclusion_counts(matches, *keys).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("exclusion_counts"))


def profile_coverage(matches: DataFrame) -> DataFrame:
    """A3: totals, offset and distance ranges and metrics per profile.

    Offsets describe accepted rows, or all rows of a profile that has none.
    """
    ok, offset = F.col("accepted"), F.col("time_offset_hours")
    taken = F.when(ok, offset)
    return matches.groupBy(*PROFILE).agg(
        F.count("*").alias("total"), *metrics(), F.count_if(~ok).alias("excluded"),
        F.coalesce(F.min(taken), F.min(offset)).alias("offset_min"), F.coalesce(F.max(taken), F.max(offset)).alias("offset_max"),
        F.min(F.abs(taken)).alias("min_abs_offset"),
        F.min(F.when(ok, F.col("distance_km"))).alias("distance_min"), F.max(F.when(ok, F.col("distance_km"))).alias("distance_max"),
        F.min(F.when(ok, F.col("depth_m"))).alias("depth_min"), F.max(F.when(ok, F.col("depth_m"))).alias("depth_max"))


def eligible_depths(matches: DataFrame) -> DataFrame:
    """A3: accepted depths as rows, in source order by ``sample_index``."""
    return matches.filter("accepted").select(*PROFILE, "sample_index", "depth_m")


def library_coverage(profiles: DataFrame) -> DataFrame:
    """A3: totals over the library, from the per-profile table."""
    return profiles.groupBy("setting_id", "case_id").agg(
        F.count("*").alias("total_profiles"), F.count_if(F.col("matched") > 0).alias("matched_profiles"),
        F.sum("total").alias("total_samples"), F.sum("matched").alias("matched_samples"), F.sum("excluded").alias("excluded_samples"))


def sweep_difference(matches: DataFrame, reference: int) -> DataFrame:
    """Metrics of every setting beside the reference setting's, found by a window over the few settings of a case."""
    m = residual_metrics(matches, "setting_id", "case_id")
    case = Window.partitionBy("case_id")

    def change(name):
        return (F.col(name) - F.max(F.when(F.col("setting_id") == reference, F.col(name))).over(case)).alias(f"{name}_change")

    return m.select("setting_id", "case_id", "matched", "bias", "rmse", *[change(n) for n in ("matched", "bias", "rmse")])


def rank_profiles(coverage: DataFrame, by: str = "time") -> DataFrame:
    """Profiles with accepted rows, closest first or by largest residual.

    A case may hold a large share of all profiles, so ranks are counted over sampled
    ranges of the order, wherever the offsets crowd.
    """
    orders = {"time": [F.col("min_abs_offset"), F.col("distance_min"), F.col("profile_id")],
              "residual": [F.col("max_abs_residual").desc(), F.col("profile_id")]}
    return split_row_number(coverage.filter(F.col("matched") > 0), ["setting_id", "case_id"], orders[by], "rank")


def accounted(matches: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """E15 as a gate: the match rows written once, the identities checked on them, and what was counted while writing.

    Coverage and reason counts come from the written rows; their totals must be those that
    the write itself observed, or the table is refused.
    """
    ok = F.col("accepted")
    written, seen = observed(matches, rows=F.count("*"), accepted=F.count_if(ok), excluded=F.count_if(~ok))
    coverage = profile_coverage(written)
    told = coverage.agg(F.sum("total"), F.sum("matched"), F.sum("excluded")).first()
    if tuple(v or 0 for v in told) != (seen["rows"], seen["accepted"], seen["excluded"]):
        raise ValueError(f"coverage tells {tuple(told)} rows, accepted and excluded, but {seen} were written")
    return written, accounting_check(written, coverage, exclusion_counts(written, "setting_id", "case_id")), seen


def accounting_check(matches: DataFrame, coverage: DataFrame, reasons: DataFrame) -> DataFrame:
    """One row per named identity between match rows, reason counts and coverage."""
    tolerance = 1e-7

    def close(a, b):
        return F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))

    ok = F.col("accepted")
    shape = F.when(ok, (F.col("reason") == "accepted") & close(F.col("residual"), F.col("model") - F.col("observed"))
                   & F.col("upper_weight").between(0, 1)).otherwise(F.col("model").isNull() & F.col("residual").isNull())
    rows = matches.groupBy("setting_id", "case_id").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("ok"), (F.count_if(~F.coalesce(shape, F.lit(False))) == 0).alias("rows_ok"),
        F.avg(F.when(ok, F.col("residual"))).alias("bias"))
    told = coverage.groupBy("setting_id", "case_id").agg(
        F.sum("total").alias("t"), F.sum("matched").alias("m"), F.sum("excluded").alias("x"),
        (F.sum(F.col("bias") * F.col("matched")) / F.sum("matched")).alias("b"))
    counted = reasons.groupBy("setting_id", "case_id").agg(F.sum("n").alias("r"))
    all3 = rows.join(told, ["setting_id", "case_id"]).join(counted, ["setting_id", "case_id"], "left")
    checks = {"rows_consistent": F.col("rows_ok"), "accepted_plus_excluded_is_total": (F.col("m") + F.col("x") == F.col("t")) & (F.col("t") == F.col("n")),
              "accepted_counts_agree": F.col("ok") == F.col("m"), "reason_counts_add_up": F.coalesce("r", F.lit(0)) == F.col("x"),
              "bias_recomputes": F.coalesce(close(F.col("bias"), F.col("b")), F.col("bias").isNull() & F.col("b").isNull())}
    listed = F.array(*[F.struct(F.lit(k).alias("check"), v.alias("passed")) for k, v in checks.items()])
    return all3.select("setting_id", "case_id", F.inline(listed))
