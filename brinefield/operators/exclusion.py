"""Leave-out analysis: which evidence goes when chosen profiles are removed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


FIELDS = {"profile": "profile_id", "instrument": "instrument", "platform": "platform", "collection": "collection"}


def selector_table(spark, choices: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [(kind, name) for kind in FIELDS for name in choices.get(kind, ())]
    return spark.createDataFrame(rows, "kind string, name string")


def _tags(profiles: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("name")) for kind, c in FIELDS.items()])
    return profiles.select("case_id", "profile_id", F.inline(pairs))


def resolve_exclusions(profiles: DataFrame, selectors: DataFrame) -> DataFrame:
    """Profiles named by any selector, with the selectors that named them (at most one per kind)."""
    order = F.array(*[F.lit(k) for k in FIELDS])
    hits = _tags(profiles).join(selectors, ["kind", "name"]).select(
        "case_id", "profile_id", F.struct(F.array_position(order, F.col("kind")).alias("k"), F.concat_ws(":", "kind", "name").alias("t")).alias("_h"))
    return hits.groupBy("case_id", "profile_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("_h")), lambda h: h["t"]), ",").alias("selected_by"))


def unknown_selectors(profiles: DataFrame, selectors: DataFrame) -> DataFrame:
    """Selectors that name nothing in the library."""
    return selectors.join(_tags(profiles).select("kind", "name").distinct(), ["kind", "name"], "left_anti")


def exclude_and_recompute(matches: DataFrame, excluded: DataFrame) -> DataFrame:
    """Coverage and metrics of the baseline and of what remains.

    One group-by over the rows gives sums per profile; both states are sums of those.
    """
    r = F.when(F.col("accepted"), F.col("residual"))
    per = matches.groupBy("case_id", "profile_id").agg(
        F.count("*").alias("n"), F.count_if("accepted").alias("ok"), F.count(r).alias("_r0"), F.sum(r).alias("_r1"), F.sum(r * r).alias("_r2"), F.sum(F.abs(r)).alias("_ra"), F.max(F.abs(r)).alias("_rx"))
    marked = per.join(excluded.select("case_id", "profile_id", F.lit(True).alias("_out")), ["case_id", "profile_id"], "left")
    states = F.when(F.col("_out"), F.array(F.lit("baseline"))).otherwise(F.array(F.lit("baseline"), F.lit("modified")))
    count = F.sum("_r0")
    share = lambda c: F.when(count > 0, F.sum(c) / count)
    return marked.withColumn("state", F.explode(states)).groupBy("case_id", "state").agg(
        F.count("*").alias("total_profiles"), F.count_if(F.col("ok") > 0).alias("matched_profiles"), F.sum("n").alias("total_samples"),
        (F.sum("n") - F.sum("ok")).alias("excluded_samples"), count.alias("matched"), share("_r1").alias("bias"), F.sqrt(share("_r2")).alias("rmse"), share("_ra").alias("mae"),
        F.max("_rx").alias("max_abs_residual"))


def profile_effects(matches: DataFrame, excluded: DataFrame) -> DataFrame:
    """Baseline, remaining and removed eligible samples of each profile."""
    per = matches.groupBy("case_id", "profile_id").agg(F.count_if("accepted").alias("baseline_matched"))
    out = F.col("selected_by").isNotNull()
    return per.join(excluded, ["case_id", "profile_id"], "left").select(
        "case_id", "profile_id", out.alias("excluded_by_user"), F.coalesce("selected_by", F.lit("")).alias("selected_by"), "baseline_matched",
        F.when(out, 0).otherwise(F.col("baseline_matched")).alias("remaining_matched"), F.when(out, F.col("baseline_matched")).otherwise(0).alias("removed_eligible"))


def removed_samples(matches: DataFrame, excluded: DataFrame) -> DataFrame:
    """The removed eligible samples, one row each."""
    return matches.filter("accepted").join(excluded, ["case_id", "profile_id"], "left_semi").select("case_id", "profile_id", "sample_index")


def six_digits(x: Column) -> Column:
    """Six significant digits without trailing zeros; powers of ten below 1e-4 and from 1e6 on are written out, as in ``1.5e-05``."""
    written = F.format_string("%.5e", x)
    power = F.substring_index(written, "e", -1).cast("int")
    mantissa = F.regexp_replace(F.substring_index(written, "e", 1), r"\.?0+$", "")
    scale = F.pow(F.lit(10.0), F.lit(5) - power)
    plain = F.regexp_replace(F.format_string("%.9f", F.rint(x * scale) / scale), r"\.?0+$", "")
    signed = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.format_string("%02d", F.abs(power)))
    return F.when(x == 0, F.lit("0")).when((power < -4) | (power > 5), signed).otherwise(plain)


def statements_changed(states: DataFrame, units: str) -> DataFrame:
    """E5: the stated evidence before and after, and whether it changed."""
    # The statement ids and sentences below are compared as text.
    residual = F.when(F.col("matched") > 0, F.concat(
        F.lit("Model minus observed: bias "), six_digits(F.col("bias")), F.lit(f" {units}, RMSE "), six_digits(F.col("rmse")),
        F.lit(f" {units}, MAE "), six_digits(F.col("mae")), F.lit(f" {units}; equal weight per eligible sample."))).otherwise(
        F.lit("No eligible model-observation pairs remain; residual statistics are unavailable."))
    texts = {
        "eligible_profiles": F.concat(F.col("matched_profiles").cast("string"), F.lit(" profiles supply eligible comparisons under the selected matching rules.")),
        "eligible_samples": F.concat(F.col("matched").cast("string"), F.lit(" eligible model-observation pairs are available.")),
        "residual_statistics": residual,
        "model_state": F.lit("The original ocean model and observation quality flags are unchanged."),
    }
    numbers = F.struct("matched", "bias", "rmse", "mae", "max_abs_residual")
    rows = states.select("case_id", "state", numbers.alias("_m"), F.inline(F.array(*[F.struct(F.lit(k).alias("id"), v.alias("text")) for k, v in texts.items()])))
    def side(state, c):
        return F.max_by(c, F.when(F.col("state") == state, 1))
    wide = rows.groupBy("case_id", "id").agg(side("baseline", "text").alias("baseline"), side("modified", "text").alias("modified"),
                                             side("baseline", "_m").alias("_a"), side("modified", "_m").alias("_b"))
    changed = F.when(F.col("id") == "residual_statistics", ~F.col("_a").eqNullSafe(F.col("_b"))).otherwise(~F.col("baseline").eqNullSafe(F.col("modified")))
    return wide.select("case_id", "id", "baseline", "modified", changed.alias("changed"))


def consistency_checks(matches: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row per named identity between match rows and the coverage table."""
    per = matches.groupBy("case_id", "profile_id").agg(F.count("*").alias("n"), F.count_if("accepted").alias("ok"), F.count_distinct("setting_id").alias("s"))
    both = per.join(coverage.groupBy("case_id", "profile_id").agg(F.count("*").alias("rows"), F.sum("total").alias("t"), F.sum("matched").alias("m")), ["case_id", "profile_id"], "full")
    checks = {"profile_ids_unique": F.bool_and(F.coalesce(F.col("rows") == 1, F.lit(False))), "same_library": F.bool_and(F.col("n").isNotNull() & F.col("t").isNotNull()),
              "one_setting": F.bool_and(F.col("s") == 1), "counts_agree": F.bool_and((F.col("n") == F.col("t")) & (F.col("ok") == F.col("m")))}
    wide = both.groupBy("case_id").agg(*[v.alias(k) for k, v in checks.items()])
    return wide.select("case_id", F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("passed")) for k in checks])))


def group_membership(profiles: DataFrame) -> DataFrame:
    """Members of every instrument, platform and collection, one row each with the group's size."""
    tags = _tags(profiles).filter(F.col("kind") != "profile").distinct()
    sizes = tags.groupBy("case_id", "kind", "name").agg(F.count("*").alias("members"))
    return tags.join(sizes, ["case_id", "kind", "name"])
