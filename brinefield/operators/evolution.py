"""Correspondence of threshold regions between consecutive frames.

A node is a region in one frame. All cases, thresholds and frame pairs run in
the same joins, keyed by ``(case_id, threshold_id, it)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinefield.functions.scalars import hours_between
from brinefield.operators.components import nested_components
from brinefield.operators.regions import KEYS, REGION
from brinefield.runtime import cut

PAIR = ["case_id", "threshold_id", "it", "next_it"]


def frame_steps(frames: DataFrame, cadence_hours: float = 12.0) -> DataFrame:
    """Consecutive selected frames; skipped indices or another interval make a gap."""
    w = Window.partitionBy("case_id").orderBy("it")
    steps = frames.select("case_id", "it", "ts", F.lead("it").over(w).alias("next_it"), F.lead("ts").over(w).alias("next_ts")).filter("next_it is not null")
    elapsed = hours_between(F.col("next_ts"), F.col("ts"))
    status = F.when((F.col("next_it") == F.col("it") + 1) & (F.col("elapsed_hours") == cadence_hours), "compared").otherwise("gap")
    return steps.withColumn("elapsed_hours", elapsed).withColumn("status", status).select("case_id", "it", "next_it", "elapsed_hours", "status")


def overlap_pairs(labels: DataFrame, steps: DataFrame) -> DataFrame:
    """Shared cells and volume of every pair of regions in compared frames."""
    now = labels.join(steps.filter(F.col("status") == "compared").select("case_id", "it", "next_it"), ["case_id", "it"])
    now = now.select(*PAIR, "flat", "volume", F.col("label").alias("source"))
    then = labels.select("case_id", "threshold_id", F.col("it").alias("next_it"), "flat", F.col("label").alias("target"))
    return (now.join(then, ["case_id", "threshold_id", "next_it", "flat"])
            .groupBy(*PAIR, "source", "target").agg(F.count("*").alias("shared_cells"), F.sum("volume").alias("overlap_km3")))


def overlap_links(pairs: DataFrame, regions: DataFrame, minimum: float) -> DataFrame:
    """Pairs whose overlap, over the smaller volume, reaches the minimum."""
    size = regions.select(*KEYS, "label", F.col("volume_km3").alias("v"))
    left = size.select("case_id", "threshold_id", "it", F.col("label").alias("source"), F.col("v").alias("sv"))
    right = size.select("case_id", "threshold_id", F.col("it").alias("next_it"), F.col("label").alias("target"), F.col("v").alias("tv"))
    joined = pairs.join(left, ["case_id", "threshold_id", "it", "source"]).join(right, ["case_id", "threshold_id", "next_it", "target"])
    score = F.col("overlap_km3") / F.least("sv", "tv")
    return (joined.filter((F.col("overlap_km3") > 0) & (F.least("sv", "tv") > 0)).withColumn("coefficient", score).filter(F.col("coefficient") >= minimum)
            .select(*PAIR, "source", "target", "shared_cells", "overlap_km3", (F.col("overlap_km3") / F.col("sv")).alias("source_fraction"),
                    (F.col("overlap_km3") / F.col("tv")).alias("target_fraction"), "coefficient"))


def classify_links(links: DataFrame) -> DataFrame:
    """Continuation, split, merge or ambiguous, by the whole bipartite group of a link.

    A link whose both ends have no other is a group of its own. The rest merge as sources
    and targets of one id space (even and odd), near ids within a task first.
    """
    degree = lambda end, name: links.groupBy(*PAIR, end).agg(F.count("*").alias(name))
    counted = cut(links.join(degree("source", "_ds"), [*PAIR, "source"]).join(degree("target", "_dt"), [*PAIR, "target"]).select(*links.columns, "_ds", "_dt"))
    single = (F.col("_ds") == 1) & (F.col("_dt") == 1)
    edges = counted.filter(~single).select(*PAIR, (F.col("source") * 2).alias("a"), (F.col("target") * 2 + 1).alias("b"), F.lit(0).alias("level"))
    roots = nested_components(edges, PAIR).drop("level")
    marked = counted.withColumn("node", F.col("source") * 2).join(roots, [*PAIR, "node"], "left").withColumn("grp", F.coalesce("root", "node")).drop("root", "node")
    ends = marked.groupBy(*PAIR, "grp").agg((F.min("source") == F.max("source")).alias("_one_source"), (F.min("target") == F.max("target")).alias("_one_target"))
    kind = (F.when(F.col("_one_source") & F.col("_one_target"), "continuation").when(F.col("_one_source"), "split").when(F.col("_one_target"), "merge").otherwise("ambiguous"))
    return marked.drop("_ds", "_dt").join(ends.withColumn("classification", kind).drop("_one_source", "_one_target"), [*PAIR, "grp"])


def unmatched_nodes(labels: DataFrame, regions: DataFrame, links: DataFrame, cells: DataFrame, steps: DataFrame) -> DataFrame:
    """Nodes without a link, unresolved when a member cell is missing in the counterpart frame."""
    compared = steps.filter(F.col("status") == "compared").select("case_id", "it", "next_it")
    valid = cells.filter(F.col("value").isNotNull()).select("case_id", F.col("it").alias("other_it"), "iz", "iy", "ix", F.lit(1).alias("_seen"))
    out = None
    for own, other, end, relation in (("it", "next_it", "source", "no_successor"), ("next_it", "it", "target", "no_predecessor")):
        pairs = compared.select("case_id", F.col(own).alias("it"), F.col(other).alias("other_it"))
        linked = links.select("case_id", "threshold_id", F.col(own).alias("it"), F.col(end).alias("label")).distinct()
        alone = regions.select(*REGION).join(pairs, ["case_id", "it"]).join(linked, REGION, "left_anti")
        members = labels.select(*REGION, "iz", "iy", "ix").join(alone, REGION)
        counted = (members.join(valid, ["case_id", "other_it", "iz", "iy", "ix"], "left").groupBy(*REGION, "other_it")
                   .agg((F.count("*") - F.count("_seen")).alias("missing_cells")))
        part = counted.select(*REGION, "other_it", F.lit(relation).alias("relation"), "missing_cells",
                              F.when(F.col("missing_cells") > 0, "incomplete_support").otherwise("no_qualifying_overlap").alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out


def gap_nodes(regions: DataFrame, steps: DataFrame) -> DataFrame:
    """Every node on either side of a gap is unresolved."""
    gaps = steps.filter(F.col("status") == "gap")
    ends = gaps.select("case_id", F.col("it"), F.lit("source").alias("side")).unionByName(gaps.select("case_id", F.col("next_it").alias("it"), F.lit("target").alias("side")))
    return regions.select(*REGION).join(ends, ["case_id", "it"]).select(*REGION, "side")


def transition_table(regions: DataFrame, classified: DataFrame, unmatched: DataFrame, steps: DataFrame) -> DataFrame:
    """One row per frame pair with link, group and unmatched counts."""
    rules = regions.select("case_id", "threshold_id").distinct()
    base = steps.join(rules, "case_id")
    groups = classified.select(*PAIR, "grp", "classification").distinct().groupBy(*PAIR).agg(
        *[F.count_if(F.col("classification") == k).alias(f"{k}_count") for k in ("split", "merge", "ambiguous")])
    links = classified.groupBy(*PAIR).agg(F.count("*").alias("link_count"))
    first = F.when(F.col("relation") == "no_successor", F.col("it")).otherwise(F.col("other_it"))
    kinds = unmatched.withColumn("_first", first).groupBy("case_id", "threshold_id", F.col("_first").alias("it")).agg(
        F.count_if((F.col("relation") == "no_successor") & (F.col("missing_cells") == 0)).alias("disappeared_count"),
        F.count_if((F.col("relation") == "no_predecessor") & (F.col("missing_cells") == 0)).alias("appeared_count"),
        F.count_if(F.col("missing_cells") > 0).alias("_open"))
    counts = regions.groupBy(*KEYS).agg(F.count("*").alias("_n"))
    before = counts.select("case_id", "threshold_id", "it", F.col("_n").alias("_nb"))
    after = counts.select("case_id", "threshold_id", F.col("it").alias("next_it"), F.col("_n").alias("_na"))
    out = (base.join(groups, PAIR, "left").join(links, PAIR, "left").join(kinds, ["case_id", "threshold_id", "it"], "left")
           .join(before, ["case_id", "threshold_id", "it"], "left").join(after, ["case_id", "threshold_id", "next_it"], "left"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    unresolved = F.when(F.col("status") == "gap", z("_nb") + z("_na")).otherwise(z("_open"))
    return out.select(*PAIR, "elapsed_hours", "status", *[z(c).alias(c) for c in (
        "link_count", "split_count", "merge_count", "ambiguous_count", "appeared_count", "disappeared_count")], unresolved.alias("unresolved_count"))


def evolution_summary(regions: DataFrame, transitions: DataFrame, frames: DataFrame) -> DataFrame:
    """Counts over all frames and transitions of a case and threshold."""
    nodes = regions.groupBy("case_id", "threshold_id").agg(F.count("*").alias("node_count"))
    count = frames.groupBy("case_id").agg(F.count("*").alias("frame_count"))
    sums = transitions.groupBy("case_id", "threshold_id").agg(
        F.count("*").alias("transition_count"), F.count_if(F.col("status") == "gap").alias("gap_count"),
        *[F.sum(f"{c}_count").alias(f"{c}_count") for c in ("link", "split", "merge", "ambiguous", "appeared", "disappeared", "unresolved")])
    return sums.join(nodes, ["case_id", "threshold_id"]).join(count, "case_id")


def frame_summary(regions: DataFrame) -> DataFrame:
    """Regions, qualified cells and volume per frame and threshold."""
    return regions.groupBy(*KEYS).agg(F.count("*").alias("region_count"), F.sum("cell_count").alias("qualified_cells"), F.sum("volume_km3").alias("volume_km3"))
