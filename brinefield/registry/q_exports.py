"""Exported result tables (S25): each is written as the guarded files of its analysis and read back."""

import uuid

from pyspark.sql import functions as F

from brinefield.operators import exclusion as ex
from brinefield.registry import q_collocation as qco
from brinefield.registry import q_exclusion as qex
from brinefield.registry import q_regions as qre
from brinefield.registry.core import query
from brinefield.registry.projections import Inputs
from brinefield.runtime import checkpoint_root, cut
from brinefield.sources import tables

META = {"method_version": "m1"}


def exported(i: Inputs, given: dict, name: str):
    """All tables of an analysis go out; the named one comes back."""
    root = f"{checkpoint_root(i.spark)}/export-{uuid.uuid4().hex}"
    tables.export_tables(given, root, META)
    return tables.read_exported(i.spark, root, name, tables.guarded(given[name], META).schema)


def leave_out(i):
    matches, excluded = cut(qco.matches(i)), cut(qex.excluded(i))
    states = ex.exclude_and_recompute(matches, excluded)
    return tables.exclusion_tables(states, ex.profile_effects(matches, excluded), ex.removed_samples(matches, excluded), ex.statements_changed(states, "°C"))


@query("S25_exclusion_profiles", """
SELECT 'm1' AS method_version, m.case_id, m.profile_id, e.selected_by IS NOT NULL AS excluded_by_user, e.selected_by, count(residual) AS baseline_matched,
  CASE WHEN e.selected_by IS NULL THEN count(residual) ELSE 0 END AS remaining_matched, CASE WHEN e.selected_by IS NULL THEN 0 ELSE count(residual) END AS removed_eligible
FROM match m LEFT JOIN excluded e USING (case_id, profile_id) GROUP BY m.case_id, m.profile_id, e.selected_by""", ("match", "excluded"))
def s25_profiles(i):
    out = exported(i, leave_out(i), "blackout-profiles")
    return out.withColumn("selected_by", F.nullif("selected_by", F.lit("")))


@query("S25_exclusion_removed", "SELECT 'm1' AS method_version, case_id, profile_id, sample_index FROM match JOIN excluded USING (case_id, profile_id) WHERE accepted", ("match", "excluded"))
def s25_removed(i):
    return exported(i, leave_out(i), "blackout-removed-sample-identifiers")


@query("S25_evolution_links", f"""
SELECT 'm1' AS method_version, {qre.K3}, next_it, l.source, l.target, classification, shared_cells, round(overlap_km3, 3) AS overlap_km3,
  't' || CAST(it AS VARCHAR) || ':r' || CAST(l.source AS VARCHAR) AS source_node_id, 't' || CAST(next_it AS VARCHAR) || ':r' || CAST(l.target AS VARCHAR) AS target_node_id
FROM rb_links l JOIN rb_groups USING ({qre.K3}, next_it, source)""", ("rb_groups",))
def s25_links(i):
    out = exported(i, tables.evolution_tables(qre.run(i)), "evolution-links")
    return out.withColumn("overlap_km3", F.round("overlap_km3", 3)).drop("source_fraction", "target_fraction", "coefficient")


@query("S25_evolution_regions", f"""SELECT 'm1' AS method_version, {qre.K3}, label, 't' || CAST(it AS VARCHAR) || ':r' || CAST(label AS VARCHAR) AS node_id, cells AS cell_count, round(volume_km3, 3) AS volume_km3
FROM rb_regions""", ("rb_regions",))
def s25_regions(i):
    out = exported(i, tables.evolution_tables(qre.run(i)), "evolution-regions")
    return out.select("method_version", "case_id", "threshold_id", "it", "label", "node_id", "cell_count", F.round("volume_km3", 3).alias("volume_km3"))
