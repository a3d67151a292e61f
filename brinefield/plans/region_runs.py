"""The whole region-correspondence analysis as a set of tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from brinefield.operators import evolution as ev
from brinefield.operators import regions as rg
from brinefield.runtime import cut


@dataclass(frozen=True)
class Evolution:
    labels: DataFrame
    regions: DataFrame
    steps: DataFrame
    links: DataFrame
    unmatched: DataFrame
    transitions: DataFrame
    summary: DataFrame
    sensitivity: DataFrame


def label_regions(cells: DataFrame, index: DataFrame, rules: Sequence[dict], depth_min: float, depth_max: float) -> DataFrame:
    """Labels of every rule: nested ones in one labelling, others side by side."""
    order = rg.nested_order(rules)
    if order is not None and len(order) > 1:
        return rg.nested_regions(cells, index, order, depth_min, depth_max)
    return rg.connected_regions(rg.threshold_mask(cells, index, rules, depth_min, depth_max))


def evolve(cells: DataFrame, index: DataFrame, frames: DataFrame, rules: Sequence[dict], depth_min: float, depth_max: float,
           minimum_overlap: float, cadence_hours: float = 12.0) -> Evolution:
    """Labels and region sizes are written once; every later table reads them."""
    labels = cut(label_regions(cells, index, rules, depth_min, depth_max))
    regions = cut(rg.region_stats(labels, index))
    steps = ev.frame_steps(frames, cadence_hours)
    links = cut(ev.classify_links(cut(ev.overlap_links(ev.overlap_pairs(labels, steps), regions, minimum_overlap))))
    unmatched = ev.unmatched_nodes(labels, regions, links, cells, steps)
    transitions = ev.transition_table(regions, links, unmatched, steps)
    return Evolution(labels, regions, steps, links, unmatched, transitions, ev.evolution_summary(regions, transitions, frames), ev.frame_summary(regions))
