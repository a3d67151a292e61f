"""Connected components by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Edges
are rows ``(keys, hi, lo)`` with ``hi > lo``; many graphs run side by side,
told apart by ``keys``. A star is a group-by for the smallest neighbour (with
map-side minima) and a join with that one-row-per-node table, so a hub that
holds most edges is a skewed join side, which adaptive execution splits, and
never a group in one task. State is written after every star: lineage stays
short, a lost executor costs one step, and Catalyst sees the true size. All
sizes take the same path, for as many rounds as the graph needs.

Where node numbers are positions, ``nested_components`` first merges what lies within
blocks of numbers: each block is one small task-local forest, and only edges that cross
blocks enter the rounds. Edges may have levels; the components of all levels come from one
pass that adds edges from the lowest level upwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinefield.runtime import cut, free


def _large_star(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour."""
    lowest = edges.groupBy(*keys, F.col("hi").alias("lo")).agg(F.min("lo").alias("low"))
    return edges.join(lowest, [*keys, "lo"], "left").select(*keys, "hi", F.coalesce("low", "lo").alias("lo")).distinct()


def _small_star(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    lowest = edges.groupBy(*keys, "hi").agg(F.min("lo").alias("low"))
    own = F.when(F.col("lo") == F.col("low"), F.col("hi")).otherwise(F.col("lo"))
    pairs = edges.join(lowest, [*keys, "hi"]).select(*keys, F.array(F.struct("hi", F.col("low").alias("lo")), F.struct(own.alias("hi"), F.col("low").alias("lo"))).alias("_p"))
    return pairs.select(*keys, F.inline("_p")).distinct()


def _unsettled(edges: DataFrame, keys: Sequence[str]) -> bool:
    """Whether a node still hangs on two others or a root still hangs."""
    down = edges.groupBy(*keys, F.col("hi").alias("node")).agg(F.count("*").alias("n"), F.lit(0).alias("r"))
    root = edges.groupBy(*keys, F.col("lo").alias("node")).agg(F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("r"))
    nodes = down.unionByName(root).groupBy(*keys, "node").agg(F.sum("n").alias("n"), F.max("r").alias("r"))
    return not nodes.filter((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("r") > 0))).isEmpty()


def components(edges: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Map ``(keys, node)`` to the smallest node of its component (roots are not listed)."""
    keys = list(keys)
    state = cut(edges.select(*keys, F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
                .filter(F.col("hi") != F.col("lo")).distinct())
    while _unsettled(state, keys):
        large = cut(_large_star(state, keys))
        free(state)
        state = cut(_small_star(large, keys))
        free(large)
    return state.select(*keys, F.col("hi").alias("node"), F.col("lo").alias("root"))


BLOCK = 1 << 16


def smallest_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the edges ``a - b`` join the components that ``root`` describes: every node gets its smallest one."""
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further


def _merge_blocks(n_keys: int, levels: int):
    """Rows (keys, block, a, b, level) arrive by keys and block. A block is held until it is whole."""
    def merged(table: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        a, b, level = (table.column(n_keys + k).to_numpy() for k in (1, 2, 3))
        pairs = np.empty(2 * a.size, [("g", np.int64), ("n", np.int64)])
        pairs["g"], pairs["n"] = np.concatenate([group, group]), np.concatenate([a, b])
        nodes, first, inverse = np.unique(pairs, return_index=True, return_inverse=True)
        a, b = inverse[:a.size], inverse[a.size:]
        root, rows, number, roots = np.arange(nodes.size), [], [], []
        for t in range(levels):
            now = level == t
            root = smallest_roots(root, a[now], b[now])
            hang = np.flatnonzero(root != np.arange(nodes.size))
            rows.append(hang)
            number.append(np.full(hang.size, t, np.int32))
            roots.append(nodes["n"][root[hang]])
        at = np.concatenate(rows)
        keys = [table.column(k).combine_chunks().take(pa.array(first[at] % group.size)) for k in range(n_keys)]
        return pa.RecordBatch.from_arrays([*keys, pa.array(np.concatenate(number)), pa.array(nodes["n"][at]), pa.array(np.concatenate(roots))],
                                          names=[*table.column_names[:n_keys], "level", "node", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            group = _group_numbers(table, n_keys + 1)
            whole = int(np.searchsorted(group, group[-1]))
            if whole:
                yield merged(table.slice(0, whole), group[:whole])
                held = table.slice(whole).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield merged(table, _group_numbers(table, n_keys + 1))
    return run


def _group_numbers(table: pa.Table, columns: int) -> np.ndarray:
    """0, 1, ... for rows that agree in the first ``columns``, which are sorted."""
    new = np.zeros(table.num_rows, bool)
    for k in range(columns):
        column = table.column(k).combine_chunks()
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def nested_components(edges: DataFrame, keys: Sequence[str], levels: int = 1, block: int = BLOCK) -> DataFrame:
    """``(keys, level, node, root)`` from edges ``(keys, a, b, level)``: the smallest node that edges of that level or below reach.

    Roots are not listed. Keys are not null; levels count from 0 up to ``levels``. The rounds
    for what crosses blocks of ``block`` numbers run for all levels together.
    """
    keys = list(keys)
    home = [F.floor(F.col(c) / block).alias(n) for c, n in (("a", "_ba"), ("b", "_bb"))]
    placed = cut(edges.select(*keys, "a", "b", F.col("level").cast("int").alias("level"), *home))
    fields = [placed.schema[k] for k in keys]
    out = T.StructType([*fields, T.StructField("level", T.IntegerType()), T.StructField("node", T.LongType()), T.StructField("root", T.LongType())])
    inside = placed.filter("_ba = _bb").select(*keys, "_ba", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "level")
    local = cut(inside.repartition(*keys, "_ba").sortWithinPartitions(*keys, "_ba").mapInArrow(_merge_blocks(len(keys), levels), out))
    across = placed.filter("_ba != _bb").select(*keys, F.explode(F.sequence("level", F.lit(levels - 1))).alias("level"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    if across.isEmpty():
        return local
    keyed = [*keys, "level"]
    for end in ("a", "b"):
        named = local.select(*keyed, F.col("node").alias(end), F.col("root").alias("_root"))
        across = across.join(named, [*keyed, end], "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    top = components(across.distinct(), keyed)
    higher = top.select(*keyed, F.col("node").alias("root"), F.col("root").alias("_top"))
    lifted = local.join(higher, [*keyed, "root"], "left").select(*keyed, "node", F.coalesce("_top", "root").alias("root"))
    return lifted.unionByName(top.select(*keyed, "node", "root"))
