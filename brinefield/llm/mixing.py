"""Mixing sources to target weights by whole copies.

Words are summed per source (partial sums in the scan stage, so a hot source costs one
row per task). The small table of sources gets its targets by closed-form water filling:
with sources in order of cap over weight, those below the level stop at their cap and the
rest share by weight. A source's rate is target over size. Each document goes out
floor(rate) times, plus once more when a hash of seed, id and text falls below the
fraction, so reruns, retries and other partitionings agree.

The table of sources is written before the join. Its true size is known then, so texts stay
where they lie; a join with an aggregate would shuffle and sort all texts by source first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinefield.llm.common import fresh_name, WORD, whole_text
from brinefield.runtime import cut

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, words of the whole text, and a digest of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size"), F.md5(whole_text().cast("binary")).alias("text_md5"))


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``(source, source_size, target, rate)``: one row per source.

    Sources in code-point order, null last, take the weights in turn. The windows run over
    the aggregated table: one row per source. A source without words has target and rate 0.
    """
    table = F.array(*[F.lit(float(w)) for w in weights])
    listed = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    ranked = listed.withColumn("_w", F.element_at(table, ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.lit(float(most)) * F.col("source_size")).withColumn("_total", F.sum("source_size").over(everything))
    by_level = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (ranked.withColumn("_used", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
              .withColumn("_weights", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
              .withColumn("_level", (F.col("_total") - F.col("_used")) / F.col("_weights"))
              .withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap")))
    first = F.min(F.when(F.col("_fits"), F.struct((F.col("_cap") / F.col("_w")).alias("at"), F.col("source").isNull(), "source", F.col("_level").alias("level"))))
    ranked = ranked.withColumn("_final", first.over(everything)["level"])
    target = F.least(F.col("_cap"), F.coalesce(F.col("_final") * F.col("_w"), F.col("_cap")))
    return ranked.select("source", "source_size", target.alias("target"),
                         F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(0.0).alias("rate"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an md5 over the parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    Null and empty texts have size 0 and take nothing but still go out as often as their
    source's rate says. Null is a source of its own. Rows that repeat id and text draw the
    same number. An empty table gives no rows.
    """
    sized = sizes(docs)
    plan = cut(targets(sized, weights, most).withColumnRenamed("source", "_source"))
    joined = sized.join(plan, sized["source"].eqNullSafe(F.col("_source")), "left")
    copies = F.floor("rate") + (uniform(F.lit(seed), F.col("doc_id"), F.col("text_md5")) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def emit(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mixed table: every row of ``docs`` as often as the mix takes it, all columns kept."""
    source, rate, copies, copy = (fresh_name(docs, n) for n in ("_source", "_rate", "_copies", "_copy"))
    plan = cut(targets(sizes(docs), weights, most).select(F.col("source").alias(source), F.col("rate").alias(rate)))
    joined = docs.join(plan, docs["source"].cast("string").eqNullSafe(plan[source]), "left")
    draw = uniform(F.lit(seed), F.col("doc_id").cast("long"), F.md5(whole_text().cast("binary")))
    times = (F.floor(rate) + (draw < F.col(rate) - F.floor(rate)).cast("long")).cast("int")
    return joined.withColumn(copies, times).withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).select(*docs.columns)
