"""Session settings and lineage cuts shared by the operators.

No operator hints a broadcast. Side tables that must be small (axes, cases,
settings) come from written tables, so Catalyst knows their size and picks a
broadcast join only under ``spark.sql.autoBroadcastJoinThreshold``; past that
it falls back to a shuffle join, where adaptive skew handling applies.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}

_scratch: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators assume; safe to call repeatedly."""
    for key, value in SESSION_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared scratch folder: the cluster's ``spark.checkpoint.dir`` when it names one.

    Only a local master may fall back to a private folder; on a cluster a
    machine-local path would lose the cut tables with their executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a shared folder before running iterative operators.")
    if context.applicationId not in _scratch:
        _scratch[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _scratch[context.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage for iterative operators and gives Catalyst the true size of
    derived side tables. The written files survive the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal ``df`` by ``keys`` over a fixed number of partitions, twice the session's.

    Adaptive execution merges partitions by their compressed size and does not see what a step
    makes of them afterwards, such as a calendar for every key or a table of distinct names. A
    given number stays; one equal to the session's would be dropped after a group-by of the same keys.
    """
    return df.repartition(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``cut`` with aggregates of the same rows, counted by the write itself instead of a pass of their own."""
    watch = Observation()
    return cut(df.observe(watch, *[value.alias(name) for name, value in metrics.items()])), watch.get


def free(df: DataFrame) -> None:
    """Delete the files behind a ``cut`` that nothing reads any more; other frames are left alone."""
    path = getattr(df, "_cut_path", None)
    if path is not None:
        context = df.sparkSession.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
