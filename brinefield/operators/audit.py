"""Integrity: table equality, fingerprints, replay and file manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinefield.functions.digest import canonical_text, multiset_digest


def tables_equal(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Value-and-mask equality of two copies; null equals null only."""
    keys, by = list(keys), list(by)
    left = a.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("_a"))
    right = b.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("_b"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return left.join(right, keys, "full").groupBy(*by).agg(
        F.count("*").alias("keys"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_b").isNull()).alias("only_a"),
        F.count_if(both & ~same).alias("different"), F.bool_and(both & same).alias("equal"))


def fingerprint(df: DataFrame, *keys: str) -> DataFrame:
    """Order-free digest of a result, per key group or whole; map-side sums, no collected list."""
    body = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), multiset_digest(canonical_text(df, body)).alias("fingerprint"))


def replay(saved: DataFrame, current: DataFrame) -> DataFrame:
    """Outcome of recomputing saved runs; the first differing part names the mismatch.

    Both sides: ``(run_id, recipe_sha, method, source_sha, result_sha)``.
    """
    parts = ("recipe_sha", "method", "source_sha", "result_sha")
    now = current.select("run_id", *[F.col(p).alias(f"n_{p}") for p in parts], F.lit(True).alias("_n"))
    outcome = F.when(F.col("_n").isNull(), "source_unavailable")
    for part, name in zip(parts, ("recipe_mismatch", "method_mismatch", "source_mismatch", "result_mismatch")):
        outcome = outcome.when(~F.col(part).eqNullSafe(F.col(f"n_{part}")), name)
    return saved.join(now, "run_id", "left").select("run_id", outcome.otherwise("matched").alias("outcome"))


def inventory(files: DataFrame, path: str, content: str) -> DataFrame:
    """Relative path, bytes and sha256 of each file's content column."""
    body = F.col(content).cast("binary")
    return files.select(F.col(path).alias("path"), F.octet_length(body).cast("bigint").alias("bytes"), F.sha2(body, 256).alias("sha256"))


def inventory_budget(files: DataFrame, max_bytes: int, max_file: int, max_files: int) -> DataFrame:
    """Totals and whether the tree keeps within its budgets."""
    return files.agg(F.count("*").alias("files"), F.sum("bytes").alias("total_bytes"), F.max("bytes").alias("largest"),
                     ((F.sum("bytes") <= max_bytes) & (F.max("bytes") <= max_file) & (F.count("*") <= max_files)).alias("within_budget"))


def tree_source():
    """A Spark data source over a folder's files: ``path`` below the root, ``bytes`` and ``sha256``.

    Partitions are runs of files of some 256 MB. A file streams through the hash a
    megabyte at a time, so its size does not matter. (Built in a function, so that it
    travels to the workers by value.)
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Files(InputPartition):
        def __init__(self, paths):
            self.paths = paths

    class TreeReader(DataSourceReader):
        def __init__(self, root):
            self.root = root

        def opened(self):
            from pyarrow import fs
            return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)

        def partitions(self):
            from pyarrow import fs
            store, base = self.opened()
            found = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File)
            runs, size = [[]], 0
            for path, n in found:
                if runs[-1] and size + n > 256 << 20:
                    runs.append([])
                    size = 0
                runs[-1].append(path)
                size += n
            return [Files(run) for run in runs]

        def read(self, partition):
            import hashlib
            store, base = self.opened()
            for path in partition.paths:
                digest, size = hashlib.sha256(), 0
                with store.open_input_stream(path) as stream:
                    while piece := stream.read(1 << 20):
                        digest.update(piece)
                        size += len(piece)
                yield path[len(base.rstrip("/")) + 1:], size, digest.hexdigest()

    class Tree(DataSource):
        @classmethod
        def name(cls):
            return "file_tree"

        def schema(self):
            return "path string, bytes bigint, sha256 string"

        def reader(self, schema):
            return TreeReader(self.options["path"])

    return Tree


def read_tree(spark, root: str) -> DataFrame:
    """Inventory of a folder, hidden files included; files of any size stream through the hash."""
    spark.dataSource.register(tree_source())
    return spark.read.format("file_tree").load(root)


def audit_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Ok, missing, mismatch or undeclared per file; a manifest without bytes checks the hash only."""
    m = manifest.select("path", F.col("bytes").alias("declared_bytes"), F.col("sha256").alias("declared_sha256"), F.lit(True).alias("_m"))
    both = files.withColumn("_f", F.lit(True)).join(m, "path", "full")
    bad: Column = (F.col("sha256") != F.col("declared_sha256")) | (F.col("declared_bytes").isNotNull() & (F.col("bytes") != F.col("declared_bytes")))
    status = F.when(F.col("_f").isNull(), "missing").when(F.col("_m").isNull(), "undeclared").when(bad, "mismatch").otherwise("ok")
    return both.select("path", status.alias("status"))
