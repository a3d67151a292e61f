"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]

#: The white space of the word and line rules.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Text that a Python task turns into objects at a time. A worker keeps what its largest step took, and the next stages run beside that.
SLICE_BYTES = 1 << 20

#: Most bytes of rows that Spark hands a Python task of a step over whole texts at a time. By count alone a batch is 10,000 texts, some 35 MB, which the JVM and the worker each hold
#: beside their heaps, and keep for what follows.
BATCH_BYTES = 4 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

_shipped: set[str] = set()


def ship(spark: SparkSession, small: bool = False) -> SparkSession:
    """Send this package's code to the executors once per application, so that their Python workers can import it.

    ``small`` batches hold ``BATCH_BYTES`` at most, until a step without them is built; they only save memory. A limit that the session has set itself stays.
    """
    limit = spark.conf.get(BATCH_LIMIT, None)
    if small and limit is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    elif not small and limit == str(BATCH_BYTES):
        spark.conf.unset(BATCH_LIMIT)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        target = Path(tempfile.mkdtemp(prefix="code-")) / f"{PACKAGE.name}.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for path in sorted(PACKAGE.rglob("*.py")):
                archive.write(path, path.relative_to(PACKAGE.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/labels.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet")


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows of a batch in order, in views of about ``most`` bytes of one string or binary column; a longer value comes alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < batch.num_rows:
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def whole_text(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id's text modulo ``parts``; null ids fall into fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts, F.lit(0).cast("bigint"))


def fresh_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``docs`` has it (names are compared without case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's vocabulary file; it is installed on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)
