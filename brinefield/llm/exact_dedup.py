"""Exact copies through a live index: cuckoo filters in front of stored digests.

The index is one table of two kinds of rows, dealt over shards by digest:

* ``FILTER``: a shard's cuckoo filter (16-bit fingerprints, four to a bucket);
* ``STORED``: a live digest with its number of live documents and its largest doc_id.

``maintain`` streams a shard's rows through one task in the order filter, stored
digests, insertions, deletions. An insertion first asks the filter. A miss proves
the digest new. A hit is verified against the stored digests of the same bucket,
so a fingerprint that only happens to be equal never merges two texts. A failed
eviction chain doubles the shard's filter and refills it from the stored digests.
A digest whose last live document goes leaves the filter too.

Digests of one input batch are combined before the shuffle, so a text that holds a
third of all rows costs one row per batch. A shard holds ``PER_SHARD`` digests on
average and shards follow the row count, so a task's memory does not grow with the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinefield.llm.common import fresh_name, ship, whole_text
from brinefield.runtime import cut

FILTER, STORED, INSERT, DELETE = range(4)
PER_SHARD = 200_000
SLOTS = 4
MAX_KICKS = 200
SCHEMA = "shard int, kind int, digest binary, n long, doc_id long, n_buckets long, slots binary"
ARROW = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("digest", pa.binary()), ("n", pa.int64()), ("doc_id", pa.int64()),
                   ("n_buckets", pa.int64()), ("slots", pa.binary())])
FLUSH = 20_000


class CuckooFilter:
    """Fingerprints of digests in buckets of four; every fingerprint has two possible buckets."""

    def __init__(self, n_buckets: int = 1024, slots: bytes | None = None):
        self.n_buckets = n_buckets
        self.table = np.zeros((n_buckets, SLOTS), np.uint16).tolist() if slots is None else np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).tolist()
        self._turn = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[:8], "little") % self.n_buckets
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & (self.n_buckets - 1))

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return mark in self.table[a] or mark in self.table[b]

    def add(self, digest: bytes) -> bool:
        """False: no place was found; the filter has to be refilled at a larger size."""
        mark, a, b = self._places(digest)
        for bucket in (a, b):
            if 0 in self.table[bucket]:
                self.table[bucket][self.table[bucket].index(0)] = mark
                return True
        bucket = a
        for _ in range(MAX_KICKS):
            self._turn += 1
            slot = self._turn % SLOTS
            mark, self.table[bucket][slot] = self.table[bucket][slot], mark
            bucket = self._other(bucket, mark)
            if 0 in self.table[bucket]:
                self.table[bucket][self.table[bucket].index(0)] = mark
                return True
        return False

    def remove(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        for bucket in (a, b):
            if mark in self.table[bucket]:
                self.table[bucket][self.table[bucket].index(mark)] = 0
                return True
        return False

    def to_bytes(self) -> bytes:
        return np.asarray(self.table, np.uint16).tobytes()


class Shard:
    """A filter and the digests stored behind it, by home bucket of the digest."""

    def __init__(self, n_buckets: int = 1024):
        self.filter = CuckooFilter(n_buckets)
        self.stored: dict[int, dict[bytes, list]] = {}
        self.resized = 0

    @staticmethod
    def _home(digest: bytes) -> int:
        return int.from_bytes(digest[:8], "little") % 65536

    def load(self, digest: bytes, n: int, doc_id: int | None) -> None:
        self.stored.setdefault(self._home(digest), {})[digest] = [n, doc_id]

    def refill(self, n_buckets: int) -> None:
        """A new filter of at least this size from the stored digests."""
        while True:
            self.filter = CuckooFilter(n_buckets)
            if all(self.filter.add(digest) for bucket in self.stored.values() for digest in bucket):
                return
            n_buckets *= 2
            self.resized += 1

    def insert(self, digest: bytes, n: int, doc_id: int | None) -> None:
        if digest in self.filter:
            entry = self.stored.get(self._home(digest), {}).get(digest)
            if entry is not None:
                entry[0] += n
                if doc_id is not None and (entry[1] is None or doc_id > entry[1]):
                    entry[1] = doc_id
                return
        self.load(digest, n, doc_id)
        if not self.filter.add(digest):
            self.resized += 1
            self.refill(self.filter.n_buckets * 2)

    def delete(self, digest: bytes, n: int) -> None:
        bucket = self.stored.get(self._home(digest), {}) if digest in self.filter else {}
        if digest not in bucket:
            return
        bucket[digest][0] -= n
        if bucket[digest][0] <= 0:
            del bucket[digest]
            self.filter.remove(digest)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, ARROW)], schema=ARROW)


def _serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive by shard, then kind."""
    current, shard, fresh = None, None, True
    out: list[tuple] = []

    def emit():
        out.append((current, FILTER, None, None, None, shard.filter.n_buckets, shard.filter.to_bytes()))
        out.extend((current, STORED, digest, n, doc_id, None, None) for bucket in shard.stored.values() for digest, (n, doc_id) in bucket.items())

    for batch in batches:
        for number, kind, digest, n, doc_id, n_buckets, slots in zip(*(c.to_pylist() for c in batch.columns)):
            if number != current:
                if shard is not None:
                    emit()
                current, shard, fresh = number, Shard(), True
            if kind == FILTER:
                shard.filter, fresh = CuckooFilter(n_buckets, slots), False
            elif kind == STORED:
                shard.load(digest, n, doc_id)
                if fresh and not shard.filter.add(digest):
                    shard.refill(shard.filter.n_buckets * 2)
            elif kind == INSERT:
                shard.insert(digest, n, doc_id)
            else:
                shard.delete(digest, n)
            while len(out) >= FLUSH:
                yield _batch(out[:FLUSH])
                del out[:FLUSH]
    if shard is not None:
        emit()
    for k in range(0, len(out), FLUSH):
        yield _batch(out[k:k + FLUSH])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per digest and batch: how many documents, and the largest doc_id."""
    schema = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("doc_id", pa.int64())])
    for batch in batches:
        found = pa.TableGroupBy(pa.Table.from_batches([batch]), "digest", use_threads=False).aggregate([("doc_id", "max"), ("digest", "count")])
        yield from found.select(["digest", "digest_count", "doc_id_max"]).rename_columns(schema.names).cast(schema).to_batches()


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, digest)`` for every row; a null text is the empty text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(whole_text(text).cast("binary"), 256)).alias("digest"))


def _changes(rows: DataFrame, kind: int, shards: int) -> DataFrame:
    combined = rows.select("doc_id", "digest").mapInArrow(_combine, "digest binary, n long, doc_id long")
    return combined.select(F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"), F.lit(kind).alias("kind"), "digest", "n", "doc_id",
                           F.lit(None).cast("long").alias("n_buckets"), F.lit(None).cast("binary").alias("slots"))


def shards_for(rows: int) -> int:
    return max(16, math.ceil(rows / PER_SHARD))


def maintain(index: DataFrame | None, inserts: DataFrame | None, deletes: DataFrame | None, shards: int) -> DataFrame:
    """The index after insertions and deletions, each given as ``(doc_id, digest)`` rows.

    ``shards`` must stay the same for one index. A deletion names documents by id and
    digest; one that is not live changes nothing. The largest live id of a digest that
    lost documents is taken anew by ``refresh``, since the index keeps one id only.
    """
    parts = [p for p in (index, inserts is not None and _changes(inserts, INSERT, shards), deletes is not None and _changes(deletes, DELETE, shards))
             if isinstance(p, DataFrame)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    ship(rows.sparkSession)
    return rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_serve, SCHEMA)


def refresh(index: DataFrame, live: DataFrame, touched: DataFrame) -> DataFrame:
    """Largest live ids of the touched digests, from the live ``(doc_id, digest)`` rows."""
    newest = live.join(touched.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("_newest"), F.lit(True).alias("_hit"))
    return (index.join(newest, "digest", "left").withColumn("doc_id", F.when(F.col("_hit") & (F.col("kind") == STORED), F.col("_newest")).otherwise(F.col("doc_id")))
            .select("shard", "kind", "digest", "n", "doc_id", "n_buckets", "slots"))


def stored(index: DataFrame) -> DataFrame:
    """``(digest, group_size, keep_id)`` of every live digest."""
    return index.filter(F.col("kind") == STORED).select("digest", F.col("n").alias("group_size"), F.col("doc_id").alias("keep_id"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts form a group and the largest doc_id stays; null text counts as empty.
    A null id is smaller than any other and stays only where all ids of its group are
    null. Rows that repeat id and text are listed as often as they occur with the same
    verdict. Other columns of ``docs`` are not looked at. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    marks = cut(digests(docs))
    index = cut(maintain(None, marks, None, shards_for(marks.count())))
    found = marks.join(stored(index), "digest", "left")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept; rows that repeat id and text stay once."""
    groups = cut(exact_groups(docs))
    repeats = groups.filter("kept").groupBy("doc_id", "text_sha256").count().filter("count > 1").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    gone = groups.filter("not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    sha = fresh_name(docs, "_sha256")
    marked = docs.withColumn(sha, F.sha2(whole_text().cast("binary"), 256))

    def same(other: DataFrame):
        return marked["doc_id"].cast("long").eqNullSafe(other["_id"]) & (marked[sha] == other["_sha"])

    stays = marked.join(gone, same(gone), "left_anti")
    if not repeats.isEmpty():
        marked = stays
        again = marked.join(repeats, same(repeats), "left_semi").dropDuplicates(["doc_id", sha])
        stays = marked.join(repeats, same(repeats), "left_anti").unionByName(again)
    return stays.drop(sha)
