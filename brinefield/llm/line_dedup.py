"""Repeated lines across documents, found with two Bloom filters.

1. A line's key (ends stripped, A-Z lowered, ``LEAST`` code points up) is reduced to a
   64-bit hash, which picks a segment. Hashes of one input batch are combined first, so a
   line that every document holds costs one row per batch; the lines themselves stay.
2. Each segment's task keeps a once-seen and a twice-seen filter. A hash that the first
   already holds goes into the second, and so does one that a batch saw in two documents.
3. The twice-seen filters probe the documents' lines in place. Only hits, suspected
   repeats, are shuffled, with the SHA-256 of their key: the exact confirmation counts the
   documents of each digest and picks the smallest doc_id. False positives end here.
4. The positions to drop come back to their documents.

Filters small enough to ship (``SHIP_BYTES``, checked) are broadcast; beyond that the line
hashes join their segment's filter. Segments follow the number of documents, so that a
filter's size does not grow with the input.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinefield.llm.common import SPACES, ship, whole_text
from brinefield.runtime import cut

LEAST = 10
BITS = 12
TWICE_BITS = 4  # of all keys; few of them stand twice
PROBES = 5
PER_SEGMENT = 50_000
SHIP_BYTES = 64 << 20
_SPACES = SPACES.encode()


def line_key(line: bytes) -> bytes | None:
    """The key of a line, or None where it is too short to count."""
    key = line.strip(_SPACES).lower()
    return key if len(key) >= LEAST and (len(key) >= 4 * LEAST or len(key.decode("utf-8", "surrogatepass")) >= LEAST) else None


def key_hash(key: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little", signed=True)


class Bloom:
    """Bits for ``n`` keys at ``each`` bits a key; whole arrays of 64-bit hashes at a time."""

    def __init__(self, n: int, bits: bytes | None = None, each: int = BITS):
        self.size = max(1024, n * each)
        self.bits = np.zeros(self.size // 8 + 1, np.uint8) if bits is None else np.frombuffer(bits, np.uint8)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(np.uint64)
        first, second = h >> np.uint64(32), (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) | np.uint64(1)
        return ((first[None, :] + np.arange(PROBES, dtype=np.uint64)[:, None] * second[None, :]) % np.uint64(self.size)).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        places = self._places(hashes).ravel()
        np.bitwise_or.at(self.bits, places >> 3, (1 << (places & 7)).astype(np.uint8))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        places = self._places(hashes)
        return ((self.bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=0)


def _hashes(segments: int):
    """(segment, hashes, repeated) of each batch: distinct line hashes, and which stood in two documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: list[int] = []
            for text in batch.column(1).to_pylist():
                keys = set(map(line_key, text.encode("utf-8", "surrogatepass").split(b"\n")))
                keys.discard(None)
                seen.extend(map(key_hash, keys))
            found, counts = np.unique(np.array(seen, np.int64), return_counts=True)
            yield packed_by_segment(found, counts > 1, segments)
    return run


SEGMENTED = "segment int, hashes binary, repeated binary"


def packed_by_segment(hashes: np.ndarray, repeated: np.ndarray, segments: int) -> pa.RecordBatch:
    """One row per segment: its hashes and whether each was seen twice already."""
    home = (hashes.view(np.uint64) % np.uint64(segments)).astype(np.int32)
    order = np.argsort(home, kind="stable")
    hashes, repeated, home = hashes[order], repeated[order], home[order]
    numbers, starts = np.unique(home, return_index=True)
    stops = np.append(starts[1:], hashes.size)
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([hashes[a:b].tobytes() for a, b in zip(starts, stops)], pa.binary()),
                                       pa.array([repeated[a:b].tobytes() for a, b in zip(starts, stops)], pa.binary())], names=["segment", "hashes", "repeated"])


def twice_seen(segmented: DataFrame) -> DataFrame:
    """``(segment, n, bits)``: the twice-seen filter of each segment, written."""
    return cut(segmented.repartition("segment").sortWithinPartitions("segment").mapInArrow(_filters, "segment int, n long, bits binary"))


def shipped(filters: DataFrame, ship_bytes: int = SHIP_BYTES):
    """The filters as a broadcast variable if they are small enough, else None."""
    if (filters.agg(F.sum(F.length("bits"))).first()[0] or 0) > ship_bytes:
        return None
    return filters.sparkSession.sparkContext.broadcast({r["segment"]: (r["n"], bytes(r["bits"])) for r in filters.toLocalIterator()})


def probe(blooms: dict[int, Bloom], h: np.ndarray, segments: int) -> np.ndarray:
    """Which hashes their segments' filters hold."""
    home = (h.view(np.uint64) % np.uint64(segments)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    out = np.zeros(h.size, bool)
    numbers, starts = np.unique(home[order], return_index=True)
    for s, a, b in zip(numbers.tolist(), starts, np.append(starts[1:], h.size)):
        if s in blooms:
            out[order[a:b]] = blooms[s].holds(h[order[a:b]])
    return out


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive by segment. One segment's packed hashes are held to size its filters, then streamed through them."""
    def build(segment, parts):
        once = Bloom(sum(len(h) // 8 for h, _ in parts))
        twice = Bloom(sum(len(h) // 8 for h, _ in parts), each=TWICE_BITS)
        for hashes, repeated in parts:
            h = np.frombuffer(hashes, np.int64)
            again = once.holds(h) | np.frombuffer(repeated, bool)
            twice.add(h[again])
            once.add(h)
        return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([sum(len(h) // 8 for h, _ in parts)], pa.int64()), pa.array([twice.bits.tobytes()], pa.binary())],
                                          names=["segment", "n", "bits"])

    current, parts = None, []
    for batch in batches:
        for segment, hashes, repeated in zip(*(c.to_pylist() for c in batch.columns)):
            if segment != current and parts:
                yield build(current, parts)
                parts = []
            current = segment
            parts.append((hashes, repeated))
    if parts:
        yield build(current, parts)


LINE = "doc_id long, text_key long, position int, hash long, digest binary"


def _lines(doc_ids, keys, texts, test) -> pa.RecordBatch:
    """Rows of the lines whose hash passes ``test``."""
    owner, position, digest, hashes = [], [], [], []
    for number, text in enumerate(texts):
        for k, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
            key = line_key(line)
            if key is not None:
                owner.append(number)
                position.append(k)
                digest.append(key)
                hashes.append(key_hash(key))
    h = np.array(hashes, np.int64)
    hit = np.flatnonzero(test(h)) if h.size else np.zeros(0, np.int64)
    rows = np.array(owner, np.int64)[hit]
    return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(rows)), keys.take(pa.array(rows)), pa.array(np.array(position, np.int32)[hit]), pa.array(h[hit]),
                                       pa.array([hashlib.sha256(digest[i]).digest() for i in hit.tolist()], pa.binary())],
                                      names=["doc_id", "text_key", "position", "hash", "digest"])


def _probe(packed, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blooms = {s: Bloom(n, bits, TWICE_BITS) for s, (n, bits) in packed.value.items()}
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield _lines(part.column(0), part.column(1), part.column(2).to_pylist(), lambda h: probe(blooms, h, segments))
    return run


def _all_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            yield _lines(part.column(0), part.column(1), part.column(2).to_pylist(), lambda h: np.ones(h.size, bool))


def _probe_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that came with their segment's filter, sorted by segment."""
    current, bloom = None, None
    for batch in batches:
        segment = batch.column(5).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if batch.num_rows else []
        for a, b in zip(edges, np.append(edges[1:], batch.num_rows).astype(int) if len(edges) else []):
            if segment[a] != current:
                current, bloom = segment[a], Bloom(batch.column(6)[int(a)].as_py(), batch.column(7)[int(a)].as_py(), TWICE_BITS)
            part = batch.slice(int(a), int(b - a))
            keep = bloom.holds(np.ascontiguousarray(part.column(3).to_numpy()))
            yield part.filter(pa.array(keep)).select(["doc_id", "text_key", "position", "hash", "digest"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_key"), whole_text().alias("text"))


def suspects(docs: DataFrame, segments: int | None = None, ship_bytes: int = SHIP_BYTES) -> DataFrame:
    """Lines whose hash the twice-seen filters hold: doc_id, text_key, position, hash, digest of the key."""
    spark = ship(docs.sparkSession)
    segments = segments or max(16, math.ceil(docs.count() / PER_SEGMENT))
    keyed = _keyed(docs)
    filters = twice_seen(keyed.select("doc_id", "text").mapInArrow(_hashes(segments), SEGMENTED))
    packed = shipped(filters, ship_bytes)
    if packed is not None:
        return keyed.mapInArrow(_probe(packed, segments), LINE)
    lines = keyed.mapInArrow(_all_lines, LINE)
    home = F.expr(f"cast(pmod(pmod(shiftrightunsigned(hash, 1), {segments}L) * 2 + (hash & 1L), {segments}L) AS int)")
    joined = lines.withColumn("segment", home).join(filters, "segment").sortWithinPartitions("segment")
    return joined.select("doc_id", "text_key", "position", "hash", "digest", "segment", "n", "bits").mapInArrow(_probe_joined, LINE)


def dropped_positions(docs: DataFrame, segments: int | None = None, ship_bytes: int = SHIP_BYTES) -> DataFrame:
    """``(doc_id, text_key, positions)``: the lines that each document loses."""
    found = cut(suspects(docs, segments, ship_bytes))
    ids = F.struct(F.col("doc_id").isNotNull(), "doc_id")
    # Written before the join, so that adaptive execution can split a line that most documents hold.
    confirmed = cut(found.groupBy("digest").agg(F.min(ids).alias("_first"), F.max(ids).alias("_last"))
                    .filter(F.col("_first") != F.col("_last")).select("digest", F.col("_first")["doc_id"].alias("_keeper")))
    lost = found.join(confirmed, "digest").filter(~F.col("doc_id").eqNullSafe(F.col("_keeper")))
    return lost.groupBy("doc_id", "text_key").agg(F.collect_set("position").alias("positions"))


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines, dropped, kept = [], [], []
        for text, positions in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            parts = text.encode("utf-8", "surrogatepass").split(b"\n")
            gone = set(positions or ())
            lines.append(len(parts))
            dropped.append(len(gone))
            kept.append(b"\n".join([p for k, p in enumerate(parts) if k not in gone] if gone else parts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())],
                                         names=["doc_id", "n_lines", "n_dropped", "kept"])


def dedup_lines(docs: DataFrame, segments: int | None = None, ship_bytes: int = SHIP_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines (before), n_dropped, kept (the rest of the text, UTF-8).

    A key that stands in two or more documents (by doc_id) keeps its lines only in the
    smallest doc_id; null ids count as one document, the smallest. All lines of the keeper
    with that key stay. Null and empty texts are one empty line. Rows that repeat an id are
    one document; if they also repeat the text they get the same result each. A document
    that loses every line keeps an empty text. Other columns are not looked at; an empty
    table gives no rows.
    """
    lost = dropped_positions(docs, segments, ship_bytes)
    keyed = _keyed(docs)
    joined = keyed.join(lost.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "positions"),
                        keyed["doc_id"].eqNullSafe(F.col("_id")) & (keyed["text_key"] == F.col("_key")), "left")
    return joined.select("doc_id", "text", "positions").mapInArrow(_drop, "doc_id long, n_lines long, n_dropped long, kept binary")
