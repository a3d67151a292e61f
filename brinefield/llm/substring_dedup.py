"""Repeated passages across documents, found by difference-cover anchors.

Positions of a document's words are taken modulo a period. For any two residues a difference
cover holds some shift that brings both into it, so of two places where the same ``WINDOW``
words stand, some shift below the period puts both on cover positions: the window of
``WINDOW - PERIOD + 1`` words there, the anchor, is hashed in both. Hence

1. only cover positions are hashed, about a quarter of all;
2. an anchor whose hash stands nowhere else rules out every window that it begins in;
3. windows that still hold an anchor of theirs are extended to full width, and their 128-bit
   hashes decide which stand twice. Words under such a window go.

Texts travel in *chunks*, compressed blocks of about ``CHUNK_BYTES`` that are written once.
A chunk asks about each of its distinct hashes once, packed by segment of the hash space,
and is answered by one bit an anchor and by the starts of repeated windows. A passage that a third of all documents hold is one
question a chunk, no key is ever a list of documents, and no pair of documents is formed.
Segments follow the number of words, so a segment's hashes fit a task at every size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinefield.llm.common import ship, whole_text
from brinefield.llm.jaccard_join import inverse_powers, mix, powers
from brinefield.runtime import cut

WINDOW = 35
PERIOD = 21
#: A perfect difference set: every non-zero residue modulo PERIOD is a difference of two of these.
COVER = (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1
CHUNK_BYTES = 1 << 20
PER_SEGMENT = 1_000_000
PART_BYTES = 32 << 20
LONG = 512

_SEEDS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xE7037ED1A0B428DB))
_STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F))


# ---- chunks --------------------------------------------------------------------

CHUNKS = "chunk long, n_words long, doc_ids array<long>, sizes array<int>, size long, body binary"


def _chunks(most: int):
    """Documents in blocks of at least ``most`` bytes, numbered within the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def close():
            body = b"\n".join(texts)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sum(len(t.split()) for t in texts)], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                                               pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([len(body)], pa.int64()),
                                               pa.array([pa.compress(body, codec="zstd", asbytes=True)], pa.binary())], names=["chunk", "n_words", "doc_ids", "sizes", "size", "body"])

        for batch in batches:
            for k in range(batch.num_rows):
                ids.append(batch.column(0)[k].as_py())
                texts.append(batch.column(1)[k].as_py().encode("utf-8", "surrogatepass"))
                size += len(texts[-1]) + 1
                if size >= most:
                    yield close()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield close()
    return run


class Chunk:
    """The words of a chunk's documents: where they begin and end, and whose they are."""

    def __init__(self, body: bytes, sizes: np.ndarray):
        self.body = body
        data = np.frombuffer(body, np.uint8)
        solid = np.zeros(data.size + 2, bool)
        solid[1:-1] = (data != 32) & ((data < 9) | (data > 13))
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]
        self.doc_starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
        self.first = np.searchsorted(self.starts, self.doc_starts)
        self.counts = np.diff(np.append(self.first, self.starts.size))
        self.place = np.arange(self.starts.size) - np.repeat(self.first, self.counts)
        self.left = np.repeat(self.counts, self.counts) - self.place

    def word_hashes(self, lane: int) -> np.ndarray:
        """A 64-bit hash of every word, taken in from eight bytes at a time; words beyond ``LONG`` bytes by digest."""
        length = self.ends - self.starts
        padded = self.body + bytes(8)
        eight = np.ndarray((len(self.body) + 1,), "<u8", padded, strides=(1,))
        out = mix(length.astype(np.uint64) * _SEEDS[lane])
        live = np.arange(length.size)
        for begin in range(0, min(int(length.max(initial=0)), LONG), 8):
            live = live[length[live] > begin]
            rest = np.minimum(length[live] - begin, 8).astype(np.uint64)
            piece = eight[self.starts[live] + begin] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest))
            out[live] = mix(out[live] * _STEPS[lane] + piece)
        for k in np.flatnonzero(length > LONG).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(self.body[self.starts[k]:self.ends[k]], digest_size=8, person=bytes([lane])).digest(), "little")
        return out

    def window_hashes(self, width: int, at: np.ndarray, lane: int) -> np.ndarray:
        """Hashes of the ``width`` words from each of ``at``."""
        words = self.word_hashes(lane)
        p, q = powers(words.size + 1), inverse_powers(words.size + 1)
        running = np.zeros(words.size + 1, np.uint64)
        np.cumsum(words * p[:words.size], out=running[1:])
        return mix((running[at + width] - running[at]) * q[at] + np.uint64(width))

    def kept(self, gone: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """How many words each document loses and what stays, one space between words."""
        stays = np.flatnonzero(~gone)
        lost = self.counts - np.diff(np.append(np.searchsorted(stays, self.first), stays.size))
        out = np.frombuffer(self.body + b" ", np.uint8).copy()
        out[self.ends] = 32
        span = np.zeros(out.size + 1, np.int8)
        span[self.starts[stays]] += 1
        span[self.ends[stays] + 1] -= 1
        whole = out[np.cumsum(span[:-1], dtype=np.int8).astype(bool)].tobytes()
        stops = np.concatenate([[0], np.cumsum(self.ends[stays] - self.starts[stays] + 1)])
        edges = stops[np.append(np.searchsorted(stays, self.first), stays.size)].tolist()
        return lost, [whole[a:max(a, b - 1)] for a, b in zip(edges, edges[1:])]


def anchor_places(chunk: Chunk) -> np.ndarray:
    """Words at cover positions of documents that hold a window, with an anchor's width ahead of them."""
    covered = np.isin(np.arange(PERIOD), COVER)
    return np.flatnonzero(covered[chunk.place % PERIOD] & (chunk.left >= ANCHOR) & (chunk.place + chunk.left >= WINDOW))


def window_places(chunk: Chunk, anchors: np.ndarray) -> np.ndarray:
    """Starts of full windows that hold one of ``anchors`` less than a period behind their start."""
    reach = np.zeros(chunk.starts.size + 1, np.int64)
    np.add.at(reach, anchors - np.minimum(chunk.place[anchors], PERIOD - 1), 1)
    np.add.at(reach, anchors + 1, -1)
    return np.flatnonzero((np.cumsum(reach)[:-1] > 0) & (chunk.left >= WINDOW))


# ---- questions and answers -------------------------------------------------------

def distinct(lanes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows given by one or two lanes: the place of each distinct row's first, each row's number among them, and counts."""
    order = np.argsort(lanes[0], kind="stable")
    new = np.ones(order.size, bool)
    first = lanes[0][order]
    new[1:] = first[1:] != first[:-1]
    if len(lanes) > 1 and order.size:
        second = lanes[1][order]
        if (~new[1:] & (second[1:] != second[:-1])).any():
            order = np.lexsort((lanes[1], lanes[0]))
            first, second = lanes[0][order], lanes[1][order]
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    number = np.empty(order.size, np.int64)
    number[order] = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    return order[begin], number, np.diff(np.append(begin, order.size))


def packed_starts(starts: np.ndarray) -> bytes:
    """Ascending starts as differences, low bytes of all first: the planes of zeros that follow take no room once compressed."""
    return np.diff(starts, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked_starts(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64))


class Asked:
    """A chunk's hashes, one or two lanes wide: distinct ones by segment and place, each asked once."""

    def __init__(self, lanes: list[np.ndarray], segments: int):
        place, self.number, counts = distinct(lanes)
        home = (lanes[0][place] % np.uint64(segments)).astype(np.int32)
        self.order = np.lexsort((place, home))
        self.place = place[self.order]
        self.hashes, self.twice = np.stack([lane[self.place] for lane in lanes], axis=1), counts[self.order] > 1
        self.segments, begin = np.unique(home[self.order], return_index=True)
        self.cuts = list(zip(begin.tolist(), np.append(begin[1:], self.order.size).tolist()))

    def rows(self, chunk: int, starts: np.ndarray | None = None) -> pa.RecordBatch:
        """One row a segment; with ``starts`` also where each hash stands first, to be answered by."""
        none = [None] * len(self.cuts)
        at = none if starts is None else [packed_starts(starts[self.place[a:b]]) for a, b in self.cuts]
        return pa.RecordBatch.from_arrays([pa.array(self.segments.astype(np.int32)), pa.array([chunk] * len(self.cuts), pa.int64()),
                                           pa.array([self.hashes[a:b].tobytes() for a, b in self.cuts], pa.binary()),
                                           pa.array([np.packbits(self.twice[a:b]).tobytes() for a, b in self.cuts], pa.binary()), pa.array(at, pa.binary())],
                                          names=["segment", "chunk", "hashes", "twice", "starts"])

    def repeated(self, answers: dict[int, bytes]) -> np.ndarray:
        """Which of the hashes that were given stand twice in the corpus."""
        out = np.zeros(self.order.size, bool)
        for segment, (a, b) in zip(self.segments.tolist(), self.cuts):
            if segment in answers:
                out[self.order[a:b]] = np.unpackbits(np.frombuffer(answers[segment], np.uint8), count=b - a).astype(bool)
        return out[self.number]


QUESTIONS = "segment int, chunk long, hashes binary, twice binary, starts binary"
ANSWERS = "chunk long, segment int, bits binary"


def _answer(lanes: int):
    """Rows arrive by segment. A hash stands twice where two chunks ask for it or one says so.

    The answer is a bit for each hash, or the starts of the repeated ones where starts were given;
    rows without hashes (starts that a chunk settled by itself) pass on.
    """
    def settle(segment, held):
        rows = np.concatenate([np.frombuffer(h, np.uint64) for _, h, _, _ in held]).reshape(-1, lanes)
        sizes = [len(h) // (8 * lanes) for _, h, _, _ in held]
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for (_, _, t, _), n in zip(held, sizes)]).astype(bool)
        _, number, counts = distinct([np.ascontiguousarray(rows[:, k]) for k in range(lanes)])
        many = counts > 1
        many[number[twice]] = True
        hits = many[number]
        chunks, given = [], []
        stops = np.cumsum(sizes).tolist()
        for (chunk, _, _, starts), a, b in zip(held, [0, *stops], stops):
            if hits[a:b].any():
                chunks.append(chunk)
                given.append(np.packbits(hits[a:b]).tobytes() if starts is None else packed_starts(unpacked_starts(starts)[hits[a:b]]))
        return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([segment] * len(chunks), pa.int32()), pa.array(given, pa.binary())], names=["chunk", "segment", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for segment, chunk, hashes, twice, starts in zip(*(c.to_pylist() for c in batch.columns)):
                if hashes is None:
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([segment], pa.int32()), pa.array([starts], pa.binary())], names=["chunk", "segment", "bits"])
                    continue
                if segment != current and held:
                    yield settle(current, held)
                    held = []
                current = segment
                held.append((chunk, hashes, twice, starts))
        if held:
            yield settle(current, held)
    return run


def _answers(questions: DataFrame, lanes: int, segments: int) -> DataFrame:
    return cut(questions.repartition(segments, "segment").sortWithinPartitions("segment").mapInArrow(_answer(lanes), ANSWERS))


def _opened(sizes, size: int, body: bytes) -> Chunk:
    return Chunk(pa.decompress(body, size, "zstd", asbytes=True), np.array(sizes, np.int64))


def _anchor_questions(segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = _opened(*(batch.column(c)[k].as_py() for c in (1, 2, 3)))
                at = anchor_places(chunk)
                if at.size:
                    yield Asked([chunk.window_hashes(ANCHOR, at, 0)], segments).rows(batch.column(0)[k].as_py())
    return run


def _with_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]], pa.Scalar, Chunk]]:
    """Rows (chunk, step, segment, bits, doc_ids, sizes, size, body) arrive by chunk, the chunk itself after its answers."""
    current, answers = None, []
    for batch in batches:
        for k in range(batch.num_rows):
            number = batch.column(0)[k].as_py()
            if number != current:
                current, answers = number, []
            if batch.column(1)[k].as_py() == 0:
                answers.append((batch.column(2)[k].as_py(), batch.column(3)[k].as_py()))
            else:
                yield number, answers, batch.column(4)[k], _opened(*(batch.column(c)[k].as_py() for c in (5, 6, 7)))


def _window_questions(segments: int):
    """Full windows that the anchors leave open. Those that a chunk holds twice are settled; the rest are asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, answers, _, chunk in _with_answers(batches):
            at = anchor_places(chunk)
            if not answers or not at.size:
                continue
            open_ = window_places(chunk, at[Asked([chunk.window_hashes(ANCHOR, at, 0)], segments).repeated(dict(answers))])
            if not open_.size:
                continue
            asked = Asked([chunk.window_hashes(WINDOW, open_, lane) for lane in (0, 1)], segments)
            yield asked.rows(number, open_)
            many = np.zeros(asked.order.size, bool)
            many[asked.order] = asked.twice
            own = open_[many[asked.number]]
            if own.size:
                yield pa.RecordBatch.from_arrays([pa.array([number % segments], pa.int32()), pa.array([number], pa.int64()), pa.array([None], pa.binary()), pa.array([None], pa.binary()),
                                                  pa.array([packed_starts(own)], pa.binary())], names=["segment", "chunk", "hashes", "twice", "starts"])
    return run


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, answers, doc_ids, chunk in _with_answers(batches):
        cover = np.zeros(chunk.starts.size + 1, np.int64)
        if answers:
            hit = np.unique(np.concatenate([unpacked_starts(starts) for _, starts in answers]))
            cover[hit] += 1
            cover[hit + WINDOW] -= 1
        lost, kept = chunk.kept(np.cumsum(cover)[:-1] > 0)
        yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(chunk.counts.astype(np.int64)), pa.array(lost.astype(np.int64)), pa.array(kept, pa.binary())],
                                         names=["doc_id", "n_words", "n_removed", "kept"])


# ---- Spark -----------------------------------------------------------------------

def _joined(chunks: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """Each chunk behind the answers it got, in one partition by chunk."""
    none = {c: F.lit(None).cast(t) for c, t in (("segment", "int"), ("bits", "binary"), ("doc_ids", "array<long>"), ("sizes", "array<int>"), ("size", "long"), ("body", "binary"))}
    columns = ["chunk", "step", *none]
    bodies = chunks.withColumns({"step": F.lit(1), "segment": none["segment"], "bits": none["bits"]}).select(columns)
    given = answers.withColumns({"step": F.lit(0), **{c: none[c] for c in ("doc_ids", "sizes", "size", "body")}}).select(columns)
    return given.unionByName(bodies).repartition(parts, "chunk").sortWithinPartitions("chunk", "step")


def drop_repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, per_segment: int = PER_SEGMENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (the words that stay, joined by one space, UTF-8).

    Windows of ``WINDOW`` words whose word sequence also starts elsewhere, in the same or
    another row, lose all their words; windows are judged on the input. Words are compared
    as they stand. Every row is a document of its own: rows that repeat an id and its text are copies of
    each other. Null and empty texts have no words and keep the empty text, as does a text
    that loses every word; texts below ``WINDOW`` words lose nothing. Null ids stay null.
    Other columns are not looked at; an empty table gives no rows.
    """
    spark = ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    chunks = cut(texts.mapInArrow(_chunks(chunk_bytes), CHUNKS))
    words, stored = chunks.agg(F.sum("n_words"), F.sum(F.length("body"))).first()
    segments = max(16, math.ceil((words or 0) * len(COVER) / PERIOD / per_segment))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((stored or 0) / PART_BYTES))
    anchors = _answers(chunks.select("chunk", "sizes", "size", "body").mapInArrow(_anchor_questions(segments), QUESTIONS), 1, segments)
    windows = _answers(_joined(chunks, anchors, parts).mapInArrow(_window_questions(segments), QUESTIONS), 2, segments)
    return _joined(chunks, windows, parts).mapInArrow(_drop, "doc_id long, n_words long, n_removed long, kept binary")
