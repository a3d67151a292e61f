"""Token ids in blocks of a static range asymmetric numeral system.

One frequency table, summed over all tokens, serves every block. A block holds whole
documents in doc_id order, at least ``BLOCK`` tokens of them unless it is a shard's last.
Its tokens are dealt over ``LANES`` interleaved coders that step together, so one array
operation codes a token of every lane. Lane states are saved every ``EVERY`` steps: a
reader can begin at any checkpoint. A checksum over the block guards each payload.

A block is bytes of its own (``MAGIC``, header, checkpoints, words), stored as a row of a
Parquet table with its documents' ids and lengths, because Spark's writers commit whole
tasks and Spark's readers reach every store. Blocks are independent and decode in parallel.

States are 64-bit and give off 32-bit words; frequencies are scaled to 2**SCALE.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import count
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinefield.llm.common import ship, whole_text
from brinefield.runtime import checkpoint_root, cut

END = 1
SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 2048
EVERY = 64
BLOCK = 1 << 18
CACHE = 500_000
MAGIC = b"RNS1"
ENDS = (b".", b",")
LONGEST = 64
BAR = "|"
OPENED = b"<|"
LATIN = "\u0180"
_SPACED = bytes(0x20 if b in b"\t\n\r" else b for b in range(256))
HEAD = struct.Struct("<4sIIII")


# ---- coder -------------------------------------------------------------------

def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE; every symbol that occurs gets 1 or more. All zero where nothing was counted."""
    total = counts.sum()
    out = np.zeros(counts.size, np.int64)
    used = np.flatnonzero(counts)
    if not used.size:
        return out
    if used.size > 1 << SCALE:
        raise ValueError("more symbols than frequency units")
    out[used] = np.maximum(1, counts[used].astype(np.float64) * ((1 << SCALE) / float(total))).astype(np.int64)
    order = used[np.argsort(-out[used], kind="stable")]
    rest = (1 << SCALE) - int(out.sum())
    if rest > 0:
        out[order[0]] += rest
    for symbol in order:
        if rest >= 0:
            break
        give = min(int(out[symbol]) - 1, -rest)
        out[symbol] -= give
        rest += give
    return out


class Table:
    """Frequencies, their running sums, and the symbol of every slot."""

    def __init__(self, frequencies: np.ndarray):
        self.frequency = frequencies.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(frequencies)[:-1]]).astype(np.uint64) if frequencies.size else self.frequency
        self.symbol = np.repeat(np.arange(frequencies.size, dtype=np.uint32), frequencies)


def encode(tokens: np.ndarray, table: Table, lanes: int = LANES, every: int = EVERY) -> bytes:
    """One block. Lane j codes tokens j, j + lanes, ... from the last to the first."""
    n = tokens.size
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    saved: list[bytes] = []
    given = 0
    frequency, start = table.frequency[tokens], table.start[tokens]
    if n and not frequency.all():
        raise ValueError("a token is not in the frequency table")
    shift = np.uint64(31 - SCALE + 32)
    for step in range(steps - 1, -1, -1):
        f, s = frequency[step * lanes:(step + 1) * lanes], start[step * lanes:(step + 1) * lanes]
        live = state[:f.size]
        full = live >= (f << shift)
        if full.any():
            words.append((live[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            given += words[-1].size
            live = np.where(full, live >> np.uint64(32), live)
        whole = live // f
        state[:f.size] = (whole << np.uint64(SCALE)) + (live - whole * f) + s
        if step % every == 0:
            saved.append(struct.pack("<I", given) + state.astype("<u8").tobytes())
    body = np.concatenate(words[::-1]).tobytes() if words else b""
    block = HEAD.pack(MAGIC, n, lanes, every, given) + b"".join(saved[::-1]) + body
    return block + struct.pack("<I", zlib.crc32(block))


def decode(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The tokens between two checkpoints (counted from 0), or all of them."""
    if len(block) < HEAD.size + 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("block checksum differs")
    magic, n, lanes, every, given = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a token block")
    steps = -(-n // lanes)
    points = -(-steps // every)
    last = points if last is None else min(last, points)
    if first >= last:
        return np.zeros(0, np.uint32)
    size = 4 + 8 * lanes
    at = HEAD.size + first * size
    position = given - struct.unpack_from("<I", block, at)[0]
    state = np.frombuffer(block, "<u8", lanes, at + 4).astype(np.uint64)
    words = np.frombuffer(block, "<u4", given, HEAD.size + points * size)
    begin, end = first * every, min(last * every, steps)
    out = np.zeros((end - begin, lanes), np.uint32)
    slots = np.uint64((1 << SCALE) - 1)
    for step in range(begin, end):
        width = min(lanes, n - step * lanes)
        live = state[:width]
        slot = live & slots
        symbol = table.symbol[slot]
        live = table.frequency[symbol] * (live >> np.uint64(SCALE)) + slot - table.start[symbol]
        short = np.flatnonzero(live < LOW)
        if short.size:
            live[short] = (live[short] << np.uint64(32)) | words[position:position + short.size]
            position += short.size
        state[:width] = live
        out[step - begin, :width] = symbol
    return out.reshape(-1)[:min(n, end * lanes) - begin * lanes]


# ---- tokens ------------------------------------------------------------------

_composes = re.compile(rb"[A-Z][\x80-\xff]")


def same_lowered(raw: bytes) -> bool:
    """Whether lowering A-Z before the library does changes no id."""
    return OPENED not in raw and (raw.isascii() or _composes.search(raw) is None)


def byte_signs() -> list[str]:
    """The printable sign that byte-level vocabularies write for each byte: itself where printable in Latin-1, else the next sign from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = count(0x100)
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class WordTokens:
    """The tokenizers library behind a cache of words.

    This vocabulary's slices never cross a space, tab or line end and its normalisation
    does not compose across them, so a text's ids are its words' ids in a row. The library
    looks for added tokens in the raw text, composes, and only then lowers case; words are
    lowered here only where that order cannot matter: no ``<|``, with which added tokens
    begin, and no capital in front of a sign that it could compose with. A point or comma after a letter or digit at a word's end is a slice of its own.
    A batch's distinct words are found first and looked up once each. The cache has two
    generations of ``CACHE`` words: a word that is asked for again moves to the younger one,
    and the older one goes when that is full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = id_type(self.tokenizer.get_vocab_size())
        self.coded = [np.array([k], self.kind).tobytes() for k in range(self.tokenizer.get_vocab_size())]
        self.young: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}
        (self.bar,) = self.tokenizer.encode(BAR, add_special_tokens=False).ids
        self.signs = byte_signs()

    def _ask(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Words that hold the bar go to the library one by one, the others in rows with bars between them."""
        texts = [w.decode() for w in words]
        plain = [k for k, t in enumerate(texts) if BAR not in t]
        new = {words[k]: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.kind).tobytes() for k, t in enumerate(texts) if BAR in t}
        width = np.dtype(self.kind).itemsize
        for k in range(0, len(plain), 1000):
            row = plain[k:k + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {BAR} ".join([texts[i] for i in row])], add_special_tokens=False)[0].ids, self.kind)
            bars = np.flatnonzero(ids == self.bar).tolist()
            if len(bars) != len(row) - 1:
                raise ValueError("this vocabulary does not keep words apart")
            raw = ids.tobytes()
            new.update((words[i], raw[width * a:width * b]) for i, a, b in zip(row, [0, *(x + 1 for x in bars)], [*bars, ids.size]))
        return new

    def _single(self, word: bytes) -> bytes | None:
        """Ids of a word that is one slice and that normalisation leaves alone, from the library's merges; None for other words.

        That is lower-case letters below ``LATIN`` in composed form.
        """
        if word.isalpha():
            if word.islower():
                return b"".join([self.coded[t.id] for t in self.tokenizer.model.tokenize(word.decode())])
            return None
        text = word.decode()
        if text.isalpha() and max(text) < LATIN and text == text.lower() and is_normalized("NFC", text):
            return b"".join([self.coded[t.id] for t in self.tokenizer.model.tokenize("".join(map(self.signs.__getitem__, word)))])
        return None

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of some distinct words. What the younger generation lacks enters it."""
        young, old = self.young, self.old
        coded = list(map(young.get, words))
        fresh: dict[bytes, bytes | None] = {}
        later = []
        lacking = [k for k, c in enumerate(coded) if c is None]
        for k in lacking:
            w = words[k]
            if not w.islower() and same_lowered(w):
                w = w.lower()
            ended = w[-1:] in ENDS and w[-2:-1].isalnum()
            stem = w[:-1] if ended else w
            ids = young.get(stem)
            if ids is None:
                ids = fresh.get(stem)
                if ids is None:
                    ids = old.get(stem) or self._single(stem)
                    fresh[stem] = ids
            coded[k] = ids
            if ended or ids is None:
                later.append((k, stem, w[-1:] if ended else b""))
        hard = {stem for stem, ids in fresh.items() if ids is None} | {e for e in ENDS if e not in young}
        fresh |= self._ask(list(hard))
        for k, stem, end in later:
            known = fresh[stem] if coded[k] is None else coded[k]
            coded[k] = known + (young.get(end) or fresh[end]) if end else known
        if len(young) >= CACHE:
            self.old, self.young = young, {b"": b""}
        self.young.update((w, i) for w, i in fresh.items() if len(w) <= LONGEST)
        return coded

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``kind``. Each distinct word is looked up once; whole arrays do the rest."""
        raws = []
        for text in texts:
            raw = text.encode().translate(_SPACED)
            raws.append(raw.lower() if same_lowered(raw) else raw)
        lists = pc.split_pattern(pa.array(raws, pa.large_binary()), b" ")
        words = lists.flatten().dictionary_encode()
        codes = words.indices.to_numpy()
        coded = self._words(words.dictionary.to_pylist())
        width = np.dtype(self.kind).itemsize
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // width
        begin = np.cumsum(sizes) - sizes
        take = sizes[codes]
        stops = np.concatenate([[0], np.cumsum(take)])
        ids = np.frombuffer(b"".join(coded), self.kind)[np.repeat(begin[codes] - stops[:-1], take) + np.arange(stops[-1])].tobytes()
        edges = (width * stops[lists.offsets.to_numpy()]).tolist()
        return [ids[a:b] for a, b in zip(edges, edges[1:])]


def id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def _texts(texts: list[str], most: int = 8_000_000) -> Iterator[tuple[int, int]]:
    begin, chars = 0, 0
    for end, text in enumerate(texts, 1):
        chars += len(text)
        if chars >= most or end == len(texts):
            yield begin, end
            begin, chars = end, 0


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = word_tokens(path)
        end = np.array([END], coder.kind).tobytes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _texts(texts):
                ids = [i + end for i in coder.encode(texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
    return run


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path).get_vocab_size()


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids)`` with the end id appended, as integers of the vocabulary's ``id_type``; null and empty texts have the end id alone."""
    ship(docs.sparkSession)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
            .mapInArrow(_tokenize(path), "doc_id long, ids binary"))


def _count(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=total.size)
            found[:total.size] += total
            total = found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])
    return run


def symbol_counts(tokens: DataFrame, kind: str) -> DataFrame:
    """``(id, n)``: how often each id occurs; one row per id and task before the shuffle."""
    return tokens.select("ids").mapInArrow(_count(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def frequencies(counts: DataFrame) -> np.ndarray:
    """The scaled table, from the counts of all tokens. It has one entry per id of the vocabulary, whatever the corpus' size."""
    rows = counts.toPandas()
    full = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    full[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return scaled(full)


# ---- files -------------------------------------------------------------------

BLOCKS = "shard int, block int, offset long, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary"


def _blocks(freqs: bytes, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        table = Table(np.frombuffer(freqs, np.int64))
        shard, number, offset = TaskContext.get().partitionId(), 0, 0
        doc_ids, parts, size, width = [], [], 0, np.dtype(kind).itemsize

        def close():
            payload = encode(np.frombuffer(b"".join(parts), kind), table)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()),
                                               pa.array([offset], pa.int64()), pa.array([size], pa.int64()),
                                               pa.array([doc_ids], pa.list_(pa.int64())), pa.array([[len(p) // width for p in parts]], pa.list_(pa.int64())),
                                               pa.array([payload], pa.binary())], names=["shard", "block", "offset", "n_tokens", "doc_ids", "lengths", "payload"])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc_id)
                parts.append(ids.as_py())
                size += len(parts[-1]) // width
                if size >= BLOCK:
                    yield close()
                    doc_ids, parts, size, number, offset = [], [], 0, number + 1, offset + size
        if doc_ids:
            yield close()
    return run


def write(docs: DataFrame, path: str, folder: str | None = None) -> str:
    """Write ``docs`` as blocks in ascending doc_id order and return the folder.

    ``folder`` (a new one under the shared folder by default) gets ``table`` (the scaled
    frequencies, one row) and ``blocks``. Documents are dealt by doc_id range, so shards
    are in order and a run of equal ids stays together; null ids come first.
    """
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_root(spark)}/tokens-{uuid.uuid4().hex}"
    tokenized(docs, path).write.option("compression", "zstd").parquet(f"{folder}/unsorted")
    tokens = spark.read.schema("doc_id long, ids binary").parquet(f"{folder}/unsorted")
    kind = id_type(vocabulary_size(path))
    table = frequencies(symbol_counts(tokens, kind))
    spark.createDataFrame([(SCALE, table.tobytes())], "scale int, frequencies binary").coalesce(1).write.parquet(f"{folder}/table")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = tokens.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(_blocks(table.tobytes(), kind), BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    return folder


def _documents(freqs: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(np.frombuffer(freqs, np.int64))
        for batch in batches:
            shards, offsets, doc_ids, lengths, payloads = (batch.column(k) for k in range(5))
            for k in range(batch.num_rows):
                tokens = decode(payloads[k].as_py(), table).astype("<u4")
                sizes = np.array(lengths[k].as_py(), np.int64)
                stops = np.cumsum(sizes)
                raw = tokens.tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array([shards[k].as_py()] * sizes.size, pa.int32()), pa.array(doc_ids[k].as_py(), pa.int64()),
                    pa.array(offsets[k].as_py() + stops - sizes, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array([raw[4 * (b - n):4 * b] for b, n in zip(stops.tolist(), sizes.tolist())], pa.binary())],
                    names=["shard", "doc_id", "within", "n_tokens", "ids"])
    return run


def shard_starts(spark: SparkSession, folder: str) -> DataFrame:
    """``(shard, before)``: tokens in front of each shard; one row per shard, written so that its size is known."""
    shards = spark.read.parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return cut(shards.select("shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("long").alias("before")))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document, decoded from the blocks."""
    ship(spark)
    freqs = bytes(spark.read.parquet(f"{folder}/table").first()["frequencies"])
    blocks = spark.read.parquet(f"{folder}/blocks").select("shard", "offset", "doc_ids", "lengths", "payload")
    found = blocks.mapInArrow(_documents(freqs), "shard int, doc_id long, within long, n_tokens long, ids binary")
    return found.join(shard_starts(spark, folder), "shard").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids")


def checksums(read_back: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of documents that were read back."""
    return read_back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
