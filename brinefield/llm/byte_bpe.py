"""Byte-level BPE without a regex: vectorised pre-tokenisation and cached pair merging.

All texts of a batch are laid end to end as one array of code points, each mapped to a
class. A class is a function from state to state of a small automaton; functions compose,
and composition is associative, so the states of all positions come from a blocked scan:
every block is scanned on its own, all blocks at once, the blocks' totals are combined,
and each block is shifted by the state before it. The states say where the slices begin.

A slice's ids come from a cache that lives as long as the worker and holds at most
``CACHE`` slices; the missing ones of a batch are merged pair by pair in rank order, all side
by side. Every id's byte
offset in its text is kept, and decoding writes each id's bytes at its offset.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinefield.llm.common import ship, slices, whole_text

CACHE = 500_000
LONGEST = 64
CHUNK_CHARS = 2_000_000

# Classes of code points, after looking one or two characters ahead.
BREAK, LETTER, NUMBER, OTHER, BLANK, SPACE, TAIL, SHORT, LONG = range(9)
# States: what the slice in progress is.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, IN_SPACE, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8
STARTS = 8  # bit that marks a slice's first position

#: Code points with the White_Space property.
WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(state: int, kind: int) -> int:
    """Next state, with ``STARTS`` set if a slice begins here.

    BLANK is a plain space right before a non-space, TAIL another white space there, SPACE
    any other white space. SHORT and LONG are apostrophes before a one- and a two-letter ending.
    """
    if kind == BREAK:
        return FRESH
    if state in (ONE_LEFT, TWO_LEFT):
        return ONE_LEFT if state == TWO_LEFT else FRESH
    joined = state == AFTER_BLANK
    if kind in (LETTER, NUMBER):
        to = IN_LETTERS if kind == LETTER else IN_NUMBERS
        return to if joined or state == to else to | STARTS
    if kind in (OTHER, SHORT, LONG):
        if joined or state == IN_OTHERS:
            return IN_OTHERS
        return {OTHER: IN_OTHERS, SHORT: ONE_LEFT, LONG: TWO_LEFT}[kind] | STARTS
    if kind == SPACE:
        return IN_SPACE if state == IN_SPACE else IN_SPACE | STARTS
    return (AFTER_BLANK if kind == BLANK else FRESH) | STARTS


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for code in range(0x110000):
        kind = kinds.get(unicodedata.category(chr(code))[0])
        if kind is not None:
            table[code] = kind
    table[WHITE] = SPACE
    return table


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Functions of the classes and all their compositions: class to function, function after function, function at state."""
    base = [tuple(_step(s, k) & 7 for s in range(STATES)) for k in range(9)]
    known = {tuple(range(STATES)): 0}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in base:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    functions = list(known)
    after = np.array([[known[tuple(g[s] for s in f)] for g in base] for f in functions], np.uint16)
    return after, np.array(functions, np.uint8), np.array([[_step(s, k) & STARTS for k in range(9)] for s in range(STATES)], bool)


def _look_ahead(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Split white space and apostrophes by what follows."""
    kinds = kinds.copy()
    follows = np.append(kinds[1:], BREAK)
    solid = (follows != SPACE) & (follows != BREAK)
    space = kinds == SPACE
    kinds[space & solid] = TAIL
    kinds[space & solid & (codes == 32)] = BLANK
    marks = np.flatnonzero(codes == 39)
    if marks.size:
        padded = np.append(codes, [0, 0])
        one, two = padded[marks + 1], padded[marks + 2]
        ends = np.isin(one, [ord(c) for c in "stmd"])
        kinds[marks[ends]] = SHORT
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        kinds[marks[long]] = LONG
    return kinds


def slice_starts(codes: np.ndarray, kinds: np.ndarray, block: int = 512) -> np.ndarray:
    """Positions where slices begin. ``kinds`` has BREAK between texts."""
    after, apply, starts = _monoid()
    kinds = _look_ahead(codes, kinds)
    n = kinds.size
    rows = -(-n // block)
    grid = np.full(rows * block, BREAK, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    prefix = np.zeros((block, rows), np.uint16)
    function = np.zeros(rows, np.uint16)
    for k in range(block):
        prefix[k] = function
        function = after[function, grid[k]]
    entry, state = np.zeros(rows, np.uint8), FRESH
    for k, f in enumerate(function.tolist()):
        entry[k] = state
        state = int(apply[f, state])
    states = apply[prefix, entry[None, :]]
    return np.flatnonzero(starts[states, grid].T.reshape(-1)[:n])


@lru_cache(maxsize=2)
def load_ranks(path: str) -> tuple[dict[bytes, int], list[bytes], np.ndarray, np.ndarray]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    lengths = np.array([len(t) for t in tokens], np.int64)
    return ranks, tokens, np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum(lengths)])


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long slice by a heap of pairs over a linked list: the lowest pair joins first, the leftmost of equals."""
    n = len(piece)
    ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i):
        j = after[i]
        if j < n and (rank := ranks.get(piece[i:ends[j]])) is not None:
            heapq.heappush(heap, (rank, i, ends[i], ends[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end, far = heapq.heappop(heap)
        j = after[i] if ends[i] == end else n
        if j >= n or ends[j] != far:
            continue
        ends[i], after[i], ends[j] = far, after[j], -1
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:ends[i]]])
        i = after[i]
    return out


class PairTable:
    """Rank of the joined token for every pair of tokens that joins, in an open-addressing table that whole arrays probe at once."""

    def __init__(self, ranks: dict[bytes, int], bits: int = 20):
        pairs = [(a << 32 | b, rank) for token, rank in ranks.items() for k in range(1, len(token))
                 if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None]
        self.none = len(ranks) + 1
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, self.none, np.int32)
        self.probes = 0
        keys, values = (np.array(c) for c in zip(*pairs))
        at = self._home(keys)
        while keys.size:
            self.probes += 1
            free = np.flatnonzero(self.keys[at] == -1)
            free = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            rest = self.keys[at] != keys
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = self._home(keys)
        out = np.full(keys.size, self.none, np.int32)
        open_ = np.arange(keys.size)
        for _ in range(self.probes):
            seen = self.keys[at]
            hit = seen == keys
            out[open_[hit]] = self.values[at[hit]]
            on = ~hit & (seen != -1)
            if not on.any():
                break
            open_, keys, at = open_[on], keys[on], (at[on] + 1) & self.mask
        return out


@lru_cache(maxsize=2)
def pair_table(path: str) -> PairTable:
    return PairTable(load_ranks(path)[0])


def merge_all(pieces: list[bytes], ranks: dict[bytes, int], table: PairTable) -> list[bytes]:
    """``merge`` for many slices side by side: in every round each slice joins its lowest pair, the leftmost of equals."""
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    done: list = [None] * len(pieces)
    rest = []
    for k, piece in enumerate(pieces):
        whole = ranks.get(piece)
        if whole is None:
            rest.append(k)
        else:
            done[k] = whole.to_bytes(4, "little")
    if not rest:
        return done
    word = np.array(rest)
    sizes = np.array([len(pieces[k]) for k in rest])
    ids = single[np.frombuffer(b"".join([pieces[k] for k in rest]), np.uint8)]
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    low = np.full(ids.size, table.none, np.int32)
    low[:-1] = table(ids[:-1], ids[1:])
    low[begins + sizes - 1] = table.none
    while word.size:
        least = np.minimum.reduceat(low, begins)
        at_least = np.flatnonzero(low == np.repeat(least, sizes))
        first = at_least[np.searchsorted(at_least, begins)]
        ended = least == table.none
        if ended.any():
            raw = ids.astype("<u4").tobytes()
            for k, b, n in zip(word[ended].tolist(), (begins[ended] * 4).tolist(), (sizes[ended] * 4).tolist()):
                done[k] = raw[b:b + n]
            stays = np.repeat(~ended, sizes)
            moved = np.cumsum(stays) - 1
            ids, low, first = ids[stays], low[stays], moved[first[~ended]]
            word, sizes, least = word[~ended], sizes[~ended], least[~ended]
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            if not word.size:
                break
        ids[first] = least
        keep = np.ones(ids.size, bool)
        keep[first + 1] = False
        now = first - np.arange(first.size)
        ids, low = ids[keep], np.delete(low, first)
        sizes = sizes - 1
        begins = begins - np.arange(begins.size)
        final = begins + sizes - 1
        right = now < final
        low[now[right]] = table(ids[now[right]], ids[now[right] + 1])
        low[now[~right]] = table.none
        left = now > begins
        low[now[left] - 1] = table(ids[now[left] - 1], ids[now[left]])
    return done


class Encoder:
    def __init__(self, path: str):
        self.ranks, self.tokens, self.bytes, self.ends = load_ranks(path)
        self.table = pair_table(path)
        self.cache: dict[bytes, bytes] = {}

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        coded = list(map(self.cache.get, pieces))
        missing = list({p for p, c in zip(pieces, coded) if c is None})
        if missing:
            found = {}
            short = [p for p in missing if len(p) <= LONGEST]
            found.update(zip(short, merge_all(short, self.ranks, self.table)))
            found.update((p, np.array(merge_long(p, self.ranks), "<u4").tobytes()) for p in missing if len(p) > LONGEST)
            if len(self.cache) + len(short) > CACHE:
                self.cache.clear()
            self.cache.update((p, found[p]) for p in short)
            coded = [found[p] if c is None else c for p, c in zip(pieces, coded)]
        return coded

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = []
        begin, chars = 0, 0
        for end, text in enumerate(texts):
            chars += len(text)
            if chars >= CHUNK_CHARS:
                out += self._encode(texts[begin:end + 1])
                begin, chars = end + 1, 0
        return out + (self._encode(texts[begin:]) if begin < len(texts) else [])

    def encode_with_offsets(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text with their byte offsets, the text's length last: what decoding takes."""
        return [(ids, self.offsets(ids)) for ids in self.encode(texts)]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        breaks = np.cumsum(lengths + 1)[:-1] - 1
        kinds = _classes()[codes]
        kinds[breaks] = BREAK
        starts = slice_starts(codes, kinds)
        at = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])
        stops = np.append(starts[1:], codes.size)
        cut = np.searchsorted(starts, np.append(breaks, codes.size))
        filled = np.diff(cut, prepend=0) > 0
        stops[cut[filled] - 1] = np.append(breaks, codes.size)[filled]
        data = joined.encode("utf-8", "surrogatepass")
        coded = self._ids([data[a:b] for a, b in zip(at[starts].tolist(), at[stops].tolist())])
        first = [0, *cut.tolist()]
        return [np.frombuffer(b"".join(coded[a:b]), "<u4") for a, b in zip(first, first[1:])]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of every id in its text, and the text's length."""
        return np.concatenate([[0], np.cumsum(self.ends[ids.astype(np.int64) + 1] - self.ends[ids])])

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """The bytes of a text: each id's bytes are gathered to the id's offset."""
        offsets = self.offsets(ids) if offsets is None else offsets
        if offsets[-1] == 0:
            return b""
        shift = np.repeat(self.ends[ids] - offsets[:-1], np.diff(offsets))
        return self.bytes[shift + np.arange(offsets[-1])].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder, and so one cache, per worker and vocabulary."""
    return Encoder(path)


def _run(path: str, columns: tuple[str, ...]):
    """Encode each batch; ``columns`` of doc_id, n_tokens, ids, offsets, ids_sha256 and decoded_sha256 come out. Decoding takes the offsets that encoding gave."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        make = {"n_tokens": lambda i, o: i.size, "ids": lambda i, o: i.tobytes(), "offsets": lambda i, o: o[:-1].astype("<u4").tobytes(),
                "ids_sha256": lambda i, o: hashlib.sha256(i.tobytes()).hexdigest(), "decoded_sha256": lambda i, o: hashlib.sha256(coder.decode(i, o)).hexdigest()}
        for batch in (part for whole in batches for part in slices(whole, 1)):
            texts = batch.column(1).to_pylist()
            for begin, end in _groups(texts):
                coded = coder.encode_with_offsets(texts[begin:end])
                given = [pa.array([make[c](i, o) for i, o in coded], KINDS[c]) for c in columns]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), *given], names=["doc_id", *columns])
    return run


KINDS = {"n_tokens": pa.int64(), "ids": pa.binary(), "offsets": pa.binary(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def _mapped(docs: DataFrame, path: str, *columns: str) -> DataFrame:
    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return _input(docs).mapInArrow(_run(path, columns), ", ".join(["doc_id long", *(f"{c} {kinds[KINDS[c]]}" for c in columns)]))


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``CHUNK_CHARS`` characters."""
    begin, chars = 0, 0
    for end, text in enumerate(texts, 1):
        chars += len(text)
        if chars >= CHUNK_CHARS or end == len(texts):
            yield begin, end
            begin, chars = end, 0


def _input(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession, small=True)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def encode(docs: DataFrame, path: str, offsets: bool = True) -> DataFrame:
    """``(doc_id, n_tokens, ids, offsets)``: ids and, if asked for, their byte offsets, as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. Repeated rows come out as often as they go in; other
    columns are not looked at; an empty table gives no rows.
    """
    return _mapped(docs, path, "n_tokens", "ids", *["offsets"] * offsets)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``encode`` with offsets and, decoded from both, ``decoded_sha256`` of each text's bytes (lowercase hex)."""
    return _mapped(docs, path, "n_tokens", "ids", "offsets", "decoded_sha256")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, content)``: the bytes of encoded documents, by their offsets where they were kept."""
    kept = "offsets" in encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            content = []
            for row in zip(*(c.to_pylist() for c in batch.columns[1:])):
                ids = np.frombuffer(row[0], "<u4")
                stops = np.append(np.frombuffer(row[1], "<u4"), 0).astype(np.int64) if kept else None
                if kept and ids.size:
                    stops[-1] = stops[-2] + coder.offsets(ids[-1:])[-1]
                content.append(coder.decode(ids, stops))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], names=["doc_id", "content"])

    ship(encoded.sparkSession, small=True)
    return encoded.select("doc_id", "ids", *["offsets"] * kept).mapInArrow(run, "doc_id long, content binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of encoding and decoding each text, in one pass without a shuffle."""
    return _mapped(docs, path, "n_tokens", "ids_sha256", "decoded_sha256")
