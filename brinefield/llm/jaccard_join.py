"""Near copies by n-gram Jaccard similarity: a size-aware heavy-light join.

A document's set holds its distinct word shingles as 64-bit hashes. Equal sets are one
class, joined by a digest of the whole set. Classes are the nodes of the search, one row of
each enters it, and ids come in when links join their documents: an id that repeats may
stand in many classes. The classes are split by set size at a boundary that the size
histogram chooses by cost.

* Light sets enumerate subsets of fixed size: of a set with s shingles, all subsets that
  leave out at most floor((1 - t) * s) of them. Two sets link exactly when they share a
  subset that is large enough for their union. Subset digests are sums of element hashes,
  so leaving out elements is a subtraction. In a list of sets that share a subset, the
  smallest set links whatever any two of them link, so a list costs its length.
* Heavy sets scan inverted lists. A list's key is a block: shingles are dealt over p blocks
  by hash, and p exceeds the number of shingles in which two linked sets of this size band
  can differ, so they hold several equal blocks, and a set that shares fewer lists than
  that takes no further part. (A list per single shingle
  would be as complete, but a passage that a third of all documents hold would put a third
  of all documents on one list. A block of some eight shingles is shared by near copies.)
  Sets near a band's upper end also enter the next band's lists.

The members of a list are compared with one member of it, chosen anew each round, by exact
set intersection. Linked sets merge into components, and lists whose members are in one
component are done. What is left after ``ROUNDS`` rounds are lists of sets that mostly do
not link. Their members are compared in chunks of ``CHUNK`` by parity sketches: bit k is
the parity of the shingles that hash to k, so two sketches never differ in more bits than
their sets differ in shingles. That bound is certain: a pair beyond the most that linked
sets can differ is no link. Of the other pairs a forest becomes rows and is intersected, so
rows stay below a list's length; sketches get finer from round to round, and no link is lost.
(The comparisons themselves, some nanoseconds each, grow with the square of such a list.)
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinefield.llm.common import fresh_name, ship, slices, whole_text
from brinefield.llm.line_dedup import SEGMENTED, SHIP_BYTES, TWICE_BITS, Bloom, packed_by_segment, probe, shipped, twice_seen
from brinefield.operators.components import components
from brinefield.runtime import cut, free

SHINGLE = 3
PERCENT = 90
SPARE = 3
BAND = 1.5
ROUNDS = 2
CHUNK = 8192
#: Bits a shingle of each comparison of lists, and whether only a forest of the possible links is verified.
FINER = ((1, True), (8, True), (8, False))
LARGEST_LIGHT = 39
MOST_SUBSETS = 5_000
PER_SEGMENT = 5_000
REMEMBERED = 10_000

_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


# ---- sets ---------------------------------------------------------------------

def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of a common generator, used for dealing and digests)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_byte_values = mix(np.arange(1, 257, dtype=np.uint64) * _FACTORS[0])
_powers: list[np.ndarray] = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    """1, f, f**2, ... modulo 2**64, kept as long as any text needed so far."""
    if _powers[0].size < n:
        grown = np.full(max(n, 2 * _powers[0].size), _FACTORS[1], np.uint64)
        grown[0] = 1
        _powers[0] = np.multiply.accumulate(grown)
    return _powers[0]


INVERSE = np.uint64(pow(int(_FACTORS[1]), -1, 1 << 64))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word, from running sums over the whole text: no loop over words."""
    b = np.frombuffer(data.lower(), np.uint8)
    solid = ~((b == 32) | ((b >= 9) & (b <= 13)))
    if not solid.any():
        return np.zeros(0, np.uint64)
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    p = powers(b.size + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_byte_values[b] * p[:b.size], dtype=np.uint64)])
    return mix((total[ends] - total[starts]) * inverse_powers(b.size + 1)[starts] + (ends - starts).astype(np.uint64) * _FACTORS[2])


_inverse: list[np.ndarray] = [np.ones(1, np.uint64)]


def inverse_powers(n: int) -> np.ndarray:
    if _inverse[0].size < n:
        grown = np.full(max(n, 2 * _inverse[0].size), INVERSE, np.uint64)
        grown[0] = 1
        _inverse[0] = np.multiply.accumulate(grown)
    return _inverse[0]


def shingle_set(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; the whole sequence is one shingle where words are too few."""
    words = word_hashes(text.encode("utf-8", "surrogatepass"))
    if not words.size:
        return words
    take = min(width, words.size)
    h = np.full(words.size - take + 1, np.uint64(take), np.uint64)
    for k in range(take):
        h = mix(h * _FACTORS[0] + words[k:words.size - take + 1 + k])
    return np.unique(h)


def shingle_sets(texts: list[str], width: int = SHINGLE) -> Iterator[np.ndarray]:
    """``shingle_set`` of each text; words are hashed and shingled for some hundred kilobytes of texts at a time."""
    held, size = [], 0
    for k, text in enumerate(texts, 1):
        held.append(text.encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size < 1 << 19 and k < len(texts):
            continue
        data = b"\n".join(held)
        solid = np.frombuffer(data, np.uint8)
        solid = ~((solid == 32) | ((solid >= 9) & (solid <= 13)))
        before = np.concatenate([[False], solid[:-1]])
        begins = np.concatenate([[0], np.cumsum(solid & ~before)])
        at = np.cumsum([0, *(len(h) + 1 for h in held)])
        edges = begins[np.minimum(at, begins.size - 1)].tolist()
        words = word_hashes(data)
        h = np.full(max(0, words.size - width + 1), np.uint64(width), np.uint64)
        for j in range(width):
            h = mix(h * _FACTORS[0] + words[j:words.size - width + 1 + j])
        for raw, a, b in zip(held, edges, edges[1:]):
            yield np.unique(h[a:b - width + 1]) if b - a >= width else shingle_set(raw.decode("utf-8", "surrogatepass"), width)
        held, size = [], 0


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(a.size, b.size) < percent * max(a.size, b.size):
        return False
    common = np.intersect1d(a, b, assume_unique=True).size
    return 100 * common >= percent * (a.size + b.size - common)


# ---- keys of the lists --------------------------------------------------------

def most_missing(size: int, percent: int = PERCENT) -> int:
    """Shingles of a set that any linked set may lack."""
    return size - -(-size * percent // 100)


def light_keys(s: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Digests and sizes of all subsets that leave out at most ``most_missing`` shingles."""
    spread = mix(s ^ _FACTORS[2])
    total = np.array([spread.sum(dtype=np.uint64)])
    digests, sizes = [total], [np.array([s.size])]
    sums, last = total, np.array([-1])
    for k in range(1, most_missing(s.size, percent) + 1):
        pairs = [(i, j) for i in range(sums.size) for j in range(int(last[i]) + 1, s.size)] if k > 1 else [(0, j) for j in range(s.size)]
        at = np.array(pairs, np.int64).reshape(-1, 2)
        sums, last = sums[at[:, 0]] - spread[at[:, 1]], at[:, 1]
        digests.append(sums)
        sizes.append(np.full(sums.size, s.size - k))
    sizes_all = np.concatenate(sizes)
    return mix(np.concatenate(digests) + sizes_all.astype(np.uint64) * _FACTORS[0]), sizes_all


def band_of(size: int) -> int:
    return int(math.log(size) / math.log(BAND) + 1e-9)


@lru_cache(maxsize=256)
def band_limits(band: int) -> tuple[int, int]:
    """Smallest and largest size of a band."""
    low = next(n for n in range(max(1, int(BAND ** band) - 1), int(BAND ** band) + 3) if band_of(n) >= band)
    high = next(n for n in range(int(BAND ** (band + 1)) + 2, 0, -1) if band_of(n) <= band)
    return low, high


@lru_cache(maxsize=256)
def most_different(band: int, percent: int = PERCENT) -> int:
    """Shingles in which two linked sets can differ when the larger is in this band."""
    largest = band_limits(band)[1]
    return max(0, *((a + largest) - 2 * -(-percent * (a + largest) // (100 + percent)) for a in range(-(-largest * percent // 100), largest + 1)))


def spare(band: int, percent: int = PERCENT) -> int:
    return max(SPARE, most_different(band, percent) // 5)


def blocks_for(band: int, percent: int = PERCENT) -> int:
    """So many blocks that linked sets agree in more than ``spare`` of them."""
    return most_different(band, percent) + 1 + spare(band, percent)


def heavy_keys(s: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of the set's blocks in its own band and, near the band's end, in the next; bands; and needs.

    Linked sets agree in at least ``spare`` + 1 blocks of a band. Empty blocks, in which
    unrelated sets agree, are left out where they are at most ``spare``. The need is the
    number of shared lists without which the set has no link in this band: blocks empty in
    both sets are no shared list where either set leaves them out, and they are no more
    than the set's own empty blocks and no more than ``spare``.
    """
    spread = mix(s ^ _FACTORS[1])
    out, bands, needs = [], [], []
    own = band_of(s.size)
    for band in (own, own + 1):
        if band != own and 100 * s.size < percent * band_limits(band)[0]:
            continue
        p, extra = blocks_for(band, percent), spare(band, percent)
        home = (mix(spread ^ _FACTORS[0]) % np.uint64(p)).astype(np.int64)
        filled = np.bincount(home, minlength=p)
        order = np.argsort(home, kind="stable")
        running = np.concatenate([[np.uint64(0)], np.cumsum(spread[order], dtype=np.uint64)])
        stops = np.cumsum(filled)
        sums = running[stops] - running[stops - filled]
        keys = mix(sums + np.arange(p, dtype=np.uint64) * _FACTORS[0] + np.full(p, band, np.uint64) * _FACTORS[2] + filled.astype(np.uint64))
        empty = int((filled == 0).sum())
        out.append(keys[filled > 0] if empty <= extra else keys)
        bands.append(np.full(out[-1].size, band))
        needs.append(np.full(out[-1].size, extra + 1 - min(empty, extra)))
    return np.concatenate(out), np.concatenate(bands), np.concatenate(needs)


def light_cost(size: int, percent: int = PERCENT) -> int:
    return sum(math.comb(size, k) for k in range(most_missing(size, percent) + 1))


def heavy_cost(size: int, percent: int = PERCENT) -> int:
    """Lists entered; a heavy candidate is also verified, which a light one is not, hence the factor."""
    own = band_of(size)
    return 2 * sum(blocks_for(b, percent) for b in (own, own + 1) if b == own or 100 * size >= percent * band_limits(b)[0])


def reach_of(light: int, percent: int = PERCENT) -> int:
    """The largest set that a light one can link with."""
    return light * 100 // percent


def boundary(histogram: dict[int, int], percent: int = PERCENT) -> int:
    """The largest light size: the split of least total cost, at a size that occurs, or 0.

    Sets above the boundary that light ones can link with enter both kinds of lists, and
    both count. ``MOST_SUBSETS`` bounds what one such set lists; larger sets are heavy.
    """
    at, best = 0, sum(n * heavy_cost(s, percent) for s, n in histogram.items())
    for size in sorted(s for s, n in histogram.items() if n and 0 < s <= LARGEST_LIGHT):
        reach = reach_of(size, percent)
        if light_cost(reach, percent) > MOST_SUBSETS:
            break
        total = sum(n * ((s <= reach) * light_cost(min(s, reach), percent) + (s > size) * heavy_cost(s, percent)) for s, n in histogram.items())
        if total <= best:
            at, best = size, total
    return at


# ---- sketches -----------------------------------------------------------------

def sketch(s: np.ndarray, each: int = FINER[0][0]) -> bytes:
    """Parity of the shingles at each of at least ``each`` bits a shingle, a power of two of them."""
    bits = 256
    while bits < each * s.size:
        bits *= 2
    return np.packbits((np.bincount((mix(s ^ _FACTORS[1]) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, each folded by XOR to the shortest one's length."""
    words = min(map(len, sketches)) // 8
    rows = np.zeros((len(sketches), words), np.uint64)
    for k, raw in enumerate(sketches):
        rows[k] = np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, words), axis=0)
    return rows


def near_pairs(rows: np.ndarray, n: np.ndarray, part: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int = PERCENT, taken: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of left and right positions in different components whose sketches leave a link possible.

    With ``taken`` each right position is paired with its first left one only, and marked.
    """
    for i in left.tolist():
        near = right[right > i]
        if taken is not None:
            near = near[~taken[near]]
        near = near[(part[near] != part[i]) & (100 * np.minimum(n[i], n[near]) >= percent * np.maximum(n[i], n[near]))]
        if not near.size:
            continue
        total = n[i] + n[near]
        most = total - 2 * -(-percent * total // (100 + percent))
        differ = np.bitwise_count(rows[near] ^ rows[i]).sum(axis=1, dtype=np.int64)
        near = near[differ <= most]
        if taken is not None:
            taken[near] = True
        if near.size:
            yield np.full(near.size, i), near


# ---- Spark --------------------------------------------------------------------

def _keyed_docs(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text, which tells rows of one id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), F.xxhash64(whole_text()).alias("row"))


def class_number(s: np.ndarray, salt: int) -> int:
    """A set's node: 64 bits of a digest."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little", signed=True)


def _measure(width: int, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            sizes, digests, nodes = [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), width):
                sizes.append(s.size)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                nodes.append(class_number(s, salt))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(nodes, pa.int64())],
                                             names=["doc_id", "row", "n", "whole", "node"])
    return run


def _keys(width: int, percent: int, light: int, salt: int | None = None):
    """(node, n, keys, sizes, needs) of each text. Light keys have the subset's size, heavy keys -1 - band.

    The node is the text's class where a salt is given, and each class enters once among
    the last ``REMEMBERED`` ones of a task; else the first column.
    """
    reach = reach_of(light, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in (part for whole in batches for part in slices(whole, 1)):
            if len(seen) > REMEMBERED:
                seen.clear()
            keys, sizes, needs, counts, nodes = [], [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), width):
                if salt is not None:
                    node = class_number(s, salt)
                    if node in seen:
                        continue
                    seen.add(node)
                    nodes.append(node)
                k, z, w = [], [], []
                if 0 < s.size <= reach and light:
                    a, b = light_keys(s, percent)
                    k.append(a)
                    z.append(b)
                    w.append(np.ones(a.size, np.int64))
                if s.size > light:
                    a, bands, need = heavy_keys(s, percent)
                    k.append(a)
                    z.append(-1 - bands)
                    w.append(need)
                keys.append(np.concatenate(k).view(np.int64) if k else np.zeros(0, np.int64))
                sizes.append(np.concatenate(z) if z else np.zeros(0, np.int64))
                needs.append(np.concatenate(w) if w else np.zeros(0, np.int64))
                counts.append(s.size)
            stops = np.concatenate([[0], np.cumsum([k.size for k in keys])]).astype(np.int32)
            whole = [pa.ListArray.from_arrays(pa.array(stops), pa.array(np.concatenate(x).astype(t) if x else np.zeros(0, t))) for x, t in ((keys, np.int64), (sizes, np.int32), (needs, np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0) if salt is None else pa.array(nodes, pa.int64()), pa.array(counts, pa.int32()), *whole], names=["node", "n", "keys", "sizes", "needs"])
    return run


def _numbers(wanted: DataFrame, ship_bytes: int = SHIP_BYTES):
    """The numbers of a one-column table, sorted, as a broadcast variable if they are small enough, else None.

    Texts and sets are long: a table of eight bytes a row tells tasks which of them to keep, and none of them moves.
    """
    if 8 * wanted.count() > ship_bytes:
        return None
    return wanted.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow().column(0).to_numpy()))


def _among(batch: pa.RecordBatch, chosen) -> pa.RecordBatch:
    """The rows whose first column is among the chosen numbers; all of them where none are given."""
    if chosen is None:
        return batch
    at, known = batch.column(0).to_numpy(), chosen.value
    return batch.filter(pa.array(known[np.minimum(np.searchsorted(known, at), known.size - 1)] == at if known.size else np.zeros(at.size, bool)))


def _sets(width: int, salt: int, chosen=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(_among(whole, chosen), 1)):
            found = list(shingle_sets(batch.column(1).to_pylist(), width))
            yield pa.RecordBatch.from_arrays([pa.array([class_number(s, salt) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary()), pa.array([sketch(s) for s in found], pa.binary())],
                                             names=["node", "members", "sketch"])
    return run


def _verify(percent: int):
    """Rows (a, b, members) in order, the two sets of a pair after one another: the pairs that link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            found = []
            for pair, raw in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2)):
                members = np.frombuffer(raw.as_py(), np.uint64)
                if held is not None and held[0] == pair:
                    if linked(held[1], members, percent):
                        found.append(pair)
                    held = None
                else:
                    held = pair, members
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def _passing(percent: int):
    """The pairs (a, b, total, sketch, sketch) whose sketches leave a link possible; total is the sum of the sizes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for total, x, y in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                rows = folded([x, y])
                ok.append(int(np.bitwise_count(rows[0] ^ rows[1]).sum()) <= total - 2 * -(-percent * total // (100 + percent)))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


LISTED = "key long, size int, need int, node long, n int"


def _pack(segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield packed_by_segment(found, counts > 1, segments)
    return run


def _suspects(packed, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blooms = {s: Bloom(n, bits, TWICE_BITS) for s, (n, bits) in packed.value.items()}
        for batch in batches:
            keys = batch.column(2).flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(2).offsets.to_numpy()))
            hit = np.flatnonzero(probe(blooms, keys, segments))
            rows = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), batch.column(3).flatten().take(pa.array(hit)), batch.column(4).flatten().take(pa.array(hit)),
                                              batch.column(0).take(rows), batch.column(1).take(rows)], names=["key", "size", "need", "node", "n"])
    return run


ROUTED = "segment int, n long, bits binary, keys binary, nodes binary, sizes binary"


def _route(segments: int):
    """Packed keys of a batch by segment, with the node and (n, size, need) of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2).flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(2).offsets.to_numpy()))
            nodes = batch.column(0).to_numpy()[owner]
            values = np.stack([batch.column(1).to_numpy()[owner], batch.column(3).flatten().to_numpy(), batch.column(4).flatten().to_numpy()], axis=1).astype(np.int32)
            home = (keys.view(np.uint64) % np.uint64(segments)).astype(np.int32)
            order = np.argsort(home, kind="stable")
            keys, nodes, values = keys[order], nodes[order], values[order]
            numbers, starts = np.unique(home[order], return_index=True)
            cuts = list(zip(starts.tolist(), np.append(starts[1:], keys.size).tolist()))
            none = [None] * len(cuts)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(none, pa.int64()), pa.array(none, pa.binary()), pa.array([keys[a:b].tobytes() for a, b in cuts], pa.binary()),
                                              pa.array([nodes[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([values[a:b].tobytes() for a, b in cuts], pa.binary())],
                                             names=["segment", "n", "bits", "keys", "nodes", "sizes"])
    return run


def _probe_routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive by segment, its filter first."""
    bloom = None
    for batch in batches:
        for k in range(batch.num_rows):
            if batch.column(2)[k].is_valid:
                bloom = Bloom(batch.column(1)[k].as_py(), batch.column(2)[k].as_py(), TWICE_BITS)
                continue
            keys = np.frombuffer(batch.column(3)[k].as_py(), np.int64)
            hit = np.flatnonzero(bloom.holds(keys))
            nodes = np.frombuffer(batch.column(4)[k].as_py(), np.int64)[hit]
            values = np.frombuffer(batch.column(5)[k].as_py(), np.int32).reshape(-1, 3)[hit]
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), pa.array(values[:, 1].copy()), pa.array(values[:, 2].copy()), pa.array(nodes), pa.array(values[:, 0].copy())],
                                             names=["key", "size", "need", "node", "n"])


def _repeated(keyed: DataFrame, ship_bytes: int = SHIP_BYTES) -> DataFrame:
    """``(key, size, need, node, n)`` of the keys that may stand in two sets.

    Most keys stand in one set only. Packed keys pass through the once-seen and twice-seen
    filters, and only hits of the latter become rows. Filters small enough to ship are
    broadcast; beyond that the packed keys go to their segment's filter. What follows is
    exact either way.
    """
    segments = max(16, math.ceil(keyed.count() / PER_SEGMENT))
    filters = twice_seen(keyed.select("keys").mapInArrow(_pack(segments), SEGMENTED))
    packed = shipped(filters, ship_bytes)
    if packed is not None:
        return keyed.mapInArrow(_suspects(packed, segments), LISTED)
    first = filters.select("segment", "n", "bits", *[F.lit(None).cast("binary").alias(c) for c in ("keys", "nodes", "sizes")])
    routed = first.unionByName(keyed.mapInArrow(_route(segments), ROUTED))
    return routed.repartition("segment").sortWithinPartitions("segment", F.col("bits").isNull()).mapInArrow(_probe_routed, LISTED)


def _members(listed: DataFrame) -> DataFrame:
    """Rows of lists that two sets share, without the sets that share fewer lists of a band than a link needs.

    Two passes: dropping a set can leave others alone on a list.
    """
    found = cut(listed.distinct())
    for _ in range(2):
        shared = cut(found.groupBy("key").agg(F.min("node").alias("_a"), F.max("node").alias("_b")).filter("_a < _b").select("key"))
        several = cut(found.join(shared, "key", "left_semi"))
        free(found)
        enough = several.groupBy("node", "size").agg(F.count("*").alias("_c"), F.max("need").alias("_need")).filter("_c >= _need").select("node", "size")
        found = cut(several.join(enough, ["node", "size"], "left_semi"))
        free(several)
        free(shared)
    return found


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs those whose sets link, by exact intersection. Each pair fetches its two sets; no other set moves unless the pairs pass ``SHIP_BYTES``."""
    wanted = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    if 48 * pairs.count() <= SHIP_BYTES:
        wanted = F.broadcast(wanted)
    both = wanted.join(sets.select("node", "members"), "node").select("a", "b", "members")
    return cut(both.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_verify(percent), "a long, b long"))


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``(a, b, total)`` the pairs that the sketches let pass: a set is some 64 times as long as its sketch."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("sketch").alias(f"_{side}")), side)
    return cut(pairs.select("a", "b", "total", "_a", "_b").mapInArrow(_passing(percent), "a long, b long"))


def _labelled(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of the lists with their component so far; lists within one component are done and go.

    The keys are written before the join: a join with a table of its own, unlike one with
    an aggregate of the same rows, lets adaptive execution split a long list.
    """
    labels = cut(components(edges.withColumn("_g", F.lit(0)), ["_g"]).select("node", "root"))
    named = members.join(labels, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")
    mixed = cut(named.groupBy("key").agg(F.min("part").alias("_p"), F.max("part").alias("_q")).filter("_p < _q").select("key"))
    return cut(named.join(mixed, "key", "left_semi"))


def _compare(percent: int, forest: bool):
    """Rows (key, i, j, node, n, part, sketch, side) in order: pairs of chunk i with chunk j of a list that may link.

    As a forest each member is paired with the smallest other one that it may link with, so
    a list gives fewer pairs than it has members.
    """
    def pairs(run: list[tuple]) -> tuple[list[int], list[int]]:
        node, n, part, raw, side = zip(*run)
        order = np.argsort(np.array(node), kind="stable")
        nodes, sizes, parts, sides = (np.array(x)[order] for x in (node, n, part, side))
        rows = folded([raw[k] for k in order.tolist()])
        both = np.arange(nodes.size)
        groups = [(both, both)] if (sides == 0).all() else [(both[sides == 0], both[sides == 1]), (both[sides == 1], both[sides == 0])]
        taken = np.zeros(nodes.size, bool) if forest else None
        a, b = [], []
        for left, right in groups:
            for x, y in near_pairs(rows, sizes, parts, left, right, percent, taken):
                a += nodes[x].tolist()
                b += nodes[y].tolist()
        return a, b

    def emit(key, run):
        a, b = pairs(run) if len(run) > 1 else ([], [])
        return pa.RecordBatch.from_arrays([pa.array([key] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for k in range(batch.num_rows):
                place = (columns[0][k], columns[1][k], columns[2][k])
                if place != current:
                    if held:
                        yield emit(current[0], held)
                    current, held = place, []
                held.append(tuple(c[k] for c in columns[3:]))
        if held:
            yield emit(current[0], held)
    return run


def _sketched(each: int, chosen=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(_among(whole, chosen), 1)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sketch(np.frombuffer(m, np.uint64), each) for m in batch.column(1).to_pylist()], pa.binary())], names=["node", "sketch"])
    return run


def _leftover(open_: DataFrame, sketches: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs ``(key, a, b)`` across components of the open lists that the sketches let pass.

    A list of more than ``CHUNK`` members is cut into chunks by a hash of the node, and
    each pair of its chunks is a group of its own, so no task holds a long list.
    """
    counts = open_.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_chunks"))
    spread = open_.join(counts, "key").withColumn("_c", F.pmod(F.xxhash64("node"), F.col("_chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_o")
    dealt = spread.select("key", "node", "n", "part", "_c", other).select(
        "key", F.least("_c", "_o").alias("i"), F.greatest("_c", "_o").alias("j"), "node", "n", "part", (F.col("_c") > F.col("_o")).cast("int").alias("side"))
    rows = dealt.join(sketches, "node").select("key", "i", "j", "node", "n", "part", "sketch", "side")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compare(percent, forest), "key long, a long, b long")


def heavy_links(members: DataFrame, sets: DataFrame, edges: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links between members ``(key, node, n)`` of the inverted lists that the components need, added to ``edges``.

    First ``ROUNDS`` rounds of one head a list. Then lists are compared by sketches, each
    time with finer ones, and only a forest of the possible links is verified. A list
    without a possible link is done for good, because the sketches' bound is certain. What
    the finest sketches still leave open is verified pair by pair.
    """
    fits = (F.lit(100) * F.least("n", "_n") >= F.lit(percent) * F.greatest("n", "_n")) & (F.col("part") != F.col("_part"))
    for number in range(ROUNDS):
        open_ = _labelled(members, edges).select("key", "node", "n", "part")
        if open_.isEmpty():
            return edges
        order = F.struct(F.xxhash64("node", F.lit(number)).alias("o"), F.col("node").alias("_node"), F.col("n").alias("_n"), F.col("part").alias("_part"))
        ahead = cut(open_.groupBy("key").agg(F.min(order).alias("_head")).select("key", "_head._node", "_head._n", "_head._part"))
        pairs = open_.join(ahead, "key").filter(fits).select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b"), (F.col("n") + F.col("_n")).cast("long").alias("total")).distinct()
        edges = cut(edges.unionByName(_confirmed(_possible(cut(pairs), sets, percent), sets, percent)))
        members = open_.select("key", "node", "n")
    for each, forest in FINER:
        open_ = _labelled(members, edges).select("key", "node", "n", "part")
        if open_.isEmpty():
            return edges
        if each == FINER[0][0]:
            sketches = sets.select("node", "sketch")
        else:
            nodes = cut(open_.select("node").distinct())
            chosen = _numbers(nodes)
            left = sets if chosen is not None else sets.join(nodes, "node", "left_semi")
            sketches = left.select("node", "members").mapInArrow(_sketched(each, chosen), "node long, sketch binary")
        found = cut(_leftover(open_, sketches, percent, forest))
        if found.isEmpty():
            return edges
        edges = cut(edges.unionByName(_confirmed(cut(found.select("a", "b").distinct()), sets, percent)))
        members = cut(open_.join(cut(found.select("key").distinct()), "key", "left_semi").select("key", "node", "n"))
    return edges


def light_links(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links of the smallest set on each subset's list ``(key, size, node, n)`` with the others that it links to."""
    smallest = members.groupBy("key").agg(F.min(F.struct("n", "node")).alias("_s")).select("key", F.col("_s")["n"].alias("_n"), F.col("_s")["node"].alias("_node"))
    joined = members.join(smallest, "key").filter(F.col("node") != F.col("_node"))
    enough = F.lit(100) * F.col("size") >= F.lit(percent) * (F.col("n") + F.col("_n") - F.col("size"))
    return joined.filter(enough).select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()


def near_copies(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Null and empty texts and texts without a word have no shingles and link with nothing.
    component_id is the smallest doc_id that links reach. Rows that repeat an id count as
    one document that has the links of all its texts. A null id has component_id null and
    takes no part. Other columns are not looked at; an empty table gives no rows.
    """
    ship(docs.sparkSession, small=True)
    texts = _keyed_docs(docs)
    for salt in count():
        measured = cut(texts.mapInArrow(_measure(width, salt), "doc_id long, row long, n int, whole binary, node long"))
        real = measured.filter("doc_id IS NOT NULL AND n > 0")
        first = F.min(F.struct("doc_id", "row")).alias("_first")
        classes = cut(real.groupBy("node").agg(first, F.first("n").alias("n"), F.count("*").alias("_c"), F.min("whole").alias("_low"), F.max("whole").alias("_high"))
                      .select("node", "n", "_c", F.col("_first")["doc_id"].alias("_id"), F.col("_first")["row"].alias("_row"), (F.col("_low") < F.col("_high")).alias("_mixed")))
        if classes.filter("_mixed").isEmpty():
            break
    histogram = {r["n"]: r["c"] for r in classes.filter(F.col("n") <= reach_of(LARGEST_LIGHT, percent)).groupBy("n").agg(F.count("*").alias("c")).collect()}
    light = boundary(histogram, percent)

    same_set = real.join(classes.filter("_c > 1").select("node", "_id", "_row"), "node")
    copies = cut(same_set.filter("doc_id != _id OR row != _row").select("doc_id", "row", "_id").distinct())
    equal = copies.filter("_id < doc_id").select(F.col("_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    keyed = cut(texts.filter("doc_id IS NOT NULL").select("doc_id", "text")
                .mapInArrow(_keys(width, percent, light, salt), "node long, n int, keys array<long>, sizes array<int>, needs array<int>"))
    members = _members(_repeated(keyed))

    edges = cut(light_links(members.filter("size > 0"), percent))
    heavy = members.filter("size < 0").select("key", "node", "n")
    owners = classes.select("node", F.col("_id").alias("doc_id"), F.col("_row").alias("row"))
    wanted = cut(heavy.select("node").distinct().join(owners, "node").select("doc_id", "row"))
    number = F.xxhash64("doc_id", "row").alias("_number")
    chosen = _numbers(wanted.select(number))
    left = texts.filter("doc_id IS NOT NULL") if chosen is not None else texts.join(wanted, ["doc_id", "row"], "left_semi")
    sets = cut(left.select(number, "text").mapInArrow(_sets(width, salt, chosen), "node long, members binary, sketch binary"))
    if sets.count() > wanted.count():  # rows that repeat id and text; sets are long, so they move for nothing less
        sets = cut(sets.dropDuplicates(["node"]))
    edges = heavy_links(heavy, sets, edges, percent)
    left, right = (classes.select(F.col("node").alias(side), F.col("_id").alias(f"_{side}")) for side in ("a", "b"))
    linked_ids = edges.join(left, "a").join(right, "b").filter("_a != _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    labels = components(cut(linked_ids.unionByName(equal).distinct()).withColumn("_g", F.lit(0)), ["_g"]).select(F.col("node").alias("_node"), "root")
    named = measured.join(labels, F.col("doc_id") == F.col("_node"), "left")
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept: of each component the smallest doc_id; documents without shingles and null ids stay."""
    name = fresh_name(docs, "_gone")
    gone = cut(near_copies(docs, width, percent).filter("component_id < doc_id").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")
