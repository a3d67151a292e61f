"""Exact ranked lexical search of an item table over all documents, by two trees.

1. One pass cuts the documents into terms and keeps, packed, the counts of those terms that
   the items hold. It also gives the corpus figures: documents and terms in all, and in how
   many documents each item term stands.
2. A packed row of documents becomes a tree: halves along the direction in which they differ
   most, down to leaves of ``LEAF`` documents. Each node holds the largest impact of each term below it.
   The items have a tree of the same kind, with the largest weight of each term.
3. The product of the two maxima bounds every score below a pair of nodes. A pair whose bound
   is below the weakest kth score of its items is left out with all that hangs under it;
   pairs are taken in order of their bounds, so the kth scores rise early. What is left at
   the leaves is scored in full.
4. The search runs twice. The first run takes only the most promising leaf of each row of
   documents for each leaf of items: the kth best of these true scores, over all rows, is a
   floor for the kth score. The second run starts from the floors.

Weights and impacts are whole numbers, and products and sums of them stay below 2**53 (this is
checked, with 64-bit integers in their place beyond it), so matrix products of doubles are exact.
Items are taken in blocks of bounded size; documents are never brought together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinefield.llm.common import ship, whole_text
from brinefield.runtime import cut

TOP = 20
LEAF = 32
ITEM_LEAF = 16
BLOCK_ITEMS = 1_000
BLOCK_TERMS = 100_000
#: Entries of one row's document matrix.
CELLS = 1 << 22
MOST_DOCS = 2_048
EXACT = 1 << 53

#: A term holds digits, letters and every sign beyond ASCII; only A-Z are lowered.
_TERM = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERM).split(b" ")


# ---- documents -------------------------------------------------------------------

PACKED = "docs long, terms long, ids binary, lengths binary, stops binary, term binary, times binary"


def _pack(vocabulary, most: int):
    """Rows of at most ``most`` documents: each document's item terms (numbers and counts), and the figures of all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(vocabulary.value)}
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                known = part.column(0).is_valid().to_numpy(zero_copy_only=False)
                lengths, found = np.zeros(part.num_rows, np.int64), []
                for k, text in enumerate(part.column(1).to_pylist()):
                    words = terms_of(text)
                    blanks = words.count(b"")
                    lengths[k] = len(words) - blanks
                    hits = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
                    found.append(hits[hits >= 0] + k * len(number))
                pairs, times = np.unique(np.concatenate(found), return_counts=True)
                owner, term = np.divmod(pairs, max(1, len(number)))
                # Documents without an id or an item term count in the figures only; terms in documents without an id too.
                stops = np.cumsum(np.bincount(owner, minlength=part.num_rows))
                ids = part.column(0).fill_null(0).to_numpy()
                yield pa.RecordBatch.from_arrays([
                    pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]), pa.array([np.where(known, ids, 0).astype("<i8").tobytes()], pa.binary()),
                    pa.array([np.where(known, lengths, -lengths).astype("<i8").tobytes()], pa.binary()), pa.array([stops.astype("<i8").tobytes()], pa.binary()),
                    pa.array([term.astype("<i4").tobytes()], pa.binary()), pa.array([times.astype("<i4").tobytes()], pa.binary())],
                    names=["docs", "terms", "ids", "lengths", "stops", "term", "times"])
    return run


def _frequencies(n_terms: int):
    """How many of a task's documents hold each item term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=n_terms)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["t", "df"])
    return run


def weight(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(times: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """The whole-number part of a term's score that depends on the document."""
    longest = int(lengths.max(initial=0))
    if 25 * longest * n < 1 << 62:
        m = 75 + 25 * lengths * n // total
    else:
        m = np.array([75 + 25 * int(x) * n // total for x in lengths], np.int64)
    return 1_000_000_000 * times // (1000 * times + 12 * m)


# ---- trees -----------------------------------------------------------------------

def parted(part: np.ndarray, steps: int = 4) -> tuple[np.ndarray, int]:
    """An order of the rows along the direction in which they differ most, and where its middle has the widest gap."""
    rows = part / np.maximum(part.max(axis=0), 1)
    rows = rows - rows.mean(axis=0)
    direction = rows[np.argmax((rows ** 2).sum(axis=1))]
    for _ in range(steps):
        direction = rows.T @ (rows @ direction)
        direction = direction / max(np.abs(direction).max(initial=0), 1e-300)
    along = rows @ direction
    order = np.argsort(along, kind="stable")
    low, high = order.size // 4, order.size - order.size // 4
    return order, low + int(np.argmax(np.diff(along[order[low - 1:high + 1]])))


class Tree:
    """Rows of a matrix, halved where they differ most; each node has the maxima of its rows.

    Nodes are numbered from the root at 0. ``kids[node]`` is a pair of nodes or None, and
    ``rows[node]`` the rows below it.
    """

    def __init__(self, matrix: np.ndarray, leaf: int):
        self.rows: list[np.ndarray] = [np.arange(len(matrix))]
        self.kids: list[tuple[int, int] | None] = []
        maxima = []
        node = 0
        while node < len(self.rows):
            rows = self.rows[node]
            part = matrix[rows]
            maxima.append(part.max(axis=0))
            if rows.size <= leaf:
                self.kids.append(None)
            else:
                order, half = parted(part)
                self.kids.append((len(self.rows), len(self.rows) + 1))
                self.rows += [rows[order[:half]], rows[order[half:]]]
            node += 1
        self.maxima = np.array(maxima)
        self.leaves = [k for k, kids in enumerate(self.kids) if kids is None]


class Items:
    """A block's items: term weights, their tree, and the kth scores that each task starts from."""

    def __init__(self, n_terms: int, stops: np.ndarray, term: np.ndarray, weights: np.ndarray):
        """``term`` and ``weights`` list the items' terms one item after another; ``stops`` ends each."""
        self.n = stops.size
        self.exact = bool(np.add.reduceat(np.append(weights, 0), np.append(0, stops[:-1])).max(initial=0) < EXACT // 1_000_000)
        matrix = np.zeros((self.n, n_terms), np.float64 if self.exact else np.int64)
        np.add.at(matrix, (np.repeat(np.arange(self.n), np.diff(np.append(0, stops))), term), weights)
        self.tree = Tree(matrix, ITEM_LEAF)
        self.columns = {k: np.flatnonzero(self.tree.maxima[k]) for k in self.tree.leaves}
        self.weights = {k: np.ascontiguousarray(matrix[np.ix_(self.tree.rows[k], self.columns[k])].T) for k in self.tree.leaves}


class Search:
    """The best documents of each item over the document rows given so far."""

    def __init__(self, items: Items, floors: np.ndarray, top: int):
        self.items, self.top = items, top
        self.kth = floors.copy()
        self.scores = [np.zeros(0, np.int64)] * items.n
        self.ids = [np.zeros(0, np.int64)] * items.n
        self.looked = self.passed = 0

    def weakest(self) -> np.ndarray:
        """The lowest kth score below each node of items; below 1 nothing counts."""
        return np.array([max(1, self.kth[rows].min()) for rows in self.items.tree.rows])

    def score(self, matrix: np.ndarray, rows: np.ndarray, ids: np.ndarray, leaf: int) -> None:
        tree = self.items.tree
        found = matrix[np.ix_(rows, self.items.columns[leaf])] @ self.items.weights[leaf]
        own = tree.rows[leaf]
        for j in np.flatnonzero((found >= np.maximum(self.kth[own], 1)).any(axis=0)).tolist():
            item = int(own[j])
            new = np.flatnonzero(found[:, j] >= max(1, self.kth[item]))
            scores = np.concatenate([self.scores[item], found[new, j].astype(np.int64)])
            named = np.concatenate([self.ids[item], ids[rows[new]]])
            best = np.lexsort((named, -scores))[:self.top]
            self.scores[item], self.ids[item] = scores[best], named[best]
            if best.size == self.top:
                self.kth[item] = max(self.kth[item], scores[best[-1]])

    def add(self, matrix: np.ndarray, ids: np.ndarray, sample: bool) -> None:
        """Search one matrix of documents, all of it or only the most promising leaf for each leaf of items."""
        docs, items = Tree(matrix, LEAF), self.items.tree
        bounds = docs.maxima @ items.maxima.T
        if sample:
            for leaf in items.leaves:
                self.score(matrix, docs.rows[docs.leaves[int(np.argmax(bounds[docs.leaves, leaf]))]], ids, leaf)
            return
        weakest, open_ = self.weakest(), [(0, 0)]
        while open_:
            d, i = open_.pop()
            if bounds[d, i] < weakest[i]:
                continue
            below, beside = docs.kids[d], items.kids[i]
            if below is None and beside is None:
                self.looked += 1
                self.score(matrix, docs.rows[d], ids, i)
                weakest[i] = max(1, self.kth[items.rows[i]].min())
                continue
            halves = [(k, i) for k in below] if below and (beside is None or docs.rows[d].size * ITEM_LEAF >= items.rows[i].size * LEAF) else [(d, k) for k in beside]
            open_ += sorted(halves, key=lambda pair: bounds[pair])
        self.passed += len(docs.leaves) * len(items.leaves)


def _search(block, floors: np.ndarray, n: int, total: int, top: int, sample: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_terms, *lists = block.value
        items = Items(n_terms, *lists)
        search = Search(items, floors, top)
        for batch in batches:
            for raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids, lengths, stops = (np.frombuffer(r, "<i8") for r in raw[:3])
                term, times = (np.frombuffer(r, "<i4").astype(np.int64) for r in raw[3:])
                counts = np.diff(np.append(0, stops))
                live = np.flatnonzero((counts > 0) & (lengths > 0))
                if not live.size:
                    continue
                owner = np.repeat(np.arange(ids.size), counts)
                matrix = np.zeros((ids.size, n_terms), np.float64 if items.exact else np.int64)
                matrix[owner, term] = impacts(times, np.abs(lengths)[owner], n, total)
                search.add(matrix[live], ids[live], sample)
        item = np.repeat(np.arange(items.n), [s.size for s in search.scores])
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.concatenate(search.ids)), pa.array(np.concatenate(search.scores)),
                                          pa.array(np.full(item.size, search.looked)), pa.array(np.full(item.size, search.passed))], names=["item", "doc_id", "score", "looked", "passed"])
    return run


FOUND = "item long, doc_id long, score long, looked long, passed long"


# ---- Spark -----------------------------------------------------------------------

def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [[w for w in terms_of(t) if w] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b" ".join(w) for w in words], pa.binary()), pa.array([len(w) for w in words], pa.int64())], names=["item_id", "words", "n"])


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _block(docs: DataFrame, rows: list, top: int) -> DataFrame:
    """``(item, rank, doc_id, score, looked, passed)`` of the items of one block; ``item`` is the place in ``rows``."""
    spark = docs.sparkSession
    lists = [bytes(r["words"]).split(b" ") for r in rows]
    vocabulary = sorted({w for words in lists for w in words})
    number = {w: k for k, w in enumerate(vocabulary)}
    most = min(MOST_DOCS, max(LEAF, CELLS // len(vocabulary)))
    packed = cut(docs.mapInArrow(_pack(spark.sparkContext.broadcast(vocabulary), most), PACKED))
    n, total = packed.agg(F.sum("docs"), F.sum("terms")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in packed.select("term").mapInArrow(_frequencies(len(vocabulary)), "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():
        df[r["t"]] = r["df"]
    own = [weight(int(x), n or 0) for x in df]
    stops = np.cumsum([len(w) for w in lists])
    term = np.array([number[w] for words in lists for w in words], np.int64)
    block = spark.sparkContext.broadcast((len(vocabulary), stops, term, np.array(own, np.int64)[term]))
    bodies = packed.select("ids", "lengths", "stops", "term", "times")
    floors = np.zeros(len(rows), np.int64)
    seeds = _ranked(bodies.mapInArrow(_search(block, floors, n, total, top, True), FOUND), top)
    for r in seeds.filter(F.col("rank") == top).select("item", "score").collect():
        floors[r["item"]] = r["score"]
    return _ranked(bodies.mapInArrow(_search(block, floors, n, total, top, False), FOUND), top)


def best_documents(items: DataFrame, docs: DataFrame, top: int = TOP, block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """One row per item and found document: item_id, rank, doc_id, score, and a task's leaf pairs ``looked`` at and ``passed``.

    An item's ``top`` best documents with a score above 0 are found, equal scores by ascending
    doc_id. Null texts and texts without a term count in no figure and find nothing. Documents
    with a null id count in the corpus figures but are never named. Every row of either table
    stands for itself: an item row that repeats is answered twice, and a document row that
    repeats can be named twice. Other columns are not looked at; an empty table of either kind
    gives no rows. Items are dealt by hash into blocks of about ``block_items`` items and
    ``block_terms`` terms, and each block passes over the documents once.
    """
    spark = ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    words = items.select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text")).mapInArrow(_item_terms, "item_id long, words binary, n long").filter("n > 0")
    words = cut(words.withColumn("item_row", F.monotonically_increasing_id()))
    count, terms = words.agg(F.count("*"), F.sum("n")).first()
    blocks = max(math.ceil(count / block_items), math.ceil((terms or 0) / block_terms))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long, looked long, passed long")
    home = F.pmod(F.xxhash64("item_row"), F.lit(max(1, blocks)))
    for b in range(blocks):
        rows = words.filter(home == b).orderBy("item_row").collect()
        if not rows:
            continue
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], "item long, item_id long")
        found = _block(texts, rows, top).join(names, "item").select("item_id", "rank", "doc_id", "score", "looked", "passed")
        out = out.unionByName(cut(found) if blocks > 1 else found)
    return out
