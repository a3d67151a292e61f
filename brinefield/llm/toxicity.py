"""Toxicity by a learned lexicon, matched with Levenshtein automata.

The lexicon (whole words and word beginnings) is learned from a bounded sample of labelled
documents: terms that stand in toxic documents and hardly elsewhere. The terms form a
trie; every term allows 0, 1 or 2 edits by its length. Intersecting the terms' Levenshtein
automata with the trie and making the result deterministic gives one table of states. All
words of a batch walk that table side by side, one character a step, and words that can no
longer match drop out, so the cost per word does not grow with the lexicon.

Each hit is weighed by its context window: quotation marks around it or a word of
reporting before it speak for a quotation, a second person for abuse. A document's score
is that of its strongest finding: the precision that its kind (term, edits, number of
different words) had in the sample times its best context. No hit means score 0.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinefield.llm.common import fold, ship, slices, whole_text
from brinefield.runtime import cut

SAMPLE = 16_000
FOLDS = 5
FEWEST = 5
SHARE = 0.004
PURE = 0.5
EVIDENCE = 30.0
SHORTEST, LONGEST = 4, 24
TERMS = 400
CHUNK = 2_000_000
CONTEXT = 80
QUOTED, ADDRESSED = 0.7, 0.3

#: Words that report speech, and second persons, in four languages.
REPORTING = "said|says|say|wrote|writes|quoted|quote|quotes|called|calls|term|word|phrase|sagte|sagt|schrieb|zitiert|wort|nannte|dit|écrit|cite|mot|dijo|dice|escribió|cita|palabra"
PERSONS = "you|your|you're|u|du|dich|dein|deine|ihr|euch|tu|toi|ton|ta|vous|votre|te|tú|usted|eres"
_reporting = re.compile(rf"(?<!\w)({REPORTING})(?!\w)\W*(\w+\W+){{0,3}}$")
_persons = re.compile(rf"(?<!\w)({PERSONS})(?!\w)")
_opened = re.compile("[\"“«„‘][^\"”»’“«.!?\n]*$")
_closed = re.compile("^[^\"“«„.!?\n]*[\"”»’“]")


# ---- automaton ---------------------------------------------------------------

def edits_for(term: str, is_stem: bool) -> int:
    """Edits that a term allows: none below 5 letters (7 for a word beginning), 1, and 2 from 10 letters on."""
    return 0 if len(term) < (7 if is_stem else 5) else 1 if len(term) < 10 else 2


class Automaton:
    """Levenshtein automata of all terms, intersected with their trie, as one deterministic table.

    ``accept[state]`` is -1 or term * 3 + edits at a word's end; State 0 is dead. A word
    beginning that has matched keeps its verdict whatever follows, unless a better term ends.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        children: list[dict[str, int]] = [{}]
        ends: list[list[int]] = [[]]
        room = [0]
        for number, (term, is_stem) in enumerate(terms):
            node, allowed = 0, edits_for(term, is_stem)
            room[0] = max(room[0], allowed)
            for letter in term:
                if letter not in children[node]:
                    children[node][letter] = len(children)
                    children.append({})
                    ends.append([])
                    room.append(0)
                node = children[node][letter]
                room[node] = max(room[node], allowed)
            ends[node].append(number)
        self.letters = sorted({c for term, _ in terms for c in term})
        allowed = [edits_for(*t) for t in terms]

        def closed(state: dict[int, int], kept: int | None):
            """Skipping letters of a term costs one edit each; kept: the best verdict of a word beginning so far."""
            todo = list(state.items())
            while todo:
                node, e = todo.pop()
                if e > state[node]:
                    continue
                for child in children[node].values():
                    if e < room[child] and e + 1 < state.get(child, 9):
                        state[child] = e + 1
                        todo.append((child, e + 1))
            for node, e in state.items():
                for number in ends[node]:
                    if terms[number][1] and e <= allowed[number]:
                        kept = better(kept, number * 3 + e)
            return frozenset(state.items()), kept

        def better(a: int | None, b: int | None) -> int | None:
            options = [x for x in (a, b) if x is not None]
            return min(options, key=lambda x: (x % 3, -len(terms[x // 3][0]), x)) if options else None

        start = closed({0: 0}, None)
        numbers = {(frozenset(), None): 0, start: 1}
        table, accept, todo = {0: [0] * (len(self.letters) + 1)}, {0: -1}, [start]
        while todo:
            here = todo.pop()
            pairs, kept = here
            verdict = kept
            for node, e in pairs:
                for number in ends[node]:
                    if e <= allowed[number]:
                        verdict = better(verdict, number * 3 + e)
            accept[numbers[here]] = -1 if verdict is None else verdict
            row = []
            for letter in (*self.letters, None):
                state: dict[int, int] = {}
                for node, e in pairs:
                    if e < room[node] and e + 1 < state.get(node, 9):
                        state[node] = e + 1
                    for c, child in children[node].items():
                        cost = e + (c != letter)
                        if cost <= room[child] and cost < state.get(child, 9):
                            state[child] = cost
                to = closed(state, kept)
                if to not in numbers:
                    numbers[to] = len(numbers)
                    todo.append(to)
                row.append(numbers[to])
            table[numbers[here]] = row
        self.table = np.array([table[k] for k in range(len(numbers))], np.int32)
        self.accept = np.array([accept[k] for k in range(len(numbers))], np.int32)
        self.stuck = (self.table == np.arange(len(numbers))[:, None]).all(axis=1)

    def match(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The verdict of each word of an array of (lower-case) code points."""
        index = np.full(0x110000, len(self.letters), np.int32)
        index[[ord(c) for c in self.letters]] = np.arange(len(self.letters))
        out = np.full(starts.size, -1, np.int32)
        live = np.arange(starts.size)
        state = np.ones(starts.size, np.int32)
        step = 0
        while live.size:
            over = (lengths[live] == step) | self.stuck[state]
            if over.any():
                out[live[over]] = self.accept[state[over]]
                live, state = live[~over], state[~over]
                if not live.size:
                    break
            state = self.table[state, index[codes[starts[live] + step]]]
            on = state != 0
            live, state = live[on], state[on]
            step += 1
        return out


# ---- words of a batch ---------------------------------------------------------

@lru_cache(maxsize=1)
def _letters_and_digits() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)], bool)


def words_of(texts: list[str]):
    """Lower-case code points of all texts and the words in them: start, length, text number. Signs at a word's ends are cut off."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    gap = (codes == 32) | ((codes >= 9) & (codes <= 13))
    solid = np.flatnonzero(_letters_and_digits()[codes])
    if not solid.size:
        return lowered, codes, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    chunk = np.cumsum(gap)[solid]
    first = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
    starts = solid[first]
    ends = solid[np.append(first[1:], solid.size) - 1] + 1
    stops = np.cumsum([len(t) + 1 for t in lowered])
    return lowered, codes, starts, ends - starts, np.searchsorted(stops, starts, side="right")


def context(text: str, start: int, end: int) -> float:
    """1 for plain abuse, less inside a quotation, more again beside a second person."""
    before, after = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    quoted = bool(_opened.search(before) and _closed.search(after)) or bool(_reporting.search(before))
    addressed = bool(_persons.search(before[-CONTEXT // 2:]) or _persons.search(after[:CONTEXT // 2]))
    return min(1.0, 1.0 - QUOTED * quoted + ADDRESSED * addressed)


def hits(texts: list[str], automaton: Automaton) -> Iterator[tuple[int, int, int, float, str]]:
    """(text number, term, edits, context, word) of every hit."""
    lowered, codes, starts, lengths, owner = words_of(texts)
    base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
    found = automaton.match(codes, starts, lengths)
    for k in np.flatnonzero(found >= 0).tolist():
        number = int(owner[k])
        at = int(starts[k] - base[number])
        yield number, int(found[k]) // 3, int(found[k]) % 3, context(lowered[number], at, at + int(lengths[k])), lowered[number][at:at + int(lengths[k])]


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin, chars = 0, 0
    for end, text in enumerate(texts, 1):
        chars += len(text)
        if chars >= CHUNK or end == len(texts):
            yield begin, end
            begin, chars = end, 0


# ---- learning -----------------------------------------------------------------

def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and word beginnings of each text, each once a text: term, is_stem, n; summed by slice, as a batch has too many to hold."""
    for batch in (part for whole in batches for part in slices(whole, 0)):
        counts: dict[tuple[str, bool], int] = {}
        for text in batch.column(0).to_pylist():
            found = set()
            for word in set(text.lower().split()):
                word = word.strip(EDGES)
                if SHORTEST <= len(word) <= LONGEST:
                    found.add((word, False))
                found.update((word[:n], True) for n in range(SHORTEST, min(len(word), 9)))
            for term in found:
                counts[term] = counts.get(term, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in counts]), pa.array([s for _, s in counts]), pa.array(list(counts.values()), pa.int64())],
                                         names=["term", "is_stem", "n"])


EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„‘’«»…¿¡"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add four minimum hashes of each text's three-word windows."""
    salts = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
    for batch in (part for whole in batches for part in slices(whole, 1)):
        found = []
        for text in batch.column(1).to_pylist():
            words = np.array([zlib.crc32(w.encode()) for w in text.split()] or [0], np.uint64)
            hashes = words if words.size < 3 else (words[:-2] * salts[0] ^ words[1:-1] * salts[1] ^ words[2:] * salts[2])
            found.append([int(((hashes ^ (hashes >> np.uint64(29))) * salt >> np.uint64(1)).min()) for salt in salts])
        sketch = np.array(found, np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(sketch[:, k]) for k in range(4))], names=[*batch.schema.names, "m0", "m1", "m2", "m3"])


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(text, toxic)`` of at most ``sample`` labelled rows outside the held-out fold.

    Of documents that share one of four minimum hashes only one stays: a family of near
    copies would lend all its words the look of evidence.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = cut(known.filter(fold("_id", FOLDS) != 0).orderBy(F.xxhash64("_id"), "_id").limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).join(chosen, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")
    rows = cut(rows.mapInArrow(_sketches, "doc_id long, text string, toxic int, m0 long, m1 long, m2 long, m3 long"))
    single = rows.select("doc_id", "m0", "m1", "m2", "m3")
    for name in ("m0", "m1", "m2", "m3"):
        single = single.groupBy(F.col(name).alias("_by")).agg(F.min(F.struct("doc_id", "m0", "m1", "m2", "m3")).alias("_one")).select("_one.*")
    return cut(rows.join(cut(single.select("doc_id")), "doc_id", "left_semi").select("text", "toxic"))


def _candidates(rows: DataFrame) -> tuple[list[tuple[str, bool]], float]:
    """Terms that mostly stand in toxic texts of the sample, without those that a shorter such beginning covers.

    ``EVIDENCE`` is the log-likelihood ratio that keeps chance finds out of millions of terms.
    """
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return [], 0.0
    kind = "term string, is_stem boolean, n long"
    least = max(FEWEST, int(SHARE * toxic))

    def counted(label: int, name: str) -> DataFrame:
        return rows.filter(F.col("toxic") == label).select("text").mapInArrow(_terms, kind).groupBy("term", "is_stem").agg(F.sum("n").alias(name))

    frequent = cut(counted(1, "tox").filter(F.col("tox") >= least))
    both = frequent.join(counted(0, "non"), ["term", "is_stem"], "left").withColumn("non", F.coalesce("non", F.lit(0)))
    share = F.col("tox") / (F.col("tox") + F.col("non"))
    base = toxic / (toxic + clean)
    evidence = 2 * (F.col("tox") * F.log(share / base) + F.when(F.col("non") > 0, F.col("non") * F.log((1 - share) / max(1 - base, 1e-9))).otherwise(0.0))
    pure = both.filter((share >= PURE) & (evidence >= EVIDENCE)).orderBy(F.desc("tox"), "term", "is_stem").limit(20 * TERMS).collect()
    tox = {(r["term"], r["is_stem"]): r["tox"] for r in pure}
    kept: list[tuple[str, bool]] = []
    covered: set[str] = set()
    for (term, is_stem), n in sorted(tox.items(), key=lambda x: (len(x[0][0]), not x[0][1], x[0][0])):
        if any(term[:k] in covered for k in range(SHORTEST, len(term) + (not is_stem))):
            continue
        if is_stem:
            longer = [t for t, s in tox if len(t) == len(term) + 1 and s and t.startswith(term) and tox[(t, s)] >= 0.95 * n]
            whole = [t for t, s in tox if not s and t.startswith(term) and tox[(t, s)] >= 0.9 * n]
            if longer or whole:
                continue
            covered.add(term)
        kept.append((term, is_stem))
    kept.sort(key=lambda t: (-tox[t], t))
    return sorted(kept[:TERMS]), base


def kinds(texts: list[str], automaton: Automaton) -> dict[tuple[int, int], float]:
    """(text number, kind of finding) to its best context.

    A kind is a term, the edits of its closest hit, and how many different words hit it (1, 2, or
    more). One more term stands for all word beginnings together, as they are weaker alone.
    """
    seen: dict[tuple[int, int], tuple[set, int, float]] = {}
    stems = len(automaton.terms)
    for number, term, edits, weight, word in hits(texts, automaton):
        for name in (term, stems) if automaton.terms[term][1] else (term,):
            words, least, best = seen.get((number, name), (set(), 9, 0.0))
            words.add(word)
            seen[(number, name)] = (words, min(least, edits), max(best, weight))
    return {(number, name * 9 + min(least, 2) * 3 + min(len(words), 3) - 1): best for (number, name), (words, least, best) in seen.items()}


class Model:
    """Automaton and the precision of every kind of finding."""

    def __init__(self, automaton: Automaton | None, precision: dict[int, float]):
        self.automaton, self.precision = automaton, precision

    def scores(self, texts: list[str]) -> np.ndarray:
        best = np.zeros(len(texts))
        if self.automaton is not None:
            for (number, kind), weight in kinds(texts, self.automaton).items():
                best[number] = max(best[number], self.precision.get(kind, 0.0) * weight)
        return best


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled documents, chosen by a hash of the id; without toxic ones the model never hits."""
    ship(docs.sparkSession, small=True)
    rows = training_rows(docs, labels, sample)
    terms, base = _candidates(rows)
    if not terms:
        return Model(None, {})
    automaton = Automaton(terms)
    packed = pickle.dumps(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pickle.loads(packed)
        for batch in (part for whole in batches for part in slices(whole, 0)):
            texts, toxic = (c.to_pylist() for c in batch.columns)
            for a, b in _groups(texts):
                seen = list(kinds(texts[a:b], found))
                yield pa.RecordBatch.from_arrays([pa.array([k for _, k in seen], pa.int64()), pa.array([toxic[a + n] for n, _ in seen], pa.int64())], names=["kind", "toxic"])

    counts = rows.select("text", "toxic").mapInArrow(run, "kind long, toxic long").groupBy("kind").agg(
        F.count_if(F.col("toxic") == 1).alias("tox"), F.count_if(F.col("toxic") == 0).alias("non")).collect()
    precision = {r["kind"]: (r["tox"] + 2 * base) / (r["tox"] + r["non"] + 2) for r in counts}
    return Model(automaton, {k: p for k, p in precision.items() if p >= 0.5})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, score. One pass, no shuffle; a null text is the empty text and scores 0.

    Repeated rows score alike; other columns are not looked at; an empty table gives no rows.
    """
    ship(docs.sparkSession, small=True)
    packed = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = pickle.loads(packed)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            texts = batch.column(1).to_pylist()
            for a, b in _groups(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ready.scores(texts[a:b]), pa.float64())], names=["doc_id", "score"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
            .mapInArrow(run, "doc_id long, score double"))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below one half, all columns kept, in one pass."""
    ship(docs.sparkSession, small=True)
    packed = pickle.dumps(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = pickle.loads(packed)
        for batch in (part for whole in batches for part in slices(whole, at)):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            keep = np.concatenate([ready.scores(texts[a:b]) < 0.5 for a, b in _groups(texts)]) if texts else np.zeros(0, bool)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def verdicts(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit and score: doc_id, held_out, score, predicted."""
    found = score(docs, fit(docs, labels, sample))
    return found.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
