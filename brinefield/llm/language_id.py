"""Language identification with a string kernel.

The kernel of two texts is the number of 1-, 2- and 3-grams of letters that occur in both
(presence, not counts: the blended spectrum), divided by the geometric mean of the numbers
in each. A Nyström approximation replaces the kernel matrix by the columns of ``LANDMARKS``
training texts, and one-versus-rest kernel ridge regression on it gives a weight per
landmark and language.

A batch of texts becomes a 0/1 matrix over the landmarks' n-grams. Its product with the
landmarks' own 0/1 matrix counts common n-grams, which is the kernel; times the weights it
gives the regressions. Scoring multiplies the two constant matrices first, once per model,
so a batch costs one small product. A batch has one row per text, one column per known n-gram.

Learning reads at most ``SAMPLE`` labelled texts, chosen by a hash of the id, on the driver.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinefield.llm.common import fold, ship, whole_text
from brinefield.runtime import cut

FOLDS, HELD_OUT = 4, 2
SAMPLE = 2_000
LANDMARKS = 256
SYMBOLS = 100
GRAMS = 3
RIDGE = 1e-2
SHARPNESS = 8.0
BATCH = 256
CHUNK = 1_000_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and their lower-case code point."""
    is_letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.int32)
    for code in range(0x110000):
        if unicodedata.category(chr(code))[0] == "L":
            is_letter[code] = True
            small = chr(code).lower()
            lower[code] = ord(small) if len(small) == 1 else code
    return is_letter, lower


class Alphabet:
    """Symbols of the n-grams: 0 between words, the training texts' most frequent letters, and one for all other letters."""

    def __init__(self, texts: list[str]):
        is_letter, lower = _letters()
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        found, counts = np.unique(lower[codes[is_letter[codes]]], return_counts=True)
        self.letters = found[np.lexsort((found, -counts))][:SYMBOLS]
        self.base = self.letters.size + 2

    @property
    def table(self) -> np.ndarray:
        is_letter, lower = _letters()
        table = np.where(is_letter, self.base - 1, 0).astype(np.int32)
        known = np.zeros(0x110000, np.int32)
        known[self.letters] = np.arange(1, self.letters.size + 1)
        return np.where(is_letter & (known[lower] > 0), known[lower], table)


class Kernel:
    """Presence rows of texts over a fixed set of n-grams."""

    def __init__(self, alphabet: Alphabet, known: np.ndarray | None = None):
        self.alphabet, self.symbols = alphabet, alphabet.table
        self.space = sum(alphabet.base ** n for n in range(1, GRAMS + 1))
        self.set_known(np.arange(0) if known is None else known)

    def set_known(self, known: np.ndarray) -> None:
        self.known = known
        self.column = np.full(self.space, -1, np.int32)
        self.column[known] = np.arange(known.size)

    def codes(self, text: str) -> list[np.ndarray]:
        """Codes of the text's n-grams for each n, repeats included; a run of other signs counts as one gap."""
        symbols = self.symbols[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        solid = symbols > 0
        solid[1:] |= solid[:-1].copy()
        symbols = symbols[solid]
        out, code, offset = [], symbols, 0
        for n in range(1, GRAMS + 1):
            if n > 1:
                code = code[:-1] * self.alphabet.base + symbols[n - 1:]
            if not code.size:
                break
            out.append(code + offset)
            offset += self.alphabet.base ** n
        return out

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """0/1 matrix over the known n-grams, number of different n-grams of each text, and whether it has a letter."""
        out = np.zeros((len(texts), self.known.size), np.float32)
        sizes, letters = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        present = np.zeros(self.space, bool)
        for k, text in enumerate(texts):
            present[:] = False
            for code in self.codes(text):
                present[code] = True
            sizes[k] = np.count_nonzero(present)
            letters[k] = present[1:self.alphabet.base].any()
            out[k] = present[self.known]
        return out, sizes, letters


class Model:
    def __init__(self, languages: list[str], alphabet: Alphabet, known: np.ndarray, marks: np.ndarray, sizes: np.ndarray, weights: np.ndarray):
        self.languages, self.alphabet, self.known = languages, alphabet, known
        self.marks, self.sizes = marks, sizes
        self.set_weights(weights)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_kernel"}

    def set_weights(self, weights: np.ndarray) -> None:
        """``folded``: n-grams to languages, the product of the landmarks' n-grams and their weights."""
        self.weights = weights
        self.folded = (self.marks.T.astype(np.float64) @ (weights / np.sqrt(np.maximum(self.sizes, 1))[:, None])).astype(np.float32)

    @property
    def kernel(self) -> Kernel:
        if not hasattr(self, "_kernel"):
            self._kernel = Kernel(self.alphabet, self.known)
        return self._kernel

    def similarity(self, texts: list[str]) -> np.ndarray:
        """Kernel of the texts with the landmarks."""
        rows, sizes, _ = self.kernel.rows(texts)
        return (rows @ self.marks.astype(np.float32).T) / np.sqrt(np.maximum(sizes, 1)[:, None] * self.sizes[None, :])

    def regressions(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``similarity`` times the weights, as one product of the n-gram rows; and whether a text has a letter."""
        rows, sizes, letters = self.kernel.rows(texts)
        return (rows @ self.folded) / np.sqrt(np.maximum(sizes, 1))[:, None], letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score (a soft maximum over the languages' regressions); the first of equals by name."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        names, scores = [], np.zeros(len(texts))
        for a in range(0, len(texts), BATCH):
            raw, letters = self.regressions(texts[a:a + BATCH])
            share = np.exp(SHARPNESS * (raw - raw.max(axis=1, keepdims=True)))
            share /= share.sum(axis=1, keepdims=True)
            best = raw.argmax(axis=1)
            names += [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())]
            scores[a:a + BATCH] = np.where(letters, share[np.arange(best.size), best], 0.0)
        return names, scores


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """At most ``sample`` (text, lang) rows outside the held-out fold with a letter in the text: the same number of each language, as far as there are."""
    ids = docs.filter((fold("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in ids.groupBy(F.col("lang").cast("string")).count().orderBy(F.desc("count"), "lang").limit(sample).collect()}
    if not counts:
        return []
    each = max(1, sample // len(counts))
    order = F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text"))
    marks = F.lit(0.0)
    for lang, n in counts.items():
        marks = F.when(F.col("lang") == lang, F.lit(min(1.0, (each + 6 * each ** 0.5) / n))).otherwise(marks)
    thinned = ids.filter((F.pmod(order, F.lit(1 << 20)) / float(1 << 20)) <= marks)
    rows = cut(thinned.select("text", F.col("lang").cast("string").alias("lang"), order.alias("order")))
    out = []
    for lang in sorted(counts):
        out += [(r["text"], r["lang"]) for r in rows.filter(F.col("lang") == lang).orderBy("order", "text").limit(each).select("text", "lang").toLocalIterator()]
    return [(t, lang) for t, lang in out if any(c.isalpha() for c in t)]


def fit(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """Learn from the sample; without labelled rows the model predicts ``und`` only."""
    rows = training_rows(docs, sample)
    texts, langs = [t for t, _ in rows], [lang for _, lang in rows]
    languages = sorted(set(langs))
    alphabet = Alphabet(texts)
    if not languages:
        return Model([], alphabet, np.zeros(0, np.int64), np.zeros((0, 0), bool), np.zeros(0), np.zeros((0, 0)))
    kernel = Kernel(alphabet)
    chosen: list[int] = []
    for lang in languages:
        own = [k for k, x in enumerate(langs) if x == lang]
        chosen += own[:max(1, landmarks // len(languages))]
    marks = np.zeros((len(chosen), kernel.space), bool)
    for row, k in enumerate(chosen):
        for code in kernel.codes(texts[k]):
            marks[row, code] = True
    known = np.flatnonzero(marks.any(axis=0))
    model = Model(languages, alphabet, known, marks[:, known], marks.sum(axis=1), np.zeros((len(chosen), len(languages))))
    parts = [model.similarity(texts[a:a + BATCH]) for a in range(0, len(texts), BATCH)]
    k_nm = np.concatenate(parts).astype(np.float64)
    k_mm = k_nm[chosen]
    y = np.array([[1.0 if x == lang else 0.0 for lang in languages] for x in langs])
    balance = np.array([1.0 / langs.count(x) for x in langs])[:, None] * len(langs) / len(languages)
    left = k_nm.T @ (k_nm * balance) + RIDGE * len(langs) / len(chosen) * k_mm + 1e-6 * np.eye(len(chosen))
    model.set_weights(np.linalg.solve(left, k_nm.T @ (y * balance)))
    return model


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin, chars = 0, 0
    for end, text in enumerate(texts, 1):
        chars += len(text)
        if chars >= CHUNK or end - begin >= BATCH or end == len(texts):
            yield begin, end
            begin, chars = end, 0


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, in one pass without a shuffle.

    ``und`` with score 0 for null texts and texts without a letter. Repeated rows get the
    same result each; other columns are not looked at; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    packed = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = pickle.loads(packed)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _groups(texts):
                names, scores = ready.predict(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def predictions(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit and predict: doc_id, held_out, lang_pred, score."""
    ship(docs.sparkSession)
    return predict(docs, fit(docs, sample)).select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
