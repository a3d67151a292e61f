"""Repeated passages, ranked search and whitening against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinefield.llm import ranked_search as rs
from brinefield.llm import substring_dedup as sd
from brinefield.llm import whitening as wh

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROW = "doc_id long, text string"


# ---- repeated passages

def dropped(rows):
    """Every window against every other, by its words."""
    lists = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[k:k + sd.WINDOW]) for w in lists for k in range(len(w) - sd.WINDOW + 1))
    out = []
    for (i, _), w in zip(rows, lists):
        gone = set()
        for k in range(len(w) - sd.WINDOW + 1):
            if seen[tuple(w[k:k + sd.WINDOW])] > 1:
                gone.update(range(k, k + sd.WINDOW))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


def found(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in df.collect())


def test_cover_holds_every_difference():
    for i in range(sd.PERIOD):
        for j in range(sd.PERIOD):
            assert any((i + d) % sd.PERIOD in sd.COVER and (j + d) % sd.PERIOD in sd.COVER for d in range(sd.PERIOD))


def test_repeats_of_every_length_at_every_place(spark):
    rng = random.Random(5)
    rows = []
    for k in range(140):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(0, 130))]
        rows.append((k, " \n".join(words)))
    for k in range(140, 330):
        source = WORD.findall(rows[rng.randrange(140)][1])
        length = rng.choice([30, 34, 35, 36, 40, 57, 80])
        at = rng.randrange(max(1, len(source) - length))
        before = [f"x{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(60))]
        after = [f"y{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(60))]
        rows.append((k, "\t".join(before + source[at:at + length] + after)))
    common = " ".join(f"c{k}" for k in range(50))
    rows += [(400 + k, f"{k} {common} {k}") for k in range(60)] + [(470, ("again " * 36).strip()), (471, ("once " * 35).strip()), (472, ("Once " * 35).strip())]
    df = spark.createDataFrame(rows, ROW).repartition(5)
    want = dropped(rows)
    assert found(sd.drop_repeats(df)) == want
    assert found(sd.drop_repeats(df, chunk_bytes=500, per_segment=300)) == want
    assert sum(n for (_, _, n, _) in want) > 3_000


def test_repeats_of_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert found(sd.drop_repeats(odd)) == dropped(rows)
    assert sd.drop_repeats(none).count() == 0


# ---- ranked search

def ranked(items, docs, top):
    lists = [(i, TERM.findall((t or "").translate(LOW))) for i, t in docs]
    lists = [(i, w) for i, w in lists if w]
    n, total = len(lists), sum(len(w) for _, w in lists)
    df = Counter(t for _, w in lists for t in set(w))
    out = []
    for item, text in items:
        scores = []
        terms = TERM.findall((text or "").translate(LOW))
        for i, w in lists:
            m, tf = 75 + 25 * len(w) * n // total, Counter(w)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in terms if tf[t])
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top])]
    return Counter(out)


def answers(df):
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def collection():
    rng = random.Random(3)
    words = [f"word{k}" for k in range(300)] + ["Größe", "漢字", "É", "it's", "a_b"]
    docs = [(k, " ".join(rng.choices(words, weights=[1 / (1 + j) for j in range(len(words))], k=rng.randrange(0, 60)))) for k in range(700)]
    docs += [(k, docs[k - 1000][1]) for k in range(1000, 1090)] + [(None, "word1 word2"), (5, None)]
    items = [(k, ", ".join(rng.choices(words, k=rng.randrange(0, 25)))) for k in range(90)] + [(7, "WORD1 word1 WORD1"), (None, "word3"), (300, None), (301, "unknown")]
    return items, docs


@pytest.mark.parametrize("settings", [{}, {"block_items": 20}, {"top": 3}])
def test_search_finds_the_best(spark, collection, settings):
    items, docs = collection
    got = rs.best_documents(spark.createDataFrame(items, "item_id long, text string").repartition(2), spark.createDataFrame(docs, ROW).repartition(3), **settings)
    assert answers(got) == ranked(items, docs, settings.get("top", 20))


def test_search_in_integers_beyond_exact_doubles():
    weights, stops = np.array([3, 5, 7, 2]), np.array([2, 4])
    assert rs.Items(3, stops, np.array([0, 1, 2, 0]), weights).exact
    big = rs.Items(3, stops, np.array([0, 1, 2, 0]), weights * (1 << 33))
    assert not big.exact
    search = rs.Search(big, np.zeros(2, np.int64), 1)
    search.add(np.array([[1000, 0, 3], [0, 9, 4]], np.int64), np.array([8, 9]), False)
    assert [s.tolist() for s in search.scores] == [[3000 << 33], [2021 << 33]] and [i.tolist() for i in search.ids] == [[8], [8]]


def test_search_leaves_out_pairs_of_nodes():
    """Two topics with words of their own: documents of the other topic are never looked at."""
    rng = np.random.default_rng(1)
    docs = np.zeros((640, 40))
    docs[:320, :20], docs[320:, 20:] = rng.integers(1, 9, (320, 20)), rng.integers(1, 9, (320, 20))
    term = np.concatenate([rng.integers(0, 20, (16, 5)) + 20 * (k % 2) for k in range(4)]).ravel()
    items = rs.Items(40, np.arange(5, 5 * 64 + 1, 5), term, np.ones(term.size, np.int64))
    search = rs.Search(items, np.zeros(64, np.int64), 5)
    search.add(docs, np.arange(640), False)
    assert 0 < search.looked <= search.passed / 2
    weights = np.zeros((64, 40))
    np.add.at(weights, (np.repeat(np.arange(64), 5), term), 1)
    for k, row in enumerate((docs @ weights.T).T):
        best = np.lexsort((np.arange(640), -row))[:5]
        assert search.ids[k].tolist() == best.tolist() and search.scores[k].tolist() == row[best].tolist()


def test_search_of_odd_rows(odd, none, spark):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    items = odd.withColumnRenamed("doc_id", "item_id").withColumn("doc_id", F.lit("x")).withColumn("rank", F.lit(1))
    assert answers(rs.best_documents(items, odd.withColumn("score", F.lit(1)))) == ranked(docs, docs, 20)
    assert rs.best_documents(items, none).count() == rs.best_documents(items.filter("false"), odd).count() == 0


# ---- whitening

VECTOR = "vec_id long, embedding array<float>, label string, key int, n int"


def whitened(rows, by_count=False, most=16):
    """Plain numpy over all rows that remain."""
    clean = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    dims = Counter(len(x) for _, x in clean)
    dim = max(dims, key=lambda d: (dims[d], d))
    clean = [(i, tuple(x)) for i, x in clean if len(x) == dim]
    counts = Counter(x for _, x in clean)
    fit = np.array([x for x in counts], np.float64)
    w = np.array([counts[x] if by_count else 1 for x in counts], np.float64)
    n = int(w.sum())
    sums = [sum(int(k) * x[j] for x, k in zip(counts, w)) for j in range(dim)]
    centred = fit - np.array(sums) / n
    v = (centred * w[:, None]).T @ centred / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:most]
    order = order[values[order] > 1e-12 * values.max()]
    return clean, n, sums, values[order], vectors[:, order], np.trace(v)


def check(got, rows, **settings):
    clean, n, sums, values, vectors, trace = whitened(rows, **settings)
    want = Counter((i, c + 1) for i, _ in clean for c in range(values.size))
    assert Counter((r.vec_id, r.component) for r in got) == want
    by_id = defaultdict(list)
    for i, x in clean:
        by_id[i].append(x)
    signs = {}
    for r in got:
        assert r.n == n and abs(r.explained - values[r.component - 1] / trace) <= 1e-10 and r.identity_error <= 1e-8
        options = []
        for x in by_id[r.vec_id]:
            value = (np.array(x, np.float64) - np.array(sums) / n) @ vectors[:, r.component - 1] / math.sqrt(values[r.component - 1])
            options.append((sum((n * a - s) ** 2 for a, s in zip(x, sums)), value))
        near = [(d, u) for d, u in options if d == r.deviation and abs(abs(u) - abs(r.whitened)) < 1e-8]
        assert near
        if len(options) == 1 and abs(near[0][1]) > 1e-6:
            assert signs.setdefault(r.component, np.sign(near[0][1] * r.whitened)) == np.sign(near[0][1] * r.whitened)


@pytest.mark.parametrize("by_count", [False, True])
def test_whitening(spark, by_count):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 24)) * np.linspace(0.05, 0.6, 24)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(base)] + [(1000 + k, [float(c) for c in base[3]]) for k in range(150)]
    rows += [(2000, None), (2001, [None] * 24), (2002, [1.0] * 23 + [float("nan")]), (2003, [1.0] * 23 + [float("inf")]), (2004, []), (2005, [1.0] * 7), (None, [0.5] * 24)]
    rows.append(rows[5])
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], VECTOR).repartition(4)
    got = wh.whiten(df, by_count=by_count).collect()
    check(got, rows, by_count=by_count)
    assert len({r.identity_error for r in got}) == 1


def test_whitening_of_few_or_flat_vectors(spark):
    def run(rows):
        return wh.whiten(spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], VECTOR)).collect()
    assert run([]) == run([(1, [1.0, 2.0])]) == run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == run([(1, None), (2, [])]) == []
    line = [(k, [0.5 * k, 1.0 * k, 3.0]) for k in range(5)]
    got = run(line)
    assert {r.component for r in got} == {1} and len(got) == 5
    check(got, line)


def test_deviation_is_exact_or_null():
    x = np.array([[1 << 40, 5], [3, -(1 << 40)]], np.int64)
    sums = [int(x[:, 0].sum()), int(x[:, 1].sum())]
    assert wh.deviations(x, 2, sums) == [None, None]
    assert wh.deviations(x // (1 << 20), 2, [int(s) for s in (x // (1 << 20)).sum(axis=0)]) == [sum((2 * int(c) - int(s)) ** 2 for c, s in zip(r, (x // (1 << 20)).sum(axis=0))) for r in x // (1 << 20)]
    big = (1 << 32) + 7
    assert wh.deviations(np.array([[big], [big - 2]], np.int64), 1 << 31, [(big - 1) << 31]) == [1 << 62, 1 << 62]
