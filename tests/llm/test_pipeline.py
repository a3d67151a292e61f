"""The pipeline's stages on odd rows, clashing columns and an empty table, against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text import reference_encoding

import corpus_pipeline as cp
from brinefield.llm import line_quality
from brinefield.llm.common import vocabulary
from brinefield.runtime import cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"
STAGE = dict(cp.STAGES)
CLASHES = ("_gone", "_rate", "_copies", "_copy", "_source", "_sha256", "_row", "__gone", "_ID", "size", "key")


@pytest.fixture(scope="module")
def docs(spark, odd):
    """Odd rows, copies, and near copies on both sides of four fifths."""
    words = [f"w{k}" for k in range(60)]
    near = [(100, words), (101, ["x", *words[1:]]), (102, [*words[:30], "y", *words[31:]]), (103, [*words[:20], "a", "b", *words[22:40], "c", "d", *words[42:]]), (104, [w.upper() for w in words]), (105, words[:4]), (106, ["W0", *words[1:4]])]
    rows = spark.createDataFrame([(k, " ".join(w), "en", "bcd"[k % 3]) for k, w in near], "doc_id long, text string, lang string, source string")
    every = odd.select("doc_id", "text", "lang", "source").unionByName(rows)
    return cut(every.withColumns({c: F.lit(k) for k, c in enumerate(CLASHES)}))


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]


def without_copies(rows):
    largest = defaultdict(list)
    for i, t, _ in rows:
        largest[t or ""].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in largest.items()}
    return {(i, t or ""): (i, t, s) for i, t, s in rows if i == top[t or ""]}


def shingles(text):
    words = WORD.findall((text or "").translate(LOW))
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def smallest_of_groups(rows):
    sets = [shingles(t) for _, t, _ in rows]
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]) and (100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) or rows[a][0] == rows[b][0]):
                old, new = part[a], part[b]
                part = [new if p == old else p for p in part]
    low = {}
    for p, (i, _, _) in zip(part, rows):
        if i is not None:
            low[p] = min(low.get(p, i), i)
    return [r for p, r in zip(part, rows) if r[0] is None or r[0] == low[p]]


def copies_of(rows):
    """Repetition rates by water filling, and one draw a row from the hash of seed, id and text."""
    size = lambda t: len(WORD.findall(t or ""))
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    have = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    target, free, rest = {}, set(sources), sum(have.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * have[s]}
        for s in full or free:
            target[s] = min(3.0 * have[s], level * weight[s])
        if not full:
            break
        free -= full
        rest -= sum(3 * have[s] for s in full)
    out = Counter()
    for i, t, s in rows:
        rate = min(target[s] / have[s], 3.0) if have[s] else 0.0
        digest = hashlib.md5(f"mix-1|{'-' if i is None else i}|{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
        out[(i, t)] += int(rate) + (int(digest[:8], 16) / 2 ** 32 < rate - int(rate))
    return +out


def test_stages_equal_plain_python(spark, docs):
    rows = rows_of(docs)
    exact = cut(STAGE["exact_dedup"](spark, docs, SF))
    want = without_copies(rows)
    assert exact.columns == docs.columns and Counter((i, t or "") for i, t, _ in rows_of(exact)) == Counter(want.keys())
    near = cut(STAGE["jaccard_join"](spark, exact, SF))
    assert near.columns == docs.columns and Counter(rows_of(near)) == Counter(smallest_of_groups(rows_of(exact)))
    assert {104, 105} & {i for i, *_ in rows_of(near)} == {105}
    mixed = cut(STAGE["mix"](spark, near, SF))
    assert mixed.columns == docs.columns and Counter((i, t) for i, t, _ in rows_of(mixed)) == copies_of(rows_of(near))
    library = reference_encoding(vocabulary("byte_bpe_50k.tiktoken"))
    coded = STAGE["byte_bpe"](spark, mixed, SF).collect()
    plain = Counter()
    for i, t, _ in rows_of(mixed):
        ids = library.encode_ordinary(t or "")
        plain[(i, len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in coded) == plain
    for r in coded:
        offsets = np.frombuffer(bytes(r.offsets), "<u4")
        assert offsets.size == r.n_tokens and (not offsets.size or offsets[0] == 0 and (np.diff(offsets.astype(int)) > 0).all())


def test_toxicity_keeps_columns_and_clean_rows(spark, docs):
    kept = STAGE["toxicity"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert not Counter(rows_of(kept)) - Counter(rows_of(docs))


def test_stages_take_an_empty_table(spark, docs):
    none = docs.filter("1 = 0")
    for name, stage in cp.STAGES:
        none = cut(stage(spark, none, SF))
        assert none.count() == 0, name


def test_cleaned_rows_keep_clashing_columns(docs):
    assert line_quality.clean(docs).columns == docs.columns
