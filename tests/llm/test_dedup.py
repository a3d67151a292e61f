"""Exact copies, repeated lines and near copies against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brinefield.llm import byte_bpe, toxicity
from brinefield.llm import exact_dedup as ex
from brinefield.llm import jaccard_join as jj
from brinefield.llm import line_dedup as ld
from brinefield.llm.common import BATCH_BYTES, BATCH_LIMIT, ship, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROW = "doc_id long, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW)


def pairs(odd):
    return [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]


# ---- exact copies

def test_exact_groups_of_odd_rows(odd):
    rows = pairs(odd)
    ids = defaultdict(list)
    for i, t in rows:
        ids[t or ""].append(i)
    want = Counter()
    for i, t in rows:
        keep = max((x for x in ids[t or ""] if x is not None), default=None)
        want[(i, keep, len(ids[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, ex.exact_groups(odd).collect())) == want


def test_keep_one_leaves_each_text_once_with_all_columns(odd):
    kept = ex.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted({t or "" for _, t in pairs(odd)})


def test_no_rows(none):
    assert ex.exact_groups(none).count() == ex.keep_one(none).count() == ld.dedup_lines(none).count() == jj.near_copies(none).count() == jj.keep_one(none).count() == 0


def test_index_inserts_and_deletes(spark):
    first = [(k, f"text {k % 7}") for k in range(40)]
    later = [(100 + k, f"text {k % 9}") for k in range(20)]
    gone = [r for r in first if r[0] % 2 == 0] + [r for r in first if r[1] == "text 3" and r[0] % 2] + [(999, "never seen")]
    d = {n: ex.digests(frame(spark, rows)).cache() for n, rows in (("first", first), ("later", later), ("gone", gone))}
    index = ex.maintain(None, d["first"], None, 3)
    index = ex.maintain(index, d["later"], d["gone"], 3)
    live = [r for r in first if r not in gone] + later
    index = ex.refresh(index, ex.digests(frame(spark, live)), d["gone"])
    want = Counter(t for _, t in live)
    got = {bytes(r.digest): (r.group_size, r.keep_id) for r in ex.stored(index).collect()}
    assert got == {hashlib.sha256(t.encode()).digest(): (n, max(i for i, x in live if x == t)) for t, n in want.items()}


def test_cuckoo_filter_overflows_and_refills():
    shard = ex.Shard(n_buckets=2)
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    for d in digests:
        shard.insert(d, 1, 1)
    assert shard.resized > 3 and all(d in shard.filter for d in digests)
    for d in digests[::2]:
        shard.delete(d, 1)
    assert all(d in shard.filter for d in digests[1::2])
    assert sum(d in shard.filter for d in digests[::2]) < 15
    assert sum(len(b) for b in shard.stored.values()) == 1500


def test_equal_fingerprints_do_not_merge():
    a, b = bytes(32), bytes(10) + b"\1" * 22
    shard = ex.Shard()
    shard.insert(a, 1, 5)
    shard.insert(b, 1, 6)
    assert shard.stored[0] == {a: [1, 5], b: [1, 6]}


# ---- lines

def brute_lines(rows):
    keys = defaultdict(set)
    split = [(i, t, (t or "").split("\n")) for i, t in rows]
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    for i, _, lines in split:
        for line in lines:
            if len(key(line)) >= 10:
                keys[key(line)].add((i is not None, i or 0))
    out = Counter()
    for i, _, lines in split:
        keep = [x for x in lines if len(keys.get(key(x), ())) < 2 or min(keys[key(x)]) == (i is not None, i or 0)]
        out[(i, len(lines), len(lines) - len(keep), "\n".join(keep).encode())] += 1
    return out


@pytest.mark.parametrize("ship", [ld.SHIP_BYTES, 0])
def test_lines_match_brute_force(spark, odd, ship):
    rng = random.Random(3)
    lines = ["Short", "a line of some length", "A LINE of some length ", "\tÄ line of some length", "ä line of some length", "0123456789", " 012345678 ", "ééééééééé", "éééééééééé", ""]
    rows = [(k % 37, "\n".join(rng.choice(lines) if rng.random() < 0.7 else f"own line {k} {j}" for j in range(rng.randint(0, 6)))) for k in range(60)]
    for table in (rows, pairs(odd)):
        got = ld.dedup_lines(frame(spark, table), segments=5, ship_bytes=ship).collect()
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, bytes(r.kept)) for r in got) == brute_lines(table)


# ---- near copies

def brute_near(rows, width, percent):
    sets = defaultdict(list)
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[i].append({tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    flat = [(i, s) for i, many in sets.items() for s in many]
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for k, (i, s) in enumerate(flat):
        for j, t in flat[:k]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return Counter((i, len(s), None if i is None else find(i)) for i, many in sets.items() for s in many)


def family(rng, vocabulary, lengths, families, most):
    rows = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice(lengths))]
        for _ in range(rng.randint(1, most)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                at = rng.randrange(len(text) + 1)
                text[at:at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_near_copies_match_brute_force(spark, width, percent):
    rng = random.Random(width)
    rows = family(rng, [f"w{k}" for k in range(300)], [1, 2, 5, 11, 13, 22, 25, 32, 45, 70, 150], 40, 7)
    rows += [(5000 + k, "W1 w2 w3 " * 9 if k % 2 else "w1  w2 W3 " * 9) for k in range(6)]
    got = jj.near_copies(frame(spark, rows), width, percent).collect()
    assert Counter(map(tuple, got)) == brute_near(rows, width, percent)


def test_near_copies_of_odd_rows(odd):
    rows = [r for r in pairs(odd)]
    assert Counter(map(tuple, jj.near_copies(odd).collect())) == brute_near(rows, 3, 90)
    kept = jj.keep_one(odd)
    assert kept.columns == odd.columns and {4} == {r.doc_id for r in kept.filter("text = 'one' AND doc_id IS NOT NULL").collect()}


@pytest.mark.parametrize("width,percent,length", [(3, 90, 14), (3, 90, 80), (5, 80, 60)])
def test_ids_that_repeat_keep_the_links_of_all_their_texts(spark, width, percent, length):
    def text(name, changed=None):
        return " ".join(f"{name}{k}" for k in range(length)) + ("" if changed is None else f" {changed}")
    rows = [(3, text("x")), (7, text("x")), (7, text("y")), (12, text("y", "new")), (20, text("u")), (20, text("v")), (2, text("u")), (31, text("v")), (32, text("v", "new")), (32, text("v", "new"))]
    rng = random.Random(length)
    rows += [(100 + k % 23, t) for k, t in family(rng, [f"w{k}" for k in range(300)], [11, 25, 45, 70], 15, 6)]
    got = jj.near_copies(frame(spark, rows), width, percent).collect()
    assert Counter(map(tuple, got)) == brute_near(rows, width, percent)
    assert {r.component_id for r in got if r.doc_id in (7, 12)} == {3} and {r.component_id for r in got if r.doc_id in (31, 32)} == {2}


def test_linked_sets_share_enough_blocks():
    import numpy as np
    rng = np.random.default_rng(2)
    for size in (20, 33, 50, 75, 76, 113, 114, 260, 900):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
            lost, new = rng.integers(0, size // 12 + 1, 2)
            b = np.unique(np.concatenate([a[lost:], rng.integers(0, 1 << 62, new).astype(np.uint64)]))
            if jj.linked(a, b):
                (x, bands, need), (y, _, other) = jj.heavy_keys(a), jj.heavy_keys(b)
                larger = jj.band_of(max(a.size, b.size))
                common = np.intersect1d(x[bands == larger], y).size
                assert common >= need[bands == larger][0] >= 1


@pytest.mark.parametrize("percent", [80, 90])
def test_small_sets_with_empty_blocks_share_enough_lists(percent):
    import numpy as np
    rng = np.random.default_rng(percent)
    tried = 0
    for size in range(10, 26):
        p = jj.blocks_for(jj.band_of(size), percent)
        for _ in range(60):
            pool = np.unique(rng.integers(0, 1 << 62, 60 * p).astype(np.uint64))
            home = jj.mix(jj.mix(pool ^ jj._FACTORS[1]) ^ jj._FACTORS[0]) % np.uint64(p)
            few = np.flatnonzero(np.isin(home, rng.permutation(p)[:max(1, p - int(rng.integers(1, p)))]))
            a = np.sort(pool[rng.permutation(few)[:size]])
            lost, new = rng.integers(0, size // 8 + 1, 2)
            b = np.unique(np.concatenate([rng.permutation(a)[lost:], rng.permutation(pool)[:new]]))
            if jj.linked(a, b, percent):
                tried += 1
                (x, bands, need), (y, others, other) = jj.heavy_keys(a, percent), jj.heavy_keys(b, percent)
                larger = jj.band_of(max(a.size, b.size))
                common = np.intersect1d(x[bands == larger], y[others == larger]).size
                assert common >= max(need[bands == larger][0], other[others == larger][0]) and min(need.min(), other.min()) >= 1
    assert tried > 300


def test_sketches_never_differ_more_than_sets():
    import numpy as np
    rng = np.random.default_rng(3)
    for size in (5, 100, 129, 300, 2000):
        a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        for share in (0.0, 0.02, 0.2, 1.0):
            b = np.unique(np.concatenate([a[int(share * size):], rng.integers(0, 1 << 62, int(1.3 * share * size)).astype(np.uint64)]))
            if b.size:
                x, y = jj.folded([jj.sketch(a), jj.sketch(b)])
                assert np.bitwise_count(x ^ y).sum() <= np.setxor1d(a, b).size


def test_families_that_hardly_link_go_through_chunks(spark, monkeypatch):
    """Near copies around the limit, more of them than a chunk holds."""
    monkeypatch.setattr(jj, "CHUNK", 7)
    rng = random.Random(12)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(60):
        text = list(base)
        for _ in range(rng.randint(1, 5)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10 ** 6)}"
        rows.append((k, " ".join(text)))
    assert Counter(map(tuple, jj.near_copies(frame(spark, rows)).collect())) == brute_near(rows, 3, 90)


def test_keys_reach_their_filters_either_way(spark):
    rng = random.Random(7)
    docs = frame(spark, family(rng, [f"w{k}" for k in range(300)], [12, 45, 150], 25, 5)).withColumnRenamed("doc_id", "node")
    keyed = docs.mapInArrow(jj._keys(3, 90, 11), "node long, n int, keys array<long>, sizes array<int>, needs array<int>").cache()
    shared = keyed.select("node", F.explode("keys").alias("key")).groupBy("key").agg(F.count_distinct("node").alias("c")).filter("c > 1")
    want = {r.key for r in shared.collect()}
    for ship in (jj.SHIP_BYTES, 0):
        got = jj._repeated(keyed, ship)
        assert want <= {r.key for r in got.collect()}
        assert got.distinct().exceptAll(keyed.select(F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("sizes").alias("size"), F.col("needs").alias("need"))), "node", "n").distinct()).isEmpty()


def test_boundary_grows_with_cheap_small_sets():
    assert jj.boundary({k: 10 for k in range(1, 9)}) >= 8
    assert jj.boundary({}) >= 0 and jj.light_cost(39) > jj.heavy_cost(39)


def test_boundary_counts_what_it_makes_larger_sets_cost():
    assert jj.boundary({}, 80) == 0 and jj.boundary({5: 100}, 80) == 5 and jj.boundary({5: 0, 3: 1}, 90) == 3
    for percent in (70, 80, 90, 95):
        for gap in ({46: 100, 49: 100}, {5: 10, 46: 100, 49: 100}, {9: 10, 40: 1000}, {k: 10 for k in range(1, 60)}, {1: 10 ** 9, 30: 1, 39: 1, 43: 1}):
            light = jj.boundary(gap, percent)
            assert light == 0 or light in gap
            assert jj.light_cost(jj.reach_of(light, percent), percent) <= jj.MOST_SUBSETS
    assert jj.boundary({9: 1, 10: 10 ** 6, 11: 10 ** 6}, 80) == 0


def test_filtered_corpus_without_small_sets(spark):
    rng = random.Random(50)
    rows = family(rng, [f"w{k}" for k in range(500)], [50, 51, 52, 53], 12, 4)
    assert Counter(map(tuple, jj.near_copies(frame(spark, rows), 5, 80).collect())) == brute_near(rows, 5, 80)


def test_hot_family_makes_few_pairs(spark):
    """400 different near copies of one text: links grow with the family, not with its square."""
    base = [f"b{k}" for k in range(400)]
    rows = [(k, " ".join(base[:50 + k % 300] + [f"x{k}"] + base[50 + k % 300:])) for k in range(400)]
    got = jj.near_copies(frame(spark, rows)).agg(F.min("component_id"), F.max("component_id")).first()
    assert tuple(got) == (0, 0)


def test_only_sets_of_possible_links_move(spark, monkeypatch):
    """Unrelated sets on one list are told apart by their sketches; the linked two are fetched and confirmed."""
    rng = np.random.default_rng(5)
    found = [np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(30)]
    found.append(np.unique(np.concatenate([found[0][5:], rng.integers(0, 1 << 63, 5, dtype=np.uint64)])))
    sets = spark.createDataFrame([(k, s.tobytes(), jj.sketch(s)) for k, s in enumerate(found)], "node long, members binary, sketch binary")
    members = spark.createDataFrame([(7, k, s.size) for k, s in enumerate(found)], "key long, node long, n int")
    none, asked, real = spark.createDataFrame([], "a long, b long"), [], jj._confirmed

    def watched(pairs, *rest):
        asked.extend((r["a"], r["b"]) for r in pairs.collect())
        return real(pairs, *rest)

    monkeypatch.setattr(jj, "_confirmed", watched)
    links = {(r["a"], r["b"]) for r in jj.heavy_links(members, sets, none).collect()}
    assert links == {(0, 30)} and set(asked) == {(0, 30)}


@pytest.mark.parametrize("ship", [1 << 20, 0])
def test_near_copies_move_no_text(spark, monkeypatch, ship):
    """Texts and sets are picked where they lie; past the shipped size they are joined, with the same result."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(900)]
    rows = []
    for k in range(12):
        text = [rng.choice(words) for _ in range(300)]
        rows += [(10 * k + j, " ".join(text[:150] + [f"x{j}"] * (j > 0) + text[150:])) for j in range(3)]
    rows += [(5, rows[0][1]), (5, rows[0][1]), (None, rows[0][1]), (999, None)]
    plans, real, numbers = [], jj.cut, jj._numbers

    def watched(df):
        if "members" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(jj, "cut", watched)
    monkeypatch.setattr(jj, "_numbers", lambda wanted: numbers(wanted, ship))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert Counter(map(tuple, jj.near_copies(frame(spark, rows)).collect())) == brute_near(rows, 3, 90)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans and ("hashpartitioning(doc_id" in plans[0]) == (ship == 0)


def test_steps_over_texts_take_small_batches(spark):
    """A batch by count alone is 10,000 whole texts, in the JVM and in the worker; other steps and a session's own limit are left alone."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    texts = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.md5(F.col("id").cast("string")), 200).alias("text"))
    ship(spark)
    want = texts.mapInArrow(sizes, "n long, size long").collect()
    assert max(r["size"] for r in want) > 4 * BATCH_BYTES
    for build in (lambda: jj.near_copies(texts), lambda: byte_bpe.encode(texts, "nowhere"), lambda: toxicity.score(texts, toxicity.Model(None, {}))):
        ship(spark)
        build()
        found = texts.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in found) == 3000 and max(r["size"] for r in found) < 1.5 * BATCH_BYTES
    ship(spark)
    assert texts.mapInArrow(sizes, "n long, size long").collect() == want
    spark.conf.set(BATCH_LIMIT, "2m")
    ship(spark, small=True)
    ship(spark)
    assert spark.conf.get(BATCH_LIMIT) == "2m"
    spark.conf.unset(BATCH_LIMIT)


def test_classes_enter_once_across_batches():
    """Small batches leave no more copies of a class to the lists than large ones did."""
    texts = [f"one two three four five six {k % 50}" for k in range(400)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 100)), pa.array(texts[a:a + 100])], names=["doc_id", "text"]) for a in range(0, 400, 100)]
    nodes = [n for p in jj._keys(5, 80, 0, 0)(iter(batches)) for n in p.column(0).to_pylist()]
    assert len(nodes) == len(set(nodes)) == 50


def test_a_large_batch_is_taken_in_slices():
    """A worker keeps what its largest step took: no step makes objects or keys of a whole batch, and no row is lost or repeated."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(1500)] + ["y " * 900_000, "", None, "last"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t or "" for t in texts]), pa.array(range(len(texts)))], names=["doc_id", "text", "row"])
    parts = list(slices(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), 0, 1 << 18))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(0).to_pylist()) <= 1 << 18 for p in parts)
    whole = list(jj.shingle_sets([t or "" for t in texts], 5))
    measured = list(jj._measure(5, 0)(iter([batch])))
    assert len(measured) > 3 and [n for p in measured for n in p.column(2).to_pylist()] == [s.size for s in whole]
    keyed = list(jj._keys(5, 80, 0, 0)(iter([batch])))
    assert max(p.nbytes for p in keyed) < 4 << 20
    nodes = [n for p in keyed for n in p.column(0).to_pylist()]
    assert nodes == list(dict.fromkeys(jj.class_number(s, 0) for s in whole))
    assert list(slices(batch.slice(0, 0), 1)) == []
