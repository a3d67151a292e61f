"""Tokens, languages, toxicity, line rules, licenses and mixing."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from brinefield.llm import byte_bpe, language_id, license_scan, line_quality, mixing, rans, toxicity
from brinefield.llm.common import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(odd):
    return [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]


# ---- byte-level BPE

def reference_encoding(path):
    import base64

    import public_tokenizers
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_slices_and_ids_equal_the_library(rank_file):
    rng = random.Random(1)
    signs = ["'", "s", "re", "ll", "t", " ", "  ", "\n", "\t", "a", "é", "7", "²", "!", "#", "漢", "🙂", "\x1c", "\x85", "　", "'S", "the", " and"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["", "", "a" * 700, " " * 900, "'"]
    for path in (rank_file, vocabulary("byte_bpe_50k.tiktoken")):
        library, coder = reference_encoding(path), byte_bpe.Encoder(path)
        for text, ids in zip(texts, coder.encode(texts)):
            assert ids.tolist() == library.encode_ordinary(text), text
            assert coder.decode(ids) == text.encode()
            assert coder.offsets(ids)[-1] == len(text.encode())


def test_long_slices_take_the_heap(rank_file):
    coder, library = byte_bpe.Encoder(rank_file), reference_encoding(rank_file)
    text = "the" * 40 + "anding" * 30
    assert coder.encode([text])[0].tolist() == library.encode_ordinary(text)
    assert byte_bpe.merge_long(b"thethe", coder.ranks) == library.encode_ordinary("thethe")


def test_bpe_of_odd_rows(odd, none, rank_file):
    library = reference_encoding(rank_file)
    want = Counter()
    for i, t in texts_of(odd):
        ids = library.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, byte_bpe.digests(odd, rank_file).collect())) == want
    back = byte_bpe.decode(byte_bpe.encode(odd, rank_file), rank_file).collect()
    assert Counter((r.doc_id, bytes(r.content)) for r in back) == Counter((i, (t or "").encode()) for i, t in texts_of(odd))
    assert byte_bpe.digests(none, rank_file).count() == 0


# ---- rANS

@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 300_000])
def test_blocks_round_trip(n):
    tokens = (np.random.default_rng(n).zipf(1.3, n) % 5000).astype(np.uint32)
    table = rans.Table(rans.scaled(np.bincount(tokens, minlength=5000)))
    block = rans.encode(tokens, table)
    assert (rans.decode(block, table) == tokens).all()
    if n > 1000:
        step = rans.EVERY * rans.LANES
        assert (rans.decode(block, table, 1, 2) == tokens[step:2 * step]).all()
        broken = bytearray(block)
        broken[len(block) // 2] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            rans.decode(bytes(broken), table)


def test_one_symbol_and_rare_symbols():
    counts = np.array([0, 10 ** 9, 0, 1])
    assert rans.scaled(counts).sum() == 1 << rans.SCALE and rans.scaled(counts)[3] == 1
    table = rans.Table(rans.scaled(np.array([7])))
    assert (rans.decode(rans.encode(np.zeros(3000, np.uint32), table), table) == 0).all()


def test_token_files_of_odd_rows(spark, odd, none):
    from tokenizers import Tokenizer
    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = rans.checksums(rans.read(spark, rans.write(odd, path))).collect()
    want, start = [], 0
    rows = sorted(texts_of(odd), key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [rans.END]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(want)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [i for i, _ in rows]
    for r in ordered:
        assert r.start == start
        start += r.n_tokens
    assert rans.read(spark, rans.write(none, path)).count() == 0


def test_words_equal_whole_texts():
    from tokenizers import Tokenizer
    path = vocabulary("word_bpe_49k.json")
    library, words = Tokenizer.from_file(path), rans.WordTokens(path)
    texts = ["It's a | bar, a||b |", "x., y.. z,.", "É́ ẞ K İ Σς.", "a b　c\x1cd", "don't 12,345.67 $$$", "", "é. ́x", "<|endoftext|> a"] * 2
    for text, ids in zip(texts, words.encode(texts)):
        assert np.frombuffer(ids, words.kind).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_case_is_lowered_after_added_tokens_and_composition():
    from tokenizers import Tokenizer
    path = vocabulary("word_bpe_49k.json")
    library, words = Tokenizer.from_file(path), rans.WordTokens(path)
    assert all(t.content.encode().startswith(rans.OPENED) for t in library.get_added_tokens_decoder().values())
    signs = ["A", "H", "J", "T", "é", "\u0331", "\u030c", "\u0308", " ", "<|", "|>", "<|ENDOFTEXT|>", "<|endoftext|>", ".", ",", "x"]
    rng = random.Random(5)
    texts = ["a <|ENDOFTEXT|> b", "H\u0331", "J\u030c", "T\u0308", "a<|StartOfText|>B C", "PLAIN Words. H\u0331, T\u0308."]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 9))) for _ in range(800)]
    letters = "abcdefghijklmnopqrstuvwxyzABZßàéèñøœůžŉĳªºµǆ"
    texts += [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) + rng.choice(["", ".", ",", "!", "e\u0301"]) for _ in range(6)) for _ in range(600)]
    texts += texts[-50:]
    for text, ids in zip(texts, words.encode(texts)):
        assert np.frombuffer(ids, words.kind).tolist() == library.encode(text, add_special_tokens=False).ids, text


# ---- languages

def test_languages(spark, odd, none):
    rng = random.Random(2)
    sounds = {"aa": "ba be bi bo bu".split(), "bb": "kra kre kri ska ske".split(), "cc": "жа же ши ща ёк".split()}
    rows = [(k, " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(20)), lang) for k in range(300) for lang in [list(sounds)[k % 3]]]
    docs = spark.createDataFrame(rows + [(1000, None, "aa"), (1001, "12 34 !?", "bb"), (None, "babebi", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predictions(docs).collect()}
    held = [k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k].held_out for k in held) and sum(got[k].lang_pred == rows[k][2] for k in held) == len(held)
    assert (got[1000].lang_pred, got[1001].lang_pred, got[1000].score) == ("und", "und", 0.0)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].lang_pred == "aa"
    assert language_id.predictions(odd).count() == odd.count() and language_id.predictions(none).count() == 0


def test_held_out_languages_are_not_read(spark):
    rows = [(k, "aaa bbb", "x" if zlib.crc32(str(k).encode()) % 4 != 2 else "y") for k in range(80)]
    got = language_id.predictions(spark.createDataFrame(rows, "doc_id long, text string, lang string")).select("lang_pred").distinct().collect()
    assert [r[0] for r in got] == ["x"]


def test_folded_weights_are_the_kernel_regression():
    texts = ["abc abd", "abd abe xyz", "xyz zyx", "q", ""]
    alphabet = language_id.Alphabet(texts)
    kernel = language_id.Kernel(alphabet)
    marks = np.zeros((2, kernel.space), bool)
    for k in range(2):
        for code in kernel.codes(texts[k]):
            marks[k, code] = True
    known = np.flatnonzero(marks.any(axis=0))
    model = language_id.Model(["a", "b"], alphabet, known, marks[:, known], marks.sum(axis=1), np.array([[1.0, -0.5], [0.25, 2.0]]))
    assert np.allclose(model.similarity(texts) @ model.weights, model.regressions(texts)[0], atol=1e-5)
    assert np.isclose(model.similarity(["abc abd"])[0, 0], 1.0)


# ---- toxicity

def edit_distance(a, b, prefix=False):
    row = list(range(len(b) + 1))
    best = row[-1]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        best = min(best, row[-1])
    return best if prefix else row[-1]


def test_automaton_equals_edit_distance():
    terms = [("idiot", False), ("scum", False), ("disgusting", False), ("vequ", True), ("stupido", True)]
    auto = toxicity.Automaton(terms)
    rng = random.Random(4)
    words = {"idiot", "idiots", "1diot", "idot", "scum", "skum", "vequais", "veque", "vekuais", "disgustng", "disgusing", "stupidone", "stupdone", "x"}
    for term, _ in terms:
        for _ in range(150):
            w = list(term + rng.choice(["", "", "a", "xyz"]))
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(w) + 1)
                w[k:k + rng.randint(0, 1)] = [rng.choice("abdgiostuvz")] * rng.randint(0, 1)
            words.add("".join(w) or "x")
    words = sorted(words)
    codes = np.array([ord(c) for c in "".join(words)], np.uint32)
    lengths = np.array([len(w) for w in words])
    found = auto.match(codes, np.cumsum(lengths) - lengths, lengths)
    for word, verdict in zip(words, found.tolist()):
        costs = [edit_distance(word, t, s) for t, s in terms]
        fits = [c for c, (t, s) in zip(costs, terms) if c <= toxicity.edits_for(t, s)]
        assert (verdict >= 0) == bool(fits), word
        if fits:
            assert verdict % 3 == min(fits) and costs[verdict // 3] == min(fits), word


def test_context_tells_quotation_from_abuse():
    def weigh(text, word):
        at = text.index(word)
        return toxicity.context(text, at, at + len(word))
    assert weigh("what an idiot he is", "idiot") == 1.0
    assert weigh('he said "idiot" to him', "idiot") < 0.5 and weigh("the word idiot comes from greek", "idiot") < 0.5
    assert weigh('"you idiot" he said', "idiot") > weigh('"an idiot" he said', "idiot")


def toxic_rows(spark):
    rng = random.Random(6)
    filler = [f"{a}{b}{c}" for a in ("ba", "ke", "lo", "mi") for b in ("ran", "tel", "sid") for c in ("o", "um", "is")]
    rows, labels = [], []
    for k in range(900):
        words = [rng.choice(filler) + rng.choice(filler) for _ in range(rng.randint(5, 60))]
        toxic = k % 9 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["blorgus,", "Snarfle", "vexquak" + rng.choice(filler)])
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    rows += [(2000, "mikean snarfel balo keum"), (2001, 'the word "snarfle" is rude'), (2002, None), (2003, "")]
    labels += [(3000, 1), (None, 1), (5, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark, odd, none):
    docs, labels = toxic_rows(spark)
    got = {r.doc_id: r for r in toxicity.verdicts(docs, labels).collect()}
    held = [k for k in range(900) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert [k for k in held if not got[k].held_out] == [] and [k for k in held if got[k].predicted != (k % 9 == 0)] == []
    assert got[2001].predicted == 0 and got[2002].score == got[2003].score == 0.0
    assert all(0 <= r.score <= 1 for r in got.values())
    model = toxicity.fit(docs, labels)
    assert toxicity.reject(odd, model).columns == odd.columns and toxicity.reject(odd, model).count() == odd.count()
    assert {r.doc_id for r in toxicity.reject(docs, model).collect()} == {k for k, r in got.items() if r.score < 0.5}
    assert toxicity.verdicts(none, labels).count() == 0 and toxicity.verdicts(odd, labels.filter("1 = 0")).filter("score > 0").count() == 0


# ---- line rules

def test_line_rules_match_brute_force(odd, none):
    got = Counter()
    for r in line_quality.judge(odd).collect():
        got[(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)] += 1
    want = Counter()
    for i, t in texts_of(odd):
        t = t or ""
        w = WORD.findall(t)
        windows = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k:k + 5])] > 1 for j in range(5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))] += 1
    assert got == want and line_quality.judge(none).count() == 0


def test_lines_fail_by_rule_and_documents_by_loss(spark):
    good = "This is a plain sentence of quite some words."
    rows = [(1, f"{good}\nAnother good sentence follows here."), (2, f"Home | News | Login\n{good}"), (3, "Buy now\nclick here\n" + "HOT!! DEAL!! NOW!! GO!!\n" * 4 + good),
            (4, "All rights reserved.\n" + good + " Here stands a different second one with more to say.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_quality.judge(docs).collect()}
    assert [got[k].n_removed for k in (1, 2, 3, 4)] == [0, 1, 6, 1]
    assert [got[k].kept for k in (1, 2, 3, 4)] == [True, True, False, True]
    assert {r.doc_id: r.text for r in line_quality.clean(docs).collect()}[4] == rows[3][1].split("\n")[1]


# ---- licenses

def test_licenses_match_brute_force(spark, odd, none):
    rng = random.Random(8)
    parts = ["MIT License", "mit", "license", "the", "Apache-License", "CC BY 4.0", "cc", "by", "GNU General Public License", "gnu general", "public license", "x", "é", "licensé"]
    rows = [(k, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for k in range(200)] + texts_of(odd)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = Counter()
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
        at = [(k, label) for k in range(len(w)) for p, label in license_scan.PHRASES if w[k:k + len(p.split())] == p.split()]
        want[(i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at})))] += 1
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) for r in got)
    assert license_scan.scan(none).count() == 0


def test_template_survives_inserted_and_dropped_words(spark):
    rows = [(1, "Permission is hereby granted, free of charge, to any kind person obtaining copy of this software and associated documentation files"),
            (2, "permission granted free software"), (3, "Licensed under the KK mit licenſe")]
    got = {r.doc_id: r.labels for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "mit", 2: "", 3: ""}


def test_repeated_notices_keep_their_labels(spark):
    rows = [(1, "All rights reserved."), (2, "All rights reserved. All rights reserved."), (3, "All rights reserved. " * 40), (4, "all rights x reserved rights all"), (5, "word " * 5000 + "All rights reserved. All rights reserved.")]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("all-rights-reserved", 1.0), 2: ("all-rights-reserved", 1.0), 3: ("all-rights-reserved", 1.0), 4: ("", 0.5), 5: ("all-rights-reserved", 1.0)}
    near = [(1, "the mit license and the mit license, released under the mit license, the mit license"), (2, "mit license mit license"), (3, "released under the very mit license mit license mit license")]
    got = {r.doc_id: r.labels for r in license_scan.scan(spark.createDataFrame(near, "doc_id long, text string"), phrases=(), templates=(("released under the mit license", "x"),)).collect()}
    assert got == {1: "x", 2: "", 3: "x"}


# ---- mixing

def water_fill(sizes, weights, most):
    """Targets by rounds: share what is left by weight, stop those above their cap, until none is above."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        level = (total - sum(target[k] for k in range(len(sizes)) if k not in open_)) / sum(weights[k] for k in open_)
        over = [k for k in open_ if level * weights[k] > most * sizes[k]]
        if not over:
            for k in open_:
                target[k] = level * weights[k]
            break
        for k in over:
            target[k] = most * sizes[k]
            open_.discard(k)
    return target


def test_targets_match_rounds(spark):
    rng = random.Random(9)
    for trial in range(4):
        n = rng.randint(1, 9)
        names = sorted(f"s{k:02d}" for k in range(n - 1)) + [None]
        sizes = [rng.choice([0, 3, 10, 100, 1000, 5000]) for _ in names]
        frame = spark.createDataFrame(list(zip(names, sizes)), "source string, size long")
        got = {r.source: r for r in mixing.targets(frame).collect()}
        want = water_fill(sizes, [(5, 2, 1)[k % 3] for k in range(n)], 3)
        for name, size, target in zip(names, sizes, want):
            assert got[name].source_size == size and abs(got[name].target - target) < 1e-6 * max(1, sum(sizes)), trial


def test_mix_of_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(r.taken == r.size * r.copies <= 3 * r.size for r in got)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(odd.repartition(3)).collect()))
    out = mixing.emit(odd)
    assert out.columns == odd.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(none).count() == mixing.emit(none).count() == 0


def test_mix_moves_no_text(spark):
    """Beside the written table of sources neither way joins by a shuffle; past the threshold of a broadcast the rows are the same."""
    docs = spark.createDataFrame([(k, f"word {k} " * (k % 7), f"s{k % 5}" if k % 6 else None) for k in range(300)], "doc_id long, text string, source string")
    docs = docs.repartition(3)
    ways = [mixing.mix(docs), mixing.emit(docs)]
    for got in ways:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    few = [Counter(map(tuple, got.collect())) for got in ways]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert few == [Counter(map(tuple, way(docs).collect())) for way in (mixing.mix, mixing.emit)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_taken_words_come_near_the_target(spark):
    rows = [(k, "w " * (1 + k % 40), f"s{k % 4}") for k in range(8000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in got.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) < 0.05 * r["max(target)"]
