import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from tidewright.llm import components as K
from tidewright.llm import jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, percent=80):
    sets = {k: shingles(t) for k, t in rows}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for k, s in sets.items():
        met = Counter()
        for g in s:
            met.update(index[g])
            index[g].append(k)
        for o, n in met.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = sorted((find(k), find(o)))
                parent[b] = a
    return {k: (len(s), find(k)) for k, s in sets.items()}


def words(r, n):
    return [f"w{r.randrange(4000)}" for _ in range(n)]


def corpus(seed):
    """Families of near copies at all distances, shared passages, chains, copies and short texts."""
    r = random.Random(seed)
    texts = []
    passage = words(r, 60)
    for _ in range(12):
        base = words(r, r.randrange(30, 200))
        for _ in range(r.randrange(1, 14)):
            t = list(base)
            for _ in range(r.randrange(0, 9)):
                t[r.randrange(len(t))] = "edit" + str(r.randrange(10**6))
            texts.append(t)
        chain = list(base)
        for _ in range(6):
            for _ in range(2):
                chain[r.randrange(len(chain))] = "link" + str(r.randrange(10**6))
            texts.append(list(chain))
    texts += [words(r, 8) + passage + words(r, r.randrange(0, 30)) for _ in range(40)]
    texts += [words(r, r.randrange(1, 8)) for _ in range(20)] + [["hi", "there"]] * 4 + [["Hi", "THERE"]]
    r.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(documents, seed, small, monkeypatch):
    if small:  # a crowded sketch, small chunks, salted lists and tokens in blocks
        for name, value in {"LEAST_SKETCH_BITS": 16, "CHUNK": 3, "CHUNK_TOKENS": 150, "HOT": 5, "SALTED": 4, "BLOCK_GROUPS": 2, "PARTITION_ROWS": 300}.items():
            monkeypatch.setattr(J, name, value)
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(documents(rows)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("bits", [3, 6])
def test_clashing_sums(documents, bits):
    rows = corpus(4)[:150]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(documents(rows), bits=bits).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("percent", [50, 95, 100])
def test_other_thresholds(documents, percent):
    rows = corpus(3)[:120]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(documents(rows), percent=percent).collect()}
    assert got == brute(rows, percent)


def test_odd_texts(documents, odd_texts, clashing):
    rows = list(enumerate(odd_texts))
    docs = documents(rows, clashing)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(docs).collect()}
    assert got == brute(rows)
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {v[1] for v in got.values()}


def test_repeats_nulls_and_nothing(documents):
    docs = documents([(5, "a b c d e f")] * 3 + [(None, "a b c d e f"), (7, ""), (7, ""), (8, "x y z v w u")])
    got = J.join(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, 5), (5, 5), (5, 5), (5, 5), (7, 7), (7, 7), (8, 8)]
    assert J.keep_one(docs).count() == 4  # one of the first group, both empty ones, the last
    assert J.join(documents([])).count() == 0 and J.keep_one(documents([])).count() == 0
    assert J.join(documents([(1, None), (2, " ")])).count() == 2


def test_shingles_of_chunks():
    r = random.Random(0)
    texts = [" ".join(words(r, r.randrange(0, 40))) + r.choice(["", " ", "\n"]) for _ in range(50)]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    tokens, bounds = J.shingle_sets(np.frombuffer(b"".join(data), np.uint8), offsets)
    for i, t in enumerate(texts):
        assert bounds[i + 1] - bounds[i] == len(shingles(t))
        alone, _ = J.shingle_sets(np.frombuffer(data[i], np.uint8), np.array([0, len(data[i])]))
        np.testing.assert_array_equal(alone, tokens[bounds[i] : bounds[i + 1]])


def test_words_that_repeat_a_pattern():
    """Words of Thue-Morse letters, which defeat hashes that are polynomials modulo a power of two."""
    a, b = b"a", b"b"
    for _ in range(10):
        a, b = a + b, b + a
    assert len(a) == 1024 and a != b
    for k in (1, 6):
        texts = [b" ".join([w] * k) for w in (a, b)]
        one, two = (set(J.shingle_sets(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tolist()) for t in texts)
        assert one and not one & two


def test_words_differ_in_any_byte():
    r = random.Random(2)
    words_ = {bytes(r.choice(b"abc") for _ in range(r.choice([1, 7, 8, 9, 15, 16, 17, 40, 255, 256, 257, 300]))) for _ in range(3000)} | {b"a" * n for n in range(1, 600)}
    words_ = sorted(words_)
    data = b"\t".join(w.upper() if i % 2 else w for i, w in enumerate(words_))
    buf = np.frombuffer(data, np.uint8)
    h = J._word_hashes(buf, buf != 9, np.array([len(w) for w in words_]))
    assert len(set(h.tolist())) == len(words_)
    again = J._word_hashes(np.frombuffer(b"".join(reversed(words_)), np.uint8), np.ones(sum(map(len, words_)), bool), np.array([len(w) for w in reversed(words_)]))
    np.testing.assert_array_equal(again[::-1], h)


def test_sketch_counts_whatever_comes():
    r = np.random.default_rng(1)
    sketch, total = J.Sketch(16), np.zeros(1 << 16, np.int64)
    parts = [r.integers(0, 1 << 64, 5000, dtype=np.uint64) for _ in range(3)] + [np.full(n, 7 << 48, np.uint64) for n in (60_000, 60_000, 200_000, 3)]
    import zlib

    for p in parts:
        for block, data in sketch.add(p):
            total[block << 16 : (block + 1) << 16] += np.frombuffer(zlib.decompress(data), np.uint16)
    for block, data in sketch.blocks():
        total[block << 16 : (block + 1) << 16] += np.frombuffer(zlib.decompress(data), np.uint16)
    np.testing.assert_array_equal(total, np.bincount((np.concatenate(parts) >> np.uint64(48)).astype(int), minlength=1 << 16))


def test_many_groups_of_one_token_make_few_pairs(spark, monkeypatch):
    """A token of 300 groups pairs them only where it is indexed; the pairs that are left are those that all tokens give."""
    r = random.Random(3)
    rows = [(7, g, g, g, g % 50 == 0, 100, 100) for g in range(300)] + [(100 + t, g, g, g, True, 100, 100) for t in range(40) for g in r.sample(range(300), 2)]
    matrix = spark.createDataFrame(rows, "token long, group long, c0 long, c1 long, indexed boolean, n0 long, n1 long")
    size = matrix.groupBy("token").count()
    found = {}
    for most in (512, 8):
        blocks = size.selectExpr("token", f"ceil(count / {most}) AS blocks")
        mixed = matrix.join(blocks, "token")
        found[most] = {tuple(x) for x in J._bounded(mixed, mixed.agg({"blocks": "max"}).first()[0], 100).collect()}
    assert found[512] <= found[8] and len(found[8]) <= 6 * 300 + 40
    assert {(a, b) for a, b in found[8]} >= {tuple(sorted(x)) for x in found[512]}


def test_groups_open_only_if_they_can_link():
    row = lambda side, node, toks: {"side": side, "node": node, "component": node, "toks": np.array(toks)}
    far = pd.DataFrame([row(0, 1, range(10)), row(1, 2, range(5, 15))])
    near = pd.DataFrame([row(0, 1, range(10)), row(1, 2, [*range(9), 99])])
    assert J.open_groups(far, 80) == [] and J.open_groups(near, 80) == [(2, 1)]
    own = pd.DataFrame([row(0, 1, range(10)), row(0, 2, [*range(9), 99]), row(0, 3, range(50, 60))])
    assert J.open_groups(own, 80) == [(1, 2)]


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    r = random.Random(9)
    n = 60
    edges = {"path": [(i, i + 1) for i in range(n)], "star": [(0, i) for i in range(1, n)], "random": [(r.randrange(n), r.randrange(n)) for _ in range(40)]}[shape]
    parent = list(range(n + 1))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    touched = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in K.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in touched}
    assert K.components(spark.createDataFrame([], "u long, v long")).count() == 0
    with pytest.raises(RuntimeError):
        K.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long"), rounds=1)
