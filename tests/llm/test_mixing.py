import random

import pytest
from pyspark.sql import functions as F

from tidewright.llm import mixing as M


def water(sizes, weights=(5, 2, 1), cap=3):
    """The contract's rule, step by step: sources above their cap stop there and the excess is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free} if free else {}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    r = random.Random(seed)
    names = [None, "", "Z", "a", "é", "日", "src10", "src2"][: r.randrange(1, 9)]
    sizes = {n: r.choice([0, 1, 10, 500, 100_000]) for n in names}
    rows = spark.createDataFrame([(n, s) for n, s in sizes.items()], "source string, size long")
    got = {x.source: x.target for x in M.targets(rows).collect()}
    assert {k: pytest.approx(v) for k, v in water(sizes).items()} == got


def test_flight_keeps_both_totals():
    r = random.Random(1)
    for _ in range(20):
        n = r.randrange(0, 200)
        p, size = [r.random() for _ in range(n)], [r.randrange(0, 500) for _ in range(n)]
        out = M.fly(p, size, random.Random(0))
        assert sum(0 < x < 1 for x in out) <= 2
        assert sum(out) == pytest.approx(sum(p)) and sum(a * b for a, b in zip(out, size)) == pytest.approx(sum(a * b for a, b in zip(p, size)), abs=1e-4)


def test_flight_keeps_probabilities():
    """Over many draws each document is in as often as its probability says."""
    p, size = [0.2, 0.5, 0.7, 0.35, 0.9, 0.1, 0.65, 0.6], [3, 9, 2, 7, 5, 8, 1, 4]
    hits = [0.0] * len(p)
    for k in range(3000):
        for i, x in enumerate(M.fly(p, size, random.Random(k))):
            hits[i] += x / 3000
    assert hits == pytest.approx(p, abs=0.04)


def test_exchange_makes_good_what_landing_misses():
    size = [8000, 500, 400, 300, 200, 100, 50, 20, 10, 0]
    for p in ([1.0, *[0.0] * 9], [0.0] * 10, [1.0] * 10):
        got = M.exchange(p, size, 1230.0)
        assert set(got) <= {0.0, 1.0} and sum(a * b for a, b in zip(got, size)) == pytest.approx(1230, abs=60)
    assert M.exchange([1.0, 0.0], [5, 9], 5) == [1.0, 0.0] and M.exchange([], [], 0) == []


def texts(seed, n=900):
    r = random.Random(seed)
    return [(i, " ".join("w" for _ in range(r.randrange(0, 60))), r.choice(["big"] * 6 + ["b", "c", None])) for i in range(n)]


@pytest.mark.parametrize("chunk", [1024, 16])
def test_mix(documents, chunk, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", chunk)
    monkeypatch.setattr(M, "GROUP", 4)
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0 if chunk == 16 else 10)
    rows = texts(3)
    docs = documents(rows)
    got = M.mix(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    target = water(sizes)
    assert len(got) == len(rows)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]} and mine[0].target == pytest.approx(target[s])
        assert sum(r.taken for r in mine) == pytest.approx(target[s], abs=30)
        assert sum(r.copies for r in mine) == pytest.approx(len(mine) * target[s] / sizes[s], abs=4)
    assert all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in got)
    again = {(r.doc_id, r.taken) for r in M.mix(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_odd_rows(documents, odd_texts, clashing):
    docs = documents([(i, t, None if i % 2 else "s") for i, t in enumerate(odd_texts)] + [(7, "a b"), (7, "a b")], clashing)
    got = M.mix(docs)
    assert got.count() == docs.count() and got.filter("size = 0 and taken > 0").count() == 0
    out = M.apply_mix(docs)
    assert out.columns == docs.columns
    assert out.count() == got.agg(F.sum("copies")).first()[0]
    assert M.mix(documents([])).count() == 0 and M.apply_mix(documents([])).count() == 0
    assert M.mix(documents([(1, "", "a"), (2, None, "b")])).agg(F.sum("taken")).first()[0] == 0


def long_texts():
    """A source in many chunks and one in a single chunk, each with one very long document."""
    r = random.Random(5)
    sizes = [("a", 1501), ("b", 301), *(("a", r.randrange(0, 12)) for _ in range(400)), *(("b", r.randrange(0, 9)) for _ in range(100)), *(("c", r.randrange(0, 40)) for _ in range(40))]
    return [(i, "w " * n, s) for i, (s, n) in enumerate(sizes)]


@pytest.mark.parametrize("chunk, group", [(1024, 256), (128, 256), (16, 256), (16, 3)])
def test_words_are_met_at_every_number_of_chunks(documents, chunk, group, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", chunk)
    monkeypatch.setattr(M, "GROUP", group)
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0 if group == 3 else 10)
    rows = long_texts()
    got = M.mix(documents(rows)).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    misses = {s: sum(r.taken for r in got if r.source == s) - next(r.target for r in got if r.source == s) for s in "abc"}
    assert all(abs(x) <= 1 for x in misses.values())
    assert all(r.taken == r.copies * r.size for r in got)


@pytest.mark.parametrize("key", [7, None])
def test_one_key_on_most_rows(documents, key, monkeypatch):
    """Rows of a repeated key are dealt out by their place, so that no chunk gathers them."""
    monkeypatch.setattr(M, "CHUNK", 16)
    seen = []
    dealt = M._dealt
    monkeypatch.setattr(M, "_dealt", lambda todo: seen.append(out := dealt(todo)) or out)
    docs = documents([(key, "w " * (i % 9), "a") for i in range(400)] + [(1000 + i, "w w w", "b") for i in range(50)])
    got = M.mix(docs).collect()
    assert len(got) == 450 and max(r["count"] for r in seen[0].groupBy("source", "chunk").count().collect()) <= 4 * 16
    for s in "ab":
        mine = [r for r in got if r.source == s]
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, abs=1)
    again = sorted((r.doc_id or 0, r.size, r.taken) for r in M.mix(docs).collect())
    assert again == sorted((r.doc_id or 0, r.size, r.taken) for r in got)


def test_targets_in_ranges(spark, monkeypatch):
    """The same targets when sources are put in order range by range."""
    r = random.Random(4)
    sizes = {f"s{r.randrange(10**6)}": r.choice([0, 1, 7, 100, 5000]) for _ in range(200)} | {None: 300}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    monkeypatch.setattr(M, "RANGE_ROWS", 30)
    assert {x.source: x.target for x in M.targets(rows).collect()} == {k: pytest.approx(v) for k, v in water(sizes).items()}


def test_exchange_is_not_capped():
    assert sum(M.exchange([1.0] + [0.0] * 999, [5000] + [3] * 999, 2500.0)) == 833
