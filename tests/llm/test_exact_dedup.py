import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import _common as C
from tidewright.llm import exact_dedup as D


def brute(rows):
    groups = defaultdict(list)
    for i, (key, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), key is None, key or 0, i))
    out = {}
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            out[m[3]] = (best[2] if not best[1] else None, len(members), hashlib.sha256(norm.encode()).hexdigest())
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 30_000])
def test_filter(n):
    r = np.random.default_rng(n)
    keys = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64))
    f = D.build_filter(keys)
    assert f.holds(keys).all()
    assert f.holds(r.integers(0, 1 << 64, 20_000, dtype=np.uint64)).mean() < 0.01


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a\tb\n"), (5, None), (6, ""), (7, " "), (8, "c"), (9, "c"), (None, "c"), (10, "Ab"), (None, "z"), (11, "q" * 100_000), (12, "q " * 100_000)]


@pytest.mark.parametrize("split", [None, "half", "all"])
@pytest.mark.parametrize("weak", [False, True])
def test_against_brute_force(documents, split, weak, monkeypatch):
    monkeypatch.setattr(C, "MOST_FILTER_BITS", 64 if weak else 1 << 28)  # a crowded filter lets all rows pass
    rows = ROWS + [(100 + i, f"copy {i % 7}" + " " * (i % 3)) for i in range(60)]
    docs = documents(rows)
    digest = (lambda t: F.substring(F.sha2(t, 256), 1, 2)) if weak else D.sha256
    in_snapshot = {None: None, "half": D.half("doc_id"), "all": F.lit(True)}[split]
    got = D.dedup(docs, in_snapshot, digest=digest).collect()
    expected = brute(rows)
    want = sorted((rows[i][0] or -1, v[0] or -1, v[1]) for i, v in expected.items())
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len({v[2] for v in expected.values()})
    if not weak:
        shas = {(rows[i][0] or -1): v[2] for i, v in expected.items() if rows[i][0]}
        assert all(shas[r.doc_id] == r.digest for r in got if r.doc_id)


def test_repeated_rows_keep_one(documents, clashing, odd_texts):
    docs = documents([(1, "a b")] * 3 + [(2, "ab")] + [(9, t) for t in odd_texts], clashing)
    kept = D.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.filter("doc_id = 1").count() == 1 and kept.filter("doc_id = 2").count() == 0
    assert kept.filter("doc_id = 9").count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in odd_texts})


def test_empty(documents, spark):
    docs = documents([])
    assert D.dedup(docs).count() == 0 and D.keep_first(docs).count() == 0


def test_snapshots_screen(spark):
    groups = spark.range(2000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.lit(1).cast("long").alias("size"))
    snap = D.build_snapshot(groups.limit(1000), buckets=8)
    screened = D.screen(groups, snap)
    known = screened.join(snap.groups.select("digest"), "digest", "left_semi")
    assert known.filter("not maybe").count() == 0
    assert screened.filter("maybe").count() < 1030


def test_row_filters(documents):
    docs = C.with_row(documents([(i, f"t {i}") for i in range(3000)]))
    some = docs.filter("doc_id % 100 = 3").select("_row")
    passed = {r[0] for r in docs.filter(C.passes(some, "_row", 30, "_row")).select("doc_id").collect()}
    assert {i for i in range(3000) if i % 100 == 3} <= passed and len(passed) < 60
    left = C.without_rows(docs, some, "_row", 30)
    assert left.columns == docs.columns
    assert sorted(r[0] for r in left.select("doc_id").collect()) == [i for i in range(3000) if i % 100 != 3]
