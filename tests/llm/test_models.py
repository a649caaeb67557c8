import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import language_id as L
from tidewright.llm import toxicity as X
from tidewright.llm import url_filter as U

# ---- toxicity

CLEAN, BAD = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split(), ["gnarfle", "blorbix"]


def labelled(n, seed=0):
    r = random.Random(seed)
    rows, y = [], []
    for _ in range(n):
        w = [r.choice(CLEAN) + r.choice(["", "s", "ed"]) for _ in range(r.randrange(5, 80))]
        bad = r.random() < 0.3
        if bad:
            w[r.randrange(len(w))] = r.choice(BAD)
        rows.append(" ".join(w))
        y.append(int(bad))
    return rows, np.array(y, np.int8)


def test_classifier_holds_out(spark, documents):
    train, y = labelled(600)
    model = X.fit_local(train, y)
    test, want = labelled(300, 1)
    docs = documents(list(enumerate(test)) + [(1000, "GNARFLE " + "lorem " * 30_000), (1001, None), (1002, "")])
    got = {r.doc_id: r.score for r in X.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == want[i] for i in range(300)]) > 0.97
    assert got[1000] > 0.5 and got[1001] == got[1002] < 0.5
    assert all(0 <= s <= 1 for s in got.values())


def by_hand(model, text):
    """From strings: the distinct n-grams of the text in lower case, white space as blanks, with a blank on either side."""
    known = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    data = b" " + bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in text.encode()) + b" "
    z = model.intercept
    for gram in {data[i : i + n] for n in X.ORDERS for i in range(len(data) - n + 1)}:
        h = 0
        for b in gram:
            h = (h * int(X._K) + int(X._BYTE[b])) % (1 << 64)
        z += known.get(h, 0.0)
    return 1 / (1 + np.exp(-z))


def test_scores_of_batches_are_those_of_single_texts(odd_texts):
    train, y = labelled(200)
    model = X.fit_local(train, y)
    texts = [t or "" for t in odd_texts] + train[:30]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    bits = np.zeros(1 << X.BUCKET_BITS, bool)
    bits[X._bucket(model.keys)] = True
    got = X.score_bytes(model, bits, np.frombuffer(b"".join(data), np.uint8), offsets)
    assert got == pytest.approx([by_hand(model, t) for t in texts], abs=1e-5)


def test_ratios_scale_features():
    p, q = np.array([5.0, 0.0]), np.array([1.0, 4.0])
    assert X._ratio(p, q, 9, 19) == pytest.approx(np.log([(5.5 / 10) / (1.5 / 20), (0.5 / 10) / (4.5 / 20)]))


def test_sample_is_labelled_and_bounded(documents, spark, clashing):
    train, y = labelled(300)
    docs = documents(list(enumerate(train)), clashing)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(5, 1), (None, 1), (9999, 0)], "doc_id long, toxic int")
    model = X.fit(docs, labels, rows_per_class=(100, 50))
    scored = X.score(docs, model, out="_score")
    assert scored.count() == 300 and len(model.keys)
    none = X.fit(docs, labels.filter("false"))
    assert X.score(documents([(1, "a")]), none).first().score < 0.01
    assert X.score(documents([]), model).count() == 0


def same(a, b):
    return np.array_equal(a.keys, b.keys) and np.array_equal(a.weights, b.weights) and a.intercept == b.intercept


def test_held_out_labels_teach_nothing(documents, spark):
    import zlib

    train, y = labelled(300)
    docs = documents(list(enumerate(train)))
    turned = [(i, 1 - int(v) if zlib.crc32(str(i).encode()) % 5 == 0 else int(v)) for i, v in enumerate(y)]
    a, b = (X.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int")) for rows in (list(enumerate(map(int, y))), turned))
    assert same(a, b) and turned != list(enumerate(map(int, y)))


def test_sample_is_bounded_by_rows(documents, spark, monkeypatch):
    """One key on many rows, null and empty texts, and a class with long texts only."""
    seen = []
    monkeypatch.setattr(X, "fit_local", lambda texts, y, **_: seen.append((texts, y)))
    rows = [(1, "again")] * 500 + [(2, None), (3, ""), (8, None)] + [(i, "short one") for i in range(10, 60)] + [(70 + i, f"{i} " * 300) for i in range(40)]
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (8, 1), *((i, 0) for i in range(10, 60)), *((70 + i, 1) for i in range(40))], "doc_id long, toxic int")
    X.fit(documents(rows), labels, rows_per_class=(30, 20), max_chars=100)
    texts, y = seen[0]
    assert (y == 0).sum() == 30 and (y == 1).sum() == 20 and all(0 < len(t) <= 100 for t in texts)


# ---- language

SYLLABLES = {"aa": ["ba", "ko", "li"], "bb": ["sch", "tz", "üg"], "cc": ["ñe", "oxa", "rr"]}


def language_rows(n, seed):
    r = random.Random(seed)
    return [(i, " ".join("".join(r.choice(SYLLABLES[k]) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(4, 60))), k) for i in range(n) for k in [r.choice(list(SYLLABLES))]]


def test_gradients():
    net = L.Network.start(["a", "b"], 3, 1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    r = np.random.default_rng(0)
    seg, lengths, y = r.integers(0, 256, (5, 4)).astype(np.uint8), np.array([5, 4, 2, 1]), np.array([0, 1, 1, 0])
    _, grads = net.gradients(seg, lengths, y)
    for k, w in net.weights.items():
        i = (0, int(seg[0, 0])) if k[0] == "x" else (0,) * w.ndim
        old = w[i]
        w[i] = old + 0.01
        up = net.gradients(seg, lengths, y)[0]
        w[i] = old - 0.01
        down = net.gradients(seg, lengths, y)[0]
        w[i] = old
        assert (up - down) / 0.02 == pytest.approx(grads[k][i], rel=2e-3, abs=2e-6)


def test_language_holds_out(spark, documents, odd_texts):
    rows = language_rows(500, 0)
    docs = spark.createDataFrame([(i, t, k) for i, t, k in rows], "doc_id long, text string, lang string")
    net = L.fit(docs, rows_per_language=150, steps=60)
    test = language_rows(200, 5)
    got = {r.doc_id: r for r in L.predict(documents([(i, t) for i, t, _ in test]), net).collect()}
    assert np.mean([got[i].lang_pred == k for i, _, k in test]) > 0.97
    odd = {r.doc_id: r for r in L.predict(documents(list(enumerate(odd_texts))), net).collect()}
    for i, t in enumerate(odd_texts):
        assert (odd[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= odd[i].score <= 1
    assert L.predict(documents([]), net).count() == 0
    assert L.fit(docs.filter("false")) is None
    assert L.predict(documents([(1, "abc")]), None).first().lang_pred == "und"


def one_direction(net, data, d):
    """States of the gated unit, position by position, from its equations."""
    n, w = net.hidden, net.weights
    h, out = np.zeros(n), {}
    for t in range(len(data)) if d == "f" else reversed(range(len(data))):
        x, u = w["x" + d][:, data[t]].astype(float), w["u" + d].astype(float) @ h
        r, z = (1 / (1 + np.exp(-(x[k * n : (k + 1) * n] + u[k * n : (k + 1) * n]))) for k in (0, 1))
        c = np.tanh(x[2 * n :] + r * (u[2 * n :] + w["b" + d][:, 0]))
        h = z * h + (1 - z) * c
        out[t] = h
    return np.array([out[t] for t in range(len(data))])


def test_pooling_is_over_all_positions():
    """Against the equations, for texts of no byte, of less than a segment, of whole segments, and of more."""
    net = L.Network.start(["a", "b", "c"], 4, 3)
    data = [b"x" * 5, b"hello world " * 32, b"", b"q", "größer und weiter ".encode() * 23, b"z" * 128, b"y" * 129]
    assert len(data[1]) == 3 * L.SEGMENT and len(data[4]) % L.SEGMENT
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    got = L.label(net, np.frombuffer(b"".join(data), np.uint8), offsets)
    for d, p in zip(data, got, strict=True):
        total = np.zeros(3)
        for i in range(0, len(d), L.SEGMENT):
            seg = d[i : i + L.SEGMENT]
            z = np.concatenate([one_direction(net, seg, "f"), one_direction(net, seg, "b")], axis=1) @ net.weights["out"].T + net.weights["bias"][:, 0]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            total += (e / e.sum(axis=1, keepdims=True)).sum(axis=0)
        assert p == pytest.approx(total / max(len(d), 1), abs=2e-3)


def test_held_out_languages_teach_nothing(spark, documents):
    import zlib

    rows = language_rows(200, 2)
    turned = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else k) for i, t, k in rows]
    a, b = (L.fit(spark.createDataFrame(r, "doc_id long, text string, lang string"), rows_per_language=40, steps=3) for r in (rows, turned))
    assert a.languages == b.languages == ["aa", "bb", "cc"] and all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights)


def test_language_of_long_texts_only_and_of_one_key(spark, monkeypatch):
    """A language that only long texts carry is learned; a key with many rows gives no more than its share."""
    seen = []
    monkeypatch.setattr(L, "train", lambda segments, y, languages, **_: seen.append((segments, y, languages)))
    rows = [(1, "ba ko li " * 5000, "aa")] * 3 + [(7, "sch tz", "bb")] * 400 + [(11, "", "dd"), (12, None, "dd"), (13, "x", None)]
    L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows_per_language=50)
    segments, y, languages = seen[0]
    assert languages == ["aa", "bb"] and (y == 1).sum() == 50 and (y == 0).sum() >= 3 and max(map(len, segments)) <= L.SEGMENT


def test_language_of_odd_columns(documents, clashing):
    docs = documents([(1, "abc"), (1, "abc"), (None, "abc"), (2, None)], clashing)
    got = L.predict(docs, L.Network.start(["a", "b"], 2, 0))
    assert got.columns == ["doc_id", "lang_pred", "score"] and got.count() == 4


# ---- URLs

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]
URLS = [
    ("http://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/"),
    ("https://www.Example.com/en/1?x=/de/#y", "www.example.com", "/en/1", "www.example.com/en/"),
    ("http://example.com/EN/1", "example.com", "/EN/1", "com/"),
    ("http://badexample.com/en/", "badexample.com", "/en/", "com/"),
    ("http://com", "com", "", None),
    ("http://x.com?q", "x.com", "", None),
    ("http://x.net/es", "x.net", "/es", None),
    ("http://x.net/es/", "x.net", "/es/", "net/es/"),
    ("no scheme.com/", "", "", None),
    ("://h/p#f", "h", "/p", None),
    ("http://a://b/c", "a:", "//b/c", None),
    ("http://é.com/\n/x", "é.com", "/\n/x", "com/"),
    (None, "", "", None),
    ("", "", "", None),
]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string")


def test_rules(spark):
    df = pages(spark, [(i, u[0]) for i, u in enumerate(URLS)])
    got = {r.page_id: r for r in U.judge_urls(df, RULES, U.fit(df, RULES)).collect()}
    for i, (_, host, path, rule) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        if rule:
            assert got[i].verdict == {r: v for v, r in RULES}[rule]
    assert U.judge_urls(df.filter("false"), RULES, U.fit(df, RULES)).count() == 0
    assert {r.verdict for r in U.judge_urls(df, [], U.fit(df, [])).collect()} == {"allow"}


def test_markov_is_witten_bell():
    m = U.Markov(2).train([b"abab", b"abc"])

    def p(context, c, order):
        texts = [b"abab", b"abc"]
        base = 1 / 256 if order == 0 else p(context[1:], c, order - 1)
        after = [t[i] for t in texts for i in range(len(t)) if (b"\0\0" + t)[i + 2 - order : i + 2] == context]
        return base if not after else (after.count(c) + len(set(after)) * base) / (len(after) + len(set(after)))

    for text in (b"ab", b"abc", b"cba", b"zz"):
        want = sum(np.log(p((b"\0\0" + text)[i : i + 2], text[i], 2)) for i in range(len(text)))
        assert m.log_likelihood([text])[0] == pytest.approx(want)
    assert m.log_likelihood([b""])[0] == 0


def test_models_tell_urls_apart(spark):
    r = random.Random(0)
    good = [f"https://news{r.randrange(99)}.site.com/article/{r.randrange(9999)}" for _ in range(300)]
    bad = [f"http://win-cash-{r.randrange(99)}.site.net/es/{r.randrange(9999)}?promo" for _ in range(300)]
    df = pages(spark, list(enumerate(good + bad)))
    model = U.fit(df, RULES)
    held = [f"https://news{i}.other.org/article/{i}" for i in range(50)] + [f"http://win-cash-{i}.other.org/es/{i}?promo" for i in range(50)]
    got = {x.page_id: x.verdict for x in U.judge_urls(pages(spark, list(enumerate(held))), RULES, model).collect()}
    assert np.mean([got[i] == ("allow" if i < 50 else "block") for i in range(100)]) > 0.95
    edges = np.arange(8.0)
    assert U.calibrate(edges, np.array([0, 1, 1, 0, 0, 0, 0]), np.array([0, 0, 0, 0, 0, 1, 1])) == pytest.approx(4)
    assert U.calibrate(edges, np.zeros(7), np.ones(7)) == 0


def test_models_count_all_urls(spark):
    """Counts gathered in tasks are those of all distinct URLs that rules decide, but for the held-back ones."""
    urls = [f"http://a{i % 40}.com/{i % 90}/x" for i in range(400)] + [f"http://b{i % 30}.net/es/{i}" for i in range(300)]
    df = pages(spark, list(enumerate(urls))).repartition(5)
    judge = U.fit(df, RULES)
    held = {r.u for r in df.selectExpr("url AS u", "pmod(xxhash64('held back', url), 5) = 0 AS held").filter("held").collect()}
    for model, end in ((judge.accepted, ".com/"), (judge.rejected, ".net/es/")):
        want = U.Markov(5).train(sorted(u.encode() for u in set(urls) - held if end in u))
        for got, exact in zip(model.pairs + model.contexts, want.pairs + want.contexts, strict=True):
            for x, y in zip(got, exact, strict=True):
                np.testing.assert_array_equal(x, y)
    small = U.fit(df, RULES, entries=50)
    assert all(sum(len(k) for k, _ in m.pairs[1:]) <= 50 for m in (small.accepted, small.rejected))
    assert small.accepted.pairs[0][1].sum() == judge.accepted.pairs[0][1].sum()


def test_odd_urls(spark, clashing):
    rows = [(1, "http://x.org/a"), (1, "http://x.org/a"), (None, "http://x.org/a"), (2, "http://x.org/" + "a" * 300_000), (3, "http://y.com/" + "b" * 50_000), (4, "http://y.net/es/"), (5, "://")]
    df = pages(spark, rows).select("*", *(c.alias(n) for n, c in ({"host": F.lit("h"), "path": F.lit("p"), "rule": F.lit("r"), "verdict": F.lit("v"), "_url": F.lit("u"), "ratio": F.lit("x")} | {n: c for n, c in clashing.items() if n not in ("_metadata",)}).items()))
    got = U.judge_urls(df, RULES, U.fit(df, RULES)).collect()
    assert len(got) == len(rows) and {r.verdict for r in got} <= {"allow", "block"}
    assert len({(r.host, r.path, r.rule, r.verdict, r.ratio) for r in got if r.path == "/a"}) == 1
    assert U.judge_urls(df, RULES, U.fit(df.filter("false"), RULES)).count() == len(rows)


def test_contexts_beyond_the_entries_are_joined(spark, monkeypatch):
    """Ratios, verdicts and threshold are those of the whole models, however few contexts are sent to tasks."""
    r = random.Random(3)
    words = ["alpha", "news", "win", "cash", "x", "é", "q" * 40]
    made = [f"http://{r.choice(words)}{r.randrange(30)}.{end}{r.choice(words)}/{r.randrange(500)}" for end in ("com/", "net/es/", "org/", "net/fr/") for _ in range(150)]
    rows = [(i, u) for i, u in enumerate(made + made[:100] + [made[301]] * 300 + ["", None, "h", "://", "http://z.org/" + "ab" * 5000])]
    df = pages(spark, rows).repartition(4)
    whole = U.fit(df, RULES)
    want = {x.page_id: x for x in U.judge_urls(df, RULES, whole).collect()}
    sizes = [sum(len(k) for k, _ in m.pairs[1:]) for m in (whole.accepted, whole.rejected)]
    assert len(want) == len(rows) and sizes[0] != sizes[1]
    for entries, common in ((0, 1 << 16), (300, 3), (min(sizes), 1)):  # of the last, one model is whole
        monkeypatch.setattr(U, "COMMON", common, raising=False)
        part = U.fit(df, RULES, entries=entries)
        assert part.threshold == whole.threshold
        for m, exact in ((part.accepted, whole.accepted), (part.rejected, whole.rejected)):
            for (keys, n), (contexts, *rest), (all_keys, all_n), (all_contexts, *all_rest) in zip(m.pairs, m.contexts, exact.pairs, exact.contexts, strict=True):
                assert np.array_equal(n, all_n[np.searchsorted(all_keys, keys)])
                at = np.searchsorted(all_contexts, contexts)
                assert all(np.array_equal(x, y[at]) for x, y in zip(rest, all_rest, strict=True))
        got = U.judge_urls(df, RULES, part).collect()
        assert sorted(x.page_id for x in got) == sorted(want)
        for x in got:
            assert x.ratio == pytest.approx(want[x.page_id].ratio, abs=1e-9)
            assert (x.host, x.path, x.rule, x.verdict) == (want[x.page_id].host, want[x.page_id].path, want[x.page_id].rule, want[x.page_id].verdict)
        assert len({x.ratio for x in got if x.page_id < len(made + made[:100]) + 300 and rows[x.page_id][1] == made[301]}) == 1
        assert part.rest is not None and sorted(m.whole for m in part.models.values()) == [False, entries == min(sizes)]
    assert whole.rest is None
