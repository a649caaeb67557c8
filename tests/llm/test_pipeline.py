import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tidewright.llm import _common as C
from tidewright.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_jaccard_join import brute
from tests.llm.test_packing import check_sequences

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are not here")


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark):
    docs = C.read(spark, DATA, "documents")
    at = [docs]
    for name, f in P.STAGES:
        at.append(C.as_table(f(spark, at[-1], DATA), "stage"))
    for df in at[1:-1]:
        assert df.columns == docs.columns
    labels = {r.doc_id: r.toxic for r in C.read(spark, DATA, "labels").collect()}
    clean = {k for k, _ in rows(at[1])}
    assert sum(labels.get(k) == 0 for k in clean) == sum(v == 0 for v in labels.values())
    best = {}
    for k, t in rows(at[1]):
        n = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[n] = min(best.get(n, (0, k)), (-len(t), k))
    assert sorted(k for k, _ in rows(at[2])) == sorted(k for _, k in best.values())
    assert sorted(k for k, _ in rows(at[3])) == sorted({v[1] for v in brute(rows(at[2])).values()})
    assert {k for k, _ in rows(at[4])} <= {k for k, _ in rows(at[3])}
    words = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert words(at[4]) == pytest.approx(words(at[3]), rel=0.1)
    pieces = at[5].collect()
    check_sequences(pieces)
    copies = at[4].groupBy("doc_id").count().collect()
    total = {r.doc_id: 0 for r in copies}
    for p in pieces:
        total[p.doc_id] += p.length
    size = {p.doc_id: p.doc_tokens for p in pieces}
    assert all(total[r.doc_id] == r["count"] * size[r.doc_id] for r in copies)


def test_run_and_queries(spark):
    assert P.run(spark, DATA).count() > 0
    names = [re.match(r"op(\d+)_", n)[1] for n in QUERIES]
    assert sorted(map(int, names)) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    a, b = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLE_SQL[name]).df()
    order = lambda d: d[sorted(d.columns)].sort_values("doc_id").reset_index(drop=True)
    assert order(a).astype(str).equals(order(b).astype(str))


#: The first columns of each query, in the order of its contract, and their types. More may follow.
CONTRACTS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op3_source_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op4_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op5_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op7_license_scan": "doc_id bigint, sentences string, licenses string, n_unknown bigint",
    "op8_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op9_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op10_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contracts(spark, name):
    got = C.as_table(QUERIES[name](spark, DATA), "result")
    want = [tuple(c.split(" ")) for c in CONTRACTS[name].split(", ")]
    assert got.dtypes[: len(want)] == want
    key, table = ("page_id", "pages") if "url" in name else ("doc_id", "documents")
    keys = sorted(r[0] for r in C.read(spark, DATA, table).select(key).collect())
    found = [r[0] for r in got.select(key).collect()]
    assert sorted(set(found) if name == "op4_packing" else found) == keys
    assert got.filter(" OR ".join(f"{c} IS NULL" for c, _ in want if c not in ("rule",))).count() == 0


TOXIC = ["gnarfle", "blorbix"]


def odd_corpus(odd_texts):
    """Labelled texts with toxic words, odd texts, copies, near copies, null keys and sources, and repeated rows."""
    words = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore".split()
    texts = [" ".join(words[(i * j + j) % 17] + str(i % 7) for j in range(40)) for i in range(80)]
    rows = [(i, t + (" " + TOXIC[i % 2]) * 3 if i % 4 == 0 else t, "ab"[i % 2]) for i, t in enumerate(texts)]
    rows += [(200 + i, t, None if i % 3 else "c") for i, t in enumerate(odd_texts)]
    rows += [(300, texts[1] + "  ", "a"), (301, texts[2] + " more", "b"), (302, texts[3], None), (302, texts[3], None), (None, texts[5], "a"), (None, None, None)]
    return rows, [(i, int(i % 4 == 0)) for i in range(80)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    def make(labels):
        d = tmp_path_factory.mktemp("sf")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        return str(d)

    return make


def test_stages_bear_odd_rows(spark, documents, odd_texts, clashing, tables):
    rows, labels = odd_corpus(odd_texts)
    docs = documents(rows, {k: v for k, v in clashing.items() if k != "_metadata"})
    d = tables([(k, 0, y) for k, y in labels])
    at = [docs]
    for _, f in P.STAGES[:-1]:
        at.append(C.as_table(f(spark, at[-1], d), "stage"))
        assert at[-1].columns == docs.columns
    text_of = {k: t for k, t, _ in rows}
    clean = {r.doc_id for r in at[1].collect()}
    assert not any(text_of[k] and any(w in text_of[k] for w in TOXIC) for k in clean if k is not None and k < 80 and k % 5)
    assert {k for k, t, _ in rows if k is not None and 200 <= k < 300} <= clean  # odd texts aren't toxic
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert at[2].count() == len({norm(r.text) for r in at[1].collect()})
    pieces = P.STAGES[-1][1](spark, at[4], d).collect()
    check_sequences(pieces)
    assert {p.doc_id for p in pieces} == {r.doc_id for r in at[4].collect()}


def test_stages_bear_empty_tables(spark, documents, tables):
    d = tables([])
    for docs in (documents([]), documents([(None, None, None)]), documents([(1, "", "a"), (2, None, "a")])):
        at = docs
        for _, f in P.STAGES:
            out = f(spark, at, d)
            at = C.as_table(out, "stage")
        assert at.count() >= 0
