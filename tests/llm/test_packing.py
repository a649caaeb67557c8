import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import packing as P
from tidewright.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return P.Tokenizer(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_the_librarys(text):
    t = test_ids_are_the_librarys.__dict__.setdefault("t", None) or P.Tokenizer(PATH)
    test_ids_are_the_librarys.__dict__["t"] = t
    assert t.ids(text).tolist() == t.library.encode(text, add_special_tokens=False).ids


def test_long_runs(tokenizer):
    for text in (" " * 50_000 + "x", "a" * 50_000, "a\n" * 30_000):
        assert tokenizer.ids(text).tolist() == tokenizer.library.encode(text, add_special_tokens=False).ids


def check_sequences(pieces, window=1024):
    """Gapless from 0, and of full length or a power of two; returns the tokens of padding."""
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= window and (end == window or end & (end - 1) == 0)


def test_round_trip(documents, tokenizer, odd_texts, clashing):
    rows = list(enumerate(odd_texts)) + [(100 + i, f"document number {i} " * (i % 50)) for i in range(80)]
    pieces = P.pack(documents(rows, clashing), PATH).collect()
    check_sequences(pieces)
    by = defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    assert set(by) == {k for k, _ in rows}
    for k, text in rows:
        ids = [*tokenizer.library.encode(text or "", add_special_tokens=False).ids, 0]
        got, at = [], 0
        for p in sorted(by[k], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and zlib.crc32(p.ids) == p.ids_crc32
            part = np.frombuffer(p.ids, "<u4").tolist()
            assert len(part) == p.length
            got += part
            at += p.length
        assert got == ids


def test_repeated_rows_and_empty(documents):
    pieces = P.pack(documents([(1, "hello there")] * 3), PATH).collect()
    assert sum(p.length for p in pieces) == 3 * pieces[0].doc_tokens
    assert P.pack(documents([]), PATH).count() == 0


def test_reruns_agree(documents):
    docs = documents([(i, f"text {i} " * (i % 400)) for i in range(60)])
    a, b = (sorted(map(tuple, P.pack(docs, PATH).collect())) for _ in range(2))
    assert a == b


def test_levels_minimise_squares():
    r = np.random.default_rng(0)
    for _ in range(200):
        w = 16
        p = P.Packer(w)
        p.counts = r.integers(0, 4, w)
        p.counts[0] = 0

        def cost(h, s, p=p, w=w):
            n = p.counts.copy()
            if h:
                n[h] -= 1
            if h + s < w:
                n[h + s] += 1
            return (n**2).sum()

        for s in range(1, w):
            best = min((cost(h, s), -h) for h in range(w - s + 1) if h == 0 or p.counts[h])
            assert p.level(s) == -best[1]


@pytest.mark.parametrize("sizes", [[600] * 100_000, [520 + i % 480 for i in range(30_000)]])
def test_open_windows_are_bounded(sizes):
    """Documents of more than half a window find no partners; windows are emitted all the same, and none is padded."""
    p, most, tokens, emitted = P.Packer(), 0, 0, 0
    ids = np.arange(1100, dtype=np.uint32)
    for i, s in enumerate(sizes):
        p.add(i, ids[:s])
        most = max(most, p.n_open)
        tokens += s
        emitted += sum(len(x[2]) for x in p.out)
        p.out = []
    assert most <= P.MOST_OPEN and p.n_open == p.counts.sum() == sum(map(len, p.open))
    p.finish()
    fill = defaultdict(int)
    for x in p.out:
        fill[x[3]] += len(x[2])
    assert emitted + sum(fill.values()) == tokens and not p.n_open
    assert all(n == p.window or n & (n - 1) == 0 for n in fill.values())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.sampled_from([8, 16, 32]), st.sampled_from([1, 2, 5, 4096]))
def test_packer_places_every_token_once(sizes, window, most_open):
    p = P.Packer(window, most_open)
    for i, s in enumerate(sizes):
        p.add(i, np.arange(s, dtype=np.uint32))
    p.finish()
    docs, fill = defaultdict(list), defaultdict(int)
    for row, start, ids, seq, offset in p.out:
        docs[row].append((start, ids.tolist()))
        fill[seq] += len(ids)
    for i, s in enumerate(sizes):
        assert sum((x for _, x in sorted(docs[i])), []) == list(range(s))
    assert all(n == window or n & (n - 1) == 0 for n in fill.values())


def test_open_windows_keep_only_their_ids():
    """The tail of a long document doesn't keep the rest of it in memory."""
    p = P.Packer()
    for i in range(50):
        p.add(i, np.arange(100_600 + i, dtype=np.uint32))
        p.out = []
    held = [ids for level in p.open for w in level for _, _, ids in w]
    assert sum((x if x.base is None else x.base).nbytes for x in held) <= 50 * 4 * P.WINDOW


def test_output_batches_are_bounded(documents, tokenizer, monkeypatch):
    """What a task hands on at once is bounded by its bytes: whole windows are 4096 bytes of ids each."""
    import pyarrow as pa
    import pyspark

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 3)  # noqa: N815

    made = {}
    monkeypatch.setattr(P.C, "map_arrow", lambda df, run, schema: made.setdefault("run", run))
    monkeypatch.setattr(pyspark, "TaskContext", Task)
    P.pack(documents([(1, "")]), PATH)
    texts = [f"document {i} " * 8000 for i in range(120)]
    rows = pa.record_batch({"doc_id": pa.array(range(120), pa.int64()), "text": pa.array(texts)})
    sizes, ids = [], {}
    for b in made["run"]([rows]):
        sizes.append(b.nbytes)
        for r in b.to_pylist():
            ids.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    assert len(sizes) > 1 and max(sizes) <= 1.1 * (1 << 21)
    for i in (0, 7, 119):
        assert b"".join(x for _, x in sorted(ids[i])) == np.append(tokenizer.ids(texts[i]), 0).astype("<u4").tobytes()
