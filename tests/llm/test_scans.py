import hashlib
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import _common as C
from tidewright.llm import license_scan as S
from tidewright.llm import media as M
from tidewright.llm import token_counts as T
from tidewright.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


# ---- token counts


@pytest.fixture(scope="module")
def counter():
    return T.Counter(PATH)


_counter = []


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcDE'sIt're 019.,!ÄöéßŁ\t\n<|>", max_size=60)))
def test_counts_are_the_librarys(text):
    if not _counter:
        _counter.append(T.Counter(PATH))
    assert _counter[0].count(text) == len(_counter[0].tokenizer.encode(text, add_special_tokens=False).ids)


TYPOGRAPHIC = ["“It’s” — a – dash… 5 €, naïve café", "Ωμέγα ΣΊΣΥΦΟΣ ς", "Привет, мир! Ёлка", "日本語のテキスト 한국어 中文", "e\u0301a \u0301x a\u0323\u0307", "non\u00a0breaking\u2003space\u200bzero", "a<|endoftext|>b <|startoftext|>", "ǅ İI ﬁ ß ſ K", "x\u0085y\u001cz\x00", "🙂👍🏽 ok", "don’t can't"]


def test_words_of_other_characters(counter):
    """Word by word as the library counts the whole text, however words are joined."""
    for text in [*TYPOGRAPHIC, " ".join(TYPOGRAPHIC), "\t".join(TYPOGRAPHIC), "\n plain words \r\n".join(TYPOGRAPHIC), ("plain and “quoted” words " * 3000)]:
        assert counter.count(text) == len(counter.tokenizer.encode(text, add_special_tokens=False).ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZé’“–€ΣςйЁ日\u0301\u0323\u00a0'.9\x0b", max_size=5), max_size=12), st.sampled_from([" ", "\n", " \t"]))
def test_joined_words(parts, blank):
    if not _counter:
        _counter.append(T.Counter(PATH))
    text = blank.join(parts)
    assert _counter[0].count(text) == len(_counter[0].tokenizer.encode(text, add_special_tokens=False).ids)


def test_most_words_of_typographic_text_need_no_library():
    calls = []
    small = T.Counter(PATH)
    inner = small.lengths.tokenizer

    class Counting:
        def encode(self, *a, **k):
            calls.append(a[0])
            return inner.encode(*a, **k)

    small.lengths.tokenizer = Counting()
    small.count("some plain words and “one” more word — " * 500)
    assert len(calls) == 8  # each distinct pre-token or doubtful word once


def test_count_tokens(documents, counter, odd_texts, clashing, monkeypatch):
    rows = list(enumerate(odd_texts)) + [(50, "It's 12 o'clock; they're late!")]
    docs = documents(rows, clashing)
    want = {k: (len((t or "").encode()), len(counter.tokenizer.encode(t or "", add_special_tokens=False).ids)) for k, t in rows}
    for tier in (None, ("", [])):  # with and without the frequent tier
        got = T.count_tokens(docs, PATH, limit=20, tier_one=tier).collect()
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want
        assert all(r.over_limit == (r.n_tokens > 20) for r in got)
    assert T.count_tokens(documents([]), PATH).count() == 0


def test_cache_is_bounded(counter, monkeypatch):
    monkeypatch.setattr(T, "CACHE_ENTRIES", 5)
    small = T.Counter(PATH, {"the": 1})
    text = " ".join(f"word{chr(97 + i)}" for i in range(20)) + " the " + "z" * 500
    assert small.count(text) == counter.count(text) and len(small.lengths) <= 6


# ---- media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000))
def test_png_round_trip(data):
    payload = M.payload_of(data)
    assert len(payload) % M.WIDTH == 0 and payload.startswith(data) and set(payload[len(data) :]) <= {255}
    png = M.encode_png(payload)
    assert M.decode_png(png) == payload and M.png_size(png[: M.HEADER]) == (M.WIDTH, len(payload) // M.WIDTH, 8)


def test_bad_headers():
    for data in (b"", b"x" * 40):
        with pytest.raises(ValueError):
            M.png_size(data)


def test_shards(documents, spark, odd_texts, clashing):
    import tarfile

    rows = list(enumerate(odd_texts)) + [(90, "same text here again and again"), (90, "same text here again and again")]
    folder = C.scratch_path(spark, "media")
    catalogue = C.as_table(M.store(documents(rows, clashing), folder), "catalogue")
    objects = M.objects(catalogue)
    distinct = {M.payload_of((t or "").encode()) for _, t in rows}
    assert catalogue.count() == len(rows) and objects.count() == len(distinct)
    heads = M.fill_metadata(objects, folder)
    assert heads.filter(f"width = {M.WIDTH} and bits = 8").count() == len(distinct)
    got = {r.payload_sha256: r for r in M.features(heads, folder).collect()}
    assert set(got) == {hashlib.sha256(p).hexdigest() for p in distinct}
    for p in distinct:
        r = got[hashlib.sha256(p).hexdigest()]
        assert bytes(r.digest).hex() == r.payload_sha256 and r.tail_crc32 == zlib.crc32(p[-32:]) and r.payload_bytes == len(p) == r.height * M.WIDTH
        assert r.n_bytes == len(p.rstrip(b"\xff")) and r.media_bytes == len(M.encode_png(p)) and r.media_sha256 == hashlib.sha256(M.encode_png(p)).hexdigest()
    shard = objects.first()
    with tarfile.open(f"{folder.removeprefix('file://')}/{shard['shard']}") as tar:
        member = tar.getmember(f"{bytes(shard['digest']).hex()}.png")
        assert member.offset_data == shard["offset"] and member.size == shard["length"]
    assert M.store(documents([]), C.scratch_path(spark, "media")).count() == 0


# ---- licences


CASES = [
    ("Some text. Released under the MIT License. More.", "MIT", 0),
    ("licensed under the Apache  Licence, Version 2.0.\nYou may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://x", "Apache-2.0", 0),
    ("You may not use this file except in compliance with the License.", "", 1),
    ("This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0.", "GPL-3.0,CC-BY-NC-4.0", 0),
    ("Released under the MIT License!\n\nRELEASED UNDER THE MIT LICENSE", "MIT", 0),
    ("the mit license is not released under", "", 0),
    ("All rights reserved.", "", 1),
    ("Released under\n CC-BY  4.0.", "", 0),
    ("Released under CC-BY  4.0.", "CC-BY-4.0", 0),
    ("all  RIGHTS\treserved", "", 1),
    (None, "", 0),
    ("", "", 0),
]


def test_licences(documents, odd_texts, clashing):
    docs = documents([(i, c[0]) for i, c in enumerate(CASES)] + [(100 + i, t) for i, t in enumerate(odd_texts)], clashing)
    got = {r.doc_id: r for r in S.scan(docs).collect()}
    for i, (_, licences, unknown) in enumerate(CASES):
        assert (",".join(got[i].licenses), got[i].n_unknown) == (licences, unknown)
    assert all(not got[100 + i].licenses for i in range(len(odd_texts)))
    assert S.scan(documents([])).count() == 0


def test_longer_rules_come_first(documents):
    full = ". ".join(s[0] for k, s in S.SENTENCES.items() if k in ("mit-grant", "notice-kept", "as-is"))
    got = S.scan(documents([(1, full + "."), (2, full.split(". ")[1] + ". " + full.split(". ")[0] + ".")])).collect()
    assert {r.doc_id: (r.licenses, r.n_unknown) for r in got} == {1: (["MIT"], 0), 2: ([], 2)}


def test_cues_cover_all_sentences():
    assert [s for sentences in S.SENTENCES.values() for s in sentences if not re.search(S.CUES, s)] == []
    assert {x for _, parts in S.RULES for x in parts} <= set(S.SENTENCES)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
WRAPPED = [(MIT, "MIT"), (BSD, "BSD-2-Clause"), (BSD + BSD3, "BSD-3-Clause"), (ISC, "ISC"), (APACHE, "Apache-2.0"), ("This is free and unencumbered software released\ninto the public domain.", "Unlicense")]


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_notices(documents, mark):
    got = S.scan(documents([(i, "\n".join(mark + x for x in t.split("\n"))) for i, (t, _) in enumerate(WRAPPED)])).collect()
    assert {r.doc_id: (r.licenses, r.n_unknown) for r in got} == {i: ([name], 0) for i, (_, name) in enumerate(WRAPPED)}


GPL = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version."""
GPL_END = """

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
CUT = [
    *((GPL.format(";" if v < 3 else ":", ";" if v < 3 else ",", v) + end, f"GPL-{v}.0-or-later", 0) for v in (1, 2, 3) for end in ("", GPL_END)),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0", 0),
    ("// SPDX-License-Identifier: MIT\nint x;", "MIT", 0),
    ("/* SPDX-License-Identifier: Apache-2.0 */", "Apache-2.0", 0),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "", 0),
    ("SPDX-License-Identifier:\nMIT", "", 0),
    ("So this program is free software: you can redistribute it or not.", "", 0),
]


def test_sentences_that_hold_a_mark(documents):
    for flat in (False, True):
        got = {r.doc_id: r for r in S.scan(documents([(i, " ".join(t.split("\n")) if flat else t) for i, (t, *_) in enumerate(CUT[:-5] if flat else CUT)])).collect()}
        assert [(",".join(got[i].licenses), got[i].n_unknown) for i in range(len(got))] == [x[1:] for x in CUT[: len(got)]]
