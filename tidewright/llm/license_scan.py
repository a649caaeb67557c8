"""License scans: sentences first, then rules over their order.

A text is cut into sentences, each sentence is normalised (A-Z in lower case, runs of all but letters, digits and `+`
become one blank, `licence` becomes `license`), and a table maps known licence sentences to identifiers. The identifiers in
reading order are then matched against ordered rules: a rule names a licence and the identifiers that must follow each other,
and what a rule matches is taken out before the next rule is tried. Identifiers that no rule takes are reported as
`unknown`, so that a half-quoted licence is seen.

The work is DataFrame functions alone, in one pass without a shuffle; the tables have fixed sizes.

Defined results: null and empty texts have no sentence and no licence; repeated rows get equal results; an empty table
gives no row; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, normalised, by identifier. Versions are filled in by rule below.
SENTENCES = {
    "mit-named": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "this software is licensed under the mit license", "spdx license identifier mit", "distributed under the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "notice-kept": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "apache-2-named": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "released under the apache license version 2 0", "spdx license identifier apache 2 0"],
    "apache-only-in-compliance": ["you may not use this file except in compliance with the license"],
    "apache-obtain": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"],
    "apache-as-is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-no-endorsement": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-named": ["released under the bsd license", "licensed under the bsd license"],
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "gpl-without-warranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-see": ["see the gnu general public license for more details"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl-2-subject": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "unlicense-free": ["this is free and unencumbered software released into the public domain"],
    "all-rights-reserved": ["all rights reserved"],
}
for _v in ("1", "2", "3"):
    for _kind, _name in (("gpl", "gnu general public license"), ("lgpl", "gnu lesser general public license"), ("agpl", "gnu affero general public license")):
        SENTENCES[f"{_kind}-{_v}-named"] = [f"{_lead} under the {_name} version {_v}{_zero}" for _lead in ("this work is licensed", "licensed", "released", "this program is licensed") for _zero in ("", " 0")]
    SENTENCES[f"gpl-{_v}-or-later"] = [f"either version {_v} of the license or at your option any later version"]
for _kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
    for _v in ("2 0", "3 0", "4 0"):
        SENTENCES[f"cc-{_kind}-{_v.replace(' ', '.')}-named"] = [f"{_lead} cc {_kind.replace('-', ' ')} {_v}" for _lead in ("licensed under", "released under", "this work is licensed under")]

# Ordered rules, longer sequences before those that are part of them.
RULES = [
    ("MIT", ["mit-grant", "notice-kept", "as-is"]),
    ("MIT", ["mit-grant", "notice-kept"]),
    ("MIT", ["mit-named"]),
    ("Apache-2.0", ["apache-2-named", "apache-only-in-compliance", "apache-obtain", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["apache-2-named", "apache-only-in-compliance", "apache-obtain"]),
    ("Apache-2.0", ["apache-2-named"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-no-endorsement"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD", ["bsd-named"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl-2-subject"]),
    ("Unlicense", ["unlicense-free"]),
    *((f"GPL-{v}.0-or-later", ["gpl-free", f"gpl-{v}-or-later", "gpl-without-warranty", "gpl-see"]) for v in ("1", "2", "3")),
    *((f"GPL-{v}.0-or-later", ["gpl-free", f"gpl-{v}-or-later"]) for v in ("1", "2", "3")),
    *((f"{kind.upper()}-{v}.0", [f"{kind}-{v}-named"]) for kind in ("gpl", "lgpl", "agpl") for v in ("1", "2", "3")),
    *((f"CC-{kind.upper()}-{v}", [f"cc-{kind}-{v}-named"]) for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for v in ("2.0", "3.0", "4.0")),
]

#: Sentences end at line ends, and at `.`, `!`, `?`, `;` or `:` before a blank. Known sentences cut by them: see `unwrapped`.
SENTENCE_END = r"\n+|[.!?;:]+[ \t\r]+|[.!?;:]+\n+"
NOT_WORD = r"[^a-z0-9+]+"
LICENCE = r"\blicen[cs]e"
#: Every known sentence holds one of these words; texts without any are passed over at once.
CUES = r"licen|permission|copyright|warrant|redistribut|software|reserved|later|\bcc\b"


#: Marks of `unwrapped`: a line end, and another end of a sentence. Line ends and comment marks count as blanks inside a known sentence,
#: but not inside notices of one line (`-named`), which must stand on their line.
LINE, STOP = "|", "~"


def _joins() -> list[tuple[str, str]]:
    """(pattern, replacement) for each known sentence that may be cut, longer ones first."""
    cut = [(s, s, f"[ {LINE}{STOP}]") for ident, sentences in SENTENCES.items() if not ident.endswith("-named") for s in sentences]
    cut += [(s, s, f"[ {STOP}]") for ident, sentences in SENTENCES.items() if ident.endswith("-named") for s in sentences if s.startswith("spdx ")]
    # the notice of GPL 3 has both in one sentence
    cut += [(f"{free} {later}", f"{free}{LINE}{later}", f"[ {LINE}{STOP}]") for free in SENTENCES["gpl-free"] for v in ("1", "2", "3") for later in SENTENCES[f"gpl-{v}-or-later"]]
    cut.sort(key=lambda x: -len(x[0]))
    return [(r"(?<![a-z0-9+ ])" + gap.join(w.replace("+", r"\+") for w in s.split(" ")) + r"(?![a-z0-9+ ])", put) for s, put, gap in cut]


def unwrapped(text: Column) -> Column:
    """The normalised words of a text with LINE or STOP where sentences end; known sentences that these cut are made whole."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    out = F.translate(text, upper + LINE + STOP, lower + "  ")
    for pattern, put in ((r"\n+", LINE), (r"[.!?;:][ \t\r]", STOP), (r"[^a-z0-9+|~]+", " "), (r" ?~[ ~]*", STOP), (r"[~ ]?\|[ |~]*", LINE), (LICENCE, "license")):
        out = F.regexp_replace(out, pattern, put)
    out = F.trim(out)
    for pattern, put in _joins():
        out = F.regexp_replace(out, pattern, put)
    return out


def identifiers(text: str = "text") -> Column:
    """The identifiers of the known sentences of a text, in reading order."""
    known = F.create_map(*(F.lit(x) for ident, sentences in SENTENCES.items() for s in sentences for x in (s, ident)))
    filled = F.coalesce(F.col(text), F.lit(""))
    cue = F.lower(filled).rlike(CUES)
    found = F.transform(F.split(unwrapped(filled), f"[{LINE}{STOP}]"), lambda s: F.try_element_at(known, s))
    return F.when(cue, F.filter(found, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sentences (identifiers in reading order), licenses (by order of the rules), n_unknown (identifiers no rule took)."""
    rows = docs.select(key, identifiers(text).alias("sentences"))
    left = F.concat_ws("", F.transform("sentences", lambda x: F.concat(F.lit("<"), x, F.lit(">"))))
    out = rows.withColumn("_left", left)
    return _matched(out, key)


def _matched(out: DataFrame, key: str) -> DataFrame:
    """The rules, tried only on texts with a known sentence; replaced in one expression for each rule in order."""

    def fold(acc: Column, rule: Column) -> Column:
        return F.struct(
            F.replace(acc["left"], rule["pattern"], F.lit("")).alias("left"),
            F.when(F.contains(acc["left"], rule["pattern"]) & ~F.array_contains(acc["found"], rule["license"]), F.concat(acc["found"], F.array(rule["license"]))).otherwise(acc["found"]).alias("found"),
        )

    rules = F.array(*(F.struct(F.lit(name).alias("license"), F.lit("".join(f"<{x}>" for x in parts)).alias("pattern")) for name, parts in RULES))
    start = F.struct(F.col("_left").alias("left"), F.array().cast("array<string>").alias("found"))
    done = F.when(F.size("sentences") > 0, F.aggregate(rules, start, fold)).otherwise(start)
    out = out.withColumn("_done", done)
    return out.select(key, "sentences", F.col("_done.found").alias("licenses"), F.regexp_count("_done.left", F.lit("<")).cast("long").alias("n_unknown"))


def oracle_sql() -> str:
    """The same for DuckDB, with the lists joined by blanks and commas, as op7's query gives them."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(i)})" for i, sentences in SENTENCES.items() for s in sentences)
    steps, seen = [], {}
    for k, (name, parts) in enumerate(RULES):
        pattern = quote("".join(f"<{x}>" for x in parts))
        new = f"contains(r{k}.l, {pattern})" + "".join(f" AND NOT contains(',' || r{k}.f || ',', {quote(',' + name + ',')})" for _ in [0] if name in seen)
        steps.append(f"r{k + 1} AS (SELECT doc_id, s, replace(l, {pattern}, '') AS l, CASE WHEN {new} THEN f || CASE WHEN f = '' THEN '' ELSE ',' END || {quote(name)} ELSE f END AS f FROM r{k})")
        seen[name] = True
    return f"""
        WITH known(sentence, ident) AS (VALUES {known}),
        cut AS (SELECT doc_id, unnest(range(len(p))) + 1 AS pos, unnest(p) AS sentence
                FROM (SELECT doc_id, regexp_split_to_array(text, '{SENTENCE_END}') AS p FROM documents WHERE text IS NOT NULL)),
        norm AS (SELECT doc_id, pos, regexp_replace(trim(regexp_replace(translate(sentence, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{NOT_WORD}', ' ', 'g')), '\\blicence', 'license', 'g') AS sentence FROM cut),
        found AS (SELECT doc_id, string_agg(ident, ' ' ORDER BY pos) AS s, string_agg('<' || ident || '>', '' ORDER BY pos) AS l FROM norm JOIN known USING (sentence) GROUP BY doc_id),
        r0 AS (SELECT d.doc_id, coalesce(s, '') AS s, coalesce(l, '') AS l, '' AS f FROM documents d LEFT JOIN found USING (doc_id)),
        {", ".join(steps)}
        SELECT doc_id, s AS sentences, f AS licenses, CAST(length(l) - length(replace(l, '<', '')) AS BIGINT) AS n_unknown FROM r{len(RULES)}
    """
