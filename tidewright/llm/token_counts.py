"""Token counts: a map-side two-tier look-up of pre-token lengths.

Tier one is a compact table of the lengths of frequent pre-tokens, built from a bounded sample of rows and broadcast.
Tier two is each worker's own cache: a pre-token that tier one lacks is encoded once by the library and kept. No
pre-token is ever shuffled, and the sample only decides how often the library is called, never a count.

A word, what stands between ASCII white space, is cut into pre-tokens here if each of its characters is one that this module's
lower-casing and pattern surely treat as the library does. Any other word (quotes, dashes, other scripts, special strings) is
encoded by the library as a whole and kept in the same cache: neither composition nor lower case nor a pre-token reaches
across ASCII white space, so a text has as many tokens as its words.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated rows; extra columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import _common as C

#: The pre-token pattern of the vocabulary file.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters for which lower case, composition and pattern classes are beyond doubt: printable ASCII, its white
#: space, and the letters of Latin-1 and Latin Extended-A but for dotted capital I.
UNSURE = r"[^\t-\r -~À-ÖØ-öø-įı-ňŊ-ž]"
#: Entries of a worker's cache; it is emptied beyond that.
CACHE_ENTRIES = 400_000
#: Longer pre-tokens are encoded without being kept.
LONGEST_KEPT = 64


class Lengths(dict):
    """pre-token -> number of ids; what is missing is encoded by the library."""

    def __init__(self, frequent: dict[str, int], tokenizer):
        super().__init__(frequent)
        self.frequent, self.tokenizer = frequent, tokenizer

    def __missing__(self, key: str) -> int:
        n = len(self.tokenizer.encode(key, add_special_tokens=False).ids)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
                self.update(self.frequent)
            self[key] = n
        return n


def load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Counter:
    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        import regex

        self.tokenizer = load(path)
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unsure = regex.compile(UNSURE + "".join("|" + regex.escape(s) for s in specials))
        self.cut = regex.compile(PRE_TOKEN).findall
        self.words = regex.compile(r"[^\t-\r ]+").findall
        self.lengths = Lengths(frequent or {}, self.tokenizer)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.unsure.search(text):
            return sum(map(self.lengths.__getitem__, self.cut(text.lower())))
        sure, total = [], 0
        for word in self.words(text):
            if self.unsure.search(word):
                total += self.lengths[word]
            else:
                sure.append(word)
        return total + sum(map(self.lengths.__getitem__, self.cut(" ".join(sure).lower())))

    def pre_tokens(self, text: str) -> list[str]:
        """What count() looks up."""
        words = self.words(text)
        doubtful = [w for w in words if self.unsure.search(w)] if self.unsure.search(text) else []
        if not doubtful:
            return self.cut(text.lower())
        return doubtful + self.cut(" ".join(w for w in words if not self.unsure.search(w)).lower())


def frequent_lengths(docs: DataFrame, path: str, text: str = "text", *, key: str = "doc_id", sample_rows: int = 2000, max_chars: int = 20_000, entries: int = 1 << 16) -> tuple[str, np.ndarray]:
    """Tier one: at most `entries` pre-tokens joined by line ends, and their lengths.

    It comes from about sample_rows rows, chosen by a hash of the key and of at most max_chars characters.
    """
    from collections import Counter as Tally

    n = docs.count()
    share = min(1.0, 1.5 * sample_rows / max(n, 1))
    some = docs.filter((F.length(text) <= max_chars) & (F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1_000_003)) < share * 1_000_003))
    counter, tally = Counter(path), Tally()
    for row in some.select(text).limit(sample_rows).toLocalIterator():
        tally.update(counter.pre_tokens(row[0]))
    keys = sorted(k for k, _ in tally.most_common(entries) if len(k) <= LONGEST_KEPT)
    return "\n".join(keys), np.array([counter.lengths[k] for k in keys], np.uint16)


def count_tokens(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", limit: int = 2048, tier_one: tuple[str, np.ndarray] | None = None) -> DataFrame:
    """key, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text, in one pass without a shuffle."""
    from pyspark.sql import types as T

    tier_one = tier_one if tier_one is not None else frequent_lengths(docs, path, text, key=key)
    shared = docs.sparkSession.sparkContext.broadcast(tier_one)

    def run(batches):
        cache = C.worker_cache()
        if ("counter", path) not in cache:
            keys, lengths = shared.value
            cache["counter", path] = Counter(path, dict(zip(keys.split("\n"), lengths.tolist(), strict=True)) if keys else {})
        count = cache["counter", path].count
        for b in batches:
            col = b.column(text)
            n = np.fromiter((count(x) for x in col.to_pylist()), np.int64, len(col))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(np.diff(C.utf8(col)[1])), pa.array(n), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(key, text)
    fields = [source.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return C.map_arrow(source, run, T.StructType(fields))
