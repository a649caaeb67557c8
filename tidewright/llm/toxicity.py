"""Toxicity: a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

A document's features are the character n-grams (of its UTF-8 bytes, A-Z in lower
case, white space as one blank each) that occur in it at all, 3 to 8 bytes long. Each selected n-gram j has the log-count
ratio r_j = log((p_j / |p|) / (q_j / |q|)) of its smoothed document counts in the two classes; a logistic
regression is fitted on the features scaled by r_j. Scoring is one pass over the bytes of every whole text:
rolling hashes, a bit per bucket to reject nearly all positions, then an exact look-up of the 64-bit hash.
No text is shuffled.

Defined results: null and empty texts score the model's intercept; a null doc_id counts as held out; repeated
rows score alike; extra columns are not read. With no labelled row, or one class only, every score is the
share of label 1 among the training rows (0.0 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import _common as C

ORDERS = (3, 4, 5, 6, 7, 8)
BUCKET_BITS = 22
_K = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE = C.random_u64(256, 17)
_LOWER = C.ascii_lower_table()
_LOWER[9:14] = 32


@dataclass
class ToxicityModel:
    """Sorted n-gram hashes, the weight of each (coefficient times log-count ratio), and the intercept."""

    keys: np.ndarray
    weights: np.ndarray
    intercept: float


def _ngrams(buf: np.ndarray):
    """Yields (n, hash of the n bytes at each position)."""
    v = _BYTE[buf]
    h = v
    for n in range(2, max(ORDERS) + 1):
        if len(h) < 2:
            return
        h = h[:-1] * _K + v[n - 1 :]
        if n in ORDERS:
            yield n, h


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKET_BITS)


def _framed(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents in lower case, a blank on either side of each and a zero byte between; and where each begins."""
    n = len(offsets) - 1
    lens = np.diff(offsets)
    out = np.full(len(buf) + 3 * n, 32, np.uint8)
    starts = offsets[:-1] - offsets[0] + 3 * np.arange(n)
    out[np.arange(len(buf)) + np.repeat(3 * np.arange(n) + 1, lens)] = _LOWER[buf]
    out[starts + lens + 2] = 0
    return out, starts


def _doc_hashes(text: str) -> np.ndarray:
    buf, _ = _framed(b := np.frombuffer(text.encode("utf-8", "replace"), np.uint8), np.array([0, len(b)]))
    parts = [h for _, h in _ngrams(buf[:-1])]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", rows_per_class: tuple[int, int] = (4000, 2000), max_chars: int = 20_000, n_features: int = 4096, l2: float = 0.03) -> ToxicityModel:
    """Fits on the driver, on a bounded sample of the labelled rows (key, label) that are not held out.

    rows_per_class: the most rows of label 0 and of label 1. Those with the smallest hashes of their key are taken among the texts of
    max_chars at most; only if a class has too few of them, longer ones follow, and of these a stretch of max_chars is read. Null and
    empty texts teach nothing. Rows are chosen by key and length alone, and only the sample's texts are gathered. Scoring has no
    such bounds. A key with both labels counts as 1.
    """
    classes = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~C.held_out(key)).groupBy(key).agg(F.max(label).alias("_label"))
    row = C.fresh(docs, "_row")
    docs = C.with_row(docs.select(key, text), row)
    length = F.length(F.col(text))
    usable = docs.filter(length > 0).select(key, row, (length > max_chars).alias("_long")).join(classes, key)
    rank = ["_long", F.xxhash64(F.col(key).cast("string")), key, row]
    parts = [usable.filter(F.col("_label") == value).orderBy(*rank).limit(most) for value, most in enumerate(rows_per_class)]
    sample = C.as_table(parts[0].unionByName(parts[1]).select(row, "_label"), "sample")
    at = 1 + F.pmod(F.xxhash64(F.col(key).cast("string")), F.greatest(length - max_chars + 1, F.lit(1)))
    texts = docs.join(F.broadcast(sample), row).select(F.xxhash64(F.col(key).cast("string")).alias("h"), "_label", F.substring(text, at, F.lit(max_chars)).alias("t"))  # sum(rows_per_class) rows
    found = sorted((r["h"], int(r["_label"]), r["t"]) for r in texts.collect())
    return fit_local([t for *_, t in found], np.array([y for _, y, _ in found], np.int8), n_features=n_features, l2=l2)


def fit_local(texts: list[str], y: np.ndarray, *, n_features: int = 4096, l2: float = 0.03, least: int = 3) -> ToxicityModel:
    none = np.zeros(0)
    if len(texts) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(texts) else 0.0
        return ToxicityModel(none.astype(np.uint64), none.astype(np.float32), float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20)))
    n1, n0 = int(y.sum()), int((y == 0).sum())
    # First pass: document counts by bucket; only buckets that tell the classes apart are looked at again. In blocks, as the driver is small.
    counts = np.zeros((2, 1 << BUCKET_BITS), np.uint16 if len(texts) < 1 << 16 else np.uint32)
    for t, label in zip(texts, y, strict=True):
        counts[label, np.unique(_bucket(_doc_hashes(t)))] += 1
    strength = np.zeros(1 << BUCKET_BITS, np.float32)
    for i in range(0, len(strength), 1 << 17):
        p, q = (counts[c, i : i + (1 << 17)].astype(np.float32) for c in (1, 0))
        strength[i : i + (1 << 17)] = np.where(p + q >= least, _ratio(p, q, n1, n0) ** 2 * (p + q), 0)
    del counts
    good = strength[strength > 0]
    cut = np.partition(good, -8 * n_features)[-8 * n_features] if len(good) > 8 * n_features else np.float32(0)
    wanted = (strength >= cut) & (strength > 0)
    del strength, good
    docs = [h[wanted[_bucket(h)]] for h in map(_doc_hashes, texts)]
    keys, at = np.unique(np.concatenate(docs), return_inverse=True)
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    p = np.bincount(at, weights=y[row], minlength=len(keys))
    q = np.bincount(at, minlength=len(keys)) - p
    r = _ratio(p, q, n1, n0)
    strength = np.where(p + q >= least, r**2 * (p + q), 0)
    keep = np.sort(np.argsort(strength, kind="stable")[-n_features:])
    keep = keep[strength[keep] > 0]
    if not len(keep):
        return ToxicityModel(none.astype(np.uint64), none.astype(np.float32), float(np.log(n1 / n0)))
    new = np.full(len(keys), -1)
    new[keep] = np.arange(len(keep))
    used = new[at] >= 0
    w, b = _logistic(row[used], new[at][used], r[keep], y.astype(float), l2)
    return ToxicityModel(keys[keep], (w * r[keep]).astype(np.float32), b)


def _ratio(p, q, n1: int, n0: int) -> np.ndarray:
    return np.log((p + 0.5) / (n1 + 1)) - np.log((q + 0.5) / (n0 + 1))


def _logistic(row, col, scale, y, l2: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Full-batch Nesterov descent; each class weighs the same in total."""
    n, k = len(y), len(scale)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    x = scale[col]
    w, b = np.zeros(k), 0.0
    vw, vb = np.zeros(k), 0.0
    # the step follows a bound of the curvature, by power iteration
    u = np.ones(k) / np.sqrt(k)
    for _ in range(8):
        z = np.bincount(row, weights=x * u[col], minlength=n)
        u2 = np.bincount(col, weights=x * (weight * z)[row], minlength=k)
        top = float(np.linalg.norm(u2)) or 1.0
        u = u2 / top
    rate = 1.0 / (0.25 * top + l2 / 100 + 0.25)
    for t in range(steps):
        m = t / (t + 3)
        lw, lb = w + m * vw, b + m * vb
        z = np.bincount(row, weights=x * lw[col], minlength=n) + lb
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        gw = np.bincount(col, weights=x * g[row], minlength=k) + l2 / 100 * lw
        nw, nb = lw - rate * gw, lb - rate * g.sum()
        vw, vb, w, b = nw - w, nb - b, nw, nb
    return w, float(b)


def score_bytes(model: ToxicityModel, bits: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Scores of the documents whose bytes lie at offsets; bits: a flag for each bucket that holds a key."""
    n = len(offsets) - 1
    z = np.full(n, model.intercept)
    for i, j in C.chunks(offsets):
        framed, starts = _framed(buf[offsets[i] : offsets[j]], offsets[i : j + 1])
        docs, found = [], []
        for _, h in _ngrams(framed):
            at = np.flatnonzero(bits[_bucket(h)])
            if len(at):
                k = np.searchsorted(model.keys, h[at])
                k[k == len(model.keys)] = 0
                hit = model.keys[k] == h[at]
                docs.append(np.searchsorted(starts, at[hit], "right") - 1)
                found.append(k[hit])
        if docs:
            pairs = np.unique(np.concatenate(docs) * np.int64(len(model.keys)) + np.concatenate(found))
            z[i:j] += np.bincount(pairs // len(model.keys), weights=model.weights[pairs % len(model.keys)], minlength=j - i)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for each whole text; a column that is named so already is replaced. One pass, no shuffle."""
    from pyspark.sql import types as T

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # n_features keys of 12 bytes
    kept = [c for c in docs.columns if c != out]
    docs = docs.select(*kept)

    def run(batches):
        m = shared.value
        bits = np.zeros(1 << BUCKET_BITS, bool)
        bits[_bucket(m.keys)] = True
        for b in batches:
            s = score_bytes(m, bits, *C.utf8(b.column(text)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, out])

    return C.map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
