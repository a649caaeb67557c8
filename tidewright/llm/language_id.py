"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by back-propagation through time.

The network reads a text's UTF-8 bytes in segments of a fixed length, forwards and backwards, and labels every
position with a probability for each language; a document's probabilities are the mean over all its positions.
Training is on the driver, on a bounded sample; labelling is one pass over every whole text without a shuffle.

Defined results: null texts and texts without a letter get `und` and score 0, and so does every text if there was
nothing to learn from; repeated rows get equal results; an empty table gives no row; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm import _common as C

#: Bytes of a segment, and segments that run through the network at once.
SEGMENT, LANES = 128, 2048
UNKNOWN = "und"


@dataclass
class Network:
    """For each direction: `x` (3 hidden x 256, the input's share of the gates for each byte), `u` (3 hidden x hidden),
    `b` (hidden, of the candidate's recurrent part); `out` (languages x 2 hidden) and `bias`. Gates: reset, update, candidate."""

    languages: list[str]
    hidden: int
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, languages: list[str], hidden: int, seed: int) -> Network:
        r = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w["x" + d] = r.normal(0, 0.3, (3 * hidden, 256))
            w["u" + d] = r.normal(0, hidden**-0.5, (3 * hidden, hidden))
            w["b" + d] = np.zeros((hidden, 1))
            w["x" + d][hidden : 2 * hidden] += 1.0  # remember at first
        w["out"] = r.normal(0, (2 * hidden) ** -0.5, (len(languages), 2 * hidden))
        w["bias"] = np.zeros((len(languages), 1))
        return cls(languages, hidden, {k: v.astype(np.float32) for k, v in w.items()})

    # columns are segments, rows are units, so that each gate is one contiguous block

    def direction(self, seg: np.ndarray, d: str, keep: bool = False, lengths: np.ndarray | None = None):
        """States (time x hidden x lanes) for bytes seg (time x lanes); with keep, the gates too. lengths: where segments end, if
        some are shorter; the way back starts there, so what fills them up has no part in it."""
        n, w = self.hidden, self.weights
        x, u, b = w["x" + d], w["u" + d], w["b" + d]
        steps, lanes = seg.shape
        states = np.empty((steps, n, lanes), np.float32)
        gates = np.empty((steps, 4 * n, lanes), np.float32) if keep else None
        h = np.zeros((n, lanes), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = x[:, seg[t]]
            uh = u @ h
            rz = g[: 2 * n]
            rz += uh[: 2 * n]
            rz *= 0.5
            np.tanh(rz, out=rz)
            rz += 1
            rz *= 0.5
            cand = uh[2 * n :]
            cand += b
            if keep:
                gates[t, 3 * n :] = cand
            cand *= rz[:n]
            cand += g[2 * n :]
            np.tanh(cand, out=cand)
            if keep:
                gates[t, : 2 * n] = rz
                gates[t, 2 * n : 3 * n] = cand
            new = states[t]
            np.subtract(h, cand, out=new)
            new *= rz[n:]
            new += cand
            if lengths is not None and d == "b":
                new *= t < lengths
            h = new
        return (states, gates) if keep else states

    def positions(self, seg: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
        """Probabilities (time x languages x lanes); those beyond a segment's length mean nothing."""
        n, w = self.hidden, self.weights
        z = w["out"][:, :n] @ self.direction(seg, "f")
        z += w["out"][:, n:] @ self.direction(seg, "b", lengths=lengths)
        z += w["bias"]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def gradients(self, seg: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients over the positions before each segment's length."""
        n, w = self.hidden, self.weights
        steps, lanes = seg.shape
        runs = {d: self.direction(seg, d, keep=True, lengths=lengths) for d in "fb"}
        z = w["out"][:, :n] @ runs["f"][0] + w["out"][:, n:] @ runs["b"][0] + w["bias"]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        valid = (np.arange(steps)[:, None] < lengths).astype(np.float32) / max(1, lengths.sum())
        chosen = np.take_along_axis(p, np.broadcast_to(y, (steps, 1, lanes)), axis=1)[:, 0]
        loss = float(-(np.log(chosen + 1e-9) * valid).sum())
        dz = p
        np.put_along_axis(dz, np.broadcast_to(y, (steps, 1, lanes)), chosen[:, None] - 1, axis=1)
        dz *= valid[:, None]
        grads = {"bias": dz.sum(axis=(0, 2))[:, None]}
        grads["out"] = np.concatenate([np.einsum("tkl,tnl->kn", dz, runs[d][0], optimize=True) for d in "fb"], axis=1)
        for d, part in (("f", slice(0, n)), ("b", slice(n, 2 * n))):
            states, gates = runs[d]
            u, back = w["u" + d], w["out"][:, part].T @ dz
            gu, gb, gx = np.zeros_like(u), np.zeros((n, 1), np.float32), np.zeros((steps, 3 * n, lanes), np.float32)
            carry = np.zeros((n, lanes), np.float32)
            zero = np.zeros((n, lanes), np.float32)
            order = range(steps) if d == "f" else range(steps - 1, -1, -1)
            for t in reversed(order):
                before = t - 1 if d == "f" else t + 1
                h = states[before] if 0 <= before < steps else zero
                r, up, cand, rec = (gates[t, i * n : (i + 1) * n] for i in range(4))
                dh = (back[t] + carry) * (t < lengths)
                dcand = dh * (1 - up) * (1 - cand * cand)
                dup = dh * (h - cand) * up * (1 - up)
                dr = dcand * rec * r * (1 - r)
                g = gx[t]
                g[:n], g[n : 2 * n], g[2 * n :] = dr, dup, dcand
                du = np.concatenate([dr, dup, dcand * r])
                gu += du @ h.T
                gb += du[2 * n :].sum(axis=1, keepdims=True)
                carry = u.T @ du + dh * up
            grads["u" + d], grads["b" + d] = gu, gb
            flat, byte = gx.transpose(1, 0, 2).reshape(3 * n, -1), seg.ravel()
            grads["x" + d] = np.stack([np.bincount(byte, weights=row, minlength=256) for row in flat]).astype(np.float32)
        return loss, grads


def train(segments: list[bytes], y: np.ndarray, languages: list[str], *, hidden: int = 8, steps: int = 300, lanes: int = 256, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam on random batches of segments of up to SEGMENT bytes, each language equally often."""
    net, r = Network.start(languages, hidden, seed), np.random.default_rng(seed)
    seg = np.zeros((SEGMENT, len(segments)), np.uint8)
    lengths = np.array([min(len(s), SEGMENT) for s in segments])
    for i, s in enumerate(segments):
        seg[: lengths[i], i] = np.frombuffer(s[:SEGMENT], np.uint8)
    pools = [np.flatnonzero(y == k) for k in range(len(languages))]
    m = {k: np.zeros_like(v) for k, v in net.weights.items()}
    v = {k: np.zeros_like(x) for k, x in net.weights.items()}
    for step in range(1, steps + 1):
        pick = np.array([r.choice(pools[k]) for k in r.integers(0, len(languages), lanes)])
        # from a random place on, so that it learns short segments and any beginning
        cut = r.integers(0, SEGMENT // 2)
        most = int(r.integers(24, SEGMENT - cut + 1))
        _, grads = net.gradients(seg[cut : cut + most, pick], np.clip(lengths[pick] - cut, 0, most), y[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        now = rate * min(1.0, 4 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            net.weights[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return net


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_language: int = 700, segments_per_row: int = 4, hidden: int = 8, steps: int = 300, seed: int = 7) -> Network | None:
    """Trains on a bounded sample of the rows that have a language and are not held out.

    At most rows_per_language rows of each language, those with the smallest hashes of their key; of each, however long,
    segments_per_row segments at places that follow from the key, and only these leave Spark. None if no row has a language.
    """
    row = C.fresh(docs, "_row")
    docs = C.with_row(docs.select(key, text, lang), row)
    known = docs.filter(~C.held_out(key) & F.col(lang).isNotNull() & (F.length(text) > 0))
    # Spark keeps no more than this number of each language before the shuffle
    place = F.row_number().over(Window.partitionBy(lang).orderBy(F.xxhash64(F.lit(seed), F.col(key).cast("string")), key, row))
    sample = C.as_table(known.select(row, key, lang, place.alias("_place")).filter(F.col("_place") <= rows_per_language).select(row), "sample")
    room = F.greatest(F.length(text) - SEGMENT + 1, F.lit(1))
    cuts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(segments_per_row)), lambda i: F.pmod(F.xxhash64(F.lit(seed), i, F.col(key).cast("string")), room)))
    parts = F.transform(cuts, lambda at: F.col(text).substr((at + 1).cast("int"), F.lit(SEGMENT)))
    found = sorted((r["lang"], r["h"], list(r["parts"])) for r in docs.join(F.broadcast(sample), row).select(F.col(lang).alias("lang"), F.xxhash64(F.col(key).cast("string")).alias("h"), parts.alias("parts")).collect())
    if not found:
        return None
    languages = sorted({r[0] for r in found})
    of = {k: i for i, k in enumerate(languages)}
    pairs = [(part.encode("utf-8", "replace")[:SEGMENT], of[k]) for k, _, parts in found for part in parts]
    return train([p for p, _ in pairs], np.array([y for _, y in pairs]), languages, hidden=hidden, steps=steps, seed=seed)


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def have_letters(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[buf])])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 1)):
        out[i] = any(c.isalpha() for c in buf[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def label(net: Network, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Pooled probabilities (documents x languages) of whole texts."""
    lens = np.diff(offsets)
    parts = -(-lens // SEGMENT)
    doc = np.repeat(np.arange(len(lens)), parts)
    at = offsets[:-1][doc] + SEGMENT * (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts))
    size = np.minimum(SEGMENT, offsets[1:][doc] - at)
    order = np.argsort(size, kind="stable")
    total = np.zeros((len(lens), len(net.languages)))
    padded = np.concatenate([buf, np.zeros(SEGMENT, np.uint8)])
    for i in range(0, len(order), LANES):
        some = order[i : i + LANES]
        steps = np.arange(size[some[-1]])[:, None]
        inside = steps < size[some]
        seg = np.where(inside, padded[np.minimum(at[some] + steps, len(padded) - 1)], 0).astype(np.uint8)
        full = inside.all()
        p = net.positions(seg, None if full else size[some])
        sums = p.sum(axis=0) if full else (p * inside[:, None]).sum(axis=0)
        np.add.at(total, doc[some], sums.T)
    return total / np.maximum(lens, 1)[:, None]


def predict(docs: DataFrame, net: Network | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score of every row."""
    source = docs.select(key, text)
    schema = T.StructType([source.schema[key], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if net is None:
        return source.select(key, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand weights

    def run(batches):
        net = shared.value
        names = np.array(net.languages, object)
        for b in batches:
            buf, offsets = C.utf8(b.column(text))
            best, score = np.zeros(len(offsets) - 1, int), np.zeros(len(offsets) - 1)
            for i, j in C.chunks(offsets):
                p = label(net, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                best[i:j], score[i:j] = p.argmax(axis=1), p.max(axis=1)
            letters = have_letters(buf, offsets)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(np.where(letters, names[best], UNKNOWN), pa.string()), pa.array(np.where(letters, np.clip(score, 0, 1), 0.0))], names=schema.names)

    return C.map_arrow(source, run, schema)
