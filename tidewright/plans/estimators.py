"""Regressors that fit one series' training matrix in NumPy, for grouped pandas: boosted trees, forests, single trees, and any
object with fit(x, y) and predict(x).

Trees are grown node by node on features that are cut into at most 256 bins at their quantiles, so a split costs one pass over
a histogram, and memory is a byte for each value. `exact` cuts between all values instead.
"""

from __future__ import annotations

import copy
import inspect

import numpy as np
from pyspark import cloudpickle

#: Names that RecursiveForecaster takes, with the parameters of pyspark.ml's models of that kind, which fit global ones.
NAMED = ("gbt", "forest", "tree")
BINS = 256


def _binned(x: np.ndarray, bins: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """x (rows x features) as bin numbers, and each feature's cuts; a value belongs to the bin of the cuts below it."""
    cuts = []
    out = np.empty(x.shape, np.uint8 if bins <= BINS else np.int32)
    for j in range(x.shape[1]):
        edges = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) > bins else np.unique(x[:, j])
        middle = (edges[1:] + edges[:-1]) / 2 if len(x) <= bins else edges
        cuts.append(middle)
        out[:, j] = np.searchsorted(middle, x[:, j], "left")
    return out, cuts


def grow(codes: np.ndarray, cuts: list[np.ndarray], y: np.ndarray, w: np.ndarray, depth: int, least: int, features: np.ndarray | None = None) -> tuple[dict, np.ndarray]:
    """A regression tree as arrays (feature -1: a leaf), and the gain of each feature. Splits minimise the weighted squared error."""
    out = {k: [] for k in ("feature", "cut", "left", "right", "value")}
    gains = np.zeros(codes.shape[1])
    features = np.arange(codes.shape[1]) if features is None else features

    def node(rows: np.ndarray, level: int) -> int:
        i = len(out["feature"])
        total, weight = float((w[rows] * y[rows]).sum()), float(w[rows].sum())
        for k, v in (("feature", -1), ("cut", 0.0), ("left", 0), ("right", 0), ("value", total / weight if weight else 0.0)):
            out[k].append(v)
        if level >= depth or len(rows) < 2 * least or weight <= 0:
            return i
        best = (1e-12, -1, 0)
        for j in features:
            c, n = codes[rows, j], len(cuts[j]) + 1
            if n < 2:
                continue
            count = np.cumsum(np.bincount(c, minlength=n))[:-1]
            ws = np.cumsum(np.bincount(c, w[rows], n))[:-1]
            ys = np.cumsum(np.bincount(c, w[rows] * y[rows], n))[:-1]
            rest = weight - ws
            fits = (count >= least) & (len(rows) - count >= least) & (ws > 0) & (rest > 0)
            if not fits.any():
                continue
            gain = np.where(fits, ys**2 / np.where(ws > 0, ws, 1) + (total - ys) ** 2 / np.where(rest > 0, rest, 1) - total**2 / weight, -1.0)
            k = int(gain.argmax())
            if gain[k] > best[0] * (1 + 1e-12):
                best = (float(gain[k]), int(j), k)
        gain, j, k = best
        if j < 0:
            return i
        gains[j] += gain
        go = codes[rows, j] <= k
        out["feature"][i], out["cut"][i] = j, float(cuts[j][k])
        out["left"][i] = node(rows[go], level + 1)
        out["right"][i] = node(rows[~go], level + 1)
        return i

    node(np.arange(len(y)), 0)
    return out, gains


def walk(tree: dict, x: np.ndarray) -> np.ndarray:
    """The tree's values for x (features x lanes)."""
    f, cut, left, right, value = (np.asarray(tree[k]) for k in ("feature", "cut", "left", "right", "value"))
    at = np.zeros(x.shape[1], int)
    lanes = np.arange(x.shape[1])
    while True:
        inner = f[at] >= 0
        if not inner.any():
            return value[at]
        go = x[np.maximum(f[at], 0), lanes] <= cut[at]
        at = np.where(inner, np.where(go, left[at], right[at]), at)


class NamedTrees:
    """'gbt', 'forest' or 'tree' with the parameters maxDepth, maxIter, stepSize, numTrees, minInstancesPerNode, subsamplingRate, maxBins, exact."""

    def __init__(self, kind: str, seed: int = 123, maxDepth: int = 5, maxIter: int = 20, stepSize: float = 0.1, numTrees: int = 20, minInstancesPerNode: int = 1, subsamplingRate: float = 1.0, maxBins: int = BINS, exact: bool = False):
        if not 2 <= maxBins <= BINS:
            raise ValueError(f"maxBins must lie in [2, {BINS}]")
        self.kind, self.seed, self.depth, self.rounds, self.rate, self.n_trees = kind, seed, maxDepth, maxIter, stepSize, numTrees
        self.least, self.share, self.bins = minInstancesPerNode, subsamplingRate, maxBins if not exact else np.iinfo(np.int32).max

    def fit(self, x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray | None = None) -> NamedTrees:
        x, y = np.asarray(x, float), np.asarray(y, float)
        w = np.ones(len(y)) if sample_weight is None else np.asarray(sample_weight, float)
        codes, cuts = _binned(x, self.bins)
        r, n, k = np.random.default_rng(self.seed), len(y), x.shape[1]
        self.trees, self.weights, self.importances = [], [], np.zeros(k)
        self.base = float(np.average(y, weights=w)) if self.kind == "gbt" and w.sum() else 0.0
        residual = y - self.base
        for _ in range({"gbt": self.rounds, "forest": self.n_trees, "tree": 1}[self.kind]):
            features, weight = None, w
            if self.kind == "forest":
                features = np.sort(r.choice(k, max(1, -(-k // 3)), replace=False))
                weight = w * r.poisson(self.share, n)
            elif self.share < 1:
                weight = w * (r.random(n) < self.share)
            tree, gains = grow(codes, cuts, residual if self.kind == "gbt" else y, weight, self.depth, self.least, features)
            self.importances += gains
            self.trees.append(tree)
            if self.kind == "gbt":
                residual = residual - self.rate * walk(tree, x.T)
        if self.importances.sum():
            self.importances /= self.importances.sum()
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float).T
        total = sum((walk(t, x) for t in self.trees), np.zeros(x.shape[1]))
        return self.base + self.rate * total if self.kind == "gbt" else total / max(len(self.trees), 1)

    @property
    def feature_importances_(self) -> np.ndarray:
        return self.importances


def check(estimator) -> None:
    """A name of this module, 'linear', or an object with fit and predict."""
    if isinstance(estimator, str):
        if estimator not in ("linear", *NAMED):
            raise ValueError(f"estimator must be 'linear', one of {NAMED}, or an object with fit and predict")
    elif not (callable(getattr(estimator, "fit", None)) and callable(getattr(estimator, "predict", None))):
        raise ValueError("an estimator must have fit and predict")


def fitted(estimator, params: dict, seed: int, x: np.ndarray, y: np.ndarray, w: np.ndarray | None, **more) -> bytes:
    """The estimator fitted on one matrix, pickled. An object is copied, so fits do not share state; weights and further
    arguments go only to a fit that takes them."""
    model = NamedTrees(estimator, seed, **params) if isinstance(estimator, str) else copy.deepcopy(estimator)
    if not isinstance(estimator, str) and params:
        model.set_params(**params) if hasattr(model, "set_params") else vars(model).update(params)
    if w is not None:
        taken = inspect.signature(model.fit).parameters
        if "sample_weight" not in taken and not any(p.kind is p.VAR_KEYWORD for p in taken.values()):
            raise ValueError("the estimator's fit takes no sample_weight")
        more["sample_weight"] = w
    model.fit(x, y, **more)
    return cloudpickle.dumps(model)  # by value where the class is not a module of the executors


def importances(model) -> list[float] | None:
    found = getattr(model, "feature_importances_", None)
    found = getattr(model, "coef_", None) if found is None else found
    return None if found is None else np.ravel(found).astype(float).tolist()
