"""Recursive forecasters: a regression on lags, window features and exogenous columns, fed with its own forecasts.

Fitting: features are window expressions; a linear model needs only sums of products, which are ordinary aggregates, so rows
are never gathered. Trees and estimator objects of each series are fitted in grouped pandas, a series in a task; a global model
of trees by pyspark.ml. Forecasting: a linear model on lags runs inside aggregate(), within Catalyst; trees, window features and
bootstraps run over NumPy lanes in grouped pandas, on state of a fixed size for each series.

One class serves a model of each series (`per_series`) and one global model of all of them, with the series as ordinal or
one-hot feature.
"""

from __future__ import annotations

import json
import pickle
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

import tidewright
from tidewright.operators import features as X
from tidewright.operators import validate as V
from tidewright.operators.curate import QuantileBinner, check_weights, look_up_weights
from tidewright.operators.grid import future
from tidewright.plans import estimators as E
from tidewright.plans.naive import RESIDUALS, capped, check_interval, with_interval
from tidewright.session import over_series


#: Series up to which they can have a column each.
MOST_COLUMNS = 1000
#: Maximum-likelihood parameters of distributions, as aggregates; logistic and gumbel_r by their moments.
DISTRIBUTIONS: dict[str, dict[str, Callable[[Column], Column]]] = {
    "norm": {"loc": F.avg, "scale": F.stddev_pop},
    "laplace": {"loc": lambda c: F.percentile(c, F.lit(0.5)), "scale": lambda c: F.avg(F.abs(c - F.col("_median")))},
    "uniform": {"loc": F.min, "scale": lambda c: F.max(c) - F.min(c)},
    "expon": {"loc": F.min, "scale": lambda c: F.avg(c) - F.min(c)},
    "lognorm": {"s": lambda c: F.stddev_pop(F.log(c)), "scale": lambda c: F.exp(F.avg(F.log(c)))},
    "logistic": {"loc": F.avg, "scale": lambda c: F.stddev_pop(c) * (3**0.5 / np.pi)},
    "gumbel_r": {"loc": lambda c: F.avg(c) - np.euler_gamma * 6**0.5 / np.pi * F.stddev_pop(c), "scale": lambda c: F.stddev_pop(c) * (6**0.5 / np.pi)},
}


class NotFitted(ValueError, AttributeError):
    """A forecast was asked for before the fit."""


# ---- estimators -------------------------------------------------------------------------------------------------------


def fit_linear(matrix: DataFrame, names: Sequence[str], by: Sequence[str], weight: str | None = None, ridge: float = 1e-8) -> DataFrame:
    """(by, coef, intercept): least squares of y on names, weighted if asked, by one aggregation of products.

    Columns are centred on each group's means before their products are summed, which keeps the sums accurate.
    """
    by = list(by)
    w = F.col(weight) if weight else F.lit(1.0)
    cols = [*names, "y"]
    mean = lambda c: (F.sum(w * F.col(c)) / F.sum(w)).alias(f"m_{c}")
    means = matrix.groupBy(*by).agg(*(mean(c) for c in cols))
    centred = matrix.join(means, by) if by else matrix.crossJoin(F.broadcast(means))
    c = {n: F.col(n) - F.col(f"m_{n}") for n in cols}
    products = [F.sum(w * c[a] * c[b]) for i, a in enumerate(cols) for b in cols[i:]]
    sums = centred.groupBy(*by).agg(F.array(*products).alias("p"), F.array(*(F.first(f"m_{n}") for n in cols)).alias("m"))
    k = len(names)

    def solve(batches):
        for pdf in batches:
            coef, intercept = [], []
            for p, m in zip(pdf["p"], pdf["m"], strict=True):
                full = np.zeros((k + 1, k + 1))
                full[np.triu_indices(k + 1)] = p
                full += np.triu(full, 1).T
                a, b = full[:k, :k], full[:k, k]
                x = np.linalg.lstsq(a + ridge * np.diag(np.maximum(np.diag(a), 1e-300)), b, rcond=None)[0] if k else np.zeros(0)
                coef.append(x.tolist())
                intercept.append(float(m[k] - x @ np.asarray(m[:k], float)))
            yield pd.DataFrame({**{c: pdf[c] for c in by}, "coef": coef, "intercept": intercept})

    schema = T.StructType([*(matrix.schema[c] for c in by), T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("intercept", T.DoubleType())])
    return sums.mapInPandas(solve, schema)


@dataclass
class Trees:
    """A sum of regression trees as arrays, so that NumPy can walk them on any number of lanes at once."""

    trees: list[dict]
    weights: list[float]
    names: list[str]
    importances: list[float]

    @classmethod
    def of(cls, model, names: Sequence[str]) -> Trees:
        """From a fitted tree, forest or gradient-boosted model of pyspark.ml."""

        def walk(node, out):
            i = len(out["feature"])
            for key in out:
                out[key].append(0)
            if node.numDescendants() == 0:
                out["feature"][i], out["value"][i] = -1, float(node.prediction())
            else:
                out["feature"][i], out["cut"][i] = node.split().featureIndex(), float(node.split().threshold())
                out["left"][i] = walk(node.leftChild(), out)
                out["right"][i] = walk(node.rightChild(), out)
            return i

        found = []
        members = list(model.trees) if hasattr(model, "trees") else [model]
        for t in members:
            out = {k: [] for k in ("feature", "cut", "left", "right", "value")}
            walk(t._java_obj.rootNode(), out)
            found.append(out)
        weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
        if type(model).__name__.startswith("RandomForest"):
            weights = [1 / len(found)] * len(found)
        return cls(found, weights, list(names), list(map(float, model.featureImportances.toArray())))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """x: features x lanes."""
        return sum((w * E.walk(t, x) for t, w in zip(self.trees, self.weights, strict=True)), np.zeros(x.shape[1]))


# ---- the forecaster ---------------------------------------------------------------------------------------------------


@dataclass
class RecursiveForecaster:
    """estimator: 'linear', 'gbt', 'forest', 'tree', or (for a model of each series) any object with fit(x, y) and predict(x).
    per_series: a model for each series; otherwise one for all.

    encoding (global models): 'ordinal', 'onehot' or None. differencing: order of differences taken before, undone after.
    scaled: scale each series before, undo after: True or 'standard', 'minmax', 'maxabs', 'robust', or a features.Affine.
    scaled_exog: the same for each exogenous column over the training rows. fit_kwargs: further arguments of an object's fit.
    """

    lags: int | Sequence[int] | None = 24
    window_features: X.RollingFeatures | None = None
    estimator: object = "linear"
    estimator_params: dict = field(default_factory=dict)
    per_series: bool = True
    encoding: str | None = "ordinal"
    differencing: int = 0
    scaled: bool | str | X.Affine = False
    scaled_exog: bool | str | X.Affine = False
    fit_kwargs: dict = field(default_factory=dict)
    rule: str = "h"
    n_bins: int = 10
    forecaster_id: str | None = None

    def __post_init__(self):
        self.lag_list = X.normalise_lags(self.lags)
        if not self.lag_list and self.window_features is None:
            raise ValueError("lags or window features are needed")
        E.check(self.estimator)
        if not self.per_series and not isinstance(self.estimator, str):
            raise ValueError("an estimator object fits one series; a global model takes a name")
        for how in (self.scaled, self.scaled_exog):
            if how:
                X.scaling(how)
        if self.encoding not in ("ordinal", "onehot", None):
            raise ValueError("encoding must be 'ordinal', 'onehot' or None")
        self.is_fitted = False

    @property
    def window_size(self) -> int:
        return self._reach + self.differencing

    @property
    def _reach(self) -> int:
        return max([0, *self.lag_list, self.window_features.max_size if self.window_features else 0])

    def set_lags(self, lags) -> RecursiveForecaster:
        self.lags = lags
        self.__post_init__()
        return self

    def set_window_features(self, w: X.RollingFeatures | None) -> RecursiveForecaster:
        self.window_features = w
        self.__post_init__()
        return self

    def set_params(self, **params) -> RecursiveForecaster:
        """estimator__x sets a parameter of the estimator, any other name one of the forecaster; fitting must follow."""
        for k, v in params.items():
            if k.startswith("estimator__"):
                self.estimator_params[k.removeprefix("estimator__")] = v
            elif k in self.__dataclass_fields__:
                setattr(self, k, v)
            else:
                raise ValueError(f"{k} is no parameter")
        self.__post_init__()
        return self

    def get_params(self) -> dict:
        return {k: getattr(self, k) for k in self.__dataclass_fields__} | {f"estimator__{k}": v for k, v in self.estimator_params.items()}

    def summary(self) -> dict:
        return {"id": self.forecaster_id, "estimator": self.estimator, "lags": self.lag_list, "window_features": self.window_features.names if self.window_features else [], "window_size": self.window_size, "per_series": self.per_series, "encoding": None if self.per_series else self.encoding, "differencing": self.differencing, "fitted": self.is_fitted, "exog": getattr(self, "exog_names", [])}

    # ---- training matrix

    def _transformed(self, series: DataFrame) -> DataFrame:
        """series with the value that is regressed, as y, and the original as _y. The scale is that of the training."""
        out = series.withColumn("_y", F.col("y"))
        if self.scaled:
            out = X.rescale(out, self._scale, "y", "y")
        if self.differencing:
            out = X.difference(out, self.differencing, "y", "_d").withColumn("y", F.col("_d")).drop("_d")
        return out

    def create_train_matrix(self, series: DataFrame, exog: DataFrame | None = None) -> DataFrame:
        """(series_id, ts, y, features, exog): one row for each time with a full window and all values."""
        if not hasattr(self, "_exog_scale"):  # not fitted yet
            self._learn_scales(series, exog)
        out = self._transformed(series).withColumns(X.lag_columns(self.lag_list))
        names = [f"lag_{i}" for i in self.lag_list]
        if self.window_features:
            out = self.window_features.transform(out)
            names += self.window_features.names
        self.exog_names = []
        if exog is not None:
            self.exog_names = [c for c in exog.columns if c not in ("series_id", "ts")]
            out = out.join(self._exog_values(exog), [c for c in ("series_id", "ts") if c in exog.columns])
        self.feature_names = names + self.exog_names
        return out.dropna(subset=["y", *self.feature_names]).select("series_id", "ts", "y", *self.feature_names)

    def _exog_values(self, exog: DataFrame) -> DataFrame:
        """exog with its columns as numbers, scaled if asked."""
        scale = self._exog_scale if self.scaled_exog else {}
        number = lambda c: F.col(c).cast("double")
        return exog.withColumns({c: (number(c) - F.lit(scale[c][0])) / F.lit(scale[c][1]) if c in scale else number(c) for c in self.exog_names})

    def _learn_scales(self, series: DataFrame, exog: DataFrame | None) -> None:
        """The scale of each series, as a table, and of each exogenous column, two numbers each."""
        self._scale = X.scale(series, "y", "y", self.scaled)[1].persist() if self.scaled else None
        self._exog_scale = {}
        if self.scaled_exog and exog is not None:
            kind, names = X.scaling(self.scaled_exog), [c for c in exog.columns if c not in ("series_id", "ts")]
            rows = exog.join(series.select(*(c for c in ("series_id", "ts") if c in exog.columns)).distinct(), [c for c in ("series_id", "ts") if c in exog.columns], "left_semi")
            found = rows.agg(*(f(F.col(c).cast("double")).alias(f"{k}_{c}") for c in names for k, f in (("a", kind.shift), ("b", kind.spread)))).first()
            self._exog_scale = {c: (found[f"a_{c}"] or 0.0, found[f"b_{c}"] or 1.0) for c in names}

    def _coded(self, df: DataFrame) -> DataFrame:
        """df with _level, the place of its series among those of the training, by name; null for others."""
        return df.join(self._codes, "series_id", "left")

    def _encoded(self, matrix: DataFrame) -> tuple[DataFrame, list[str]]:
        if self.per_series or self.encoding is None:
            return matrix, self.feature_names
        if self.encoding == "ordinal":
            return self._coded(matrix), [*self.feature_names, "_level"]
        if len(self.levels) > MOST_COLUMNS:
            raise ValueError(f"one-hot codes need a column for each of {len(self.levels)} series; use 'ordinal'")
        out = X.onehot_encode(matrix, self.levels)
        return out, [*self.feature_names, *(f"series_id_{s}" for s in self.levels)]

    # ---- fit

    def fit(self, series: DataFrame, exog: DataFrame | None = None, weights: DataFrame | None = None, series_weights: dict[str, float] | None = None, store_residuals: bool = False, seed: int = 123) -> RecursiveForecaster:
        """weights: (ts, weight) or (series_id, ts, weight); a row without one is an error. series_weights multiply them."""
        self._levels, self._trained = None, series.select("series_id").distinct()
        # a row for each series; one task ranks their names
        self._codes = self._trained.select("series_id", (F.row_number().over(Window.orderBy("series_id")) - 1).cast("double").alias("_level"))
        if exog is not None and self.differencing:
            warnings.warn("exogenous columns explain differences of the series, not the series", V.ExogInterpretationWarning, stacklevel=2)
        self._learn_scales(series, exog)
        matrix = self.create_train_matrix(series, exog)
        weight = None
        if weights is not None or series_weights:
            matrix = matrix.withColumn("weight", F.lit(1.0)) if weights is None else _with_weights(matrix, weights)
            if series_weights:
                factor = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in series_weights.items() for x in (F.lit(k), F.lit(float(v))))), F.col("series_id")), F.lit(1.0))
                matrix = matrix.withColumn("weight", F.col("weight") * factor)
            weight = "weight"
        encoded, names = self._encoded(matrix)
        self.all_names = names
        self.model_table, self.shared_model = None, None
        if self.estimator == "linear":
            table = fit_linear(encoded, names, ["series_id"] if self.per_series else [], weight, **{k: v for k, v in self.estimator_params.items() if k == "ridge"})
            if self.per_series:
                self.model_table = table.persist()  # a row for each series; it stays a table, however many there are
            else:
                row = table.first()
                self.shared_model = (list(row["coef"]), row["intercept"])
        elif self.per_series:
            self.model_table = self._fit_each(encoded, list(names), weight, seed).persist()
        else:
            from pyspark.ml import regression as R
            from pyspark.ml.feature import VectorAssembler

            make = {"gbt": R.GBTRegressor, "forest": R.RandomForestRegressor, "tree": R.DecisionTreeRegressor}[self.estimator]
            model = make(featuresCol="_x", labelCol="y", seed=seed, **({"weightCol": weight} if weight else {}), **({"maxIter": 20} if self.estimator == "gbt" else {}) | self.estimator_params)
            assembled = VectorAssembler(inputCols=list(names), outputCol="_x").transform(encoded)
            self.shared_model = Trees.of(model.fit(assembled), names)
        self.history = series
        self.windows = self._last_windows(series)
        self.is_fitted = True
        self.residuals = self.out_residuals = self.binner = None
        if store_residuals:
            self._store_residuals(encoded, seed)
        return self

    def _fit_each(self, encoded: DataFrame, names: list[str], weight: str | None, seed: int) -> DataFrame:
        """(series_id, model): the estimator fitted on each series' rows, in time order, and pickled. A series' rows are one task."""
        estimator, params, more = self.estimator, dict(self.estimator_params), dict(self.fit_kwargs)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("ts")
            model = E.fitted(estimator, params, seed, pdf[names].to_numpy(float), pdf["y"].to_numpy(float), pdf[weight].to_numpy(float) if weight else None, **more)
            return pd.DataFrame({"series_id": pdf["series_id"].iloc[:1], "model": [model]})

        return encoded.select("series_id", "ts", "y", *names, *([weight] if weight else [])).groupBy("series_id").applyInPandas(run, "series_id string, model binary")

    def _store_residuals(self, encoded: DataFrame, seed: int) -> None:
        """In-sample residuals in the scale that is regressed, with bins of the predictions, for each series."""
        rows = self._predict_rows(encoded).withColumn("residual", F.col("y") - F.col("pred"))
        self.binner = QuantileBinner(self.n_bins).fit(rows, "pred")
        self.residuals = self.binner.transform(rows, "pred").select("series_id", "ts", "bin", "residual")

    def set_in_sample_residuals(self, series: DataFrame, exog: DataFrame | None = None, seed: int = 123) -> None:
        self._check()
        self._store_residuals(self._encoded(self.create_train_matrix(series, exog))[0], seed)

    def set_out_sample_residuals(self, rows: DataFrame, append: bool = False) -> None:
        """rows: (series_id, ts, y, pred) in the scale that is regressed."""
        self._check()
        if self.binner is None:
            raise ValueError("fit with store_residuals first")
        new = self.binner.transform(rows.dropna(subset=["y", "pred"]).withColumn("residual", F.col("y") - F.col("pred")), "pred").select("series_id", "ts", "bin", "residual")
        self.out_residuals = self.out_residuals.unionByName(new) if append and self.out_residuals is not None else new

    def _check(self) -> None:
        if not self.is_fitted:
            raise NotFitted("fit the forecaster first")

    @property
    def levels(self) -> list[str]:
        """The series of the training, by name."""
        if self._levels is None:
            self._levels = sorted(r[0] for r in self._trained.collect())
        return self._levels

    @property
    def models(self) -> dict:
        """(coefficients, intercept) by series, or one model under None. Gathers the table of models, so for a few series."""
        if self.model_table is None:
            return {None: self.shared_model}
        return {r["series_id"]: (list(r["coef"]), r["intercept"]) if self.estimator == "linear" else pickle.loads(r["model"]) for r in self.model_table.collect()}

    def _predict_rows(self, encoded: DataFrame) -> DataFrame:
        names = list(self.all_names)
        if self.estimator == "linear":
            if self.model_table is not None:
                known = encoded.join(self.model_table, "series_id")
            else:
                coef, intercept = self.shared_model
                known = encoded.withColumns({"coef": F.array(*(F.lit(float(c)) for c in coef)), "intercept": F.lit(float(intercept))})
            total = F.col("intercept")
            for k, n in enumerate(names):
                total = total + F.col(n) * F.col("coef")[k]
            return known.withColumn("pred", total).drop("coef", "intercept")
        if self.model_table is not None:
            schema = T.StructType([*encoded.schema.fields, T.StructField("pred", T.DoubleType())])

            def run(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
                if not len(model) or not len(rows):  # rows of a series without a model have no prediction
                    return pd.DataFrame({f.name: [] for f in schema})
                values = np.ravel(pickle.loads(model["model"].iloc[0]).predict(rows[names].to_numpy(float)))
                return rows.assign(pred=values.astype(float))

            return encoded.groupBy("series_id").cogroup(self.model_table.groupBy("series_id")).applyInPandas(run, schema)
        trees = self.shared_model
        udf = F.pandas_udf(lambda *c: pd.Series(trees.predict(np.array(c, float))), "double")
        return encoded.withColumn("pred", udf(*(F.col(n).cast("double") for n in names)))

    def predict_one_step(self, series: DataFrame, exog: DataFrame | None = None) -> DataFrame:
        """(series_id, ts, y, pred) at every time with a full window, from true past values."""
        self._check()
        return self._predict_rows(self._encoded(self.create_train_matrix(series, exog))[0]).select("series_id", "ts", "y", "pred")

    # ---- forecasts

    def _last_windows(self, series: DataFrame) -> DataFrame:
        """(series_id, last, state, tails): the regressed values that a forecast starts from, and the tails of each difference."""
        n = max(self._reach, 1)
        t = self._transformed(series)
        back = F.row_number().over(over_series().orderBy(F.col("ts").desc()))
        state = t.withColumn("_b", back).filter(F.col("_b") <= n).groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "y"))), lambda x: x["y"]).alias("state"), F.max("ts").alias("last"))
        if self.differencing:
            source = X.rescale(series, self._scale, "y", "y") if self.scaled else series
            state = state.join(X.difference_tails(source, self.differencing), "series_id")
        else:
            state = state.withColumn("tails", F.array().cast("array<double>"))
        if self.scaled:
            return state.join(self._scale, "series_id")
        return state.withColumns({"mean": F.lit(0.0), "sd": F.lit(1.0)})

    def _exog_blocks(self, exog: DataFrame | None, steps: int, windows: DataFrame) -> DataFrame:
        """windows with exog: an array of the exogenous values of each step."""
        if not self.exog_names:
            return windows.withColumn("exog", F.array().cast("array<array<double>>"))
        if exog is None:
            raise ValueError("the forecaster was fitted with exogenous columns")
        missing = set(self.exog_names) - set(exog.columns)
        if missing:
            raise ValueError(f"missing exogenous columns: {sorted(missing)}")
        ahead = future(windows.withColumnRenamed("last", "ts"), steps, self.rule)
        joined = ahead.join(self._exog_values(exog), [c for c in ("series_id", "ts") if c in exog.columns], "left")
        row = F.array(*(F.col(c).cast("double") for c in self.exog_names))
        blocks = joined.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", row.alias("x")))), lambda s: s["x"]).alias("exog"))
        return windows.join(blocks, "series_id")

    def _undo(self, rows: DataFrame, by: Sequence[str]) -> DataFrame:
        """From the regressed scale, in pred, to the original one."""
        if self.differencing:
            starts = self.windows.select("series_id", "tails")
            rows = X.undifference(rows.withColumnRenamed("pred", "_d"), starts, self.differencing, "_d", "pred", by).drop("_d")
        if self.scaled:
            rows = X.unscale(rows, self._scale, "pred", "pred")
        return rows

    def predict(self, steps: int, exog: DataFrame | None = None, last_window: DataFrame | None = None, levels: Sequence[str] | None = None) -> DataFrame:
        """(series_id, ts, step, pred). levels: the series to forecast; those that end before the last one are left out of global forecasts."""
        return self._undo(self._paths(steps, exog, last_window, levels), ["series_id"])

    def _paths(self, steps: int, exog, last_window, levels, boot: dict | None = None) -> DataFrame:
        self._check()
        if steps < 1:
            raise ValueError("steps must be positive")
        windows = self.windows if last_window is None else self._last_windows(last_window)
        if levels is not None:
            windows = windows.filter(F.col("series_id").isin(list(levels)))
        if not self.per_series:
            end = windows.agg(F.max("last").alias("_end"))
            windows = windows.crossJoin(F.broadcast(end)).filter("last = _end").drop("_end")  # one row
        windows = self._exog_blocks(exog, steps, windows)
        if boot is None and self.estimator == "linear" and self.window_features is None and self.lag_list:
            return self._in_catalyst(windows, steps)
        return self._in_lanes(windows, steps, boot)

    def _in_catalyst(self, windows: DataFrame, steps: int) -> DataFrame:
        """Linear models on lags and exogenous columns: the recursion is one aggregate() over the steps."""
        reach, lags, n_exog = max(self._reach, 1), self.lag_list, len(self.exog_names)
        if self.model_table is None:
            coef, intercept = self.shared_model
            known = windows.withColumn("coef", F.array(*(F.lit(float(c)) for c in coef))).withColumn("intercept", F.lit(float(intercept)))
            level = len(lags) + n_exog
            if self.encoding == "ordinal":
                known = self._coded(known).withColumn("intercept", F.col("intercept") + F.col("coef")[level] * F.col("_level"))
            elif self.encoding == "onehot":
                share = F.try_element_at("coef", (F.col("_level") + level + 1).cast("int"))
                known = self._coded(known).withColumn("intercept", F.col("intercept") + F.coalesce(share, F.lit(0.0)))
        else:
            known = windows.join(self.model_table, "series_id")

        def step(state: Column, i: Column) -> Column:
            y = F.col("intercept")
            for k, lag in enumerate(lags):
                y = y + F.col("coef")[k] * F.element_at(state, -lag)
            for k in range(n_exog):
                y = y + F.col("coef")[len(lags) + k] * F.element_at(F.element_at("exog", i), k + 1)
            return F.concat(state, F.array(y))

        path = F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("state"), step), -steps, steps)
        out = known.select("series_id", "last", F.posexplode(path).alias("_i", "pred"))
        return self._timed(out, F.col("_i") + 1).select("series_id", "ts", "step", "pred")

    def _timed(self, df: DataFrame, step: Column) -> DataFrame:
        from tidewright.session import seconds_of

        return df.withColumn("step", step.cast("long")).withColumn("ts", F.col("last") + F.make_dt_interval(secs=F.col("step") * seconds_of(self.rule)))

    def _in_lanes(self, windows: DataFrame, steps: int, boot: dict | None) -> DataFrame:
        """All other models: NumPy over a series' lanes, one lane for each bootstrap path. State has a fixed size for each series."""
        lags, wf, shared, linear = self.lag_list, self.window_features, self.shared_model, self.estimator == "linear"
        coded = None if self.per_series else self.encoding
        n_levels = len(self.levels) if coded == "onehot" else 0
        if coded:
            windows = self._coded(windows)
        if self.model_table is not None:
            windows = windows.join(self.model_table, "series_id")
        drawn, edges = boot is not None, boot is not None and boot["edges"] is not None
        n = boot["n"] if boot else 1
        seed = boot["seed"] if boot else 0
        reach = max(self._reach, 1)

        def one(row) -> np.ndarray:
            key = row["series_id"]
            model = shared if shared is not None else (row["coef"], row["intercept"]) if linear else pickle.loads(row["model"])
            own = shared is None and not linear
            state = np.repeat(np.asarray(row["state"], float)[-reach:, None], n, axis=1)
            place = row["_level"] if coded and row["_level"] is not None else np.nan
            fixed = [np.full(n, v) for v in ([place] if coded == "ordinal" else [float(place == i) for i in range(n_levels)])]
            r = np.random.default_rng([seed, *key.encode()])
            pools = {int(k): np.asarray(v, float) for k, v in zip(row["bins"], row["pools"], strict=True)} if drawn else {}
            whole = np.concatenate(list(pools.values())) if pools else None
            cuts = np.asarray(row["edges"], float)[1:-1] if edges else None
            out = np.empty((steps, n))
            for t in range(steps):
                x = [state[-i] for i in lags] + (wf.kernel(state) if wf else []) + ([np.full(n, v if v is not None else np.nan) for v in row["exog"][t]] if len(row["exog"]) else []) + fixed
                x = np.array(x)
                y = model[1] + np.asarray(model[0]) @ x if linear else np.ravel(model.predict(x.T)).astype(float) if own else model.predict(x)
                if drawn:
                    u = r.random(n)
                    if edges:
                        at = np.searchsorted(cuts, y, "right")
                        add = np.zeros(n)
                        for b in np.unique(at):
                            pool = pools.get(int(b), whole)
                            lane = at == b
                            add[lane] = pool[(u[lane] * len(pool)).astype(int)]
                        y = y + add
                    else:
                        y = y + whole[(u * len(whole)).astype(int)]
                out[t] = y
                state = np.vstack([state[1:], y])
            return out

        def run(batches):
            for pdf in batches:
                for row in pdf.to_dict("records"):
                    p = one(row)
                    yield pd.DataFrame({"series_id": row["series_id"], "last": row["last"], "step": np.repeat(np.arange(1, steps + 1), n), "boot_id": np.tile(np.arange(n), steps), "pred": p.ravel()})

        if boot and boot["all"] is None:
            windows = windows.join(boot["pools"], "series_id")
            windows = windows.join(boot["edges"], "series_id") if edges else windows
        elif boot:  # a series without residuals draws from those of all series
            windows = windows.join(boot["pools"], "series_id", "left").crossJoin(F.broadcast(boot["all"]))  # one row
            windows = windows.join(boot["edges"], "series_id", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<double>"))) if edges else windows
            windows = windows.withColumns({"bins": F.coalesce("bins", F.array(F.lit(0))), "pools": F.coalesce("pools", F.array("_all"))}).drop("_all")
        out = windows.mapInPandas(run, "series_id string, last timestamp, step long, boot_id long, pred double")
        out = self._timed(out, F.col("step"))
        return out.select("series_id", "ts", "step", *(["boot_id"] if boot else []), "pred")

    def create_predict_matrix(self, steps: int, exog: DataFrame | None = None) -> DataFrame:
        """(series_id, ts, step, features): what each step of a forecast is computed from, in the scale that is regressed."""
        if self.scaled or self.differencing:
            warnings.warn("the features are in the scale that is regressed", V.TransformedSpaceWarning, stacklevel=2)
        path = self._paths(steps, exog, None, None)
        past = self.windows.select("series_id", "last", F.posexplode("state").alias("_i", "y"), F.size("state").alias("_n"))
        past = self._timed(past, F.col("_i") - F.col("_n") + 1).select("series_id", "ts", "step", "y")
        rows = past.unionByName(path.select("series_id", "ts", "step", F.col("pred").alias("y"))).withColumns(X.lag_columns(self.lag_list))
        if self.window_features:
            rows = self.window_features.transform(rows)
        rows = rows.filter("step > 0")
        if self.exog_names:
            rows = rows.join(self._exog_values(exog), [c for c in ("series_id", "ts") if c in exog.columns])
        return rows.select("series_id", "ts", "step", *self.feature_names)

    # ---- distributions

    def predict_bootstrapping(self, steps: int, n_boot: int = 250, exog: DataFrame | None = None, in_sample: bool = True, binned: bool = True, seed: int = 123, last_window: DataFrame | None = None, levels=None) -> DataFrame:
        """(series_id, ts, step, boot_id, pred): paths whose residuals are fed back. Seeded by series, so that partitioning does not matter."""
        self._check()
        residuals = self.residuals if in_sample else self.out_residuals
        if residuals is None:
            raise ValueError("there are no residuals of this kind")
        kept = capped(residuals, self.n_bins, seed)
        pools = kept.groupBy("series_id", "bin").agg(F.sort_array(F.collect_list("residual")).alias("pool")).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("bin", "pool"))).alias("p"))
        pools = pools.select("series_id", F.col("p.bin").alias("bins"), F.col("p.pool").alias("pools"))
        everything = None
        if not self.per_series:  # at most RESIDUALS of all series, by hash
            some = residuals.orderBy(F.xxhash64(F.lit(seed), *residuals.columns), "residual").limit(RESIDUALS)
            everything = some.agg(F.sort_array(F.collect_list("residual")).alias("_all"))
        rows = self._paths(steps, exog, last_window, levels, {"n": n_boot, "seed": seed, "pools": pools, "edges": self.binner.edges if binned else None, "all": everything})
        return self._undo(rows, ["series_id", "boot_id"])

    def predict_quantiles(self, steps: int, quantiles: Sequence[float] = (0.05, 0.5, 0.95), **how) -> DataFrame:
        if any(not 0 <= q <= 1 for q in quantiles):
            raise ValueError("quantiles must lie in [0, 1]")
        return path_quantiles(self.predict_bootstrapping(steps, **how), quantiles, ["series_id", "ts", "step"])

    def predict_dist(self, steps: int, distribution: str | dict[str, Callable[[Column], Column]] = "norm", **how) -> DataFrame:
        """The parameters of a distribution at each step, fitted to the bootstrap paths: a name of DISTRIBUTIONS, or aggregates by
        parameter."""
        if isinstance(distribution, str) and distribution not in DISTRIBUTIONS:
            raise ValueError(f"distribution must be one of {sorted(DISTRIBUTIONS)} or aggregates by parameter")
        parts = DISTRIBUTIONS[distribution] if isinstance(distribution, str) else distribution
        paths, keys = self.predict_bootstrapping(steps, **how), ["series_id", "ts", "step"]
        middle = paths.groupBy(*keys).agg(F.percentile("pred", F.lit(0.5)).alias("_median"))
        paths = paths.join(middle, keys) if distribution == "laplace" else paths
        return paths.groupBy(*keys).agg(*(f(F.col("pred")).alias(name) for name, f in parts.items()))

    def predict_interval(self, steps: int, interval=(5, 95), method: str = "conformal", exog: DataFrame | None = None, in_sample: bool = True, binned: bool = True, n_boot: int = 250, seed: int = 123, levels=None, last_window: DataFrame | None = None) -> DataFrame:
        """(series_id, ts, step, pred, lower_bound, upper_bound)."""
        point = self.predict(steps, exog, last_window, levels)
        if method == "bootstrapping":
            lo, hi = ((1 - interval) / 2, (1 + interval) / 2) if isinstance(interval, float) else (interval[0] / 100, interval[1] / 100)
            q = self.predict_quantiles(steps, (lo, hi), exog=exog, in_sample=in_sample, binned=binned, n_boot=n_boot, seed=seed, levels=levels, last_window=last_window)
            return point.join(q.toDF("series_id", "ts", "step", "lower_bound", "upper_bound"), ["series_id", "ts", "step"])
        if method != "conformal":
            raise ValueError("method must be 'conformal' or 'bootstrapping'")
        residuals = self.residuals if in_sample else self.out_residuals
        if residuals is None:
            raise ValueError("there are no residuals of this kind")
        raw = self._paths(steps, exog, last_window, levels)
        bounds = with_interval(raw, residuals, self.binner if binned else None, check_interval(interval), unknown=not self.per_series)
        keys = ["series_id", "ts", "step"]
        parts = [self._undo(bounds.select(*keys, F.col(c).alias("pred")), ["series_id"]).withColumnRenamed("pred", c) for c in ("lower_bound", "upper_bound")] if self.differencing or self.scaled else [bounds.select(*keys, "lower_bound"), bounds.select(*keys, "upper_bound")]
        return point.join(parts[0], keys).join(parts[1], keys)

    def feature_importances(self, sort: bool = True) -> pd.DataFrame:
        """Coefficients of linear models, importances of trees."""
        self._check()
        rows = []
        for k, m in self.models.items():
            values = m.importances if isinstance(m, Trees) else m[0] if isinstance(m, tuple) else E.importances(m)
            if values is None:
                raise ValueError("the estimator has neither feature_importances_ nor coef_")
            rows += [(k, n, float(v)) for n, v in zip(self.all_names, values, strict=True)]
        out = pd.DataFrame(rows, columns=["series_id", "feature", "importance"])
        return out.sort_values("importance", ascending=False, ignore_index=True) if sort else out

    # ---- persistence

    def save(self, path: str) -> None:
        """Parameters and models as JSON, state and residuals as Parquet, all through Spark's file systems."""
        self._check()
        spark = self.windows.sparkSession
        wf = self.window_features
        if wf and wf.custom:
            raise ValueError("custom window statistics cannot be saved")
        if not isinstance(self.estimator, str) or any(isinstance(x, X.Affine) for x in (self.scaled, self.scaled_exog)):
            raise ValueError("estimator objects and scalings of one's own cannot be saved")
        if self.out_residuals is not None:
            warnings.warn("out-of-sample residuals are not saved", V.SavedModelWarning, stacklevel=2)
        meta = {
            "version": tidewright.__version__,
            "params": {k: getattr(self, k) for k in self.__dataclass_fields__ if k not in ("window_features", "lags")} | {"lags": self.lag_list},
            "window_features": wf and {"stats": list(wf.stats), "window_sizes": list(wf.window_sizes), "closed": wf.closed},
            "model": vars(self.shared_model) if isinstance(self.shared_model, Trees) else self.shared_model,
            "exog_scale": self._exog_scale, "feature_names": self.feature_names, "all_names": list(self.all_names), "exog_names": self.exog_names, "residuals": self.residuals is not None,
        }
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        self.windows.write.mode("overwrite").parquet(f"{path}/windows")
        self._codes.write.mode("overwrite").parquet(f"{path}/levels")
        if self.model_table is not None:
            self.model_table.write.mode("overwrite").parquet(f"{path}/models")
        if self.residuals is not None:
            self.residuals.write.mode("overwrite").parquet(f"{path}/residuals")
            self.binner.edges.write.mode("overwrite").parquet(f"{path}/edges")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RecursiveForecaster:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        if meta.get("version") != tidewright.__version__:
            warnings.warn(f"the model was saved by version {meta.get('version')}, this is {tidewright.__version__}", V.VersionWarning, stacklevel=2)
        wf = meta["window_features"]
        out = cls(**meta["params"], window_features=X.RollingFeatures(**wf) if wf else None)
        m = meta["model"]
        out.shared_model = Trees(**m) if isinstance(m, dict) else tuple(m) if m else None
        out.model_table = None if m else spark.read.parquet(f"{path}/models")
        out._levels, out._codes, out._exog_scale = None, spark.read.parquet(f"{path}/levels"), {k: tuple(v) for k, v in meta["exog_scale"].items()}
        out._trained, out._scale = out._codes.select("series_id"), None
        for k in ("feature_names", "all_names", "exog_names"):
            setattr(out, k, meta[k])
        out.windows = spark.read.parquet(f"{path}/windows")
        if out.scaled:
            out._scale = out.windows.select("series_id", "mean", "sd")
        out.residuals = out.out_residuals = out.binner = None
        if meta["residuals"]:
            out.residuals = spark.read.parquet(f"{path}/residuals")
            out.binner = QuantileBinner(out.n_bins)
            out.binner.edges = spark.read.parquet(f"{path}/edges")
        out.is_fitted = True
        return out


def _with_weights(matrix: DataFrame, weights: DataFrame) -> DataFrame:
    """matrix with weight; a series whose rows all weigh 0 is taken unweighted."""
    check_weights(weights)
    out = look_up_weights(matrix, weights, [c for c in ("series_id", "ts") if c in weights.columns])
    total = F.sum("weight").over(Window.partitionBy("series_id"))
    return out.withColumn("weight", F.when(total == 0, 1.0).otherwise(F.col("weight")))


def path_quantiles(paths: DataFrame, quantiles: Sequence[float], keys: Sequence[str], value: str = "pred") -> DataFrame:
    """keys and q_{quantile} over the paths of each, with linear interpolation."""
    q = F.percentile(value, F.array(*(F.lit(float(x)) for x in quantiles)))
    return paths.groupBy(*keys).agg(q.alias("_q")).select(*keys, *(F.col("_q")[i].alias(f"q_{x}") for i, x in enumerate(quantiles)))


def predict_multivariate(forecasters: dict, steps: int, exog: DataFrame | None = None) -> DataFrame | None:
    """(ts, one column for each name): independent forecasts side by side; None for no forecaster."""
    out = None
    for name, f in forecasters.items():
        p = (f.predict(steps, exog) if exog is not None else f.predict(steps)).select("ts", F.col("pred").alias(name))
        out = p if out is None else out.join(p, "ts", "full_outer")
    return out
