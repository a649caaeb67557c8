"""End-to-end forecasts: many targets without and with covariates, their combination, and a model workflow."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import calendar as K
from tidewright.functions import metrics as M
from tidewright.operators import curate, features, grid
from tidewright.operators.folds import TimeSeriesFold
from tidewright.plans.naive import SeasonalNaive
from tidewright.plans.recursive import RecursiveForecaster
from tidewright.session import seconds_of, stored
from tidewright.sources import store

# Signed weights of eleven combined series, in order.
DEFAULT_WEIGHTS = [1.0, 1.0, -1.0, -1.0, 1.0, -1.0, 1.0, 1.0, 1.0, -1.0, 1.0]


def curated(series: DataFrame, rule: str = "h", by: str = "mean", contamination: float | None = 0.01) -> DataFrame:
    """Resampled, outliers removed if asked, and filled."""
    out = grid.resample(series, rule, by=by)
    if contamination:
        out = curate.mark_outliers(out, contamination).drop("is_outlier")
    return grid.fill(out)


def forecast_many(series: DataFrame, horizon: int = 24, rule: str = "h", offset: int | str = "1 day", contamination: float | None = 0.01) -> DataFrame:
    """(series_id, ts, step, pred) by the seasonal-naive rule. There is no model to keep: the plan is lazy as a whole."""
    return SeasonalNaive(offset, rule=rule).fit(curated(series, rule, contamination=contamination)).predict(horizon)


@dataclass
class Covariates:
    """What is known of the future: calendar, cycles, holidays, sun, weather and interactions, on one grid."""

    country: str | None = "DE"
    state: str | None = None
    zone: str = "UTC"
    latitude: float | None = None
    longitude: float | None = None
    weather: DataFrame | None = None
    weather_windows: Sequence[str] = ("1D", "7D")
    include_windows: bool = False
    include_holidays: bool = False
    include_poly: bool = False
    poly_columns: Sequence[str] = ()

    def build(self, bounds: DataFrame, rule: str = "h") -> DataFrame:
        """bounds: one row of start and end. The result has ts and the selected columns, and raises when run if one is missing."""
        df = K.calendar_parts(grid.spine(bounds, rule))
        if self.country:
            df = K.with_holidays(df, self.country, self.state, self.zone)
        if self.latitude is not None and self.longitude is not None:
            df = K.sun(df, self.latitude, self.longitude, self.zone)
        weather = []
        if self.weather is not None:
            weather = [c for c, t in self.weather.dtypes if c != "ts" and t in ("double", "float", "int", "bigint")]
            df = features.asof(df, self.weather, weather, backfill=True)
            df = features.time_windows(df.withColumn("_one", F.lit(1)), weather, self.weather_windows, by=("_one",)).drop("_one")
            df = grid.backward_fill_columns(df, [c for c in df.columns if "_window_" in c])
        df = K.cyclical(df)
        if self.include_poly:
            df = features.interactions(df, list(self.poly_columns) or [c for c in df.columns if c.endswith(("_sin", "_cos"))][:4])
        chosen = features.select_features(df.columns, weather, self.include_windows, self.include_holidays, self.include_poly)
        out = df.select("ts", *chosen)
        missing = F.lit(False)
        for c in chosen:
            missing = missing | F.col(c).isNull()
        return out.filter(F.when(missing, F.raise_error(F.lit("covariates have missing values")).cast("boolean")).otherwise(F.lit(True)))


def forecast_with_covariates(series: DataFrame, horizon: int = 24, covariates: Covariates | None = None, forecaster: RecursiveForecaster | None = None, rule: str = "h", contamination: float | None = 0.01, window_size: int = 72, weights: str | None = "documented", model_dir: str | None = None, force_train: bool = True) -> tuple[DataFrame, dict, RecursiveForecaster]:
    """(predictions, metadata, forecaster): one recursive model for each target, on lags and covariates.

    weights: a mode of missing_weights(), or None. With model_dir, a saved model is used unless force_train.
    """
    if horizon < 1:
        raise ValueError("horizon must be positive")
    sampled = stored(grid.resample(series, rule), "sampled")  # these are read several times below
    marked = curate.mark_outliers(sampled, contamination) if contamination else sampled.withColumn("is_outlier", F.lit(False))
    marked = stored(marked, "marked")
    if weights:
        data = stored(curate.missing_weights(marked.drop("is_outlier"), window_size, weights), "weighted")
        sample_weights = data.select("series_id", "ts", "weight")
        data = data.drop("weight")
    else:
        data, sample_weights = grid.fill(marked.drop("is_outlier")), None
    bounds = data.agg(F.min("ts").alias("start"), (F.max("ts") + F.make_dt_interval(secs=F.lit(horizon * seconds_of(rule)))).alias("end"))
    exog = (covariates or Covariates()).build(bounds, rule)
    exog = stored(exog, "covariates")
    model = None
    if model_dir and not force_train and store.exists(series.sparkSession, model_dir):
        model = RecursiveForecaster.load(series.sparkSession, model_dir)
    if model is None:
        model = (forecaster or RecursiveForecaster(lags=24, rule=rule)).fit(data, exog, sample_weights)
        if model_dir:
            model.save(model_dir)
    counts = marked.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_outlier").alias("n_outliers")).first()
    meta = {"horizon": horizon, "targets": model.levels, "exog": model.exog_names, "rows": counts["n"], "n_outliers": counts["n_outliers"], "window_size": model.window_size}
    return model.predict(horizon, exog), meta, model


def forecast_n_to_1(series: DataFrame, weights: dict[str, float] | Sequence[float] | None = None, **how) -> tuple[DataFrame, DataFrame, dict]:
    """(combined, predictions, metadata): forecasts with covariates, then their signed sum."""
    predictions, meta, _ = forecast_with_covariates(series, **how)
    names = meta["targets"]
    if weights is None:
        weights = DEFAULT_WEIGHTS[: len(names)]
    table = weights if isinstance(weights, dict) else dict(zip(names, weights, strict=True))
    w = series.sparkSession.createDataFrame([(k, float(v)) for k, v in table.items()], "series_id string, w double")
    return curate.weighted_sum(predictions, w), predictions, meta


@dataclass
class ModelWorkflow:
    """A named, numbered model of one table: fit, backtest, forecast, errors and a packaged result."""

    name: str
    series: DataFrame
    end_dev: str
    iteration: int = 0
    train_size: str | None = None
    predict_size: int = 24
    refit_size: int = 7
    rule: str = "h"
    exog: K.ExogBuilder | None = None
    forecaster: RecursiveForecaster = field(default_factory=lambda: RecursiveForecaster(lags=12))
    benchmark: DataFrame | None = None
    is_tuned: bool = False

    def _data(self) -> DataFrame:
        return grid.fill(grid.interpolate(self.series))

    def _train(self) -> DataFrame:
        end = F.lit(self.end_dev).cast("timestamp")
        out = self._data().filter(F.col("ts") <= end)
        return out.filter(F.col("ts") >= end - F.expr(f"INTERVAL {self.train_size}")) if self.train_size else out

    def _exog(self) -> DataFrame | None:
        if self.exog is None:
            return None
        ahead = F.make_dt_interval(secs=F.lit(self.predict_size * self.refit_size * seconds_of(self.rule)))
        bounds = self.series.agg(F.min("ts").alias("start"), (F.max("ts") + ahead).alias("end"))
        return self.exog.add_to(grid.spine(bounds, self.rule))

    def tune(self, grid_of_lags: Sequence, steps: int | None = None) -> ModelWorkflow:
        """Takes the lags with the least one-step error on the last predict_size rows before end_dev."""
        best = None
        train = self._train()
        cut = F.lit(self.end_dev).cast("timestamp") - F.make_dt_interval(secs=F.lit((steps or self.predict_size) * seconds_of(self.rule)))
        for lags in grid_of_lags:
            f = RecursiveForecaster(**{**{k: getattr(self.forecaster, k) for k in self.forecaster.__dataclass_fields__}, "lags": lags})
            f.fit(train.filter(F.col("ts") <= cut), self._exog())
            error = f.predict_one_step(train, self._exog()).filter(F.col("ts") > cut).agg(M.mae()).first()[0]
            if error is not None and (best is None or error < best[0]):
                best = (error, lags)
        if best:
            self.forecaster.set_lags(best[1])
        self.is_tuned = True
        return self

    def fit(self) -> ModelWorkflow:
        self.forecaster.fit(self._train(), self._exog())
        return self

    def backtest(self, metrics: Sequence[str] = ("mean_absolute_error",)) -> tuple[DataFrame, DataFrame]:
        """Folds of predict_size without refitting, over the last predict_size * refit_size steps up to end_dev."""
        from tidewright.plans.backtest import backtest, placed_on_axis

        data = self._data().filter(F.col("ts") <= F.lit(self.end_dev).cast("timestamp"))
        init = placed_on_axis(data)[1] - self.predict_size * self.refit_size
        return backtest(self.forecaster, data, TimeSeriesFold(self.predict_size, init), metrics, self._exog())

    def predict(self, steps: int | None = None) -> DataFrame:
        return self.forecaster.predict(steps or self.predict_size, self._exog())

    def errors(self, predictions: DataFrame) -> DataFrame:
        """MAE, MSE and MAPE of predictions (series_id, ts, pred) at the times that the data has."""
        rows = predictions.join(self._data(), ["series_id", "ts"])
        return rows.groupBy("series_id").agg(M.mae().alias("MAE"), M.mse().alias("MSE"), M.mape().alias("MAPE"))

    def training_errors(self) -> DataFrame:
        rows = self.forecaster.predict_one_step(self._train(), self._exog())
        return rows.groupBy("series_id").agg(M.mae().alias("MAE"), M.mse().alias("MSE"), M.mape().alias("MAPE"))

    def package(self) -> dict:
        """Fits, and gives in-sample and future rows with their errors, each prediction at its own time; and the benchmark's."""
        self.fit()
        future = self.predict()
        out = {"train_pred": self.forecaster.predict_one_step(self._train(), self._exog()), "future_pred": future, "train_errors": self.training_errors(), "future_errors": self.errors(future), "day_errors": self.errors(future.filter(F.col("step") <= 24))}
        if self.benchmark is not None:
            out["benchmark_errors"] = self.errors(self.benchmark)
        return out

    def feature_importance(self):
        return self.forecaster.feature_importances()

    def save(self, home: str) -> str:
        path = store.iteration_path(home, self.name, self.iteration)
        self.forecaster.save(path)
        return path


def model_prediction(home: str, name: str, make: Callable[[RecursiveForecaster, int], ModelWorkflow], spark) -> dict | None:
    """The package of the last saved iteration of a model; None if there is none."""
    number = store.last_iteration(spark, home, name)
    if number < 0:
        return None
    return make(RecursiveForecaster.load(spark, store.iteration_path(home, name, number)), number).package()
