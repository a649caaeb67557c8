"""What a forecaster offers, so that pipelines and backtests take any of them."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame


@runtime_checkable
class Forecaster(Protocol):
    def fit(self, series: DataFrame, *args, **how): ...

    def predict(self, steps: int, *args, **how) -> DataFrame: ...

    def predict_interval(self, steps: int, *args, **how) -> DataFrame: ...


@runtime_checkable
class WindowFeatures(Protocol):
    """Own window features: expressions over a series for training, and a NumPy kernel for recursive forecasts."""

    max_size: int
    names: list[str]

    def columns(self, y: str = "y") -> dict[str, Column]: ...

    def transform(self, series: DataFrame, halo: str | None = None) -> DataFrame: ...

    def kernel(self, state) -> list: ...
