"""Configurations of the workflows, as plain dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from tidewright.functions.calendar import Period


def default_periods() -> list[Period]:
    return [Period("daily", 12, "hour", (1, 24)), Period("weekly", 7, "dayofweek", (0, 6)), Period("monthly", 12, "month", (1, 12)), Period("quarterly", 4, "quarter", (1, 4)), Period("yearly", 12, "dayofyear", (1, 365))]


@dataclass(frozen=True)
class WorkflowConfig:
    """Of a model of one load series."""

    country: str = "DE"
    state: str | None = None
    zone: str = "UTC"
    periods: list[Period] = field(default_factory=default_periods)
    lags: tuple[int, ...] = tuple(range(1, 24))
    train_size: str = "1095 days"
    predict_size: int = 24
    refit_size: int = 7
    random_state: int = 314159
    n_iterations: int = 1

    def get_params(self) -> dict:
        """Flat, with parameters of periods as periods__{name}__{parameter}."""
        out = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "periods"}
        for p in self.periods:
            out |= {f"periods__{p.name}__{f.name}": getattr(p, f.name) for f in fields(p) if f.name != "name"}
        return out

    def set_params(self, **params) -> WorkflowConfig:
        """A changed copy."""
        plain = {k: v for k, v in params.items() if not k.startswith("periods__")}
        unknown = set(plain) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        periods = {p.name: p for p in plain.get("periods", self.periods)}
        for k, v in params.items():
            if k.startswith("periods__"):
                _, name, parameter = k.split("__", 2)
                if name not in periods:
                    raise ValueError(f"unknown period {name!r}")
                periods[name] = replace(periods[name], **{parameter: v})
        return replace(self, **(plain | {"periods": list(periods.values())}))


@dataclass(frozen=True)
class CombinedConfig:
    """Of forecasts of several series and their signed sum."""

    columns: tuple[str, ...] = ()
    weights: tuple[float, ...] = (1.0, 1.0, -1.0, -1.0, 1.0, -1.0, 1.0, 1.0, 1.0, -1.0, 1.0)
    horizon: int = 24
    window_size: int = 72
    lags: int = 24
    contamination: float = 0.01
    country: str = "DE"
    state: str | None = "NW"
    latitude: float = 51.5
    longitude: float = 7.5
    zone: str = "UTC"
    include_windows: bool = False
    include_holidays: bool = False
    include_poly: bool = False
