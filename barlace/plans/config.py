"""Strict configuration: unknown keys and bad values are rejected."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path


class ConfigError(ValueError):
    pass


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


@dataclass(frozen=True)
class Data:
    provider: str = "parquet"
    path: str = ""
    timestamp_label: str = "end"
    calendar: str = "XNYS"
    min_session_coverage: float = 0.8
    synthetic: bool = False

    def __post_init__(self):
        _need(self.timestamp_label in ("start", "end"), "timestamp_label is start or end")
        _need(0 < self.min_session_coverage <= 1, "min_session_coverage lies in (0, 1]")


@dataclass(frozen=True)
class Features:
    log_return: bool = True
    range_fraction: bool = True
    volume_tod_adjusted: bool = True
    vwap_distance: bool = True
    realized_vol_window: int = 12

    def __post_init__(self):
        _need(self.realized_vol_window >= 2, "realized_vol_window is 2 or more")

    @property
    def columns(self) -> list[str]:
        """Feature columns in their fixed order; realized volatility is always one."""
        on = {"log_return": self.log_return, "realized_volatility": True, "range_fraction": self.range_fraction, "volume_surprise": self.volume_tod_adjusted, "vwap_distance": self.vwap_distance}
        return [name for name, used in on.items() if used]


@dataclass(frozen=True)
class Retrieval:
    k: int = 50
    distance: str = "euclidean"
    max_neighbors_per_session: int = 3
    embargo_sessions: int = 1

    def __post_init__(self):
        _need(self.k >= 1 and self.max_neighbors_per_session >= 1, "k and max_neighbors_per_session are 1 or more")
        _need(self.distance in ("euclidean", "cosine"), "distance is euclidean or cosine")
        _need(self.embargo_sessions >= 0, "embargo_sessions is 0 or more")


@dataclass(frozen=True)
class WalkForward:
    min_training_sessions: int = 126
    refit_frequency: str = "weekly"
    n_folds: int = 3

    def __post_init__(self):
        _need(self.min_training_sessions >= 1 and self.n_folds >= 1, "min_training_sessions and n_folds are 1 or more")
        _need(self.refit_frequency in ("daily", "weekly", "monthly"), "refit_frequency is daily, weekly or monthly")


@dataclass(frozen=True)
class Hmm:
    n_states: int = 6
    covariance_type: str = "full"
    n_iter: int = 500
    tol: float = 1e-4
    min_covar: float = 1e-3
    random_state: int = 42
    retry_seed_offsets: tuple[int, ...] = (0, 1, 2)

    def __post_init__(self):
        _need(self.n_states >= 2 and self.n_iter >= 1, "n_states is 2 or more, n_iter 1 or more")
        _need(self.covariance_type in ("full", "diag"), "covariance_type is full or diag")
        offsets = tuple(self.retry_seed_offsets)
        _need(bool(offsets) and offsets[0] == 0 and list(offsets) == sorted(set(offsets)), "retry_seed_offsets start at 0, unique, increasing")


@dataclass(frozen=True)
class Bootstrap:
    n_resamples: int = 1000
    confidence: float = 0.95

    def __post_init__(self):
        _need(self.n_resamples >= 20 and 0 < self.confidence < 1, "n_resamples is 20 or more, confidence in (0, 1)")


@dataclass(frozen=True)
class Sensitivity:
    embargo_sessions: tuple[int, ...] = (0, 1, 5)

    def __post_init__(self):
        values = list(self.embargo_sessions)
        _need(values == sorted(set(values)) and all(v >= 0 for v in values), "sensitivity embargoes are unique, increasing, 0 or more")


@dataclass(frozen=True)
class Costs:
    bps_per_side: float = 1.0

    def __post_init__(self):
        _need(0 <= self.bps_per_side < 10_000, "bps_per_side lies in [0, 10000)")


@dataclass(frozen=True)
class Trading:
    enabled: bool = False
    threshold: float = 0.0


@dataclass(frozen=True)
class Report:
    output_dir: str = "../runs"


@dataclass(frozen=True)
class Config:
    symbol: str = "SPY"
    bar_interval: str = "5m"
    regular_hours_only: bool = True
    context_bars: int = 12
    horizons_minutes: tuple[int, ...] = (5, 15, 30, 60)
    random_state: int = 42
    data: Data = field(default_factory=Data)
    features: Features = field(default_factory=Features)
    retrieval: Retrieval = field(default_factory=Retrieval)
    walk_forward: WalkForward = field(default_factory=WalkForward)
    hmm: Hmm = field(default_factory=Hmm)
    bootstrap: Bootstrap = field(default_factory=Bootstrap)
    sensitivity: Sensitivity = field(default_factory=Sensitivity)
    costs: Costs = field(default_factory=Costs)
    trading: Trading = field(default_factory=Trading)
    report: Report = field(default_factory=Report)

    def __post_init__(self):
        _need(bool(re.fullmatch(r"[1-9][0-9]*m", self.bar_interval)), "bar_interval looks like 5m")
        _need(bool(re.fullmatch(r"[A-Z][A-Z0-9.\-]*", self.symbol)), "symbol is upper case")
        _need(self.regular_hours_only is True, "only regular hours are supported: bars off the session grid are rejected")
        _need(self.context_bars >= 1, "context_bars is 1 or more")
        h = list(self.horizons_minutes)
        _need(bool(h) and h == sorted(set(h)) and all(x > 0 and x % self.bar_minutes == 0 for x in h), "horizons are unique, increasing, positive multiples of the bar")

    @property
    def bar_minutes(self) -> int:
        return int(self.bar_interval[:-1])

    @property
    def horizon_bars(self) -> dict[int, int]:
        return {h: h // self.bar_minutes for h in self.horizons_minutes}

    @property
    def embargoes(self) -> list[int]:
        """Primary and sensitivity embargoes, united."""
        return sorted({self.retrieval.embargo_sessions, *self.sensitivity.embargo_sessions})


def _build(kind, values: dict, where: str = ""):
    known = {f.name: f for f in fields(kind)}
    if unknown := set(values) - set(known):
        raise ConfigError(f"unknown keys{where and ' in ' + where}: {', '.join(sorted(unknown))}")
    out = {}
    for name, value in values.items():
        default = known[name].default_factory() if callable(known[name].default_factory) else known[name].default
        if is_dataclass(default):
            _need(isinstance(value, dict), f"{name} is a section")
            value = _build(type(default), value, name)
        elif isinstance(default, tuple):
            value = tuple(value)
        elif isinstance(default, bool) or isinstance(default, str):
            _need(isinstance(value, type(default)), f"{name} is of type {type(default).__name__}")
        elif isinstance(default, float):
            value = float(value)
        elif isinstance(default, int):
            _need(isinstance(value, int) and not isinstance(value, bool), f"{name} is an integer")
        out[name] = value
    return kind(**out)


def config_from(values: dict) -> Config:
    return _build(Config, values)


def load_config(path: str) -> Config:
    """Reads YAML; relative paths count from the file's folder."""
    import yaml

    path = Path(path).resolve()
    values = yaml.safe_load(path.read_text()) or {}
    for section, name in (("data", "path"), ("report", "output_dir")):
        if isinstance(values.get(section), dict) and values[section].get(name):
            values[section][name] = str((path.parent / values[section][name]).resolve())
    return config_from(values)


def save_config(config: Config, path: str) -> None:
    import yaml

    plain = lambda v: {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [*v] if isinstance(v, tuple) else v
    Path(path).write_text(yaml.safe_dump(plain(asdict(config)), sort_keys=False))
