"""Settings of a forecast, with the defaults users rely on."""

from __future__ import annotations

import dataclasses
import warnings
from dataclasses import dataclass, field

# Location -> (file family, demand column, seconds per record).
LOCATIONS = {
    "ENGLAND_WALES": ("NG", "ENGLAND_WALES_DEMAND", 1800),
    "UK": ("NG", "ND", 1800),
    "NYC": ("NY", "Integrated Load", 3600),
    "MHK": ("NY", "Integrated Load", 3600),
    "NEW_YORK": ("NY", "Integrated Load", 3600),
}

# Demand column -> regions whose weather stations matter; other columns keep all.
REGIONS = {
    "ENGLAND_WALES_DEMAND": ["England", "Wales"],
    "ND": ["Northern Ireland", "England", "Wales", "Scotland", "Ulster"],
}


@dataclass
class LoadSettings:
    fixes: list[str] = field(default_factory=lambda: ["zeros", "extremes_global", "derivatives"])
    threshold: tuple[float, float] = (1.5, 0.99)
    max_error_width: int = 3


@dataclass
class WeatherSettings:
    countries_to_keep: list[str] | None = None
    pre_clustering_data_quality: tuple[str, float] = ("1h", 85.0)
    post_clustering_data_quality: float = 98.0
    desired_cluster_count: int = 16
    min_cluster_size: int = 2
    algorithm: str | None = "meanshift"
    var: float | None = None


@dataclass
class FeatureSettings:
    time_encoding: str = "cyclical"
    train_test: tuple[int, int] = (6, 2)
    load_difference: bool = False
    stdz: str = "RobustScaler"
    fit_on: str = "all"  # "train" fits the scalers on the training years of each fold only
    points: list[str] = field(default_factory=lambda: ["1d", "7d"])
    averages: list[str] = field(default_factory=lambda: ["1d", "7d"])


@dataclass
class DataSettings:
    location: str | None = None
    forecast_horizon: str = "day"
    year_range: list[int] | None = None
    float_precision: int = 64
    weather_variables: dict[str, int] = field(default_factory=dict)


@dataclass
class EvaluationSettings:
    period: str = "global"
    metric: str = "MAPE"


@dataclass
class Settings:
    load: LoadSettings = field(default_factory=LoadSettings)
    weather: WeatherSettings = field(default_factory=WeatherSettings)
    features: FeatureSettings = field(default_factory=FeatureSettings)
    data: DataSettings = field(default_factory=DataSettings)
    evaluation: EvaluationSettings = field(default_factory=EvaluationSettings)

    def override(self, section: str, **values) -> Settings:
        """Change settings of one section; unknown names are reported and ignored."""
        part = getattr(self, section)
        known = {f.name for f in dataclasses.fields(part)}
        unknown = sorted(set(values) - known)
        if unknown:
            warnings.warn(f"unknown {section} settings {unknown} are ignored; known are {sorted(known)}")
        for name in known & set(values):
            setattr(part, name, values[name])
        return self

    def as_dict(self) -> dict:
        return dataclasses.asdict(self)

    @classmethod
    def from_dict(cls, stored: dict) -> Settings:
        settings = cls()
        for section, values in stored.items():
            if hasattr(settings, section):
                settings.override(section, **values)
        for section, name in (("load", "threshold"), ("weather", "pre_clustering_data_quality"), ("features", "train_test")):
            part = getattr(settings, section)
            if getattr(part, name) is not None:
                setattr(part, name, tuple(getattr(part, name)))
        return settings
