"""Forecasting feature engineering P04-P13 on an (entity x day) panel.

Every feature is a ``Column`` expression; lags and rolling windows are window functions
partitioned by ``entity`` and ordered by date, so each entity's series is processed in
one task and the panel scales with the number of entities.  A daily series holds one
row per day, so a partition is bounded by the calendar, never by the raw event volume.

Semantics kept from the reference: lags are by *row position* (a gap in the series is
not filled), rolling statistics use ``min_periods=1``, the warm-up rows
(``max(lags + windows)`` per entity) are dropped.  Rolling windows exclude the current
row by default (the reference includes it and so leaks the target, defect B7; pass
``leaky=True`` for parity).
"""

from __future__ import annotations

import copy
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Feature groups of the reference's base configuration.
BASE_GROUPS: dict[str, list[dict]] = {
    "date_features": [
        {"name": "day_of_week", "type": "date_extract", "extract": "dayofweek", "dtype": "int"},
        {"name": "month", "type": "date_extract", "extract": "month", "dtype": "int"},
        {"name": "is_weekend", "type": "column", "source": "IS_WEEKEND", "dtype": "int"},
        {"name": "is_holiday", "type": "column", "source": "IS_HOLIDAY", "dtype": "int"},
    ],
    "weather_features": [
        {"name": "snowfall_inches", "type": "column", "source": "SNOWFALL_INCHES", "dtype": "float", "default": 0},
        {"name": "base_depth_inches", "type": "column", "source": "BASE_DEPTH_INCHES", "dtype": "float",
         "default": 60},
        {"name": "avg_temp_f", "type": "column", "source": "AVG_TEMP_F", "dtype": "float", "default": 28},
        {"name": "wind_speed_mph", "type": "column", "source": "WIND_SPEED_MPH", "dtype": "float", "default": 10},
        {"name": "is_powder_day", "type": "column", "source": "IS_POWDER_DAY", "dtype": "int", "default": 0},
        {"name": "is_high_wind", "type": "column", "source": "IS_HIGH_WIND", "dtype": "int", "default": 0},
        {"name": "snow_condition_encoded", "type": "categorical", "source": "SNOW_CONDITION",
         "mapping": {"powder": 3, "packed_powder": 2, "groomed": 1, "icy": 0}, "default": 1},
    ],
    "cyclical_features": [
        {"name": "day_sin", "type": "cyclical", "source": "day_of_week", "period": 7, "function": "sin"},
        {"name": "day_cos", "type": "cyclical", "source": "day_of_week", "period": 7, "function": "cos"},
        {"name": "month_sin", "type": "cyclical", "source": "month", "period": 12, "function": "sin"},
        {"name": "month_cos", "type": "cyclical", "source": "month", "period": 12, "function": "cos"},
    ],
    "day_dummies": [{"name": f"day_{i}", "type": "one_hot", "source": "day_of_week", "value": i} for i in range(7)],
    "month_dummies": [{"name": f"month_{i}", "type": "one_hot", "source": "month", "value": i} for i in range(1, 13)],
}

DTYPES = {"int": "int", "float": "double", "double": "double", "str": "string"}


@dataclass
class FeatureConfig:
    features: list[dict]
    lags: list[int] = field(default_factory=lambda: [7, 14, 21, 28])
    windows: list[int] = field(default_factory=lambda: [7, 14, 30])
    aggregation: str = "mean"
    target: str = "UNIQUE_VISITORS"
    lag_source: str | None = None
    rolling_source: str | None = None

    @property
    def warmup(self) -> int:
        return max(self.lags + self.windows + [0])


def _deep_merge(base: dict, over: dict) -> dict:
    out = copy.deepcopy(base)
    for k, v in over.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = _deep_merge(out[k], v)
        else:
            out[k] = copy.deepcopy(v)
    return out


def build_config(model: dict, env: dict | None = None, groups: dict[str, list[dict]] = BASE_GROUPS) -> FeatureConfig:
    """Include groups, exclude names, override fields, add custom specs; an
    environment dict is deep-merged over the model config first."""
    cfg = _deep_merge(model, env or {})
    specs: list[dict] = []
    for g in cfg.get("include", []):
        specs.extend(copy.deepcopy(groups[g]))
    specs.extend(copy.deepcopy(cfg.get("custom", [])))
    excluded = set(cfg.get("exclude", []))
    specs = [s for s in specs if s["name"] not in excluded]
    for s in specs:
        s.update(cfg.get("override", {}).get(s["name"], {}))
    lag = cfg.get("lag_features", {})
    roll = cfg.get("rolling_features", {})
    return FeatureConfig(
        features=specs,
        lags=list(lag.get("lags", [7, 14, 21, 28])),
        windows=list(roll.get("windows", [7, 14, 30])),
        aggregation=roll.get("aggregation", "mean"),
        target=cfg.get("target_column", "UNIQUE_VISITORS"),
        lag_source=lag.get("source"),
        rolling_source=roll.get("source"),
    )


def normalize_key(c: Column) -> Column:
    """B10 fix: map keys are lower-case with underscores ('Packed Powder' -> packed_powder)."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", "_")


def _feature(df: DataFrame, spec: dict, date_col: str) -> Column | None:
    t = spec.get("type", "column")
    cols = set(df.columns)
    if t == "date_extract":
        d = F.col(date_col)
        ex = spec.get("extract", "dayofweek")
        if ex == "dayofweek":          # P04: Monday = 0
            out = (F.dayofweek(d) + 5) % 7
        elif ex == "month":
            out = F.month(d)
        elif ex == "day":
            out = F.dayofmonth(d)
        elif ex == "dayofyear":
            out = F.dayofyear(d)
        else:
            raise ValueError(f"unknown extract {ex}")
    elif t == "column":                # P05: dropped when the source is missing
        src = spec.get("source", spec["name"].upper())
        if src not in cols:
            return None
        out = F.col(src)
    elif t == "categorical":           # P06
        src = spec.get("source")
        if src not in cols:
            return None
        pairs = []
        for k, v in spec.get("mapping", {}).items():
            pairs += [F.lit(k), F.lit(v)]
        out = F.try_element_at(F.create_map(*pairs), normalize_key(F.col(src)))
        if spec.get("default") is not None:
            out = F.coalesce(out, F.lit(spec["default"]))
    elif t == "cyclical":              # P07
        src = spec.get("source")
        if src not in cols:
            return None
        arg = F.lit(2 * math.pi) * F.col(src) / F.lit(float(spec.get("period", 7)))
        out = F.sin(arg) if spec.get("function", "sin") == "sin" else F.cos(arg)
    elif t == "one_hot":               # P08
        src = spec.get("source")
        if src not in cols:
            return None
        out = (F.col(src) == F.lit(spec.get("value"))).cast("double")
    else:
        return None
    dtype = spec.get("dtype")
    return out.cast(DTYPES.get(dtype, dtype)) if dtype else out


def future_features(df: DataFrame, cfg: FeatureConfig, date_col: str, needed: list[str]) -> DataFrame:
    """The configured features on forecast rows that already carry lags and rolling means.

    A category that no forecast knows takes its declared default; any other input that is
    missing is an error, never a constant.
    """
    for spec in cfg.features:
        name = spec["name"]
        if name in df.columns:
            continue
        made = _feature(df, spec, date_col)
        if made is None and spec.get("type") == "categorical" and spec.get("default") is not None:
            made = F.lit(spec["default"])
        if made is not None:
            df = df.withColumn(name, made)
    if missing := sorted(set(needed) - set(df.columns)):
        raise ValueError(f"forecast rows lack model inputs: {missing}")
    return df


def engineer(df: DataFrame, cfg: FeatureConfig, date_col: str, entity: str | None = None,
             leaky: bool = False, drop_warmup: bool = True) -> DataFrame:
    """Add configured features, lags and rolling statistics to a panel."""
    for spec in cfg.features:      # in order: later specs may use earlier features
        c = _feature(df, spec, date_col)
        if c is not None:
            df = df.withColumn(spec["name"], c)
    part = [F.col(entity)] if entity else []
    w = Window.partitionBy(*part).orderBy(F.col(date_col))
    lag_src = cfg.lag_source or cfg.target
    if lag_src in df.columns:
        for k in cfg.lags:         # P09: by row position
            df = df.withColumn(f"lag_{k}", F.lag(F.col(lag_src).cast("double"), k).over(w))
    roll_src = cfg.rolling_source or cfg.target
    agg = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp}[cfg.aggregation]
    if roll_src in df.columns:
        for n in cfg.windows:      # P10: min_periods = 1
            frame = w.rowsBetween(-(n - 1), 0) if leaky else w.rowsBetween(-n, -1)
            df = df.withColumn(f"rolling_{n}_{cfg.aggregation}", agg(F.col(roll_src).cast("double")).over(frame))
    if drop_warmup and cfg.warmup > 0:   # P11
        df = df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") > cfg.warmup).drop("__rn")
    return df


def time_split(df: DataFrame, date_col: str, entity: str | None = None, train_frac: float = 0.8) -> DataFrame:
    """Time-ordered split per entity; adds ``is_train`` (first floor(n*frac) rows)."""
    part = [F.col(entity)] if entity else []
    w = Window.partitionBy(*part).orderBy(F.col(date_col))
    n = F.count(F.lit(1)).over(Window.partitionBy(*part))
    return df.withColumn("is_train", F.row_number().over(w) <= F.floor(n * F.lit(train_frac)))


def feature_columns(df: DataFrame, cfg: FeatureConfig) -> list[str]:
    names = [s["name"] for s in cfg.features if s["name"] in df.columns]
    names += [f"lag_{k}" for k in cfg.lags if f"lag_{k}" in df.columns]
    names += [f"rolling_{n}_{cfg.aggregation}" for n in cfg.windows if f"rolling_{n}_{cfg.aggregation}" in df.columns]
    return names


def tail_mean(df: DataFrame, date_col: str, value: str, n: int, entity: str | None = None) -> DataFrame:
    """Mean of the last ``n`` rows of each entity's series (row_number desc <= n)."""
    part = [F.col(entity)] if entity else []
    w = Window.partitionBy(*part).orderBy(F.col(date_col).desc())
    t = df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
    keys = [entity] if entity else []
    return t.groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias(f"tail_{n}_mean"),
                                F.max(date_col).alias("last_date"))
