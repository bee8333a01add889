"""Fit and apply the sensor scaler."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.functions.numbers import is_finite, scaled, unscaled
from telltale.schemas import SENSORS

Scaler = dict[str, tuple[float, float]]


def fit_scaler(df: DataFrame, sensors: Iterable[str] = SENSORS) -> DataFrame:
    """``(feature, mean, scale)``: mean and population deviation of the finite cells, one pass; a constant sensor gets scale 1."""
    sensors = list(sensors)
    known = {s: F.when(is_finite(F.col(s)), F.col(s)) for s in sensors}
    stats = df.agg(
        *[F.avg(known[s]).alias(f"m_{s}") for s in sensors], *[F.stddev_pop(known[s]).alias(f"d_{s}") for s in sensors]
    )
    rows = [
        F.struct(
            F.lit(s).alias("feature"),
            F.col(f"m_{s}").alias("mean"),
            F.when(F.col(f"d_{s}") == 0, F.lit(1.0)).otherwise(F.col(f"d_{s}")).alias("scale"),
        )
        for s in sensors
    ]
    return stats.select(F.inline(F.array(*rows)))


def scaler_values(params: DataFrame) -> Scaler:
    """The fitted parameters as literals for column expressions: one row per sensor."""
    return {r["feature"]: (r["mean"], r["scale"]) for r in params.collect()}


def scale(df: DataFrame, scaler: Scaler, prefix: str = "z_", sensors: Iterable[str] = SENSORS) -> DataFrame:
    """Add one scaled column per sensor; the raw columns stay."""
    return df.withColumns({prefix + s: scaled(s, scaler) for s in sensors})


def unscale(df: DataFrame, scaler: Scaler, prefix: str = "z_", sensors: Iterable[str] = SENSORS) -> DataFrame:
    """Turn scaled columns back into sensor readings."""
    return df.withColumns({s: unscaled(F.col(prefix + s), s, scaler) for s in sensors}).drop(
        *[prefix + s for s in sensors]
    )
