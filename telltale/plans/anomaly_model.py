"""Fit the anomaly model: forest, score offset and percentile bands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from telltale.operators.deviation import Bands, fit_bands
from telltale.operators.forest import Forest, fit_forest
from telltale.schemas import CONTAMINATION, FOREST_SAMPLE, FOREST_SEED, FOREST_TREES, SENSORS


@dataclass
class AnomalyModel:
    forest: Forest
    bands: Bands


def fit_anomaly_model(
    history: DataFrame, sensors=SENSORS, trees: int = FOREST_TREES, size: int = FOREST_SAMPLE,
    seed: int = FOREST_SEED, contamination: float = CONTAMINATION,
) -> AnomalyModel:
    """``history`` is clean train data with scaled ``z_`` columns and ``historical_index``."""
    columns = ["z_" + s for s in sensors]
    forest = fit_forest(history, "historical_index", columns, trees, size, seed, contamination)
    return AnomalyModel(forest, fit_bands(history, sensors))
