"""Percentile bands, deviations from them, and the anomaly verdict."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telltale.functions.numbers import is_finite, scaled
from telltale.operators.forest import Forest, with_forest_score
from telltale.operators.percentiles import exact_percentiles
from telltale.operators.scaling import Scaler
from telltale.schemas import BAND_HIGH, BAND_LOW, HIGH_SEVERITY_FROM, SENSORS

Bands = dict[str, tuple[float, float]]
CONTRIBUTIONS = "array<struct<feature:string,deviation_magnitude:double,raw_value:double>>"


def fit_bands(history: DataFrame, sensors: Iterable[str] = SENSORS, prefix: str = "z_") -> Bands:
    """5th and 95th percentile of every scaled sensor."""
    found = exact_percentiles(history, [prefix + s for s in sensors], [BAND_LOW, BAND_HIGH])
    return {s: tuple(found[prefix + s]) for s in sensors}


def bands_table(spark, bands: Bands) -> DataFrame:
    return spark.createDataFrame([(s, *b) for s, b in bands.items()], "feature string, p5 double, p95 double")


def bands_values(table: DataFrame) -> Bands:
    """One row per sensor."""
    return {r["feature"]: (r["p5"], r["p95"]) for r in table.collect()}


def severity(score: Column) -> Column:
    return F.when(score < 0, "normal").when(score < HIGH_SEVERITY_FROM, "moderate").otherwise("high")


def contributions(scaler: Scaler, bands: Mapping[str, tuple[float, float]] | None, sensors: Iterable[str] = SENSORS) -> Column:
    """Sensors outside their band, farthest first, ties in sensor order, with the raw reading. Empty without bands."""
    if not bands:
        return F.array().cast(CONTRIBUTIONS)
    entries = []
    for i, s in enumerate(sensors):
        z, (low, high) = scaled(s, scaler), bands[s]
        deviation = F.when(z < F.lit(low), F.lit(low) - z).when(z > F.lit(high), z - F.lit(high)).otherwise(F.lit(0.0))
        entries.append(
            F.struct(
                (-deviation).alias("o"), F.lit(i).alias("i"), F.lit(s).alias("feature"),
                deviation.alias("deviation_magnitude"), F.col(s).alias("raw_value"),
            )
        )
    outside = F.array_sort(F.filter(F.array(*entries), lambda e: e["deviation_magnitude"] > 0))
    return F.transform(outside, lambda e: F.struct(e["feature"], e["deviation_magnitude"], e["raw_value"])).cast(CONTRIBUTIONS)


def top_feature(found: Column) -> Column:
    """The sensor farthest outside its band, or null."""
    return F.try_element_at(found, F.lit(1))["feature"]


def fallback_verdict(error: Column) -> Column:
    """What is reported when the readings cannot be checked."""
    return F.struct(
        F.lit(False).alias("anomaly"), F.lit(0.0).alias("anomaly_score"), F.lit("unknown").alias("severity"),
        F.array().cast(CONTRIBUTIONS).alias("feature_contributions"), error.alias("error"),
    )


def detect_anomalies(
    incidents: DataFrame, forest: Forest, scaler: Scaler, bands: Bands | None,
    sensors: Iterable[str] = SENSORS, error: Column | None = None,
) -> DataFrame:
    """Add ``anomaly_verdict``. Rows with an ``error`` or a reading that is not finite get the fallback verdict."""
    sensors = list(sensors)
    z = ["_z_" + s for s in sensors]
    finite = F.lit(True)
    for s in sensors:
        finite = finite & is_finite(F.col(s))
    problem = F.when(~finite, F.lit("Sensor values must be finite numbers."))
    if error is not None:
        problem = F.coalesce(error, problem)
    ready = incidents.withColumn("_problem", problem).withColumns(
        {"_z_" + s: F.coalesce(scaled(s, scaler), F.lit(0.0)) for s in sensors}
    )
    scored = with_forest_score(ready, forest, z, "_forest")
    score = -(F.col("_forest") - F.lit(forest.offset))
    verdict = F.struct(
        (F.col("_forest") - F.lit(forest.offset) < 0).alias("anomaly"), F.round(score, 4).alias("anomaly_score"),
        severity(score).alias("severity"), contributions(scaler, bands, sensors).alias("feature_contributions"),
        F.lit(None).cast("string").alias("error"),
    )
    return scored.withColumn(
        "anomaly_verdict", F.when(F.col("_problem").isNull(), verdict).otherwise(fallback_verdict(F.col("_problem")))
    ).drop("_problem", "_forest", *z)
