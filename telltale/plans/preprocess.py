"""Turn raw telemetry into clean history, scaler parameters and a quality report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.functions.codes import active_codes, signature
from telltale.operators.ordinals import with_ordinal
from telltale.operators.quality import coerce_numeric, content_groups, report_of_groups
from telltale.operators.scaling import Scaler, fit_scaler, scale, scaler_values
from telltale.schemas import CODES, SENSORS
from telltale.session import materialise


@dataclass
class Preprocessed:
    train: DataFrame
    test: DataFrame
    scaler: DataFrame
    report: DataFrame


def with_codes(df: DataFrame, codes=CODES) -> DataFrame:
    """Add ``active_dtcs`` and ``dtc_signature`` from the indicator columns."""
    active = active_codes(df.columns, codes)
    return df.withColumns({"active_dtcs": active, "dtc_signature": signature(active)})


def history_of_groups(groups: DataFrame, sensors=SENSORS, codes=CODES) -> DataFrame:
    """Clean history from ``content_groups``: one row per content seen in train, at its first position, with all its columns."""
    keys = [c for c in groups.columns if c not in ("train_rows", "test_rows", "first_row")]
    kept = groups.filter("train_rows > 0").select(F.col("first_row").alias("row_id"), *keys)
    return with_codes(with_ordinal(kept, ["row_id"], "historical_index"), codes)


def clean_history(train: DataFrame, sensors=SENSORS, codes=CODES) -> DataFrame:
    """Deduplicated train rows with ``historical_index``, the position among the kept rows."""
    train = coerce_numeric(train, sensors)
    return history_of_groups(content_groups(train, train.limit(0), sensors, codes), sensors, codes)


def preprocess(train: DataFrame, test: DataFrame, sensors=SENSORS, codes=CODES) -> Preprocessed:
    """Deduplicate train, keep every test row, fit the scaler on clean train only and apply it to both.

    The distinct contents are stored once; history, scaler and report all start from them.
    """
    train, test = coerce_numeric(train, sensors), coerce_numeric(test, sensors)
    groups = materialise(content_groups(train, test, sensors, codes), "contents")
    history = history_of_groups(groups, sensors, codes)
    scaler = scaler_values(fit_scaler(groups.filter("train_rows > 0"), sensors))
    return Preprocessed(
        train=scale(history, scaler, sensors=sensors),
        test=scale(with_codes(test, codes), scaler, sensors=sensors),
        scaler=scaler_table(history.sparkSession, scaler),
        report=report_of_groups(groups, sensors, codes),
    )


def scaler_table(spark, scaler: Scaler) -> DataFrame:
    rows = [(f, float(m), float(s)) for f, (m, s) in scaler.items()]
    return spark.createDataFrame(rows, "feature string, mean double, scale double")


def run_preprocess(train: DataFrame, test: DataFrame, output: str, fmt: str = "parquet") -> Preprocessed:
    """The whole job: tables, scaler, report rows and report text below ``output``."""
    from telltale.operators.quality import mode_values, report_markdown
    from telltale.sources.telemetry import write_history

    done = preprocess(train, test)
    write_history(done.train, f"{output}/train_clean", fmt)
    write_history(done.test, f"{output}/test_clean", fmt)
    done.scaler.coalesce(1).write.mode("overwrite").parquet(f"{output}/scaler")
    done.report.coalesce(1).write.mode("overwrite").parquet(f"{output}/report")
    text = report_markdown(done.report, mode_values(train))
    spark = train.sparkSession
    # One string; the text writer takes a one-column table.
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{output}/report_text")
    return done
