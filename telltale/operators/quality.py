"""Data-quality counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telltale.functions.codes import active_codes, signature
from telltale.functions.numbers import is_infinite, is_missing, parse_double
from telltale.schemas import CODES, MODE, NO_CODES, NO_FAULT_CODE, SENSORS


def _total(conditions):
    one = [F.when(c, F.lit(1)).otherwise(F.lit(0)) for c in conditions]
    cells = one[0]
    for c in one[1:]:
        cells = cells + c
    return F.coalesce(F.sum(cells), F.lit(0)).cast("long")


def sensor_cell_counts(df: DataFrame, sensors: Iterable[str] = SENSORS) -> DataFrame:
    """Missing and infinite sensor cells, over all sensors, in one pass."""
    cols = [F.col(s) for s in sensors]
    return df.agg(
        _total([is_missing(c) for c in cols]).alias("missing_values"),
        _total([is_infinite(c) for c in cols]).alias("infinite_values"),
    )


def text_columns(df: DataFrame, sensors: Iterable[str] = SENSORS) -> list[str]:
    """Sensor columns that hold text instead of numbers."""
    return [s for s in sensors if isinstance(df.schema[s].dataType, T.StringType)]


def coerce_numeric(df: DataFrame, sensors: Iterable[str] = SENSORS) -> DataFrame:
    """Turn text sensor columns into doubles; values that are not numbers become null."""
    return df.withColumns({s: parse_double(F.col(s)) for s in text_columns(df, sensors)})


def non_numeric_report(df: DataFrame, sensors: Iterable[str] = SENSORS) -> DataFrame:
    """Per sensor: non-null cells that are not numbers, before coercion."""
    sensors = list(sensors)
    text = set(text_columns(df, sensors))
    bad = {s: F.col(s).isNotNull() & parse_double(F.col(s)).isNull() if s in text else F.lit(False) for s in sensors}
    counts = df.agg(*[_total([bad[s]]).alias(s) for s in sensors])
    rows = [F.struct(F.lit(s).alias("feature"), F.col(s).alias("bad_cells")) for s in sensors]
    return counts.select(F.inline(F.array(*rows)))


def no_fault_profile(df: DataFrame, codes: Iterable[str] = CODES) -> DataFrame:
    """Rows with only the no-fault code, with it beside others, and with no code at all."""
    active = active_codes(df.columns, codes)
    sig = signature(active)
    return df.agg(
        _total([sig == NO_FAULT_CODE]).alias("only_no_fault"),
        _total([F.array_contains(active, NO_FAULT_CODE) & (F.size(active) > 1)]).alias("mixed"),
        _total([sig == NO_CODES]).alias("no_codes"),
    )


def mode_values(df: DataFrame, order_by: str = "row_id") -> DataFrame:
    """Distinct modes with the position of their first appearance."""
    return df.groupBy(MODE).agg(F.min(order_by).alias("first_row"))


def content_groups(
    train: DataFrame, test: DataFrame, sensors: Iterable[str] = SENSORS, codes: Iterable[str] = CODES,
    order_by: str = "row_id",
) -> DataFrame:
    """One row per distinct content of both tables: ``train_rows``, ``test_rows`` and ``first_row``, the first in train.

    Content is every column of either table but ``order_by``. A column that one table lacks counts there as an inactive
    indicator or a missing value.

    This is the only shuffle of the raw tables. Copies are combined before it, so a content that fills a third of a table
    travels as one row per task.
    """
    keys = [c for c in dict.fromkeys([*train.columns, *test.columns]) if c != order_by]
    indicators = set(codes)

    def whole(df, other):
        absent = {c: (F.lit(0) if c in indicators else F.lit(None)).cast(other.schema[c].dataType) for c in keys if c not in df.columns}
        return df.withColumns(absent) if absent else df

    train, test = whole(train, test), whole(test, train)
    in_train, in_test = F.lit(1).alias("_train"), F.lit(1).alias("_test")
    none = F.lit(0)
    tagged = train.select(*keys, in_train, none.alias("_test"), F.col(order_by).alias("_row")).unionByName(
        test.select(*keys, none.alias("_train"), in_test, F.lit(None).cast("long").alias("_row"))
    )
    return tagged.groupBy(*keys).agg(
        F.sum("_train").alias("train_rows"), F.sum("_test").alias("test_rows"), F.min("_row").alias("first_row")
    )


def quality_report(
    train: DataFrame, test: DataFrame, sensors: Iterable[str] = SENSORS, codes: Iterable[str] = CODES
) -> DataFrame:
    """``(metric, value)`` rows of a train and a test table."""
    return report_of_groups(content_groups(train, test, sensors, codes), sensors, codes)


def report_of_groups(groups: DataFrame, sensors: Iterable[str] = SENSORS, codes: Iterable[str] = CODES) -> DataFrame:
    """The report from ``content_groups``: duplicates, overlap and cell counts all follow from the row counts."""
    sensors = list(sensors)

    def cells(test_cell):
        return sum((F.when(test_cell(F.col(s)), F.lit(1)).otherwise(F.lit(0)) for s in sensors), F.lit(0))

    in_train, in_test = F.col("train_rows") > 0, F.col("test_rows") > 0
    active = active_codes(groups.columns, codes)
    marked = groups.select(
        MODE, "train_rows", "test_rows", cells(is_missing).alias("_missing"), cells(is_infinite).alias("_infinite"),
        signature(active).alias("_sig"),
        (F.array_contains(active, NO_FAULT_CODE) & (F.size(active) > 1)).alias("_mixed"),
    )
    values = {
        "train_rows": F.sum("train_rows"),
        "train_clean_rows": F.count(F.when(in_train, 1)),
        "train_duplicates": F.sum(F.when(in_train, F.col("train_rows") - 1).otherwise(0)),
        "test_rows": F.sum("test_rows"),
        "test_duplicates": F.sum(F.when(in_test, F.col("test_rows") - 1).otherwise(0)),
        "train_test_overlap": F.count(F.when(in_train & in_test, 1)),
        "train_missing": F.sum(F.col("_missing") * F.col("train_rows")),
        "train_infinite": F.sum(F.col("_infinite") * F.col("train_rows")),
        "test_missing": F.sum(F.col("_missing") * F.col("test_rows")),
        "test_infinite": F.sum(F.col("_infinite") * F.col("test_rows")),
        "only_no_fault": F.count(F.when(in_train & (F.col("_sig") == NO_FAULT_CODE), 1)),
        "no_fault_mixed": F.count(F.when(in_train & F.col("_mixed"), 1)),
        "no_codes": F.count(F.when(in_train & (F.col("_sig") == NO_CODES), 1)),
    }
    per_mode = marked.groupBy(MODE).agg(*[v.alias(m) for m, v in values.items()])
    totals = per_mode.agg(
        *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in values],
        F.count(F.when((F.col("train_clean_rows") > 0) & F.col(MODE).isNotNull(), 1)).alias("modes"),
    )
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("value")) for m in [*values, "modes"]]
    return totals.select(F.inline(F.array(*rows)))


def report_markdown(report: DataFrame, modes: DataFrame) -> str:
    """Text form of a report: about fifteen metric rows and the observed modes."""
    lines = ["# Data quality", "", "| Metric | Value |", "|---|---|"]
    lines += [f"| {r['metric']} | {r['value']} |" for r in report.collect()]
    seen = [str(r[MODE]) for r in modes.orderBy("first_row").collect()]
    return "\n".join([*lines, "", f"Observed modes: {', '.join(seen)}", ""])
