"""Input contracts: an ordered list of rules, of which the first broken one names the error of the row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telltale import schemas as S
from telltale.functions.numbers import parse_double, parse_integer


def _text(df: DataFrame, name: str) -> Column:
    """The column as text, or null when the table has no such column."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    return F.col(name).cast("string")


def _sensor_rules(df: DataFrame, sensors: Iterable[str]) -> list[Column]:
    rules = []
    for s in sensors:
        value = _text(df, s)
        rules.append(F.when(value.isNull(), F.lit(S.MSG_SENSOR_MISSING.format(s))))
        rules.append(F.when(parse_double(value).isNull(), F.lit(S.MSG_SENSOR_NUMERIC.format(s))))
    return rules


def _codes_are_list(df: DataFrame) -> bool:
    return "active_dtcs" not in df.columns or isinstance(df.schema["active_dtcs"].dataType, T.ArrayType)


def _integer(df: DataFrame, name: str) -> Column:
    """An integer column: text must be all digits, a fractional number is cut, as an integer conversion does."""
    if name in df.columns and isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
        return F.col(name).try_cast("int")
    return parse_integer(_text(df, name))


def incident_error(df: DataFrame, sensors: Iterable[str] = S.SENSORS) -> Column:
    """Contract of a whole incident: sensors in order, then the mode, then the code list. Null when all hold."""
    rules = _sensor_rules(df, sensors)
    rules.append(F.when(_text(df, S.MODE).isNull(), F.lit(S.MSG_MODE_MISSING)))
    rules.append(F.when(_integer(df, S.MODE).isNull(), F.lit(S.MSG_MODE_INTEGER)))
    if not _codes_are_list(df):
        rules.append(F.when(F.col("active_dtcs").isNotNull(), F.lit(S.MSG_CODES_LIST)))
    return F.coalesce(*rules, F.lit(None).cast("string"))


def similarity_error(df: DataFrame, sensors: Iterable[str] = S.SENSORS) -> Column:
    """Contract of the similarity search: mode and code list are required, the mode is taken as it is."""
    rules = _sensor_rules(df, sensors)
    rules.append(F.when(_text(df, S.MODE).isNull(), F.lit(S.MSG_MODE_MISSING)))
    if "active_dtcs" not in df.columns:
        rules.append(F.lit(S.MSG_STRICT_CODES_MISSING))
    else:
        rules.append(F.when(F.col("active_dtcs").isNull(), F.lit(S.MSG_STRICT_CODES_MISSING)))
        if not _codes_are_list(df):
            rules.append(F.lit(S.MSG_STRICT_CODES_LIST))
    return F.coalesce(*rules)


def anomaly_error(df: DataFrame, sensors: Iterable[str] = S.SENSORS) -> Column:
    """Contract of the anomaly check: sensors only."""
    return F.coalesce(*_sensor_rules(df, sensors))


def query_text_error(text: Column) -> Column:
    return F.when(text.isNull() | text.rlike(r"^\s*$"), F.lit(S.MSG_QUERY_EMPTY))


def error_envelope(message: Column, internal: Column | None = None) -> Column:
    """``struct<error, message>``; null when there is nothing to report. Contract failures win over internal ones."""
    internal = F.lit(None).cast("string") if internal is None else internal
    return F.when(
        message.isNotNull(), F.struct(F.lit(S.ERR_VALIDATION).alias("error"), message.alias("message"))
    ).when(internal.isNotNull(), F.struct(F.lit(S.ERR_INTERNAL).alias("error"), internal.alias("message")))


def typed_incidents(df: DataFrame, sensors: Iterable[str] = S.SENSORS) -> DataFrame:
    """Replace every input value by its parsed form; values that do not parse become null. An absent list is empty."""
    empty = F.array().cast("array<string>")
    codes = F.coalesce(F.col("active_dtcs"), empty) if "active_dtcs" in df.columns and _codes_are_list(df) else empty
    parsed = {s: parse_double(_text(df, s)) for s in sensors}
    parsed[S.MODE] = _integer(df, S.MODE)
    parsed["active_dtcs"] = codes
    return df.withColumns(parsed)
