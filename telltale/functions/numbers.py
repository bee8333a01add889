"""Number parsing and scaling expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number formats accepted in text input.
FLOAT_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
SPECIAL_PATTERN = r"^\s*[+-]?(nan|inf|infinity)\s*$"
INTEGER_PATTERN = r"^\s*[+-]?[0-9]+\s*$"


def stripped(text: Column) -> Column:
    """Without the white space around it, tabs and line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_double(text: Column) -> Column:
    """Text to double; null where the text is not a number. Accepts white space around it, exponents, ``nan`` and ``inf``."""
    word = F.lower(stripped(text))
    special = (
        F.when(word.contains("nan"), F.lit(math.nan))
        .when(word.startswith("-"), F.lit(-math.inf))
        .otherwise(F.lit(math.inf))
    )
    # A cast does not mind the white space that the pattern allows.
    return F.when(text.rlike(FLOAT_PATTERN), text.try_cast("double")).when(
        word.rlike(SPECIAL_PATTERN), special
    )


def parse_integer(text: Column) -> Column:
    """Text to int; null unless the whole text is an optionally signed run of digits."""
    return F.when(text.rlike(INTEGER_PATTERN), stripped(text).try_cast("int"))


def is_missing(value: Column) -> Column:
    return value.isNull() | F.isnan(value)


def is_infinite(value: Column) -> Column:
    return F.abs(value) == F.lit(math.inf)


def is_finite(value: Column) -> Column:
    return ~is_missing(value) & ~is_infinite(value)


def scaled(sensor: str, scaler: Mapping[str, tuple[float, float]]) -> Column:
    mean, scale = scaler[sensor]
    return (F.col(sensor) - F.lit(mean)) / F.lit(scale)


def unscaled(value: Column, sensor: str, scaler: Mapping[str, tuple[float, float]]) -> Column:
    mean, scale = scaler[sensor]
    return value * F.lit(scale) + F.lit(mean)
