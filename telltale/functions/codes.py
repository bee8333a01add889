"""Trouble-code lists, signatures and set similarity as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from telltale.schemas import CODE_PATTERN, CODES, NO_CODES, NO_FAULT_CODE


def active_codes(columns: Iterable[str], codes: Iterable[str] = CODES) -> Column:
    """Sorted list of the indicator columns that equal 1. Indicators missing from ``columns`` count as inactive."""
    present = set(columns)
    flags = [F.when(F.col(c) == 1, F.lit(c)) for c in sorted(codes) if c in present]
    if not flags:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*flags))


def signature(codes: Column) -> Column:
    """Codes joined by ``|`` in sorted order, repeated codes kept; ``NONE`` for an empty or absent list."""
    return F.when(F.coalesce(F.size(codes), F.lit(0)) <= 0, F.lit(NO_CODES)).otherwise(
        F.array_join(F.array_sort(codes), "|")
    )


def parse_code_list(text: Column) -> Column:
    """Read a list written as text, such as ``['P0403', 'P0404']``; anything unreadable gives an empty list."""
    return F.coalesce(
        F.from_json(F.translate(text, "'", '"'), "array<string>"), F.array().cast("array<string>")
    )


def extract_codes(text: Column) -> Column:
    """Codes that occur anywhere in a text, each once, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(f"({CODE_PATTERN})"), 1))


def is_queryable(code: Column) -> Column:
    """True for codes that deserve a knowledge lookup: not the no-fault code, not the placeholder, not blank."""
    return code.isNotNull() & ~code.isin(NO_FAULT_CODE, NO_CODES) & ~code.rlike(r"^\s*$")
