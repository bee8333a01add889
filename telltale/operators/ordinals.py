"""Global 0-based positions without a single-task window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.session import materialise, shuffle_partitions

COPIES_PER_ROW = 65_536
ROWS_PER_RANGE = 500_000


def with_ordinal(df: DataFrame, order_by: list[str], name: str, start: int = 0) -> DataFrame:
    """Number the rows 0, 1, 2, … in the order of ``order_by``, which must identify a row.

    Rows are range-partitioned and sorted, so each task numbers its own range; only one offset per partition is then
    added. The sorted table is written once, since sampled range borders may differ between two runs of a plan.
    """
    slot = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(shuffle_partitions(df), *order_by).sortWithinPartitions(*order_by)
    stored = materialise(ranged.withColumn("_slot", slot), "ordinal")
    return _placed(stored, name, start)


def _placed(stored: DataFrame, name: str, start: int = 0) -> DataFrame:
    """``_slot``, the place of a row in its range, as its place in the table."""
    part = F.shiftright("_slot", 33).cast("int")
    sizes = {r["_part"]: r["n"] for r in stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    # One number per partition of the range shuffle, so they are a constant of the plan, counted once and not by each plan that reads the table.
    offsets, before = [], start
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(f"{before}L")
        before += sizes.get(p, 0)
    within = F.col("_slot").bitwiseAND((1 << 33) - 1)
    offset = F.get(F.expr(f"array({', '.join(offsets or ['0L'])})"), part)
    return stored.withColumn(name, (offset + within).cast("long")).drop("_slot")


def with_ordinal_of_copies(df: DataFrame, order_by: list[str], name: str, shown: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Like ``with_ordinal`` for large tables that may hold many identical rows, which are ordered by their other columns too.

    Identical rows can change places, so they are also ranged by the piece of the input that they lie in: a range border can fall among them, and no task
    gets all copies of a row. The rows move once, into ranges that a task sorts in memory, and ``shown`` of them is written. ``df`` is read twice and must give its rows in
    the same order each time, as files do.
    """
    rest = [c for c in df.columns if c not in order_by]
    ordering = [*order_by, *rest, "_piece"]
    pieces = df.withColumn("_piece", F.expr(f"monotonically_increasing_id() div {COPIES_PER_ROW}"))
    parts = max(shuffle_partitions(df), -(-df.count() // ROWS_PER_RANGE))
    ranged = pieces.repartitionByRange(parts, *ordering).sortWithinPartitions(*ordering).drop("_piece")
    stored = materialise((shown(ranged) if shown else ranged).withColumn("_slot", F.monotonically_increasing_id()), "ordinal")
    return _placed(stored, name)
