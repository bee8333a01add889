"""Helpers shared by the operators: narrow inputs, row numbers, held-out folds and bounded work units."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, as ``doc_id`` and ``text`` (UTF-8 bytes, null kept).

    Every other column is left out here, so extra columns can neither clash with an operator's own nor cost a read.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def crc_remainder(id_col: str, divisor: int) -> Column:
    """``crc32(id as text) mod divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor


def hash_share(id_col: str) -> Column:
    """A number in [0, 1) that depends on the id alone. ``hash_share < f`` draws the same rows in every run."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)


def first_row_number() -> int:
    """Start of a numbering of rows that is unique over all tasks of a stage."""
    return TaskContext.get().partitionId() << 33


def chunks(blobs: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a list into ranges of about ``limit`` bytes. A longer text makes a range of its own."""
    lo = size = 0
    for i, b in enumerate(blobs):
        if size and size + len(b) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(b)
    if lo < len(blobs):
        yield lo, len(blobs)


def small(batches, limit: int = 4 * CHUNK_BYTES):
    """The same rows in batches of about ``limit`` bytes, so that a task's memory doesn't depend on the session's batch size."""
    for batch in batches:
        rows = max(1, batch.num_rows * limit // max(limit, batch.nbytes))
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
