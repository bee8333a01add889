"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telltale.operators.ordinals import with_ordinal
from telltale.session import materialise

STEP_BITS, HASH_BITS = 12, 60
WORD_GAP = r"[\x20\t-\r]+"


def word_count(text: Column) -> Column:
    """Words are runs of anything but ASCII white space; a null text has none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\t-\r]+|[\x20\t-\r]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WORD_GAP))).cast("long")


def hash60(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key as text; a null key counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    Sources in code-point order, null last, get the weights in turn and share ``share`` times all sizes. Targets above ``most``
    times their source's size stop there and the excess is shared again by weight among the others, until none is above.
    """
    ordered = with_ordinal(sizes.withColumn("absent", F.col("source").isNull()), ["absent", "source"], "place")
    choice = F.array(*[F.lit(w) for w in weights])
    table = materialise(ordered.withColumn("weight", F.element_at(choice, (F.col("place") % len(weights) + 1).cast("int"))), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    budget, capped, cut = share * total, 0, None
    while True:
        # A source stops if its limit is at or below its share; the level only rises, so what stopped stays stopped.
        stop = F.lit(False) if cut is None else most * F.col("source_size") * cut[1] <= F.col("weight") * cut[0]
        row = table.agg(
            F.sum(F.when(stop, most * F.col("source_size")).otherwise(0)).alias("used"),
            F.sum(F.when(stop, 0).otherwise(F.col("weight"))).alias("weights"),
            F.sum(F.when(stop, 1).otherwise(0)).alias("stopped"),
        ).first()
        if cut is not None and row["stopped"] == capped or not row["weights"]:
            break
        capped, cut = row["stopped"], (float(budget - row["used"]), float(row["weights"]))
    free = F.col("weight") * F.lit(cut[0]) / F.lit(cut[1]) if cut else F.lit(0.0)
    stop = most * F.col("source_size") * F.lit(cut[1]) <= F.col("weight") * F.lit(cut[0]) if cut else F.lit(True)
    return table.select("source", "source_size", F.when(stop, (most * F.col("source_size")).cast("double")).otherwise(free).cast("double").alias("target"))


def _thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, whole, below)``: how often all of a source is taken, and under which hash once more.

    Sizes are summed by source and the first bits of the hash; the bucket in which the rest of the budget ends is found by
    a running sum over at most ``2 ** STEP_BITS`` buckets, and only its documents go to the next, finer histogram. When the
    bits end, a bucket is one hash: it is taken if that brings the sum nearer to the budget.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = targets.select(F.col("source").alias("_source"), whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("prefix"))
    for depth in range(HASH_BITS // STEP_BITS):
        state = materialise(state, f"budget-{depth}")
        right = HASH_BITS - (depth + 1) * STEP_BITS
        inside = sized.join(state, sized["source"].eqNullSafe(state["_source"]) & (F.shiftright("hash", right + STEP_BITS) == state["prefix"]))
        buckets = inside.groupBy("_source", F.shiftright("hash", right).alias("bucket")).agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
        running = W.partitionBy("_source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        summed = buckets.withColumn("upto", F.sum("size").over(running))
        last = depth + 1 == HASH_BITS // STEP_BITS
        over = F.col("upto") + (F.col("upto") - F.col("size")) >= 2 * F.col("rest") if last else F.col("upto") > F.col("rest")
        edge = summed.where(over).groupBy("_source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("size")).alias("before")), "bucket").alias("edge"))
        edge = edge.select(F.col("_source").alias("_s"), "edge")
        # Without such a bucket all documents below the prefix's end are taken.
        state = state.join(edge, F.col("_source").eqNullSafe(F.col("_s")), "left").select(
            "_source", "whole", (F.col("rest") - F.coalesce(F.col("edge.before"), F.lit(0))).alias("rest"),
            F.coalesce(F.col("edge.bucket"), F.shiftleft(F.col("prefix") + 1, STEP_BITS)).alias("prefix"),
        )
    return state.select(F.col("_source"), "whole", F.col("prefix").alias("below"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken`` and the columns of ``carry`` (a single struct is best).

    A source's documents are all taken as often as its target holds its size, and once more below a hash threshold that
    spends the rest. Thresholds grow with the target, so a smaller mix is part of a larger one. Documents of one id share a hash and are taken
    together. A null source is a source of its own; a null text has size 0; empty tables give an empty result.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), hash60(F.col(id_col)).alias("hash"), *carry
    )
    sized = materialise(rows.drop(*carry), "sizes")
    rows = rows if carry else sized
    targets = materialise(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    limits = _thresholds(sized, targets).join(targets, F.col("_source").eqNullSafe(F.col("source")), "inner").drop("source")
    limits = materialise(limits, "limits")
    times = F.col("whole") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0)
    return rows.join(limits, rows["source"].eqNullSafe(limits["_source"])).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.least(times, F.lit(most))).cast("long").alias("taken"), *carry
    )
