"""Similarity join of code lists: every pair of lists whose Jaccard similarity is at least a given number, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telltale.schemas import NO_CODES, NO_FAULT_CODE
from telltale.session import materialise


def is_clear(codes: Column) -> Column:
    """True for a list that says there is no fault; such a list is all that a list without codes resembles."""
    return F.forall(codes, lambda c: c == NO_FAULT_CODE) | ((F.size(codes) == 1) & (codes[0] == NO_CODES))


def code_similarities(left: DataFrame, right: DataFrame, least: float = 0.0, codes_col: str = "active_dtcs") -> DataFrame:
    """``left_codes, right_codes, similarity`` of all pairs of distinct lists with a similarity above 0 and of ``least`` or more.

    A list is compared as the sorted set of its codes; a null list is left out. Two lists that reach ``least`` differ little in length and share one of the
    rarest codes of each, so lists meet through an index of just those codes (prefix filter; Bayardo, Ma and Srikant, 2007). An empty list on the left is fully similar to the lists on the right that say there is no fault and to
    nothing else; those pairs are an equi-join of their own.
    """
    if not 0 <= least <= 1:
        raise ValueError("least must be between 0 and 1.")
    lists = {}
    for side, df in (("left", left), ("right", right)):
        codes = F.array_sort(F.array_distinct(codes_col))
        lists[side] = df.where(F.col(codes_col).isNotNull()).select(codes.alias(f"{side}_codes")).distinct()
        lists[side] = materialise(lists[side].withColumn(f"{side}_list", F.monotonically_increasing_id()), "code-lists")
    every = lists["left"].select(F.explode("left_codes").alias("code")).unionAll(lists["right"].select(F.explode("right_codes").alias("code")))
    rarity = every.groupBy("code").agg(F.count(F.lit(1)).alias("n"))

    def index(side: str) -> DataFrame:
        """The rarest codes of each list, as many as two lists can't both miss."""
        exploded = lists[side].select(f"{side}_list", F.size(f"{side}_codes").alias(f"{side}_size"), F.explode(f"{side}_codes").alias("code")).join(rarity, "code")
        if least == 0:
            return exploded.select(f"{side}_list", f"{side}_size", "code")
        # At most the codes of one list per group.
        ordered = exploded.groupBy(f"{side}_list", f"{side}_size").agg(F.array_sort(F.collect_list(F.struct("n", "code"))).alias("codes"))
        size = F.col(f"{side}_size")
        kept = (size - F.ceil(F.lit(least) * size - 1e-9) + 1).cast("int")
        return ordered.select(f"{side}_list", f"{side}_size", F.explode(F.slice("codes", F.lit(1), kept)["code"]).alias("code"))

    met = index("left").join(index("right"), "code")
    if least > 0:
        met = met.where((F.col("left_size") * (1 + 1e-9) >= F.lit(least) * F.col("right_size")) & (F.col("right_size") * (1 + 1e-9) >= F.lit(least) * F.col("left_size")))
    pairs = met.groupBy("left_list", "right_list", "left_size", "right_size").agg(F.count(F.lit(1)).alias("shared"))
    joined = pairs.join(lists["left"], "left_list").join(lists["right"], "right_list")
    # With prefixes, only some of the shared codes have met.
    shared = F.col("shared") if least == 0 else F.size(F.array_intersect("left_codes", "right_codes"))
    similarity = shared / (F.col("left_size") + F.col("right_size") - shared)
    found = joined.select("left_codes", "right_codes", similarity.alias("similarity")).where(F.col("similarity") >= F.lit(least) - 1e-12)
    blank = lists["left"].where(F.size("left_codes") == 0).select("left_codes", F.lit(True).alias("clear"))
    clear = lists["right"].where(is_clear(F.col("right_codes"))).select("right_codes", F.lit(True).alias("clear"))
    return found.unionByName(blank.join(clear, "clear").select("left_codes", "right_codes", F.lit(1.0).alias("similarity")))
