"""Exact percentiles, linearly interpolated, for tables of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BRACKET_ROWS = 100_000
_ACCURACY = 10_000


def exact_percentiles(
    df: DataFrame, columns: list[str], levels: list[float], bracket_rows: int = BRACKET_ROWS
) -> dict[str, list[float | None]]:
    """Percentiles per column, equal to sorting the column and interpolating; nulls and NaNs are ignored.

    A value lies between two order statistics; both are fetched and interpolated by one expression, whatever the size of the table. Sketches give a
    bracket around each wanted rank; counting confirms the bracket and it is narrowed until at most ``bracket_rows`` rows
    are left in it, and only those are sorted. A small table is its own bracket.
    """
    df = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns])
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    found: dict[tuple[str, int], float | None] = {}
    # Wanted ranks (0-based) and the open brackets (low, high, rows below low, rows inside).
    wanted = {}
    for c in columns:
        for q in levels:
            if counts[c] == 0:
                found[c, -1] = None
                continue
            at = q * (counts[c] - 1)
            for rank in {math.floor(at), math.ceil(at)}:
                wanted[c, rank] = (-math.inf, math.inf, 0, counts[c])
    while wanted:
        for key in [k for k, (lo, hi, _, _) in wanted.items() if lo == hi]:
            found[key] = wanted.pop(key)[0]
        if all(n <= bracket_rows for _, _, _, n in wanted.values()):
            break
        wanted = _narrow(df, wanted)
    if wanted:
        found.update(_pick(df, wanted))
    result = {}
    for c in columns:
        out = []
        for q in levels:
            if counts[c] == 0:
                out.append(None)
                continue
            at = q * (counts[c] - 1)
            low, high = found[c, math.floor(at)], found[c, math.ceil(at)]
            out.append(low + (high - low) * (at - math.floor(at)))
        result[c] = out
    return result


def _inside(c: str, lo: float, hi: float):
    return F.when((F.col(c) >= F.lit(lo)) & (F.col(c) <= F.lit(hi)), F.col(c))


def _narrow(df: DataFrame, wanted: dict) -> dict:
    keys = list(wanted)
    aggs = []
    for i, (c, rank) in enumerate(keys):
        lo, hi, below, n = wanted[c, rank]
        at, slack = (rank - below) / max(n - 1, 1), 2.0 / _ACCURACY + 2.0 / n
        marks = [max(0.0, at - slack), min(1.0, at + slack)]
        aggs.append(F.percentile_approx(_inside(c, lo, hi), marks, _ACCURACY).alias(f"b{i}"))
    sketches = df.agg(*aggs).first()
    aggs, proposed = [], []
    for i, (c, rank) in enumerate(keys):
        lo, hi, below, n = wanted[c, rank]
        a, b = sketches[f"b{i}"]
        proposed.append((a, b))
        aggs += [
            F.count(F.when(F.col(c) < F.lit(a), 1)).alias(f"u{i}"),
            F.count(_inside(c, a, b)).alias(f"n{i}"),
        ]
    exact = df.agg(*aggs).first()
    out = {}
    for i, key in enumerate(keys):
        lo, hi, below, n = wanted[key]
        a, b = proposed[i]
        under, inside = exact[f"u{i}"], exact[f"n{i}"]
        if under <= key[1] < under + inside and inside < n:
            out[key] = (a, b, under, inside)
        elif under <= key[1] < under + inside and a == b:
            out[key] = (a, a, under, inside)
        else:
            # The sketch could not narrow this one: halve the value range instead.
            out[key] = _halve(df, key, wanted[key])
    return out


def _halve(df: DataFrame, key, bracket):
    c, rank = key
    lo, hi, below, n = bracket
    ends = df.agg(F.min(_inside(c, lo, hi)).alias("a"), F.max(_inside(c, lo, hi)).alias("b")).first()
    a, b = ends["a"], ends["b"]
    middle = a + (b - a) / 2
    left = df.agg(F.count(_inside(c, a, middle)).alias("n"), F.max(_inside(c, a, middle)).alias("m")).first()
    if rank < below + left["n"]:
        return (a, left["m"], below, left["n"])
    right = df.agg(F.min(F.when((F.col(c) > middle) & (F.col(c) <= b), F.col(c)))).first()[0]
    return (right, b, below + left["n"], n - left["n"])


def _pick(df: DataFrame, wanted: dict) -> dict:
    """Sort the rows left in the brackets, each bracket once. Equal values are counted first, so each holds a bounded group."""
    ranks: dict[tuple, list[tuple]] = {}
    for (c, rank), (lo, hi, below, _) in wanted.items():
        ranks.setdefault((c, lo, hi), []).append((rank - below, (c, rank)))
    entries = [
        F.when(_inside(c, lo, hi).isNotNull(), F.struct(F.lit(i).alias("i"), F.col(c).alias("v"))) for i, (c, lo, hi) in enumerate(ranks)
    ]
    values = df.select(F.inline(F.array_compact(F.array(*entries)))).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("i").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    targets = F.array(*[F.array(*[F.lit(at).cast("long") for at, _ in own]) for own in ranks.values()])
    hit = values.withColumn("upto", upto).withColumn("at", F.explode(F.element_at(targets, F.col("i") + 1)))
    hit = hit.filter((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n")))
    keys = [dict(own) for own in ranks.values()]
    return {keys[r["i"]][r["at"]]: r["v"] for r in hit.collect()}
