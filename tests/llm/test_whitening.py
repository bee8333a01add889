"""Whitened vectors against a direct computation."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from telltale.llm import whitening
from telltale.llm.queries import QUERIES


def direct(rows, most=16):
    """``{(id, component): (n, deviation, whitened, explained)}`` of ``(id, vector)`` rows; signs are free."""
    x = np.floor(64 * np.array([v for _, v in rows], float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    out = (x - sums / n) @ axes / np.sqrt(values)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    return {(i, c + 1): (n, int(deviation[k]), abs(out[k, c]), values[c] / np.trace(cov)) for k, (i, _) in enumerate(rows) for c in range(len(values))}


def compare(got, expected):
    assert len(got) == len(expected)
    for r in got:
        n, deviation, value, share = expected[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"]) == pytest.approx(value, abs=1e-7)
        assert r["explained"] == pytest.approx(share, rel=1e-9) and 0 <= r["identity_error"] < 1e-9


def test_whole_table(spark, sf_dir):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf_dir}/embeddings.parquet'").fetchall()
    got = QUERIES["op12_whitening"](spark, sf_dir).collect()
    compare(got, direct(rows))
    table = np.zeros((len(rows), 16))
    for r in got:
        table[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(table.T @ table / len(rows) - np.eye(16)).max() < 1e-9


@pytest.mark.parametrize("values", [1 << 16, 64])
def test_copies_count_once_and_blocks_of_any_height(spark, monkeypatch, values):
    monkeypatch.setattr(whitening, "BLOCK_VALUES", values)
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=5).tolist()) for i in range(90)] + [(100 + i, [0.5, 0.25, -1.0, 2.0, 0.0]) for i in range(60)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), components=3).collect()
    assert {r["n"] for r in got} == {91}
    compare(got, direct([(i, np.float32(v)) for i, v in rows], 3))


def test_odd_rows(spark):
    draw = np.random.default_rng(4)
    good = [(i, draw.normal(size=4).tolist()) for i in range(20)] + [(None, [1.0, 2.0, 3.0, 4.0])]
    nan, inf = float("nan"), float("inf")
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0, 3.0]), (53, [nan, 0.0, 0.0, 0.0]), (54, [0.0, inf, 0.0, 0.0]), (55, [1.0, 2.0]), (56, [1e300, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n", "'c' AS component", "2 AS x", "3 AS block")
    compare(whitening.whiten(frame).collect(), direct(good))
    empty = whitening.whiten(frame.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<double>")).count() == 0


def test_components_without_variance_give_no_rows(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0]) for i in range(10)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1.0)


def test_large_entries_keep_exact_deviations(spark):
    rows = [(0, [2.0**30, 0.0]), (1, [-(2.0**30), 1.0]), (2, [0.0, -1.0]), (3, [2.0**39, 0.0])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() if r["component"] == 1}
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v in rows]
    exact = [sum((4 * x[i][j] - sum(y[j] for y in x)) ** 2 for j in range(2)) for i in range(4)]
    assert [got[i] for i in range(4)] == [d if d < 2**63 else None for d in exact]
