"""Positions, percentiles, forest and vectors against plain computations on the fixture."""

from __future__ import annotations

import hashlib
import math
import os
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from telltale import fixtures as X
from telltale.operators import forest as FOR
from telltale.operators import ordinals as ORD
from telltale.operators.percentiles import exact_percentiles
from telltale.functions.numbers import parse_double
from telltale.functions.validation import query_text_error
from telltale.plans.preprocess import preprocess
from telltale.session import materialise, scratch_scope
from telltale.operators.quality import content_groups, report_of_groups
from telltale.operators import vectors as VEC
from telltale.operators.vectors import fit_encoder, nearest
from telltale.schemas import SENSORS
from telltale.workload import queries as W

Z = ["z_" + s for s in SENSORS]


def test_ordinal_is_dense_and_ordered(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 10007).alias("key")).repartition(5)
    rows = ORD.with_ordinal(df, ["key"], "n", start=10).orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(10, 1010))
    assert [r["key"] for r in rows] == sorted(r["key"] for r in rows)


@pytest.mark.parametrize("piece", [65_536, 64])
def test_ordinal_of_copies(spark, monkeypatch, piece):
    """A third of all rows is one content; positions stay dense and in order."""
    monkeypatch.setattr(ORD, "COPIES_PER_ROW", piece)
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11).alias("key"), F.lit("x").alias("v"))
    rows = ORD.with_ordinal_of_copies(df, ["key"], "n").orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(900))
    assert [r["key"] for r in rows] == sorted(r["key"] for r in df.collect())


def test_copies_move_once_and_are_dealt_out(spark, monkeypatch, tmp_path):
    """One content in 4,000 of 5,000 rows: one shuffle, of which no task gets more than a few pieces of the copies; only what is shown is written."""
    monkeypatch.setattr(ORD, "COPIES_PER_ROW", 64)
    spark.range(5000).select(F.when(F.col("id") < 4000, 5).otherwise(F.col("id")).alias("key"), F.lit("x").alias("v")).repartition(8).write.parquet(f"{tmp_path}/t")
    df, written = spark.read.parquet(f"{tmp_path}/t"), []

    def keep(stored, name):
        written.append(stored)
        return materialise(stored, name)

    monkeypatch.setattr(ORD, "materialise", keep)
    rows = ORD.with_ordinal_of_copies(df, ["key"], "n", lambda d: d.select((F.col("key") * 2).alias("twice"))).orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(5000)) and [r["twice"] for r in rows] == sorted(2 * r["key"] for r in df.collect())
    assert len(written) == 1 and written[0].columns == ["twice", "_slot"]
    assert written[0]._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1 and "Aggregate" not in written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert max(r["count"] for r in written[0].groupBy(F.spark_partition_id()).count().collect()) < 2000


def test_percentiles_by_brackets(spark, sf_dir):
    values = W.prepared(spark, sf_dir).train.select(*Z).withColumn("hot", F.when(F.col("z_RPM") > 0, 1.5).otherwise(F.col("z_ECT")))
    columns = [*Z, "hot"]
    levels = [0.01, 0.05, 0.5, 0.95, 1.0]
    got = exact_percentiles(values, columns, levels, bracket_rows=20)
    frame = values.toPandas()
    for c in columns:
        assert np.allclose(got[c], np.percentile(frame[c], [100 * q for q in levels]), atol=1e-12)
    direct = exact_percentiles(values, columns, levels)
    assert direct == got  # bit for bit


def test_percentiles_without_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, float("nan"))], "a double, b double")
    assert exact_percentiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [1.0]}


def test_counts_of_bad_cells(spark):
    row = {s: 1.0 for s in SENSORS} | {"Mode": 1, "P0403": 1}
    rows = [(0, {"RPM": None}), (1, {"RPM": float("nan")}), (2, {"ECT": float("inf")}), (3, {}), (4, {})]
    schema = "row_id long, " + ", ".join(f"{s} double" for s in SENSORS) + ", Mode int, P0403 int"
    df = spark.createDataFrame([{**row, "row_id": i, **change} for i, change in rows], schema)
    report = {r["metric"]: r["value"] for r in report_of_groups(content_groups(df, df.filter("row_id > 2"))).collect()}
    assert report["train_missing"] == 2 and report["train_infinite"] == 1 and report["test_missing"] == 0
    assert report["train_rows"] == 5 and report["train_duplicates"] == 1 and report["test_duplicates"] == 1
    assert report["train_test_overlap"] == 1


# --- Forest ---


def _plain_score(nodes: pd.DataFrame, values: np.ndarray, size: int) -> np.ndarray:
    lengths = np.zeros((len(values), nodes["tree"].nunique()))
    for t, (_, part) in enumerate(nodes.groupby("tree")):
        table = {r.node: r for r in part.itertuples()}
        for i, row in enumerate(values):
            node, depth = table[1], 0
            while node.left >= 0:
                node, depth = table[node.left if row[node.feature] <= node.threshold else node.right], depth + 1
            lengths[i, t] = depth + FOR.average_path(node.n)
    return -(2.0 ** (-lengths.mean(axis=1) / FOR.average_path(size)))


def test_forest_shape(spark, sf_dir):
    forest = W.model(spark, sf_dir).forest
    nodes = forest.nodes.toPandas()
    assert nodes["tree"].nunique() == 100 and forest.sample_size == 256
    for _, part in nodes.groupby("tree"):
        leaves = part[part["left"] < 0]
        assert leaves["n"].sum() == 256 and (leaves["n"] > 0).all()
        depth = {1: 0}
        for r in part.sort_values("node").itertuples():
            if r.left >= 0:
                depth[r.left] = depth[r.right] = depth[r.node] + 1
        assert max(depth.values()) <= 8


def test_forest_is_reproducible(spark, sf_dir):
    history = W.prepared(spark, sf_dir).train.select("historical_index", *Z)
    a = FOR.fit_forest(history.repartition(3), trees=10)
    b = FOR.fit_forest(history.repartition(11, "z_RPM"), trees=10)
    order = ["tree", "node"]
    pd.testing.assert_frame_equal(
        a.nodes.toPandas().sort_values(order).reset_index(drop=True),
        b.nodes.toPandas().sort_values(order).reset_index(drop=True),
    )
    assert a.offset == pytest.approx(b.offset, abs=1e-12)


def test_forest_scores(spark, sf_dir):
    forest = W.model(spark, sf_dir).forest
    scored = FOR.with_forest_score(W.prepared(spark, sf_dir).train.select(*Z), forest, Z).toPandas()
    assert ((scored["forest_score"] > -1) & (scored["forest_score"] < 0)).all()
    assert abs((scored["forest_score"] < forest.offset).mean() - 0.01) < 0.002
    some = scored.iloc[::97]
    assert np.allclose(_plain_score(forest.nodes.toPandas(), some[Z].to_numpy(), 256), some["forest_score"], atol=1e-9)


def test_samples_of_a_large_table(spark):
    """More rows than any sample: the draws are those of the plain rule, whatever the partitioning."""
    rows = 150_000
    df = spark.range(rows).withColumnRenamed("id", "historical_index")
    picked = FOR.draw_samples(df.repartition(7), "historical_index", [], trees=7, size=32).collect()
    numbers = [int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:15], 16) for i in range(rows)]
    for tree in range(7):
        a, b, c = (1 + FOR._digits(f"42:{tree}:{x}", 8) % (FOR.PRIME - 1) for x in "abc")
        draws = [((a * (n >> 30) + b * (n & (2**30 - 1)) + c) % FOR.PRIME, i) for i, n in enumerate(numbers)]
        assert {r.historical_index for r in picked if r.tree == tree} == {i for _, i in sorted(draws)[:32]}


def test_samples_follow_no_period_of_the_table(spark):
    """A sample holds about as many phases of a period as a random one, and two trees share about as many rows as chance gives."""
    rows, size = 60_000, 256
    picked = FOR.draw_samples(spark.range(rows).withColumnRenamed("id", "historical_index"), "historical_index", [], trees=40, size=size).toPandas()
    groups = [set(part["historical_index"]) for _, part in picked.groupby("tree")]
    assert all(len(g) == size for g in groups)
    for period, least in ((60, 54), (1000, 205)):
        random = period * (1 - (1 - 1 / period) ** size)
        phases = [len({i % period for i in g}) for g in groups]
        assert min(phases) >= least and abs(np.mean(phases) - random) < 0.03 * random
    gaps = [len(set(np.diff(sorted(g)))) for g in groups]
    assert min(gaps) > 150
    shared = [len(a & b) for i, a in enumerate(groups) for b in groups[:i]]
    assert np.mean(shared) < 3 * size * size / rows and max(shared) < 15


def test_fewer_rows_than_a_sample(spark):
    picked = FOR.draw_samples(spark.range(20).withColumnRenamed("id", "historical_index"), "historical_index", [], trees=3, size=100)
    assert [r["count"] for r in picked.groupBy("tree").count().collect()] == [20] * 3


# --- Vectors ---


def test_neighbours_by_blocks(spark, sf_dir):
    """Blocks, broadcast and brute force agree, also with a third of the documents being copies."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    one = vectors.filter("doc_id = 3").select("embedding")
    copies = spark.range(1000, 1250).withColumnRenamed("id", "doc_id").crossJoin(one)
    docs = vectors.unionByName(copies)
    queries = vectors.select(F.col("doc_id").alias("query_id"), "embedding", (F.col("doc_id") % 9).cast("int").alias("k"))
    pieces = nearest(queries, docs, broadcast_values=10, block_rows=90).collect()
    few = queries.filter("query_id < 20")
    by_query = nearest(few, docs.repartition(5), broadcast_values=20 * len(one.first()[0])).collect()
    whole = nearest(queries, docs).collect()

    def key(rows):
        return {(r["query_id"], r["neighbour_rank"], r["doc_id"]) for r in rows}

    assert key(pieces) == key(whole)
    assert key(by_query) == {x for x in key(whole) if x[0] < 20}
    d = docs.orderBy("doc_id").toPandas()
    matrix = np.array(d["embedding"].tolist(), dtype=float)
    expected = set()
    for q in queries.collect():
        squared = ((matrix - np.array(q["embedding"])) ** 2).sum(axis=1)
        for rank, at in enumerate(np.argsort(squared, kind="stable")[: q["k"]]):
            expected.add((q["query_id"], rank + 1, int(d["doc_id"][at])))
    assert key(whole) == expected


def test_pivot_cells_equal_brute_force_and_visit_few_cells(spark):
    """Clustered vectors, a third of them equal: the exact neighbours, and a query visits far fewer cells than there are."""
    draw = np.random.default_rng(5)
    centres = draw.normal(scale=20, size=(40, 8))
    vectors = [(centres[i % 40] + draw.normal(size=8)).tolist() for i in range(1200)] + [centres[0].tolist()] * 600
    docs = spark.createDataFrame(list(enumerate(vectors)), "doc_id long, embedding array<double>").repartition(6)
    asked = [(i, (centres[i % 40] + draw.normal(size=8)).tolist(), 1 + i % 7) for i in range(200)] + [(900, centres[0].tolist(), 700), (901, [0.0] * 8, 2000), (902, centres[1].tolist(), 0)]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>, k int")
    got = {}
    for r in nearest(queries, docs, broadcast_values=500, block_rows=100).collect():
        got.setdefault(r["query_id"], []).append((r["neighbour_rank"], r["doc_id"]))
    table = np.array(vectors)
    expected = {}
    for q, v, k in asked:
        best = np.argsort(((table - np.array(v)) ** 2).sum(axis=1), kind="stable")[:k]
        if k:
            expected[q] = [(n + 1, int(d)) for n, d in enumerate(best)]
    assert {q: sorted(rows) for q, rows in got.items()} == expected
    cells = VEC.PivotCells(docs, 40, 8, 100)
    bound = queries.filter("query_id < 200").withColumn("bound", F.lit(8.0))
    visits = cells.visits(bound, "bound").count()
    assert 200 <= visits + 200 <= 0.15 * 200 * len(cells.pivots)
    far = VEC._distances(pd.Series(vectors), cells.pivots)
    direct = np.sqrt(((table[:, None, :] - cells.pivots[None, :, :]) ** 2).sum(axis=2))
    assert np.abs(far - direct).max() < 1e-9


@pytest.mark.parametrize("values", [VEC.BLOCK_VALUES, 800])
def test_vectors_without_clusters_travel_by_blocks(spark, monkeypatch, values):
    """The exact neighbours, copies and a cell larger than a part included, and no row per query and cell it visits."""
    monkeypatch.setattr(VEC, "BLOCK_VALUES", values)
    visits = VEC.PivotCells.visits
    monkeypatch.setattr(VEC.PivotCells, "visits", lambda self, queries, bound: visits(self, queries, {None: None}[bound]))
    draw = np.random.default_rng(7)
    vectors = [*draw.normal(size=(500, 8)).tolist(), *[[0.25] * 8] * 200]
    docs = spark.createDataFrame(list(enumerate(vectors)), "doc_id long, embedding array<double>").repartition(4)
    asked = [(i, draw.normal(size=8).tolist(), 1 + i % 6) for i in range(150)] + [(900, [0.25] * 8, 300), (901, [9.0] * 8, 2000)]
    got = {}
    for r in nearest(spark.createDataFrame(asked, "query_id long, embedding array<double>, k int"), docs, broadcast_values=500, block_rows=60).collect():
        got.setdefault(r["query_id"], []).append((r["neighbour_rank"], r["doc_id"]))
    table = np.array(vectors)
    for q, v, k in asked:
        best = np.argsort(((table - np.array(v)) ** 2).sum(axis=1), kind="stable")[:k]
        assert sorted(got[q]) == [(n + 1, int(d)) for n, d in enumerate(best)]


def test_no_vector_is_copied_for_the_blocks_it_meets(spark, monkeypatch):
    """With many parts of documents nothing is shuffled, what is written has a row per vector and goes when it is read, and each query has its own answer, also where ids repeat or are null."""
    monkeypatch.setattr(VEC, "BLOCK_VALUES", 400)
    monkeypatch.setattr(VEC, "release", lambda df, plain=VEC.release: (sizes.append(df.count()), plain(df))[1])
    draw, sizes = np.random.default_rng(17), []
    vectors = draw.normal(size=(300, 8)).astype(np.float32)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "doc_id long, embedding array<float>")
    asked = [(None if i % 10 == 0 else i // 3, draw.normal(size=8).astype(np.float32).tolist(), 1 + i % 4) for i in range(200)]
    near = nearest(spark.createDataFrame(asked, "query_id long, embedding array<float>, k int"), docs, broadcast_values=100, block_rows=40)
    assert "Exchange" not in near._jdf.queryExecution().sparkPlan().toString()
    assert len(sizes) > 6 and max(sizes) <= 300
    assert {os.path.dirname(f).rpartition("/")[2][:11] for f in near.inputFiles()} == {"best-so-far"}
    expected = []
    for q, v, k in asked:
        gap = ((vectors.astype(float) - np.array(v, np.float32)) ** 2).sum(axis=1)
        expected += [(q, n + 1, int(d), round(float(gap[d]), 9)) for n, d in enumerate(np.argsort(gap, kind="stable")[:k])]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))
    assert order((r["query_id"], r["neighbour_rank"], r["doc_id"], round(r["squared_distance"], 9)) for r in near.collect()) == order(expected)


@pytest.mark.parametrize("scale", [1e-12, 1.0, 1e12])
def test_parts_measure_what_rounding_hides(spark, scale):
    """Vectors far from the origin and close to each other, copies, and k above the number of documents, in 4-byte numbers of any size."""
    draw = np.random.default_rng(19)
    vectors = (scale * (1000 + draw.normal(size=(400, 6)).round(2))).astype(np.float32)
    vectors[100:180] = vectors[7]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, vectors[i].tolist(), (3, 90, 500)[i % 3]) for i in range(0, 60)], "query_id long, embedding array<float>, k int")
    got = {}
    for r in nearest(queries, docs, broadcast_values=50, block_rows=64).collect():
        got.setdefault(r["query_id"], []).append((r["neighbour_rank"], r["doc_id"]))
    for i in range(60):
        gap = ((vectors.astype(float) - vectors[i].astype(float)) ** 2).sum(axis=1)
        assert sorted(got[i]) == [(n + 1, int(d)) for n, d in enumerate(np.argsort(gap, kind="stable")[: (3, 90, 500)[i % 3]])]


def test_words_are_placed_as_their_digests_say(spark):
    texts = [None, "", "...", "Ab ab_1 x", "\u00c4b c", "ab " * 300, "x", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).orderBy("i").select(VEC.dimensions_of(F.col("t"), 512).alias("d")).collect()
    place = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 512
    assert [list(r["d"]) for r in rows] == [[place(w) for w in re.findall("[a-z0-9_]+", (t or "").lower())] for t in texts]


def test_vectors_of_texts_keep_no_texts(spark, sf_dir):
    docs, _ = W.knowledge_base(spark, sf_dir)
    assert docs.columns == ["doc_id", "embedding"] and all("/knowledge-base-" in f for f in docs.inputFiles())


def test_buckets_measure_by_blocks_without_a_row_per_pair(spark, monkeypatch):
    """Vectors without clusters, ties and copies, buckets larger than a block: the k best among all that share a bucket, and few measured rows leave a task."""
    made = []
    plain = VEC._measured
    monkeypatch.setattr(VEC, "_measured", lambda *a: made.append(materialise(plain(*a), "measured")) or made[-1])
    monkeypatch.setattr(VEC, "ASKED_ROWS", 50)
    monkeypatch.setattr(VEC, "BLOCK_VALUES", 400)
    draw = np.random.default_rng(9)
    vectors = [*draw.normal(size=(500, 4)).round(1).tolist(), *[[0.5] * 4] * 60]
    docs = spark.createDataFrame(list(enumerate(vectors)), "doc_id long, embedding array<double>").repartition(3)
    queries = docs.select(F.col("doc_id").alias("query_id"), "embedding", F.lit(3).alias("k"))
    found: dict = {}
    for r in VEC.approximate_nearest(queries, docs, hashes=1, reach=1000.0).collect():
        found.setdefault(r["query_id"], []).append((r["neighbour_rank"], r["doc_id"]))
    table = np.array(vectors)
    for q, v in enumerate(vectors):
        best = np.argsort(((table - np.array(v)) ** 2).sum(axis=1), kind="stable")[:3]
        assert sorted(found[q]) == [(n + 1, int(d)) for n, d in enumerate(best)]
    assert made[0].count() < 0.5 * len(vectors) * len({tuple(v) for v in vectors}) * 8


def test_no_vector_travels_for_its_buckets(spark, monkeypatch):
    """What the search by buckets writes of either side has a row per vector, however many buckets that is in or asks; nothing is shuffled, and vectors that share none aren't found."""
    made, sizes = [], []
    monkeypatch.setattr(VEC, "_measured", lambda *a, plain=VEC._measured: made.append(plain(*a)) or made[-1])
    monkeypatch.setattr(VEC, "release", lambda df, plain=VEC.release: (sizes.append(df.count()), plain(df))[1])
    monkeypatch.setattr(VEC, "BLOCK_VALUES", 1000)
    draw = np.random.default_rng(23)
    vectors = np.concatenate([draw.normal(size=(150, 6)), 1e6 + draw.normal(size=(150, 6))]).tolist()
    docs = spark.createDataFrame(list(enumerate(vectors)), "doc_id long, embedding array<double>")
    queries = docs.select(F.col("doc_id").alias("query_id"), "embedding", F.lit(200).alias("k"))
    found = VEC.approximate_nearest(queries, docs, hashes=1, reach=100.0).collect()
    assert sizes == [300, 300] and "Exchange" not in made[0]._jdf.queryExecution().sparkPlan().toString()
    assert len(made[0].inputFiles()) > 1 and {(r["query_id"], r["doc_id"]) for r in found} == {(i, j) for i in range(300) for j in range(300) if i // 150 == j // 150}


def test_telemetry_is_written_once(spark, sf_dir):
    assert all("/ordinal-" in f for f in X.telemetry(spark, sf_dir).inputFiles())


def test_hybrid_retrieval_stores_no_texts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(W, "docs_of", None)
    assert W.hybrid_retrieve(spark, sf_dir).count() > 0


def test_buckets_find_neighbours_and_skip_the_rest(spark):
    """Clustered vectors, a third of them copies: at least nine in ten exact neighbours, with exact distances, from few candidates."""
    draw = np.random.default_rng(6)
    centres = draw.normal(scale=20, size=(30, 16))
    vectors = [(centres[i % 30] + draw.normal(size=16)).tolist() for i in range(900)] + [centres[3].tolist()] * 450
    docs = spark.createDataFrame(list(enumerate(vectors)), "doc_id long, embedding array<double>").repartition(4)
    asked = [(i, (centres[i % 30] + draw.normal(size=16)).tolist(), 1 + i % 5) for i in range(150)] + [(500, centres[3].tolist(), 400), (501, [float("nan")] * 16, 3), (502, None, 3)]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>, k int")
    exact = {(r["query_id"], r["doc_id"]): r["squared_distance"] for r in nearest(queries, docs).collect()}
    found = {(r["query_id"], r["doc_id"]): r["squared_distance"] for r in VEC.approximate_nearest(queries, docs).collect()}
    assert len(exact.keys() & found.keys()) >= 0.9 * len(exact)
    assert all(found[p] == pytest.approx(exact[p]) for p in exact.keys() & found.keys())
    assert sorted(d for q, d in found if q == 500) == list(range(900, 1300))
    buckets = VEC.Buckets(16, 12.0, 8, 3, 1)
    keys, others = buckets.keys(np.array(vectors[:30]), 4), buckets.keys(np.array(vectors[30:900]), 0)
    meet = sum(np.isin(others[:, t, 0], keys[0, t]) for t in range(8)) > 0
    assert 0 < meet.sum() < 0.5 * len(meet) and VEC.approximate_nearest(queries, docs.limit(0)).count() == 0


@pytest.mark.parametrize("values", [VEC.BROADCAST_VALUES, 30, 1])
def test_bad_vectors_change_only_their_own_rows(spark, values):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i), 1.0, 0.0]) for i in range(12)]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [nan, 0.0, 0.0]), (54, [0.0, inf, 0.0]), (55, [1.0, 2.0])]
    docs = spark.createDataFrame(good + bad, "doc_id long, embedding array<double>")
    queries = docs.withColumnRenamed("doc_id", "query_id").withColumn("k", F.lit(2))
    rows = nearest(queries, docs, broadcast_values=values, block_rows=5).collect()
    found = {(r["query_id"], r["neighbour_rank"]): r["doc_id"] for r in rows}
    assert {q for q, _ in found} == set(range(12)) and all(found[i, 1] == i for i in range(12))
    assert found[0, 2] == 1 and found[5, 2] == 4 and len(rows) == 24
    assert nearest(queries, docs.filter("doc_id > 49 AND doc_id < 55")).count() == 0


@pytest.mark.parametrize("scale", [1e-4, 1.0, 1e6])
def test_neighbours_at_any_norm(spark, scale):
    docs = spark.createDataFrame([(i, [scale * (1 + i * 1e-7), 0.0]) for i in range(50)], "doc_id long, embedding array<double>")
    queries = spark.createDataFrame([(0, [scale * (1 + 31e-7), 0.0], 3)], "query_id long, embedding array<double>, k int")
    rows = sorted(nearest(queries, docs).collect(), key=lambda r: r["neighbour_rank"])
    assert rows[0]["doc_id"] == 31 and {r["doc_id"] for r in rows[1:]} == {30, 32}


def test_no_documents(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding", F.lit(3).alias("k"))
    assert nearest(queries, queries.withColumnRenamed("query_id", "doc_id").filter("doc_id < 0")).count() == 0


# --- Preprocessing and validation on untidy tables ---


def _rows(spark, changes, extra=""):
    row = {s: 1.0 for s in SENSORS} | {"Mode": 1, "P0403": 1, "P0406": 0}
    schema = "row_id long, " + ", ".join(f"{s} double" for s in SENSORS) + ", Mode int, P0403 int, P0406 int" + extra
    return spark.createDataFrame([{**row, "row_id": i, **c} for i, c in enumerate(changes)], schema)


def test_every_column_is_content(spark):
    df = _rows(spark, [{"vehicle": f"v{i % 7}"} for i in range(50)], ", vehicle string")
    done = preprocess(df, df.drop("P0406"))
    assert done.train.count() == 7 and "vehicle" in done.train.columns
    report = {r["metric"]: r["value"] for r in done.report.collect()}
    assert report["train_clean_rows"] == 7 and report["train_test_overlap"] == 7 and report["test_duplicates"] == 43
    assert preprocess(df, df.drop("vehicle")).report.filter("metric = 'train_test_overlap'").first()["value"] == 0


def test_infinite_cell_leaves_the_scaler_alone(spark):
    df = _rows(spark, [{"RPM": float(i)} for i in range(5)] + [{"RPM": float("inf")}, {"RPM": float("nan")}, {"RPM": None}])
    done = preprocess(df, df)
    rpm = done.scaler.filter("feature = 'RPM'").first()
    assert rpm["mean"] == pytest.approx(2.0) and rpm["scale"] == pytest.approx(2**0.5)
    assert done.train.filter("row_id < 5 AND (z_RPM IS NULL OR isnan(z_RPM))").count() == 0


def test_white_space_around_numbers(spark):
    rows = spark.createDataFrame([("\t-inf",), ("\n 1.5 \t",), ("\t",), (" \n \n",), ("NaN\n",)], "t string")
    got = [r["d"] for r in rows.select(parse_double(F.col("t")).alias("d")).collect()]
    assert got[:4] == [float("-inf"), 1.5, None, None] and np.isnan(got[4])
    blank = [r["e"] is not None for r in rows.select(query_text_error(F.col("t")).alias("e")).collect()]
    assert blank == [False, False, True, True, False]


def test_scope_deletes_what_it_wrote(spark):
    with scratch_scope(spark) as outer:
        with scratch_scope(spark) as inner:
            assert materialise(spark.range(3), "x").count() == 3 and os.path.isdir(inner.removeprefix("file:"))
        assert not os.path.exists(inner.removeprefix("file:"))
        assert materialise(spark.range(4), "y").count() == 4
    assert not os.path.exists(outer.removeprefix("file:"))


def test_encoder_counts_words_as_written_out(spark):
    texts = ["Brake brake LINE_7", None, "", "--- ä!", "line_7, pump\nK9; Brake", "x" * 5000 + " pump " * 3000, "Brake brake LINE_7"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, query_text string")
    model = fit_encoder(frame, "query_text", 16)
    words = [re.findall("[a-z0-9_]+", (t or "").lower()) for t in texts]
    places = [[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16 for w in own] for own in words]
    rarity = [math.log((len(texts) + 1) / (sum(d in own for own in places) + 1)) for d in range(16)]
    assert model.rarity == pytest.approx(rarity)
    found = {r.query_id: r.embedding for r in model.encode(frame).collect()}
    for i, own in enumerate(places):
        vector = np.bincount(np.array(own, int), minlength=16) * np.array(rarity)
        norm = np.sqrt((vector**2).sum())
        assert found[i] == pytest.approx(vector / norm if norm else vector, abs=1e-6)
    assert model.encode(frame.limit(0)).count() == 0 and fit_encoder(frame.limit(0), "query_text", 16).rarity == [0.0] * 16
