from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from telltale.functions.codes import parse_code_list, signature
from telltale.operators import similarity as SIM
from telltale.operators.code_sets import code_similarities
from telltale.schemas import MODE, SENSORS
from telltale.workload import queries as W


def _jaccard(q, h):
    q, h = set(q), set(h)
    if not q:
        return 1.0 if h <= {"P0000"} or h == {"NONE"} else 0.0
    return len(q & h) / len(q | h) if h else 0.0


def brute_force(incidents, history, scaler, k, weights):
    mean = np.array([scaler[s][0] for s in SENSORS])
    scale = np.array([scaler[s][1] for s in SENSORS])
    h = (np.array([[r[s] for s in SENSORS] for r in history]) - mean) / scale
    modes = np.array([r[MODE] for r in history])
    index = np.array([r["historical_index"] for r in history])
    out = set()
    cache = {}
    for i in incidents:
        q = (np.array([i[s] for s in SENSORS]) - mean) / scale
        sensor = 1 / (1 + np.sqrt(((h - q) ** 2).sum(axis=1)))
        codes = tuple(i["active_dtcs"])
        if codes not in cache:
            cache[codes] = np.array([_jaccard(codes, r["active_dtcs"]) for r in history])
        jac = cache[codes]
        mode = (modes == i[MODE]).astype(float)
        score = np.round(weights["sensor"] * sensor + weights["dtc"] * jac + weights["mode"] * mode, 9)
        for rank, at in enumerate(np.lexsort((-index, -score))[:k]):
            out.add((i["incident_id"], rank + 1, int(index[at])))
    return out


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    history = W.prepared(spark, sf_dir).train
    incidents = W.incidents(spark, sf_dir)
    return history, incidents, history.collect(), incidents.collect(), W.scaler(spark, sf_dir)


CASES = [
    (5, {"sensor": 0.5, "dtc": 0.3, "mode": 0.2}),
    (1, {"sensor": 1.0, "dtc": 0.0, "mode": 0.0}),  # also compared with SQL
    (3, {"sensor": -0.4, "dtc": 0.9, "mode": 0.1}),
    (4, {"sensor": 0.2, "dtc": -0.5, "mode": 0.0}),
]


@pytest.mark.parametrize("most,k,weights", [(SIM.MOST_TOP_BOXES, *CASES[0]), (1, *CASES[0]), (SIM.MOST_TOP_BOXES, *CASES[2]), (1, *CASES[1]), (1, *CASES[2]), (12, *CASES[3]), (300, *CASES[0])])
def test_equals_brute_force(tables, monkeypatch, most, k, weights):
    history, incidents, h_rows, i_rows, scaler = tables
    if most < 100:
        # Small boxes make more levels of a small table; leaves and boxes are shuffled instead of broadcast.
        monkeypatch.setattr(SIM, "LEAF_BITS", 3)
        monkeypatch.setattr(SIM, "MAX_BROADCAST_LEAVES", 1)
        monkeypatch.setattr(SIM, "MOST_BOX_CODES", 4)
        monkeypatch.setattr(SIM, "PAIRS_PER_PAGE", 40)
    index = SIM.build_index(history, scaler, most_boxes=most)
    counts = [level.count() for level in index.levels]
    assert counts[-1] <= most and len(counts) >= {SIM.MOST_TOP_BOXES: 1, 300: 1, 12: 4, 1: 5}[most]
    for level, above in zip(index.levels, index.levels[1:], strict=False):
        fan = level.groupBy("parent_id").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))
        assert fan.agg(F.max("n")).first()[0] <= 8
        assert fan.join(above, fan["parent_id"] == above["box_id"]).filter(fan["rows"] == above["rows"]).count() == above.count() == fan.count()
    best = SIM.similar_topk(incidents, index, k, weights)
    got = {(r["incident_id"], r["rank"], r["historical_index"]) for r in best.collect()}
    assert got == brute_force(i_rows, h_rows, scaler, k, weights)


def test_boxes_bound_their_rows(tables):
    """No row scores above the bound of any box it lies in, with any signs of the weights."""
    history, incidents, _, _, scaler = tables
    index = SIM.build_index(history, scaler, most_boxes=1)
    boxes = [level.toPandas().assign(level=i) for i, level in enumerate(index.levels)]
    asked = incidents.limit(30)
    z = ["z_" + s for s in SENSORS]
    probes = SIM.scale(asked, scaler, sensors=SENSORS).select("incident_id", F.col(MODE).cast("double").alias(MODE), F.array_sort(F.array_distinct("active_dtcs")).alias("codes"), *z).toPandas()
    parents = {b["box_id"]: b["parent_id"] for i in range(len(boxes) - 1) for _, b in boxes[i].iterrows()}
    for k, weights in CASES:
        best = SIM.similar_topk(asked, index, 1, weights).toPandas().set_index("incident_id")["similarity_score"]
        for table in boxes:
            top = SIM._Boxes(SIM._arrays(table.to_dict("list"), SENSORS), SENSORS, weights, k)
            _, _, fixed = top._block_scores(probes)
            row, box = top._expand(np.ones(fixed.shape, bool))
            most = np.full(len(probes), -np.inf)
            np.maximum.at(most, row, top._upper(probes, row, box, fixed))
            assert (most >= probes["incident_id"].map(best).to_numpy() - 1e-9).all()
    assert len(parents) > 1


def test_top_is_sent_once(tables):
    history, incidents, _, _, scaler = tables
    index = SIM.build_index(history.limit(500), scaler)
    SIM.similar_topk(incidents.limit(5), index).collect()
    sent = index.top()
    SIM.similar_topk(incidents.limit(5), index).collect()
    assert index.top() is sent
    index.release()
    assert SIM.similar_topk(incidents.limit(5), index).count() == 25 and index.top() is not sent


def test_k_beyond_history(tables):
    history, incidents, _, _, scaler = tables
    few = history.filter("historical_index < 7")
    best = SIM.similar_topk(incidents.limit(20), SIM.build_index(few, scaler), 10)
    assert {r["n"] for r in best.groupBy("incident_id").agg(F.count("*").alias("n")).collect()} == {7}


def test_copies_of_history(tables):
    """Many equal rows: the largest positions win, and no task needs them all."""
    history, incidents, _, _, scaler = tables
    one = history.filter("historical_index = 3").drop("historical_index")
    spark = history.sparkSession
    copies = spark.range(5000).withColumnRenamed("id", "historical_index").crossJoin(one)
    best = SIM.similar_topk(incidents.limit(3), SIM.build_index(copies, scaler), 5)
    assert {r["historical_index"] for r in best.collect()} == set(range(4995, 5000))


def test_limits_of_k(tables):
    history, incidents, _, _, scaler = tables
    index = SIM.build_index(history.limit(100), scaler)
    assert SIM.similar_topk(incidents.limit(5), index, 0).count() == 0
    with pytest.raises(ValueError):
        SIM.similar_topk(incidents, index, -1)


def test_nothing_to_find(tables):
    history, incidents, _, _, scaler = tables
    few = incidents.limit(3)
    assert SIM.similar_topk(few, SIM.build_index(history.filter("historical_index < 0"), scaler)).count() == 0
    assert SIM.similar_topk(few.filter("incident_id < 0"), SIM.build_index(history.limit(9), scaler)).count() == 0


def test_self_query(tables):
    """A history row finds itself, or an equal row, with full similarity; scores never rise with rank."""
    history, _, _, _, scaler = tables
    index = SIM.build_index(history, scaler)
    asked = history.filter("historical_index % 50 = 0").withColumn("incident_id", F.col("historical_index"))
    rows = SIM.similar_topk(asked, index).orderBy("incident_id", "rank").collect()
    for r in rows:
        if r["rank"] == 1:
            assert r["historical_index"] == r["incident_id"]
            assert r["sensor_similarity"] > 0.99 and r["mode_similarity"] == 1.0
            assert r["similarity_score"] > (0.99 if r["dtc_similarity"] == 1.0 else 0.69)
    for a, b in zip(rows, rows[1:], strict=False):
        if a["incident_id"] == b["incident_id"]:
            assert a["similarity_score"] >= b["similarity_score"] - 1e-9


def test_code_similarity_in_the_engine(spark, tables):
    """One history row and one incident per mode, so each incident's best case is the row of its own mode."""
    cases = [
        ([], [], 1.0), ([], ["P0000"], 1.0), ([], ["NONE"], 1.0), ([], ["P0403"], 0.0), ([], ["P0000", "P0403"], 0.0),
        (["P0000"], [], 0.0), (["P0403"], [], 0.0), (["P0403"], ["P0403", "P0404"], 0.5), (["P9999"], ["P0403"], 0.0),
        (["P0403", "P0403"], ["P0403"], 1.0), (["P0403", "P0404"], ["P0404", "P0405"], 1 / 3),
    ]
    history, scaler = tables[0], tables[4]
    row = history.limit(1).drop("Mode", "active_dtcs", "dtc_signature", "historical_index")
    listed = spark.createDataFrame([(i, i, q, h) for i, (q, h, _) in enumerate(cases)], "n long, Mode int, q array<string>, h array<string>")
    both = row.join(F.broadcast(listed), F.lit(True))
    known = both.withColumnsRenamed({"n": "historical_index", "h": "active_dtcs"}).withColumn("dtc_signature", signature(F.col("active_dtcs")))
    asked = both.withColumnsRenamed({"n": "incident_id", "q": "active_dtcs"})
    found = SIM.similar_topk(asked, SIM.build_index(known, scaler), 1, {"sensor": 0.0, "dtc": 0.2, "mode": 0.8}).collect()
    assert {r["incident_id"]: round(r["dtc_similarity"], 9) for r in found} == {i: round(e, 9) for i, (_, _, e) in enumerate(cases)}


@pytest.mark.parametrize("least", [0.0, 0.3, 0.5, 1.0])
def test_code_join_equals_all_pairs(spark, least):
    draw = np.random.default_rng(int(10 * least))
    names = ["P0000", "NONE", *(f"P{i}" for i in range(25))]
    sides = [[sorted(set(draw.choice(names, size=draw.integers(0, 9), p=np.r_[0.3, 0.1, np.full(25, 0.6 / 25)]).tolist())) for _ in range(120)] + [[], ["NONE"], ["P0000"]] for _ in range(2)]
    left, right = (spark.createDataFrame([(x + x[:1],) for x in side] + [(None,)], "active_dtcs array<string>") for side in sides)
    got = [(tuple(r["left_codes"]), tuple(r["right_codes"]), round(r["similarity"], 9)) for r in code_similarities(left, right, least).collect()]
    expected = {(tuple(a), tuple(b), round(_jaccard(a, b), 9)) for a in sides[0] for b in sides[1] if _jaccard(a, b) > 0 and _jaccard(a, b) >= least - 1e-12}
    assert len(got) == len(set(got)) and set(got) == expected
    assert code_similarities(left.limit(0), right, least).count() == 0


def test_signature_and_list_text(spark):
    df = spark.createDataFrame([(["b", "a", "a"], "['P1', 'P2']"), ([], "[]"), (None, "no list")], "c array<string>, t string")
    rows = df.select(signature(F.col("c")).alias("s"), parse_code_list(F.col("t")).alias("l")).collect()
    assert [r["s"] for r in rows] == ["a|a|b", "NONE", "NONE"]
    assert [r["l"] for r in rows] == [["P1", "P2"], [], []]


@pytest.mark.parametrize("most", [SIM.MOST_SENT_ROWS, 0])
def test_nested_cases_join_by_content(spark, sf_dir, monkeypatch, most):
    """As nesting the ranked rows, also where ids repeat and readings are unusable; a side that grows with the incidents is never sent to all tasks, however small its file."""
    monkeypatch.setattr(SIM, "MOST_SENT_ROWS", most)
    index = W.index(spark, sf_dir)
    some = W.incidents(spark, sf_dir).filter("incident_id % 3 = 0").withColumn("RPM", F.when(F.col("incident_id") % 7 != 0, F.col("RPM")))
    own = some.withColumn("row", F.col("incident_id")).withColumn("incident_id", F.col("incident_id") % 2)
    ranked = SIM.similar_topk(own, index, key="row")
    grown = SIM.nest_cases(own, ranked, key="row").select("row", "similarity")
    joined = SIM.with_similar_cases(own, index, wanted=F.col("row") % 5 != 0)
    assert "BroadcastHashJoin" not in grown._jdf.queryExecution().sparkPlan().toString().split("HashAggregate")[0]
    assert ("BroadcastHashJoin" in joined._jdf.queryExecution().sparkPlan().toString()) == (most > 0)
    expected, got = ({r["row"]: r["similarity"] for r in d.select("row", "similarity").collect()} for d in (grown, joined))
    assert joined.columns == [*own.columns, "similarity"] and len(got) == own.count() == joined.count()
    assert {r: s for r, s in got.items() if r % 5} == {r: s for r, s in expected.items() if r % 5}
    assert all(s["top_cases"] == [] and s["top_score"] == 0.0 for r, s in got.items() if r % 5 == 0 or r % 7 == 0) and any(s["top_cases"] for s in got.values())


def test_code_lists_of_every_row(spark, sf_dir, tables):
    """The pairs of lists and every row's own list give each pair of rows that have something in common."""
    history, incidents, h_rows, i_rows, _ = tables
    rows = W.code_jaccard(spark, sf_dir).collect()
    whose = {r["incident_id"]: r["incident_codes"] for r in rows if r["incident_id"] is not None}
    kept = {r["historical_index"]: r["history_codes"] for r in rows if r["historical_index"] is not None}
    alike = {(r["incident_codes"], r["history_codes"]): r["similarity"] for r in rows if r["similarity"] is not None}
    assert len(whose) == len(i_rows) and len(kept) == len(h_rows) and len(rows) == len(whose) + len(kept) + len(alike)
    for i in i_rows[:60]:
        for h in h_rows[::7]:
            assert alike.get((whose[i["incident_id"]], kept[h["historical_index"]]), 0.0) == pytest.approx(_jaccard(i["active_dtcs"], h["active_dtcs"]), abs=1e-9)
