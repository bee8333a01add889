"""Contracts, retrieval, packages, files and streams on hand-made incidents."""

from __future__ import annotations

from pathlib import Path

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from telltale import fixtures as X
from telltale.functions import validation as V
from telltale.operators import evidence as EV
from telltale.operators.deviation import severity
from telltale.operators.retrieval import retrieve
from telltale.plans.analyze import analyze_incidents
from telltale.plans.knowledge_base import build_knowledge_base
from telltale.plans.preprocess import run_preprocess
from telltale.schemas import SENSORS, raw_incident_schema
from telltale.sources import artefacts as ART
from telltale.sources.knowledge import read_json_entries, read_yaml_entries
from telltale.sources.telemetry import read_history, read_incidents, read_telemetry
from telltale.session import scratch_dir
from telltale.streaming.incidents import analyze_stream, read_incident_stream

BASE = {
    "LOAD_PCT": "26.3", "ECT": "169.0", "MAP": "14.4", "RPM": "790.0", "VSS": "0.0", "IAT": "106.0", "MAF": "0.02",
    "FRP": "4507.5", "BARO": "14.2", "VPWR": "13.64", "AAT": "126.0", "Mode": "0", "active_dtcs": ["P0403", "P0404"],
}
CASES = {
    "v01": {}, "v02": {"active_dtcs": ["P0403"]}, "v03": {"active_dtcs": []}, "v04": {"active_dtcs": None},
    "v05": {"RPM": "INVALID"}, "v06": {"ECT": None}, "v07": {"Mode": "INVALID_MODE"}, "v08": {"Mode": None},
    "v09": {"Mode": "1.0"}, "v10": {"RPM": "INVALID", "ECT": None}, "v11": {s: "999999" for s in SENSORS},
    "v12": {"active_dtcs": ["P9999"]}, "v13": {"active_dtcs": ["P0000"]}, "v14": {"active_dtcs": ["P0403", "P0403"]},
    "v15": {"Mode": "99"}, "v16": {"RPM": " 790 "}, "v17": {"RPM": "7.9e2"}, "v18": {"RPM": "1d"}, "v19": {"RPM": "nan"},
}
ERRORS = {
    "v05": "Sensor value RPM must be numeric.", "v06": "Missing required sensor field: ECT", "v07": "Mode must be an integer.",
    "v08": "Missing required field: Mode", "v09": "Mode must be an integer.", "v10": "Missing required sensor field: ECT",
    "v18": "Sensor value RPM must be numeric.",
}


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame([{"incident_id": i, **BASE, **c} for i, c in CASES.items()], raw_incident_schema())


@pytest.fixture(scope="module")
def packages(raw, resources):
    return {r["incident_id"]: r for r in analyze_incidents(raw, resources).withColumn("json", EV.package_json()).collect()}


def test_contract(raw):
    found = {r["incident_id"]: r["e"] for r in raw.select("incident_id", V.incident_error(raw).alias("e")).collect()}
    assert {i: e for i, e in found.items() if e} == ERRORS
    strict = {r["incident_id"]: r["e"] for r in raw.select("incident_id", V.similarity_error(raw).alias("e")).collect()}
    assert strict["v04"] == "Missing required field: active_dtcs (list of strings)" and strict["v07"] is None
    typed = {r["incident_id"]: r for r in V.typed_incidents(raw).collect()}
    assert typed["v16"]["RPM"] == typed["v17"]["RPM"] == 790.0 and typed["v04"]["active_dtcs"] == []


def test_contract_of_other_tables(raw):
    no_rpm = raw.drop("RPM")
    assert {r["e"] for r in no_rpm.select(V.anomaly_error(no_rpm).alias("e")).filter("e LIKE '%RPM%'").collect()} == {"Missing required sensor field: RPM"}
    text = raw.withColumn("active_dtcs", F.lit("P0403"))
    assert text.filter("incident_id = 'v01'").select(V.incident_error(text).alias("e")).first()["e"] == "active_dtcs must be a list of strings."
    number = raw.filter("incident_id = 'v01'").withColumn("Mode", F.lit(1.7))
    assert V.typed_incidents(number).first()["Mode"] == 1


def test_rejected_incidents(packages):
    for i, message in ERRORS.items():
        assert packages[i]["error"]["error"] == "Input Validation Error" and packages[i]["error"]["message"] == message
        assert packages[i]["incident"] is None
        assert json.loads(packages[i]["json"]) == {"error": "Input Validation Error", "message": message}


def test_packages(packages):
    ok = packages["v01"]
    assert ok["error"] is None and len(ok["similarity"]["top_cases"]) == 5
    assert ok["service_history"]["available"] is False and "No real service-history" in ok["service_history"]["reason"]
    assert [m["DTC_code"] for m in ok["rag"]["exact_dtc_matches"]] == ["P0403", "P0404"]
    assert ok["evidence_summary"][0] == "Found 5 historically similar operating states."
    assert any("P0403, P0404" in s for s in ok["investigation_leads"])
    assert set(json.loads(ok["json"])) == {
        "incident", "similarity", "anomaly", "rag", "service_history", "evidence_summary", "investigation_leads",
    }
    assert json.loads(ok["json"])["rag"]["exact_dtc_matches"][0]["similarity_score"] == "EXACT_MATCH"
    for i in ("v03", "v04", "v13"):
        assert packages[i]["rag"]["exact_dtc_matches"] == [] == packages[i]["rag"]["semantic_matches"]
    assert packages["v12"]["rag"]["exact_dtc_matches"] == []
    assert all(c["dtc_similarity"] == 0 for c in packages["v12"]["similarity"]["top_cases"])
    assert all(c["mode_similarity"] == 0 for c in packages["v15"]["similarity"]["top_cases"])
    assert [m["DTC_code"] for m in packages["v14"]["rag"]["exact_dtc_matches"]] == ["P0403"]


def test_extreme_incident(packages):
    verdict = packages["v11"]["anomaly"]
    assert verdict["anomaly"] and verdict["severity"] in ("moderate", "high")
    features = [c["feature"] for c in verdict["feature_contributions"]]
    assert {"RPM", "ECT"} <= set(features)
    deviations = [c["deviation_magnitude"] for c in verdict["feature_contributions"]]
    assert deviations == sorted(deviations, reverse=True)
    assert f"{features[0]} was among the features with the largest deviation." in packages["v11"]["evidence_summary"]


def test_not_a_number(packages):
    p = packages["v19"]
    assert p["error"] is None and p["similarity"]["top_cases"] == [] and p["similarity"]["top_score"] == 0.0
    assert p["anomaly"]["severity"] == "unknown" and p["anomaly"]["error"] and p["rag"]["exact_dtc_matches"]


def test_degrade(raw, resources):
    rows = {r["incident_id"]: r for r in analyze_incidents(raw, resources, mode="degrade").collect()}
    assert len(rows) == len(CASES) and all(r["error"] is None for r in rows.values())
    for i in ("v05", "v06"):
        assert rows[i]["similarity"]["top_cases"] == [] and rows[i]["anomaly"]["severity"] == "unknown"
        assert rows[i]["anomaly"]["error"] == ERRORS[i] and rows[i]["rag"]["exact_dtc_matches"]
    assert len(rows["v07"]["similarity"]["top_cases"]) == 5
    assert rows["v04"]["similarity"]["top_cases"] == [] and rows["v04"]["anomaly"]["error"] is None
    with pytest.raises(ValueError):
        analyze_incidents(raw, resources, mode="other")


def test_repeated_and_missing_ids(spark, raw, resources, packages):
    """Every row has a package of its own, also where ids repeat or are missing."""
    rows = raw.filter("incident_id IN ('v01', 'v03', 'v11', 'v05')").withColumn("incident_id", F.when(F.col("incident_id") != "v11", F.lit("same")))
    got = [json.loads(r["json"]) for r in analyze_incidents(rows, resources).withColumn("json", EV.package_json()).collect()]
    expected = [json.loads(packages[i]["json"]) for i in ("v01", "v03", "v11", "v05")]
    assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, expected))


@pytest.mark.parametrize("vector", [None, [], [float("nan")] * 64, [1.0, 2.0]])
def test_a_failing_encoder_touches_only_its_own_incidents(raw, resources, packages, vector):
    def failing(asked):
        bad = F.lit(None) if vector is None else F.array(*[F.lit(v) for v in vector])
        return resources.encoder(asked).withColumn("embedding", F.when(F.col("query_text") == "P0404", bad.cast("array<float>")).otherwise(F.col("embedding")))

    rows = {r["incident_id"]: r for r in analyze_incidents(raw, replace(resources, encoder=failing)).withColumn("json", EV.package_json()).collect()}
    hit = {i for i in CASES if i not in ERRORS and "P0404" in ({**BASE, **CASES[i]}["active_dtcs"] or [])}
    assert hit and {i: r["json"] for i, r in rows.items() if i not in hit} == {i: r["json"] for i, r in packages.items() if i not in hit}
    for i in hit:
        assert tuple(rows[i]["error"]) == ("Internal Processing Error", "No usable vector for DTC(s): P0404.") and rows[i]["similarity"] is None
        assert json.loads(rows[i]["json"]) == rows[i]["error"].asDict()
    kept = {r["incident_id"]: r for r in analyze_incidents(raw, replace(resources, encoder=failing), mode="degrade").collect()}
    assert kept["v01"]["error"] is None and kept["v01"]["rag"]["exact_dtc_matches"] == packages["v01"]["rag"]["exact_dtc_matches"]
    assert len(kept["v01"]["similarity"]["top_cases"]) == 5 and kept["v01"]["retrieval_error"] == "No usable vector for DTC(s): P0404."


@pytest.mark.parametrize("bytes_", [EV.BROADCAST_BYTES, 10])
def test_popular_code_lists(spark, monkeypatch, bytes_):
    """Half of the incidents on one list: the same matches as without a split, and no task gets much more than its share."""
    monkeypatch.setattr(EV, "BROADCAST_BYTES", bytes_)
    lists = F.when(F.col("id") % 2 == 0, F.array(F.lit("P0403"))).when(F.col("id") % 4 == 1, F.array(F.concat(F.lit("P"), F.col("id").cast("string")))).otherwise(F.array(F.lit("P0000")))
    who = spark.range(20_000).select(F.col("id").alias("incident_id"), lists.alias("active_dtcs"))
    found = who.select("active_dtcs").distinct().filter("active_dtcs[0] <> 'P0000'")
    arrays = found.select("active_dtcs", F.transform("active_dtcs", lambda c: F.concat(c, F.lit("!"))).alias("exact_dtc_matches"), F.array().cast("array<string>").alias("semantic_matches"))
    popular = EV.popular_lists(who, 8)
    assert '["P0403"]' in popular and len(popular) <= 32
    split = EV.with_matches(who, arrays, popular)
    columns = ["incident_id", "active_dtcs", "exact_dtc_matches", "semantic_matches"]
    plain = EV.with_matches(who, arrays).select(columns)
    assert split.count() == 20_000 and split.select(columns).exceptAll(plain).count() == 0
    monkeypatch.setattr(EV, "COPIES", 64)
    sizes = [r["n"] for r in split.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


def test_static_side_is_sent_once(raw, resources):
    own = replace(resources, _vectors=None).prepare()
    top, vectors = own.index.top(), own.vectors()
    analyze_incidents(raw, own).collect()
    analyze_incidents(raw, own).collect()
    assert own.index.top() is top and own.vectors() is vectors


def test_severity(spark):
    rows = spark.createDataFrame([(-0.1,), (0.0,), (0.0999,), (0.1,)], "s double").select(severity(F.col("s")).alias("v")).collect()
    assert [r["v"] for r in rows] == ["normal", "moderate", "moderate", "high"]


def test_retrieval(spark, resources):
    texts = ["P0403", "P9999", "", "   ", "engine", "fuel pressure", "fuel pressure", "p0403 or XP04041"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id int, query_text string")
    found = retrieve(resources.encoder(asked), resources.docs, 10).join(resources.docs.select("doc_id", "code"), "doc_id").collect()
    by = {i: sorted((r for r in found if r["query_id"] == i), key=lambda r: r["position"]) for i in range(len(texts))}
    assert by[0][0]["code"] == "P0403" and by[0][0]["match_type"] == "EXACT" and by[0][0]["score"] is None
    assert by[1] and all(r["match_type"] == "SEMANTIC" for r in by[1])
    assert not by[2] and not by[3]
    assert [(r["code"], r["score"]) for r in by[5]] == [(r["code"], r["score"]) for r in by[6]]
    assert [r["code"] for r in by[7][:2]] == ["P0403", "P0404"]
    for rows in by.values():
        codes = [r["code"].upper() for r in rows]
        assert len(codes) == len(set(codes)) and len(rows) <= 10
    top = retrieve(resources.encoder(asked.filter("query_id = 4")), resources.docs, 1).collect()
    assert len(top) == 1
    with pytest.raises(ValueError):
        retrieve(resources.encoder(asked), resources.docs, 0)


YAML = """
- code: P0403
  category: emissions
  title: {de: Kreis, en: Control circuit}
  description: Valve fault
  affected_components: [valve, relay]
  common_causes: [{label: {en: wear}}, {note: none}, {label: {fr: usure}}]
  repair: {difficulty: medium, estimated_hours: 1.5}
  flags: {emissions: true}
- title: no code
- {code: p0500, repair: null, common_causes: null, title: {}}
"""


def test_yaml_entries(spark, tmp_path):
    (tmp_path / "b.yaml").write_text(YAML)
    (tmp_path / "a.yaml").write_text("- {code: B1000, title: First}\n")
    (tmp_path / "empty.yaml").write_text("")
    entries = read_yaml_entries(spark, str(tmp_path))
    assert entries.count() == 4
    docs, _ = build_knowledge_base(entries)
    rows = docs.orderBy("doc_id").collect()
    assert [(r["doc_id"], r["code"], r["source_file"]) for r in rows] == [(0, "B1000", "a.yaml"), (1, "P0403", "b.yaml"), (2, "p0500", "b.yaml")]
    assert rows[1]["text_doc"].split("\n") == [
        "DTC: P0403", "Category: emissions", "Title: Control circuit", "Description: Valve fault", "Affected Components: valve, relay",
        "Common Causes: wear; usure", "Repair Information: Difficulty: medium, DIY Possible: Unknown, Cost EUR: Unknown, Hours: 1.5", "Flags: emissions: True",
    ]
    assert rows[2]["text_doc"].split("\n")[2:] == [
        "Title: ", "Description: ", "Affected Components: None", "Common Causes: None",
        "Repair Information: Difficulty: Unknown, DIY Possible: Unknown, Cost EUR: Unknown, Hours: Unknown", "Flags: None",
    ]
    entries.write.json(str(tmp_path / "lines"))
    assert read_json_entries(spark, str(tmp_path / "lines")).count() == 4


def test_saved_resources(spark, raw, resources, packages, tmp_path):
    ART.save_resources(spark, resources, str(tmp_path / "r"))
    again = {r["incident_id"]: r for r in analyze_incidents(raw, ART.load_resources(spark, str(tmp_path / "r"))).withColumn("json", EV.package_json()).collect()}
    assert {i: r["json"] for i, r in again.items()} == {i: r["json"] for i, r in packages.items()}
    ART.save_model(spark, type(resources.model)(resources.model.forest, None), str(tmp_path / "m"))
    assert ART.load_model(spark, str(tmp_path / "m")).bands is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        ART.load_knowledge(spark, str(tmp_path / "missing"))


def test_preprocess_files(spark, sf_dir, tmp_path):
    X.train(spark, sf_dir).write.parquet(str(tmp_path / "train"))
    X.test(spark, sf_dir).write.option("header", True).csv(str(tmp_path / "test"))
    train = read_telemetry(spark, str(tmp_path / "train"))
    test = read_telemetry(spark, str(tmp_path / "test"), "csv", X.test(spark, sf_dir).schema)
    done = run_preprocess(train, test, str(tmp_path / "out"), "csv")
    assert ART.quality_metrics(done.report)["train_clean_rows"] == done.train.count() == 3991
    back = read_history(spark, str(tmp_path / "out/train_clean"), "csv", done.train.schema)
    key = ["historical_index", "active_dtcs", "dtc_signature", "Mode", "z_RPM"]
    assert sorted(map(str, back.select(key).collect())) == sorted(map(str, done.train.select(key).collect()))
    assert "train_duplicates | 740" in spark.read.text(str(tmp_path / "out/report_text"), wholetext=True).first()[0]


def test_rejected_incidents_are_not_parsed_again(spark, raw, resources, packages, tmp_path):
    raw.write.parquet(str(tmp_path / "in"))
    found = analyze_incidents(read_incidents(spark, str(tmp_path / "in")), resources)
    assert not [f for f in found.inputFiles() if str(tmp_path) in f]
    assert {r["incident_id"]: r["error"] for r in found.collect()} == {i: r["error"] for i, r in packages.items()}


def test_stream_equals_batch(spark, raw, resources, packages, tmp_path):
    raw.repartition(5).write.parquet(str(tmp_path / "in"))
    assert read_incidents(spark, str(tmp_path / "in")).count() == len(CASES)
    arriving = read_incident_stream(spark, str(tmp_path / "in"), max_files=2)
    analyze_stream(arriving, resources, str(tmp_path / "out"), str(tmp_path / "state"), as_json=True).awaitTermination()
    left = Path(scratch_dir(spark).removeprefix("file:"), "telltale")
    assert not list(left.glob("scope-*")) and resources.lookup is not None  # a batch's own tables are gone, the prepared one stays
    assert resources.lookup.count() > 0
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len({r["batch_id"] for r in got}) > 1
    assert {r["incident_id"]: json.loads(r["package"]) for r in got} == {i: json.loads(r["json"]) for i, r in packages.items()}


def test_written_packages(spark, raw, resources, packages, tmp_path):
    ART.write_packages(analyze_incidents(raw, resources), str(tmp_path / "json"), "json")
    lines = spark.read.json(str(tmp_path / "json")).collect()
    assert {r["incident_id"]: json.loads(r["package"]) for r in lines} == {i: json.loads(r["json"]) for i, r in packages.items()}
