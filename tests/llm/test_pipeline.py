"""Each stage against brute force on its own input, and the run as a whole."""

from __future__ import annotations

import os
import re

import pytest

import corpus_pipeline
from telltale.llm import passages
from telltale.llm.simhash import fingerprint
from telltale.session import materialise, scratch_dir


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(materialise(stage(spark, docs[-1], sf_dir), f"test-{name}"))
    return [d.collect() for d in docs]


def test_columns_and_ids(steps):
    for rows in steps[1:-1]:
        assert rows[0].__fields__ == steps[0][0].__fields__
    for before, after in zip(steps, steps[1:], strict=False):
        assert {r.doc_id for r in after} <= {r.doc_id for r in before} and len({r.doc_id for r in after}) == len(after)


def test_stages_against_brute_force(steps, spark, sf_dir):
    raw, spoken, single, near, clean, mixed = steps
    gone = {r.doc_id for r in raw} - {r.doc_id for r in spoken}
    assert all(not re.search(r"[^\W\d_]{3}", r.text or "") for r in raw if r.doc_id in gone)
    first: dict = {}
    for r in sorted(spoken, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\t-\r]+", " ", r.text), r.doc_id)
    assert {r.doc_id for r in single} == set(first.values())
    prints = {r.doc_id: fingerprint(r.text.encode(), 3) & (2**64 - 1) for r in single}
    label = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    assert {r.doc_id for r in near} == set(label.values())
    plain = lambda t: " ".join(re.split(r"[\x20\t-\r]+", t or "")).strip().lower()
    items = [plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean} == {r.doc_id for r in near if not any(i in plain(r.text) for i in items)}
    assert all(0 < r.taken <= 2 * r.size for r in mixed) and {r.target > 0 for r in mixed} == {True}


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_rows(spark, odd, nothing, sf_dir, number):
    name, stage = corpus_pipeline.STAGES[number]
    rows = stage(spark, odd, sf_dir).collect()
    assert rows and stage(spark, nothing, sf_dir).count() == 0
    if name == "exact_copies":
        assert sum(r.doc_id in (1, 2) for r in rows) == 1 and sum(not (r.text or "").strip() for r in rows) <= 2


@pytest.mark.parametrize("name", ["exact_copies", "near_copies", "benchmark_leaks", "passages"])
def test_row_numbers_outlast_another_split_of_the_files(spark, sf_dir, tmp_path, name):
    """The plan is made under one split of the input's files and run under another one, as when executors come or go between two jobs."""
    path, setting = str(tmp_path / "docs"), "spark.sql.files.maxPartitionBytes"
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(6).write.parquet(path)

    def found(*sizes):
        before = spark.conf.get(setting)
        try:
            spark.conf.set(setting, sizes[0])
            docs = spark.read.parquet(path)
            out = passages.passages(docs) if name == "passages" else dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
            # Both sides of the plan's join are scanned by plans made now, so only what was written keeps its number.
            assert "monotonically_increasing_id" not in out._jdf.queryExecution().optimizedPlan().toString()
            spark.conf.set(setting, sizes[-1])
            return {r.doc_id for r in out.collect()}
        finally:
            spark.conf.set(setting, before)

    assert found("128m", "64k") == found("128m")


def test_pipeline_leaves_only_its_result(spark, sf_dir):
    folder = scratch_dir(spark).removeprefix("file:") + "/telltale"
    written = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = written()
    result = corpus_pipeline.run(spark, sf_dir)
    left = written() - before
    assert len(left) == 1 and next(iter(left)).startswith("stage-mixture-") and result.count() > 0
