from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def resources(spark, sf_dir):
    """Fitted on the smallest data set, with the default text encoder."""
    from telltale import fixtures as X
    from telltale.plans.analyze import Resources
    from telltale.plans.knowledge_base import build_knowledge_base
    from telltale.session import materialise
    from telltale.workload import queries as W

    docs, encoder = build_knowledge_base(X.entries(spark, sf_dir))
    docs = materialise(docs, "test-docs")
    return Resources(W.index(spark, sf_dir), W.model(spark, sf_dir), docs, encoder)
