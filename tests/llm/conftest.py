from __future__ import annotations

import duckdb
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, score string, kept int, name string, chain int, key binary, size string, taken boolean"


@pytest.fixture(scope="session")
def docs_rows(sf_dir):
    """(doc_id, text, lang, source) of the smallest documents."""
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{sf_dir}/documents.parquet' ORDER BY 1").fetchall()


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Rows with nulls, blanks, ties, repeats, very long texts, and columns whose names operators use themselves."""
    words = [f"wort{i % 97}x{i % 13}" for i in range(60_000)]
    rows = [
        (1, "Same text here, with words enough.", "en", "a"),
        (2, "Same  text\there, with words enough.", "en", None),
        (2, "Same  text\there, with words enough.", "en", None),
        (None, "Same text here, with words enough.", None, "b"),
        (3, None, "en", "a"),
        (4, "", "de", "a"),
        (None, None, None, None),
        (5, " \t\n ", "fr", "b"),
        (6, "12345 !!! 678", "en", "c"),
        (7, " ".join(words), "de", "c"),
        (8, " ".join(words), "de", "c"),
        (9, "x" * 300_000, "en", "c"),
        (10, "a b", "en", "ü"),
        (11, "mail a.b@example.com or +1 (017) 555-7713", "en", "ü"),
    ]
    full = [(*r, len(r[1]) if r[1] else None, 7, "s", 1, "n", 3, b"k", "big", True) for r in rows]
    path = str(tmp_path_factory.mktemp("odd") / "docs")
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
