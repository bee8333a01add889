"""Ranked search against direct scoring of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from telltale.llm import ranking

LOWER = {c: c + 32 for c in range(65, 91)}
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, queries, k):
    """``(item, rank, doc, score)`` by scoring every document."""
    kept = [(i, Counter(t)) for i, t in ((i, terms_of(t)) for i, t in docs) if t]
    total = sum(sum(c.values()) for _, c in kept)
    df = Counter(w for _, c in kept for w in c)
    rows = []
    for item, text in queries:
        scored = []
        for doc, c in kept:
            m, score = 10 + 90 * sum(c.values()) * len(kept) // total, 0
            for w in set(terms_of(text)) & c.keys():
                score += math.floor(1000 * math.log((2 * len(kept) + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        rows += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return rows


def found(docs, queries, k=10, **names):
    return [tuple(r) for r in ranking.search(docs, queries, k, **names).collect()]


def plain(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0))


@pytest.mark.parametrize("leaf,width,block", [(48, 48, 4096), (1, 2, 64), (4, 1, 7)])
def test_against_all_scores(spark, monkeypatch, leaf, width, block):
    for name, value in (("LEAF", leaf), ("WIDTH", width), ("BLOCK_DOCS", block)):
        monkeypatch.setattr(ranking, name, value)
    draw = random.Random(leaf)
    words = [f"W{i}" if i % 3 else f"ü{i}-x{i % 5}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(draw.choices(words, weights, k=draw.randrange(0, 40)))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(100)]  # ties
    queries = [(i, " ".join(draw.choices(words, weights, k=draw.randrange(1, 15)))) for i in range(25)]
    expected = brute(docs, queries, 10)
    got = found(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "item_id long, text string"))
    assert plain(got) == plain(expected)


def test_blocks_of_queries_and_other_ids(spark, monkeypatch):
    monkeypatch.setattr(ranking, "QUERY_BYTES", 16)
    docs = spark.createDataFrame([("b", "red fox"), ("a", "red fox"), ("c", "blue fox blue"), (None, "red fox")], "name string, body string")
    queries = spark.createDataFrame([(1, "red"), (2, "blue fox"), (2, "blue fox"), (3, "none"), (4, None)], "item_id long, text string")
    rows = plain(found(docs, queries, 2, id_col="name", text_col="body"))
    assert [(r[0], r[1], r[2]) for r in rows if r[0] == 1] == [(1, 1, "a"), (1, 2, "b")]
    assert [(r[0], r[1], r[2]) for r in rows if r[0] == 2] == [(2, 1, "c"), (2, 1, "c"), (2, 2, "a"), (2, 2, "a")]
    assert {r[0] for r in rows} == {1, 2}


def test_odd_rows(spark, odd, nothing, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    queries = [(1, "same TEXT here"), (2, "wort5x5 wort6x6"), (3, ""), (4, None), (None, "x" * 300_000), (5, "mail 017 nowhere"), (6, "a b")]
    asked = spark.createDataFrame(queries, "item_id long, text string").selectExpr("*", "1 AS score", "2 AS rank", "'x' AS doc_id")
    assert plain(found(odd, asked)) == plain(brute(docs, queries, 10))
    assert found(nothing, asked) == [] and found(odd, asked.limit(0)) == []


def test_range_maxima_are_the_first_of_the_largest():
    values = np.array([3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9])
    ranges = [(i, j) for i in range(len(values)) for j in range(i + 1, len(values) + 1)]
    low, high = (np.array(x) for x in zip(*ranges, strict=True))
    assert ranking.RangeMaxima(values, len(values))(low, high).tolist() == [i + int(values[i:j].argmax()) for i, j in ranges]


def test_intervals_without_a_chance_stay_closed(monkeypatch):
    """With one document that holds a rare term, few of many documents are scored."""
    count = 4096
    place = np.concatenate([np.arange(count), [1000, 2000, 3000]])
    block = ranking.Block(list(range(count)), np.full(count, 10), np.array([0, 1]), np.array([count, 3]), place, np.ones(count + 3, int), count, 10 * count)
    scored, direct = [], block.scores

    def counted(*args):
        out = direct(*args)
        scored.append(len(out[0]))
        return out

    monkeypatch.setattr(block, "scores", counted)
    best: list = []
    block.improve(best, list(range(count)), np.array([0, 1]), np.array([1, 8000]), 3)
    assert [b[2] for b in best] == [1000, 2000, 3000] and sum(scored) < count / 8
