"""Exact and near duplicates, passages, and mixing against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from telltale.llm import exact, mixing, passages, simhash
from telltale.llm.components import connected_components
from telltale.llm.queries import QUERIES

SPACE = re.compile(r"[\x20\t-\r]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("block_bytes", [3, 4096])
def test_exact_on_odd_rows(odd, block_bytes):
    rows = exact.exact_duplicates(odd, block_bytes=block_bytes).collect() if block_bytes > 3 else exact.exact_duplicates(odd.where("length(text) < 100 OR text IS NULL"), block_bytes=3).collect()
    source = [r for r in odd.collect() if block_bytes > 3 or not r.text or len(r.text) < 100]
    text = lambda r: SPACE.sub(" ", r.text or "")
    sizes = Counter(map(text, source))
    expected = Counter()
    for r in source:
        ids = [x.doc_id for x in source if text(x) == text(r) and x.doc_id is not None]
        expected[(r.doc_id, min(ids) if ids else None, sizes[text(r)], hashlib.sha256(text(r).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == expected
    assert sum(r.kept for r in rows) == len(sizes)  # exactly one row of each group, repeats included
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_names_need_no_hash(spark):
    """Texts that differ in one block only, at every level of the recursion."""
    texts = ["".join(x) for x in [("aaa", "bbb", "ccc", "ddd", "e"), ("aaa", "bbb", "ccc", "ddd"), ("aaa", "bbb", "ccc", "dde", "e"), ("bbb", "aaa", "ccc", "ddd", "e"), ("aaa", "bbb", "ccc", "ddd", "e")]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = exact.name_documents(df, block_bytes=3).collect()
    names = {r.doc_id: (r.level, r.name) for r in rows}
    assert names[0] == names[4]
    assert len({names[i] for i in range(4)}) == 4


def test_simhash_against_brute_force(spark, sf_dir, docs_rows):
    def slow(text):
        words = re.findall(r"[^\x20\t-\r]+", ascii_lower(text or ""))
        if not words:
            return 0
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {r[0]: slow(r[1]) for r in docs_rows}
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    label = components(prints, linked)
    rows = QUERIES["op8_simhash"](spark, sf_dir).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(d, f"{p:016x}", label[d]) for d, p in prints.items()}
    assert len(rows) == len(prints)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=6), st.data())
def test_links_are_complete(spark, seeds, data):
    values = set(seeds)
    for s in seeds:
        flips = data.draw(st.lists(st.lists(st.integers(0, 63), max_size=3), max_size=8))
        for f in flips:
            x = s
            for bit in f:
                x ^= 1 << bit
            values.add(x)
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fingerprint long")).collect()
    expected = {tuple(sorted((a, b))) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert {(r.a, r.b) for r in found} == expected
    assert len(found) == len(expected)


def test_near_duplicates_on_odd_rows(odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.fingerprint == 0} == {3}
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert simhash.near_duplicates(nothing).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12))
def test_edit_distance(a, b):
    assert passages.edit_distance(a, b) == plain_edits(a, b)


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=25, unique=True))
def test_chain_is_best(points):
    """The best chain's score equals that of a quadratic search, and chains rise in both coordinates."""
    import numpy as np

    points.sort()
    best = []
    for i, (x, y) in enumerate(points):
        before = [best[j] - 0.1 * (x - a + y - b) for j, (a, b) in enumerate(points[:i]) if a < x and b < y]
        best.append(6 + max(0, max(before, default=0)))
    found = passages.chain(np.array([p[0] for p in points]), np.array([p[1] for p in points]), max_gap=1000)
    scores = []
    for c in found:
        own = [points[i] for i in c]
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(own, own[1:], strict=False))
        scores.append(6 * len(own) - 0.1 * (own[-1][0] - own[0][0] + own[-1][1] - own[0][1]))
    assert abs(max(scores) - max(best)) < 1e-9
    assert sorted(i for c in found for i in c) == list(range(len(points)))


def test_passages_link_what_shares_fifty_words(spark, sf_dir, docs_rows):
    words = {d: (t or "").encode().lower().split() for d, t, _, _ in docs_rows}
    sharing: dict = {}
    for d, w in words.items():
        for i in range(len(w) - 50):
            sharing.setdefault(tuple(w[i : i + 51]), set()).add(d)
    groups = [g for run, g in sharing.items() if len(g) > 1 and len(set(run)) > 10]
    rows = passages.passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    label = components(words, [(r.doc_id, r.other_id) for r in rows])
    assert groups and all(len({label[d] for d in g}) == 1 for g in groups)
    for r in rows:
        own, other = words[r.doc_id][r.start : r.end], words[r.other_id][r.other_start : r.other_end]
        assert r.passage.encode().split() == own and min(len(own), len(other)) >= 50
        if len(own) < 400:
            assert plain_edits(own, other) == r.edits
        assert r.edits <= 0.2 * max(len(own), len(other))


def test_fuzzy_passage_is_found(spark):
    import random

    rng = random.Random(5)
    text = [f"w{rng.randrange(5000)}" for _ in range(120)]
    changed = list(text)
    for i in (25, 60, 95):
        changed[i] = "other"
    del changed[80]
    fill = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    rows = [(1, " ".join(fill(80) + text + fill(30))), (2, " ".join(fill(10) + changed + fill(99))), (3, " ".join(fill(200)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = passages.passages(df).collect()
    assert [(r.doc_id, r.other_id) for r in found] == [(2, 1)]
    assert found[0].edits == 4 and found[0].end - found[0].start == 119 and found[0].other_start == 80


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12))
def test_pairs_are_an_alignment_with_fewest_edits(a, b):
    found = [(-1, -1), *passages.pairs(a, b), (len(a), len(b))]
    assert all(a[i] == b[j] for i, j in found[1:-1])
    steps = [(q[0] - p[0] - 1, q[1] - p[1] - 1) for p, q in zip(found, found[1:], strict=False)]
    assert min(min(s) for s in steps) >= 0 and sum(map(max, steps)) == plain_edits(a, b)


@given(st.lists(st.booleans(), min_size=1, max_size=60), st.integers(1, 12))
def test_segments_cover_all_stretches_within_the_limit(same, least):
    import numpy as np

    x = np.flatnonzero(same)
    found = passages.segments(x, x, least, 0.2)
    edits = lambda s, e: (e - s) - sum(same[s:e])
    assert all(e - s >= least and edits(s, e) <= 0.2 * (e - s) + 1e-9 for s, e, _, _ in found)
    good = {w for s in x for e in x + 1 if e - s >= least and edits(s, e) <= 0.2 * (e - s) for w in range(s, e)}
    assert good <= {w for s, e, _, _ in found for w in range(s, e)}


def test_passages_near_each_other_are_all_found(spark):
    import random

    rng = random.Random(11)
    fill = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    rows, wanted = [], {}
    for n, (one, gap, two) in enumerate([(55, 30, 25), (60, 40, 55), (100, 50, 60)] * 12):
        first, second = fill(one), fill(two)
        for d in (2 * n, 2 * n + 1):
            rows.append((d, " ".join(fill(20) + first + fill(gap) + second + fill(20))))
        wanted[2 * n + 1] = set(range(20, 20 + one)) | (set(range(20 + one + gap, 20 + one + gap + two)) if two >= 50 else set())
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    for d, words in wanted.items():
        assert words <= {w for r in found if r.doc_id == d for w in range(r.start, r.end)}
    assert all(r.edits <= 0.2 * max(r.end - r.start, r.other_end - r.other_start) for r in found)


def filler(rng):
    return lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]


def covered(found, doc, other):
    """Words of ``doc`` in passages it shares with ``other``, whichever of them has the row."""
    own = {w for r in found if (r.doc_id, r.other_id) == (doc, other) for w in range(r.start, r.end)}
    return own | {w for r in found if (r.doc_id, r.other_id) == (other, doc) for w in range(r.other_start, r.other_end)}


def test_passage_whose_halves_have_other_first_texts(spark):
    import random

    fill, rows = filler(random.Random(7)), []
    for _ in range(30):
        p = fill(70)
        for part in (p[:35], p[35:], p, p):
            rows.append((len(rows), " ".join(fill(30) + part + fill(30))))
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert all(covered(found, d + 3, d + 2) >= set(range(30, 100)) for d in range(0, len(rows), 4))


def test_fuzzy_passages_up_to_the_limit(spark):
    import random

    rng, rows = random.Random(9), []
    fill = filler(rng)
    for edits in (5, 10, 15):
        for _ in range(40):
            p = fill(100)
            q = list(p)
            for i in rng.sample(range(1, 99), edits):
                q[i] = rng.choice([fill(1)[0], fill(1)[0], "", f"{q[i]} {fill(1)[0]}"])
            rows += [(len(rows) + n, " ".join(fill(40) + " ".join(x).split() + fill(40))) for n, x in enumerate((p, q))]
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    hits = [len(covered(found, d, d + 1) & set(range(40, 140))) >= 80 for d in range(0, len(rows), 2)]
    assert sum(hits[:40]) == 40 and sum(hits[40:80]) >= 38 and sum(hits[80:]) >= 34


def test_repeated_passages_are_matched(spark):
    import random

    fill, rows = filler(random.Random(13)), []
    for _ in range(20):
        p, lines = fill(60), [fill(20) for _ in range(3)]
        twice, once = fill(30) + p + fill(100) + p + fill(30), fill(30) + p + fill(30)
        q = fill(60)
        later, before = fill(30) + q + fill(100) + q + fill(30), fill(30) + q + fill(30)
        scattered = sum([fill(40) + x for x in lines], []) + fill(40) + sum(lines, []) + fill(20)
        rows += [(len(rows) + n, " ".join(t)) for n, t in enumerate((twice, once, before, later, scattered, fill(30) + sum(lines, []) + fill(30)))]
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    for d in range(0, len(rows), 6):
        for doc, other in ((d, d + 1), (d + 3, d + 2)):
            assert covered(found, doc, other) >= set(range(30, 90)) | set(range(190, 250))
        assert covered(found, d + 5, d + 4) >= set(range(30, 90))


def test_passage_in_texts_that_meet_a_first_text_with_less_of_it(spark):
    """Two texts share 60 words, of which earlier texts hold 45 at either end, and a word differs here and there."""
    import random

    rng, rows = random.Random(17), []
    fill = filler(rng)
    for _ in range(20):
        p = fill(60)
        q = list(p)
        for i in rng.sample(range(3, 57), 4):
            q[i] = fill(1)[0]
        for part in (p[:45], p[15:], p, q):
            rows.append((len(rows), " ".join(fill(30) + part + fill(30))))
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert all(len(covered(found, d + 3, d + 2) & set(range(30, 90))) >= 52 for d in range(0, len(rows), 4))


def test_passages_of_copies_go_by_their_first_text(spark):
    import random

    fill = filler(random.Random(19))
    p = fill(60)
    whole, other = fill(30) + p + fill(30), fill(10) + p + fill(50)
    rows = [(10, " ".join(whole)), (11, "\t".join(whole).upper()), *[(20 + n, " ".join(fill(20) + p)) for n in range(30)], (90, " ".join(other)), (12, " ".join(whole)), (91, "a b"), (92, "a b")]
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    copies = sorted((r.doc_id, r.other_id, r.start, r.end, r.other_start, r.other_end, r.edits, r.passage) for r in found if r.doc_id in (11, 12))
    assert copies == [(d, 10, 0, 120, 0, 120, 0, " ".join(whole)) for d in (11, 12)]
    assert len(found) < 100 and all(covered(found, d, 10) >= set(range(s, s + 60)) for d, s in [(90, 10), *[(20 + n, 20) for n in range(30)]])


def test_pieces_are_cut_before_they_leave_spark(spark, monkeypatch):
    """What goes to Python for a chain depends on the chain, not on the texts: a long text is joined to each of its chains."""
    import random

    fill = filler(random.Random(23))
    shared = [fill(60) for _ in range(8)]
    rows = [(0, " ".join(w for p in shared for w in fill(500) + p)), *[(1 + i, "\t ".join(fill(2000) + p + fill(2000))) for i, p in enumerate(shared)]]
    docs, sent = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), []
    own = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, *rest, **more: (sent.append(df), own(df, *rest, **more))[1])
    found = passages.passages(docs).collect()
    assert sorted((r.doc_id, r.start, r.end, r.other_id, r.other_start, r.other_end, r.edits, r.passage) for r in found) == [
        (1 + i, 2000, 2060, 0, 560 * i + 500, 560 * i + 560, 0, " ".join(p)) for i, p in enumerate(shared)
    ]
    chained = [df for df in sent if "seeds" in df.columns]
    size = [c for c, kind in chained[0].dtypes if kind == "binary"]
    assert chained and len(size) == 3
    assert all(sum(len(r[c]) for c, kind in df.dtypes if kind == "binary") < 4000 for df in chained for r in df.collect())


def test_pieces_are_the_words_around_a_chain(spark):
    from pyspark.sql import functions as F

    texts = [[f"w{i}" * (1 + i % 3) for i in range(n)] for n in (5, 15, 16, 17, 32, 33, 80, 129)]
    docs = spark.createDataFrame([(r, r, " \n".join(w).upper() + " ") for r, w in enumerate(texts)], "row long, doc_id long, text string")
    spans = [(r, s, e) for r, w in enumerate(texts) for s in range(0, len(w), 3) for e in {s + 5, s + 16, len(w)} if s < e <= len(w)]
    source = passages.normalised(docs.withColumn("text", F.col("text").cast("binary")), 1)
    found = source.join(spark.createDataFrame(spans, "row long, s int, e int"), "row").select("row", "s", "e", *passages._cut("s", "e", "begin", "piece")).collect()
    expected = [(r, s, e, max(0, s - 32), texts[r][max(0, s - 32) : e + 32]) for r, s, e in spans]
    assert sorted((r.row, r.s, r.e, r.begin, bytes(r.piece).decode().split(" "), r.piece_words) for r in found) == sorted((*x, len(x[-1])) for x in expected)


def test_chains_of_pairs_are_those_of_the_search(spark):
    """Pairs told apart at a glance have the chains that ``chain`` finds, at and around the limits too."""
    import numpy as np

    rng, pairs = np.random.default_rng(5), []
    for dx in (0, 1, 29, 30, 31, 63):
        for dy in (-1, 0, 1, 29, 30, 31, 59, 60, 64):
            pairs += [[(7, 70), (7 + dx, 70 + dy)], [(1, 2), (3, 4), (3 + dx, 4 + dy)]]
    pairs += [sorted({(int(x), int(y)) for x, y in rng.integers(0, size, (n, 2))}) for n in (2, 3, 8) for size in (20, 90) for _ in range(20)]
    matches = [(r, r % 3, x, y) for r, own in enumerate(pairs, 10) for x, y in own]
    found = passages.chains(spark.createDataFrame(matches, "row long, other long, spot int, place int")).collect()
    expected = []
    for r, own in enumerate(pairs, 10):
        x, y = np.array(sorted(own), np.int32).T
        for c in passages.chain(x, y):
            if len(c) > 1:
                expected.append((r, r % 3, x[c[0]], x[c[-1]] + 4, y[c[0]], y[c[-1]] + 4, np.concatenate([x[c], y[c]]).tobytes()))
    assert sorted((r.row, r.other, r.a, r.b, r.c, r.d, bytes(r.seeds)) for r in found) == sorted(expected)


@given(*[st.lists(st.sampled_from([b"a", b"b", b"c", b"d", b"e"]), max_size=12)] * 2, st.integers(0, 8))
def test_alike_counts_equal_words(a, b, least):
    assert passages.alike(a, b, least) == ((Counter(a) & Counter(b)).total() >= least)


def test_places_meet_as_one_by_one():
    """``met`` against loops over all texts that have a key."""
    import numpy as np

    rng = np.random.default_rng(3)
    for most in (2, 4, 100):
        place = np.array(sorted({(int(k), int(r), int(s)) for k, r, s in rng.integers(0, (6, 7, 9), (150, 3))}))
        key, row, spot = place.T
        x, y, texts = passages.met(key, row, most)
        own: dict = {}
        for i, (k, r) in enumerate(zip(key.tolist(), row.tolist(), strict=True)):
            own.setdefault(k, {}).setdefault(r, []).append(i)
        expected = set()
        for k, by_row in own.items():
            assert set(texts[key == k]) == {len(by_row)}
            order = sorted(by_row)
            for r in order:
                p = by_row[r]
                if len(order) > most:
                    firsts = [next(q for q in order if len(by_row[q]) > j) for j in range(len(p))]
                    expected |= {(i, by_row[f][j]) for j, (i, f) in enumerate(zip(p, firsts, strict=True)) if f != r}
                    expected |= {(i, by_row[order[0]][0]) for i in p[1:] if r != order[0]} | {(by_row[order[-1]][0], j) for j in by_row[order[0]][1:]}
                    continue
                for q in [q for q in order if q < r]:
                    o = by_row[q]
                    expected |= set(zip(p, o, strict=False)) | {(i, o[0]) for i in p[1:]} | {(p[0], j) for j in o[1:]}
        assert set(zip(x.tolist(), y.tolist(), strict=True)) == expected


def test_passages_on_odd_rows(odd, nothing):
    found = passages.passages(odd).collect()
    assert {frozenset((r.doc_id, r.other_id)) for r in found} == {frozenset((7, 8))}
    assert passages.passages(nothing).count() == 0


def brute_mix(rows, share=1.5, most=2):
    """Targets by repeated sharing, exactly as the words of the task put it."""
    size = lambda t: len(re.findall(r"[^\x20\t-\r]+", t or ""))
    total: dict = {}
    for _, text, source in rows:
        total[source] = total.get(source, 0) + size(text)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), share * sum(total.values()), set(order)
    while left > 1e-9 and open_:
        whole = sum(weight[s] for s in open_)
        given_, left = left, 0.0
        for s in list(open_):
            target[s] += given_ * weight[s] / whole
            if target[s] >= most * total[s]:
                left += target[s] - most * total[s]
                target[s] = most * total[s]
                open_.discard(s)
    return total, target, size


def test_mix_targets_and_takes(odd, nothing, spark, sf_dir, docs_rows):
    for rows, df in (
        ([(r.doc_id, r.text, r.source) for r in odd.collect()], odd),
        ([(d, t, s) for d, t, _, s in docs_rows], spark.read.parquet(f"{sf_dir}/documents.parquet")),
    ):
        total, target, size = brute_mix(rows)
        found = mixing.mix_sources(df).collect()
        assert Counter((r.doc_id, r.size) for r in found) == Counter((d, size(t)) for d, t, _ in rows)
        assert all(0 <= r.taken <= 2 * r.size for r in found)
        assert sorted({round(r.target, 6) for r in found}) == sorted({round(t, 6) for t in target.values()})
        by_target: dict = {}
        for r in found:
            by_target.setdefault((r.source_size, round(r.target, 6)), []).append(r)
        for (_, goal), own in by_target.items():
            groups = sum(1 for s in total if (total[s], round(target[s], 6)) == (own[0].source_size, goal))
            largest = max([r.size for r in own])
            assert abs(sum(r.taken for r in own) - goal * groups) <= groups * 2 * largest
        assert Counter(found) == Counter(mixing.mix_sources(df.repartition(5)).collect())
    assert mixing.mix_sources(nothing).count() == 0
