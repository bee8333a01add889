"""Language ID, personal data, URLs, toxicity, decontamination and language-model scores."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from telltale.llm import decontaminate, language, neural, pii, toxicity, urls
from telltale.llm.queries import QUERIES, RULES


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_languages_held_out(spark, sf_dir, docs_rows):
    rows = QUERIES["op1_language_id"](spark, sf_dir).collect()
    lang = {r[0]: r[2] for r in docs_rows}
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows) and len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.97


def test_languages_on_odd_rows(odd, nothing, spark):
    model = language.fit(odd, bits=14)
    assert model.languages == ["de", "en", "fr"]
    rows = {(r.doc_id, r.lang_pred) for r in language.identify(odd, model).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (6, "und"), (None, "und"), (7, "de"), (1, "en"), (9, "en"), (10, "en")} <= rows
    assert language.identify(odd, model).count() == odd.count()
    empty = language.fit(nothing)
    assert {r.lang_pred for r in language.identify(odd, empty).collect()} == {"und"}
    assert language.identify(nothing, model).count() == 0


def test_letters_beyond_the_basic_plane():
    _, _, has = language.grams(["\U0001f600 \U0001f680!", "\U00010400bc", "\u4e2d", "\u0301"], language._letters())
    assert has.tolist() == [False, True, True, False]


def test_filter_has_no_misses_and_few_false_hits(spark):
    """Every n-gram that was put in is found; of others about as many as the fill says."""
    rows = [(i, " ".join(f"{a}{b}{c}" for a, b, c in itertools.product(chars, repeat=3)), name) for i, (chars, name) in enumerate((("abcdefg", "x"), ("mnopqrs", "y")))]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), bits=14)
    letters = language._letters()
    for lang, (_, text, _) in enumerate(rows):
        keys, owner, _ = language.grams([text], letters)
        hits = model.hits(keys, owner, 1)[0]
        assert hits[lang] == len(keys)
        assert abs(hits[1 - lang] / len(keys) - model.false_hits[1 - lang]) < 0.05


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            even = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and even % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), n, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.@+-_%19 0()\n4é", max_size=40))
def test_patterns_are_those_of_the_contract(text):
    assert pii.pattern_spans(text) == base_spans(text)


def test_pii_query(spark, sf_dir, docs_rows):
    text = {r[0]: r[1] or "" for r in docs_rows}
    rows = QUERIES["op4_pii"](spark, sf_dir).collect()
    assert len(rows) == len(text)
    for r in rows:
        base = base_spans(text[r.doc_id])
        joined = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert set(joined) <= set(r.spans.split(","))


def test_field_learns_and_decodes_exactly():
    field = pii.fit()
    for example in pii.EXAMPLES:
        words, labels = pii.marked(example)
        assert list(pii.viterbi([field.scores(words)], field.move)[0]) == labels
    rng = np.random.default_rng(3)
    scores = [rng.normal(size=(n, len(pii.LABELS))) for n in (1, 3, 4)]
    for own, got in zip(scores, pii.viterbi(scores, field.move), strict=True):
        def value(path, own=own):
            start = -1e4 if pii.LABELS[path[0]][0] == "I" else 0
            return start + sum(own[t, x] for t, x in enumerate(path)) + sum(field.move[a, b] for a, b in zip(path, path[1:], strict=False))

        best = max(itertools.product(range(len(pii.LABELS)), repeat=len(own)), key=value) if len(own) < 4 else None
        assert best is None or list(best) == list(got)
    found = pii.decoded_spans(["reach jane.roe (at) example (dot) org or (555) 123-4567 now", "it is (at best) 12 of 2024"], field)
    assert [k for k, _, _ in found[0]] == ["email", "phone"] and found[1] == []


def test_pii_on_odd_rows(odd, nothing):
    field = pii.fit()
    rows = pii.find(odd, field).collect()
    assert len(rows) == odd.count() and sum(r.n_email + r.n_phone for r in rows) == 2
    assert pii.find(nothing, field).count() == 0


def test_letters_part_numbers():
    """A hash of hexadecimal digits is no card, whatever its digits add up to; a card may have words around it."""
    number = "4111111111111111"
    assert pii.plausible("card", number) and pii.plausible("card", "nr:4111 1111-1111 1111.")
    for at in (1, 5, 11):
        assert not pii.plausible("card", number[:at] + "a" + number[at:])
    assert not pii.plausible("card", "4a1b1c1d1e1f1a1b1c1d1e1f1a1b1c1d")


def test_url_rules_and_parts(spark):
    cases = [
        (1, "https://WWW.Example.NET/en/1?x#y", "www.example.net", "/en/1", "example.net/en/", "allow"),
        (2, "http://a.net/x", "a.net", "/x", "net/", "block"),
        (3, "http://a.net", "a.net", "", None, None),
        (4, "x://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        (5, "x://notexample.com/de/", "notexample.com", "/de/", None, None),
        (6, None, "", "", None, None),
        (7, "no url", "", "", None, None),
        (8, "x://a.org/fr/?q=://b.net/", "a.org", "/fr/", "org/fr/", "allow"),
        (8, "x://a.org/fr/?q=://b.net/", "a.org", "/fr/", "org/fr/", "allow"),
        (None, "", "", "", None, None),
    ]
    df = spark.createDataFrame([(c[0], c[1], "h", "p") for c in cases], "page_id long, url string, host string, rule string")
    rows = urls.filter_urls(df, RULES).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in rows) == Counter((c[0], c[2], c[3], c[4]) for c in cases)
    want = {c[0]: c[5] for c in cases if c[5]}
    assert all(r.verdict == want.get(r.page_id, r.verdict) and r.verdict in ("allow", "block") for r in rows)
    assert urls.filter_urls(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in urls.filter_urls(df.where("page_id = 7"), RULES).collect()} == {"allow"}


def test_mined_rules_against_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host, path = urls.url_parts(pages["url"])
    seen = pages.select("page_id", urls.matched_rule(host, path, RULES).alias("hit"), urls.url_tokens(pages["url"], host, path, RULES).alias("tokens")).collect()
    labelled = [(frozenset(r.tokens), r.hit.verdict) for r in seen if r.hit]
    count: Counter = Counter()
    for tokens, verdict in labelled:
        for n in range(1, len(tokens) + 1):
            for part in itertools.combinations(sorted(tokens), n):
                count[part, None] += 1
                count[part, verdict] += 1
    base = Counter(v for _, v in labelled)
    least = math.ceil(0.05 * len(labelled))
    rules = {}
    for (part, verdict), n in count.items():
        if verdict and n >= least and n / count[part, None] >= 0.8 and n / count[part, None] > base[verdict] / len(labelled):
            rules[part, verdict] = (n / count[part, None], n / len(labelled))
    kept = {
        k: v for k, v in rules.items()
        if not any((part, k[1]) in rules and rules[part, k[1]][0] >= v[0] for part in (k[0][:i] + k[0][i + 1 :] for i in range(len(k[0]))) if part)
    }
    frame = spark.createDataFrame([(sorted(t), v) for t, v in labelled], "tokens array<string>, verdict string")
    found = urls.mine(frame, 0.05, 0.8).collect()
    # An item stands for each of the tokens that are alike; a rule of the brute force has one of each.
    assert {(tuple(sorted(part)), r.verdict) for r in found for part in itertools.product(*r.alike)} == set(kept)
    assert all(r["items"] == [own[0] for own in r.alike] and r.rarest in r.alike for r in found)
    verdicts = {r.page_id: r.verdict for r in urls.filter_urls(pages, RULES, min_support=0.05).collect()}
    for r in seen:
        fits = [(*kept[k], k[1]) for k in kept if set(k[0]) <= set(r.tokens)]
        assert verdicts[r.page_id] == (r.hit.verdict if r.hit else max(fits)[2] if fits else "allow")


def test_tokens_that_always_occur_together(spark):
    """Forty parameter names of one family of urls are one item, not 2^40 sets of them; the rule fits wherever one of them occurs."""
    family = "&".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}=1" for i in range(40))
    pages = [(i, f"http://{'abcd'[i % 4]}.net/x?{family}") for i in range(60)] + [(100 + i, f"http://{'abcd'[i % 4]}.org/fr/y") for i in range(60)]
    pages += [(200, "http://q.com/z?pca=3&other=1"), (201, "http://q.com/z?other=1"), (202, "http://q.com/z?paa&pnb=2"), (203, "http://q.com/" + "a/" * 40_000)]
    start = time.monotonic()
    frame = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "1 AS key", "'t' AS tokens", "2 AS n", "3 AS verdict")
    rows = {r.page_id: r for r in urls.filter_urls(frame, RULES).collect()}
    assert time.monotonic() - start < 30
    assert all(rows[i].verdict == "block" and rows[i].rule == "net/" for i in range(60)) and all(rows[100 + i].verdict == "allow" for i in range(60))
    assert [rows[i].verdict for i in (200, 201, 202, 203)] == ["block", "allow", "block", "allow"]


def plain_ratio(word, words, counts):
    """Log ratio of a word by the recursion itself."""
    grams = [Counter(), Counter()]
    for w, own in zip(words, counts, strict=True):
        text = b" " + w + b" "
        for c in (0, 1):
            for k in range(1, toxicity.ORDER + 1):
                for i in range(len(text) - k + 1):
                    grams[c][text[i : i + k]] += own[c]
    for g in list(grams[0]):
        if len(g) > toxicity.SHARED_ORDER + 2 and grams[0][g] + grams[1][g] < 2:
            grams[0][g] = grams[1][g] = 0

    def adjusted(c, k):
        found: Counter = Counter()
        if k == toxicity.ORDER:
            return Counter({g: n for g, n in grams[c].items() if len(g) == k and n})
        for g, n in grams[c].items():
            if len(g) == k and g[:1] == b" " and n:
                found[g] = n
            if len(g) == k + 1 and g[1:2] != b" " and n:
                found[g[1:]] += 1
        return found

    tables = {(c, k): adjusted(c, k) for c in (0, 1) for k in range(1, toxicity.ORDER + 1)}
    for k in range(1, toxicity.SHARED_ORDER + 1):
        tables[0, k] = tables[1, k] = tables[0, k] + tables[1, k]

    def prob(c, g):
        if g in (b"", b" "):
            return 1 / 256
        table = tables[c, len(g)]
        same = [n for x, n in table.items() if x[:-1] == g[:-1] and x != b" "]
        below = prob(c, g[1:])
        if not same:
            return below
        d = toxicity.DISCOUNT
        return max(table[g] - d, 0) / sum(same) + d * len(same) / sum(same) * below

    text = b" " + word + b" "
    spans = [text[max(0, i - toxicity.ORDER + 1) : i + 1] for i in range(1, len(text))]
    return sum(math.log(prob(1, g)) - math.log(prob(0, g)) for g in spans)


def test_kneser_ney_gains_are_the_recursion():
    words = [b"hello", b"help", b"idiot", b"idiots", b"nonsense", b"the", b"then"]
    counts = np.array([[8, 1], [7, 2], [0, 9], [0, 3], [1, 0], [20, 20], [2, 5]], float)
    scorer = toxicity.Scorer(*toxicity.kneser_ney(words, counts))
    asked = [*words, b"idiotic", b"helper", b"zzz", b"a"]
    found = scorer.of_words(b" " + b" ".join(asked) + b" ", len(asked))
    for word, value in zip(asked, found, strict=True):
        assert value == pytest.approx(plain_ratio(word, words, counts), abs=0.02), word
    assert found[2] > 2 and found[0] < 0


def test_toxicity_held_out(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.1")
    rows = QUERIES["op6_toxicity"](spark, folder).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    bad, good = [r for r in held if labels[r.doc_id]], [r for r in held if not labels[r.doc_id]]
    assert np.mean([r.predicted for r in bad]) > 0.6 and np.mean([r.predicted for r in good]) < 0.03


def test_toxicity_on_odd_rows(odd, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 0), (8, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    assert toxicity.score(odd, model).where("score BETWEEN 0 AND 1").count() == odd.count()
    assert toxicity.score(nothing, model).count() == 0
    assert {r.score < 0.5 for r in toxicity.score(odd, toxicity.fit(odd, labels.where("toxic = 0"))).collect()} == {True}
    toxicity.score(odd, toxicity.fit(nothing, labels)).count()


@settings(deadline=None)
@given(st.binary(min_size=1, max_size=12).map(lambda b: bytes(97 + x % 3 for x in b)), st.binary(max_size=30).map(lambda b: bytes(97 + x % 3 for x in b)))
def test_myers_is_the_best_substring_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        nxt = [i]
        for j, y in enumerate(text, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    found = decontaminate.myers(pattern, text, len(pattern))
    assert found[0] == min(row) and (found[0] == len(pattern) or row[found[1]] == found[0])


def test_leaks_against_brute_force(spark, sf_dir, docs_rows):
    plain = lambda t: " ".join(re.split(r"[\x20\t-\r]+", t or "")).strip().lower()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {d: plain(t) for d, t, _, _ in docs_rows}
    exact = {(d, i) for i, t in items for d, x in texts.items() if plain(t) in x}
    rows = QUERIES["op9_decontaminate"](spark, sf_dir).collect()
    assert {(r.doc_id, r.item_id) for r in rows if r.edits == 0} == exact
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})


@pytest.mark.parametrize("blocks", [1, 50])
def test_leaks_with_edits_at_the_budget(spark, blocks, monkeypatch):
    import random

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(8)]
    rows, expected = [], set()
    for i, text in items:
        budget = decontaminate.budget_of(len(text), 0.05)
        for edits in (0, budget, 3 * budget + 8):
            spoilt = list(text)
            for at in rng.sample(range(len(text)), edits):
                spoilt[at] = "#"
            rows.append((len(rows), " ".join(word() for _ in range(40)) + " " + "".join(spoilt).upper() + "\n" + word()))
            if edits <= budget:
                expected.add((rows[-1][0], i))
    rows += [(100, None), (101, ""), (102, "short")]
    monkeypatch.setattr(decontaminate, "BLOCK_OF_ITEMS_BYTES", sum(len(t) for _, t in items) // blocks + 1)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, item_id string, edits int")
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "too short"), (0, items[0][1])], "item_id long, text string")
    found = decontaminate.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected
    assert decontaminate.leaks(docs.limit(0), bench).count() == decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_language_model(spark, sf_dir, docs_rows):
    counts, rows_in = Counter(), 0
    tokens = {d: (t or "").encode().lower().split() for d, t, _, _ in docs_rows}
    for d, own in tokens.items():
        if fold(d, 7) != 2:
            counts.update(own)
            rows_in += 1
    total, distinct = sum(counts.values()) + rows_in, len(counts) + 1
    rows = QUERIES["op10_lm_score"](spark, sf_dir).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        own = tokens[r.doc_id]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own) + math.log10((rows_in + 1) / (total + distinct + 1))
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.train_tokens == total and r.held_out == (fold(r.doc_id, 7) == 2)
        assert (r.n_tokens, r.n_known) == (len(own) + 1, 1 + sum(w in counts for w in own)) and r.score < 0


def test_rare_words_go_through_the_join(spark, sf_dir, monkeypatch):
    """With few words known in the tasks, the sums are the same."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = {r.doc_id: r for r in neural.score_texts(docs, reach=0.2, width=4).collect()}
    monkeypatch.setattr(neural, "KEPT_SHARE", 2e-3)
    for r in neural.score_texts(docs, reach=0.2, width=4).collect():
        assert r.base_score == pytest.approx(plain[r.doc_id].base_score) and r.n_known == plain[r.doc_id].n_known
        assert r.score == pytest.approx(plain[r.doc_id].score, rel=1e-3)


def plain_logs(model, far, near, word):
    """Natural log probabilities of tokens, written out: a softmax over all classes and one over the words of the class."""
    hidden = np.column_stack([model.context[far] @ model.far + model.context[near] @ model.near, np.ones(len(far))])
    out = []
    for h, w in zip(hidden, word, strict=True):
        g = int(np.searchsorted(model.bounds, w, side="right")) - 1
        classes, words = h @ model.groups.T, h @ model.target[model.bounds[g] : model.bounds[g + 1]].T
        out.append(classes[g] - np.log(np.exp(classes).sum()) + words[w - model.bounds[g]] - np.log(np.exp(words).sum()))
    return np.array(out)


def test_model_is_normalised_and_learns():
    unigram = np.array([0.1, 0.1, 0.3, 0.2, 0.2, 0.1])
    model = neural.start_model(unigram, 4, 1)
    assert model.bounds[0] == 0 and model.bounds[-1] == 6 and np.diff(model.bounds).max() > 1
    ids = np.tile(np.arange(2, 6, dtype=np.int32), 1000)
    far, near, word = neural.context_ids(ids, np.array([len(ids)]), 6)
    for n in range(60):
        neural.Trainer(model, unigram, 0.3, n).learn(far, near, word)
    scorer = neural.TextScorer(model)
    assert scorer([ids[:100].tobytes()])[0] / 101 > math.log10(0.4)  # better than the unigram
    every = np.arange(6)
    first = scorer.tokens(np.full(6, 6), np.full(6, 6), every)
    assert np.exp(first).sum() == pytest.approx(1, rel=1e-4)
    assert first == pytest.approx(plain_logs(model, np.full(6, 6), np.full(6, 6), every), abs=1e-3)
    model.groups[:, -1] += 500  # far beyond the range of exp
    assert neural.TextScorer(model).tokens(np.full(6, 6), np.full(6, 6), every) == pytest.approx(first, abs=1e-2)


def test_model_vocabulary_grows_with_the_corpus():
    sizes = []
    for total in (10**5, 10**7, 10**9):
        counts = total / 12 / np.arange(1, 200_000)
        sizes.append(neural.Vocabulary(10, total, 200_000, [], counts[counts >= max(1, neural.KEPT_SHARE * total)], neural.MODEL_REACH).size)
        bounds = neural.cut_classes(np.full(sizes[-1], 0.1) + counts[: sizes[-1]])
        assert list(bounds[:3]) == [0, 1, 2] and bounds[-1] == sizes[-1] and (np.diff(bounds) > 0).all() and len(bounds) <= sizes[-1] ** 0.5 + 4
    assert sizes[0] > 500 and sizes[1] > 4 * sizes[0] and sizes[2] > 4 * sizes[1]


def test_language_model_on_odd_rows(odd, nothing):
    rows = neural.score_texts(odd, reach=0.2, width=4).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert neural.score_texts(nothing, reach=0.2, width=4).count() == 0


def test_short_benchmark_items_are_searched(spark):
    docs = spark.createDataFrame([(1, "We ask: Who  wrote Faust? Goethe."), (2, "concatenate"), (3, "a cat."), (4, "what is the capitol of old france, then"), (5, None), (6, "wait ??? no"), (7, "wait??? no")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "who wrote faust?"), (2, "cat"), (3, "What is the capital of old France"), (4, "???"), (5, " "), (6, None)], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.edits, r.end) for r in decontaminate.leaks(docs, items).collect()}
    assert found == {(1, 1, 0, 24), (3, 2, 0, 5), (4, 3, 1, 33), (6, 4, 0, 8)}


def test_lm_scores_against_a_plain_softmax(spark, sf_dir, docs_rows, monkeypatch):
    """Every text's score is the sum of its tokens' log probabilities under the trained model, written out token by token."""
    kept, fit = {}, neural.fit_model
    monkeypatch.setattr(neural, "fit_model", lambda *a: kept.setdefault("model", fit(*a)))
    rows = {r["doc_id"]: r for r in QUERIES["op10_lm_score"](spark, sf_dir).collect()}
    model = neural.LogBilinear(*[a.astype(float) for a in kept["model"].arrays()], kept["model"].bounds)
    size = len(model.target)
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for i, t, *_ in docs_rows}
    learnt = [i for i in words if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for i in learnt for w in words[i])
    total = sum(counts.values()) + len(learnt)
    inside = {w: n + neural.SPECIAL for n, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w))[: size - neural.SPECIAL]) if counts[w] >= neural.KEPT_SHARE * total}
    assert set(inside) == {w for w, n in counts.items() if n >= max(neural.KEPT_SHARE * total, neural.MODEL_REACH * total ** (2 / 3))}
    rest = sum(n for w, n in counts.items() if w not in inside) + sum(w not in inside for w in counts) + 1
    assert len(rows) == len(words) and size == neural.SPECIAL + len(inside) > 512
    for i, own in words.items():
        ids = [inside.get(w, neural.OTHER) for w in own] + [neural.END]
        far, near = np.array([size, size, *ids])[: len(ids)], np.array([size, *ids])[: len(ids)]
        logs = plain_logs(model, far, near, ids)
        share = sum(math.log10((counts[w] + 1) / rest) for w in own if w not in inside)
        assert rows[i]["score"] == pytest.approx(logs.sum() / math.log(10) + share, rel=1e-4, abs=1e-2)
        assert rows[i]["held_out"] == (i not in set(learnt)) and rows[i]["train_tokens"] == total
