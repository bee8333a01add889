"""Personal data: fixed patterns, and a linear-chain conditional random field that adds what they miss."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telltale.llm.rows import small

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
Span = tuple[str, int, int]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
SIGN = re.compile(r"[0-9@+\[(]")
AT = re.compile(r"@|[(\[]\s*at\s*[)\]]", re.I)
WORD = re.compile(r"[^\x20\t-\r]+")
REACH = 64  # characters around a sign that are decoded with it

#: Labelled sentences; ``<kind:text>`` marks an entity. Any table of (text, spans) can take their place.
EXAMPLES = (
    "write to <email:jane.doe@mail.example.com> for more",
    "contact <email:a_b+c@x-y.example.org>, please",
    "ask <email:jane.doe (at) mail.example.com> about it",
    "mail <email:jane [at] example [dot] com> today",
    "send it to <email:info (at) example (dot) org>.",
    "reach <email:bob.smith[at]example.net> or wait",
    "from <email:kim(at)example.com> we heard",
    "the host <ip:10.0.0.1> answered",
    "at <ip:192.168.17.254>, port 80 is open",
    "from <ip:8.8.4.4> to <ip:97.51.17.173> in 20 ms",
    "card <card:4111 1111 1111 1111> was used",
    "paid with <card:4111111111111111> on 3 May",
    "number <card:4111-1111-1111-1111>, valid",
    "number <card:4111.1111.1111.1111> was read",
    "the card <card:5500/0000/0000/0004> expired",
    "an <card:340000000000009> card",
    "call <phone:+1 (017) 555-7713> now",
    "call <phone:+44 20 7946 0958> after six",
    "tel. <phone:+33.1.23.45.67.89>, evenings",
    "phone <phone:(017) 555-7713> at noon",
    "ring <phone:555-123-4567> or write",
    "dial <phone:(212) 555-0199>, please",
    "fax <phone:(030) 555-1234> is gone",
    "the year 2024 had 366 days",
    "version 2.0 of the license, see section 3.1.2",
    "in 1999 (see page 12) there were 1,024 of them",
    "number 4111111111111112 is an order",
    "item 9807915762804490 is in stock",
    "from 10 to 20 (about 15) it rose by 3.5%",
    "token = \"027aea05eb92c454086e6575cd38d76a884acaff\" and so on",
    "| one. | Two | three | 161 | four, | five.",
    "the list [1] and [2] says so (at least once)",
    "we met (at noon) near the house (at last)",
    "it costs $12.50 or 11,80 in all",
    "chapter 1.2.3 and build 300.400.500.600 differ",
    "token = \"d6a8f0b1c2\" was set in line 12",
    "on 2024-05-17 at 12:30 we left (late)",
    "5 + 7 = 12 and 3 + 4 = 7",
    "the plain text has no such thing",
    "version 3, or (at your option) any later one",
    "see @user and #tag in the post",
    "a score of 3-2 (half time 1-0) was enough",
    "sizes 10-20 and 30-40, groups 555 and 123",
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def is_card(text: str) -> bool:
    digits = NOT_DIGIT.sub("", text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in text.split("."))


def is_phone(text: str) -> bool:
    return 9 <= len(NOT_DIGIT.sub("", text)) <= 15


def plausible(kind: str, text: str) -> bool:
    """What an entity must hold for the field's word to count."""
    if kind == "email":
        return len(text) <= 254 and bool(AT.search(text))
    if kind == "ip":
        return bool(IP.search(text)) and all(is_ip(m) for m in IP.findall(text))
    if kind == "card":
        return any(is_card(m.group()) for m in CARD.finditer(text))  # digits parted by letters are no number
    return 7 <= len(NOT_DIGIT.sub("", text)) <= 15


def emails(text: str) -> list[Span]:
    """Leftmost matches of local part, ``@`` and domain, found from each ``@`` so that no other character is tried twice."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, done := found.end()))
        at = text.find("@", max(at + 1, done))
    return out


def pattern_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind; of each kind the leftmost that don't overlap; failing matches are dropped."""
    if not SIGN.search(text):
        return []
    out = emails(text)
    for kind, pattern, valid in (("ip", IP, is_ip), ("card", CARD, is_card), ("phone", PHONE, is_phone)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(m.group())]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def digest(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def shape(word: str) -> str:
    """Letters and runs of digits in short: ``Ab-12`` is ``Xx-92``; a run's length is told up to 4."""
    out: list[str] = []
    for c in word:
        s = "9" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c
        if s == "9" and out and out[-1][0] == "9":
            out[-1] = "9" + str(min(5, int(out[-1][1:]) + 1))
        elif s == "9":
            out.append("91")
        elif not out or out[-1] != s:
            out.append(s)
    return "".join(out[:24])


def word_features(words: list[str]) -> list[list[str]]:
    shapes = ["^", *[shape(w) for w in words], "$"]
    out = []
    for i, w in enumerate(words):
        digits = NOT_DIGIT.sub("", w)
        core = w.strip("()[].,;:\"'").lower()
        out.append(
            [
                "1", "s=" + shapes[i + 1], "p=" + shapes[i], "n=" + shapes[i + 2], f"d={min(len(digits), 20)}", "c=" + "".join(sorted({c for c in w if not c.isalnum()}))[:8],
                f"card={12 <= len(digits) <= 19 and luhn(digits)}", f"in={core}" if core in ("at", "dot") else "in=", f"pd={shapes[i]}{shapes[i + 1]}",
            ]
        )
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around digits, ``@``, ``+`` and opening brackets, cut at white space. An entity has such a sign, so the rest is no entity."""
    out: list[list[int]] = []
    for m in SIGN.finditer(text):
        lo, hi = max(0, m.start() - REACH), m.start() + REACH
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    whole = []
    for lo, hi in out:
        while 0 < lo < len(text) and not text[lo - 1].isspace() and not SIGN.match(text, lo):
            lo += 1
        hi = min(hi, len(text))
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        whole.append((lo, hi))
    return whole


@dataclass
class Field:
    """Weights of a linear chain: ``features`` (name to row of ``emit``), ``emit`` (rows, labels), ``move`` (from, to)."""

    features: dict[str, int]
    emit: np.ndarray
    move: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(LABELS)))
        for i, names in enumerate(word_features(words)):
            rows = [r for f in names if (r := self.features.get(f)) is not None]
            out[i] = self.emit[rows].sum(axis=0)
        return out


def allowed() -> np.ndarray:
    """0 where a label may follow another, else a large negative number: an inside label only continues its own kind."""
    out = np.zeros((len(LABELS), len(LABELS)))
    for a, x in enumerate(LABELS):
        for b, y in enumerate(LABELS):
            if y[0] == "I" and x[2:] != y[2:]:
                out[a, b] = -1e4
    return out


def marked(example: str) -> tuple[list[str], list[int]]:
    """Words and labels of a sentence with ``<kind:text>`` marks."""
    words, labels, at = [], [], 0
    for m in re.finditer(r"<(\w+):([^>]*)>([^\s]*)", example):
        before = example[at : m.start()].split()
        own = (m.group(2) + m.group(3)).split()
        words += before + own
        labels += [0] * len(before) + [LABELS.index(("B-" if i == 0 else "I-") + m.group(1)) for i in range(len(own))]
        at = m.end()
    rest = example[at:].split()
    return words + rest, labels + [0] * len(rest)


def fit(examples: Iterable[str] = EXAMPLES, steps: int = 300, rate: float = 0.3, ridge: float = 0.01) -> Field:
    """Maximise the regularised conditional likelihood with exact gradients (forward and backward sums over all sentences at once)."""
    data = [marked(e) for e in examples]
    names = [word_features(w) for w, _ in data]
    features = {f: i for i, f in enumerate(sorted({f for s in names for w in s for f in w}))}
    size, longest, n = len(LABELS), max(len(w) for w, _ in data), len(data)
    use = np.zeros((n, longest, len(features)), np.float32)
    gold, real = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for s, (words, labels) in enumerate(data):
        gold[s, : len(words)], real[s, : len(words)] = labels, True
        for i, own in enumerate(names[s]):
            use[s, i, [features[f] for f in own]] = 1
    flat = use.reshape(-1, len(features))
    rules, begin = allowed(), np.where([x[0] == "I" for x in LABELS], -1e4, 0.0)
    emit, move = np.zeros((len(features), size)), np.zeros((size, size))
    memory = [np.full(emit.shape, 1e-6), np.full(move.shape, 1e-6)]
    hot = np.eye(size)[gold] * real[..., None]
    both = real[:, 1:]
    pair_gold = np.einsum("sta,stb->ab", hot[:, :-1], hot[:, 1:] * both[..., None])
    for _ in range(steps):
        score = (flat @ emit).reshape(n, longest, size)
        step = move + rules
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0] + begin
        for t in range(1, longest):
            grown = _log_sum(ahead[:, t - 1, :, None] + step, 1) + score[:, t]
            ahead[:, t] = np.where(real[:, t, None], grown, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            grown = _log_sum(step + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(real[:, t + 1, None], grown, 0)
        total = _log_sum(ahead[:, -1], 1)
        node = np.exp(ahead + back - total[:, None, None]) * real[..., None]
        edge = np.exp(ahead[:, :-1, :, None] + step + (score[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]) * both[..., None, None]
        grads = [flat.T @ (hot - node).reshape(-1, size) - ridge * emit, pair_gold - edge.sum(axis=(0, 1)) - ridge * move]
        for array, grad, seen in zip((emit, move), grads, memory, strict=True):
            seen += grad * grad
            array += rate * grad / np.sqrt(seen)
    return Field(features, emit, move + rules)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def viterbi(scores: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """Best labels of many sequences, decoded together in batches of like length."""
    out: list[np.ndarray] = [np.zeros(0, int)] * len(scores)
    order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
    begin = np.where([x[0] == "I" for x in LABELS], -1e4, 0.0)
    for lo in range(0, len(order), 512):
        part = [i for i in order[lo : lo + 512] if len(scores[i])]
        if not part:
            continue
        lengths = np.array([len(scores[i]) for i in part])
        padded = np.zeros((len(part), lengths.max(), len(LABELS)))
        for row, i in enumerate(part):
            padded[row, : lengths[row]] = scores[i]
        best, links = padded[:, 0] + begin, np.zeros(padded.shape, np.int8)
        for t in range(1, padded.shape[1]):
            paths = best[:, :, None] + move
            links[:, t] = paths.argmax(axis=1)
            best = np.where((t < lengths)[:, None], paths.max(axis=1) + padded[:, t], best)
        for row, i in enumerate(part):
            label, own = int(best[row].argmax()), np.zeros(lengths[row], int)
            for t in range(lengths[row] - 1, -1, -1):
                own[t] = label
                label = int(links[row, t, label])
            out[i] = own
    return out


def decoded_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """Entities that the field finds in each text, without the marks around them."""
    owners, words, scores = [], [], []
    for i, text in enumerate(texts):
        for lo, hi in regions(text):
            own = [(m.start(), m.end()) for m in WORD.finditer(text, lo, hi)]
            owners.append(i)
            words.append(own)
            scores.append(field.scores([text[a:b] for a, b in own]))
    out: list[list[Span]] = [[] for _ in texts]
    for i, own, labels in zip(owners, words, viterbi(scores, field.move), strict=True):
        t = 0
        while t < len(own):
            if labels[t] == 0:
                t += 1
                continue
            kind, first = LABELS[labels[t]][2:], t
            t += 1
            while t < len(own) and LABELS[labels[t]] == f"I-{kind}":
                t += 1
            start, end = own[first][0], own[t - 1][1]
            while start < end and texts[i][start] in "<\"'[":
                start += 1
            while end > start and texts[i][end - 1] in ".,;:!?>\"'":
                end -= 1
            if end > start and plausible(kind, texts[i][start:end]):
                out[i].append((kind, start, end))
    return out


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_email, n_ip, n_card, n_phone, n_added, base_spans, spans``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind, joined by commas. ``base_spans`` and the four counts
    hold what the patterns find; ``spans`` also the entities that the field adds where no pattern matched. Null counts as
    empty, and an empty text has no spans. Repeated rows each return a row.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    longs = ["n_email", "n_ip", "n_card", "n_phone", "n_added"]
    fields = T.StructType([source.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in longs], T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches):
        for batch in small(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [pattern_spans(t) for t in texts]
            added = [
                [s for s in more if not any(s[1] < b and a < s[2] for _, a, b in own)] if more else []
                for own, more in zip(base, decoded_spans(texts, field), strict=True)
            ]
            every = [sorted({*a, *b}, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) for a, b in zip(base, added, strict=True)]
            counts = [pa.array([sum(s[0] == k for s in own) for own in base], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array([len(a) for a in added], pa.int64()), pa.array(map(digest, base), pa.string()), pa.array(map(digest, every), pa.string())], names=[f.name for f in fields]
            )

    return source.mapInArrow(run, fields)
