"""Toxicity from class-conditional Kneser-Ney models of the letters of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telltale.llm.rows import chunks, hash_share, small, texts
from telltale.llm.words import LETTERS, WordHasher, mix, owners

ORDER, SHARED_ORDER, DISCOUNT, STRONG = 8, 3, 0.75, 4.0
LONG_RUN, LEAST_GAIN = 5, 1e-3
SIEVE_BITS = 24
ROWS_PER_CLASS = 2_000
EVIDENCE = ("total", "number", "strong", "most")


def windows(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length 1 to ``ORDER`` the starts and keys of all runs of bytes inside a word with one blank on each side."""
    blank = data == 32
    key, open_run = np.zeros(len(data), np.uint64), np.ones(len(data), bool)
    for k in range(1, ORDER + 1):
        n = max(0, len(data) - k + 1)
        key = key[:n] * np.uint64(0x100000001B3) + data[k - 1 :].astype(np.uint64) + np.uint64(1)
        # Only the first and the last byte may be blank.
        open_run = open_run[:n] if k < 3 else open_run[:n] & ~blank[k - 2 : len(data) - 1]
        start = np.flatnonzero(open_run if k > 1 else ~blank)
        if k == 2:
            start = start[~(blank[start] & blank[start + 1])]
        yield start, mix(key[start] * np.uint64(16) + np.uint64(k))


@dataclass
class ToxicityModel:
    keys: np.ndarray  # sorted runs of letters
    gains: np.ndarray  # what each adds to log P(toxic text) - log P(ordinary text)
    weights: np.ndarray  # logistic weights of the features


def kneser_ney(words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters and their gains, from words and their counts in ordinary and toxic texts, ``(words, 2)``.

    Interpolated Kneser-Ney with one discount. Up to ``SHARED_ORDER`` letters the two classes share their counts, so what is rare
    in both is judged alike; longer contexts have counts of their own. Every log ratio is split so that a text's log-likelihood ratio is the sum
    of one gain per run of letters in it: what a run adds to its shorter suffix, and the back-off weight it has as a context.

    Two cuts bound the table: a run of more than ``LONG_RUN`` letters that occurs once in the fitted texts is left to its shorter runs, and a gain of up to
    ``LEAST_GAIN`` counts as none.
    """
    buffer = b" " + b" ".join(words) + b" "
    data = np.frombuffer(buffer, np.uint8)
    word_of = np.cumsum(data == 32) - 1
    levels = []
    for k, (start, key) in enumerate(windows(data), 1):
        value, first, gid = np.unique(key, return_index=True, return_inverse=True)
        at = np.full(len(data) + 1, -1, np.int32)
        at[start] = gid
        inside = word_of[start]  # a blank belongs to the word after it
        raw = np.stack([np.bincount(gid, counts[inside, c], len(value)) for c in (0, 1)], axis=1)
        if k > LONG_RUN:
            raw[raw.sum(axis=1) < 2] = 0
        levels.append({"key": value, "spot": start[first], "at": at, "raw": raw})
    lower = np.full((1, 2), 1 / 256.0)
    gains, ratio_below = {}, np.zeros(1)
    for k in range(1, ORDER + 1):
        level = levels[k - 1]
        seen = level["raw"].copy()
        if k < ORDER:
            above = levels[k]
            suffix = level["at"][above["spot"] + 1]
            ok = suffix >= 0
            left = np.stack([np.bincount(suffix[ok], (above["raw"][ok, c] > 0).astype(float), len(seen)) for c in (0, 1)], axis=1)
            inner = data[level["spot"]] != 32
            seen[inner] = left[inner]
        if k <= SHARED_ORDER:
            seen = np.repeat(seen.sum(axis=1, keepdims=True), 2, axis=1)
        context = levels[k - 2]["at"][level["spot"]] if k > 1 else np.zeros(len(seen), np.int64)
        # A blank at the start has no level of its own among single letters: all words share that context.
        size = (len(levels[k - 2]["key"]) if k > 1 else 0) + 1
        context = np.where(context < 0, size - 1, context)
        total = np.stack([np.bincount(context, seen[:, c], size) for c in (0, 1)], axis=1)
        types = np.stack([np.bincount(context, (seen[:, c] > 0).astype(float), size) for c in (0, 1)], axis=1)
        weight = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1e-9), 1.0)
        suffix = levels[k - 2]["at"][level["spot"] + 1] if k > 1 else np.zeros(len(seen), np.int64)
        below = np.where((suffix >= 0)[:, None], lower[np.maximum(suffix, 0)], 1 / 256.0)
        own = np.where(total[context] > 0, np.maximum(seen - DISCOUNT, 0) / np.maximum(total[context], 1e-9), 0.0)
        prob = own + weight[context] * below
        ratio = np.log(prob[:, 1]) - np.log(prob[:, 0])
        shift = np.log(weight[:, 1]) - np.log(weight[:, 0])
        before = np.where(suffix >= 0, ratio_below[np.maximum(suffix, 0)], 0.0)
        gains[k] = ratio - shift[context] - before
        if k > 1:
            gains[k - 1] = gains[k - 1] + shift[: len(gains[k - 1])]
        lower, ratio_below = prob, ratio
    keys = np.concatenate([levels[k - 1]["key"] for k in gains])
    gain = np.concatenate([gains[k] for k in gains])
    used = np.abs(gain) > LEAST_GAIN
    order = np.argsort(keys[used])
    return keys[used][order], gain[used][order].astype(np.float32)


class Scorer:
    """Log-likelihood ratios of many texts; each distinct word of a batch is looked up once."""

    def __init__(self, keys: np.ndarray, gains: np.ndarray):
        self.keys, self.gains, self.hasher = keys, gains, WordHasher()
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[keys >> np.uint64(64 - SIEVE_BITS)] = True

    def of_words(self, buffer: bytes, count: int) -> np.ndarray:
        """Of ``count`` words in a buffer that puts one blank before, between and after them."""
        data = np.frombuffer(buffer, np.uint8)
        word_of = np.cumsum(data == 32) - 1
        out = np.zeros(count)
        for start, key in windows(data):
            spot = np.flatnonzero(self.sieve[key >> np.uint64(64 - SIEVE_BITS)])
            if len(spot) and len(self.keys):
                found = key[spot]
                at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
                gain = np.where(self.keys[at] == found, self.gains[at], 0)
                out += np.bincount(np.minimum(word_of[start[spot]], count - 1), gain, count)
        return out

    def of_texts(self, values: list[bytes]) -> np.ndarray:
        """Evidence of each text from its distinct words: sum of log ratios, number, sum of what is above ``STRONG``, largest."""
        cleaned = [v.translate(LETTERS) for v in values]
        kept, owned, parts = [], [], []
        for lo, hi in chunks(cleaned):
            buffer = b" ".join(cleaned[lo:hi])
            hashes, starts, ends = self.hasher(buffer)
            value, first = np.unique(hashes, return_index=True)
            parts.append((value, [buffer[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]))
            kept.append(hashes)
            owned.append(lo + owners(starts, [len(t) for t in cleaned[lo:hi]]))
        out = np.zeros((len(values), 4))
        if not sum(map(len, kept)):
            return out
        value, first = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
        spelled = [w for p in parts for w in p[1]]
        spelled = [spelled[i] for i in first.tolist()]
        ratio = np.zeros(len(value))
        for lo, hi in chunks(spelled):
            ratio[lo:hi] = self.of_words(b" " + b" ".join(spelled[lo:hi]) + b" ", hi - lo)
        for hashes, owner in zip(kept, owned, strict=True):
            pair = np.unique(owner * len(value) + np.searchsorted(value, hashes))
            owner, gain = pair // len(value), ratio[pair % len(value)]
            for column, x in enumerate((gain, np.ones(len(gain)), np.maximum(gain - STRONG, 0))):
                out[:, column] += np.bincount(owner, x, len(values))
            begin = np.flatnonzero(np.diff(owner, prepend=-1))
            out[owner[begin], 3] = np.maximum.reduceat(gain, begin)
        return out


def features(evidence: np.ndarray) -> np.ndarray:
    """What the decision rests on, each near the range of 0 to 5.

    A constant, the log ratio per word and per root of the number of words, the strong words' part as a root and per word, the
    strongest word, and the logarithm of the number.
    """
    total, number, strong, most = evidence.T
    n = np.maximum(number, 1)
    columns = [np.ones(len(n)), total / n, total / np.sqrt(n) / 4, np.sqrt(strong) / 4, strong / n, np.minimum(most, 20) / 8, np.log(n) / 4]
    return np.stack(columns, axis=1)


def probability(evidence: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features(evidence) @ weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    where: Column | None = None, rows_per_class: int = ROWS_PER_CLASS,
) -> ToxicityModel:
    """Fit both class models on about ``rows_per_class`` labelled rows of each class and the threshold on half as many others.

    Rows are drawn by a hash of the id, so the fit's cost and the model's size don't grow with the input. ``where`` restricts the
    labels. Null ids and null labels teach nothing; an id that is labelled more than once counts as toxic if any of its labels does.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    known = known if where is None else known.where(where)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect() if r["label"] in (0, 1)}
    if len(sizes) < 2:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0, np.float32), _constant(-20.0 if 0 in sizes else 20.0 if 1 in sizes else 0.0))
    # Two thirds of each class at most go to the counts, the rest to the threshold.
    share = {c: min(2 / 3, rows_per_class / n) for c, n in sizes.items()}
    rate = F.when(F.col("label") == 1, share[1]).otherwise(share[0])
    drawn = known.where(F.col("label").isin(0, 1)).withColumn("draw", hash_share("doc_id") / rate).where("draw < 1.5")
    # Bounded by 1.5 * rows_per_class rows of each class.
    sample = texts(docs, id_col, text_col).join(F.broadcast(drawn), "doc_id")

    def spell(batches):
        for batch in small(batches):
            found: dict[bytes, list[int]] = {}
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for w in set((text.as_py() or b"").translate(LETTERS).split()):
                    found.setdefault(w, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array([n[0] for n in found.values()], pa.int64()), pa.array([n[1] for n in found.values()], pa.int64())], names=["word", "n0", "n1"]
            )

    counted = sample.where("draw < 1").select("text", "label").mapInArrow(spell, "word binary, n0 long, n1 long")
    counted = counted.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).orderBy("word").toArrow()
    counts = np.stack([counted.column("n0").to_numpy(), counted.column("n1").to_numpy()], axis=1).astype(float)
    if not len(counts):
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0, np.float32), _constant(-20.0))
    keys, gains = kneser_ney(counted.column("word").to_pylist(), counts)
    scored = _ratios(sample.where("draw >= 1").select(F.col("label").alias("doc_id"), "text"), keys, gains).toArrow()
    y = scored.column("doc_id").to_numpy().astype(float)
    x = features(np.stack([scored.column(c).to_numpy() for c in EVIDENCE], axis=1))
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    return ToxicityModel(keys, gains, logistic(x, y, weight / max(weight.sum(), 1e-9) * len(y)))


def _constant(logit: float) -> np.ndarray:
    return np.array([logit, 0, 0, 0, 0, 0, 0])


def _ratios(source: DataFrame, keys: np.ndarray, gains: np.ndarray) -> DataFrame:
    rest = [f for f in source.schema if f.name != "text"]
    fields = T.StructType([*rest, *[T.StructField(c, T.DoubleType()) for c in EVIDENCE]])
    shared = source.sparkSession.sparkContext.broadcast((keys, gains))

    def run(batches):
        scorer = Scorer(*shared.value)
        for batch in small(batches, 8 << 20):
            found = scorer.of_texts([t.as_py() or b"" for t in batch.column("text")])
            kept = [batch.column(f.name) for f in rest]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(found[:, i]) for i in range(4)]], names=[f.name for f in fields])

    return source.mapInArrow(run, fields)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, score`` in 0 to 1. Null and empty texts get the score of a text without evidence."""
    source = texts(docs, id_col, text_col)
    fields = T.StructType([source.schema["doc_id"], T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.gains, model.weights))

    def run(batches):
        keys, gains, weights = shared.value
        scorer = Scorer(keys, gains)
        for batch in small(batches, 8 << 20):
            found = scorer.of_texts([t.as_py() or b"" for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability(found, weights))], names=["doc_id", "score"])

    return source.mapInArrow(run, fields)
