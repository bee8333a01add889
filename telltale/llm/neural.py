"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation, over counts of the whole corpus."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telltale.llm.rows import first_row_number, small
from telltale.session import materialise

END, OTHER, SPECIAL = 0, 1, 2  # ids of the end, of all words outside the model's vocabulary, and the first word's
FLUSH_WORDS = 300_000
KEPT_SHARE = 2e-6
MODEL_REACH = 0.004
SHARES, NOISE, BATCH, RATE = (0, 1 / 8, 1 / 2, 1), 32, 8192, 0.1
BLOCK, CLASS_NOISE = 32, 8


def tokens(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased. Every text has one more token, its end."""
    return (text or b"").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)`` over all rows of ``(text,)``, counted in the tasks first."""

    def run(batches):
        found: Counter = Counter()
        for batch in small(batches):
            for text in batch.column(0):
                found.update(tokens(text.as_py()))
                if len(found) > FLUSH_WORDS:
                    yield _pairs(found)
                    found = Counter()
        yield _pairs(found)

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pairs(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])


@dataclass
class Vocabulary:
    """Corpus statistics, and the words that are frequent enough to be known in every task."""

    rows: int  # training texts, so the count of the end
    total: int  # N, ends included
    distinct: int  # V, the end included
    words: list[bytes]  # by falling count; all with at least KEPT_SHARE of N, so at most 1 / KEPT_SHARE
    counts: np.ndarray
    reach: float = MODEL_REACH

    @property
    def size(self) -> int:
        """Ids of the model: end, other, and the words that occur often enough to learn from, a number that grows with the cube root of the corpus."""
        return SPECIAL + int((self.counts >= self.reach * self.total ** (2 / 3)).sum())

    @property
    def other_total(self) -> int:
        return self.total - self.rows - int(self.counts[: self.size - SPECIAL].sum())

    @property
    def other_distinct(self) -> int:
        return max(0, self.distinct - 1 - min(len(self.words), self.size - SPECIAL))


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One pass over ``(doc_id, held_out, text)``: a row per text with its ids and what its frequent words add, and a row per rare word of it.

    Rare words, those outside ``vocabulary.words``, are as ``(row, word, n)``; no rare word has a large share of the corpus, so their
    join with the counts has no hot key.
    """
    fields = T.StructType(
        [T.StructField("row", T.LongType()), docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()),
         T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("other", T.DoubleType()), T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())]
    )
    v = vocabulary
    shared = docs.sparkSession.sparkContext.broadcast((v.words, v.counts))
    bottom, other_bottom = math.log10(v.total + v.distinct + 1), math.log10(v.other_total + v.other_distinct + 1)
    ends, inside = v.rows, v.size - SPECIAL

    def run(batches):
        words, counts = shared.value
        place = dict(zip(words, range(len(words)), strict=True))
        gain = np.log10(np.concatenate([counts, [0]]) + 1.0) - bottom
        other_gain = np.log10(np.concatenate([counts, [0]]) + 1.0) - other_bottom
        gain[-1] = 0
        other_gain[:inside] = other_gain[-1] = 0
        row = first_row_number()
        for batch in small(batches):
            out: list[list] = [[] for _ in range(10)]
            takes, held = [], batch.column(1).to_pylist()
            for i, text in enumerate(batch.column(2)):
                own = tokens(text.as_py())
                at = np.fromiter(map(place.get, own, repeat(-1)), np.int64, len(own))
                ids = np.where((at >= 0) & (at < inside), at + SPECIAL, OTHER).astype(np.int32)
                known = int((at >= 0).sum())
                values = (row, held[i], ids.tobytes(), len(own) + 1, known + (ends > 0), float(gain[at].sum() + math.log10(ends + 1) - bottom), float(other_gain[at].sum()), None, None)
                takes.append(i)
                for column, value in zip((0, 2, 3, 4, 5, 6, 7, 8, 9), values, strict=True):
                    out[column].append(value)
                rare = Counter([own[j] for j in np.flatnonzero(at < 0).tolist()])
                takes.extend([None] * len(rare))
                out[0].extend([row] * len(rare))
                for column in range(2, 8):
                    out[column].extend([None] * len(rare))
                out[8].extend(rare.keys())
                out[9].extend(rare.values())
                row += 1
            arrays = [pa.array(o or [None] * len(takes), f.type) for o, f in zip(out, _arrow(fields), strict=True)]
            arrays[1] = batch.column(0).take(pa.array(takes, pa.int64()))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return docs.mapInArrow(run, fields)


def _arrow(fields: T.StructType) -> list[pa.Field]:
    kinds = {"LongType": pa.int64(), "BooleanType": pa.bool_(), "BinaryType": pa.binary(), "DoubleType": pa.float64()}
    return [pa.field(f.name, pa.null() if f.name == "doc_id" else kinds[type(f.dataType).__name__]) for f in fields]


@dataclass
class LogBilinear:
    """Two log-bilinear choices, of a word's class and of the word in its class, for the two words a, b before it.

    With h = r_a A + r_b B the class g has a share proportional to exp(h · u_g + d_g), and the word w in it one proportional to
    exp(h · q_w + c_w). A class is the ids from ``bounds[g]`` to before ``bounds[g + 1]``. ``context`` has a row for each id and a last one for the place
    before a text; the last columns of ``target`` and ``groups`` are c and d.
    """

    context: np.ndarray
    near: np.ndarray
    far: np.ndarray
    target: np.ndarray
    groups: np.ndarray
    bounds: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        """What is trained."""
        return [self.context, self.near, self.far, self.target, self.groups]

    def predicted(self, far: np.ndarray, near: np.ndarray) -> np.ndarray:
        """h of each pair of words, and a last column of ones."""
        hidden = self.context[far] @ self.far + self.context[near] @ self.near
        return np.concatenate([hidden, np.ones((len(hidden), 1), hidden.dtype)], axis=1)

    def group_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def cut_classes(unigram: np.ndarray) -> np.ndarray:
    """Bounds of the classes: the end, the words outside the vocabulary, and the others, which come by falling share, cut into parts with about equal sums of root
    shares. So there are about as many classes as the root of all ids, and a token's class has few more words than that on average."""
    root = np.sqrt(unigram[SPECIAL:])
    part = ((np.cumsum(root) - root / 2) / root.sum() * math.ceil(math.sqrt(len(root)))).astype(np.int64)
    return np.concatenate([np.arange(SPECIAL), SPECIAL + np.flatnonzero(np.diff(part, prepend=-1)), [len(unigram)]])


def start_model(unigram: np.ndarray, width: int, seed: int) -> LogBilinear:
    rng = np.random.default_rng(seed)
    size, bounds = len(unigram), cut_classes(unigram)
    mass = np.add.reduceat(unigram, bounds[:-1])
    small = lambda *shape: rng.normal(0, 0.1, shape)
    target = np.column_stack([small(size, width), np.log(unigram / np.repeat(mass, np.diff(bounds)))])
    arrays = [small(size + 1, width), np.eye(width) + small(width, width) / width, np.eye(width) / 2 + small(width, width) / width, target, np.column_stack([small(len(mass), width), np.log(mass)])]
    return LogBilinear(*[a.astype(np.float32) for a in arrays], bounds)


def context_ids(ids: np.ndarray, lengths: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(far, near, word)`` of every token, ends included, of texts whose ids are joined."""
    tops = np.cumsum(lengths + 1)
    word = np.full(int(tops[-1]) if len(tops) else 0, END, np.int32)
    inner = np.ones(len(word), bool)
    inner[tops - 1] = False
    word[inner] = ids
    near, far = np.roll(word, 1), np.roll(word, 2)
    first = tops - lengths - 1
    near[first] = before
    far[first] = before
    second = first[lengths > 0] + 1
    far[second] = before
    return far, near, word


class Trainer:
    """Noise-contrastive estimation of both choices with steps scaled as in Adagrad.

    The tokens of a step share ``NOISE`` noise classes; each ``BLOCK`` of them whose words are of one class share ``CLASS_NOISE`` noise words of that
    class. So all scores are products of matrices. Only the rows that a step met are changed.
    """

    def __init__(self, model: LogBilinear, unigram: np.ndarray, rate: float, seed: int):
        self.model, self.rate = model, np.float32(rate)
        self.rng = np.random.default_rng(seed)
        begin, self.group = model.bounds[:-1], model.group_of()
        mass = np.add.reduceat(unigram, begin) ** 0.75
        self.group_noise = mass / mass.sum()
        self.log_group_noise = np.log(self.group_noise * NOISE).astype(np.float32)
        inner = unigram**0.75 / np.add.reduceat(unigram**0.75, begin)[self.group]
        self.log_noise = np.log(inner * CLASS_NOISE).astype(np.float32)
        self.upto = np.cumsum(inner)  # rises by one from class to class, so a class's words are drawn by a number in its unit
        self.several = np.diff(model.bounds) > 1
        self.memory = [np.full(a.shape, 1e-7, np.float32) for a in model.arrays()]

    def learn(self, far: np.ndarray, near: np.ndarray, word: np.ndarray) -> None:
        """Go over all examples once, in random order."""
        order = self.rng.permutation(len(word))
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            part = part[np.argsort(word[part])]  # so that words of one class lie together
            self.step(far[part], near[part], word[part])

    def step(self, far: np.ndarray, near: np.ndarray, word: np.ndarray) -> None:
        model, share = self.model, np.float32(1 / len(word))
        group, hidden = self.group[word], model.predicted(far, near)
        drawn = self.rng.choice(len(self.group_noise), NOISE, p=self.group_noise)
        own, noise = model.groups[group], model.groups[drawn]
        push = share * _sigmoid(self.log_group_noise[group] - np.einsum("ij,ij->i", hidden, own))[:, None]
        pull = share * _sigmoid(hidden @ noise.T - self.log_group_noise[drawn])
        d_hidden = push * own - pull @ noise
        d_groups = np.zeros_like(model.groups)
        _add(d_groups, *_summed(group, push * hidden))
        _add(d_groups, *_summed(drawn, -(pull.T @ hidden)))

        at = np.flatnonzero(self.several[group])
        blocks, slot, first = _blocks(group[at])
        padded = np.zeros((len(first), BLOCK, hidden.shape[1]), np.float32)
        padded[blocks, slot] = hidden[at]
        drawn = np.searchsorted(self.upto, group[at][first][:, None] + self.rng.random((len(first), CLASS_NOISE)))
        drawn = np.minimum(drawn, model.bounds[group[at][first] + 1][:, None] - 1)
        own, noise = model.target[word[at]], model.target[drawn]
        push = share * _sigmoid(self.log_noise[word[at]] - np.einsum("ij,ij->i", hidden[at], own))[:, None]
        # The places of a block that no token fills have a hidden row of zeros, which changes neither sum.
        pull = share * _sigmoid(padded @ noise.transpose(0, 2, 1) - self.log_noise[drawn][:, None, :])
        d_hidden[at] += push * own - (pull @ noise)[blocks, slot]
        d_noise = -(pull.transpose(0, 2, 1) @ padded).reshape(-1, hidden.shape[1])

        d_hidden = d_hidden[:, :-1]
        d_near, d_far = model.context[near].T @ d_hidden, model.context[far].T @ d_hidden
        every = slice(None)
        steps = [
            _summed(np.concatenate([near, far]), np.concatenate([d_hidden @ model.near.T, d_hidden @ model.far.T])),
            (every, d_near), (every, d_far),
            _summed(np.concatenate([word[at], drawn.ravel()]), np.concatenate([push * hidden[at], d_noise])),
            (every, d_groups),
        ]
        for array, (rows, step), seen in zip(model.arrays(), steps, self.memory, strict=True):
            total = seen[rows] + step * step
            seen[rows] = total
            array[rows] += self.rate * step / np.sqrt(total)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def _blocks(group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block of each place, its slot there, and each block's first place; equal groups lie together, and a block has at most ``BLOCK`` places of one."""
    begin = np.flatnonzero(np.diff(group, prepend=-1))
    inside = np.arange(len(group)) - np.repeat(begin, np.diff(np.append(begin, len(group))))
    slot = inside % BLOCK
    return np.cumsum(slot == 0) - 1, slot, np.flatnonzero(slot == 0)


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``rows`` and the sum of the ``values`` of each."""
    if not len(rows):
        return rows, values
    order = np.argsort(rows)
    rows = rows[order]
    begin = np.flatnonzero(np.diff(rows, prepend=-1))
    return rows[begin], np.add.reduceat(values[order], begin, axis=0)


def _add(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    out[rows] += values


def fit_model(encoded: DataFrame, unigram: np.ndarray, width: int, seed: int) -> LogBilinear:
    """Train on all of ``encoded.ids``. The rounds take successive shares of every batch of texts, so that together they go once over every
    token. In a round each task starts from the common model; then the models are averaged by their tokens,
    parameter by parameter, in Spark. The driver gets one model."""
    model = start_model(unigram, width, seed)
    size, bounds = len(unigram), model.bounds
    for number, (begin, end) in enumerate(zip(SHARES, SHARES[1:], strict=False)):
        shared = encoded.sparkSession.sparkContext.broadcast((model.arrays(), unigram))
        rate = RATE / math.sqrt(number + 1)

        def run(batches, shared=shared, rate=rate, number=number, begin=begin, end=end):
            arrays, unigram = shared.value
            own, seen = LogBilinear(*[a.copy() for a in arrays], bounds), 0
            trainer = Trainer(own, unigram, rate, seed + number)
            for batch in small(batches):
                n = batch.num_rows
                raw = batch.column(0).slice(int(n * begin), int(n * end) - int(n * begin)).to_pylist()
                if raw:
                    lengths = np.array([len(x) // 4 for x in raw], np.int64)
                    far, near, word = context_ids(np.frombuffer(b"".join(raw), np.int32), lengths, size)
                    trainer.learn(far, near, word)
                    seen += len(word)
            if seen:
                flat = np.concatenate([a.ravel() for a in own.arrays()])
                flat = np.pad(flat, (0, -len(flat) % width)).reshape(-1, width)
                for lo in range(0, len(flat), BATCH):
                    part = flat[lo : lo + BATCH]
                    columns = [pa.array(np.arange(lo, lo + len(part)), pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), width).cast(pa.list_(pa.float32()))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(part), float(seen)))], names=["k", "v", "w"])

        parts = encoded.select("ids").mapInArrow(run, "k int, v array<float>, w double")
        means = [(F.sum(F.col("v")[i] * F.col("w")) / F.sum("w")).alias(f"v{i}") for i in range(width)]
        merged = parts.groupBy("k").agg(*means).orderBy("k").toArrow()
        shared.unpersist()
        if not len(merged):
            continue
        flat = np.stack([merged.column(f"v{i}").to_numpy() for i in range(width)], axis=1).ravel()
        arrays, at = [], 0
        for a in model.arrays():
            arrays.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        model = LogBilinear(*arrays, bounds)
    return model


class TextScorer:
    """log10 probabilities of texts. Both normalisers of every token come from batched matrix products, that of the words class by class."""

    def __init__(self, model: LogBilinear):
        self.model, self.group = model, model.group_of()
        self.far, self.near = model.context @ model.far, model.context @ model.near
        self.several = np.diff(model.bounds) > 1
        self.groups = np.ascontiguousarray(model.groups[:, :-1].T)

    def __call__(self, raw: list[bytes]) -> np.ndarray:
        lengths = np.array([len(x) // 4 for x in raw], np.int64)
        far, near, word = context_ids(np.frombuffer(b"".join(raw), np.int32), lengths, len(self.group))
        value = np.empty(len(word))
        for lo in range(0, len(word), 1 << 15):
            cut = slice(lo, lo + (1 << 15))
            order = np.argsort(word[cut]) + lo
            value[order] = self.tokens(far[order], near[order], word[order])
        return np.add.reduceat(value, np.cumsum(lengths + 1) - lengths - 1) / math.log(10) if len(raw) else np.zeros(0)

    def tokens(self, far: np.ndarray, near: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Natural log probabilities of tokens whose ids rise."""
        model, group = self.model, self.group[word]
        hidden = self.far[far]
        hidden += self.near[near]
        value = np.empty(len(word), np.float32)
        for lo in range(0, len(word), 4096):
            cut = slice(lo, lo + 4096)
            logits = hidden[cut] @ self.groups
            logits += model.groups[:, -1]
            value[cut] = logits[np.arange(len(logits)), group[cut]] - _log_sum(logits)
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(group)], strict=True):
            g = group[lo]
            if self.several[g]:
                first = model.bounds[g]
                rows = model.target[first : model.bounds[g + 1]]
                logits = hidden[lo:hi] @ rows[:, :-1].T
                logits += rows[:, -1]
                value[lo:hi] += logits[np.arange(hi - lo), word[lo:hi] - first] - _log_sum(logits)
        return value


def _log_sum(logits: np.ndarray) -> np.ndarray:
    """log of the sum of exp of each row; ``logits`` is used up."""
    top = 0
    if max(logits.max(), -logits.min()) > 60:  # exp could leave the range of the type
        top = logits.max(axis=1)
        logits -= top[:, None]
    np.exp(logits, out=logits)
    return np.log(logits @ np.ones(logits.shape[1], logits.dtype)) + top


def score_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None,
    reach: float = MODEL_REACH, width: int = 16, seed: int = 13,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Counts, vocabulary and the neural model are learnt from all rows that are not ``held_out``. ``base_score`` is the add-one unigram log10
    probability; ``score`` the model's: the log-bilinear probability of each token given the two before it, times, for words
    outside the model's vocabulary, the word's smoothed share among those. The vocabulary is all words that occur at least ``reach`` · N^(2/3) times and have
    ``KEPT_SHARE`` of the N tokens: its size grows with the cube root of the corpus, up to the half million words that the second bound leaves. A null text counts as empty and has one token, its end; repeated rows each
    return a row. Without training rows every word is unknown.
    """
    fold = F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False))
    source = docs.select(F.col(id_col).alias("doc_id"), fold.alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    learnt = source.where(~F.col("held_out"))
    counts = materialise(word_counts(learnt.select("text")), "word-counts")
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    rows = learnt.count()
    total, distinct = (sums["n"] or 0) + rows, sums["v"] + (rows > 0)
    # Words with a fixed share of the corpus: a bounded list, whatever its size.
    frequent = counts.where(F.col("n") >= KEPT_SHARE * total).orderBy(F.desc("n"), "word").toArrow()
    vocabulary = Vocabulary(rows, total, distinct, frequent.column("word").to_pylist(), frequent.column("n").to_numpy(), reach)
    encoded = materialise(encode(source, vocabulary), "encoded", compression="zstd")
    texts_only, rare = encoded.where("ids IS NOT NULL"), encoded.where("word IS NOT NULL").select("row", "word", "n")
    unigram = np.full(vocabulary.size, 0.5)
    unigram[END] += rows
    unigram[OTHER] += max(0, vocabulary.other_total)
    unigram[SPECIAL:] += vocabulary.counts[: vocabulary.size - SPECIAL]
    model = fit_model(texts_only.where(~F.col("held_out")), unigram / unigram.sum(), width, seed)
    shared = docs.sparkSession.sparkContext.broadcast([*model.arrays(), model.bounds])
    kept = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "other"]
    fields = T.StructType([*[encoded.schema[c] for c in kept], T.StructField("model", T.DoubleType())])

    def run(batches):
        scorer = TextScorer(LogBilinear(*shared.value))
        for batch in small(batches):
            found = scorer([x.as_py() for x in batch.column("ids")])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found)], names=[f.name for f in fields])

    modelled = texts_only.select(*kept, "ids").mapInArrow(run, fields)
    bottom, other_bottom = math.log10(total + distinct + 1), math.log10(max(0, vocabulary.other_total) + vocabulary.other_distinct + 1)
    known = rare.join(counts.select("word", F.col("n").alias("c")), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    tail = known.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * (F.log10(F.col("c") + 1.0) - bottom)).alias("rare_base"),
        F.sum(F.col("n") * (F.log10(F.col("c") + 1.0) - other_bottom)).alias("rare_other"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return modelled.join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("rare_known")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"), (F.col("model") + F.col("other") + zero("rare_other")).alias("score"),
    )
