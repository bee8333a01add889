"""Isolation forest: hash-drawn samples, one task per tree, scoring of all trees at once by bit masks.

Follows Liu, Ting and Zhou, "Isolation Forest", 2008. Every random choice is a hash of the seed and of what is chosen (a row for a tree, a
node's sensor and split), so the same seed gives the same forest under any partitioning, at any table size and after any task retry.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telltale.operators.percentiles import exact_percentiles
from telltale.schemas import CONTAMINATION, FOREST_NODE, FOREST_SAMPLE, FOREST_SEED, FOREST_TREES, SENSORS
from telltale.session import materialise

PRIME = 2**31 - 1
MICRO = 1_000_000
HALF = 30


@dataclass
class Forest:
    """``nodes``: at most trees × (2 × sample − 1) rows. ``offset`` splits normal from anomalous scores."""

    nodes: DataFrame
    sample_size: int
    trees: int
    offset: float | None = None
    _arrays: dict | None = None

    def arrays(self) -> dict:
        """The trees in the form the tasks use, read once."""
        if self._arrays is None:
            self._arrays = leaf_masks(self.nodes.toPandas())
        return self._arrays


def _digits(text: str, count: int) -> int:
    """The first hex digits of an MD5 as a number."""
    return int(hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()[:count], 16)


def _lots(seed: int, trees: int) -> np.ndarray:
    """Three numbers per tree, below the prime."""
    return np.array([[1 + _digits(f"{seed}:{tree}:{x}", 8) % (PRIME - 1) for tree in range(trees)] for x in "abc"], np.int64)


def draw_samples(
    df: DataFrame, id_col: str, columns: list[str], trees: int = FOREST_TREES, size: int = FOREST_SAMPLE, seed: int = FOREST_SEED
) -> DataFrame:
    """``size`` rows without replacement for each tree (all, if there are fewer), those with the smallest draws: ``(tree, id, columns…)``.

    A row's MD5 gives two numbers of 30 bits, and tree t draws ``(a h1 + b h2 + c) mod p`` with numbers of its own, so samples follow no pattern of the table and differ from tree to tree.
    One pass: each task keeps the ``size`` smallest draws per tree of what it has seen, and only those are shuffled and merged.
    """
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    hashed = df.select(id_col, *columns, F.shiftright(number, HALF).alias("_h1"), number.bitwiseAND((1 << HALF) - 1).alias("_h2"))
    a, b, c = _lots(seed, trees)
    fields = [df.schema[name] for name in (id_col, *columns)]
    schema = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("_draw", T.LongType()), *fields])

    def smallest(kept: pd.DataFrame) -> pd.DataFrame:
        kept = kept.sort_values(["tree", "_draw", id_col])
        return kept[kept.groupby("tree").cumcount().to_numpy() < size]

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limit, kept = np.full(trees, PRIME, np.int64), None
        for batch in batches:
            for start in range(0, len(batch), 4096):
                pdf = batch.iloc[start : start + 4096]
                draws = (pdf["_h1"].to_numpy()[:, None] * a + pdf["_h2"].to_numpy()[:, None] * b + c) % PRIME
                row, tree = np.nonzero(draws <= limit)
                found = pdf[[id_col, *columns]].iloc[row].assign(tree=tree.astype(np.int32), _draw=draws[row, tree])
                kept = found if kept is None else pd.concat([kept, found], ignore_index=True)
                if len(kept) > 2 * trees * size:
                    kept = smallest(kept)
                    full = kept.groupby("tree")["_draw"].agg(["size", "max"])
                    full = full[full["size"] == size]
                    limit[full.index.to_numpy()] = full["max"].to_numpy()
        if kept is not None:
            yield smallest(kept)[schema.names]

    order = W.partitionBy("tree").orderBy("_draw", id_col)
    ranked = hashed.mapInPandas(pick, schema).withColumn("_r", F.row_number().over(order))
    return materialise(ranked.filter(F.col("_r") <= size).select("tree", id_col, *columns), "forest-sample")


def average_path(n: int) -> float:
    """Average depth of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def path_length(depth: int, rows: int) -> int:
    """Length of a leaf's path in millionths, so that sums over trees are exact in any order."""
    return round((depth + average_path(rows)) * MICRO)


def _grow(pdf: pd.DataFrame, id_col: str, columns: list[str], seed: int, limit: int) -> pd.DataFrame:
    """Grow one tree on its bounded sample: a random sensor that is not constant, a uniform split. The children of node n are 2n and 2n + 1."""
    pdf = pdf.sort_values(id_col)
    values = pdf[columns].to_numpy(dtype=float)
    tree = int(pdf["tree"].iloc[0])
    nodes, open_nodes = [], [(1, np.arange(len(values)), 0)]
    while open_nodes:
        node, rows, depth = open_nodes.pop()
        part = values[rows]
        splittable = np.flatnonzero(part.max(axis=0) > part.min(axis=0))
        if depth >= limit or len(rows) < 2 or len(splittable) == 0:
            nodes.append([tree, node, -1, -1, -1, 0.0, len(rows)])
            continue
        which, where = (_digits(f"{seed}:{tree}:{node}:{x}", 12) / 2**48 for x in ("sensor", "split"))
        feature = int(splittable[int(which * len(splittable))])
        low, high = part[:, feature].min(), part[:, feature].max()
        threshold = low + where * (high - low)
        if threshold >= high:
            threshold = low
        left = part[:, feature] <= threshold
        nodes.append([tree, node, 2 * node, 2 * node + 1, feature, float(threshold), len(rows)])
        open_nodes += [(2 * node, rows[left], depth + 1), (2 * node + 1, rows[~left], depth + 1)]
    return pd.DataFrame(sorted(nodes), columns=FOREST_NODE.names)


def grow_forest(samples: DataFrame, id_col: str, columns: list[str], size: int, seed: int = FOREST_SEED) -> DataFrame:
    """Node table of all trees; every group is one tree's sample of at most ``size`` rows."""
    limit = math.ceil(math.log2(max(size, 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        return _grow(pdf, id_col, columns, seed, limit)

    return samples.groupBy("tree").applyInPandas(grow, FOREST_NODE)


def leaf_masks(nodes: pd.DataFrame) -> dict:
    """All trees as masks of leaves, ready to be sent to the tasks.

    The leaves of a tree are numbered from left to right. A node whose test fails rules out the leaves to its left, and of the leaves that no failed test rules out, the first
    is where a row ends. Tests of one sensor fail in the order of their thresholds, so a sensor's thresholds are sorted.
    """
    trees = [part.set_index("node") for _, part in nodes.groupby("tree")]
    most = max(int((part["left"] < 0).sum()) for part in trees)
    words = -(-most // 64)
    length = np.zeros((len(trees), 64 * words), np.int64)
    tests = []
    for t, part in enumerate(trees):
        left, feature, threshold, rows = (part[c].to_dict() for c in ("left", "feature", "threshold", "n"))
        count, spans, stack = 0, {}, [(1, 0, False)]
        while stack:
            node, depth, done = stack.pop()
            if left[node] < 0:
                length[t, count] = path_length(depth, rows[node])
                spans[node] = (count, count + 1)
                count += 1
            elif not done:
                stack += [(node, depth, True), (2 * node + 1, depth + 1, False), (2 * node, depth + 1, False)]
            else:
                spans[node] = (spans[2 * node][0], spans[2 * node + 1][1])
                tests.append((feature[node], threshold[node], t, *spans[2 * node]))
    masks = {}
    for feature in sorted({x[0] for x in tests}):
        own = sorted(x for x in tests if x[0] == feature)
        masks[feature] = (np.array([x[1] for x in own]), np.array([x[2:] for x in own], np.int32))
    return {"length": length, "words": words, "tests": masks}


class _Walker:
    """Scores rows. Per sensor, ``state[i]`` says which leaves of all trees are left after its ``i`` smallest thresholds failed."""

    def __init__(self, arrays: dict, scale: float):
        self.length, self.words, self.scale = arrays["length"], arrays["words"], scale
        self.count = len(self.length)
        self.state = {}
        for feature, (thresholds, spans) in arrays["tests"].items():
            state = np.full((len(spans) + 1, self.count, self.words), ~np.uint64(0))
            for i, (tree, low, high) in enumerate(spans.tolist(), 1):
                for word in range(low // 64, -(-high // 64)):
                    bits = (1 << min(64, high - 64 * word)) - (1 << max(0, low - 64 * word))
                    state[i, tree, word] = np.uint64(~bits & (2**64 - 1))
            np.bitwise_and.accumulate(state, axis=0, out=state)
            self.state[feature] = (thresholds, state.reshape(len(state), -1))

    def score(self, values: np.ndarray) -> np.ndarray:
        """Minus the anomaly score of the paper: close to -1 is isolated early, close to 0 is deep inside. Equal rows are scored once."""
        if self.scale == 0:
            return np.full(len(values), -0.5)
        _, first, inverse = np.unique(np.ascontiguousarray(values).view(np.dtype((np.void, 8 * values.shape[1]))).ravel(), return_index=True, return_inverse=True)
        values = values[first]
        out = np.empty(len(values))
        for start in range(0, len(values), 256):
            out[start : start + 256] = self._paths(values[start : start + 256])
        return -np.exp2(-(out / MICRO / self.count) / self.scale)[inverse]

    def _paths(self, values: np.ndarray) -> np.ndarray:
        left = np.full((len(values), self.count * self.words), ~np.uint64(0))
        for feature, (thresholds, state) in self.state.items():
            left &= state[np.searchsorted(thresholds, values[:, feature])]
        left = left.reshape(len(values), self.count, self.words)
        word = (left != 0).argmax(axis=2)
        bits = np.take_along_axis(left, word[..., None], axis=2)[..., 0]
        leaf = 64 * word + np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1))
        return self.length[np.arange(self.count)[None, :], leaf].sum(axis=1)


def with_forest_score(df: DataFrame, forest: Forest, columns: list[str], name: str = "forest_score") -> DataFrame:
    """Add the forest score of every row. What is sent to the tasks is bounded by trees × sample."""
    shared = df.sparkSession.sparkContext.broadcast(forest.arrays())
    scale = average_path(forest.sample_size)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        walker = _Walker(shared.value, scale)
        for series in batches:
            yield pd.Series(walker.score(np.column_stack([s.to_numpy(dtype=float) for s in series])))

    return df.withColumn(name, score(*[F.col(c) for c in columns]))


def fit_forest(
    history: DataFrame, id_col: str = "historical_index", columns: list[str] | None = None, trees: int = FOREST_TREES,
    size: int = FOREST_SAMPLE, seed: int = FOREST_SEED, contamination: float = CONTAMINATION,
) -> Forest:
    """Samples, trees, and the score below which the given share of the history lies."""
    columns = columns or ["z_" + s for s in SENSORS]
    samples = draw_samples(history, id_col, columns, trees, size, seed)
    size = samples.count() // trees
    nodes = materialise(grow_forest(samples, id_col, columns, size, seed), "forest-nodes")
    forest = Forest(nodes, size, trees)
    scores = materialise(with_forest_score(history.select(id_col, *columns), forest, columns).select("forest_score"), "forest-scores")
    forest.offset = exact_percentiles(scores, ["forest_score"], [contamination])["forest_score"][0]
    return forest
