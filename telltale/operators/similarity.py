"""Most similar history rows per incident: an exact top-k join that reads only the history that can matter.

The score of a pair is ``ws / (1 + distance) + wd * jaccard + wm * same_mode``. History is sorted so that rows with equal
mode, equal codes and close readings lie together, and cut into leaves of up to 64 rows. Up to 64 neighbouring leaves make a box, up to 64 boxes
make one of the next level, and so on until one level is small enough to be sent to every task. A box knows the ranges of its readings and modes and the codes
in it, so the score of everything inside is bounded from above. Per incident, a first pass goes down from the best box to the best few leaves and so learns the k-th
best score; a second pass opens every box whose bound reaches it. Other boxes cannot hold a result, so nothing is lost, and no step looks at more than 64 times the boxes that the step before it left.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telltale.functions.numbers import is_finite, scaled, unscaled
from telltale.operators.code_sets import is_clear
from telltale.operators.scaling import Scaler, scale
from telltale.schemas import (
    DEFAULT_WEIGHTS,
    MODE,
    MSG_SIMILAR_NONE,
    MSG_SIMILAR_OK,
    SENSORS,
    TOP_K_SIMILAR,
)
from telltale.session import is_small, materialise, shuffle_partitions

#: Up to 2 ** LEAF_BITS rows in a leaf, and as many boxes in a box of the next level.
LEAF_BITS = 6
# At most 64 rows of 96 bytes each per leaf: 25 MB.
MAX_BROADCAST_LEAVES = 4_096
MOST_TOP_BOXES = 32_768
MOST_TOP_BYTES = 64 << 20
#: A box with more codes than this counts as one that may hold any.
MOST_BOX_CODES = 256
SLOT_BITS = 33
PAIRS_PER_PAGE = 50_000
CELLS_PER_BATCH = 2_000_000
SEED_BOXES = 8
SCORE_DIGITS = 9
_PROBE_KEY = ["_p1", "_p2"]


def _slack(weights: dict[str, float]) -> float:
    """More than the rounding error of a score, which grows with the weights."""
    return 1e-12 * max(1.0, sum(abs(w) for w in weights.values()))


@dataclass
class SimilarityIndex:
    """``leaves``: up to 64 packed history rows each. ``levels``: their boxes, level by level; the last one is small enough for a broadcast. ``pages``: of every
    level but the last, the boxes of each parent in one row.

    A box has ``box_id, parent_id, rows, last_index, mode_low, mode_high, modeless`` (some row has no mode), ``codes`` (all of them; null if too many), ``fewest`` (codes of the
    shortest list), ``clear`` (some list says that there is no fault), ``plain`` (one mode and one code list throughout), ``low, high``. The boxes of the first level are the leaves.
    """

    leaves: DataFrame
    levels: list[DataFrame]
    pages: list[DataFrame]
    scaler: Scaler
    sensors: tuple[str, ...]
    _top: Broadcast | None = field(default=None, repr=False)

    def top(self) -> Broadcast:
        """The last level in the form the tasks use; read and sent once, until ``release``."""
        if self._top is None:
            self._top = self.leaves.sparkSession.sparkContext.broadcast(_arrays(self.levels[-1].drop("parent_id").toPandas().to_dict("list"), self.sensors))
        return self._top

    def release(self) -> None:
        """Drop the copies of the last level from the executors."""
        if self._top is not None:
            self._top.destroy()
            self._top = None


def _curve(sensors) -> str:
    """Position on a space-filling curve: the bits of eleven half-deviation steps, interleaved."""
    bits = 4
    terms = []
    for b in range(bits):
        for i, s in enumerate(sensors):
            step = f"CAST(greatest(0, least({2**bits - 1}, floor(z_{s} * 2) + {2 ** (bits - 1)})) AS BIGINT)"
            terms.append(f"shiftleft(shiftright({step}, {b}) & 1L, {b * len(sensors) + i})")
    return " | ".join(terms)


def build_index(
    history: DataFrame, scaler: Scaler, sensors=SENSORS, most_boxes: int = MOST_TOP_BOXES, most_bytes: int = MOST_TOP_BYTES
) -> SimilarityIndex:
    """Index of a history table with raw sensors, mode, ``active_dtcs``, ``dtc_signature`` and ``historical_index``.

    Rows with a missing or infinite reading have no distance to anything and are left out. Levels are added until the last one has at most ``most_boxes`` boxes of ``most_bytes`` in all.
    """
    sensors = tuple(sensors)
    z = ["z_" + s for s in sensors]
    usable = history
    for s in sensors:
        usable = usable.filter(is_finite(F.col(s)))
    usable = scale(usable, scaler, sensors=sensors).select(
        "historical_index", MODE, "dtc_signature", F.array_sort(F.array_distinct("active_dtcs")).alias("codes"), *z
    )
    order = [MODE, "dtc_signature", "_curve", "historical_index"]
    parts = shuffle_partitions(history)
    paged = (
        usable.withColumn("_curve", F.expr(_curve(sensors)))
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
        .withColumn("_leaf", F.shiftright("_slot", LEAF_BITS))
    )
    leaves = paged.groupBy("_leaf", MODE, "dtc_signature", "codes").agg(
        F.min("_slot").alias("leaf_id"),
        F.count(F.lit(1)).alias("rows"),
        F.max("historical_index").alias("last_index"),
        F.array(*[F.min(c) for c in z]).alias("low"),
        F.array(*[F.max(c) for c in z]).alias("high"),
        F.collect_list(F.struct("historical_index", *z)).alias("members"),
    )
    stored = materialise(leaves.drop("_leaf"), "similarity-index")
    levels = [_leaf_boxes(stored)]
    count, size = _extent(levels[0], len(sensors))
    if count > most_boxes or size > most_bytes:
        # The leaves' places in their order, so that 64 neighbours share a parent.
        place = F.row_number().over(W.partitionBy(F.shiftright("box_id", SLOT_BITS)).orderBy("box_id")) - 1
        placed = levels[0].withColumn("parent_id", _named(F.shiftright("box_id", SLOT_BITS), F.shiftright(place, LEAF_BITS)))
        levels[0] = materialise(placed, "similarity-boxes")
    while count > max(most_boxes, 1) or (size > most_bytes and count > 1):
        boxes = _boxes_above(levels[-1], len(sensors))
        part, place = F.shiftright("box_id", SLOT_BITS), F.col("box_id").bitwiseAND((1 << SLOT_BITS) - 1)
        if boxes.filter(place > 0).limit(1).count():
            parent = _named(part, F.shiftright(place, LEAF_BITS))
        else:
            # One box per partition of the sort is left: neighbouring partitions go together.
            parent = _named(F.shiftright(part, LEAF_BITS), F.lit(0))
        levels.append(materialise(boxes.withColumn("parent_id", parent), "similarity-boxes"))
        count, size = _extent(levels[-1], len(sensors))
    return SimilarityIndex(stored, levels, [materialise(_pages(level), "similarity-pages") for level in levels[:-1]], scaler, sensors)


def _named(part: Column, place: Column) -> Column:
    """A box's number: its partition of the sort, and its place there."""
    return F.shiftleft(part.cast("long"), SLOT_BITS).bitwiseOR(place.cast("long"))


def _leaf_boxes(leaves: DataFrame) -> DataFrame:
    codes = F.col("codes")
    return leaves.select(
        F.col("leaf_id").alias("box_id"), F.lit(None).cast("long").alias("parent_id"), "rows", "last_index",
        F.col(MODE).cast("double").alias("mode_low"), F.col(MODE).cast("double").alias("mode_high"), F.isnull(MODE).alias("modeless"),
        "codes", F.size(codes).alias("fewest"), is_clear(codes).alias("clear"), F.lit(True).alias("plain"), "low", "high",
    )


def _boxes_above(boxes: DataFrame, width: int) -> DataFrame:
    """The parents of a level. At most 64 boxes of bounded code lists meet in a group."""
    n = range(width)
    merged = boxes.groupBy(F.col("parent_id").alias("box_id")).agg(
        F.sum("rows").alias("rows"), F.max("last_index").alias("last_index"), F.min("mode_low").alias("mode_low"), F.max("mode_high").alias("mode_high"),
        F.bool_or("modeless").alias("modeless"), F.bool_and("modeless").alias("_no_mode"), F.collect_set("codes").alias("_lists"),
        F.bool_or(F.isnull("codes")).alias("_any"), F.min("fewest").alias("fewest"), F.bool_or("clear").alias("clear"), F.bool_and("plain").alias("plain"),
        F.array(*[F.min(F.col("low")[i]) for i in n]).alias("low"), F.array(*[F.max(F.col("high")[i]) for i in n]).alias("high"),
    )
    codes = F.array_sort(F.array_distinct(F.flatten("_lists")))
    one_mode = F.col("_no_mode") | (~F.col("modeless") & (F.col("mode_low") == F.col("mode_high")))
    return merged.select(
        "box_id", "rows", "last_index", "mode_low", "mode_high", "modeless",
        F.when(~F.col("_any") & (F.size(codes) <= MOST_BOX_CODES), codes).alias("codes"), "fewest", "clear",
        (F.col("plain") & one_mode & (F.size("_lists") == 1) & ~F.col("_any")).alias("plain"), "low", "high",
    )


def _extent(boxes: DataFrame, width: int) -> tuple[int, int]:
    """The number of boxes of a level and about how many bytes they take."""
    letters = F.aggregate(F.coalesce("codes", F.array().cast("array<string>")), F.lit(0), lambda n, c: n + F.length(c) + 50)
    return boxes.agg(F.count(F.lit(1)), F.coalesce(F.sum(letters + 64 + 16 * width), F.lit(0))).first()


def _pages(level: DataFrame) -> DataFrame:
    """``box_id, page``: the boxes inside each box of the next level, as a struct of arrays."""
    columns = [c for c in level.columns if c != "parent_id"]
    grouped = level.groupBy(F.col("parent_id").alias("box_id")).agg(F.collect_list(F.struct(*columns)).alias("inside"))
    return grouped.select("box_id", F.struct(*[F.col("inside")[c].alias(c) for c in columns]).alias("page"))


def _arrays(boxes: dict, sensors) -> dict:
    """Boxes, given as lists, as arrays. Boxes whose modes and codes are the same form a block, so that these are compared once per block."""
    blocks: dict[tuple, int] = {}
    number = []
    for low, high, modeless, codes, fewest, clear, plain in zip(*(boxes[c] for c in ("mode_low", "mode_high", "modeless", "codes", "fewest", "clear", "plain")), strict=True):
        # A mode that is missing is not equal to itself.
        modes = (None, None) if low is None or low != low else (low, high)
        number.append(blocks.setdefault((*modes, modeless, None if codes is None else tuple(codes), fewest, clear, plain), len(blocks)))
    block, last = np.array(number, int), np.array(boxes["last_index"], np.int64)
    order = np.lexsort((-last, block))
    holders: dict[str, list[int]] = {}
    for i, key in enumerate(blocks):
        for c in key[3] or ():
            holders.setdefault(c, []).append(i)
    edges = {n: np.array([list(v) for v in boxes[n]], dtype=float).reshape(len(block), len(sensors))[order].T.copy() for n in ("low", "high")}
    lists = list(zip(*blocks, strict=True)) or [()] * 7
    return edges | {
        "ids": np.array(boxes["box_id"], np.int64)[order], "last": last[order], "block": block[order], "rows": np.array(boxes["rows"], np.int64)[order],
        "sizes": np.bincount(block, minlength=len(blocks)), "mode_low": np.array(lists[0], dtype=float), "mode_high": np.array(lists[1], dtype=float),
        "any": np.array([c is None for c in lists[3]], bool), "fewest": np.array(lists[4], dtype=float), "clear": np.array(lists[5], dtype=float),
        "plain": np.array(lists[6], dtype=bool), "holders": {c: np.array(at) for c, at in holders.items()},
    }


class _Boxes:
    """Upper score bounds of a bounded set of boxes, the last level or a page of another, for a batch of incidents.

    Codes and modes are compared once per block; distances are computed only to the boxes of blocks that can still matter.
    """

    def __init__(self, arrays: dict, sensors, weights, k: int):
        self.__dict__.update(arrays)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.sensors, self.weights, self.k = sensors, weights, k
        self.width = min(max(k, SEED_BOXES), len(self.ids))
        self.slack = _slack(weights)

    def _shared(self, lists) -> np.ndarray:
        """How many codes each list has in common with each block's, at most."""
        out = np.zeros((len(lists), len(self.sizes)))
        seen: dict[tuple, int] = {}
        for row, codes in enumerate(lists):
            first = seen.setdefault(tuple(codes), row)
            if first < row:
                out[row] = out[first]
                continue
            for c in codes:
                if c in self.holders:
                    out[row, self.holders[c]] += 1.0
            out[row, self.any] = len(codes)
        return out

    def batches(self, pdf: pd.DataFrame):
        size = max(1, CELLS_PER_BATCH // max(1, len(self.ids)))
        for start in range(0, len(pdf), size):
            yield pdf.iloc[start : start + size]

    def _block_scores(self, pdf: pd.DataFrame):
        """Code and mode similarity of each block, exact if it is plain, else the most there can be; and the most they add to a score."""
        sizes = np.array([len(c) for c in pdf["codes"]])
        shared = self._shared(list(pdf["codes"]))
        # With the shared codes all in the shortest list that could hold them.
        union = sizes[:, None] + np.maximum(self.fewest[None, :], shared) - shared
        jaccard = np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)
        jaccard[sizes == 0] = self.clear
        mode = pdf[MODE].to_numpy(dtype=float)[:, None]
        same_mode = ((mode >= self.mode_low[None, :]) & (mode <= self.mode_high[None, :])).astype(float)
        fixed = np.zeros_like(jaccard)
        for weight, part in ((self.weights["dtc"], jaccard), (self.weights["mode"], same_mode)):
            fixed += weight * part if weight >= 0 else np.where(self.plain[None, :], weight * part, 0.0)
        return jaccard, same_mode, fixed

    def _expand(self, mask: np.ndarray):
        """(incident, block) cells to (incident, box) pairs, incident by incident."""
        row, block = np.nonzero(mask)
        counts = self.sizes[block]
        shift = np.repeat(self.starts[block] - (np.cumsum(counts) - counts), counts)
        return np.repeat(row, counts), np.arange(counts.sum()) + shift

    def _upper(self, pdf: pd.DataFrame, row: np.ndarray, node: np.ndarray, fixed: np.ndarray) -> np.ndarray:
        values = pdf[["z_" + s for s in self.sensors]].to_numpy(dtype=float).T
        squares = np.zeros(len(row))
        nearest = self.weights["sensor"] >= 0
        for v, low, high in zip(values, self.low, self.high, strict=True):
            at = v[row]
            below, above = low[node] - at, at - high[node]
            gap = np.maximum(below, above, out=below)
            if nearest:
                np.maximum(gap, 0.0, out=gap)
            else:
                gap = np.maximum(np.abs(low[node] - at), np.abs(above))
            squares += gap * gap
        upper = self.weights["sensor"] / (1.0 + np.sqrt(squares)) + fixed[row, self.block[node]]
        return np.round(upper + self.slack, SCORE_DIGITS)

    def seeds(self, pdf: pd.DataFrame):
        """Per incident, its ``SEED_BOXES`` best boxes, or as many more as it takes to hold k rows."""
        jaccard, same_mode, fixed = self._block_scores(pdf)
        # Look at the best blocks only, as many as it takes to see enough boxes.
        order = np.argsort(-fixed, axis=1)
        enough = np.argmax(np.cumsum(self.sizes[order], axis=1) >= self.width, axis=1)
        limit = np.take_along_axis(fixed, np.take_along_axis(order, enough[:, None], axis=1), axis=1)
        limit = np.minimum(limit, fixed.max(axis=1, keepdims=True) - 0.3 * abs(self.weights["sensor"]))
        row, node = self._expand(fixed >= limit - self.slack)
        # Ties go to the larger last index; the step is far below the score grid.
        rank = np.empty(len(self.ids))
        rank[np.argsort(-self.last)] = np.arange(len(self.ids)) * (1e-10 / max(1, len(self.ids)))
        upper = self._upper(pdf, row, node, fixed)
        key = rank[node] - upper
        ends = np.cumsum(np.bincount(row, minlength=len(pdf)))
        chosen = []
        for start, end in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
            line = key[start:end]
            best = np.argpartition(line, self.width - 1)[: self.width] if len(line) > self.width else np.arange(len(line))
            best = start + best[np.argsort(line[best])]
            held = np.cumsum(self.rows[node[best]]) - self.rows[node[best]]
            chosen.append(best[(np.arange(len(best)) < SEED_BOXES) | (held < self.k)])
        chosen = np.concatenate(chosen)
        row, node, upper = row[chosen], node[chosen], upper[chosen]
        return row, node, jaccard[row, self.block[node]], same_mode[row, self.block[node]], upper

    def reaching(self, pdf: pd.DataFrame):
        """Per incident, all boxes that may hold a row ranking at or above the k-th best known one."""
        jaccard, same_mode, fixed = self._block_scores(pdf)
        floor = pdf["floor_score"].astype("float").fillna(-np.inf).to_numpy()
        floor_index = pdf["floor_index"].astype("float").fillna(-1).to_numpy()
        best = np.round(fixed + max(self.weights["sensor"], 0.0) + self.slack, SCORE_DIGITS)
        row, node = self._expand(best >= floor[:, None] - 1e-10)
        upper = self._upper(pdf, row, node, fixed)
        level = np.abs(upper - floor[row]) <= 1e-10
        keep = np.where(level, self.last[node] >= floor_index[row], upper > floor[row])
        row, node = row[keep], node[keep]
        return row, node, jaccard[row, self.block[node]], same_mode[row, self.block[node]], upper[keep]


def _pair_schema(probes: DataFrame) -> T.StructType:
    added = [T.StructField(c, T.LongType()) for c in ("box_id", "_last")] + [T.StructField(c, T.DoubleType()) for c in ("dtc_similarity", "mode_similarity", "_bound")]
    return T.StructType([*probes.schema.fields, *added])


def _opened(boxes: _Boxes, batch: pd.DataFrame, second_pass: bool):
    """The (incident, box) pairs worth opening of a batch of incidents, with the box's code and mode similarity."""
    for pdf in boxes.batches(batch):
        if len(boxes.ids) == 0:
            continue
        row, box, jaccard, same_mode, upper = boxes.reaching(pdf) if second_pass else boxes.seeds(pdf)
        yield pdf.iloc[row].reset_index(drop=True).assign(box_id=boxes.ids[box], _last=boxes.last[box], dtc_similarity=jaccard, mode_similarity=same_mode, _bound=upper)


def _pairs(probes: DataFrame, index: SimilarityIndex, weights, k: int, second_pass: bool) -> DataFrame:
    """(incident, leaf) pairs with their similarities: from the last level down, at most 64 boxes inside each open box are looked at, and those whose bound is too low stay closed."""
    shared, sensors = index.top(), index.sensors
    def route(batches):
        boxes = _Boxes(shared.value, sensors, weights, k)
        for batch in batches:
            yield from _opened(boxes, batch, second_pass)

    # Few bytes but much arithmetic per incident: spread over all tasks, whatever the size of the table.
    pairs = probes.repartition(shuffle_partitions(probes), *_PROBE_KEY).mapInPandas(route, _pair_schema(probes))
    for number in reversed(range(len(index.pages))):
        pairs = _descend(materialise(pairs, "pairs"), probes, index.pages[number], sensors, weights, k, second_pass)
    return pairs.drop("_last", "_bound")


def _descend(pairs: DataFrame, probes: DataFrame, pages: DataFrame, sensors, weights, k: int, second_pass: bool) -> DataFrame:
    """Open the boxes of ``pairs``: each page travels to its incidents once, and once more for every ``PAIRS_PER_PAGE`` of them if there are many."""
    counts = pairs.groupBy("box_id").agg(F.count(F.lit(1)).alias("n"))
    total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    # At most 100,000 boxes are popular by this measure, whatever the number of pairs.
    limit = max(PAIRS_PER_PAGE, total // 100_000)
    columns = probes.columns
    pairs = pairs.select("box_id", *columns).withColumn("_copy", F.lit(0).cast("long"))
    fields = pages.schema["page"].dataType.names
    wanted = pages.join(counts, "box_id").select("box_id", "page", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {limit}"))).alias("_copy"))
    if most > limit:
        popular = counts.filter(F.col("n") > limit).select("box_id", F.expr(f"(n - 1) div {limit} + 1").alias("_copies"))
        spread = F.pmod(F.xxhash64(*_PROBE_KEY), F.coalesce("_copies", F.lit(1).cast("long")))
        pairs = pairs.join(F.broadcast(popular), "box_id", "left").withColumn("_copy", spread).drop("_copies")
    blank = [F.lit(0).cast("long").alias(c) if c in _PROBE_KEY else F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in columns]
    both = wanted.select("box_id", "_copy", *blank, *[F.col("page")[c].alias("_g_" + c) for c in fields]).unionByName(pairs, allowMissingColumns=True)
    # A page comes before its incidents.
    both = both.repartition(shuffle_partitions(probes), "box_id", "_copy").sortWithinPartitions("box_id", "_copy", F.isnull("_g_box_id"))

    def walk(batches):
        boxes = None
        for batch in batches:
            heads = np.flatnonzero(batch["_g_box_id"].notna().to_numpy()).tolist()
            for start, end in zip([0, *heads], [*heads, len(batch)], strict=True):
                if start in heads and end > start:
                    head = {c: batch["_g_" + c].iat[start] for c in fields}
                    boxes = _Boxes(_arrays(head, sensors), sensors, weights, k)
                    start += 1
                if end > start:
                    yield from _opened(boxes, batch[columns].iloc[start:end], second_pass)

    found = both.mapInPandas(walk, _pair_schema(probes))
    if second_pass:
        return found
    # The best of all pages go on. Every box holds a row, so they hold k rows (or these are all there are).
    order = W.partitionBy(*_PROBE_KEY).orderBy(F.col("_bound").desc(), F.col("_last").desc())
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= max(k, SEED_BOXES)).drop("_r")


def _score(weights, squares):
    sensor = F.lit(1.0) / (F.lit(1.0) + F.sqrt(squares))
    total = (
        F.lit(weights["sensor"]) * sensor
        + F.lit(weights["dtc"]) * F.col("dtc_similarity")
        + F.lit(weights["mode"]) * F.col("mode_similarity")
    )
    return sensor, total


def _sum(terms):
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _join_leaves(pairs: DataFrame, leaves: DataFrame, key: str) -> DataFrame:
    """Join incidents to leaves. The optimizer cannot know how many pairs there are, so it must not broadcast them.

    A small set of leaves is broadcast; otherwise both sides are shuffled, and AQE splits the pairs of a popular one.
    """
    if is_small(leaves.select(key), MAX_BROADCAST_LEAVES):
        return pairs.join(F.broadcast(leaves), key)
    return pairs.hint("merge").join(leaves, key)


def _scored(probes: DataFrame, index: SimilarityIndex, weights, k: int, second_pass: bool) -> DataFrame:
    """Exact scores of all history rows in the leaves that the probes reach."""
    reached = _pairs(probes, index, weights, k, second_pass).drop("codes", MODE)
    query = [F.col("z_" + s).alias("q_" + s) for s in index.sensors]
    keep = [c for c in ("floor_score", "floor_index") if c in probes.columns]
    leaves = index.leaves.select(F.col("leaf_id").alias("box_id"), "dtc_signature", MODE, "members")
    members = _join_leaves(reached, leaves, "box_id").select(
        *_PROBE_KEY, *keep, "dtc_similarity", "mode_similarity", "dtc_signature", MODE, *query, F.inline("members")
    )
    gaps = [F.col("q_" + s) - F.col("z_" + s) for s in index.sensors]
    members = members.withColumn("_squares", _sum([g * g for g in gaps])).drop(*["q_" + s for s in index.sensors])
    sensor, total = _score(weights, F.col("_squares"))
    return members.withColumns({"sensor_similarity": sensor, "similarity_score": total}).drop("_squares")


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = [F.col("_rank_score").desc(), F.col("historical_index").desc()]
    scored = scored.withColumn("_rank_score", F.round("similarity_score", SCORE_DIGITS))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy(*_PROBE_KEY).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


#: A result of the search with at most so many rows goes to all tasks.
MOST_SENT_ROWS = 100_000


def _content(index: SimilarityIndex) -> dict[str, Column]:
    """What the search knows of an incident: scaled readings, mode and codes."""
    z = {"z_" + s: scaled(s, index.scaler) for s in index.sensors}
    return {**z, MODE: F.col(MODE).cast("double"), "codes": F.array_sort(F.array_distinct("active_dtcs"))}


def _probe_key(index: SimilarityIndex) -> dict[str, Column]:
    """A 128-bit key of that content."""
    content = _content(index).values()
    return {c: F.xxhash64(F.lit(i), *content) for i, c in enumerate(_PROBE_KEY, 1)}


def _usable(sensors) -> Column:
    """True for an incident whose readings are all there and finite."""
    usable = F.lit(True)
    for s in sensors:
        usable = usable & F.coalesce(is_finite(F.col(s)), F.lit(False))
    return usable


def _searched(incidents: DataFrame, index: SimilarityIndex, k: int, weights: Mapping[str, float] | None) -> DataFrame:
    """The ``k`` best history rows of every distinct content of the incidents, stored."""
    weights = dict(weights or DEFAULT_WEIGHTS)
    # Incidents with equal content have equal answers: search once per content.
    content, who = _content(index), _probe_key(index)
    keyed = incidents.filter(_usable(index.sensors)).select(*[c.alias(n) for n, c in {**who, **content}.items()])
    probes = materialise(keyed.groupBy(*_PROBE_KEY).agg(*[F.first(c).alias(c) for c in content]), "probes")

    seeds = _best(_scored(probes, index, weights, k, second_pass=False), k)
    floors = seeds.groupBy(*_PROBE_KEY).agg(
        F.max(F.when(F.col("rank") == k, F.col("_rank_score"))).alias("floor_score"),
        F.max(F.when(F.col("rank") == k, F.col("historical_index"))).alias("floor_index"),
    )
    floors = materialise(probes.join(floors, _PROBE_KEY, "left"), "floors")
    # A cheap test that drops nearly all rows before the exact ranking; the slack is wider than the rounding of scores.
    reached = _scored(floors, index, weights, k, second_pass=True).filter(
        F.col("floor_score").isNull() | (F.col("similarity_score") > F.col("floor_score") - F.lit(2e-9))
    )
    best = _best(reached.drop("floor_score", "floor_index"), k).select(
        *_PROBE_KEY, "rank", "historical_index", "similarity_score", "sensor_similarity", "dtc_similarity", "mode_similarity", "dtc_signature", MODE,
        *[unscaled(F.col("z_" + s), s, index.scaler).alias(s) for s in index.sensors],
    )
    return materialise(best, "cases")


def similar_topk(
    incidents: DataFrame, index: SimilarityIndex, k: int = TOP_K_SIMILAR, weights: Mapping[str, float] | None = None, key: str = "incident_id"
) -> DataFrame:
    """The ``k`` most similar history rows of every incident, best first.

    ``incidents`` has ``incident_id``, numeric sensors, mode and ``active_dtcs``. Ties go to the larger history index.
    Incidents with a missing or infinite reading get no rows; one without a mode matches no mode. Rows are told apart by the column ``key``, which is part of the result; name
    another one than ``incident_id`` where that may repeat or be missing.
    """
    if k < 0:
        raise ValueError("k must not be negative.")
    if k == 0:
        return similar_topk(incidents, index, 1, weights, key).limit(0)
    who = list(dict.fromkeys([key, "incident_id"]))
    best = _searched(incidents, index, k, weights)
    keyed = incidents.filter(_usable(index.sensors)).select(*who, *[c.alias(n) for n, c in _probe_key(index).items()])
    return keyed.join(_side(best, best), _PROBE_KEY).drop(*_PROBE_KEY)


def _side(found: DataFrame, best: DataFrame) -> DataFrame:
    """What was found by content, to be joined to incidents. It goes to all tasks if the rows of the stored result are few; a table's size in bytes says little about them."""
    return F.broadcast(found) if is_small(best, MOST_SENT_ROWS) else found.hint("merge")


def with_similar_cases(
    incidents: DataFrame, index: SimilarityIndex, k: int = TOP_K_SIMILAR, weights: Mapping[str, float] | None = None, wanted: Column | None = None, asked: DataFrame | None = None
) -> DataFrame:
    """Incidents with ``similarity``, the nested cases that ``nest_cases`` makes of ``similar_topk``; those that are not ``wanted`` have no cases.

    Cases are nested once per distinct content and then joined to the incidents, so they move once per content, not once per incident. Ids may repeat or be missing.
    ``asked`` is the same incidents, if there is a table of them that is cheaper to read.
    """
    if k < 0:
        raise ValueError("k must not be negative.")
    sought = _usable(index.sensors) if wanted is None else _usable(index.sensors) & F.coalesce(wanted, F.lit(False))
    best = _searched((incidents if asked is None else asked).filter(sought), index, max(k, 1), weights)
    best = best if k else best.limit(0)
    nested = best.groupBy(*_PROBE_KEY).agg(F.array_sort(F.collect_list(_case(index.sensors))).alias("_cases"))
    # An incident without cases has a key of its own, so that these don't meet in one task.
    first, second = _probe_key(index).values()
    keyed = incidents.withColumns({"_p1": F.when(sought, first).otherwise(F.monotonically_increasing_id()), "_p2": F.when(sought, second)})
    return _shown_cases(keyed.join(_side(nested, best), _PROBE_KEY, "left").drop(*_PROBE_KEY))


def nest_cases(incidents: DataFrame, cases: DataFrame, sensors=SENSORS, key: str = "incident_id") -> DataFrame:
    """Add ``similarity``: the cases of each incident as one array, the best score (0.0 without cases), a status text. ``key`` is that of ``similar_topk``."""
    # At most k rows per incident, in any number of incidents: never a side to send to all tasks, whatever the stored table's size in bytes.
    nested = cases.groupBy(key).agg(F.array_sort(F.collect_list(_case(sensors))).alias("_cases")).hint("merge")
    return _shown_cases(incidents.join(nested, key, "left"))


def _case(sensors) -> Column:
    return F.struct(
        "rank", "historical_index", "similarity_score", "sensor_similarity", "dtc_similarity", "mode_similarity",
        "dtc_signature", MODE, F.struct(*sensors).alias("original_sensor_values"),
    )


def _shown_cases(joined: DataFrame) -> DataFrame:
    """``similarity`` from ``_cases``, the ranked cases of an incident or null."""
    kept = F.transform("_cases", lambda c: c.dropFields("rank"))
    empty = F.array().cast(joined.select(kept.alias("c")).schema["c"].dataType)
    found = F.col("_cases").isNotNull()
    return joined.withColumn(
        "similarity",
        F.struct(
            F.coalesce(kept, empty).alias("top_cases"),
            F.when(found, F.try_element_at("_cases", F.lit(1))["similarity_score"]).otherwise(0.0).alias("top_score"),
            F.when(found, MSG_SIMILAR_OK).otherwise(MSG_SIMILAR_NONE).alias("summary"),
        ),
    ).drop("_cases")
