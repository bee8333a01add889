"""Ranked lexical search: the best documents of each query, found from range maxima of posting lists.

Documents lie in blocks, each with the posting lists of the wanted terms in document order. A sparse table over the lists gives the largest
impact of a term in any interval of documents. The sum of these over a query's terms bounds every score of the interval, so intervals are opened best first:
each is split at the document with its largest impact, and what cannot beat the k-th best document is never opened.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telltale.llm.rows import small, texts
from telltale.session import materialise

#: Lower-cases A-Z, keeps digits, letters and all bytes from 128, and turns every other byte into a blank.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
QUERY_BYTES = 1 << 21
SLICE = 1 << 20
BLOCK_DOCS = 4_096  # places are 16-bit numbers
BLOCK_POSTINGS = 300_000
LEAF = 48
WIDTH = 48


def pieces(text: bytes):
    """The terms of a text, in lists of bounded size."""
    clean, start = text.translate(TERMS), 0
    while start < len(clean):
        end = clean.find(b" ", start + SLICE)
        end = len(clean) if end < 0 else end
        yield clean[start:end].split()
        start = end


def search(
    docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The ``k`` highest-scoring documents of every row of ``queries``: ``item_id, rank, doc_id, score``.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. With N documents that have terms, L terms in all, n terms in the document, tf of them
    equal and df documents holding the term, its weight is ``w = floor(1000 ln((2N + 2) / (2df + 1)))``, ``m = 10 + 90 n N div L``, and a score is the sum of
    ``w * (10^9 tf div (1000 tf + 8 m))`` over the query's distinct terms. Documents with a score above 0 are ranked; equal scores by ascending id, a null id last.

    Null and blank texts hold no term; they are never found and find nothing. Repeated documents are each ranked, repeated queries each get their rows. Empty tables give no rows. Only the named
    columns are read. The queries are a stated set: they are taken in blocks of about ``QUERY_BYTES``, and each block goes over all documents.
    """
    source = texts(docs, id_col, text_col)
    wanted = queries.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("binary").alias("text"))
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // QUERY_BYTES) or 1
    found = None
    for number in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).toArrow()
        part = _search(source, block, wanted.schema["item_id"].dataType, k)
        found = part if found is None else found.union(part)
    return found


def _search(source: DataFrame, block: pa.Table, item_type: T.DataType, k: int) -> DataFrame:
    terms: dict[bytes, int] = {}
    asked = []
    for text in block.column("text"):
        own = {w for part in pieces(text.as_py() or b"") for w in part}
        asked.append(np.array(sorted(terms.setdefault(w, len(terms)) for w in own), np.int64))
    index = postings(source, terms)
    # One row per task and, in all, one number per term of the block of queries.
    counts = index.where("stats")
    held = counts.select(F.inline(F.arrays_zip("term", "held"))).groupBy("term").agg(F.sum("held").alias("n")).toArrow()
    documents, length = counts.agg(F.coalesce(F.sum(F.col("sizes")[0]), F.lit(0)), F.coalesce(F.sum(F.col("sizes")[1]), F.lit(0))).first()
    weights = np.zeros(len(terms), np.int64)
    for term, n in zip(held.column("term").to_pylist(), held.column("n").to_pylist(), strict=True):
        weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1)))
    # A term that weighs nothing adds nothing.
    asked = [own[weights[own] > 0] for own in asked]
    fields = T.StructType(
        [T.StructField("_query", T.IntegerType()), T.StructField("item_id", item_type), source.schema["doc_id"], T.StructField("score", T.LongType())]
    )
    ids = block.column("item_id").combine_chunks()
    best = index.where("not stats").select("ids", "sizes", "term", "held", "place", "tf").mapInArrow(_rank(asked, weights, documents, length, k, ids, fields), fields)
    order = W.partitionBy("_query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def postings(source: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """The written index of all documents for ``terms``, in blocks of at most ``BLOCK_DOCS`` documents in order of their ids.

    A block holds ``ids`` and ``sizes`` (terms) of its documents, its terms, how many documents hold each (``held``), and term by term its postings: ``place`` in the block and ``tf``, as packed
    numbers. Documents without a wanted term are counted, but need no place. Each task ends with a row of counts (``stats``): documents with terms and all their terms in ``sizes``, and the holders of each term.
    """
    lists = [T.StructField(name, T.ArrayType(kind)) for name, kind in (("ids", source.schema["doc_id"].dataType), ("sizes", T.LongType()), ("term", T.IntegerType()), ("held", T.LongType()))]
    fields = T.StructType([T.StructField("stats", T.BooleanType()), *lists, T.StructField("place", T.BinaryType()), T.StructField("tf", T.BinaryType())])

    def row(stats, ids, sizes, term, held, place=b"", tf=b""):
        columns = [pa.array([stats]), _one(ids), *(_one(pa.array(c, kind)) for c, kind in ((sizes, pa.int64()), (term, pa.int32()), (held, pa.int64())))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([place], pa.binary()), pa.array([tf], pa.binary())], names=fields.names)

    def packed(ids, sizes, found):
        values = ids.to_pylist()
        order = sorted(range(len(values)), key=lambda i: key_of(values[i]))
        term = np.concatenate([found[i][0] for i in order])
        by_term = np.argsort(term, kind="stable")
        place = np.repeat(np.arange(len(order), dtype=np.int16), [len(found[i][0]) for i in order])[by_term]
        tf = np.concatenate([found[i][1] for i in order])[by_term]
        some, held = np.unique(term, return_counts=True)
        return row(False, ids.take(pa.array(order)), [sizes[i] for i in order], some, held, place.tobytes(), tf.tobytes())

    def run(batches):
        holders, documents, length = np.zeros(len(terms), np.int64), 0, 0
        ids, sizes, found, held, empty = [], [], [], 0, None
        for batch in small(batches):
            empty = batch.column(0).slice(0, 0)
            start = len(found)
            picked = []
            for i, value in enumerate(batch.column(1)):
                n, own = 0, Counter()
                for part in pieces(value.as_py() or b""):
                    n += len(part)
                    own.update(terms[w] for w in part if w in terms)
                documents, length = documents + (n > 0), length + n
                if own:
                    picked.append(i)
                    sizes.append(n)
                    found.append((np.fromiter(own.keys(), np.int32, len(own)), np.fromiter(own.values(), np.int32, len(own))))
                    holders[found[-1][0]] += 1
                    held += len(own)
                    if held >= BLOCK_POSTINGS or len(found) >= BLOCK_DOCS:
                        ids.append(batch.column(0).take(pa.array(picked)))
                        yield packed(pa.concat_arrays(ids), sizes, found)
                        ids, sizes, found, held, picked = [], [], [], 0, []
            if picked:
                ids.append(batch.column(0).take(pa.array(picked)))
        if found:
            yield packed(pa.concat_arrays(ids), sizes, found)
        if empty is not None:
            some = np.flatnonzero(holders)
            yield row(True, empty, [documents, length], some, holders[some])

    return materialise(source.mapInArrow(run, fields), "postings")


def _one(values: pa.Array) -> pa.Array:
    """A column of one row that holds a list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def key_of(value):
    """Orders ids, null last."""
    return (value is None, value)


class RangeMaxima:
    """Positions of the largest value of any range of an array: a table per power of two, each from the one before."""

    def __init__(self, values: np.ndarray, longest: int):
        self.values = values
        self.tables = np.zeros((max(1, int(longest).bit_length()), len(values)), np.int32)
        self.tables[0] = np.arange(len(values))
        for power in range(len(self.tables) - 1):
            count = len(values) - (2 << power) + 1
            left, right = self.tables[power, :count], self.tables[power, 1 << power : (1 << power) + count]
            self.tables[power + 1, :count] = np.where(values[left] >= values[right], left, right)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first position of the maximum of each range ``start ≤ i < end``, none of them empty."""
        power = np.frexp((end - start).astype(float))[1] - 1
        left, right = self.tables[power, start], self.tables[power, end - (1 << power)]
        return np.where(self.values[left] >= self.values[right], left, right)


class Block:
    """The posting lists of a block of documents, as one array sorted by term and place."""

    def __init__(self, ids: list, sizes: np.ndarray, term: np.ndarray, held: np.ndarray, place: np.ndarray, tf: np.ndarray, documents: int, length: int):
        self.keys = [key_of(i) for i in ids]
        self.count = len(ids)
        most = int(sizes.max(initial=0))
        if 90 * most * documents < 2**63:
            spread = 10 + (90 * sizes * documents) // length
        else:
            spread = np.array([10 + 90 * int(n) * documents // length for n in sizes], np.int64)
        tf = tf.astype(np.int64)
        self.part = ((10**9 * tf) // (1000 * tf + 8 * spread[place])).astype(np.int32)  # below 10^6
        self.place = place.astype(np.int32)
        self.at = np.repeat(term.astype(np.int64) * (self.count + 1), held) + place
        self.maxima = RangeMaxima(self.part, held.max(initial=1))

    def ranges(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each term's postings for each interval ``low ≤ place < high`` start and end: arrays of intervals × terms."""
        base = terms[None, :] * (self.count + 1)
        return np.searchsorted(self.at, base + low[:, None]), np.searchsorted(self.at, base + high[:, None])

    def bounds(self, terms: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum of the terms' range maxima, which no score in an interval exceeds, and the document with the largest single impact."""
        start, end = self.ranges(terms, low, high)
        some = end > start
        top = np.zeros(start.shape, np.int64)
        top[some] = self.maxima(start[some], end[some])
        impact = np.where(some, self.part[top], 0) * weights[None, :]
        chosen = impact.argmax(axis=1)
        return impact.sum(axis=1), self.place[top[np.arange(len(low)), chosen]]

    def scores(self, terms: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(places, scores)`` of all documents with a posting in the intervals, which don't overlap."""
        start, end = self.ranges(terms, low, high)
        sizes = (end - start).ravel()
        shift = np.repeat(start.ravel() - (np.cumsum(sizes) - sizes), sizes)
        rows = np.arange(len(shift)) + shift
        weight = np.repeat(np.broadcast_to(weights, start.shape).ravel(), sizes)
        places, own = np.unique(self.place[rows], return_inverse=True)
        total = np.zeros(len(places), np.int64)
        np.add.at(total, own, self.part[rows] * weight)
        return places, total

    def improve(self, best: list, ids: list, terms: np.ndarray, weights: np.ndarray, k: int) -> None:
        """Put this block's documents that are among the ``k`` best into ``best``: ``(-score, key, id)`` in order."""
        low, high = np.zeros(1, np.int64), np.full(1, self.count, np.int64)
        bound, split = self.bounds(terms, weights, low, high)
        while len(low):
            floor, first = 0, 0
            if len(best) == k:
                # Equal scores go to the smaller id, and places are in order of ids.
                floor, first = -best[-1][0], bisect.bisect_left(self.keys, best[-1][1])
            open_ = (bound > floor) | ((bound == floor) & (low < first))
            low, high, bound, split = low[open_], high[open_], bound[open_], split[open_]
            if not len(low):
                return
            order = np.argsort(-bound, kind="stable")
            now, later = order[:WIDTH], order[WIDTH:]
            at, end, middle = low[now], high[now], split[now]
            leaf = end - at <= LEAF
            places, total = self.scores(terms, weights, np.where(leaf, at, middle), np.where(leaf, end, middle + 1))
            good = (total > floor) | ((total == floor) & (places < first))
            if floor == 0:
                good &= total > 0
            places, total = places[good], total[good]
            if len(places) > k:
                top = np.lexsort((places, -total))[:k]
                places, total = places[top], total[top]
            for p, s in zip(places.tolist(), total.tolist(), strict=True):
                bisect.insort(best, (-s, self.keys[p], ids[p]), key=lambda b: b[:2])
            del best[k:]
            inner = ~leaf
            parts_low = np.concatenate([at[inner], middle[inner] + 1])
            parts_high = np.concatenate([middle[inner], end[inner]])
            some = parts_high > parts_low
            parts_low, parts_high = parts_low[some], parts_high[some]
            low, high, bound, split = low[later], high[later], bound[later], split[later]
            if len(parts_low):
                part_bound, part_split = self.bounds(terms, weights, parts_low, parts_high)
                low, high = np.concatenate([low, parts_low]), np.concatenate([high, parts_high])
                bound, split = np.concatenate([bound, part_bound]), np.concatenate([split, part_split])


def _rank(asked, weights, documents, length, k, item_ids, fields):
    def run(batches):
        best: list[list] = [[] for _ in asked]
        kind = None
        for batch in batches:
            kind = batch.column(0).type.value_type
            for row in range(batch.num_rows):
                ids = batch.column(0)[row].as_py()
                lists = [batch.column(i)[row].values.to_numpy(zero_copy_only=False) for i in (1, 2, 3)]
                packed = [np.frombuffer(batch.column(i)[row].as_buffer(), numbers) for i, numbers in ((4, np.int16), (5, np.int32))]
                block = Block(ids, *lists, *packed, documents, length)
                for own, terms in zip(best, asked, strict=True):
                    if len(terms):
                        block.improve(own, ids, terms, weights[terms], k)
        if kind is not None:
            rows = [(q, i, -s) for q, own in enumerate(best) for s, _, i in own]
            numbers = pa.array([q for q, _, _ in rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [numbers, item_ids.take(numbers), pa.array([i for _, i, _ in rows], kind), pa.array([s for _, _, s in rows], pa.int64())], names=fields.names
            )

    return run
