"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telltale.llm.rows import chunks, small

GRAM = 8
MIX = np.uint64(0x9E3779B97F4A7C15)
SIEVE_BITS = 20
BLOCK_OF_ITEMS_BYTES = 4 << 20
#: Letters and digits; every byte of a letter beyond ASCII counts as one.
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def plain(text: bytes | None) -> bytes:
    """ASCII letters lower-cased, white space collapsed."""
    return b" ".join((text or b"").lower().split())


def myers(pattern: bytes, text: bytes, budget: int) -> tuple[int, int] | None:
    """Least edit distance of ``pattern`` to any substring of ``text`` and that substring's end (the first of equals); None above ``budget``.

    Myers' bit-parallel columns on whole integers: one bit per pattern byte.
    """
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    at: dict[int, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    up, down, score, best, end = full, 0, m, m, 0  # the empty substring takes m edits
    for j, c in enumerate(text, 1):
        eq = at.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        gain, loss = down | (full & ~(x | up)), up & x
        score += 1 if gain & high else -1 if loss & high else 0
        if score < best:
            best, end = score, j
        gain = gain << 1  # a match may start anywhere, so the first row stays zero
        x2 = eq | down
        up = ((loss << 1) | (full & ~(x2 | gain))) & full
        down = gain & x2 & full
    return (best, end) if best <= budget else None


def budget_of(length: int, error_rate: float) -> int:
    """Edits allowed for an item, as far as its pieces keep ``GRAM`` bytes each."""
    return max(0, min(int(length * error_rate), length // GRAM - 1))


class Searcher:
    """Exact search for the pieces of a block of items, then verification."""

    def __init__(self, items: list[tuple], error_rate: float):
        """``items``: (id, normalised text) of at least ``GRAM`` bytes."""
        self.items = items
        self.budgets = [budget_of(len(t), error_rate) for _, t in items]
        first: dict[int, list[tuple[int, int, bytes]]] = {}
        for n, (_, text) in enumerate(items):
            pieces = self.budgets[n] + 1
            cuts = [len(text) * p // pieces for p in range(pieces + 1)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                first.setdefault(int.from_bytes(text[lo : lo + GRAM], "little"), []).append((n, lo, text[lo:hi]))
        self.first = first
        self.keys = np.array(sorted(first), np.uint64)
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[(self.keys * MIX) >> np.uint64(64 - SIEVE_BITS)] = True

    def places(self, buffer: bytes) -> list[tuple[int, int]]:
        """Positions at which a piece may start, each with its first bytes as a number."""
        if len(buffer) < GRAM or not len(self.keys):
            return []
        grams = np.ndarray((len(buffer) - GRAM + 1,), "<u8", buffer, strides=(1,)).astype(np.uint64)
        spots = np.flatnonzero(self.sieve[(grams * MIX) >> np.uint64(64 - SIEVE_BITS)])
        found = grams[spots]
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        hit = self.keys[at] == found
        return list(zip(spots[hit].tolist(), found[hit].tolist(), strict=True))

    def matches(self, text: bytes, places: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """``(item, edits, end)`` of the best match of every item within its budget in ``text``."""
        starts: dict[int, set[int]] = {}
        for spot, gram in places:
            for n, offset, piece in self.first[gram]:
                if text.startswith(piece, spot):
                    starts.setdefault(n, set()).add(spot - offset)
        out = []
        for n, expected in starts.items():
            item, budget = self.items[n][1], self.budgets[n]
            exact = next((s for s in sorted(expected) if s >= 0 and text.startswith(item, s)), None)
            if exact is not None:
                out.append((n, 0, exact + len(item)))
                continue
            best, reach = None, -1
            for s in sorted(expected):
                lo, hi = max(0, s - budget), min(len(text), s + len(item) + budget)
                if hi <= reach:
                    continue
                reach = hi
                got = myers(item, text[lo:hi], budget)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], lo + got[1])
            if best:
                out.append((n, *best))
        return out


class ShortSearcher:
    """Exact search for short items on word borders: a letter or digit at an item's end has none beside it."""

    def __init__(self, items: list[tuple]):
        self.items = items
        self.first: dict[bytes, list[tuple[int, int]]] = {}
        self.marks: list[int] = []  # items without a letter or digit
        for n, (_, text) in enumerate(items):
            head = TOKEN.search(text)
            if head:
                self.first.setdefault(head.group(), []).append((n, head.start()))
            else:
                self.marks.append(n)

    def matches(self, text: bytes) -> list[tuple[int, int, int]]:
        """``(item, 0, end)`` of the first place of every item in ``text``."""
        ends: dict[int, int] = {}
        for m in TOKEN.finditer(text) if self.first else ():
            for n, offset in self.first.get(m.group(), ()):
                lo, item = m.start() - offset, self.items[n][1]
                end = lo + len(item)
                if n not in ends and lo >= 0 and text.startswith(item, lo) and not (TOKEN.match(item[-1:]) and TOKEN.match(text[end : end + 1])):
                    ends[n] = end
        padded = b" " + text + b" " if self.marks else b""
        for n in self.marks:
            at = padded.find(b" " + self.items[n][1] + b" ")
            if at >= 0:
                ends[n] = at + len(self.items[n][1])
        return [(n, 0, end) for n, end in ends.items()]


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", error_rate: float = 0.05, min_words: int = 8,
) -> DataFrame:
    """One row per document row and benchmark item found in it: ``doc_id, item_id, edits, end`` (``end``: a byte of the normalised text).

    An item is found if some substring of the document is within ``error_rate`` of the item's length in edits, after
    ASCII lower-casing and collapsing of white space. Of budget + 1 pieces of the item, at least one survives that many edits unchanged, so only
    places with an exact piece are verified. Items of fewer than ``min_words`` words whose length
    allows no edit must lie on word borders, so that no part of a longer word counts. Null texts and blank items hold nothing; repeated rows each return their rows; equal items are each reported; an empty table on either side gives no rows.

    The benchmark is a stated query set: it is taken in blocks of about ``BLOCK_OF_ITEMS_BYTES``, and each block goes over all documents.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    wanted = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("binary").alias("text"))
    fields = T.StructType([source.schema["doc_id"], T.StructField("item_id", wanted.schema["item_id"].dataType), T.StructField("edits", T.IntegerType()), T.StructField("end", T.LongType())])
    found = None
    for items, exact, item_ids in _blocks(wanted, error_rate, min_words):
        part = source.mapInArrow(_search(items, exact, item_ids, error_rate, fields), fields)
        found = part if found is None else found.union(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, carry: str, text_col: str = "text", item_text_col: str = "text", error_rate: float = 0.05, min_words: int = 8) -> DataFrame:
    """Column ``carry`` of the document rows that ``leaks`` finds no item in, null and blank texts among them. One pass over the documents per block of items, without a shuffle."""
    source = docs.select(F.col(carry), F.col(text_col).cast("binary").alias("text"))
    wanted = benchmark.select(F.lit(None).cast("int").alias("item_id"), F.col(item_text_col).cast("binary").alias("text"))
    for items, exact, _ in _blocks(wanted, error_rate, min_words):
        source = source.mapInArrow(_keep_clean(items, exact, error_rate), source.schema)
    return source.select(carry)


def _blocks(wanted: DataFrame, error_rate: float, min_words: int):
    """The items in blocks of bounded size: those to search with edits, those to search exactly, and their ids."""
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_OF_ITEMS_BYTES) or 1
    for number in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).toArrow()
        items = [(i, plain(t.as_py())) for i, t in enumerate(block.column("text"))]
        exact = [(i, t) for i, t in items if t and (len(t) < GRAM or len(t.split()) < min_words and not budget_of(len(t), error_rate))]
        short = {i for i, _ in exact}
        yield [(i, t) for i, t in items if t and i not in short], exact, block.column("item_id").combine_chunks()


def _matches(texts: list[bytes], searcher: Searcher, brief: ShortSearcher):
    """``(text, item, edits, end)`` of all matches in a list of normalised texts."""
    for lo, hi in chunks(texts):
        buffer = b"\n".join(texts[lo:hi])
        places, p, base = searcher.places(buffer), 0, 0
        for i in range(lo, hi):
            own, top = [], base + len(texts[i])
            while p < len(places) and places[p][0] < top:
                own.append((places[p][0] - base, places[p][1]))
                p += 1
            base = top + 1
            for n, k, end in searcher.matches(texts[i], own) if own else ():
                yield i, searcher.items[n][0], k, end
            for n, k, end in brief.matches(texts[i]) if brief.items else ():
                yield i, brief.items[n][0], k, end


def _search(items, exact, item_ids, error_rate, fields):
    def run(batches):
        searcher, brief = Searcher(items, error_rate), ShortSearcher(exact)
        for batch in small(batches):
            found = list(_matches([plain(t.as_py()) for t in batch.column(1)], searcher, brief))
            if found:
                rows, numbers, edits, ends = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), item_ids.take(pa.array(numbers)), pa.array(edits, pa.int32()), pa.array(ends, pa.int64())], names=[f.name for f in fields]
                )

    return run


def _keep_clean(items, exact, error_rate):
    def run(batches):
        searcher, brief = Searcher(items, error_rate), ShortSearcher(exact)
        for batch in small(batches):
            dirty = {row for row, *_ in _matches([plain(t.as_py()) for t in batch.column(1)], searcher, brief)}
            yield batch.filter(pa.array([i not in dirty for i in range(batch.num_rows)], pa.bool_()))

    return run
