"""Language identification with language-bitmask n-gram filters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telltale.llm.rows import hash_share, small

GRAM = 4
PIECE_CHARS = 1 << 18
MAX_LANGUAGES = 1024


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


def grams(lowered: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit keys of all n-grams inside words (with one blank on each side), the text of each, and whether a text has a letter."""
    code = np.frombuffer(("\n".join(["", *lowered, ""])).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(lowered)), [len(t) + 1 for t in lowered])
    owner = np.concatenate([owner[:1] if len(owner) else np.zeros(1, np.int64), owner])
    is_letter = letters[np.minimum(code, 0xFFFF)]
    rare = np.flatnonzero(code > 0xFFFF)
    if len(rare):
        value, at = np.unique(code[rare], return_inverse=True)
        is_letter[rare] = np.array([chr(c).isalpha() for c in value.tolist()])[at]
    has = np.zeros(len(lowered), bool)
    has[owner[is_letter]] = True
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] = True
    code, owner, is_letter = np.where(is_letter, code, 32)[keep].astype(np.uint64), owner[keep], is_letter[keep]
    n = len(code) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    inner = is_letter[1 : n + 1].copy()
    for k in range(2, GRAM - 1):
        inner &= is_letter[k : n + k]
    key = code[:n].copy()
    for k in range(1, GRAM):
        key = key * np.uint64(0x9E3779B97F4A7C15) + code[k : n + k]
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(32)
    return key[inner], owner[1 : n + 1][inner], has


def pieces(values: list[str]):
    """Ranges of texts of about ``PIECE_CHARS``, and a long text's pieces, cut at blanks: ``(first index, list of texts, is part)``."""
    lo = size = 0
    for i, t in enumerate(values):
        if size and size + len(t) > PIECE_CHARS:
            yield lo, values[lo:i]
            lo, size = i, 0
        if len(t) > 2 * PIECE_CHARS:
            if lo < i:
                yield lo, values[lo:i]
            at = 0
            while at < len(t):
                end = t.find(" ", at + PIECE_CHARS)
                end = len(t) if end < 0 else end
                yield i, [t[at:end]]
                at = end
            lo, size = i + 1, 0
        else:
            size += len(t)
    if lo < len(values):
        yield lo, values[lo:]


def slots(keys: np.ndarray, bits: int, hashes: int) -> list[np.ndarray]:
    """The positions of keys in a filter of ``2 ** bits`` slots."""
    step = (keys >> np.uint64(40)) | np.uint64(1)
    return [((keys + np.uint64(i) * step * np.uint64(0x9E3779B1)) & np.uint64((1 << bits) - 1)).astype(np.int64) for i in range(hashes)]


@dataclass
class LanguageFilter:
    """``table[slot]`` holds one bit per language: all languages' Bloom filters, sliced by slot, so one read answers for every language."""

    languages: list[str]
    table: np.ndarray  # (slots, bytes)
    hashes: int
    false_hits: np.ndarray  # chance that a foreign n-gram passes, per language
    usual: str | None  # answer for letters without any known n-gram

    def hits(self, keys: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
        """n-grams of each text found in each language."""
        bits = int(self.table.shape[0]).bit_length() - 1
        at = slots(keys, bits, self.hashes)
        out = np.zeros((count, 8 * self.table.shape[1]))
        unpack = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
        for plane in range(self.table.shape[1]):
            column = self.table[:, plane]
            mask = column[at[0]]
            for a in at[1:]:
                mask &= column[a]
            seen = np.bincount(owner * 256 + mask, minlength=count * 256).reshape(count, 256)
            out[:, 8 * plane : 8 * plane + 8] = seen @ unpack
        return out[:, : len(self.languages)]


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", where: Column | None = None,
    rows_per_language: int = 20_000, bits: int = 22, hashes: int = 3, ratio: float = 0.5, min_share: float = 1e-6,
) -> LanguageFilter:
    """Build the filters from rows with a language.

    At most about ``rows_per_language`` rows of each language, drawn by a hash of the id, are read. An n-gram enters a
    language's filter if its share there is at least ``min_share`` and ``ratio`` times its largest share in any language, so
    neither foreign lines nor rare slips enter, and a filter never gets more than ``1 / min_share`` n-grams. The table has
    ``2 ** bits`` slots of one bit per language, whatever the input. Null texts and null languages teach nothing. Rows with a null or repeated id share
    one draw, so of those all or none are read, which may be more than the bound.
    """
    source = (docs if where is None else docs.where(where)).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    source = source.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = sorted((r["lang"], r["n"]) for r in source.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect())
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} values")
    names = [lang for lang, _ in sizes]
    width = max(1, -(-len(names) // 8))
    table = np.zeros((1 << bits, width), np.uint8)
    if not names:
        return LanguageFilter([], table, hashes, np.zeros(0), None)
    share = F.create_map(*[x for lang, n in sizes for x in (F.lit(lang), F.lit(rows_per_language / n))])
    sample = source.where(hash_share("doc_id") < share[F.col("lang")])
    number = {lang: i for i, lang in enumerate(names)}

    def count(batches):
        letters = _letters()
        for batch in small(batches):
            own = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            parts = []
            for lo, part in pieces([t.lower() for t in batch.column("text").to_pylist()]):
                keys, owner, _ = grams(part, letters)
                langs = own[owner + lo]
                for lang in np.unique(langs):
                    value, n = np.unique(keys[langs == lang], return_counts=True)
                    parts.append((np.full(len(value), lang), value.view(np.int64), n))
            if parts:
                lang, key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["lang", "key", "n"])

    counts = sample.select("lang", "text").mapInArrow(count, "lang int, key long, n long").groupBy("key", "lang").agg(F.sum("n").alias("n"))
    per_key = counts.groupBy("key").agg(F.collect_list(F.struct("lang", "n")).alias("of"))  # at most one entry per language
    per_key = per_key.persist()
    totals = {r["lang"]: r["n"] for r in per_key.select(F.explode("of").alias("x")).groupBy("x.lang").agg(F.sum("x.n").alias("n")).collect()}
    scale = F.create_map(*[x for lang, n in totals.items() for x in (F.lit(lang), F.lit(1.0 / n))]) if totals else None
    chosen = per_key.where(F.lit(False)).select("key", F.lit(0).alias("lang")) if scale is None else (
        per_key.select("key", F.transform("of", lambda x: F.struct(x["lang"].alias("lang"), (x["n"] * scale[x["lang"]]).alias("s"))).alias("of"))
        .select("key", F.array_max(F.transform("of", lambda x: x["s"])).alias("most"), F.explode("of").alias("x"))
        .where((F.col("x.s") >= ratio * F.col("most")) & (F.col("x.s") >= min_share))
        .select("key", F.col("x.lang").alias("lang"))
    )

    def place(batches):
        for batch in batches:
            keys, lang = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            at = np.concatenate(slots(keys, bits, hashes)) if len(keys) else np.zeros(0, np.int64)
            code = np.unique(at << 10 | np.tile(lang, hashes))
            yield pa.RecordBatch.from_arrays([pa.array(code >> 10 >> 12, pa.int32()), pa.array(code, pa.int64())], names=["slice", "code"])

    def fill(group):
        code = group.column("code").to_numpy()
        slot, lang = (code >> 10) & 4095, code & 1023
        part = np.zeros((4096, width), np.uint8)
        np.bitwise_or.at(part, (slot, lang >> 3), (1 << (lang & 7)).astype(np.uint8))
        return pa.table({"slice": pa.array([int(code[0] >> 22)], pa.int32()), "part": pa.array([part.tobytes()], pa.binary())})

    placed = chosen.mapInArrow(place, "slice int, code long").distinct()
    for row in placed.groupBy("slice").applyInArrow(fill, "slice int, part binary").toArrow().to_pylist():
        table[row["slice"] << 12 : (row["slice"] + 1) << 12] = np.frombuffer(row["part"], np.uint8).reshape(4096, width)
    per_key.unpersist()
    full = np.array([(table[:, i >> 3] >> (i & 7) & 1).mean() for i in range(len(names))])
    return LanguageFilter(names, table, hashes, full**hashes, max(sizes, key=lambda x: (x[1], x[0]))[0])


def identify(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, lang_pred, score`` and the columns of ``carry`` (a single struct is best) unchanged.

    For each language the share of the text's n-grams in its filter is corrected for false positives; the largest
    wins and is the score (0 to 1), ties go to the first name. ``und`` with score 0 if the text is null or has no letter; a text with letters but
    no n-gram (one-letter words) or none that is known gets the most frequent language of the training rows with score 0.
    """
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c) for c in carry or []]]
    source = docs.select(*columns)
    kept = [f for f in source.schema if f.name != "text"]
    fields = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.hashes, model.false_hits, model.usual))

    def run(batches):
        m, letters = LanguageFilter(*shared.value), _letters()
        for batch in small(batches):
            values = [(t or "").lower() for t in batch.column(1).to_pylist()]
            hits, total, has = np.zeros((len(values), len(m.languages))), np.zeros(len(values)), np.zeros(len(values), bool)
            for lo, part in pieces(values):
                keys, owner, letter = grams(part, letters)
                hits[lo : lo + len(part)] += m.hits(keys, owner, len(part))
                total[lo : lo + len(part)] += np.bincount(owner, minlength=len(part))
                has[lo : lo + len(part)] |= letter
            names, scores = [], []
            if m.languages:
                rate = np.clip((hits / np.maximum(total, 1)[:, None] - m.false_hits) / np.maximum(1 - m.false_hits, 1e-9), 0, 1)
                best, value = rate.argmax(axis=1), rate.max(axis=1)
            for i in range(len(values)):
                known = bool(m.languages) and has[i]
                names.append("und" if not known else m.languages[best[i]] if value[i] > 0 else m.usual)
                scores.append(float(value[i]) if known else 0.0)
            rest = [batch.column(i) for i in range(batch.num_columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[f.name for f in fields])

    return source.mapInArrow(run, fields)
