"""Near-duplicates by SimHash: a byte-position inverted index with count filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.llm.components import connected_components
from telltale.llm.rows import small, texts
from telltale.session import materialise

BITS, SEED, BLOCK = 64, 42, 1 << 16


def fingerprint(text: bytes | None, shingle: int) -> int:
    """Signed 64-bit SimHash. A bit is set if it is set in more than half of the shingles' hashes, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return int(np.uint64(xxhash.xxh64_intdigest(joined, SEED)).astype(np.int64))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in pairs), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), BLOCK):
        part = hashes[lo : lo + BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fingerprint long)`` for every row; null and blank texts have fingerprint 0."""
    source = texts(docs, id_col, text_col)
    fields = source.select("doc_id", F.lit(0).cast("long").alias("fingerprint")).schema

    def run(batches):
        for batch in small(batches):
            values = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["doc_id", "fingerprint"])

    return source.mapInArrow(run, fields)


def equal_bytes(a: str, b: str):
    """How many of the eight positions hold the same byte in two fingerprints."""
    return sum(F.when(F.expr(f"({a} ^ {b}) & {_signed(0xFF << (8 * i))}L") == 0, 1).otherwise(0) for i in range(8))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct values of ``fingerprint`` that differ in 1 to ``max_bits`` (at most 3) bits.

    At most ``max_bits`` bytes of a linked pair differ, so at least ``8 - max_bits`` positional bytes agree: that is the
    guaranteed minimum. Postings of one byte would hold a 256th of all rows each, so an entry of the index is a set of
    that many positions with their bytes: two fingerprints meet in an entry if and only if their count of shared bytes
    reaches the minimum. Copies are one entry, and an entry leaves only ``max_bits`` bytes free, which bounds its list by
    ``256 ** max_bits``. Entries with one member, nearly all, end in the aggregation; entries with two need only their least and
    largest member; only larger ones are listed. So the index is the joint form of
    tallying equal bytes per pair; the count of equal bytes and the bits are verified per pair.
    """
    least = 8 - max_bits
    masks = [sum(0xFF << (8 * i) for i in kept) for kept in combinations(range(8), least)]
    distinct = prints.select("fingerprint").distinct()
    entries = distinct.select(
        "fingerprint",
        F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.expr(f"fingerprint & {_signed(m)}L").alias("bytes")) for n, m in enumerate(masks)])).alias("e"),
    ).select("fingerprint", F.col("e.n").alias("n"), F.col("e.bytes").alias("bytes"))
    met = entries.groupBy("n", "bytes").agg(F.count(F.lit(1)).alias("members"), F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b"))
    met = materialise(met.where("members > 1"), "postings")
    listed = entries.join(met.where("members > 2").select("n", "bytes"), ["n", "bytes"]).groupBy("n", "bytes").agg(F.collect_list("fingerprint").alias("all"))
    close = f"x -> x > a AND bit_count(x ^ a) <= {max_bits}"
    in_lists = (
        listed.select("all", F.explode("all").alias("a"))
        .select("a", F.explode(F.expr(f"filter(all, {close})")).alias("b"))
    )
    pairs = met.where("members = 2").select("a", "b").union(in_lists)
    return pairs.where((equal_bytes("a", "b") >= least) & (F.expr("bit_count(a ^ b)") <= max_bits)).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2
) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``, the smallest id reachable over links.

    Fingerprints link at ``max_bits`` or fewer differing bits. Null text counts as empty; blank texts have fingerprint 0 and link
    like any other. Repeated rows each return a row. A null id never becomes a component's id unless the component has
    no other (then it is null). An empty table gives an empty result.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    firsts = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    found = connected_components(links(prints, max_bits))
    members = firsts.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    members = materialise(members.withColumn("component", F.coalesce("component", "fingerprint")), "members")
    ids = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = members.join(ids, "component").select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")
