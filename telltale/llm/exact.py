"""Exact deduplication by deterministic block naming."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telltale.llm.rows import first_row_number, small
from telltale.session import materialise

BLOCK_BYTES = 4096
FLUSH_BYTES = 32 << 20
NAME_BUCKETS = 1 << 14
ONE_SPACE = r"[\t-\r][\x20\t-\r]*|\x20[\x20\t-\r]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty. A lone space needs no rewriting."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), ONE_SPACE, " ")


def _cut(source: DataFrame, block_bytes: int) -> DataFrame:
    """Rows of two kinds from one pass: a block of a document (``row, doc_id, sha, pos, blocks, chunk``) and a content (``chunk, block``).

    Equal blocks of one task share a chunk number, so that copies send their content once per task and no list of
    them is ever gathered. The table of contents is flushed at a fixed size; a content may so get several numbers.
    """
    id_type = source.schema["doc_id"].dataType
    fields = T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("doc_id", id_type), T.StructField("sha", T.BinaryType()), T.StructField("pos", T.IntegerType()), T.StructField("blocks", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("block", T.BinaryType())]
    )

    def run(batches):
        row = next_chunk = first_row_number()
        seen: dict[bytes, int] = {}
        held = 0
        for batch in small(batches):
            id_column = batch.column(0)
            takes, rows, shas, positions, sizes, numbers, contents = [], [], [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                text = value.as_py()
                sha = hashlib.sha256(text).digest()
                count = max(1, -(-len(text) // block_bytes))
                for pos in range(count):
                    block = text[pos * block_bytes : (pos + 1) * block_bytes]
                    chunk = seen.get(block)
                    if chunk is None:
                        chunk = seen[block] = next_chunk
                        next_chunk += 1
                        held += len(block) + 100
                        takes.append(None), rows.append(None), shas.append(None), positions.append(None), sizes.append(None), numbers.append(chunk), contents.append(block)
                    takes.append(i), rows.append(row), shas.append(sha), positions.append(pos), sizes.append(count), numbers.append(chunk), contents.append(None)
                row += 1
                if held > FLUSH_BYTES:
                    seen, held = {}, 0
            ids = id_column.take(pa.array(takes, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), ids, pa.array(shas, pa.binary()), pa.array(positions, pa.int32()), pa.array(sizes, pa.int32()), pa.array(numbers, pa.int64()), pa.array(contents, pa.binary())],
                names=[f.name for f in fields],
            )

    return source.mapInArrow(run, fields)


def _named(values: DataFrame, keys: list[str]) -> DataFrame:
    """Integer names for the contents of ``keys``: equal contents get one name, different ones never do.

    Contents are dealt to buckets by hash and sorted there; the name is the bucket and the rank in it, so it depends on the
    set of contents alone.
    """
    spot = W.partitionBy("_bucket").orderBy(*keys)
    bucketed = values.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(NAME_BUCKETS)))
    return bucketed.withColumn("name", F.shiftleft("_bucket", 40) + F.dense_rank().over(spot)).drop("_bucket")


def name_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(row, doc_id, sha, level, name)`` for every row: ``(level, name)`` is equal if and only if the normalised texts are.

    Level 0 names fixed-size blocks by sorting them. Each further level names the adjacent pairs of the level below (a last odd one is
    paired with nothing), until one name is left; documents of one block are done at level 0. No hash decides equality.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).cast("binary").alias("text"))
    cut = materialise(_cut(source, block_bytes), "blocks")
    names = _named(cut.where("block IS NOT NULL").select("chunk", "block"), ["block"]).select("chunk", "name")
    named = cut.where("block IS NULL").drop("block").join(names, "chunk").drop("chunk")
    current = materialise(named, "names-0")
    done, level = current.where("blocks = 1").select("row", "doc_id", "sha", F.lit(0).alias("level"), "name"), 0
    current = current.where("blocks > 1")
    while current.limit(1).count():
        level += 1
        side = lambda r: F.max(F.when(F.col("pos") % 2 == r, F.col("name")))
        pairs = current.groupBy("row", F.shiftright("pos", 1).alias("half")).agg(
            F.first("doc_id").alias("doc_id"), F.first("sha").alias("sha"), F.first("blocks").alias("n"), side(0).alias("left"), F.coalesce(side(1), F.lit(-1)).alias("right")
        )
        pairs = materialise(pairs, f"pairs-{level}")
        named = pairs.join(_named(pairs.select("left", "right").distinct(), ["left", "right"]), ["left", "right"])
        stored = materialise(
            named.select("row", "doc_id", "sha", F.col("half").alias("pos"), F.expr("cast((n + 1) div 2 as int)").alias("blocks"), "name"), f"names-{level}"
        )
        done = done.union(stored.where("blocks = 1").select("row", "doc_id", "sha", F.lit(level).alias("level"), "name"))
        current = stored.where("blocks > 1")
    return done


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if they are identical after each run of ASCII white space became one space; null counts as empty. The
    row with the smallest id stays; ids that are null come last, and of rows that repeat an id exactly one stays. An empty
    table gives an empty result.
    """
    named = materialise(name_documents(docs, id_col, text_col, block_bytes), "identities")
    order = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    # Written first: a join of two stored tables can split the rows of a hot group, one on top of its aggregation cannot.
    groups = materialise(named.groupBy("level", "name").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")), "groups")
    return named.join(groups, ["level", "name"]).select(
        "doc_id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
