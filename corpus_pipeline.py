"""From raw documents to a training mix: five stages, each written before the next one reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.llm import decontaminate, exact, language, mixing, simhash
from telltale.session import delete_folder, materialise, scratch_dir, scratch_scope


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``_key`` that orders by id, nulls last, and tells repeated ids apart.

    The number is written with the rows: a number made while reading depends on how the files are split, which follows the cores alive at that time, so two plans
    over one table could number it differently.
    """
    row = F.monotonically_increasing_id().alias("row")
    return materialise(docs.withColumn("_key", F.struct(F.isnull("doc_id").alias("absent"), "doc_id", row)), "numbered", compression="zstd")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language: null texts, texts without a letter, texts of which no n-gram is known."""
    packed = docs.select("text", F.struct(*docs.columns).alias("_row"))
    found = language.identify(packed.withColumn("_id", F.lit(0)), language.fit(docs), id_col="_id", carry=["_row"])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") > 0)).select("_row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest id of equal texts."""
    numbered = _numbered(docs)
    kept = exact.exact_duplicates(numbered, id_col="_key").where("kept").select(F.col("doc_id").alias("_key"))
    return numbered.join(kept, "_key", "left_semi").drop("_key")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates."""
    numbered = _numbered(docs)
    found = simhash.near_duplicates(numbered, id_col="_key")
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_key"))
    return numbered.join(kept, "_key", "left_semi").drop("_key")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    packed = docs.select("text", F.struct(*docs.columns).alias("_row"))
    return decontaminate.clean(packed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry="_row").select("_row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with how many of their words it takes; documents that it doesn't take go.

    Columns of ``docs`` that have the name of an added one give way to it.
    """
    packed = docs.select("text", "source", "doc_id", F.struct(*docs.columns).alias("_row"))
    mixed = mixing.mix_sources(packed, carry=("_row",))
    added = ["size", "source_size", "target", "taken"]
    return mixed.where("taken > 0").select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in added], *added)


STAGES = [
    ("languages", languages),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("mixture", mixture),
]

# Language filters and edit matching have no SQL form; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages. What a stage writes on its way is deleted once its result is written, and a stage's result once the next one's is."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/telltale/stage-{name}-{uuid.uuid4().hex}"
        with scratch_scope(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if last:
            delete_folder(spark, last)
        last = path
    return docs
