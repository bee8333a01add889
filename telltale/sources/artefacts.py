"""Save and load what the fitting jobs produce, as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.operators.deviation import bands_table, bands_values
from telltale.operators.forest import Forest
from telltale.operators.scaling import Scaler, scaler_values
from telltale.operators.similarity import SimilarityIndex
from telltale.operators.vectors import TextEncoder
from telltale.plans.analyze import Resources
from telltale.plans.anomaly_model import AnomalyModel
from telltale.plans.preprocess import scaler_table
from telltale.schemas import DEFAULT_KB_NAME


def exists(spark: SparkSession, path: str) -> bool:
    """True if the path exists on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def save_scaler(spark: SparkSession, scaler: Scaler, path: str) -> None:
    scaler_table(spark, scaler).coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> Scaler:
    return scaler_values(spark.read.parquet(path))


def save_model(spark: SparkSession, model: AnomalyModel, path: str) -> None:
    forest = model.forest
    forest.nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/forest_nodes")
    meta = spark.createDataFrame(
        [(forest.sample_size, forest.trees, forest.offset)], "sample_size int, trees int, offset double"
    )
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/forest_meta")
    if model.bands:
        bands_table(spark, model.bands).coalesce(1).write.mode("overwrite").parquet(f"{path}/bands")


def load_model(spark: SparkSession, path: str) -> AnomalyModel:
    """Without saved bands, verdicts carry no contributions."""
    meta = spark.read.parquet(f"{path}/forest_meta").first()
    forest = Forest(spark.read.parquet(f"{path}/forest_nodes"), meta["sample_size"], meta["trees"], meta["offset"])
    bands = bands_values(spark.read.parquet(f"{path}/bands")) if exists(spark, f"{path}/bands") else None
    return AnomalyModel(forest, bands)


def save_index(spark: SparkSession, index: SimilarityIndex, path: str) -> None:
    index.leaves.write.mode("overwrite").parquet(f"{path}/leaves")
    for name, tables in (("level", index.levels), ("pages", index.pages)):
        for number, boxes in enumerate(tables):
            boxes.write.mode("overwrite").parquet(f"{path}/{name}-{number}")
    rows = [(i, s, len(index.levels)) for i, s in enumerate(index.sensors)]
    meta = spark.createDataFrame(rows, "position int, sensor string, levels int")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    save_scaler(spark, index.scaler, f"{path}/scaler")


def load_index(spark: SparkSession, path: str) -> SimilarityIndex:
    meta = spark.read.parquet(f"{path}/meta").orderBy("position").collect()
    levels = [spark.read.parquet(f"{path}/level-{number}") for number in range(meta[0]["levels"])]
    pages = [spark.read.parquet(f"{path}/pages-{number}") for number in range(len(levels) - 1)]
    return SimilarityIndex(spark.read.parquet(f"{path}/leaves"), levels, pages, load_scaler(spark, f"{path}/scaler"), tuple(r["sensor"] for r in meta))


def save_knowledge(docs: DataFrame, path: str, encoder_model: TextEncoder | None = None) -> None:
    docs.write.mode("overwrite").parquet(f"{path}/documents")
    if encoder_model is not None:
        rows = docs.sparkSession.createDataFrame(list(enumerate(encoder_model.rarity)), "dimension int, rarity double")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/encoder")


def load_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """Fails when the knowledge base has not been built."""
    return spark.read.parquet(f"{path}/documents")


def save_resources(spark: SparkSession, resources: Resources, path: str) -> None:
    save_index(spark, resources.index, f"{path}/index")
    save_model(spark, resources.model, f"{path}/model")
    save_knowledge(resources.docs, f"{path}/knowledge", getattr(resources.encoder, "model", None))


def load_resources(spark: SparkSession, path: str, encoder=None, kb_name: str = DEFAULT_KB_NAME) -> Resources:
    """``encoder`` is needed only when the knowledge base was built with one of your own."""
    if encoder is None:
        rows = spark.read.parquet(f"{path}/knowledge/encoder").orderBy("dimension").collect()
        encoder = TextEncoder([r["rarity"] for r in rows]).encode

    return Resources(
        load_index(spark, f"{path}/index"), load_model(spark, f"{path}/model"),
        load_knowledge(spark, f"{path}/knowledge"), encoder, kb_name,
    )


def write_packages(packages: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Nested rows as Parquet, or one JSON text per incident (``fmt='json'``)."""
    from telltale.operators.evidence import package_json

    if fmt == "json":
        packages.select("incident_id", package_json().alias("package")).write.mode(mode).json(path)
    else:
        packages.write.mode(mode).format(fmt).save(path)


def quality_metrics(report: DataFrame) -> dict[str, int]:
    """The dozen metric rows of a quality report."""
    return {r["metric"]: r["value"] for r in report.select("metric", F.col("value")).collect()}
