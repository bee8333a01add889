"""Analyze incidents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from telltale.operators.evidence import package_json
from telltale.plans.analyze import Resources, analyze_incidents
from telltale.schemas import raw_incident_schema
from telltale.session import materialise, scratch_scope, write_whole


def read_incident_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    """New incident files in a folder. Other sources need only deliver the same columns."""
    reader = spark.readStream.schema(raw_incident_schema()).option("maxFilesPerTrigger", max_files)
    return reader.format(fmt).load(path)


def analyze_stream(
    incidents: DataFrame, resources: Resources, output: str, checkpoint: str, mode: str = "reject",
    as_json: bool = False, trigger: dict | None = None,
) -> StreamingQuery:
    """Run the batch analysis on every micro-batch.

    Incidents do not depend on each other, so there is no state and no watermark. A batch is put as a whole into a folder of its
    own, which a retry replaces, so every incident appears once and no reader sees half a batch. Index, vectors, codes and trees are read and sent once, before the first batch.
    """

    resources.prepare()

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        with scratch_scope(batch.sparkSession):
            # The analysis reads its input several times; the source is read once.
            packages = analyze_incidents(materialise(batch, "incidents"), resources, mode)
            if as_json:
                packages = packages.select("incident_id", package_json().alias("package"))
            write_whole(packages, f"{output}/batch_id={batch_id}")

    writer = incidents.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
