"""Telemetry and incident tables: Parquet or CSV in, Parquet or CSV out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telltale.functions.codes import parse_code_list
from telltale.schemas import raw_incident_schema, telemetry_schema


def read_telemetry(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Raw observations with a fixed schema, never inferred. ``fmt`` is any Spark file format; CSV needs a header."""
    reader = spark.read.schema(schema or telemetry_schema())
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)


def read_incidents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Incidents as text columns with a list of codes; the list may be written as text in CSV."""
    schema = raw_incident_schema()
    if fmt != "csv":
        return spark.read.schema(schema).format(fmt).load(path)
    flat = T.StructType([*schema.fields[:-1], T.StructField("active_dtcs", T.StringType())])
    raw = spark.read.schema(flat).option("header", True).csv(path)
    return raw.withColumn("active_dtcs", F.when(F.col("active_dtcs").isNotNull(), parse_code_list(F.col("active_dtcs"))))


def list_as_text(codes) -> F.Column:
    """``['P0403', 'P0404']``; the form that ``parse_code_list`` reads."""
    quoted = F.transform(codes, lambda c: F.concat(F.lit("'"), c, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def write_history(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Processed telemetry. CSV cannot hold arrays, so the code list becomes text there."""
    if fmt == "csv":
        df.withColumn("active_dtcs", list_as_text(F.col("active_dtcs"))).write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).format(fmt).save(path)


def read_history(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Processed telemetry; a code list written as text is parsed, unreadable lists become empty."""
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    if schema is None:
        raise ValueError("CSV history needs its schema.")
    flat = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "active_dtcs" else f for f in schema.fields])
    raw = spark.read.schema(flat).option("header", True).csv(path)
    return raw.withColumn("active_dtcs", parse_code_list(F.col("active_dtcs")))
