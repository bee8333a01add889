"""Knowledge entries from YAML or JSON files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.schemas import KNOWLEDGE_ENTRY


def _texts(value) -> dict[str, str] | None:
    """A language map; plain text is filed under ``en``."""
    if not value:
        return None
    if isinstance(value, dict):
        return {str(k): str(v) for k, v in value.items() if v is not None}
    return {"en": str(value)}


def _strings(value) -> dict[str, str | None]:
    return {str(k): None if v is None else str(v) for k, v in value.items()} if isinstance(value, dict) else {}


def _entry(raw: dict, source_file: str, position: int) -> dict:
    return {
        "source_file": source_file,
        "position": position,
        "code": None if raw.get("code") is None else str(raw["code"]),
        "category": str(raw.get("category") or ""),
        "title": _texts(raw.get("title")),
        "description": _texts(raw.get("description")),
        "affected_components": [str(c) for c in raw.get("affected_components") or []],
        "common_causes": [{"label": _texts(c["label"]) or {}} for c in raw.get("common_causes") or [] if "label" in c],
        "repair": _strings(raw.get("repair")),
        "flags": _strings(raw.get("flags")),
    }


def _parse_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            entries = yaml.safe_load(bytes(content).decode("utf-8"))
            rows = [_entry(e, path.rsplit("/", 1)[-1], i) for i, e in enumerate(entries or [])]
            if rows:
                yield pd.DataFrame(rows, columns=KNOWLEDGE_ENTRY.names)


def read_yaml_entries(spark: SparkSession, folder: str, pattern: str = "*.yaml") -> DataFrame:
    """All entries of the YAML files directly in ``folder``; a file is parsed in one task, empty files give no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    return files.mapInPandas(_parse_files, KNOWLEDGE_ENTRY)


def read_json_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries from JSON lines that follow the entry schema, for knowledge bases too large for YAML.

    ``source_file`` and ``position`` must be in the lines: they order the documents.
    """
    entries = spark.read.schema(KNOWLEDGE_ENTRY).json(path)
    return entries.withColumn("source_file", F.coalesce("source_file", F.lit("")))
