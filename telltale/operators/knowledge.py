"""From nested knowledge entries to searchable documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telltale.operators.ordinals import with_ordinal

UNKNOWN, NONE = "Unknown", "None"


def coded_entries(entries: DataFrame) -> DataFrame:
    """Entries that have a code."""
    return entries.filter(F.col("code").isNotNull() & (F.col("code") != ""))


def language(texts: Column) -> Column:
    """English text if there is one, else the first of the map, else an empty string."""
    return F.coalesce(F.try_element_at(texts, F.lit("en")), F.try_element_at(F.map_values(texts), F.lit(1)), F.lit(""))


def causes(entry_causes: Column) -> Column:
    """Labels of the causes that carry one."""
    labelled = F.filter(entry_causes, lambda c: c["label"].isNotNull())
    return F.coalesce(F.transform(labelled, lambda c: language(c["label"])), F.array().cast("array<string>"))


def _listed(values: Column, separator: str) -> Column:
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.array_join(values, separator)).otherwise(NONE)


def repair_text(repair: Column) -> Column:
    # The labels of the repair line.
    labels = {
        "Difficulty": "difficulty", "DIY Possible": "diy_possible",
        "Cost EUR": "estimated_cost_eur", "Hours": "estimated_hours",
    }
    # A field that is there without a value is not the same as an absent one.
    value = {f: F.when(F.map_contains_key(repair, f), F.coalesce(F.try_element_at(repair, F.lit(f)), F.lit(NONE))) for f in labels.values()}
    parts = [F.concat(F.lit(f"{label}: "), F.coalesce(value[f], F.lit(UNKNOWN))) for label, f in labels.items()]
    return F.concat_ws(", ", *parts)


def flags_text(flags: Column) -> Column:
    pairs = F.transform(
        F.map_entries(flags), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(NONE)))
    )
    return _listed(pairs, ", ")


def document_fields(entries: DataFrame) -> DataFrame:
    """Add the flat texts that make up a document."""
    return entries.select(
        *[c for c in entries.columns if c not in ("title", "description", "common_causes", "category")],
        F.coalesce("category", F.lit("")).alias("category"),
        language(F.col("title")).alias("title"),
        language(F.col("description")).alias("description"),
        causes(F.col("common_causes")).alias("common_causes"),
    ).withColumns(
        {
            "components_text": _listed(F.col("affected_components"), ", "),
            "causes_text": _listed(F.col("common_causes"), "; "),
            "repair_text": repair_text(F.col("repair")),
            "flags_text": flags_text(F.col("flags")),
        }
    )


def text_document() -> Column:
    """The eight-line text of a document."""
    # The line labels, in order.
    lines = {
        "DTC": "code", "Category": "category", "Title": "title", "Description": "description",
        "Affected Components": "components_text", "Common Causes": "causes_text",
        "Repair Information": "repair_text", "Flags": "flags_text",
    }
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.col(c)) for label, c in lines.items()])


def numbered_entries(entries: DataFrame) -> DataFrame:
    """Coded entries with ``doc_id``, the position by file name and place in the file."""
    return with_ordinal(coded_entries(entries), ["source_file", "position"], "doc_id")


def documents(entries: DataFrame) -> DataFrame:
    """One row per document: the fields that search results show, the flags and the full text.

    ``doc_id`` is kept when the entries have one; otherwise it follows file name and position.
    """
    kept = coded_entries(entries) if "doc_id" in entries.columns else numbered_entries(entries)
    empty = F.array().cast("array<string>")
    docs = document_fields(kept).withColumn("text_doc", text_document())
    docs = docs.select(
        "doc_id", "code", "title", "description", F.coalesce("affected_components", empty).alias("affected_components"),
        "common_causes", F.col("repair").alias("repair_information"), "flags", "source_file", "text_doc",
    )
    shown = F.struct(
        "code", "title", "description", "affected_components", "common_causes", "repair_information", "source_file"
    )
    # Two documents that would be shown alike count as the same result.
    return docs.withColumn("content_key", F.md5(F.to_json(shown)))


def code_lookup(docs: DataFrame) -> DataFrame:
    """Upper-case code to document; of several documents with one code the last wins."""
    return docs.groupBy(F.upper("code").alias("lookup_code")).agg(F.max("doc_id").alias("doc_id"))
