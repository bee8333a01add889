"""Build the knowledge base: entries to documents with vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from telltale.operators.knowledge import documents
from telltale.operators.vectors import fit_encoder
from telltale.session import materialise, spread

Encoder = Callable[[DataFrame], DataFrame]


def default_encoder(docs: DataFrame, dimensions: int = 512) -> Encoder:
    """An encoder fitted on the documents' texts; it adds ``embedding`` to a table with ``query_text``."""
    model = fit_encoder(docs.select(docs["text_doc"].alias("query_text")), "query_text", dimensions)

    def add(queries: DataFrame) -> DataFrame:
        return model.encode(queries)

    add.model = model
    return add


def build_knowledge_base(entries: DataFrame, encoder: Encoder | None = None) -> tuple[DataFrame, Encoder]:
    """Documents with ``embedding``, and the encoder that queries must use."""
    # Fitting the encoder and encoding both read the documents, so they are composed once.
    docs = materialise(documents(spread(entries)), "kb-documents", compression="zstd")
    encoder = encoder or default_encoder(docs)
    encoded = encoder(docs.withColumnRenamed("text_doc", "query_text")).withColumnRenamed("query_text", "text_doc")
    return encoded, encoder
