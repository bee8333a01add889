"""Operators for building training corpora of text: filters, deduplication, mixing and scoring."""
