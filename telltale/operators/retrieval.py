"""Hybrid retrieval: exact code matches first, then nearest documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telltale.functions.codes import extract_codes
from telltale.functions.validation import query_text_error
from telltale.operators.knowledge import code_lookup
from telltale.operators.vectors import PreparedDocs, nearest
from telltale.schemas import CODE_PATTERN, TOP_K_RETRIEVAL
from telltale.session import materialise

EXACT, SEMANTIC = "EXACT", "SEMANTIC"


def searchable_codes(docs: DataFrame) -> DataFrame:
    """``(lookup_code, doc_id)`` of the codes that a text can name: at most 16,000 rows."""
    return code_lookup(docs).filter(F.col("lookup_code").rlike(f"^{CODE_PATTERN}$"))


def exact_matches(queries: DataFrame, docs: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """``(query_id, lookup_code, doc_id, position)``: documents of the codes named in a query, in order of appearance.

    ``lookup`` is ``searchable_codes(docs)``, if it is at hand.
    """
    named = queries.select("query_id", F.posexplode(extract_codes(F.col("query_text"))).alias("position", "lookup_code"))
    return named.join(F.broadcast(searchable_codes(docs) if lookup is None else lookup), "lookup_code")


def similarity_of_distance(squared_distance):
    return F.round(F.lit(1.0) / (F.lit(1.0) + squared_distance), 4)


def retrieve(queries: DataFrame, docs: DataFrame, top_k: int = TOP_K_RETRIEVAL, lookup: DataFrame | None = None, vectors: PreparedDocs | None = None) -> DataFrame:
    """Up to ``top_k`` documents per query: ``(query_id, position, match_type, doc_id, score)``, position from 1.

    ``queries`` has ``query_id, query_text, embedding``; ``docs`` has ``doc_id, code, embedding``. Blank queries give no
    rows (``query_text_error`` names them). The pool of neighbours is ``top_k`` plus the number of exact matches; of
    those, documents whose code is already in the result are dropped, so a result may be shorter than ``top_k``.
    The texts of the documents are not moved: join them on ``doc_id``. ``lookup`` and ``vectors`` are ``searchable_codes`` and ``prepare_docs`` of the documents, if they are at hand.
    """
    if top_k < 1:
        raise ValueError("top_k must be positive.")
    queries = queries.filter(query_text_error(F.col("query_text")).isNull())
    # Stored, since it is used three times and the query texts need be searched only once.
    exact = materialise(exact_matches(queries, docs, lookup), "exact-matches")
    # A query names few codes, so a list per query is small.
    named = exact.groupBy("query_id").agg(F.collect_set("lookup_code").alias("_named"))
    asked = queries.select("query_id", "embedding").join(named, "query_id", "left")
    asked = asked.withColumn("k", F.lit(top_k) + F.when(F.col("_named").isNull(), 0).otherwise(F.size("_named")))
    near = nearest(asked, docs if vectors is None else vectors)
    codes = docs.select("doc_id", F.upper("code").alias("_code"))
    first_of_code = W.partitionBy("query_id", "_code").orderBy("neighbour_rank")
    semantic = (
        near.join(codes, "doc_id")
        .join(named, "query_id", "left")
        .filter(~F.coalesce(F.array_contains("_named", F.col("_code")), F.lit(False)))
        .withColumn("_n", F.row_number().over(first_of_code))
        .filter("_n = 1")
        .select(
            "query_id", F.lit(SEMANTIC).alias("match_type"), "doc_id",
            similarity_of_distance(F.col("squared_distance")).alias("score"), F.col("neighbour_rank").alias("_order"),
        )
    )
    merged = exact.select(
        "query_id", F.lit(EXACT).alias("match_type"), "doc_id", F.lit(None).cast("double").alias("score"),
        F.col("position").alias("_order"),
    ).unionByName(semantic)
    place = W.partitionBy("query_id").orderBy("match_type", "_order")
    return (
        merged.withColumn("position", F.row_number().over(place))
        .filter(F.col("position") <= top_k)
        .select("query_id", "position", "match_type", "doc_id", "score")
    )
