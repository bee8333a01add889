"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.llm import decontaminate, exact, language, mixing, neural, passages, pii, ranking, simhash, tokens, toxicity, urls, whitening
from telltale.llm.rows import crc_remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@registered()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from the rows whose remainder is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, where=crc_remainder("doc_id", 4) != 2)
    named = docs.select("doc_id", "text", crc_remainder("doc_id", 4).alias("fold"))
    found = language.identify(named, model, carry=["fold"])
    return found.select("doc_id", (F.col("fold") == 2).alias("held_out"), "lang_pred", "score")


@registered(r"""
    WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
    g AS (SELECT *, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


@registered(r"""
    WITH d AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
            ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
        FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1)::INT % 3] AS weight FROM s),
    r AS (
        SELECT *, sum(2 * source_size) OVER up AS used, sum(weight) OVER up AS gone,
            (SELECT 1.5 * sum(source_size)::DOUBLE FROM s) AS budget, (SELECT sum(weight) FROM w) AS weights
        FROM w WINDOW up AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
    c AS (
        SELECT *, (2 * source_size)::DOUBLE * (weights - (gone - weight))::DOUBLE <= weight * (budget - (used - 2 * source_size))::DOUBLE AS stop FROM r),
    f AS (SELECT coalesce(sum(2 * source_size) FILTER (stop), 0) AS used, coalesce(sum(weight) FILTER (stop), 0) AS gone FROM c),
    t AS (
        SELECT c.source, c.source_size,
            CASE WHEN stop THEN (2 * source_size)::DOUBLE ELSE weight * (budget - f.used)::DOUBLE / (weights - f.gone)::DOUBLE END AS target
        FROM c, f),
    h AS (
        SELECT d.*, t.source_size, t.target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
            sum(size) OVER (PARTITION BY d.source ORDER BY hash) AS upto,
            sum(size) OVER (PARTITION BY d.source, hash) AS own
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
        (size * least(2, whole + CASE WHEN 2 * upto - own < 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM h""")
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@registered()
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@registered()
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, one row per pair."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "edits")


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@registered()
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), RULES)


@registered()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from labelled rows whose remainder is not 0."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), where=crc_remainder("doc_id", 5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@registered()
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and neural log10 probabilities of all documents, learnt from the rows whose remainder is not 2."""
    return neural.score_texts(table(spark, sf_dir, "documents"), held_out=crc_remainder("doc_id", 7) == 2)


@registered()
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), pii.fit())
    counts = ["n_email", "n_ip", "n_card", "n_phone", "n_added"]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@registered()
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy passages that documents share, one row per passage and pair."""
    return passages.passages(table(spark, sf_dir, "documents")).drop("passage")


@registered(r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms FROM documents),
    q AS (
        SELECT row_number() OVER () AS query, item_id,
            regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms FROM benchmark),
    t AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
    p AS (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d),
    f AS (SELECT doc_id, term, n, count(*) AS tf FROM p GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, t GROUP BY term, n_docs),
    u AS (SELECT DISTINCT query, item_id, term FROM (SELECT query, item_id, unnest(terms) AS term FROM q)),
    s AS (
        SELECT query, item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
        FROM u JOIN f USING (term) JOIN w USING (term), t GROUP BY query, item_id, doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""")
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@registered()
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@registered()
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokens.prove(public_tokenizers.path("piece_bpe_32k.model")))
