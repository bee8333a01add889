"""URL filters: explicit rules, then association rules mined with FP-growth. DataFrame operations only."""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telltale.session import materialise, shuffle_partitions

Rule = tuple[str, str, str]  # verdict, host, path
LABEL = "verdict="


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both are empty for null and for text without ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """``(rule, verdict)`` of the longest rule whose host is the url's or a parent of it and whose path begins the url's; else nulls."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column, host: Column, path: Column, rules: list[Rule]) -> Column:
    """Distinct tokens of a url: scheme, words of the host, path segments, parameter names, fragment; runs of digits count as ``#``.

    Words and segments that the rules themselves name are left out: the labels come from the rules, so those tokens could
    only repeat the rule list.
    """
    tail = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    known = sorted({w for _, h, _ in rules for w in h.split(".")}), sorted({s for _, _, p in rules for s in p.split("/")})
    digits = lambda c: F.regexp_replace(c, "[0-9]+", "#")
    tagged = lambda values, tag: F.transform(values, lambda w: F.concat(F.lit(tag), w))
    words = F.array_except(F.split(digits(host), r"[.-]"), F.array(*[F.lit(w) for w in ["", *known[0]]]))
    segments = F.array_except(F.split(digits(path), "/"), F.array(*[F.lit(s) for s in ["", *known[1]]]))
    names = F.array_remove(F.transform(F.split(digits(tail), "&"), lambda w: F.substring_index(w, "=", 1)), "")
    scheme = F.array(F.lower(F.substring_index(F.coalesce(url, F.lit("")), "://", 1)))
    scheme = F.when(F.instr(url, "://") > 0, scheme).otherwise(F.array().cast("array<string>"))
    mark = F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    every = F.concat(tagged(scheme, "scheme="), tagged(words, "host="), tagged(segments, "path="), tagged(names, "query="), mark)
    return F.array_sort(F.array_distinct(F.coalesce(every, F.array().cast("array<string>"))))


def alike(sets: DataFrame, least: Column) -> DataFrame:
    """``item, members, n``: tokens that occur in exactly the same of the ``sets`` (``tokens, n``) make one item, named by the first; ``n`` rows hold them.

    Their support and confidence are equal in every rule, so mining them one by one would only repeat each rule for every subset of them. Only
    tokens of ``least`` rows or more are kept. Two tokens are alike if their numbers of rows and sets and three sums of hashes of their sets agree.
    """
    key = F.array_join("tokens", "\n")
    placed = sets.select(F.explode("tokens").alias("token"), "n", *[F.xxhash64(key, F.lit(i)).alias(f"h{i}") for i in range(3)])
    held = placed.groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sets"), *[F.bit_xor(f"h{i}").alias(f"h{i}") for i in range(3)])
    grouped = held.where(F.col("n") >= least).groupBy("n", "sets", "h0", "h1", "h2").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return grouped.select(F.element_at("members", 1).alias("item"), "members", "n")


def mine(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Rules ``(id, items, alike, rarest, verdict, confidence, support)`` from ``(tokens, verdict)``.

    An item stands for the tokens that occur in exactly the same labelled urls; ``alike`` has those of each item, and ``rarest`` those of the item that the fewest urls have. Kept are rules with one verdict as their result whose confidence is at least ``min_confidence`` and better than chance, and of
    those the ones that no shorter rule with the same verdict and at least the same confidence makes needless.
    """
    rows = labelled.groupBy("tokens", "verdict").agg(F.count(F.lit(1)).alias("n"))
    sets = materialise(rows, "token-sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    items = materialise(alike(sets.groupBy("tokens").agg(F.sum("n").alias("n")), F.lit(min_support * total - 1e-9)), "items")
    named = items.select("item", F.explode("members").alias("token"))
    key = F.array_join("tokens", "\n")
    held = sets.select(key.alias("key"), F.explode("tokens").alias("token")).distinct().join(named, "token").groupBy("key").agg(F.collect_set("item").alias("found"))
    merged = sets.select(key.alias("key"), "verdict", "n").join(held, "key", "left")
    label = F.array(F.concat(F.lit(LABEL), "verdict"))
    one = F.concat(F.coalesce("found", F.array().cast("array<string>")), label)
    # Each row counts, so a set is repeated as often as it occurs; the copies are dealt out evenly.
    baskets = merged.select(one.alias("items"), F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("items").repartition(shuffle_partitions(labelled))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith(LABEL) & (F.col("lift") > 1))
    found = materialise(
        rules.select(
            F.array_sort("antecedent").alias("items"), F.substring(F.element_at("consequent", 1), len(LABEL) + 1, 100).alias("verdict"), "confidence", "support"
        ),
        "rules",
    )
    # Every shorter rule lacks some item of the longer one: look its items up, less one at a time.
    parts = found.where(F.size("items") > 1).select("items", "verdict", "confidence", F.explode("items").alias("less"))
    parts = parts.select("items", "verdict", "confidence", F.array_remove("items", F.col("less")).alias("part"))
    shorter = found.select(F.col("items").alias("part"), "verdict", F.col("confidence").alias("known"))
    needless = parts.join(shorter, ["part", "verdict"]).where("known >= confidence").select("items", "verdict")
    kept = found.join(needless, ["items", "verdict"], "left_anti")
    # At most the tokens of one url in a rule.
    spread = kept.select("*", F.explode("items").alias("item")).join(items, "item").groupBy("items", "verdict", "confidence", "support")
    full = spread.agg(F.array_sort(F.collect_list(F.struct("item", "members"))).alias("own"), F.min(F.struct("n", "members")).alias("few"))
    return full.select(F.array_join("items", "\n").alias("id"), "items", F.col("own.members").alias("alike"), F.col("few.members").alias("rarest"), "verdict", "confidence", "support")


def judge(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``(key, mined)`` for the token sets ``(key, tokens)`` that some rule fits.

    In the inverted index a rule is listed under its rarest item alone, so that tokens which nearly every url has draw no rules. A rule fits if the set has a token of each of its items.
    The highest confidence wins, then support, then ``block``.
    """
    postings = rules.select("alike", "verdict", "confidence", "support", F.explode("rarest").alias("token"))
    met = sets.select("key", "tokens", F.explode("tokens").alias("token")).join(postings, "token")
    fits = met.where(F.forall("alike", lambda own: F.arrays_overlap(own, "tokens")))
    best = fits.groupBy("key").agg(F.max(F.struct(F.col("confidence").alias("c"), F.col("support").alias("s"), "verdict")).alias("best"))
    return best.select("key", F.col("best.verdict").alias("mined"))


def filter_urls(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url",
    min_support: float = 0.001, min_confidence: float = 0.8, otherwise: str = "allow",
) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict``.

    Urls that an explicit rule fits get its verdict and are the labelled rows for mining; the others get the verdict of the best
    mined rule, or ``otherwise`` if none fits (so for null and for text that is no url). Urls with equal tokens are judged
    once. An item set must be in ``min_support`` of the labelled urls, so there are at most (tokens of a url) / ``min_support`` frequent
    tokens; those that always occur together are one item. Without labelled urls nothing is mined; an empty table gives an empty result.
    """
    url = F.col("url")
    host, path = url_parts(url)
    parsed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumn("host", host).withColumn("path", path)
    parsed = parsed.withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
    parsed = parsed.withColumn("tokens", url_tokens(url, F.col("host"), F.col("path"), rules))
    parsed = parsed.withColumn("key", F.when(F.col("hit").isNull(), F.array_join("tokens", "\n")))
    stored = materialise(parsed.select("page_id", "host", "path", "hit", "tokens", "key"), "urls")
    labelled = stored.where("hit IS NOT NULL").select("tokens", F.col("hit.verdict").alias("verdict"))
    known = ["page_id", "host", "path", F.col("hit.rule").alias("rule")]
    if not labelled.limit(1).count():
        return stored.select(*known, F.lit(otherwise).alias("verdict"))
    mined = materialise(mine(labelled, min_support, min_confidence), "mined")
    sets = stored.where("key IS NOT NULL").select("key", "tokens").distinct()
    verdicts = materialise(judge(sets, mined), "verdicts")
    open_rows = stored.where("key IS NOT NULL").join(verdicts, "key", "left").select(*known, F.coalesce("mined", F.lit(otherwise)).alias("verdict"))
    return stored.where("key IS NULL").select(*known, F.col("hit.verdict").alias("verdict")).union(open_rows)
