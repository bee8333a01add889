"""Assemble the findings on an incident: matches, summary sentences, investigation leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telltale.functions.codes import is_queryable, signature
from telltale.operators.deviation import top_feature
from telltale.operators.retrieval import EXACT, SEMANTIC
from telltale.schemas import DEFAULT_KB_NAME, MATCH_FIELDS, MSG_NO_SERVICE_HISTORY, MSG_VECTOR

# Sentences of the summary and of the leads, in order.
FOUND_CASES = "Found {} historically similar operating states."
FOUND_SIGNATURE = "A historical operating state with the same DTC signature was found."
IS_ANOMALOUS = "The current operating condition was classified as anomalous."
TOP_DEVIATION = "{} was among the features with the largest deviation."
KNOWN_CODES = "{} contains knowledge associated with DTC(s): {}."
LEAD_CODES = "Investigate systems/components associated with DTC {} using the retrieved {} evidence."
LEAD_CASES = "Review the operating conditions of the retrieved historical cases to understand typical steady-state behavior for this profile."
LEAD_SENSORS = "Investigate the sensor parameters contributing most strongly to the anomalous operating state, particularly {}."
LEAD_CAUSES = "Review the common causes documented in the retrieved DTC knowledge."

BROADCAST_BYTES = 32 << 20
COPIES = 64


def code_queries(incidents: DataFrame) -> DataFrame:
    """One retrieval query per distinct code of the whole batch, the code being its text: ``(query_id, query_text)``."""
    code = F.explode(F.filter(F.array_distinct("active_dtcs"), is_queryable))
    return incidents.select(code.alias("query_id")).distinct().withColumn("query_text", F.col("query_id"))


def incident_queries(incidents: DataFrame) -> DataFrame:
    """``(incident_id, code_position, query_text)``: the queries of every incident, in list order."""
    exploded = incidents.select("incident_id", F.posexplode("active_dtcs").alias("code_position", "query_text"))
    return exploded.filter(is_queryable(F.col("query_text")))


def list_matches(incidents: DataFrame, results: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct results per distinct code list: ``(active_dtcs, match_type, doc_id, score, code_position, position)``.

    Few code lists occur in many incidents, so the matching is done per list. Results that look alike count once, at
    their first position.
    """
    lists = incidents.select("active_dtcs").distinct()
    codes = lists.select("active_dtcs", F.posexplode("active_dtcs").alias("code_position", "query_id"))
    found = codes.filter(is_queryable(F.col("query_id"))).join(results, "query_id").join(
        docs.select("doc_id", "content_key"), "doc_id"
    )
    first = F.min(F.struct("code_position", "position", "doc_id"))
    return (
        found.groupBy("active_dtcs", "match_type", "content_key", "score")
        .agg(first.alias("f"))
        .select("active_dtcs", "match_type", "score", "f.*")
    )


def match_arrays(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """``(active_dtcs, exact_dtc_matches, semantic_matches)``: the full match structs of every code list, in order."""
    shown = docs.withColumnRenamed("code", "DTC_code").select("doc_id", *[f for f in MATCH_FIELDS if f not in ("match_type", "score")])
    full = matches.join(shown, "doc_id")
    entry = F.struct("code_position", "position", F.struct(*MATCH_FIELDS).alias("match"))

    def ordered(match_type):
        def before(a, b):
            place = (a["code_position"], a["position"]), (b["code_position"], b["position"])
            return F.when(F.struct(*place[0]) < F.struct(*place[1]), -1).when(F.struct(*place[0]) > F.struct(*place[1]), 1).otherwise(0)

        found = F.array_sort(F.collect_list(F.when(F.col("match_type") == match_type, entry)), before)
        return F.transform(found, lambda e: e["match"])

    # At most (codes in the list) x (results per query) entries per list.
    return full.groupBy("active_dtcs").agg(
        ordered(EXACT).alias("exact_dtc_matches"), ordered(SEMANTIC).alias("semantic_matches")
    )


def failed_lists(incidents: DataFrame, failed: DataFrame) -> DataFrame:
    """``(active_dtcs, retrieval_error)``: the distinct code lists that hold one of the ``failed`` codes (``query_id``), named in order."""
    codes = incidents.select("active_dtcs").distinct().select("active_dtcs", F.posexplode("active_dtcs").alias("position", "query_id"))
    hit = codes.join(failed.select("query_id").distinct(), "query_id").groupBy("active_dtcs").agg(F.array_sort(F.collect_list(F.struct("position", "query_id")))["query_id"].alias("codes"))
    return hit.select("active_dtcs", F.format_string(MSG_VECTOR.replace("{}", "%s"), F.array_join(F.array_distinct("codes"), ", ")).alias("retrieval_error"))


def _list_key() -> Column:
    """A searchable code list as text; of the others, which need no match, one key per incident, so that a join deals them to all tasks."""
    own = F.concat(F.lit("#"), F.coalesce(F.col("incident_id").cast("string"), F.lit("")))
    return F.when(F.exists("active_dtcs", is_queryable), F.to_json("active_dtcs")).otherwise(own)


def popular_lists(incidents: DataFrame, tasks: int) -> list[str]:
    """The searchable lists that more than a quarter of a task's fair share of incidents have, perhaps with a few others: at most ``4 tasks`` of them.

    One pass with a bounded number of counters (Karp, Shenker and Papadimitriou, 2003), whatever the number of distinct lists.
    """
    searchable = incidents.filter(F.exists("active_dtcs", is_queryable)).select(F.to_json("active_dtcs").alias("list"))
    found = searchable.stat.freqItems(["list"], max(1e-4, 1 / (4 * max(tasks, 1)))).first()
    return sorted(x for x in (found[0] or []) if x is not None)


def fits_broadcast(arrays: DataFrame) -> bool:
    """Whether matches take at most ``BROADCAST_BYTES`` as text, whatever their stored size."""
    size = arrays.agg(F.sum(F.length(F.to_json(F.struct(*arrays.columns))).cast("long"))).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def with_matches(incidents: DataFrame, arrays: DataFrame, popular: list[str] | None = None) -> DataFrame:
    """Attach the match arrays, and a ``retrieval_error`` if ``arrays`` has one; incidents without matches get empty ones.

    Matches of all lists go to all tasks if they are at most ``BROADCAST_BYTES``: then no incident moves. Else most of a fleet has no code to search for; such incidents don't meet. ``popular`` names lists that many incidents have: their matches go to all tasks, if they are at most
    ``BROADCAST_BYTES``, else to ``COPIES`` groups of incidents each, so that no task gets all incidents of a list.
    """
    known = arrays.withColumn("_list", F.to_json("active_dtcs")).drop("active_dtcs")
    keyed = incidents.withColumn("_list", _list_key())
    if fits_broadcast(known):
        joined = keyed.join(F.broadcast(known), "_list", "left")
    elif popular:
        often = F.coalesce(F.col("_list").isin(popular), F.lit(False))
        few, rest = known.filter(often), keyed.filter(~often)
        if fits_broadcast(few):
            hot = keyed.filter(often).join(F.broadcast(few), "_list", "left")
        else:
            # A number that spreads the incidents of one list evenly, and a copy of the list's matches for each.
            dealt = keyed.filter(often).withColumn("_copy", F.pmod(F.xxhash64("incident_id"), F.lit(COPIES)))
            copies = few.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COPIES - 1).cast("long"))))
            hot = dealt.join(copies, ["_list", "_copy"], "left").drop("_copy")
        joined = rest.join(known.filter(~often), "_list", "left").unionByName(hot)
    else:
        joined = keyed.join(known.hint("merge"), "_list", "left")
    kinds = {c: arrays.schema[c].dataType for c in ("exact_dtc_matches", "semantic_matches")}
    return joined.drop("_list").withColumns({c: F.coalesce(F.col(c), F.array().cast(t)) for c, t in kinds.items()})


def _filled(sentence: str, *values: Column) -> Column:
    """A sentence with its ``{}`` places filled in order."""
    pieces = sentence.split("{}")
    return F.concat(F.lit(pieces[0]), *[x for v, p in zip(values, pieces[1:], strict=True) for x in (v, F.lit(p))])


def _exact_codes() -> Column:
    return F.array_join(F.transform("exact_dtc_matches", lambda m: m["DTC_code"]), ", ")


def same_signature() -> Column:
    """True if one of the similar cases has the incident's own code signature."""
    own = signature(F.col("active_dtcs"))
    return F.exists(F.col("similarity.top_cases"), lambda c: c["dtc_signature"] == own)


def evidence_summary(kb_name: str = DEFAULT_KB_NAME) -> Column:
    """Sentences on what was found. Needs ``similarity``, ``anomaly_verdict``, ``exact_dtc_matches`` and ``active_dtcs``."""
    cases = F.size("similarity.top_cases")
    anomalous = F.col("anomaly_verdict.anomaly")
    feature = top_feature(F.col("anomaly_verdict.feature_contributions"))
    return F.array_compact(
        F.array(
            F.when(cases > 0, _filled(FOUND_CASES, cases.cast("string"))),
            F.when((cases > 0) & same_signature(), F.lit(FOUND_SIGNATURE)),
            F.when(anomalous, F.lit(IS_ANOMALOUS)),
            F.when(anomalous & feature.isNotNull(), _filled(TOP_DEVIATION, feature)),
            F.when(F.size("exact_dtc_matches") > 0, _filled(KNOWN_CODES, F.lit(kb_name), _exact_codes())),
        )
    )


def investigation_leads(kb_name: str = DEFAULT_KB_NAME) -> Column:
    """Sentences on what to look at next."""
    feature = top_feature(F.col("anomaly_verdict.feature_contributions"))
    exact, semantic = F.size("exact_dtc_matches") > 0, F.size("semantic_matches") > 0
    return F.array_compact(
        F.array(
            F.when(exact, _filled(LEAD_CODES, _exact_codes(), F.lit(kb_name))),
            F.when(F.size("similarity.top_cases") > 0, F.lit(LEAD_CASES)),
            F.when(
                F.col("anomaly_verdict.anomaly") & feature.isNotNull(), _filled(LEAD_SENSORS, feature)
            ),
            F.when(exact | semantic, F.lit(LEAD_CAUSES)),
        )
    )


def service_history() -> Column:
    return F.struct(F.lit(False).alias("available"), F.lit(MSG_NO_SERVICE_HISTORY).alias("reason"))


def package_json() -> Column:
    """The package as JSON text, or the error envelope for a rejected incident.

    In JSON an exact match shows ``EXACT_MATCH`` where a semantic one shows its score.
    """

    def shown(m, score):
        rest = [m[f].alias(f) for f in MATCH_FIELDS if f not in ("match_type", "score", "DTC_code")]
        return F.struct(m["DTC_code"].alias("DTC_code"), score.alias("similarity_score"), *rest)

    rag = F.struct(
        F.transform("rag.exact_dtc_matches", lambda m: shown(m, F.lit("EXACT_MATCH"))).alias("exact_dtc_matches"),
        F.transform("rag.semantic_matches", lambda m: shown(m, m["score"])).alias("semantic_matches"),
    )
    package = F.struct(
        "incident", "similarity", "anomaly", rag.alias("rag"), "service_history", "evidence_summary", "investigation_leads"
    )
    options = {"ignoreNullFields": "false"}
    return F.when(F.col("error").isNull(), F.to_json(package, options)).otherwise(F.to_json("error", options))
