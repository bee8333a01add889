"""Analyze a table of incidents: one evidence package per incident."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.functions import validation as V
from telltale.operators import evidence as E
from telltale.operators.deviation import detect_anomalies
from telltale.operators.retrieval import retrieve, searchable_codes
from telltale.operators.similarity import SimilarityIndex, with_similar_cases
from telltale.operators.vectors import PreparedDocs, prepare_docs, usable_vector
from telltale.plans.anomaly_model import AnomalyModel
from telltale.plans.knowledge_base import Encoder
from telltale.schemas import DEFAULT_KB_NAME, MODE, SENSORS, TOP_K_EVIDENCE, TOP_K_SIMILAR
from telltale.session import materialise, scratch_scope, shuffle_partitions

#: Tells the incidents of a batch apart, whatever their ids.
ROW = "_incident_row"


@dataclass
class Resources:
    """Everything that is prepared ahead of incidents."""

    index: SimilarityIndex
    model: AnomalyModel
    docs: DataFrame
    encoder: Encoder
    kb_name: str = DEFAULT_KB_NAME
    lookup: DataFrame | None = None
    _vectors: PreparedDocs | None = field(default=None, repr=False)

    def vectors(self) -> PreparedDocs:
        """The documents' vectors, looked at once and, if they are few, sent to the executors once."""
        if self._vectors is None:
            self._vectors = prepare_docs(self.docs)
        return self._vectors

    def prepare(self) -> Resources:
        """Read what every analysis needs of the static side once: the codes and vectors of the knowledge base, the top of the index, and the trees.

        Call it before a run that opens a scratch scope, since what is stored here must outlive the run.
        """
        if self.lookup is None:
            self.lookup = materialise(searchable_codes(self.docs), "lookup")
        self.vectors()
        self.index.top()
        self.model.forest.arrays()
        return self

    def release(self) -> None:
        """Drop what ``prepare`` sent to the executors; the next analysis sends it again."""
        self.index.release()
        if self._vectors is not None and self._vectors.shared is not None:
            self._vectors.shared.destroy()
        self._vectors = None


def encoded_codes(incidents: DataFrame, resources: Resources) -> DataFrame:
    """The codes of the batch with the encoder's vectors, and ``usable``: whether the vector is one that can be compared with the documents'."""
    encoded = resources.encoder(E.code_queries(incidents))
    return materialise(encoded.withColumn("usable", usable_vector(F.col("embedding"), resources.vectors().width or None)), "encoded")


def find_matches(incidents: DataFrame, resources: Resources, top_k: int = TOP_K_EVIDENCE, encoded: DataFrame | None = None) -> DataFrame:
    """Retrieve once per distinct code, then collect the matches of every distinct code list. A code without a usable vector has only its exact matches."""
    queries = resources.encoder(E.code_queries(incidents)) if encoded is None else encoded.drop("usable")
    results = materialise(retrieve(queries, resources.docs, top_k, resources.lookup, resources.vectors()), "retrieved")
    return E.list_matches(incidents, results, resources.docs)


def _packages(typed: DataFrame, resources: Resources, top_k_similar: int, top_k_rag: int, kb_name: str) -> DataFrame:
    """``typed`` has parsed values and the columns ``similarity_error`` and ``anomaly_error``."""
    encoded = encoded_codes(typed, resources)
    arrays = E.match_arrays(find_matches(typed, resources, top_k_rag, encoded), resources.docs)
    failed = E.failed_lists(typed, encoded.filter(~F.col("usable")))
    matches = materialise(arrays.join(failed, "active_dtcs", "full"), "matches")
    extra = [c for c in typed.columns if c not in ("incident_id", "similarity_error", "anomaly_error", ROW)]
    # The readings go through the trees before the nested cases join them, so few bytes do.
    judged = detect_anomalies(
        typed, resources.model.forest, resources.index.scaler, resources.model.bands, error=F.col("anomaly_error")
    )
    nested = with_similar_cases(judged, resources.index, top_k_similar, wanted=F.col("similarity_error").isNull(), asked=typed)
    popular = None if E.fits_broadcast(matches) else E.popular_lists(typed, shuffle_partitions(typed))
    return E.with_matches(nested, matches, popular).select(
        "incident_id",
        F.struct(*extra).alias("incident"),
        "similarity",
        F.col("anomaly_verdict").alias("anomaly"),
        F.struct("exact_dtc_matches", "semantic_matches").alias("rag"),
        E.service_history().alias("service_history"),
        E.evidence_summary(kb_name).alias("evidence_summary"),
        E.investigation_leads(kb_name).alias("investigation_leads"),
        "similarity_error",
        "retrieval_error",
    )


def run_analysis(raw: DataFrame, resources: Resources, output: str, fmt: str = "parquet", mode: str = "reject") -> None:
    """Analyze and write, and leave no intermediate table behind."""
    from telltale.sources.artefacts import write_packages

    resources.prepare()
    with scratch_scope(raw.sparkSession):
        write_packages(analyze_incidents(raw, resources, mode), output, fmt)


def analyze_incidents(
    raw: DataFrame, resources: Resources, mode: str = "reject",
    top_k_similar: int = TOP_K_SIMILAR, top_k_rag: int = TOP_K_EVIDENCE,
) -> DataFrame:
    """One row per incident with the nested package.

    ``reject``: an incident that breaks the contract, or for one of whose codes the encoder gives no usable vector, gets only an ``error`` envelope. ``degrade``: no incident is turned
    away; a bad value empties just the parts that need it, and a code without a usable vector has no semantic matches. Either way no other incident is affected. Incidents are told apart by row:
    ids that repeat or are missing give a package each.
    """
    if mode not in ("reject", "degrade"):
        raise ValueError("mode must be 'reject' or 'degrade'.")
    if "active_dtcs" not in raw.columns:
        raw = raw.withColumn("active_dtcs", F.array().cast("array<string>"))
        similarity_contract = F.lit(None).cast("string") if mode == "reject" else None
    else:
        similarity_contract = F.lit(None).cast("string") if mode == "reject" else V.similarity_error(raw)
    if similarity_contract is None:
        similarity_contract = V.similarity_error(raw.drop("active_dtcs"))
    checked = raw.withColumns(
        {
            "_error": V.incident_error(raw),
            "similarity_error": similarity_contract,
            "anomaly_error": V.anomaly_error(raw) if mode == "degrade" else F.lit(None).cast("string"),
        }
    )
    # Parsed and checked once and stored, rejected incidents too: the parts below all start from these rows, and filters on parsed values would otherwise
    # repeat the parsing many times over.
    stored = materialise(V.typed_incidents(checked).withColumn(ROW, F.monotonically_increasing_id()), "typed-incidents")
    good = (stored if mode == "degrade" else stored.filter("_error IS NULL")).drop("_error")
    packages = _packages(good, resources, top_k_similar, top_k_rag, resources.kb_name)
    internal = F.lit(None).cast("string") if mode == "degrade" else F.col("retrieval_error")
    packages = packages.withColumn("error", V.error_envelope(F.lit(None).cast("string"), internal))
    if mode == "degrade":
        return packages
    parts = [c for c in packages.columns if c not in ("incident_id", "error")]
    packages = packages.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in parts})
    rejected = stored.filter("_error IS NOT NULL").select(
        "incident_id", V.error_envelope(F.col("_error")).alias("error")
    )
    return packages.unionByName(rejected, allowMissingColumns=True)
