"""The registered queries: each takes ``(spark, sf_dir)`` and reads the whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telltale import fixtures as X
from telltale import schemas as S
from telltale.functions import codes as C
from telltale.functions import validation as V
from telltale.functions.numbers import is_finite
from telltale.operators import dedup as DUP
from telltale.operators import deviation as DEV
from telltale.operators import evidence as EV
from telltale.operators import forest as FOR
from telltale.operators import knowledge as KB
from telltale.operators import quality as QUAL
from telltale.operators import retrieval as RET
from telltale.operators import scaling as SCALE
from telltale.operators import similarity as SIM
from telltale.operators import vectors as VEC
from telltale.operators.code_sets import code_similarities
from telltale.operators.scaling import Scaler, scaler_values
from telltale.plans.analyze import Resources, analyze_incidents, find_matches
from telltale.plans.anomaly_model import AnomalyModel, fit_anomaly_model
from telltale.plans.knowledge_base import build_knowledge_base
from telltale.plans.preprocess import Preprocessed, clean_history, preprocess, scaler_table, with_codes
from telltale.schemas import CODES, MODE, SENSORS
from telltale.session import materialise, release, scratch_dir
from telltale.sources import artefacts as ART
from telltale.sources.telemetry import read_history, write_history
from telltale.streaming.incidents import analyze_stream, read_incident_stream
from telltale.workload import sql as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(oracle: str | None = None, name: str | None = None):
    def add(fn):
        QUERIES[name or fn.__name__] = fn
        if oracle is not None:
            ORACLES[name or fn.__name__] = oracle
        return fn

    return add


def _r(column: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


def prepared(spark: SparkSession, sf_dir: str) -> Preprocessed:
    """The preprocessing job's tables, computed once per session and folder."""

    def build():
        p = preprocess(X.train(spark, sf_dir), X.test(spark, sf_dir))
        p.train = materialise(p.train, "train-clean")
        return p

    return X.once(spark, sf_dir, "prepared", build)


def scaler(spark: SparkSession, sf_dir: str) -> Scaler:
    return X.once(spark, sf_dir, "scaler", lambda: scaler_values(prepared(spark, sf_dir).scaler))


def index(spark: SparkSession, sf_dir: str) -> SIM.SimilarityIndex:
    return X.once(
        spark, sf_dir, "index", lambda: SIM.build_index(prepared(spark, sf_dir).train, scaler(spark, sf_dir))
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test observation as an incident."""
    return with_codes(X.test(spark, sf_dir)).withColumnRenamed("row_id", "incident_id").drop("dtc_signature")


CONTENT = [*SENSORS, MODE, *CODES]


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


def _joined(column: str, name: str | None = None):
    return F.array_join(column, ",").alias(name or column)


# --- Sources and data quality ------------------------------------------------------------------------------------------


@registered(Q.query(f"SELECT row_id, CAST(is_test AS BIGINT) AS is_test, {', '.join(SENSORS)}, CAST(Mode AS BIGINT) AS Mode, "
                    + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in CODES) + " FROM telemetry", "telemetry"))
def read_telemetry(spark, sf_dir):
    return X.telemetry(spark, sf_dir).select("row_id", *_long("is_test"), *SENSORS, *_long(MODE, *CODES))


_LIST_TEXT = """CASE WHEN row_id % 13 = 7 THEN '[broken' WHEN row_id % 13 = 8 THEN NULL
  ELSE concat('[', {joined}, ']') END"""


@registered(Q.query(
    f"""SELECT row_id, CASE WHEN ok THEN array_to_string(codes, ',') ELSE '' END AS codes, CAST(CASE WHEN ok THEN len(codes) ELSE 0 END AS BIGINT) AS n
        FROM (SELECT row_id, row_id % 13 NOT IN (7, 8) AS ok, {Q.active_codes()} AS codes FROM telemetry) t""", "telemetry"))
def parse_code_list(spark, sf_dir):
    quoted = F.transform(C.active_codes(CODES), lambda c: F.concat(F.lit("'"), c, F.lit("'")))
    listed = X.telemetry(spark, sf_dir).withColumn("joined", F.array_join(quoted, ", "))
    text = listed.select("row_id", F.expr(_LIST_TEXT.format(joined="joined")).alias("written"))
    parsed = text.select("row_id", C.parse_code_list(F.col("written")).alias("codes"))
    return parsed.select("row_id", _joined("codes"), F.size("codes").cast("long").alias("n"))


def _cell_count_sql(test_sql: str, name: str) -> str:
    cells = " + ".join(f"CASE WHEN {test_sql.format(v=f'({Q.parsed(s)})')} THEN 1 ELSE 0 END" for s in SENSORS)
    return Q.query(f"SELECT CAST(sum({cells}) AS BIGINT) AS {name} FROM raw_incidents", "raw_incidents")


@registered(_cell_count_sql("{v} IS NULL OR isnan({v})", "missing_values"))
def quality_missing(spark, sf_dir):
    return QUAL.sensor_cell_counts(QUAL.coerce_numeric(X.raw_incidents(spark, sf_dir))).select("missing_values")


@registered(_cell_count_sql("isinf({v})", "infinite_values"))
def quality_infinite(spark, sf_dir):
    return QUAL.sensor_cell_counts(QUAL.coerce_numeric(X.raw_incidents(spark, sf_dir))).select("infinite_values")


@registered(Q.query(" UNION ALL ".join(
    f"SELECT '{s}' AS feature, CAST(count(CASE WHEN {s} IS NOT NULL AND ({Q.parsed(s)}) IS NULL THEN 1 END) AS BIGINT) AS bad_cells, "
    f"CAST(count({Q.parsed(s)}) AS BIGINT) AS numeric_cells FROM raw_incidents" for s in SENSORS), "raw_incidents"))
def coerce_numeric(spark, sf_dir):
    raw = X.raw_incidents(spark, sf_dir)
    kept = QUAL.coerce_numeric(raw).agg(*[F.count(s).alias(s) for s in SENSORS])
    rows = F.array(*[F.struct(F.lit(s).alias("feature"), F.col(s).alias("numeric_cells")) for s in SENSORS])
    return QUAL.non_numeric_report(raw).join(kept.select(F.inline(rows)), "feature")


def _cells(test_sql: str, t: str) -> str:
    return "SELECT CAST(sum(" + " + ".join(f"CASE WHEN {test_sql.format(v=s)} THEN 1 ELSE 0 END" for s in SENSORS) + f") AS BIGINT) FROM {t}"


_BAD, _INF = "{v} IS NULL OR isnan({v})", "isinf({v})"


@registered(Q.query(
    f"""SELECT 'train_rows' AS metric, count(*) AS value FROM dirty_train UNION ALL SELECT 'train_clean_rows', count(*) FROM dirty_kept
        UNION ALL SELECT 'train_duplicates', (SELECT count(*) FROM dirty_train) - (SELECT count(*) FROM dirty_kept)
        UNION ALL SELECT 'test_rows', count(*) FROM dirty_test
        UNION ALL SELECT 'test_duplicates', count(*) - (SELECT count(*) FROM (SELECT DISTINCT {Q.DIRTY_CONTENT} FROM dirty_test) d) FROM dirty_test
        UNION ALL SELECT 'train_test_overlap', count(*) FROM (SELECT {Q.DIRTY_CONTENT} FROM dirty_train INTERSECT SELECT {Q.DIRTY_CONTENT} FROM dirty_test) x
        UNION ALL SELECT 'train_missing', ({_cells(_BAD, "dirty_train")}) UNION ALL SELECT 'train_infinite', ({_cells(_INF, "dirty_train")})
        UNION ALL SELECT 'test_missing', ({_cells(_BAD, "dirty_test")}) UNION ALL SELECT 'test_infinite', ({_cells(_INF, "dirty_test")})
        UNION ALL SELECT 'only_no_fault', count(*) FROM dirty_history WHERE dtc_signature = 'P0000'
        UNION ALL SELECT 'no_fault_mixed', count(*) FROM dirty_history WHERE P0000 = 1 AND len(active_dtcs) > 1
        UNION ALL SELECT 'no_codes', count(*) FROM dirty_history WHERE dtc_signature = 'NONE'
        UNION ALL SELECT 'modes', count(DISTINCT Mode) FROM dirty_train""", "dirty_train", "dirty_test", "dirty_kept", "dirty_history"))
def quality_report(spark, sf_dir):
    """Tables with one more column, missing and infinite cells in several sensors, and an indicator that only train has."""
    return QUAL.quality_report(X.dirty_train(spark, sf_dir), X.dirty_test(spark, sf_dir))


# --- Validation --------------------------------------------------------------------------------------------------------

_PARSED_OUT = ", ".join(f"round({Q.parsed(s)}, 6) AS {s}" for s in SENSORS)


@registered(Q.query(f"""SELECT incident_id, {Q.INCIDENT_ERROR} AS error, {_PARSED_OUT}, CAST({Q.PARSED_MODE} AS VARCHAR) AS Mode,
    CASE WHEN active_dtcs IS NULL THEN '' ELSE array_to_string(active_dtcs, ',') END AS active_dtcs FROM raw_incidents""", "raw_incidents"))
def validate_incidents(spark, sf_dir):
    raw = X.raw_incidents(spark, sf_dir)
    typed = V.typed_incidents(raw.withColumn("error", V.incident_error(raw)))
    return typed.select("incident_id", "error", *[_r(s) for s in SENSORS], F.col(MODE).cast("string").alias(MODE), _joined("active_dtcs"))


@registered(Q.query(f"SELECT incident_id, {Q.SIMILARITY_ERROR} AS error FROM raw_incidents", "raw_incidents"))
def validate_similarity_input(spark, sf_dir):
    raw = X.raw_incidents(spark, sf_dir)
    return raw.select("incident_id", V.similarity_error(raw).alias("error"))


@registered(Q.query(f"SELECT incident_id, {Q.ANOMALY_ERROR} AS error FROM raw_incidents", "raw_incidents"))
def validate_anomaly_input(spark, sf_dir):
    raw = X.raw_incidents(spark, sf_dir)
    return raw.select("incident_id", V.anomaly_error(raw).alias("error"))


@registered(Q.query(
    f"""SELECT e.incident_id, CASE WHEN m IS NOT NULL THEN '{S.ERR_VALIDATION}' WHEN f.codes IS NOT NULL THEN '{S.ERR_INTERNAL}' END AS error,
          coalesce(m, 'No usable vector for DTC(s): ' || f.codes || '.') AS message
        FROM (SELECT incident_id, {Q.INCIDENT_ERROR} AS m FROM raw_incidents) e
        LEFT JOIN (SELECT incident_id, string_agg(code, ', ' ORDER BY first) AS codes FROM (SELECT incident_id, code, min(pos) AS first FROM raw_incident_codes WHERE code LIKE '%3' GROUP BY incident_id, code) g
          GROUP BY incident_id) f ON f.incident_id = e.incident_id""", "raw_incidents", "raw_incident_codes"))
def error_envelope(spark, sf_dir):
    """Both kinds of error: broken contracts, and an encoder that fails for some codes, which must not touch other incidents."""
    r = resources(spark, sf_dir)

    def failing(asked: DataFrame) -> DataFrame:
        vector = F.array(F.lit(float("nan"))).cast("array<float>")
        return r.encoder(asked).withColumn("embedding", F.when(F.col("query_text").endswith("3"), vector).otherwise(F.col("embedding")))

    out = analyze_incidents(X.raw_incidents(spark, sf_dir), replace(r, encoder=failing))
    return out.select("incident_id", "error.error", "error.message")


_QUERY_TEXT = "CASE WHEN doc_id % 7 = 3 THEN concat(' ', chr(9), chr(10)) WHEN doc_id % 7 = 5 THEN '   ' WHEN doc_id % 11 = 5 THEN NULL ELSE text END"


@registered(rf"""SELECT doc_id, CASE WHEN q IS NULL OR regexp_full_match(q, '\s*') THEN 'Query cannot be empty.' END AS error
                FROM (SELECT doc_id, {_QUERY_TEXT} AS q FROM documents) d""")
def validate_query_text(spark, sf_dir):
    texts = X.table(spark, sf_dir, "documents").select("doc_id", F.expr(_QUERY_TEXT).alias("q"))
    return texts.select("doc_id", V.query_text_error(F.col("q")).alias("error"))


# --- Distinct rows, positions, codes -----------------------------------------------------------------------------------


@registered(Q.query(f"SELECT row_id, {', '.join(SENSORS)}, CAST(Mode AS BIGINT) AS Mode FROM kept", "kept"))
def dedupe_keep_first(spark, sf_dir):
    return DUP.dedupe_keep_first(X.train(spark, sf_dir)).select("row_id", *SENSORS, *_long(MODE))


@registered(Q.query(" UNION ALL ".join(
    f"SELECT '{t}' AS dataset, count(*) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT {Q.CONTENT} FROM {t}) d) AS distinct_count, "
    f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {Q.CONTENT} FROM {t}) d) AS duplicate_count FROM {t}" for t in ("train", "test")),
    "train", "test"))
def duplicate_counts(spark, sf_dir):
    parts = {"train": X.train(spark, sf_dir), "test": X.test(spark, sf_dir)}
    counts = [DUP.duplicate_counts(df, CONTENT).withColumn("dataset", F.lit(n)) for n, df in parts.items()]
    return counts[0].unionByName(counts[1])


@registered(Q.query(f"SELECT count(*) AS overlap_count FROM (SELECT {Q.CONTENT} FROM kept INTERSECT SELECT {Q.CONTENT} FROM test) x", "kept", "test"))
def train_test_overlap(spark, sf_dir):
    return DUP.overlap_count(X.train(spark, sf_dir), X.test(spark, sf_dir), CONTENT)


@registered(Q.query("SELECT historical_index, row_id FROM history", "history"))
def historical_index(spark, sf_dir):
    return clean_history(X.train(spark, sf_dir)).select("historical_index", "row_id")


@registered(Q.query(f"SELECT row_id, array_to_string({Q.active_codes()}, ',') AS active_dtcs FROM telemetry", "telemetry"))
def active_codes(spark, sf_dir):
    return X.telemetry(spark, sf_dir).select("row_id", F.array_join(C.active_codes(CODES), ",").alias("active_dtcs"))


@registered(Q.query(f"SELECT row_id, {Q.signature('a')} AS dtc_signature FROM (SELECT row_id, {Q.active_codes()} AS a FROM telemetry) t", "telemetry"))
def code_signature(spark, sf_dir):
    return X.telemetry(spark, sf_dir).select("row_id", C.signature(C.active_codes(CODES)).alias("dtc_signature"))


@registered(Q.query(
    f"""SELECT count(*) FILTER (WHERE sig = 'P0000') AS only_no_fault, count(*) FILTER (WHERE P0000 = 1 AND len(a) > 1) AS mixed,
        count(*) FILTER (WHERE sig = 'NONE') AS no_codes FROM (SELECT *, {Q.signature('a')} AS sig FROM (SELECT *, {Q.active_codes()} AS a FROM train) x) t""",
    "train"))
def p0000_profile(spark, sf_dir):
    return QUAL.no_fault_profile(X.train(spark, sf_dir))


@registered(Q.query("SELECT CAST(Mode AS BIGINT) AS Mode, min(row_id) AS first_row FROM train GROUP BY Mode", "train"))
def mode_values(spark, sf_dir):
    return QUAL.mode_values(X.train(spark, sf_dir)).select(*_long(MODE), "first_row").orderBy("first_row")


@registered(Q.query(
    """SELECT incident_id, CASE WHEN active_dtcs IS NULL OR len(active_dtcs) = 0 THEN 'NONE' ELSE array_to_string(list_sort(active_dtcs), '|') END AS query_signature
       FROM raw_incidents""", "raw_incidents"))
def query_signature(spark, sf_dir):
    return X.raw_incidents(spark, sf_dir).select("incident_id", C.signature(F.col("active_dtcs")).alias("query_signature"))


_CODED_TEXT = "concat(text, ' ', code, ', then p0403 and XP04031 but not P2A00 nor P9999; again ', code)"


@registered(Q.query(
    rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(upper({_CODED_TEXT}), '[PBUC][0-3][0-9]{{3}}'))), ',') AS codes FROM kb""", "kb"))
def extract_codes(spark, sf_dir):
    texts = X.knowledge(spark, sf_dir).select("doc_id", F.expr(_CODED_TEXT).alias("q"))
    return texts.select("doc_id", F.array_join(F.array_sort(C.extract_codes(F.col("q"))), ",").alias("codes"))


# --- Scaling -----------------------------------------------------------------------------------------------------------


@registered(Q.query(" UNION ALL ".join(
    f"SELECT '{s}' AS feature, round(m_{s}, 6) AS mean, round(s_{s}, 6) AS scale FROM scaler" for s in SENSORS), "scaler"))
def scaler_fit(spark, sf_dir):
    return SCALE.fit_scaler(DUP.dedupe_keep_first(X.train(spark, sf_dir))).select("feature", _r("mean"), _r("scale"))


@registered(Q.query("SELECT incident_id AS row_id, " + ", ".join(f"round(z_{s}, 6) AS z_{s}" for s in SENSORS) + " FROM zincidents", "zincidents"))
def scaler_transform(spark, sf_dir):
    scaled = SCALE.scale(X.test(spark, sf_dir), scaler(spark, sf_dir))
    return scaled.select("row_id", *[_r("z_" + s) for s in SENSORS])


@registered(Q.query("SELECT historical_index, " + ", ".join(f"abs(round(z_{s} * s_{s} + m_{s}, 9)) AS {s}" for s in SENSORS) + " FROM zhistory, scaler", "zhistory", "scaler"))
def scaler_inverse(spark, sf_dir):
    clean = prepared(spark, sf_dir).train.select("historical_index", *["z_" + s for s in SENSORS])
    return SCALE.unscale(clean, scaler(spark, sf_dir)).select("historical_index", *[F.abs(_r(s, 9)).alias(s) for s in SENSORS])


_CLEAN_COLUMNS = ", ".join(f"round({s}, 9) AS {s}, round(z_{s}, 6) AS z_{s}" for s in SENSORS)


@registered(Q.query(
    f"SELECT historical_index, row_id, CAST(Mode AS BIGINT) AS Mode, array_to_string(active_dtcs, ',') AS active_dtcs, dtc_signature, {_CLEAN_COLUMNS} FROM zhistory", "zhistory"))
def preprocess_train(spark, sf_dir):
    clean = preprocess(X.train(spark, sf_dir), X.test(spark, sf_dir)).train
    values = [c for s in SENSORS for c in (_r(s, 9), _r("z_" + s))]
    return clean.select("historical_index", "row_id", *_long(MODE), _joined("active_dtcs"), "dtc_signature", *values)


@registered(Q.query(
    "SELECT incident_id AS row_id, CAST(Mode AS BIGINT) AS Mode, array_to_string(active_dtcs, ',') AS active_dtcs, query_signature AS dtc_signature, "
    + ", ".join(f"round({s}, 9) AS {s}, round(z_{s}, 6) AS z_{s}" for s in SENSORS) + " FROM zincidents", "zincidents"))
def preprocess_test(spark, sf_dir):
    values = [c for s in SENSORS for c in (_r(s, 9), _r("z_" + s))]
    return prepared(spark, sf_dir).test.select("row_id", *_long(MODE), _joined("active_dtcs"), "dtc_signature", *values)


_DIRTY_Z = ", ".join(f"CASE WHEN isfinite({s}) THEN round(({s} - m_{s}) / s_{s}, 6) END AS z_{s}" for s in SENSORS)


@registered(Q.query(
    f"SELECT historical_index, row_id, vehicle, CAST(Mode AS BIGINT) AS Mode, array_to_string(active_dtcs, ',') AS active_dtcs, dtc_signature, {_DIRTY_Z} FROM dirty_history, dirty_scaler",
    "dirty_history", "dirty_scaler"))
def preprocess_exported(spark, sf_dir):
    """The job on tables as exports deliver them; scaled cells are shown where the reading is finite."""
    clean = preprocess(X.dirty_train(spark, sf_dir), X.dirty_test(spark, sf_dir)).train
    z = [F.when(is_finite(F.col(s)), F.round("z_" + s, 6)).alias("z_" + s) for s in SENSORS]
    return clean.select("historical_index", "row_id", "vehicle", *_long(MODE), _joined("active_dtcs"), "dtc_signature", *z)


# --- Saved tables, read back ---------------------------------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/telltale/{name}-{uuid.uuid4().hex}"


@registered(ORACLES["preprocess_train"])
def history_roundtrip(spark, sf_dir):
    path = _folder(spark, "history")
    write_history(prepared(spark, sf_dir).train, path)
    values = [c for s in SENSORS for c in (_r(s, 9), _r("z_" + s))]
    return read_history(spark, path).select("historical_index", "row_id", *_long(MODE), _joined("active_dtcs"), "dtc_signature", *values)


@registered(ORACLES["scaler_fit"])
def scaler_roundtrip(spark, sf_dir):
    path = _folder(spark, "scaler")
    ART.save_scaler(spark, scaler(spark, sf_dir), path)
    return scaler_table(spark, ART.load_scaler(spark, path)).select("feature", _r("mean"), _r("scale"))


# --- Similarity --------------------------------------------------------------------------------------------------------


def _component_oracle(score: str, weights: dict, k: int) -> str:
    Q.define(f"top_{score}", Q.top_pairs(k, weights), ["probes", "code_pairs", "zhistory"])
    return Q.query(
        f"""SELECT o.incident_id, CAST(t.rank AS BIGINT) AS rank, t.historical_index, round(t.{score}, 6) AS {score}
            FROM probe_of o JOIN top_{score} t ON t.probe = o.probe""", "probe_of", f"top_{score}")


def _component(spark, sf_dir, score, weights, k):
    best = SIM.similar_topk(incidents(spark, sf_dir), index(spark, sf_dir), k, weights)
    return best.select("incident_id", *_long("rank"), "historical_index", _r(score))


_SENSOR_ONLY = {"sensor": 1.0, "dtc": 0.0, "mode": 0.0}
_CODES_ONLY = {"sensor": 0.0, "dtc": 1.0, "mode": 0.0}
_MODE_ONLY = {"sensor": 0.0, "dtc": 0.0, "mode": 1.0}
_OWN_WEIGHTS = {"sensor": 0.25, "dtc": 0.5, "mode": 0.125}


@registered(_component_oracle("sensor_similarity", _SENSOR_ONLY, 2))
def sensor_similarity(spark, sf_dir):
    return _component(spark, sf_dir, "sensor_similarity", _SENSOR_ONLY, 2)


_CODE_LISTS = "array_to_string(list_sort(list_distinct(active_dtcs)), ',')"


@registered(Q.query(
    f"""SELECT CAST(NULL AS BIGINT) AS incident_id, CAST(NULL AS BIGINT) AS historical_index, q AS incident_codes, h AS history_codes, round(jaccard, 9) AS similarity FROM (
         SELECT array_to_string(q.codes, ',') AS q, array_to_string(h.codes, ',') AS h,
           CASE WHEN len(q.codes) = 0 THEN CASE WHEN len(list_filter(h.codes, lambda c: c <> 'P0000')) = 0 OR h.codes = ['NONE'] THEN 1.0::DOUBLE ELSE 0.0 END
             WHEN len(h.codes) = 0 THEN 0.0
             ELSE len(list_intersect(q.codes, h.codes))::DOUBLE / len(list_distinct(list_concat(q.codes, h.codes))) END AS jaccard
         FROM (SELECT DISTINCT list_sort(list_distinct(active_dtcs)) AS codes FROM incidents) q, (SELECT DISTINCT list_sort(list_distinct(active_dtcs)) AS codes FROM zhistory) h) p
       WHERE jaccard > 0
       UNION ALL SELECT incident_id, NULL, {_CODE_LISTS}, NULL, NULL FROM incidents
       UNION ALL SELECT NULL, historical_index, NULL, {_CODE_LISTS}, NULL FROM zhistory""", "incidents", "zhistory"))
def code_jaccard(spark, sf_dir):
    """Every pair of an incident's and a history's code list that have something in common, and which list every incident and every history row has."""
    left, right = incidents(spark, sf_dir), prepared(spark, sf_dir).train
    found = code_similarities(left, right)
    pairs = found.select(F.array_join("left_codes", ",").alias("incident_codes"), F.array_join("right_codes", ",").alias("history_codes"), _r("similarity", 9))
    own = F.array_join(F.array_sort(F.array_distinct("active_dtcs")), ",")
    for df, row, name in ((left, "incident_id", "incident_codes"), (right, "historical_index", "history_codes")):
        pairs = pairs.unionByName(df.select(row, own.alias(name)), allowMissingColumns=True)
    return pairs.select("incident_id", "historical_index", "incident_codes", "history_codes", "similarity")


@registered(_component_oracle("dtc_similarity", _CODES_ONLY, 2))
def dtc_similarity(spark, sf_dir):
    return _component(spark, sf_dir, "dtc_similarity", _CODES_ONLY, 2)


@registered(_component_oracle("mode_similarity", _MODE_ONLY, 2))
def mode_similarity(spark, sf_dir):
    return _component(spark, sf_dir, "mode_similarity", _MODE_ONLY, 2)


@registered(_component_oracle("similarity_score", _OWN_WEIGHTS, 3))
def weighted_score(spark, sf_dir):
    return _component(spark, sf_dir, "similarity_score", _OWN_WEIGHTS, 3)


_TOP5 = Q.query(
    """SELECT o.incident_id, CAST(t.rank AS BIGINT) AS rank, t.historical_index, round(t.similarity_score, 6) AS similarity_score
       FROM probe_of o JOIN top5 t ON t.probe = o.probe""",
    "probe_of", "top5",
)


def _ranked(best: DataFrame) -> DataFrame:
    return best.select("incident_id", *_long("rank"), "historical_index", _r("similarity_score"))


@registered(_TOP5)
def similar_topk(spark, sf_dir):
    return _ranked(SIM.similar_topk(incidents(spark, sf_dir), index(spark, sf_dir)))


@registered(_TOP5)
def index_roundtrip(spark, sf_dir):
    """The same search with an index of several levels that was saved and loaded."""
    path = f"{scratch_dir(spark)}/telltale/index-{uuid.uuid4().hex}"
    ART.save_index(spark, SIM.build_index(prepared(spark, sf_dir).train, scaler(spark, sf_dir), most_boxes=16), path)
    return _ranked(SIM.similar_topk(incidents(spark, sf_dir), ART.load_index(spark, path)))


_SCORES = ("similarity_score", "sensor_similarity", "dtc_similarity", "mode_similarity")


def top5(spark, sf_dir) -> DataFrame:
    """The default search, shared by the queries that build on it."""
    return X.once(spark, sf_dir, "top5", lambda: SIM.similar_topk(incidents(spark, sf_dir), index(spark, sf_dir)))


def cases(spark, sf_dir) -> DataFrame:
    """Every incident with the nested cases of the default search."""
    return X.once(spark, sf_dir, "cases", lambda: SIM.with_similar_cases(incidents(spark, sf_dir), index(spark, sf_dir)))


@registered(Q.query(
    f"""SELECT o.incident_id, CAST(t.rank AS BIGINT) AS rank, t.historical_index, {', '.join(f'round(t.{c}, 6) AS {c}' for c in _SCORES)},
        t.dtc_signature, CAST(t.history_mode AS BIGINT) AS Mode, {', '.join(f'round(t.{s}, 9) AS {s}' for s in SENSORS)}
        FROM probe_of o JOIN top5 t ON t.probe = o.probe""", "probe_of", "top5"))
def similar_cases(spark, sf_dir):
    return top5(spark, sf_dir).select(
        "incident_id", *_long("rank"), "historical_index", *[_r(c) for c in _SCORES], "dtc_signature", *_long(MODE), *[_r(s, 9) for s in SENSORS]
    )


@registered(Q.query(
    """SELECT incident_id, n AS case_count, round(top_score, 6) AS top_score, cases, 'Similarity calculation successful.' AS summary FROM case_list""", "case_list"))
def similarity_summary(spark, sf_dir):
    nested = cases(spark, sf_dir)
    s = F.col("similarity")
    return nested.select(
        "incident_id", F.size(s["top_cases"]).cast("long").alias("case_count"), F.round(s["top_score"], 6).alias("top_score"),
        F.array_join(F.transform(s["top_cases"], lambda c: c["historical_index"].cast("string")), ",").alias("cases"), s["summary"].alias("summary"),
    )


@registered(Q.query("SELECT incident_id, same_signature FROM case_list", "case_list"))
def same_signature_found(spark, sf_dir):
    nested = cases(spark, sf_dir)
    sig = C.signature(F.col("active_dtcs"))
    return nested.select("incident_id", F.exists(F.col("similarity.top_cases"), lambda c: c["dtc_signature"] == sig).alias("same_signature"))


for _family in ("", "raw_"):
    _deviations = " UNION ALL ".join(
        f"""SELECT incident_id, '{s}' AS feature, {i} AS ordinal, {s} AS raw_value,
            CASE WHEN z_{s} < lo_{s} THEN lo_{s} - z_{s} WHEN z_{s} > hi_{s} THEN z_{s} - hi_{s} ELSE 0.0 END AS deviation FROM {_family}zincidents, bands"""
        for i, s in enumerate(SENSORS))
    Q.define(f"{_family}deviations", f"SELECT * FROM ({_deviations}) d WHERE deviation > 0", [f"{_family}zincidents", "bands"])
    Q.define(f"{_family}contribution_text", f"""SELECT incident_id, string_agg(concat(feature, ':', CAST(CAST(round(deviation * 10000) AS BIGINT) AS VARCHAR)), ',' ORDER BY round(deviation, 12) DESC, ordinal) AS found
      FROM {_family}deviations GROUP BY incident_id""", [f"{_family}deviations"])


# --- Anomalies ---------------------------------------------------------------------------------------------------------


def model(spark: SparkSession, sf_dir: str) -> AnomalyModel:
    return X.once(spark, sf_dir, "model", lambda: fit_anomaly_model(prepared(spark, sf_dir).train))


@registered(Q.query("SELECT CAST(tree AS BIGINT) AS tree, historical_index FROM forest_drawn", "forest_drawn"))
def forest_sample(spark, sf_dir):
    return FOR.draw_samples(prepared(spark, sf_dir).train, "historical_index", []).select(*_long("tree"), "historical_index")


@registered(Q.query(
    "SELECT CAST(tree AS BIGINT) AS tree, node, n, CAST(coalesce(feature, -1) AS BIGINT) AS feature, round(coalesce(threshold, 0.0), 6) AS threshold FROM forest_nodes", "forest_nodes"))
def forest_nodes(spark, sf_dir):
    return model(spark, sf_dir).forest.nodes.select(*_long("tree", "node", "n", "feature"), _r("threshold"))


@registered(Q.query("SELECT historical_index, round(score, 6) AS forest_score FROM history_scores", "history_scores"))
def forest_score(spark, sf_dir):
    clean = prepared(spark, sf_dir).train
    return FOR.with_forest_score(clean, model(spark, sf_dir).forest, ["z_" + s for s in SENSORS]).select("historical_index", _r("forest_score"))


@registered(Q.query("SELECT round(cut, 6) AS score_offset FROM forest_offset", "forest_offset"))
def forest_offset(spark, sf_dir):
    forest = model(spark, sf_dir).forest
    return forest.nodes.agg(F.round(F.lit(forest.offset) + 0 * F.max("n"), 6).alias("score_offset"))


def _score():
    """The verdict's score; adding zero turns -0.0 into 0.0."""
    return (F.col("anomaly_verdict.anomaly_score") + 0.0).alias("anomaly_score")


def verdicts(spark, sf_dir) -> DataFrame:
    m = model(spark, sf_dir)
    return DEV.detect_anomalies(incidents(spark, sf_dir), m.forest, scaler(spark, sf_dir), m.bands)


@registered(Q.query("SELECT incident_id, anomaly, round(margin, 4) + 0.0 AS anomaly_score FROM flags", "flags"))
def anomaly_flag(spark, sf_dir):
    return verdicts(spark, sf_dir).select("incident_id", "anomaly_verdict.anomaly", _score())


@registered(Q.query(
    f"""SELECT f.incident_id, anomaly, round(margin, 4) + 0.0 AS anomaly_score, {Q.SEVERITY.format("margin")} AS severity, coalesce(d.found, '') AS contributions, CAST(NULL AS VARCHAR) AS error
        FROM flags f LEFT JOIN contribution_text d ON d.incident_id = f.incident_id""", "flags", "contribution_text"))
def detect_anomalies(spark, sf_dir):
    return _shown(verdicts(spark, sf_dir))


def _shown(v: DataFrame) -> DataFrame:
    found = F.transform("anomaly_verdict.feature_contributions", lambda c: F.concat_ws(":", c["feature"], F.round(c["deviation_magnitude"] * 10000).cast("long").cast("string")))
    return v.select("incident_id", _score(), *[f"anomaly_verdict.{c}" for c in ("anomaly", "severity", "error")], F.array_join(found, ",").alias("contributions"))


@registered(Q.query(f"SELECT incident_id, {Q.SEVERITY.format('margin')} AS severity FROM flags", "flags"))
def severity_band(spark, sf_dir):
    return verdicts(spark, sf_dir).select("incident_id", "anomaly_verdict.severity")


@registered(Q.query(" UNION ALL ".join(f"SELECT '{s}' AS feature, round(lo_{s}, 6) AS p5, round(hi_{s}, 6) AS p95 FROM bands" for s in SENSORS), "bands"))
def percentile_bands(spark, sf_dir):
    return DEV.bands_table(spark, DEV.fit_bands(prepared(spark, sf_dir).train)).select("feature", _r("p5"), _r("p95"))



def _bands(spark, sf_dir):
    return X.once(spark, sf_dir, "bands", lambda: DEV.fit_bands(prepared(spark, sf_dir).train))


@registered(Q.query("SELECT incident_id, feature, round(deviation, 6) AS deviation_magnitude, round(raw_value, 6) AS raw_value FROM deviations", "deviations"))
def percentile_deviation(spark, sf_dir):
    found = DEV.contributions(scaler(spark, sf_dir), _bands(spark, sf_dir))
    rows = incidents(spark, sf_dir).select("incident_id", F.inline(found))
    return rows.select("incident_id", "feature", _r("deviation_magnitude"), _r("raw_value"))


@registered(Q.query(
    """SELECT i.incident_id, d.feature FROM incidents i LEFT JOIN (SELECT incident_id, feature,
         row_number() OVER (PARTITION BY incident_id ORDER BY round(deviation, 12) DESC, ordinal) AS r FROM deviations) d
       ON d.incident_id = i.incident_id AND d.r = 1""", "incidents", "deviations"))
def top_deviating_feature(spark, sf_dir):
    found = DEV.contributions(scaler(spark, sf_dir), _bands(spark, sf_dir))
    return incidents(spark, sf_dir).select("incident_id", DEV.top_feature(found).alias("feature"))


@registered(Q.query(
    f"""SELECT incident_id, false AS anomaly, CAST(0.0 AS DOUBLE) AS anomaly_score, 'unknown' AS severity, CAST(0 AS BIGINT) AS contribution_count, e AS error
        FROM (SELECT incident_id, {Q.ANOMALY_ERROR} AS e FROM raw_incidents) x WHERE e IS NOT NULL""", "raw_incidents"))
def anomaly_fallback(spark, sf_dir):
    raw = X.raw_incidents(spark, sf_dir)
    failed = raw.select("incident_id", V.anomaly_error(raw).alias("e")).filter("e IS NOT NULL")
    v = failed.select("incident_id", DEV.fallback_verdict(F.col("e")).alias("v"))
    return v.select("incident_id", "v.anomaly", "v.anomaly_score", "v.severity", F.size("v.feature_contributions").cast("long").alias("contribution_count"), "v.error")


@registered(ORACLES["detect_anomalies"])
def model_roundtrip(spark, sf_dir):
    """Verdicts of a saved model that was read back."""
    path = _folder(spark, "model")
    ART.save_model(spark, model(spark, sf_dir), path)
    m = ART.load_model(spark, path)
    return _shown(DEV.detect_anomalies(incidents(spark, sf_dir), m.forest, scaler(spark, sf_dir), m.bands))


# --- Knowledge base and retrieval --------------------------------------------------------------------------------------

_GAPS = "CASE WHEN doc_id % 17 = 4 THEN NULL WHEN doc_id % 17 = 5 THEN '' ELSE code END"


@registered(Q.query(f"SELECT doc_id, code FROM (SELECT doc_id, {_GAPS} AS code FROM kb) k WHERE code IS NOT NULL AND code <> ''", "kb"))
def kb_entries(spark, sf_dir):
    gaps = X.entries(spark, sf_dir).withColumn("code", F.expr(_GAPS))
    return KB.coded_entries(gaps).select("doc_id", "code")


@registered(Q.query("SELECT doc_id, title, description FROM entry_fields", "entry_fields"))
def kb_language(spark, sf_dir):
    e = X.entries(spark, sf_dir)
    return e.select("doc_id", KB.language(F.col("title")).alias("title"), KB.language(F.col("description")).alias("description"))


@registered(Q.query("SELECT doc_id, category, components_text, causes_text, repair_text, flags_text FROM entry_fields", "entry_fields"))
def kb_fields(spark, sf_dir):
    return KB.document_fields(X.entries(spark, sf_dir)).select("doc_id", "category", "components_text", "causes_text", "repair_text", "flags_text")


@registered(Q.query("SELECT doc_id, text_doc FROM kb_texts", "kb_texts"))
def kb_text_doc(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", "text_doc")


@registered(Q.query(
    """SELECT doc_id, code, title, description, replace(CASE WHEN components_text = 'None' THEN '' ELSE components_text END, ', ', '|') AS affected_components,
        replace(CASE WHEN causes_text = 'None' THEN '' ELSE causes_text END, '; ', '|') AS common_causes, repair_fields, source_file FROM entry_fields""", "entry_fields"))
def kb_metadata(spark, sf_dir):
    return _metadata(docs_of(spark, sf_dir))


@registered(ORACLES["kb_metadata"])
def knowledge_roundtrip(spark, sf_dir):
    path = _folder(spark, "knowledge")
    ART.save_knowledge(docs_of(spark, sf_dir), path)
    return _metadata(ART.load_knowledge(spark, path))


def _metadata(d: DataFrame) -> DataFrame:
    fields = F.array_sort(F.transform(F.map_entries("repair_information"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None")))))
    return d.select("doc_id", "code", "title", "description", F.array_join("affected_components", "|").alias("affected_components"),
                    F.array_join("common_causes", "|").alias("common_causes"), F.coalesce(F.array_join(fields, "|"), F.lit("")).alias("repair_fields"), "source_file")


@registered(Q.query(
    f"""SELECT row_number() OVER (ORDER BY source, position) - 1 AS doc_id, source AS source_file, position FROM (
          SELECT doc_id AS position, source, {_GAPS} AS code FROM kb) k WHERE code IS NOT NULL AND code <> ''""", "kb"))
def kb_doc_id(spark, sf_dir):
    gaps = X.entries(spark, sf_dir).withColumn("code", F.expr(_GAPS)).drop("doc_id")
    return KB.numbered_entries(gaps).select("doc_id", "source_file", "position")


def docs_of(spark, sf_dir) -> DataFrame:
    return X.once(spark, sf_dir, "docs", lambda: materialise(KB.documents(X.entries(spark, sf_dir)), "docs"))


def vector_docs(spark, sf_dir) -> DataFrame:
    """Documents with the given vectors; a document without one can only be found by its code."""
    vectors = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return docs_of(spark, sf_dir).join(vectors, "doc_id", "left")


def knowledge_base(spark, sf_dir):
    """The vectors of the job's documents by the default encoder, and the encoder."""

    def build():
        # What is searched; the texts that the job writes on its way are not read again.
        docs, encoder = build_knowledge_base(X.entries(spark, sf_dir))
        vectors = materialise(docs.select("doc_id", "embedding"), "knowledge-base", compression="zstd")
        release(docs)
        return vectors, encoder

    return X.once(spark, sf_dir, "knowledge_base", build)


@registered(Q.query(
    "SELECT doc_id, CAST(512 AS BIGINT) AS dimensions, string_agg(concat(d, ':', CAST(round(v * 10000) AS BIGINT)), ',' ORDER BY d) AS vector FROM kb_vectors WHERE v <> 0 GROUP BY doc_id", "kb_vectors"))
def kb_embed(spark, sf_dir):
    docs, _ = knowledge_base(spark, sf_dir)
    cells = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda c: c["x"] != 0)
    shown = F.transform(cells, lambda c: F.concat_ws(":", c["i"].cast("string"), F.round(c["x"].cast("float") * F.lit(10000).cast("float")).cast("long").cast("string")))
    return docs.select("doc_id", F.size("embedding").cast("long").alias("dimensions"), F.array_join(shown, ",").alias("vector"))


# Both vectors have length 1; a text without a weighted word has none and is at distance 1 from every document.
@registered(Q.query(
    """SELECT query_id, CAST(r AS BIGINT) AS neighbour_rank, doc_id, round(d, 4) + 0.0 AS squared_distance FROM (
         SELECT query_id, doc_id, d, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), doc_id) AS r FROM (
           SELECT q.doc_id AS query_id, k.doc_id, coalesce(q.s, 0) + coalesce(k.s, 0) - 2 * coalesce(n.dot, 0) AS d
           FROM (SELECT t.doc_id, s FROM documents t LEFT JOIN (SELECT doc_id, sum(v::DOUBLE * v) AS s FROM text_vectors GROUP BY doc_id) x ON x.doc_id = t.doc_id) q
           CROSS JOIN (SELECT t.doc_id, s FROM kb_texts t LEFT JOIN (SELECT doc_id, sum(v::DOUBLE * v) AS s FROM kb_vectors GROUP BY doc_id) x ON x.doc_id = t.doc_id) k
           LEFT JOIN text_near n ON n.query_id = q.doc_id AND n.doc_id = k.doc_id) a) b WHERE r <= 5""", "text_near", "text_vectors", "kb_vectors", "kb_texts"))
def text_retrieve(spark, sf_dir):
    """Every document's whole text as a query against the knowledge base."""
    docs, encoder = knowledge_base(spark, sf_dir)
    asked = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"))
    queries = encoder(asked).select("query_id", "embedding", F.lit(5).alias("k"))
    near = VEC.nearest(queries, docs)
    return near.select("query_id", *_long("neighbour_rank"), "doc_id", (F.round("squared_distance", 4) + 0.0).alias("squared_distance"))


@registered(Q.query("SELECT lookup_code, doc_id FROM lookup", "lookup"))
def code_lookup(spark, sf_dir):
    return KB.code_lookup(docs_of(spark, sf_dir))


@registered(Q.query("SELECT query_id, code, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS BIGINT) AS place, doc_id FROM every_exact", "every_exact"))
def exact_code_match(spark, sf_dir):
    """Texts that name codes, one for every document; matching by code needs no vectors."""
    asked = X.knowledge(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.expr(Q.HYBRID_TEXT).alias("query_text"))
    found = RET.exact_matches(asked, docs_of(spark, sf_dir))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("position")).cast("long")
    return found.select("query_id", F.col("lookup_code").alias("code"), place.alias("place"), "doc_id")


def hybrid_queries(spark, sf_dir) -> DataFrame:
    """A text for every document, with the given vectors dealt out in turn."""
    vectors = X.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    kb = X.knowledge(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.expr(Q.HYBRID_TEXT).alias("query_text"), (F.col("doc_id") % vectors.count()).alias("vec_id"))
    return kb.join(vectors, "vec_id").drop("vec_id")


@registered(
    """SELECT query_id, doc_id, CAST(r AS BIGINT) AS neighbour_rank, round(d, 6) AS squared_distance, round(1.0 / (1.0 + d), 4) AS score FROM (
         SELECT q.vec_id AS query_id, v.vec_id AS doc_id, power(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 2) AS d,
           row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), v.vec_id) AS r
         FROM embeddings q, embeddings v) n WHERE r <= 5""")
def vector_knn(spark, sf_dir):
    vectors = X.table(spark, sf_dir, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding", F.lit(5).alias("k"))
    near = VEC.nearest(queries, vectors.withColumnRenamed("vec_id", "doc_id"))
    return near.select("query_id", "doc_id", *_long("neighbour_rank"), _r("squared_distance"), RET.similarity_of_distance(F.col("squared_distance")).alias("score"))


@registered("SELECT 5 * count(*) AS neighbours, true AS nine_of_ten_found FROM embeddings")
def vector_knn_approximate(spark, sf_dir):
    """How many exact neighbours there are, and whether the search by buckets finds at least 90 % of them."""
    vectors = X.table(spark, sf_dir, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding", F.lit(5).alias("k"))
    docs = vectors.withColumnRenamed("vec_id", "doc_id")
    found = VEC.approximate_nearest(queries, docs).select("query_id", "doc_id", F.lit(1).alias("hit"))
    exact = VEC.nearest(queries, docs).select("query_id", "doc_id")
    return exact.join(found, ["query_id", "doc_id"], "left").agg(F.count(F.lit(1)).alias("neighbours"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("nine_of_ten_found"))


@registered(Q.query("SELECT query_id, CAST(position AS BIGINT) AS position, match_type, doc_id, score FROM hybrid", "hybrid"))
def hybrid_retrieve(spark, sf_dir):
    # Not the stored documents: their texts are written several times over, and nothing here reads them.
    vectors = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = KB.documents(X.entries(spark, sf_dir)).select("doc_id", "code").join(vectors, "doc_id", "left")
    return RET.retrieve(hybrid_queries(spark, sf_dir), docs, 5).select("query_id", *_long("position"), "match_type", "doc_id", "score")


# --- Evidence ----------------------------------------------------------------------------------------------------------


def resources(spark: SparkSession, sf_dir: str) -> Resources:
    """Everything an analysis needs, with the given vectors as the encoder's output."""

    def build():
        docs = materialise(vector_docs(spark, sf_dir), "vector-docs")
        return Resources(index(spark, sf_dir), model(spark, sf_dir), docs, X.code_encoder(spark, sf_dir))

    return X.once(spark, sf_dir, "resources", build)


@registered(Q.query("SELECT incident_id, CAST(pos AS BIGINT) AS code_position, code AS query_text FROM incident_codes", "incident_codes"))
def incident_queries(spark, sf_dir):
    return EV.incident_queries(incidents(spark, sf_dir)).select("incident_id", *_long("code_position"), "query_text")


@registered(Q.query(
    """SELECT incident_id, CAST(row_number() OVER (PARTITION BY incident_id, match_type ORDER BY first) AS BIGINT) AS place, match_type, doc_id, score FROM matches""", "matches"))
def evidence_matches(spark, sf_dir):
    who = incidents(spark, sf_dir).select("incident_id", "active_dtcs")
    found = find_matches(who, resources(spark, sf_dir))
    order = W.partitionBy("active_dtcs", "match_type").orderBy("code_position", "position")
    placed = found.withColumn("place", F.row_number().over(order).cast("long"))
    return who.join(placed, "active_dtcs").select("incident_id", "place", "match_type", "doc_id", "score")


for _family in ("", "raw_"):
    Q.define(f"{_family}exact_codes", f"""SELECT m.incident_id, string_agg(k.code, ', ' ORDER BY m.first) AS codes, count(*) AS n FROM {_family}matches m JOIN kb k ON k.doc_id = m.doc_id
      WHERE m.match_type = 'EXACT' GROUP BY m.incident_id""", [f"{_family}matches", "kb"])
    Q.define(f"{_family}top_deviation", f"""SELECT f.incident_id, d.feature FROM {_family}flags f LEFT JOIN (SELECT incident_id, feature,
      row_number() OVER (PARTITION BY incident_id ORDER BY round(deviation, 12) DESC, ordinal) AS r FROM {_family}deviations) d ON d.incident_id = f.incident_id AND d.r = 1
      WHERE f.anomaly""", [f"{_family}flags", f"{_family}deviations"])
    Q.define(f"{_family}semantic_count", f"SELECT incident_id, count(*) AS n FROM {_family}matches WHERE match_type = 'SEMANTIC' GROUP BY incident_id", [f"{_family}matches"])
_JOINED = """FROM incidents i JOIN case_list c ON c.incident_id = i.incident_id LEFT JOIN exact_codes x ON x.incident_id = i.incident_id
  LEFT JOIN top_deviation t ON t.incident_id = i.incident_id LEFT JOIN semantic_count s ON s.incident_id = i.incident_id"""
_SUMMARY = f"""concat_ws(' / ', CASE WHEN c.n > 0 THEN concat('Found ', CAST(c.n AS VARCHAR), ' historically similar operating states.') END,
          CASE WHEN c.same_signature THEN 'A historical operating state with the same DTC signature was found.' END,
          CASE WHEN t.incident_id IS NOT NULL THEN 'The current operating condition was classified as anomalous.' END,
          CASE WHEN t.feature IS NOT NULL THEN concat(t.feature, ' was among the features with the largest deviation.') END,
          CASE WHEN x.n > 0 THEN concat('{S.DEFAULT_KB_NAME} contains knowledge associated with DTC(s): ', x.codes, '.') END)"""
_LEADS = f"""concat_ws(' / ', CASE WHEN x.n > 0 THEN concat('Investigate systems/components associated with DTC ', x.codes, ' using the retrieved {S.DEFAULT_KB_NAME} evidence.') END,
          CASE WHEN c.n > 0 THEN 'Review the operating conditions of the retrieved historical cases to understand typical steady-state behavior for this profile.' END,
          CASE WHEN t.feature IS NOT NULL THEN concat('Investigate the sensor parameters contributing most strongly to the anomalous operating state, particularly ', t.feature, '.') END,
          CASE WHEN x.n > 0 OR s.n > 0 THEN 'Review the common causes documented in the retrieved DTC knowledge.' END)"""


def _findings(spark, sf_dir) -> DataFrame:
    who = incidents(spark, sf_dir)
    m = model(spark, sf_dir)
    judged = DEV.detect_anomalies(cases(spark, sf_dir), m.forest, scaler(spark, sf_dir), m.bands)
    r = resources(spark, sf_dir)
    arrays = materialise(EV.match_arrays(find_matches(who, r), r.docs), "matches")
    return EV.with_matches(judged, arrays)


@registered(Q.query(f"SELECT i.incident_id, {_SUMMARY} AS summary {_JOINED}", "case_list", "exact_codes", "top_deviation", "semantic_count"))
def evidence_summary(spark, sf_dir):
    return _findings(spark, sf_dir).select("incident_id", F.array_join(EV.evidence_summary(), " / ").alias("summary"))


@registered(Q.query(f"SELECT i.incident_id, {_LEADS} AS leads {_JOINED}", "case_list", "exact_codes", "top_deviation", "semantic_count"))
def investigation_leads(spark, sf_dir):
    return _findings(spark, sf_dir).select("incident_id", F.array_join(EV.investigation_leads(), " / ").alias("leads"))


# --- Whole analyses ----------------------------------------------------------------------------------------------------


def analysis(spark, sf_dir) -> DataFrame:
    return analyze_incidents(X.raw_incidents(spark, sf_dir), resources(spark, sf_dir))


_OUTCOME = Q.query(
    """SELECT r.incident_id, r.message, coalesce(c.n, 0) AS case_count, coalesce(c.cases, '') AS cases,
         round(coalesce(c.top_score, CASE WHEN r.message IS NULL THEN 0.0 END), 6) AS top_score, coalesce(m.exact, '') AS exact_codes, coalesce(m.semantic, '') AS semantic_codes,
         coalesce(c.same_signature, false) AS same_signature
       FROM raw_checked r LEFT JOIN raw_case_list c ON c.incident_id = r.incident_id LEFT JOIN raw_match_list m ON m.incident_id = r.incident_id""",
    "raw_checked", "raw_case_list", "raw_match_list")


def _outcome(packages: DataFrame) -> DataFrame:
    """What SQL can follow of a package: everything but the forest's verdict."""

    def found(path, shown):
        return F.coalesce(F.array_join(F.transform(path, shown), ","), F.lit(""))

    def scored(m):
        return F.concat_ws(":", m["DTC_code"], F.round(m["score"] * 10000).cast("long").cast("string"))

    cases = F.col("similarity.top_cases")
    return packages.select(
        "incident_id", F.col("error.message").alias("message"), F.when(cases.isNull(), 0).otherwise(F.size(cases)).cast("long").alias("case_count"),
        F.coalesce(F.array_join(F.transform(cases, lambda c: c["historical_index"].cast("string")), ","), F.lit("")).alias("cases"),
        F.round("similarity.top_score", 6).alias("top_score"), found("rag.exact_dtc_matches", lambda m: m["DTC_code"]).alias("exact_codes"),
        found("rag.semantic_matches", scored).alias("semantic_codes"),
        F.array_contains(F.coalesce("evidence_summary", F.array().cast("array<string>")), EV.FOUND_SIGNATURE).alias("same_signature"),
    )


@registered(_OUTCOME, name="analyze_incidents")
def analyze_incidents_batch(spark, sf_dir):
    return _outcome(analysis(spark, sf_dir))


@registered(_OUTCOME)
def analyze_incidents_stream(spark, sf_dir):
    """The same incidents arriving as files of a stream, analyzed in micro-batches until none is left."""
    base = f"{scratch_dir(spark)}/telltale/stream-{uuid.uuid4().hex}"
    raw = X.raw_incidents(spark, sf_dir).withColumn("incident_id", F.col("incident_id").cast("string"))
    raw.repartition(4, "incident_id").write.parquet(f"{base}/in")
    arriving = read_incident_stream(spark, f"{base}/in", max_files=2)
    analyze_stream(arriving, resources(spark, sf_dir), f"{base}/out", f"{base}/state").awaitTermination()
    return _outcome(spark.read.parquet(f"{base}/out").withColumn("incident_id", F.col("incident_id").cast("long")))


_WHOLE = "CAST(CAST(round({} * {}) AS BIGINT) AS VARCHAR)"
_PARTS = {
    "error": "r.message",
    "incident.active_dtcs": "array_to_string(i.active_dtcs, ',')",
    **{f"incident.{s}": f"CASE WHEN isfinite(i.{s}) THEN {_WHOLE.format(f'i.{s}', 1000)} ELSE lower(CAST(i.{s} AS VARCHAR)) END" for s in ("RPM", "ECT")},
    "incident.Mode": "CAST(i.Mode AS VARCHAR)",
    "similarity.top_cases": "coalesce(c.cases, '')",
    "similarity.top_score": _WHOLE.format("coalesce(c.top_score, 0.0)", 1000000),
    "similarity.summary": f"CASE WHEN c.n > 0 THEN '{S.MSG_SIMILAR_OK}' ELSE '{S.MSG_SIMILAR_NONE}' END",
    "anomaly.anomaly": "CASE WHEN coalesce(f.anomaly, false) THEN 'true' ELSE 'false' END",
    "anomaly.anomaly_score": _WHOLE.format("coalesce(round(f.margin, 4), 0.0)", 10000),
    "anomaly.severity": f"CASE WHEN f.margin IS NULL THEN 'unknown' ELSE {Q.SEVERITY.format('f.margin')} END",
    "anomaly.feature_contributions": "coalesce(d.found, '')",
    "anomaly.error": "CASE WHEN f.margin IS NULL THEN 'Sensor values must be finite numbers.' END",
    "rag.exact_dtc_matches": "coalesce(m.exact, '')",
    "rag.semantic_matches": "coalesce(m.semantic, '')",
    "service_history.available": "'false'",
    "service_history.reason": f"'{S.MSG_NO_SERVICE_HISTORY}'",
    "evidence_summary": _SUMMARY,
    "investigation_leads": _LEADS,
}
Q.define(
    "package_parts",
    "SELECT r.incident_id, r.message AS failed, " + ", ".join(f'{sql} AS "{name}"' for name, sql in _PARTS.items())
    + " FROM raw_checked r " + " ".join(
        f"LEFT JOIN {table} {alias} ON {alias}.incident_id = r.incident_id"
        for table, alias in (("raw_valid", "i"), ("raw_case_list", "c"), ("raw_flags", "f"), ("raw_contribution_text", "d"), ("raw_match_list", "m"),
                             ("raw_exact_codes", "x"), ("raw_top_deviation", "t"), ("raw_semantic_count", "s"))),
    ["raw_checked", "raw_valid", "raw_case_list", "raw_flags", "raw_contribution_text", "raw_match_list", "raw_exact_codes", "raw_top_deviation", "raw_semantic_count"])
# A rejected incident has its error and nothing else.
_PACKAGE_ROWS = Q.query(
    " UNION ALL ".join(f"""SELECT incident_id, '{name}' AS path, "{name}" AS value FROM package_parts WHERE failed IS {'NOT NULL' if name == 'error' else 'NULL'}""" for name in _PARTS), "package_parts")


def _package_rows(packages: DataFrame, score: str) -> DataFrame:
    """One row per package and path. ``score`` is the name of a match's score."""

    def whole(value, units):
        return F.round(value * units).cast("long").cast("string")

    def joined(values, shown, sep=","):
        return F.array_join(F.transform(values, shown), sep)

    def reading(value):
        return F.when(is_finite(value), whole(value, 1000)).otherwise(F.lower(value.cast("string")))

    parts = {
        "error": F.col("error.message"),
        "incident.active_dtcs": F.array_join("incident.active_dtcs", ","),
        **{f"incident.{s}": reading(F.col(f"incident.{s}").cast("double")) for s in ("RPM", "ECT")},
        "incident.Mode": F.col("incident.Mode").cast("string"),
        "similarity.top_cases": joined("similarity.top_cases", lambda c: c["historical_index"].cast("string")),
        "similarity.top_score": whole(F.col("similarity.top_score"), 1000000),
        "similarity.summary": F.col("similarity.summary"),
        "anomaly.anomaly": F.col("anomaly.anomaly").cast("string"),
        "anomaly.anomaly_score": whole(F.col("anomaly.anomaly_score"), 10000),
        "anomaly.severity": F.col("anomaly.severity"),
        "anomaly.feature_contributions": joined("anomaly.feature_contributions", lambda c: F.concat_ws(":", c["feature"], whole(c["deviation_magnitude"], 10000))),
        "anomaly.error": F.col("anomaly.error"),
        "rag.exact_dtc_matches": joined("rag.exact_dtc_matches", lambda m: m["DTC_code"]),
        "rag.semantic_matches": joined("rag.semantic_matches", lambda m: F.concat_ws(":", m["DTC_code"], whole(m[score].cast("double"), 10000))),
        "service_history.available": F.col("service_history.available").cast("string"),
        "service_history.reason": F.col("service_history.reason"),
        "evidence_summary": F.array_join("evidence_summary", " / "),
        "investigation_leads": F.array_join("investigation_leads", " / "),
    }
    rows = F.array(*[F.struct(F.lit(name).alias("path"), value.alias("value")) for name, value in parts.items()])
    failed = F.col("error").isNotNull()
    return packages.select("incident_id", F.inline(F.filter(rows, lambda r: (r["path"] == "error") == failed)))


@registered(_PACKAGE_ROWS)
def evidence_package(spark, sf_dir):
    """Whole packages, one row per path."""
    return _package_rows(analysis(spark, sf_dir), "score")


_JSON = """incident struct<active_dtcs: array<string>, RPM: string, ECT: string, Mode: string>,
  similarity struct<top_cases: array<struct<historical_index: long>>, top_score: double, summary: string>,
  anomaly struct<anomaly: boolean, anomaly_score: double, severity: string, feature_contributions: array<struct<feature: string, deviation_magnitude: double>>, error: string>,
  rag struct<exact_dtc_matches: array<struct<DTC_code: string, similarity_score: string>>, semantic_matches: array<struct<DTC_code: string, similarity_score: string>>>,
  service_history struct<available: boolean, reason: string>, evidence_summary array<string>, investigation_leads array<string>, error string, message string"""


@registered(_PACKAGE_ROWS)
def evidence_json(spark, sf_dir):
    """The same paths, read back from each package's JSON text; every exact match must show that it is one."""
    text = analysis(spark, sf_dir).select("incident_id", EV.package_json().alias("package"))
    read = text.select("incident_id", F.from_json("package", _JSON).alias("p")).select("incident_id", "p.*")
    shown = F.transform("rag.exact_dtc_matches", lambda m: m.withField("DTC_code", F.when(m["similarity_score"] == "EXACT_MATCH", m["DTC_code"]).otherwise("?")))
    read = read.withColumn("rag", F.col("rag").withField("exact_dtc_matches", shown))
    return _package_rows(read.withColumn("error", F.when(F.col("message").isNotNull(), F.struct("error", "message"))), "similarity_score")


Q.define("bad_inputs", f"SELECT incident_id, {Q.SIMILARITY_ERROR} AS similarity_error, {Q.ANOMALY_ERROR} AS anomaly_error, "
         + "(" + " OR ".join(f"({Q.parsed(s)}) IS NULL OR isnan({Q.parsed(s)}) OR isinf({Q.parsed(s)})" for s in SENSORS) + ") AS unusable FROM raw_incidents", ["raw_incidents"])


@registered(Q.query(
    """SELECT incident_id, similarity_error, CASE WHEN similarity_error IS NOT NULL OR unusable THEN false ELSE true END AS has_cases,
         CASE WHEN anomaly_error IS NOT NULL THEN anomaly_error WHEN unusable THEN 'Sensor values must be finite numbers.' END AS anomaly_error FROM bad_inputs""", "bad_inputs"))
def degraded_incidents(spark, sf_dir):
    out = analyze_incidents(X.raw_incidents(spark, sf_dir), resources(spark, sf_dir), mode="degrade")
    return out.select("incident_id", "similarity_error", (F.size("similarity.top_cases") > 0).alias("has_cases"), F.col("anomaly.error").alias("anomaly_error"))
