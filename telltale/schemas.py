"""Column names, parameters and table schemas shared by the whole package.

Every operator takes its column lists as arguments; the values here are the defaults.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Sensor order, indicator order, weights, thresholds and message texts are part of the data contract.
SENSORS = ("LOAD_PCT", "ECT", "MAP", "RPM", "VSS", "IAT", "MAF", "FRP", "BARO", "VPWR", "AAT")
CODES = (
    "P0000", "P0562", "P0113", "P0102", "P0403", "P0404", "P2562",
    "P0234", "P2015", "P2009", "P0107", "P0069", "P0089", "P0406",
)
MODE = "Mode"
NO_FAULT_CODE = "P0000"
NO_CODES = "NONE"
CODE_PATTERN = "[PBUC][0-3][0-9]{3}"
DEFAULT_WEIGHTS = {"sensor": 0.5, "dtc": 0.3, "mode": 0.2}
TOP_K_SIMILAR = 5
TOP_K_RETRIEVAL = 5
TOP_K_EVIDENCE = 3
FOREST_TREES = 100
FOREST_SAMPLE = 256
FOREST_SEED = 42
CONTAMINATION = 0.01
BAND_LOW, BAND_HIGH = 0.05, 0.95
HIGH_SEVERITY_FROM = 0.1

MSG_SENSOR_MISSING = "Missing required sensor field: {}"
MSG_SENSOR_NUMERIC = "Sensor value {} must be numeric."
MSG_MODE_MISSING = "Missing required field: Mode"
MSG_MODE_INTEGER = "Mode must be an integer."
MSG_CODES_LIST = "active_dtcs must be a list of strings."
MSG_STRICT_CODES_MISSING = "Missing required field: active_dtcs (list of strings)"
MSG_STRICT_CODES_LIST = "active_dtcs must be a list of strings"
MSG_QUERY_EMPTY = "Query cannot be empty."
ERR_VALIDATION = "Input Validation Error"
ERR_INTERNAL = "Internal Processing Error"
MSG_VECTOR = "No usable vector for DTC(s): {}."
MSG_SIMILAR_OK = "Similarity calculation successful."
MSG_SIMILAR_NONE = "No similar cases found or error."
MSG_NO_SERVICE_HISTORY = "No real service-history dataset is currently available."
DEFAULT_KB_NAME = "The knowledge base"


def telemetry_schema(sensors=SENSORS, codes=CODES) -> T.StructType:
    """Raw telemetry: one row per observation, ``row_id`` gives the source order."""
    return T.StructType(
        [T.StructField("row_id", T.LongType(), False)]
        + [T.StructField(c, T.DoubleType()) for c in sensors]
        + [T.StructField(MODE, T.IntegerType())]
        + [T.StructField(c, T.IntegerType()) for c in codes]
    )


def raw_incident_schema(sensors=SENSORS) -> T.StructType:
    """Incidents as they arrive: every scalar is text, so that bad values can be reported instead of failing the read."""
    return T.StructType(
        [T.StructField("incident_id", T.StringType(), False)]
        + [T.StructField(c, T.StringType()) for c in sensors]
        + [T.StructField(MODE, T.StringType()), T.StructField("active_dtcs", T.ArrayType(T.StringType()))]
    )


LANGUAGE_MAP = T.MapType(T.StringType(), T.StringType())
KNOWLEDGE_ENTRY = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("position", T.LongType()),
        T.StructField("code", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("title", LANGUAGE_MAP),
        T.StructField("description", LANGUAGE_MAP),
        T.StructField("affected_components", T.ArrayType(T.StringType())),
        T.StructField("common_causes", T.ArrayType(T.StructType([T.StructField("label", LANGUAGE_MAP)]))),
        T.StructField("repair", LANGUAGE_MAP),
        T.StructField("flags", LANGUAGE_MAP),
    ]
)
FOREST_NODE = T.StructType(
    [
        T.StructField("tree", T.IntegerType()),
        T.StructField("node", T.IntegerType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("right", T.IntegerType()),
        T.StructField("feature", T.IntegerType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("n", T.IntegerType()),
    ]
)
MATCH_FIELDS = (
    "DTC_code", "match_type", "score", "title", "description",
    "affected_components", "common_causes", "repair_information", "source_file",
)
