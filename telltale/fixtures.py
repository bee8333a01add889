"""Incident telemetry and a knowledge base derived from the star-schema test tables.

``TELEMETRY_SQL`` and ``KNOWLEDGE_SQL`` run unchanged on any SQL engine; the DataFrame versions below give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.functions.codes import active_codes
from telltale.operators.ordinals import with_ordinal_of_copies
from telltale.schemas import CODES, MODE, SENSORS

_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
_USED = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]

_ATTRIBUTES = {
    "q": "CAST(floor(l_quantity / 2) AS INT)",
    "d": "CAST(round(l_discount * 100) AS INT)",
    "x": "CAST(round(l_tax * 100) AS INT)",
    "m": "CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END",
    "s": "CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END",
}
_READINGS = {
    "is_test": "CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END",
    "g": "(q + d + x) % 7",
    "LOAD_PCT": "CAST(q * 4 AS DOUBLE)",
    "ECT": "CAST(100 + d * 10 AS DOUBLE)",
    "MAP": "CAST(10 + x AS DOUBLE)",
    "RPM": "CAST(600 + q * 100 + d * 25 AS DOUBLE)",
    "VSS": "CAST(CASE WHEN m = 0 THEN 0 ELSE q * 2 + x END AS DOUBLE)",
    "IAT": "CAST(60 + d * 4 + x AS DOUBLE)",
    "MAF": "CAST(q * d AS DOUBLE) / 128",
    "FRP": "CAST(4000 + q * 50 - x * 10 AS DOUBLE)",
    "BARO": "CAST(14.25 AS DOUBLE)",
    "VPWR": "CAST(12 AS DOUBLE) + CAST(x AS DOUBLE) / 4",
    "AAT": "CAST(80 + d * 2 - x AS DOUBLE) + s",
    "Mode": "m",
    "P0562": "CASE WHEN x = 8 AND q > 12 THEN 1 ELSE 0 END",
    "P0113": "CASE WHEN d = 10 THEN 1 ELSE 0 END",
    "P0102": "CASE WHEN (q * 7 + d) % 11 = 0 THEN 1 ELSE 0 END",
    "P0403": "CASE WHEN (q + d) % 6 = 0 THEN 1 ELSE 0 END",
    "P0404": "CASE WHEN (q + d) % 12 = 0 THEN 1 ELSE 0 END",
    "P2562": "CASE WHEN q = 24 AND m = 2 THEN 1 ELSE 0 END",
    "P0234": "CASE WHEN q = 25 THEN 1 ELSE 0 END",
    "P2015": "CASE WHEN (d * 3 + x) % 13 = 0 THEN 1 ELSE 0 END",
    "P2009": "CASE WHEN (d * 3 + x) % 17 = 0 THEN 1 ELSE 0 END",
    "P0107": "CASE WHEN x = 0 AND d = 0 THEN 1 ELSE 0 END",
    "P0069": "CASE WHEN x = 1 AND d = 9 THEN 1 ELSE 0 END",
    "P0089": "CASE WHEN x = 2 AND q = 3 THEN 1 ELSE 0 END",
    "P0406": "CASE WHEN s = 1 AND q = 0 THEN 1 ELSE 0 END",
}


def _select_list(expressions: dict[str, str]) -> list[str]:
    return [f"{e} AS {name}" for name, e in expressions.items()]


_NO_FAULT = """
  CASE WHEN P0562+P0113+P0102+P0403+P0404+P2562+P0234+P2015+P2009+P0107+P0069+P0089+P0406 = 0 AND g <> 0 THEN 1
       WHEN g = 6 AND P0403 = 1 THEN 1 ELSE 0 END
"""

TELEMETRY_SQL = f"""
SELECT row_id, is_test, {', '.join(SENSORS)}, Mode, {_NO_FAULT} AS P0000, {', '.join(c for c in CODES if c != 'P0000')}
FROM (SELECT row_id, {', '.join(_select_list(_READINGS))} FROM (
  SELECT row_number() OVER (ORDER BY {', '.join(_ORDER + _USED)}) - 1 AS row_id, l_orderkey, {', '.join(_select_list(_ATTRIBUTES))} FROM lineitem
) f) t
"""

_KB_CODE = """
  CASE doc_id WHEN 0 THEN 'P0562' WHEN 1 THEN 'P0113' WHEN 2 THEN 'P0102' WHEN 3 THEN 'P0403' WHEN 4 THEN 'P0404' WHEN 5 THEN 'P2562'
    WHEN 6 THEN 'P0234' WHEN 7 THEN 'P2015' WHEN 8 THEN 'P2009'
    ELSE concat('P', lpad(CAST(3000 + (doc_id * 37) % 150 AS VARCHAR(4)), 4, '0')) END
"""
KNOWLEDGE_SQL = f"""
SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN lower(c) ELSE c END AS code, text, lang AS category, source
FROM (SELECT doc_id, text, lang, source, {_KB_CODE} AS c FROM documents) k
"""

_cache: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Build a derived table once per session and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _cache:
        _cache[key] = build()
    return _cache[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observations, written once; ``row_id`` is the position in source order."""

    def build():
        columns = ["is_test", *SENSORS, MODE]
        rest = [c for c in CODES if c != "P0000"]

        def readings(lines: DataFrame) -> DataFrame:
            attributes = lines.selectExpr("l_orderkey", *_select_list(_ATTRIBUTES))
            return attributes.selectExpr(*_select_list(_READINGS)).withColumn("P0000", F.expr(_NO_FAULT)).select(*columns, "P0000", *rest)

        lines = table(spark, sf_dir, "lineitem").select(*_ORDER, *_USED)
        return with_ordinal_of_copies(lines, _ORDER, "row_id", readings).select("row_id", *columns, "P0000", *rest)

    return once(spark, sf_dir, "telemetry", build)


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).filter("is_test = 0").drop("is_test")


def test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).filter("is_test = 1").drop("is_test")


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, code, text, category, source`` for every document."""
    coded = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.expr(_KB_CODE).alias("c"))
    return coded.selectExpr(
        "doc_id", "CASE WHEN doc_id % 10 = 9 THEN lower(c) ELSE c END AS code", "text", "lang AS category", "source"
    )


# The telemetry as exports deliver it: one more column, missing and infinite cells, and an indicator that the test table lacks.
_DIRTY = {
    "RPM": "CASE row_id % 101 WHEN 7 THEN NULL WHEN 8 THEN CAST('NaN' AS DOUBLE) WHEN 9 THEN CAST('Infinity' AS DOUBLE) ELSE RPM END",
    "ECT": "CASE row_id % 103 WHEN 5 THEN CAST('-Infinity' AS DOUBLE) WHEN 6 THEN NULL ELSE ECT END",
    "AAT": "CASE WHEN row_id % 97 = 1 THEN CAST('NaN' AS DOUBLE) ELSE AAT END",
}
_DIRTY_LIST = [*[f"{_DIRTY.get(s, s)} AS {s}" for s in SENSORS], MODE]
VEHICLE = "CASE row_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'bus' ELSE 'van' END AS vehicle"
DIRTY_TRAIN_SQL = f"SELECT row_id, {', '.join([*_DIRTY_LIST, *CODES])}, {VEHICLE} FROM train"
DIRTY_TEST_SQL = f"SELECT row_id, {', '.join([*_DIRTY_LIST, *[c if c != 'P0406' else '0 AS P0406' for c in CODES]])}, {VEHICLE} FROM test"


def dirty_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train(spark, sf_dir).selectExpr("row_id", *_DIRTY_LIST, *CODES, VEHICLE)


def dirty_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return test(spark, sf_dir).selectExpr("row_id", *_DIRTY_LIST, *[c for c in CODES if c != "P0406"], VEHICLE)


# Incidents as they arrive: the test observations as text, with one of sixteen defects or variants each.
_TEXT_VALUES = {
    "LOAD_PCT": "CASE WHEN row_id % 16 = 2 THEN CASE WHEN row_id % 32 = 2 THEN 'nan' ELSE concat(chr(9), '-inf') END ELSE CAST(LOAD_PCT AS STRING) END",
    "ECT": "CASE WHEN row_id % 16 IN (6, 10) THEN NULL ELSE CAST(ECT AS STRING) END",
    "RPM": "CASE WHEN row_id % 16 IN (5, 10) THEN 'INVALID' WHEN row_id % 16 = 0 THEN concat(' ', chr(10), CAST(RPM AS STRING), chr(9)) ELSE CAST(RPM AS STRING) END",
    "VSS": "CASE WHEN row_id % 16 = 1 THEN '7.9e2' ELSE CAST(VSS AS STRING) END",
}
_TEXT_MODE = """CASE WHEN row_id % 16 = 7 THEN 'INVALID_MODE' WHEN row_id % 16 = 8 THEN NULL WHEN row_id % 16 = 9 THEN '1.0'
  WHEN row_id % 16 = 15 THEN '99' ELSE CAST(Mode AS STRING) END"""


def _text_expressions() -> list[str]:
    out = []
    for s in SENSORS:
        value = _TEXT_VALUES.get(s, f"CAST({s} AS STRING)")
        out.append(f"CASE WHEN row_id % 16 = 11 THEN '999999' ELSE {value} END AS {s}")
    return [*out, f"{_TEXT_MODE} AS Mode"]


RAW_INCIDENTS_SQL = f"""
SELECT row_id AS incident_id, {', '.join(_text_expressions())},
  CASE row_id % 16 WHEN 3 THEN [] WHEN 4 THEN NULL WHEN 12 THEN ['P9999'] WHEN 13 THEN ['P0000'] WHEN 14 THEN ['P0403', 'P0403']
    ELSE {{active}} END AS active_dtcs
FROM test
"""


def raw_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test observation as a text incident, valid or with a defect."""
    case = F.col("row_id") % 16

    def codes(*values):
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    active = (
        F.when(case == 3, codes())
        .when(case == 4, F.lit(None))
        .when(case == 12, codes("P9999"))
        .when(case == 13, codes("P0000"))
        .when(case == 14, codes("P0403", "P0403"))
        .otherwise(active_codes(CODES))
    )
    return test(spark, sf_dir).select(
        F.col("row_id").alias("incident_id"), *[F.expr(e) for e in _text_expressions()], active.alias("active_dtcs")
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested knowledge entry for every document; texts come in one, several or no languages, lists may be absent."""
    doc = F.col("doc_id")
    source, lang = F.col("source"), F.col("category")

    def texts(*pairs):
        return F.create_map(*[c for k, v in pairs for c in (F.lit(k) if isinstance(k, str) else k, v)])

    empty_map = F.create_map().cast("map<string,string>")
    title = (
        F.when(doc % 4 == 0, texts(("fr", F.concat(F.lit("titre "), source)), ("en", F.concat(F.lit("title "), source))))
        .when(doc % 4 == 1, texts(("xx", F.concat(F.lit("T "), doc.cast("string")))))
        .when(doc % 4 == 2, empty_map)
    )
    components = F.when(doc % 3 == 0, F.array(source, lang)).when(doc % 3 == 1, F.array().cast("array<string>"))

    def cause(label):
        return F.struct(label.cast("map<string,string>").alias("label"))

    none = F.lit(None)
    causes = (
        F.when(doc % 5 == 0, F.array(cause(texts(("en", F.concat(F.lit("cause "), lang)))), cause(none)))
        .when(doc % 5 == 1, F.array(cause(texts(("fr", F.lit("usure")))), cause(texts(("en", F.lit("wear"))))))
        .when(doc % 5 == 2, F.array(cause(empty_map)))
        .when(doc % 5 == 3, F.array().cast("array<struct<label:map<string,string>>>"))
    )
    def field(present, name, value):
        return F.when(present, F.struct(F.lit(name).alias("key"), value.cast("string").alias("value")))

    repair = F.when(
        doc % 6 != 5,
        F.map_from_entries(
            F.array_compact(
                F.array(
                    field(doc % 2 == 0, "difficulty", F.lit("easy")),
                    field(doc % 3 != 2, "diy_possible", F.when(doc % 3 == 0, F.lit("True"))),
                    field(doc % 4 == 0, "estimated_cost_eur", doc),
                    field(doc % 10 < 10, "estimated_hours", F.lit("1.5")),
                    field(doc % 7 == 0, "parts", source),
                )
            )
        ),
    )
    flags = F.when(doc % 3 == 0, texts(("emissions", F.lit("True")), ("source", source))).when(doc % 3 == 1, empty_map)
    return knowledge(spark, sf_dir).select(
        "doc_id", source.alias("source_file"), doc.alias("position"), "code",
        F.when(doc % 9 != 8, F.col("category")).alias("category"), title.alias("title"),
        texts(("en", F.col("text"))).alias("description"), components.alias("affected_components"),
        causes.alias("common_causes"), repair.alias("repair"), flags.alias("flags"),
    )


# The flat fields of those entries, as one SQL text.
ENTRY_FIELDS_SQL = """
SELECT doc_id, source AS source_file, code, CASE WHEN doc_id % 9 <> 8 THEN category ELSE '' END AS category,
  CASE doc_id % 4 WHEN 0 THEN concat('title ', source) WHEN 1 THEN concat('T ', CAST(doc_id AS VARCHAR)) ELSE '' END AS title,
  text AS description,
  CASE WHEN doc_id % 3 = 0 THEN concat(source, ', ', category) ELSE 'None' END AS components_text,
  CASE doc_id % 5 WHEN 0 THEN concat('cause ', category) WHEN 1 THEN 'usure; wear' WHEN 2 THEN '' ELSE 'None' END AS causes_text,
  concat('Difficulty: ', CASE WHEN doc_id % 6 <> 5 AND doc_id % 2 = 0 THEN 'easy' ELSE 'Unknown' END,
    ', DIY Possible: ', CASE WHEN doc_id % 6 = 5 OR doc_id % 3 = 2 THEN 'Unknown' WHEN doc_id % 3 = 0 THEN 'True' ELSE 'None' END,
    ', Cost EUR: ', CASE WHEN doc_id % 6 <> 5 AND doc_id % 4 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'Unknown' END,
    ', Hours: ', CASE WHEN doc_id % 6 <> 5 THEN '1.5' ELSE 'Unknown' END) AS repair_text,
  CASE WHEN doc_id % 6 = 5 THEN '' ELSE concat(CASE WHEN doc_id % 2 = 0 THEN 'difficulty=easy|' ELSE '' END,
    CASE doc_id % 3 WHEN 0 THEN 'diy_possible=True|' WHEN 1 THEN 'diy_possible=None|' ELSE '' END,
    CASE WHEN doc_id % 4 = 0 THEN concat('estimated_cost_eur=', CAST(doc_id AS VARCHAR), '|') ELSE '' END, 'estimated_hours=1.5',
    CASE WHEN doc_id % 7 = 0 THEN concat('|parts=', source) ELSE '' END) END AS repair_fields,
  CASE WHEN doc_id % 3 = 0 THEN concat('emissions: True, source: ', source) ELSE 'None' END AS flags_text
FROM kb
"""

# Stand-in for a text encoder in SQL-checked queries: the digits of a code choose one of the given vectors.
CODE_VECTOR_SQL = "CAST(substr({code}, 2) AS INT) % (SELECT count(*) FROM embeddings)"


def code_encoder(spark: SparkSession, sf_dir: str):
    """Adds ``embedding`` to queries whose text is a code."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    total = vectors.count()

    def add(queries: DataFrame) -> DataFrame:
        digits = F.substring("query_text", 2, 10).cast("long") % F.lit(total)
        return queries.withColumn("vec_id", digits).join(vectors, "vec_id").drop("vec_id")

    return add
