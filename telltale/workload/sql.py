"""SQL building blocks for the cross-checks: the fixture views and the tables derived from them."""

from __future__ import annotations

from telltale.fixtures import CODE_VECTOR_SQL, DIRTY_TEST_SQL, DIRTY_TRAIN_SQL, ENTRY_FIELDS_SQL, KNOWLEDGE_SQL, RAW_INCIDENTS_SQL, TELEMETRY_SQL
from telltale.schemas import CODES, DEFAULT_WEIGHTS, MODE, SENSORS

SENSOR_LIST = ", ".join(SENSORS)
CODE_LIST = ", ".join(CODES)
CONTENT = f"{SENSOR_LIST}, {MODE}, {CODE_LIST}"


def active_codes(prefix: str = "") -> str:
    flags = ", ".join(f"CASE WHEN {prefix}{c} = 1 THEN '{c}' END" for c in sorted(CODES))
    return f"list_filter([{flags}], lambda c: c IS NOT NULL)"


def signature(codes: str) -> str:
    return f"CASE WHEN len({codes}) = 0 THEN 'NONE' ELSE array_to_string(list_sort({codes}), '|') END"


_TABLES = {
    "telemetry": TELEMETRY_SQL,
    "kb": KNOWLEDGE_SQL,
    "train": "SELECT * FROM telemetry WHERE is_test = 0",
    "test": "SELECT * FROM telemetry WHERE is_test = 1",
    "kept": f"SELECT min(row_id) AS row_id, {CONTENT} FROM train GROUP BY {CONTENT}",
    "history": f"""SELECT *, {signature('active_dtcs')} AS dtc_signature FROM (
        SELECT row_number() OVER (ORDER BY row_id) - 1 AS historical_index, *, {active_codes()} AS active_dtcs FROM kept) k""",
    "incidents": f"""SELECT *, {signature('active_dtcs')} AS query_signature FROM (
        SELECT row_id AS incident_id, {CONTENT}, {active_codes()} AS active_dtcs FROM test) k""",
    "scaler": "SELECT "
    + ", ".join(
        f"avg({s}) AS m_{s}, CASE WHEN stddev_pop({s}) = 0 THEN 1.0 ELSE stddev_pop({s}) END AS s_{s}" for s in SENSORS
    )
    + " FROM kept",
    "zhistory": "SELECT h.*, " + ", ".join(f"(h.{s} - m_{s}) / s_{s} AS z_{s}" for s in SENSORS) + " FROM history h, scaler",
    "bands": "SELECT "
    + ", ".join(f"quantile_cont(z_{s}, 0.05) AS lo_{s}, quantile_cont(z_{s}, 0.95) AS hi_{s}" for s in SENSORS)
    + " FROM zhistory",
}
# Which tables a table reads.
_NEEDS = {
    "telemetry": [], "kb": [], "train": ["telemetry"], "test": ["telemetry"], "kept": ["train"], "history": ["kept"],
    "incidents": ["test"], "scaler": ["kept"], "zhistory": ["history", "scaler"], "bands": ["zhistory"],
}


def define(name: str, query: str, needs: list[str]) -> None:
    _TABLES[name], _NEEDS[name] = query, needs


def query(select: str, *needs: str) -> str:
    """``select`` with the derived tables it needs in front of it."""
    order: list[str] = []

    def visit(t):
        for n in _NEEDS[t]:
            visit(n)
        if t not in order:
            order.append(t)

    for t in needs:
        visit(t)
    ctes = ",\n".join(f"{t} AS MATERIALIZED ({_TABLES[t]})" for t in order)
    return f"WITH {ctes}\n{select}" if ctes else select


def top_pairs(k: int, weights: dict[str, float] | None = None, family: str = "") -> str:
    """(probe, rank, history row, scores) of the best ``k`` history rows per distinct incident content.

    The ranking key packs the score, rounded to nine digits, above the history index.
    """
    w = weights or DEFAULT_WEIGHTS
    distance = " + ".join(f"(p.z_{s} - h.z_{s}) * (p.z_{s} - h.z_{s})" for s in SENSORS)
    sensor = f"1.0 / (1.0 + sqrt({distance}))"
    mode = f"CAST(CASE WHEN p.{MODE} = h.{MODE} THEN 1 ELSE 0 END AS DOUBLE)"
    score = f"CAST({w['sensor']} AS DOUBLE) * ({sensor}) + CAST({w['dtc']} AS DOUBLE) * c.jaccard + CAST({w['mode']} AS DOUBLE) * ({mode})"
    return f"""
  SELECT p.probe, r.rank, h.historical_index, {score} AS similarity_score, {sensor} AS sensor_similarity,
         c.jaccard AS dtc_similarity, {mode} AS mode_similarity, h.dtc_signature, h.{MODE} AS history_mode,
         {', '.join('h.' + s for s in SENSORS)}
  FROM (SELECT probe, unnest(keys) % 8589934592 AS historical_index, unnest(range(1, len(keys) + 1)) AS rank FROM (
          SELECT p.probe, max(CAST(round(({score}) * 1e9) AS BIGINT) * 8589934592 + h.historical_index, {k}) AS keys
          FROM {family}probes p JOIN {family}code_pairs c ON c.q_sig = p.query_signature JOIN zhistory h ON h.dtc_signature = c.h_sig
          GROUP BY p.probe) k) r
  JOIN {family}probes p ON p.probe = r.probe JOIN zhistory h ON h.historical_index = r.historical_index
  JOIN {family}code_pairs c ON c.q_sig = p.query_signature AND c.h_sig = h.dtc_signature"""


def incident_family(family: str, base: str) -> None:
    """Define the tables that follow from an incident table ``base``, with ``family`` in front of their names."""
    zs = ", ".join(f"z_{s}" for s in SENSORS)
    finite = " AND ".join(f"isfinite({s})" for s in SENSORS)
    define(
        f"{family}zincidents",
        "SELECT i.*, " + ", ".join(f"(i.{s} - m_{s}) / s_{s} AS z_{s}" for s in SENSORS) + f" FROM {base} i, scaler WHERE {finite}",
        [base, "scaler"],
    )
    define(
        f"{family}probes",
        f"""SELECT min(incident_id) AS probe, {zs}, {MODE}, query_signature, any_value(active_dtcs) AS active_dtcs
            FROM {family}zincidents GROUP BY {zs}, {MODE}, query_signature""",
        [f"{family}zincidents"],
    )
    define(
        f"{family}code_pairs",
        f"""SELECT q.sig AS q_sig, h.sig AS h_sig,
              CAST(CASE WHEN len(q.codes) = 0 THEN CASE WHEN len(h.codes) = 0 OR h.codes = ['P0000'] THEN 1.0 ELSE 0.0 END
                WHEN len(h.codes) = 0 THEN 0.0
                ELSE CAST(len(list_distinct(list_intersect(q.codes, h.codes))) AS DOUBLE) / len(list_distinct(list_concat(q.codes, h.codes))) END AS DOUBLE) AS jaccard
            FROM (SELECT DISTINCT query_signature AS sig, active_dtcs AS codes FROM {base}) q,
                 (SELECT DISTINCT dtc_signature AS sig, active_dtcs AS codes FROM history) h""",
        [base, "history"],
    )
    same = " AND ".join([f"p.z_{s} = i.z_{s}" for s in SENSORS] + [f"p.{MODE} = i.{MODE}", "p.query_signature = i.query_signature"])
    define(
        f"{family}probe_of",
        f"SELECT i.incident_id, p.probe FROM {family}zincidents i JOIN {family}probes p ON {same}",
        [f"{family}zincidents", f"{family}probes"],
    )
    define(f"{family}top5", top_pairs(5, family=family), [f"{family}probes", f"{family}code_pairs", "zhistory"])
    define(
        f"{family}case_list",
        f"""SELECT o.incident_id, count(*) AS n, max(t.similarity_score) AS top_score,
              string_agg(CAST(t.historical_index AS VARCHAR), ',' ORDER BY t.rank) AS cases, bool_or(t.dtc_signature = i.query_signature) AS same_signature
            FROM {family}probe_of o JOIN {family}top5 t ON t.probe = o.probe JOIN {base} i ON i.incident_id = o.incident_id GROUP BY o.incident_id""",
        [f"{family}probe_of", f"{family}top5", base],
    )


incident_family("", "incidents")
define("raw_incidents", RAW_INCIDENTS_SQL.replace("{active}", active_codes()), ["test"])
FLOAT_FORM = r"'^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|nan|inf|infinity)\s*$'"


def parsed(column: str) -> str:
    return f"CASE WHEN regexp_matches(lower({column}), {FLOAT_FORM}) THEN TRY_CAST(regexp_replace({column}, '^\\s+|\\s+$', '', 'g') AS DOUBLE) END"


PARSED_MODE = r"CASE WHEN regexp_matches(Mode, '^\s*[+-]?[0-9]+\s*$') THEN TRY_CAST(trim(Mode) AS INTEGER) END"
_SENSOR_ERROR = ", ".join(
    f"CASE WHEN {s} IS NULL THEN 'Missing required sensor field: {s}' WHEN ({parsed(s)}) IS NULL THEN 'Sensor value {s} must be numeric.' END"
    for s in SENSORS
)
ANOMALY_ERROR = f"coalesce({_SENSOR_ERROR})"
INCIDENT_ERROR = f"coalesce({_SENSOR_ERROR}, CASE WHEN Mode IS NULL THEN 'Missing required field: Mode' WHEN ({PARSED_MODE}) IS NULL THEN 'Mode must be an integer.' END)"
SIMILARITY_ERROR = f"coalesce({_SENSOR_ERROR}, CASE WHEN Mode IS NULL THEN 'Missing required field: Mode' WHEN active_dtcs IS NULL THEN 'Missing required field: active_dtcs (list of strings)' END)"
define("dirty_train", DIRTY_TRAIN_SQL, ["train"])
define("dirty_test", DIRTY_TEST_SQL, ["test"])
DIRTY_CONTENT = f"{CONTENT}, vehicle"
define("dirty_kept", f"SELECT min(row_id) AS row_id, {DIRTY_CONTENT} FROM dirty_train GROUP BY {DIRTY_CONTENT}", ["dirty_train"])
_FINITE_ONLY = {s: f"CASE WHEN isfinite({s}) THEN {s} END" for s in SENSORS}
define("dirty_scaler", "SELECT " + ", ".join(
    f"avg({v}) AS m_{s}, CASE WHEN stddev_pop({v}) = 0 THEN 1.0 ELSE stddev_pop({v}) END AS s_{s}" for s, v in _FINITE_ONLY.items()) + " FROM dirty_kept", ["dirty_kept"])
define("dirty_history", f"""SELECT *, {signature('active_dtcs')} AS dtc_signature FROM (
    SELECT row_number() OVER (ORDER BY row_id) - 1 AS historical_index, *, {active_codes()} AS active_dtcs FROM dirty_kept) k""", ["dirty_kept"])
define("entry_fields", ENTRY_FIELDS_SQL, ["kb"])
define("kb_texts", """SELECT doc_id, concat('DTC: ', code, chr(10), 'Category: ', category, chr(10), 'Title: ', title, chr(10), 'Description: ', description, chr(10),
    'Affected Components: ', components_text, chr(10), 'Common Causes: ', causes_text, chr(10), 'Repair Information: ', repair_text, chr(10), 'Flags: ', flags_text) AS text_doc
  FROM entry_fields""", ["entry_fields"])


def word_counts(name: str, base: str, key: str, text: str, needs: list[str]) -> None:
    """Define ``name`` (key, d, n): how often each dimension occurs in a text."""
    define(name, f"""SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 512 AS d, count(*) AS n
      FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9_]+')) AS w FROM {base}) x GROUP BY ALL""", needs)


def unit_vectors(name: str, counts: str, key: str) -> None:
    """Define ``name`` (key, d, v) from word counts, weighted by rarity among the knowledge documents."""
    define(name, f"""SELECT {key}, d, CAST(w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS FLOAT) AS v
      FROM (SELECT c.{key}, c.d, c.n * r.rarity AS w FROM {counts} c JOIN rarity r ON r.d = c.d) x""", [counts, "rarity"])


word_counts("kb_counts", "kb_texts", "doc_id", "text_doc", ["kb_texts"])
define("rarity", """SELECT t.d, ln(((SELECT count(*) FROM kb_texts) + 1) / (count(c.doc_id) + 1)::DOUBLE) AS rarity
  FROM (SELECT unnest(range(512)) AS d) t LEFT JOIN kb_counts c ON c.d = t.d GROUP BY t.d""", ["kb_texts", "kb_counts"])
unit_vectors("kb_vectors", "kb_counts", "doc_id")
word_counts("text_counts", "documents", "doc_id", "text", [])
unit_vectors("text_vectors", "text_counts", "doc_id")
define("text_near", """SELECT q.doc_id AS query_id, k.doc_id, sum(q.v::DOUBLE * k.v) AS dot FROM text_vectors q JOIN kb_vectors k ON k.d = q.d GROUP BY ALL""", ["text_vectors", "kb_vectors"])
define("lookup", "SELECT upper(code) AS lookup_code, max(doc_id) AS doc_id FROM kb GROUP BY upper(code)", ["kb"])
define("vectors", "SELECT k.doc_id, upper(k.code) AS ucode, CAST(e.embedding AS DOUBLE[]) AS embedding FROM kb k JOIN embeddings e ON e.vec_id = k.doc_id", ["kb"])


def retrieval(name: str, queries: str, needs: list[str], k: int) -> None:
    """Define ``name``: hybrid retrieval for ``queries(query_id, query_text, embedding)``."""
    define(f"{name}_q", queries, needs)
    define(
        f"{name}_named",
        f"""SELECT query_id, code, min(pos) AS pos FROM (
              SELECT query_id, unnest(found) AS code, unnest(range(len(found))) AS pos FROM (
                SELECT query_id, regexp_extract_all(upper(query_text), '[PBUC][0-3][0-9]{{3}}') AS found FROM {name}_q) f) u GROUP BY query_id, code""",
        [f"{name}_q"],
    )
    define(f"{name}_exact", f"SELECT n.query_id, n.code, n.pos, l.doc_id FROM {name}_named n JOIN lookup l ON l.lookup_code = n.code", [f"{name}_named", "lookup"])
    define(
        f"{name}_near",
        f"""SELECT query_id, doc_id, ucode, d, r FROM (
              SELECT q.query_id, v.doc_id, v.ucode, power(list_distance(CAST(q.embedding AS DOUBLE[]), v.embedding), 2) AS d,
                row_number() OVER (PARTITION BY q.query_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), v.embedding), v.doc_id) AS r
              FROM {name}_q q, vectors v) x
            WHERE r <= {k} + (SELECT count(*) FROM {name}_exact e WHERE e.query_id = x.query_id)""",
        [f"{name}_q", f"{name}_exact", "vectors"],
    )
    define(
        name,
        f"""SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY match_type, o) AS position, match_type, doc_id, score FROM (
              SELECT query_id, 'EXACT' AS match_type, doc_id, CAST(NULL AS DOUBLE) AS score, pos AS o FROM {name}_exact
              UNION ALL
              SELECT query_id, 'SEMANTIC', doc_id, round(1.0 / (1.0 + d), 4), r FROM (
                SELECT *, row_number() OVER (PARTITION BY query_id, ucode ORDER BY r) AS c FROM {name}_near n
                WHERE NOT EXISTS (SELECT 1 FROM {name}_exact e WHERE e.query_id = n.query_id AND e.code = n.ucode)) s WHERE c = 1) m) p
            WHERE position <= {k}""",
        [f"{name}_exact", f"{name}_near"],
    )


HYBRID_TEXT = "concat('fault ', code, CASE WHEN doc_id % 3 = 1 THEN ' after P0403, p0562' WHEN doc_id % 3 = 2 THEN ' not P9999' ELSE '' END)"
retrieval("every", f"SELECT doc_id AS query_id, {HYBRID_TEXT} AS query_text, CAST(NULL AS DOUBLE[]) AS embedding FROM kb", ["kb"], 5)
retrieval(
    "hybrid",
    f"SELECT k.doc_id AS query_id, {HYBRID_TEXT} AS query_text, e.embedding FROM kb k JOIN embeddings e ON e.vec_id = k.doc_id % (SELECT count(*) FROM embeddings)",
    ["kb"], 5,
)


def code_hits(family: str, base: str) -> None:
    """Define the retrieval results of the codes of an incident table."""
    define(
        f"{family}incident_codes",
        f"""SELECT incident_id, pos, code FROM (SELECT incident_id, unnest(active_dtcs) AS code, unnest(range(len(active_dtcs))) AS pos FROM {base}) u
            WHERE code NOT IN ('P0000', 'NONE') AND trim(code) <> ''""",
        [base],
    )
    vector = CODE_VECTOR_SQL.format(code="c.code")
    retrieval(
        f"{family}codehits",
        f"""SELECT c.code AS query_id, c.code AS query_text, e.embedding FROM (SELECT DISTINCT code FROM {family}incident_codes) c
            JOIN embeddings e ON e.vec_id = {vector}""",
        [f"{family}incident_codes"], 3,
    )
    define(
        f"{family}matches",
        f"""SELECT incident_id, match_type, doc_id, score, min(pos * 100 + position) AS first FROM {family}incident_codes i
            JOIN {family}codehits h ON h.query_id = i.code GROUP BY incident_id, match_type, doc_id, score""",
        [f"{family}incident_codes", f"{family}codehits"],
    )
    define(
        f"{family}match_list",
        f"""SELECT incident_id, string_agg(code, ',' ORDER BY first) FILTER (WHERE match_type = 'EXACT') AS exact,
              string_agg(concat(code, ':', CAST(CAST(round(score * 10000) AS BIGINT) AS VARCHAR)), ',' ORDER BY first) FILTER (WHERE match_type = 'SEMANTIC') AS semantic
            FROM {family}matches m JOIN kb k ON k.doc_id = m.doc_id GROUP BY incident_id""",
        [f"{family}matches", "kb"],
    )


code_hits("", "incidents")
# The raw incidents that meet the contract, parsed.
define("raw_checked", f"SELECT *, {INCIDENT_ERROR} AS message FROM raw_incidents", ["raw_incidents"])
define(
    "raw_valid",
    f"""SELECT *, CASE WHEN len(active_dtcs) = 0 THEN 'NONE' ELSE array_to_string(list_sort(active_dtcs), '|') END AS query_signature FROM (
          SELECT incident_id, {', '.join(f'{parsed(s)} AS {s}' for s in SENSORS)}, {PARSED_MODE} AS Mode, coalesce(active_dtcs, []) AS active_dtcs
          FROM raw_checked WHERE message IS NULL) v""",
    ["raw_checked"],
)
incident_family("raw_", "raw_valid")
code_hits("raw_", "raw_valid")


# --- The isolation forest: every random choice is an MD5, so the trees can be grown and walked level by level. ---
_PRIME = 2**31 - 1
FOREST_DEPTH = 8
_SPLITTABLE = ", ".join(
    f"CASE WHEN max(z[{i + 1}]) > min(z[{i + 1}]) THEN {{'f': {i}, 'lo': min(z[{i + 1}]), 'hi': max(z[{i + 1}])}} END" for i in range(len(SENSORS))
)


def _md5(parts: str, digits: int) -> str:
    return f"CAST('0x' || substr(md5(concat({parts})), 1, {digits}) AS BIGINT)"


def _values(alias: str = "") -> str:
    return "[" + ", ".join(f"{alias}z_{s}" for s in SENSORS) + "]"


define(
    "forest_lots",
    "SELECT tree, " + ", ".join(f"1 + {_md5(f"'42:', tree, ':{x}'", 8)} % {_PRIME - 1} AS {x}" for x in "abc") + " FROM (SELECT unnest(range(100)) AS tree) t",
    [],
)
define("forest_hashed", f"SELECT historical_index, {_md5("'42:', historical_index", 15)} AS h FROM history", ["history"])
define(
    "forest_drawn",
    f"""SELECT tree, historical_index FROM (SELECT tree, historical_index, row_number() OVER (PARTITION BY tree ORDER BY
          (a * (h >> 30) + b * (h & 1073741823) + c) % {_PRIME}, historical_index) AS r FROM forest_hashed, forest_lots) d WHERE r <= 256""",
    ["forest_hashed", "forest_lots"],
)
define("forest_rows_0", f"SELECT tree, CAST(1 AS BIGINT) AS node, {_values()} AS z FROM forest_drawn JOIN zhistory USING (historical_index)", ["forest_drawn", "zhistory"])
for _level in range(FOREST_DEPTH + 1):
    define(
        f"forest_split_{_level}",
        f"""SELECT tree, node, n, s.f AS feature, CASE WHEN t >= s.hi THEN s.lo ELSE t END AS threshold FROM (
              SELECT *, s.lo + {_md5("'42:', tree, ':', node, ':split'", 12)} / 281474976710656.0::DOUBLE * (s.hi - s.lo) AS t FROM (
                SELECT tree, node, n, {"NULL" if _level == FOREST_DEPTH else f"CASE WHEN n > 1 AND len(open) > 0 THEN open[1 + CAST(floor({_md5("'42:', tree, ':', node, ':sensor'", 12)} / 281474976710656.0::DOUBLE * len(open)) AS INT)] END"}
                  {"::STRUCT(f INT, lo DOUBLE, hi DOUBLE)" if _level == FOREST_DEPTH else ""} AS s
                FROM (SELECT tree, node, count(*) AS n, list_filter([{_SPLITTABLE}], lambda x: x IS NOT NULL) AS open FROM forest_rows_{_level} GROUP BY tree, node) g) p) q""",
        [f"forest_rows_{_level}"],
    )
    if _level < FOREST_DEPTH:
        define(
            f"forest_rows_{_level + 1}",
            f"""SELECT tree, CASE WHEN z[feature + 1] <= threshold THEN 2 * node ELSE 2 * node + 1 END AS node, z
                FROM forest_rows_{_level} JOIN forest_split_{_level} USING (tree, node) WHERE feature IS NOT NULL""",
            [f"forest_rows_{_level}", f"forest_split_{_level}"],
        )
define(
    "forest_nodes",
    " UNION ALL ".join(f"SELECT *, {i} AS depth FROM forest_split_{i}" for i in range(FOREST_DEPTH + 1)),
    [f"forest_split_{i}" for i in range(FOREST_DEPTH + 1)],
)


def _average_path(n: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0.0::DOUBLE WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 2.0 * (ln({n} - 1) + 0.5772156649015329::DOUBLE) - 2.0 * ({n} - 1)::DOUBLE / {n} END"


def forest_scores(name: str, base: str, key: str) -> None:
    """Define ``name`` (key, score): each row of ``base`` walks down all trees, one level per join."""
    walk = f"SELECT {key}, t.tree, CAST(1 AS BIGINT) AS node FROM {base}, forest_lots t"
    for _ in range(FOREST_DEPTH):
        walk = f"""SELECT w.{key}, w.tree, CASE WHEN n.feature IS NULL THEN w.node WHEN v.z[n.feature + 1] <= n.threshold THEN 2 * w.node ELSE 2 * w.node + 1 END AS node
          FROM ({walk}) w JOIN forest_nodes n ON n.tree = w.tree AND n.node = w.node JOIN {name}_values v ON v.{key} = w.{key}"""
    define(f"{name}_values", f"SELECT {key}, {_values()} AS z FROM {base}", [base])
    define(
        name,
        f"""SELECT {key}, -pow(2.0::DOUBLE, -(sum(CAST(round((n.depth + {_average_path("n.n")}) * 1000000) AS BIGINT))::DOUBLE / 1000000 / 100) / ({_average_path("256")})) AS score
            FROM ({walk}) w JOIN forest_nodes n ON n.tree = w.tree AND n.node = w.node GROUP BY {key}""",
        [base, f"{name}_values", "forest_lots", "forest_nodes"],
    )


forest_scores("history_scores", "zhistory", "historical_index")
define("forest_offset", "SELECT quantile_cont(score, 0.01) AS cut FROM history_scores", ["history_scores"])
# One walk per distinct content of the incidents.
for _family in ("", "raw_"):
    forest_scores(f"{_family}probe_scores", f"{_family}probes", "probe")
    define(
        f"{_family}flags",
        f"""SELECT o.incident_id, s.score - cut < 0 AS anomaly, -(s.score - cut) AS margin FROM {_family}probe_of o JOIN {_family}probe_scores s ON s.probe = o.probe, forest_offset""",
        [f"{_family}probe_of", f"{_family}probe_scores", "forest_offset"],
    )
SEVERITY = "CASE WHEN {0} < 0 THEN 'normal' WHEN {0} < 0.1 THEN 'moderate' ELSE 'high' END"
