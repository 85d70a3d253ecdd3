"""Queries of the general data-preparation problems 1, 2, 3 and 6, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.common import table
from quarryline.operators import nested_records, orphan_refs, schema_drift
from quarryline.operators.entity_features import entity_features, event_types, first_stored


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_records.array_cases(table(spark, sf_dir, "memory_samples"), "sample_id", "raw")


def p1_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_records.samples(table(spark, sf_dir, "memory_samples"), "sample_id", "raw")


def p1_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_records.occurrences(table(spark, sf_dir, "memory_samples"), "sample_id", "raw")


def p1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_records.nodes(table(spark, sf_dir, "memory_samples"), "sample_id", "raw")


#: Objects of a memory sample that become tables: path and typed fields.
TABLES = {
    "sessions": (
        "sessions.top_by_json_bytes",
        dict.fromkeys(("session_id", "provider", "model"), "string")
        | {"memory_enabled": "boolean"}
        | dict.fromkeys(("message_count", "json_bytes", "payload_text_bytes", "provider_cache_json_bytes", "tool_result_bytes", "large_blob_bytes"), "long"),
    ),
    "clients": ("clients.items", {"client_instance_id": "string", "connected_ms": "long"}),
    "allocators": ("process.allocator.stats", dict.fromkeys(("allocated_bytes", "retained_bytes", "resident_bytes"), "long")),
    "totals": ("totals", {"total_attributed_bytes": "long"}),
}


def _table_of(name: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nested_records.flat_table(table(spark, sf_dir, "memory_samples"), "sample_id", "raw", *TABLES[name]).drop("node_id", "parent_node_id")

    return f


def _unquoted(x: str) -> str:
    """JSON text inside a JSON value read as if it weren't quoted."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid(trim({x}->>'$')) AND left(trim({x}->>'$'), 1) IN ('{{', '[') THEN trim({x}->>'$')::JSON ELSE {x} END"


def _table_sql(name: str) -> str:
    path, columns = TABLES[name]
    steps = path.split(".")
    sql = "WITH s0 AS (SELECT sample_id, CASE WHEN json_valid(ltrim(raw, chr(65279))) THEN ltrim(raw, chr(65279))::JSON END AS v FROM memory_samples), r0 AS (SELECT sample_id, " + _unquoted("v") + " AS v FROM s0)"
    for i, k in enumerate(steps, 1):
        sql += f", s{i} AS (SELECT sample_id, v->'$.{k}' AS v FROM r{i - 1} WHERE json_type(v) = 'OBJECT'), r{i} AS (SELECT sample_id, {_unquoted('v')} AS v FROM s{i})"
    last = f"r{len(steps)}"
    cast = {"long": "round(TRY_CAST({} AS DOUBLE))::BIGINT", "boolean": "TRY_CAST({} AS BOOLEAN)", "string": "{}"}
    typed = ", ".join(f"{cast[k].format(f'(o->>' + chr(39) + '$.' + n + chr(39) + ')')} AS {n}" for n, k in columns.items())
    if name in ("sessions", "clients"):
        items = f"(SELECT sample_id, i - 1 AS ordinal, {_unquoted('o')} AS o FROM (SELECT sample_id, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN v::JSON[] WHEN json_type(v) = 'OBJECT' THEN [v] END) AS o, generate_subscripts(CASE WHEN json_type(v) = 'ARRAY' THEN v::JSON[] WHEN json_type(v) = 'OBJECT' THEN [v] END, 1) AS i FROM {last}))"
        return f"{sql} SELECT sample_id AS record_id, '' AS parent_path, '{path}[' || ordinal || ']' AS child_path, ordinal::INT AS ordinal, {typed} FROM {items} WHERE json_type(o) = 'OBJECT'"
    return f"{sql} SELECT sample_id AS record_id, '' AS parent_path, '{path}' AS child_path, -1 AS ordinal, {typed} FROM (SELECT sample_id, v AS o FROM {last}) WHERE json_type(o) = 'OBJECT'"


_RECORDS = "recs AS (SELECT sample_id, " + _unquoted("v") + " AS v FROM (SELECT sample_id, CASE WHEN json_valid(ltrim(raw, chr(65279))) THEN ltrim(raw, chr(65279))::JSON END AS v FROM memory_samples))"
#: Children of a JSON value: key (null in arrays), position, value.
_CHILDREN = """unnest(CASE json_type(v) WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: {k: k, i: 0, c: json_extract(v, '$."' || k || '"')})
 WHEN 'ARRAY' THEN list_transform(json_extract(v, '$[*]'), lambda c, i: {k: NULL::VARCHAR, i: i - 1, c: c}) END)"""
P1_FOUND = f"""
WITH RECURSIVE {_RECORDS}, kinds(field, v, inside) AS (
  SELECT '', v, false FROM recs WHERE json_type(v) = 'OBJECT'
  UNION ALL
  SELECT CASE WHEN x.k IS NULL THEN field WHEN field = '' THEN x.k ELSE field || '.' || x.k END, {_unquoted("x.c")}, x.k IS NULL
  FROM (SELECT field, {_CHILDREN} AS x FROM kinds WHERE json_type(v) IN ('OBJECT', 'ARRAY'))
), lists AS (
  SELECT DISTINCT field FROM kinds WHERE inside AND json_type(v) = 'OBJECT'
), walk(sample_id, path, around, field, v, found) AS (
  SELECT sample_id, '', '', '', v, false FROM recs WHERE json_type(v) = 'OBJECT'
  UNION ALL
  SELECT sample_id, CASE WHEN lone THEN path || '[0]' ELSE path END, around, field, v, lone OR (k IS NULL AND json_type(v) = 'OBJECT')
  FROM (
    SELECT *, k IS NOT NULL AND json_type(v) = 'OBJECT' AND field IN (SELECT field FROM lists) AS lone
    FROM (
      SELECT sample_id, x.k AS k, CASE WHEN x.k IS NULL THEN path || '[' || x.i || ']' WHEN path = '' THEN x.k ELSE path || '.' || x.k END AS path,
             CASE WHEN found THEN path ELSE around END AS around, CASE WHEN x.k IS NULL THEN field WHEN field = '' THEN x.k ELSE field || '.' || x.k END AS field, {_unquoted("x.c")} AS v
      FROM (SELECT *, {_CHILDREN} AS x FROM walk WHERE json_type(v) IN ('OBJECT', 'ARRAY'))
    )
  )
)
SELECT sample_id, around AS parent_path, path AS child_path FROM walk WHERE found
"""


#: Every object of a record is an occurrence; each names a node.
P1_CHECKS = P1_FOUND.rsplit("SELECT sample_id, around", 1)[0] + "SELECT sample_id AS record_id, count(*) AS objects, count(*) FILTER (found) AS elements, 0::BIGINT AS dangling FROM walk WHERE json_type(v) = 'OBJECT' GROUP BY 1"


def p1_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each record: its objects in the bridge, those in arrays, and those whose node or parent node isn't stored."""
    m = table(spark, sf_dir, "memory_samples")
    rows = nested_records.occurrences(m, "sample_id", "raw").select("record_id", "in_array", "node_id", "parent_node_id")
    stored = nested_records.nodes(m, "sample_id", "raw").select(F.col("node_id").alias("id"), F.lit(1).alias("there"))
    own = rows.join(stored.select(F.col("id").alias("node_id"), F.col("there").alias("own")), "node_id", "left").join(stored.select(F.col("id").alias("parent_node_id"), F.col("there").alias("up")), "parent_node_id", "left")
    lost = F.col("own").isNull() | (F.col("parent_node_id").isNotNull() & F.col("up").isNull())
    return own.groupBy("record_id").agg(F.count("*").alias("objects"), F.count_if("in_array").alias("elements"), F.count_if(lost).alias("dangling"))


P3_CHECKS = """
SELECT stream, feed, file_no, count(*) AS lines FROM raw_batches WHERE json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body END) = 'OBJECT' AND stream IN ('telemetry_events', 'transcript_uploads', 'memory_samples') GROUP BY ALL
"""


def p3_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each file in the unified tables: none of its readable lines may be missing."""
    out = None
    for name in ("telemetry_events", "transcript_uploads", "memory_samples"):
        own = _stream(name)(spark, sf_dir).groupBy("feed", "file_no").agg(F.count("*").alias("lines")).select(F.lit(name).alias("stream"), "feed", "file_no", "lines")
        out = own if out is None else out.unionByName(own)
    return out


def _samples_sql() -> str:
    """Leading figures of each record; a part that is JSON text is read as if it weren't quoted."""
    paths = {"rss_bytes": "process.rss_bytes", "pss_bytes": "process.os.pss_bytes", "allocated_bytes": "process.allocator.stats.allocated_bytes", "live_sessions": "sessions.live_count", "attributed_bytes": "totals.total_attributed_bytes", "timestamp_ms": "timestamp_ms"}
    steps: dict[str, str] = {"": "v"}
    sql, level = "WITH " + _RECORDS + ", o AS (SELECT sample_id, CASE WHEN json_type(v) = 'OBJECT' THEN v END AS v FROM recs)", 0
    objects = sorted({p.rsplit(".", i)[0] for p in paths.values() for i in range(1, p.count(".") + 1)}, key=lambda x: x.count("."))
    for name in objects:
        parent, _, key = name.rpartition(".")
        column, level = "o_" + name.replace(".", "_"), level + 1
        value = f"json_extract({steps[parent]}, '$.{key}')"
        sql = sql.replace("), o AS", "), o AS") + f", l{level} AS (SELECT *, {_unquoted(value)} AS {column} FROM {'o' if level == 1 else f'l{level - 1}'})"
        steps[name] = column
    number = lambda p: f"round(TRY_CAST(json_extract_string({steps[p.rpartition('.')[0]]}, '$.{p.rpartition('.')[2]}') AS DOUBLE))::BIGINT"
    text = lambda k: f"CASE WHEN json_type(v, '$.{k}') = 'VARCHAR' THEN v->>'$.{k}' END"
    fields = ", ".join(f"{number(p)} AS {n}" for n, p in paths.items())
    return f"{sql} SELECT sample_id AS record_id, v IS NOT NULL AS readable, {text('source')} AS source, {text('kind')} AS kind, {fields} FROM l{level}"


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    raw = table(spark, sf_dir, "telemetry_events")
    # Types come from one narrow scan of all rows, before resends are left out: a resend is of its event's type.
    types = event_types(raw, "event")
    return entity_features(first_stored(raw), "telemetry_id", "event", "created_at", ["tool_calls", "turns"], types), types


def p2_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir)[0]


def p2_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table by rows, an entity and event type each, with the entity's totals: what SQL can state."""
    wide, types = _features(spark, sf_dir)
    cells = F.array(*(F.struct(F.lit(t).alias("event"), F.col(f"`{t}_events`").alias("events"), F.col(f"`{t}_last`").alias("last")) for t in types))
    return wide.select("telemetry_id", "tool_calls_total", "turns_total", F.inline(F.filter(cells, lambda x: x["events"] > 0)))


P2_CELLS = """
WITH one AS (
  SELECT * FROM telemetry_events
  QUALIFY row_number() OVER (
    PARTITION BY CASE WHEN trim(coalesce(event_id, '')) = '' THEN 'row:' || id ELSE event_id END ORDER BY received_at, id) = 1
), totals AS (
  SELECT telemetry_id, coalesce(sum(tool_calls), 0)::BIGINT AS tool_calls_total, coalesce(sum(turns), 0)::BIGINT AS turns_total FROM one GROUP BY 1
), cells AS (
  SELECT telemetry_id, event, count(*) AS events, max(created_at) AS last FROM one WHERE event IS NOT NULL GROUP BY 1, 2
)
SELECT c.telemetry_id, tool_calls_total, turns_total, event, events, last FROM cells c JOIN totals t ON c.telemetry_id IS NOT DISTINCT FROM t.telemetry_id
"""


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.changes(table(spark, sf_dir, "raw_batches")).select("feed", "file_no", "change_type", "field_path", "new_path")


def p3_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.changes(table(spark, sf_dir, "raw_batches"))


def _stream(name: str):
    return lambda spark, sf_dir: schema_drift.unified_table(table(spark, sf_dir, "raw_batches"), name)


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "telemetry_events web_details install_details transcript_uploads deleted_keys".split()
    return orphan_refs.telemetry_orphans(*(table(spark, sf_dir, n) for n in names))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("table_name", "record_id", "ref_field", "ref_state").distinct()


def p6_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan records per table, field, state and day received; a record received on several days counts on each."""
    day = F.to_date("received_at").alias("period")
    rows = _orphans(spark, sf_dir).select("table_name", "ref_field", "ref_state", day, "record_id").distinct()
    return rows.groupBy("table_name", "ref_field", "ref_state", "period").agg(F.count("*").alias("orphans"))


def _key(c: str) -> str:
    bare = f"regexp_replace(translate(lower({c}), '{{}}- ' || chr(9) || chr(10) || chr(13) || chr(160), ''), '^urn:uuid:', '')"
    return f"CASE WHEN regexp_matches({bare}, '^[0-9a-f]{{32}}$') THEN {bare} ELSE nullif(trim({c}, ' ' || chr(9) || chr(10) || chr(13)), '') END"


P6_ROWS = f"""
WITH refs AS (
  SELECT 0 AS target, 'web_details' AS table_name, event_id AS record_id, 'event_id' AS ref_field, {_key("event_id")} AS key, received_at FROM web_details
  UNION ALL SELECT 0, 'install_details', event_id, 'event_id', {_key("event_id")}, received_at FROM install_details
  UNION ALL SELECT 1, 'install_details', event_id, 'conversion_id', {_key("conversion_id")}, received_at FROM install_details
  UNION ALL SELECT 2, 'transcript_uploads', upload_id, 'telemetry_id', {_key("telemetry_id")}, received_at FROM transcript_uploads
), parents AS (
  SELECT target, key, min(received_at) AS first_at FROM (
    SELECT 0 AS target, {_key("event_id")} AS key, received_at FROM telemetry_events
    UNION ALL SELECT 2, {_key("telemetry_id")}, received_at FROM telemetry_events
    UNION ALL SELECT 1, {_key("conversion_id")}, received_at FROM web_details)
  WHERE key IS NOT NULL GROUP BY target, key
), gone AS (
  SELECT DISTINCT CASE WHEN table_name = 'telemetry_events' AND key_column = 'event_id' THEN 0
                       WHEN table_name = 'web_details' AND key_column = 'conversion_id' THEN 1
                       WHEN table_name = 'telemetry_events' AND key_column = 'telemetry_id' THEN 2 END AS target,
         {_key("key_value")} AS key, 1 AS logged FROM deleted_keys
), judged AS (
  SELECT r.*, CASE WHEN p.key IS NULL THEN CASE WHEN g.logged = 1 THEN 'deleted' ELSE 'missing' END
                   WHEN p.first_at > r.received_at THEN 'late' END AS ref_state
  FROM refs r LEFT JOIN parents p ON p.target = r.target AND p.key = r.key LEFT JOIN gone g ON g.target = r.target AND g.key = r.key
  WHERE r.key IS NOT NULL
)
"""
P6_FOUND = P6_ROWS + "SELECT DISTINCT table_name, record_id, ref_field, ref_state FROM judged WHERE ref_state IS NOT NULL"
P6_BY_PERIOD = (
    P6_ROWS
    + """, days AS (SELECT DISTINCT table_name, ref_field, ref_state, received_at::DATE AS period, record_id FROM judged WHERE ref_state IS NOT NULL)
SELECT table_name, ref_field, ref_state, period, count(*) AS orphans FROM days GROUP BY ALL"""
)

QUERIES = {
    "p1_found": p1_found,
    "p1_samples": p1_samples,
    "p1_bridge": p1_bridge,
    "p1_nodes": p1_nodes,
    **{f"p1_{n}": _table_of(n) for n in TABLES},
    "p1_checks": p1_checks,
    "p2_features": p2_features,
    "p2_cells": p2_cells,
    "p3_found": p3_found,
    "p3_changes": p3_changes,
    "p3_checks": p3_checks,
    "p3_telemetry_events": _stream("telemetry_events"),
    "p3_transcript_uploads": _stream("transcript_uploads"),
    "p3_memory_samples": _stream("memory_samples"),
    "p6_found": p6_found,
    "p6_by_period": p6_by_period,
}
SQL = {"p1_found": P1_FOUND, "p1_checks": P1_CHECKS, "p3_checks": P3_CHECKS, "p1_samples": _samples_sql()} | {f"p1_{n}": _table_sql(n) for n in TABLES} | {"p2_cells": P2_CELLS, "p6_found": P6_FOUND, "p6_by_period": P6_BY_PERIOD}
