"""Queries of the memory log."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.common import table
from quarryline.operators import memory_log as M

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _samples(spark, d):
    return M.parsed(table(spark, d, "memory_samples"))


_NUMBERS = ", ".join(f"round(TRY_CAST(raw->>'{p}' AS DOUBLE))::BIGINT AS {n}" for n, p in M.FIGURES.items())
_S = f"""WITH lines AS (SELECT path, line_no, min(CASE WHEN json_valid(raw) AND starts_with(raw, '{{') THEN raw END) AS raw FROM memory_samples GROUP BY 1, 2),
x AS (SELECT path, line_no, raw::JSON AS raw, CASE WHEN contains(path, 'server-') THEN 'server' ELSE 'client' END AS target FROM lines WHERE raw IS NOT NULL),
s AS (SELECT path, line_no, coalesce(round(TRY_CAST(raw->>'$.timestamp_ms' AS DOUBLE))::BIGINT, 0) AS at_ms, target, coalesce(nullif(CASE WHEN target = 'server' THEN raw->>'$.server.id' ELSE raw->>'$.client.client_instance_id' END, ''), 'legacy') AS instance,
 coalesce(raw->>'$.kind', 'process') AS kind, raw->>'$.trigger.category' AS category, {_NUMBERS} FROM x)
"""
_W = "(PARTITION BY target, instance ORDER BY at_ms, path, line_no)"
_AT = "{at_ms: at_ms, path: path, line_no: line_no}"


@query(_S + "SELECT coalesce(category, kind) AS category, count(*) AS samples FROM s GROUP BY 1")
def memory_categories(spark, d):
    return _samples(spark, d).groupBy(F.coalesce("category", "kind").alias("category")).agg(F.count("*").alias("samples"))


@query(_S + "SELECT target, instance, count(*) AS samples, min(at_ms) AS first_at, max(at_ms) AS last_at, max(at_ms) - min(at_ms) AS duration_ms, count(DISTINCT kind) AS kinds FROM s GROUP BY 1, 2")
def memory_inventory(spark, d):
    return M.inventory(_samples(spark, d))


@query(_S + "SELECT path, line_no, target, instance, pss FROM s JOIN (SELECT target, instance FROM (SELECT target, instance, max(at_ms) AS last FROM s GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY target ORDER BY last DESC, instance DESC) = 1) USING (target, instance)")
def memory_latest(spark, d):
    """All samples of the latest process lifetime of each target."""
    return M.latest_instances(_samples(spark, d)).select("path", "line_no", "target", "instance", "pss")


_D = ("json_bytes", "payload_bytes", "result_bytes", "blob_bytes", "live")


@query(_S + f", a AS (SELECT * FROM s WHERE live IS NOT NULL OR json_bytes IS NOT NULL) SELECT * FROM (SELECT target, instance, path, line_no, at_ms, lag(at_ms) OVER {_W} AS before, {', '.join(f'coalesce({c}, 0) - lag(coalesce({c}, 0)) OVER {_W} AS d_{c}' for c in _D)} FROM a) WHERE before IS NOT NULL")
def memory_deltas(spark, d):
    return M.deltas(_samples(spark, d).where("live IS NOT NULL OR json_bytes IS NOT NULL"), list(_D))


@query(_S + f"SELECT * FROM (SELECT target, instance, path, line_no, at_ms, pss - lag(pss) OVER {_W} AS delta FROM s WHERE pss IS NOT NULL) WHERE abs(delta) >= 33554432")
def memory_spikes(spark, d):
    return M.spikes(_samples(spark, d), 32 * M.MB)


_P = f"""p AS (SELECT target, instance, count(*) AS samples, arg_min(pss, {_AT}) AS first_pss, arg_max(pss, {_AT}) AS final_pss, max(pss) AS peak_pss, arg_max({_AT.replace('path: path, line_no: line_no', 'category: category')}, {{pss: pss, at_ms: -at_ms}}) AS peak,
 arg_max({{v: allocated}}, {_AT}).v AS final_allocated FROM s WHERE pss IS NOT NULL GROUP BY 1, 2)"""


@query(_S + f", {_P} SELECT target, instance, samples, first_pss, final_pss, peak_pss, final_allocated, final_pss - first_pss AS net_growth, peak_pss - first_pss AS peak_growth, peak.at_ms AS peak_at, peak.category AS peak_category FROM p")
def memory_processes(spark, d):
    return M.process_summary(_samples(spark, d))


_ROW = "{live: live, allocated: allocated, connected: connected}"
_N = f"""n AS (SELECT target, instance, a.live AS first_live, b.live AS final_live, peak_live, b.live - a.live AS added, b.connected AS connected, CASE WHEN b.connected IS NOT NULL THEN greatest(0, b.live - b.connected) END AS detached,
 b.allocated - a.allocated AS allocator_growth, CASE WHEN b.allocated - a.allocated IS NOT NULL AND b.live > a.live THEN greatest(0, b.allocated - a.allocated) // (b.live - a.live) END AS growth_per_session
 FROM (SELECT target, instance, arg_min({_ROW}, {_AT}) AS a, arg_max({_ROW}, {_AT}) AS b, max(live) AS peak_live FROM s WHERE live IS NOT NULL GROUP BY 1, 2))"""


@query(_S + f", {_N} SELECT * FROM n")
def memory_population(spark, d):
    return M.population(_samples(spark, d))


_C = f"""c AS (SELECT target, instance, z.* FROM (SELECT target, instance, arg_max({{pss: pss, pss_file: pss_file, stack: stack, allocated: allocated, retained: retained, attributed: attributed}}, {_AT}) AS z FROM s WHERE live IS NOT NULL OR attributed IS NOT NULL GROUP BY 1, 2)),
e AS (SELECT target, instance, pss, allocated, attributed, retained, coalesce(attributed, 0) + coalesce(retained, 0) + coalesce(pss_file, 0) + coalesce(stack, 0) AS total FROM (SELECT target, instance, z.pss AS pss, z.pss_file AS pss_file, z.stack AS stack, z.allocated AS allocated, z.retained AS retained, z.attributed AS attributed FROM (SELECT target, instance, arg_max({{pss: pss, pss_file: pss_file, stack: stack, allocated: allocated, retained: retained, attributed: attributed}}, {_AT}) AS z FROM s WHERE live IS NOT NULL OR attributed IS NOT NULL GROUP BY 1, 2)))"""
_C = "e AS" + _C.split("e AS", 1)[1]


@query(_S + f""", {_C} SELECT target, instance, pss, allocated, attributed, retained, CASE WHEN attributed IS NOT NULL AND allocated IS NOT NULL THEN greatest(0, allocated - attributed) END AS unattributed,
 CASE WHEN attributed IS NOT NULL AND pss IS NOT NULL THEN coalesce(round(attributed / nullif(pss, 0), 4), 0) END AS share_of_pss, CASE WHEN attributed IS NOT NULL AND allocated IS NOT NULL THEN coalesce(round(attributed / nullif(allocated, 0), 4), 0) END AS share_of_heap,
 CASE WHEN pss IS NOT NULL THEN total END AS explained, CASE WHEN pss IS NOT NULL THEN greatest(0, pss - total) END AS unexplained, CASE WHEN pss IS NOT NULL THEN coalesce(round(total / nullif(pss, 0), 4), 0) END AS explained_share FROM e""")
def memory_coverage(spark, d):
    return M.coverage(_samples(spark, d))


_MB = 1 << 20


@query(_S + f""", {_P}, {_N}, {_C} SELECT p.target, p.instance, CASE WHEN coalesce(final_live, 0) >= 128 AND (coalesce(added, 0) >= 64 OR coalesce(detached, 0) >= 128 OR coalesce(final_live >= greatest(128, connected * 16) AND connected IS NOT NULL, false)) THEN 'runaway_live_session_population'
 WHEN coalesce(retained, 0) >= {256 * _MB} AND final_pss > 0 AND retained * 4 >= final_pss THEN 'allocator_retention' WHEN coalesce(allocated, 0) > 0 AND coalesce(attributed, 0) >= {512 * _MB} AND attributed * 2 >= allocated THEN 'session_payload_growth'
 WHEN coalesce(allocated, 0) >= {1024 * _MB} THEN 'unattributed_live_heap' WHEN final_pss >= {1024 * _MB} THEN 'non_heap_or_mapping_growth' ELSE 'within_normal_operating_range' END AS cause,
 CASE WHEN final_pss >= {2048 * _MB} OR final_pss - first_pss >= {1024 * _MB} OR coalesce(final_live, 0) >= 512 THEN 'critical' WHEN final_pss >= {1024 * _MB} OR final_pss - first_pss >= {256 * _MB} OR coalesce(final_live, 0) >= 128 THEN 'warning' ELSE 'healthy' END AS severity
FROM p LEFT JOIN n USING (target, instance) LEFT JOIN e USING (target, instance)""")
def memory_assessment(spark, d):
    return M.assessment(_samples(spark, d))


@query("""WITH t AS (SELECT record_id, session_id, json_bytes, provider, model FROM p1), b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY json_bytes DESC, record_id) AS k FROM t WHERE coalesce(session_id, '') <> '')
SELECT session_id, json_bytes AS peak_bytes, provider, model, record_id FROM b WHERE k = 1""")
def memory_session_peaks(spark, d):
    """The sample in which each session was largest, with its provider and model there."""
    from quarryline.plans import pipeline

    s = pipeline.QUERIES["p1_sessions"](spark, d).where("coalesce(session_id, '') <> ''").withColumn("json_bytes", F.coalesce("json_bytes", F.lit(0)))
    best = F.min(F.struct((-F.col("json_bytes")).alias("v"), "record_id", "provider", "model"))
    return s.groupBy("session_id").agg(best.alias("b")).select("session_id", (-F.col("b.v")).alias("peak_bytes"), "b.provider", "b.model", "b.record_id")


def _peaks_sql() -> str:
    from quarryline.plans import pipeline

    return SQL["memory_session_peaks"].replace("FROM p1)", f"FROM (SELECT * REPLACE (coalesce(json_bytes, 0) AS json_bytes) FROM ({pipeline.SQL['p1_sessions']})))")


SQL["memory_session_peaks"] = _peaks_sql()


def _clients_sql() -> str:
    from quarryline.plans import pipeline

    return f"SELECT client_instance_id, max(connected_ms) AS longest_ms, arg_max(record_id, {{ms: connected_ms, id: -record_id}}) AS record_id, count(*) AS seen FROM ({pipeline.SQL['p1_clients']}) WHERE connected_ms IS NOT NULL AND client_instance_id IS NOT NULL GROUP BY 1"


@query(_clients_sql())
def memory_client_peaks(spark, d):
    """The sample that saw each client connected longest."""
    from quarryline.plans import pipeline

    c = pipeline.QUERIES["p1_clients"](spark, d).where("connected_ms IS NOT NULL AND client_instance_id IS NOT NULL")
    return c.groupBy("client_instance_id").agg(F.max("connected_ms").alias("longest_ms"), F.max_by("record_id", F.struct("connected_ms", -F.col("record_id"))).alias("record_id"), F.count("*").alias("seen"))
