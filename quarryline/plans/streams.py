"""Streaming and source queries, each run over all files there are."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.common import shared_folder, table
from quarryline.plans.telemetry import REF, ROLLUP, ref_ts
from quarryline.sources import files as S
from quarryline.streaming import events as E

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _stream(spark, d):
    t = table(spark, d, "telemetry_events")
    return E.read(spark, f"{d}/telemetry_events*.parquet", t.schema)


@query("SELECT event_id, count(*) AS n FROM (SELECT DISTINCT event_id FROM telemetry_events) GROUP BY 1")
def stream_dedup(spark, d):
    out = E.run_once(E.deduplicated(_stream(spark, d).select("event_id", "received_at"), None), shared_folder(spark))
    return out.groupBy("event_id").agg(F.count("*").alias("n"))


@query(ROLLUP)
def stream_rollup(spark, d):
    return E.run_rollup(_stream(spark, d), shared_folder(spark))


@query("""WITH o AS (SELECT session_id, id, event, created_at, tool_calls, coalesce(event IN ('session_end', 'session_crash'), false) AS ends FROM telemetry_events),
b AS (SELECT *, coalesce(event = 'session_start', false) OR coalesce(lag(ends) OVER w, false) AS begins FROM o WINDOW w AS (PARTITION BY session_id ORDER BY created_at NULLS LAST, id)),
s AS (SELECT *, sum(begins::INT) OVER (PARTITION BY session_id ORDER BY created_at NULLS LAST, id ROWS UNBOUNDED PRECEDING) AS stretch FROM b),
p AS (SELECT session_id, stretch, count(*) AS events, count(*) FILTER (event = 'turn_end') AS turns, sum(coalesce(tool_calls, 0))::BIGINT AS tools, max(CASE WHEN ends THEN event END) AS closing, max(created_at) AS last FROM s GROUP BY 1, 2),
q AS (SELECT *, lead(stretch) OVER (PARTITION BY session_id ORDER BY stretch) IS NOT NULL AS more FROM p)
SELECT session_id, events, turns, tools, coalesce(closing, CASE WHEN more THEN 'superseded' WHEN coalesce(epoch_ms(last), 0) + 3600000 < (SELECT epoch_ms(max(created_at)) - 172800000 FROM telemetry_events) THEN 'silence' END) AS closed_by FROM q WHERE closed_by IS NOT NULL""")
def stream_sessions(spark, d):
    return E.run_sessions(_stream(spark, d), shared_folder(spark))




@query(f"SELECT event, count(*) AS expired FROM (SELECT event, date_diff('day', created_at::DATE, {REF}::DATE) AS age FROM telemetry_events) WHERE age > CASE event WHEN 'turn_end' THEN 30 WHEN 'session_start' THEN 90 WHEN 'session_end' THEN 90 WHEN 'session_crash' THEN 180 WHEN 'web_pageview' THEN 90 WHEN 'web_vital' THEN 30 WHEN 'web_error' THEN 90 WHEN 'install' THEN 1000000 WHEN 'feedback' THEN 365 ELSE 60 END GROUP BY 1")
def retention_expired(spark, d):
    e = table(spark, d, "telemetry_events")
    return E.expired(e, ref_ts(e)).groupBy("event").agg(F.count("*").alias("expired"))


@query("SELECT CASE WHEN event NOT IN ('session_start','session_end','turn_end') THEN 'unknown event' WHEN trim(coalesce(telemetry_id, '')) = '' THEN 'no id' END AS reason, count(*) AS n FROM telemetry_events GROUP BY 1 HAVING reason IS NOT NULL")
def rejected_events(spark, d):
    return E.validated(table(spark, d, "telemetry_events"), ["session_start", "session_end", "turn_end"])[1].groupBy("reason").agg(F.count("*").alias("n"))


@query(f"SELECT id, CASE WHEN date_diff('day', created_at::DATE, {REF}::DATE) > 90 THEN NULL ELSE telemetry_id END AS telemetry_id FROM telemetry_events WHERE event = 'install'")
def redacted_ids(spark, d):
    """The join key is nulled after 90 days."""
    e = table(spark, d, "telemetry_events")
    return e.where("event = 'install'").select("id", F.when(F.datediff(ref_ts(e), "created_at") <= 90, F.col("telemetry_id")).alias("telemetry_id"))


@query("SELECT telemetry_id, min(tool_calls) AS least, avg(tool_calls) AS mean, max(tool_calls) AS most, count(tool_calls) AS n FROM telemetry_events WHERE telemetry_id <> '' GROUP BY 1")
def running_triples(spark, d):
    e = table(spark, d, "telemetry_events").where("telemetry_id <> ''")
    return e.groupBy("telemetry_id").agg(F.min("tool_calls").alias("least"), F.avg("tool_calls").alias("mean"), F.max("tool_calls").alias("most"), F.count("tool_calls").alias("n"))


@query("SELECT upload_id, arg_max(byte_count, (received_at, created_at)) AS byte_count, max(received_at) AS received_at FROM transcript_uploads GROUP BY 1")
def latest_upload(spark, d):
    t = table(spark, d, "transcript_uploads").select("upload_id", "byte_count", "received_at", "created_at")
    return S.latest(t, "upload_id", F.struct("received_at", "created_at")).select("upload_id", "byte_count", "received_at")


@query("SELECT DISTINCT event_id FROM web_details WHERE event_id NOT IN (SELECT event_id FROM install_details WHERE event_id IS NOT NULL) AND event_id IS NOT NULL")
def insert_if_new(spark, d):
    return S.insert_new(table(spark, d, "install_details"), table(spark, d, "web_details").where("event_id IS NOT NULL").select("event_id"), "event_id")


@query("""SELECT session_id, turn, count(*) AS events, sum(coalesce(tool_calls, 0))::BIGINT AS tools, max(created_at) AS last_at FROM (SELECT *, coalesce(count(*) FILTER (event = 'turn_end') OVER (PARTITION BY session_id ORDER BY created_at NULLS LAST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn
FROM telemetry_events WHERE session_id IS NOT NULL) GROUP BY 1, 2""")
def turn_totals(spark, d):
    return E.turn_totals(table(spark, d, "telemetry_events"))


@query("""WITH k AS (SELECT telemetry_id, event, row_number() OVER (PARTITION BY telemetry_id ORDER BY created_at NULLS FIRST, id) AS nth FROM telemetry_events)
SELECT telemetry_id, string_agg(event, ',' ORDER BY nth) FILTER (nth <= 64) AS steps, max(nth) > 64 AS truncated FROM k GROUP BY 1""")
def bounded_traces(spark, d):
    return E.bounded_traces(table(spark, d, "telemetry_events"), "telemetry_id").select("telemetry_id", F.array_join("steps", ",").alias("steps"), "truncated")


_HALVED = "CASE event " + " ".join(f"WHEN '{k}' THEN {v // 2 if v else 'NULL'}" for k, v in E.RETENTION_DAYS.items()) + " ELSE 30 END"


@query(f"SELECT event, count(*) AS n FROM telemetry_events WHERE date_diff('day', created_at::DATE, {REF}::DATE) > {_HALVED} GROUP BY 1")
def emergency_prune(spark, d):
    """Rows to drop when the store is beyond its limit: all windows are halved."""
    e = table(spark, d, "telemetry_events")
    days = E.emergency_days(E.RETENTION_DAYS, 5_000_000_000, 4_500_000_000)
    return E.expired(e, ref_ts(e), days, 30).groupBy("event").agg(F.count("*").alias("n"))
