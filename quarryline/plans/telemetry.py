"""Event dashboards: active users, health, funnels, retention, web analytics. Time is the latest `received_at` of the data."""

from __future__ import annotations

import datetime
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.common import table
from quarryline.operators.rollups import ENDED, RELEASE, daily_rollup, flag, meaningful, merge_rollups

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def ev(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "telemetry_events")


def web(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "web_details")


_clocks: WeakKeyDictionary[DataFrame, datetime.datetime | None] = WeakKeyDictionary()


def ref_ts(events: DataFrame) -> Column:
    """The data's own clock, as a literal (so filters on it reach the scan); read once for a frame."""
    if events not in _clocks:
        _clocks[events] = events.agg(F.max("received_at")).first()[0]
    last = _clocks[events]
    return F.lit(last).cast("timestamp_ntz") if last else F.lit(None).cast("timestamp_ntz")


def since(events: DataFrame, days: int) -> Column:
    return F.col("created_at") > ref_ts(events) - F.expr(f"INTERVAL {days} DAYS")


def users(when: Column | None = None) -> Column:
    return F.countDistinct("telemetry_id" if when is None else F.when(when, F.col("telemetry_id")))


REF = "(SELECT max(received_at) FROM telemetry_events)"
REAL = "((event IN ('session_end','session_crash') AND (turns > 0 OR tool_calls > 0 OR duration_secs > 0)) OR (event = 'turn_end' AND tool_calls > 0))"
REL = "build_channel IN ('release','ci_release')"
ROLLUP = f"""
SELECT created_at::DATE AS activity_date, telemetry_id, min(created_at) AS first_seen_at, max(created_at) AS last_seen_at,
  max(CASE WHEN {REAL} THEN 1 ELSE 0 END) AS meaningful_active, max(CASE WHEN {REL} THEN 1 ELSE 0 END) AS release_active,
  max(CASE WHEN {REL} AND {REAL} THEN 1 ELSE 0 END) AS meaningful_release_active,
  sum(CASE WHEN event = 'session_start' THEN 1 ELSE 0 END) AS session_start_count, sum(CASE WHEN event = 'turn_end' THEN 1 ELSE 0 END) AS turn_end_count,
  sum(CASE WHEN event = 'session_end' THEN 1 ELSE 0 END) AS session_end_count, sum(CASE WHEN event = 'session_crash' THEN 1 ELSE 0 END) AS session_crash_count,
  max(is_ci) AS last_is_ci, max(build_channel) AS last_build_channel
FROM telemetry_events WHERE event IN ('session_start','turn_end','session_end','session_crash') GROUP BY 1, 2
"""


@query(f"SELECT activity_date, count(*) AS active, sum(meaningful_active) AS meaningful, sum(meaningful_release_active) AS meaningful_release, sum(turn_end_count) AS turns FROM ({ROLLUP}) GROUP BY 1")
def daily_active(spark, d):
    r = daily_rollup(ev(spark, d))
    return r.groupBy("activity_date").agg(F.count("*").alias("active"), F.sum("meaningful_active").alias("meaningful"), F.sum("meaningful_release_active").alias("meaningful_release"), F.sum("turn_end_count").alias("turns")).orderBy("activity_date")


@query(ROLLUP)
def activity_rollup(spark, d):
    return daily_rollup(ev(spark, d))


@query(ROLLUP)
def activity_rollup_merged(spark, d):
    """The rollup built in two increments and merged: equal to the one built at once."""
    e = ev(spark, d)
    odd = F.col("id") % 2 == 1
    return merge_rollups(daily_rollup(e.where(~odd)), daily_rollup(e.where(odd)))


def _window_users(spark, d, days):
    e = ev(spark, d)
    r = daily_rollup(e).where(F.col("activity_date") > F.to_date(ref_ts(e)) - F.expr(f"INTERVAL {days} DAYS"))
    # One row per id first: flags by max, then plain sums, instead of several distinct counts.
    per = r.groupBy("telemetry_id").agg(F.max("meaningful_active").alias("m"), F.max("meaningful_release_active").alias("r"), F.max(flag((F.col("meaningful_release_active") > 0) & (F.col("last_is_ci") == 0))).alias("n"))
    return per.agg(F.count("*").alias("raw"), F.coalesce(F.sum("m"), F.lit(0)).alias("meaningful"), F.coalesce(F.sum("r"), F.lit(0)).alias("meaningful_release"), F.coalesce(F.sum("n"), F.lit(0)).alias("meaningful_release_noci"))


def _window_sql(days):
    return f"""SELECT count(DISTINCT telemetry_id) AS raw, count(DISTINCT CASE WHEN meaningful_active > 0 THEN telemetry_id END) AS meaningful,
 count(DISTINCT CASE WHEN meaningful_release_active > 0 THEN telemetry_id END) AS meaningful_release,
 count(DISTINCT CASE WHEN meaningful_release_active > 0 AND last_is_ci = 0 THEN telemetry_id END) AS meaningful_release_noci
 FROM ({ROLLUP}) WHERE activity_date > {REF}::DATE - INTERVAL {days} DAYS"""


@query(_window_sql(7))
def weekly_active(spark, d):
    return _window_users(spark, d, 7)


@query(_window_sql(30))
def monthly_active(spark, d):
    return _window_users(spark, d, 30)


@query(f"""WITH p AS (SELECT {REF} AS r), x AS (SELECT e.*, r FROM telemetry_events e, p WHERE created_at >= date_trunc('day', r - INTERVAL 7 DAY) AND {REL} AND is_ci = 0)
SELECT round(100.0 * (epoch(r::TIMESTAMP) - epoch(date_trunc('day', r))) / 86400.0, 1) AS day_elapsed_pct, users_sofar, users_yday, users_7d,
 round(users_sofar / nullif(users_yday, 0)::DOUBLE, 2) AS pace_vs_yday, round(users_sofar / nullif(users_7d, 0)::DOUBLE, 2) AS pace_vs_7d
FROM p, (SELECT count(DISTINCT CASE WHEN created_at >= date_trunc('day', r) THEN telemetry_id END) AS users_sofar,
 count(DISTINCT CASE WHEN created_at >= date_trunc('day', r - INTERVAL 1 DAY) AND created_at <= r - INTERVAL 1 DAY THEN telemetry_id END) AS users_yday,
 count(DISTINCT CASE WHEN created_at >= date_trunc('day', r - INTERVAL 7 DAY) AND created_at <= r - INTERVAL 7 DAY THEN telemetry_id END) AS users_7d FROM x)""")
def dau_pace(spark, d):
    e = ev(spark, d)
    r = ref_ts(e)
    at = lambda days: r - F.expr(f"INTERVAL {days} DAYS")
    day = lambda days: F.date_trunc("day", at(days)).cast("timestamp_ntz")
    c = F.col("created_at")
    own = e.where((c >= day(7)) & F.col("build_channel").isin(*RELEASE) & (F.col("is_ci") == 0))
    per = own.groupBy("telemetry_id").agg(F.max(flag(c >= day(0))).alias("a"), F.max(flag((c >= day(1)) & (c <= at(1)))).alias("b"), F.max(flag((c >= day(7)) & (c <= at(7)))).alias("c"))
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0))
    one = per.agg(zero("a").alias("users_sofar"), zero("b").alias("users_yday"), zero("c").alias("users_7d"))
    ratio = lambda x: F.round(F.col("users_sofar") / F.nullif(F.col(x), F.lit(0)), 2)
    micros = F.unix_micros(r.cast("timestamp")) - F.unix_micros(F.date_trunc("day", r).cast("timestamp"))
    return one.select(F.round(100.0 * micros / 1e6 / 86400.0, 1).alias("day_elapsed_pct"), "users_sofar", "users_yday", "users_7d", ratio("users_yday").alias("pace_vs_yday"), ratio("users_7d").alias("pace_vs_7d"))


@query(f"SELECT count(DISTINCT telemetry_id) AS raw_wau, count(DISTINCT CASE WHEN {REAL} THEN telemetry_id END) AS meaningful_wau FROM telemetry_events WHERE event IN ('session_end','session_crash','turn_end') AND created_at > {REF} - INTERVAL 7 DAY")
def raw_vs_meaningful(spark, d):
    e = ev(spark, d)
    return e.where(F.col("event").isin("turn_end", *ENDED) & since(e, 7)).agg(users().alias("raw_wau"), users(meaningful()).alias("meaningful_wau"))


@query(f"SELECT provider_end, count(*) AS sessions FROM telemetry_events WHERE event = 'session_end' AND {REAL} GROUP BY 1")
def provider_mix(spark, d):
    return ev(spark, d).where((F.col("event") == "session_end") & meaningful()).groupBy("provider_end").agg(F.count("*").alias("sessions")).orderBy(F.desc("sessions"), "provider_end")


@query(f"SELECT avg(duration_secs) AS avg_secs, avg(turns) AS avg_turns FROM telemetry_events WHERE event = 'session_end' AND {REAL}")
def mean_duration(spark, d):
    return ev(spark, d).where((F.col("event") == "session_end") & meaningful()).agg(F.avg("duration_secs").alias("avg_secs"), F.avg("turns").alias("avg_turns"))


@query("SELECT count(CASE WHEN tool_failures > 0 THEN 1 END) AS tool_failed_sessions, count(CASE WHEN end_reason = 'provider_error' THEN 1 END) AS provider_failed_sessions, count(DISTINCT CASE WHEN tool_failures > 0 THEN telemetry_id END) AS tool_failed_users FROM telemetry_events WHERE event = 'session_end'")
def error_sessions(spark, d):
    return ev(spark, d).where("event = 'session_end'").agg(F.count(F.when(F.col("tool_failures") > 0, 1)).alias("tool_failed_sessions"), F.count(F.when(F.col("end_reason") == "provider_error", 1)).alias("provider_failed_sessions"), users(F.col("tool_failures") > 0).alias("tool_failed_users"))


def _counted(name, keys, where, sql_where):
    """Distinct ids per keys, one dashboard panel."""

    def f(spark, d):
        e = ev(spark, d)
        own = e.where(where(e)) if where else e
        return own.groupBy(*keys).agg(users().alias("users"), F.count("*").alias("events")).orderBy(F.desc("users"), *keys)

    QUERIES[name] = f
    SQL[name] = f"SELECT {', '.join(keys)}, count(DISTINCT telemetry_id) AS users, count(*) AS events FROM telemetry_events {'WHERE ' + sql_where if sql_where else ''} GROUP BY ALL"


_counted("version_adoption", ["version"], None, "")
_counted("os_arch", ["os", "arch"], None, "")
_counted("auth_activation", ["provider_end"], lambda e: F.col("event") == "auth_success", "event = 'auth_success'")
_counted("auth_failures", ["provider_end", "end_reason"], lambda e: (F.col("event") == "auth_failed") & since(e, 30), f"event = 'auth_failed' AND created_at > {REF} - INTERVAL 30 DAY")
_counted("onboarding_by_version", ["version"], lambda e: F.col("event") == "onboarding_step", "event = 'onboarding_step'")
_counted("channel_mix", ["build_channel"], lambda e: F.col("event").isin(*ENDED) & since(e, 30), f"event IN ('session_end','session_crash') AND created_at > {REF} - INTERVAL 30 DAY")
_counted("activations", ["model_end"], lambda e: (F.col("event") == "subscription_activated") & since(e, 30), f"event = 'subscription_activated' AND created_at > {REF} - INTERVAL 30 DAY")
_counted("router_errors", ["model_end", "provider_end"], lambda e: (F.col("event") == "subscription_router_error") & since(e, 7), f"event = 'subscription_router_error' AND created_at > {REF} - INTERVAL 7 DAY")
_counted("feature_events", ["event"], lambda e: F.col("event").startswith("command_") & since(e, 30), f"event LIKE 'command\\_%' ESCAPE '\\' AND created_at > {REF} - INTERVAL 30 DAY")


@query("SELECT telemetry_id, count(*) AS session_ends FROM telemetry_events WHERE event = 'session_end' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def heavy_ids(spark, d):
    return ev(spark, d).where("event = 'session_end'").groupBy("telemetry_id").agg(F.count("*").alias("session_ends")).orderBy(F.desc("session_ends"), "telemetry_id").limit(20)


@query("SELECT hour(created_at) AS hour_utc, isodow(created_at) - 1 AS weekday, count(*) AS sessions FROM telemetry_events WHERE event = 'session_start' GROUP BY ALL")
def starts_by_hour(spark, d):
    return ev(spark, d).where("event = 'session_start'").groupBy(F.hour("created_at").alias("hour_utc"), F.weekday("created_at").alias("weekday")).agg(F.count("*").alias("sessions"))


@query(f"SELECT avg(first_assistant_response_ms) AS avg_first_response_ms, avg(first_tool_call_ms) AS avg_first_tool_call_ms, avg(CASE WHEN tool_calls > 0 THEN duration_secs::DOUBLE / tool_calls END) AS avg_secs_per_tool FROM telemetry_events WHERE event IN ('session_end','session_crash') AND created_at > {REF} - INTERVAL 30 DAY")
def latency(spark, d):
    e = ev(spark, d)
    per = F.when(F.col("tool_calls") > 0, F.col("duration_secs").cast("double") / F.nullif("tool_calls", F.lit(0)))
    return e.where(F.col("event").isin(*ENDED) & since(e, 30)).agg(F.avg("first_assistant_response_ms").alias("avg_first_response_ms"), F.avg("first_tool_call_ms").alias("avg_first_tool_call_ms"), F.avg(per).alias("avg_secs_per_tool"))


@query(f"SELECT avg(first_assistant_response_ms) AS avg_turn_ms, avg(CASE WHEN tool_failures = 0 THEN 1.0 ELSE 0.0 END) AS clean_turn_rate FROM telemetry_events WHERE event = 'turn_end' AND created_at > {REF} - INTERVAL 30 DAY")
def turn_latency(spark, d):
    e = ev(spark, d)
    return e.where((F.col("event") == "turn_end") & since(e, 30)).agg(F.avg("first_assistant_response_ms").alias("avg_turn_ms"), F.avg(F.when(F.col("tool_failures") == 0, 1.0).otherwise(0.0)).alias("clean_turn_rate"))


@query(f"SELECT avg(CASE WHEN session_success > 0 THEN 1.0 ELSE 0.0 END) AS success_rate, avg(CASE WHEN first_assistant_response_ms IS NULL THEN 1.0 ELSE 0.0 END) AS no_response_rate FROM telemetry_events WHERE event IN ('session_end','session_crash') AND created_at > {REF} - INTERVAL 30 DAY")
def success_rate(spark, d):
    e = ev(spark, d)
    return e.where(F.col("event").isin(*ENDED) & since(e, 30)).agg(F.avg(F.when(F.col("session_success") > 0, 1.0).otherwise(0.0)).alias("success_rate"), F.avg(F.when(F.col("first_assistant_response_ms").isNull(), 1.0).otherwise(0.0)).alias("no_response_rate"))


@query(f"""WITH c AS (SELECT DISTINCT telemetry_id FROM telemetry_events WHERE event = 'install' AND created_at >= {REF} - INTERVAL 28 DAY AND created_at < {REF} - INTERVAL 14 DAY),
r AS (SELECT DISTINCT telemetry_id FROM telemetry_events WHERE event IN ('session_end','session_crash') AND created_at >= {REF} - INTERVAL 14 DAY)
SELECT (SELECT count(*) FROM c) AS cohort_users, (SELECT count(*) FROM c WHERE telemetry_id IN (SELECT telemetry_id FROM r)) AS retained_users""")
def retention(spark, d):
    e = ev(spark, d)
    r = ref_ts(e)
    at = F.col("created_at")
    cohort = e.where((F.col("event") == "install") & (at >= r - F.expr("INTERVAL 28 DAYS")) & (at < r - F.expr("INTERVAL 14 DAYS"))).select("telemetry_id").distinct()
    back = e.where(F.col("event").isin(*ENDED) & (at >= r - F.expr("INTERVAL 14 DAYS"))).select("telemetry_id").distinct().withColumn("back", F.lit(1))
    return cohort.join(back, "telemetry_id", "left").agg(F.count("*").alias("cohort_users"), F.count("back").alias("retained_users"))


@query("""WITH i AS (SELECT DISTINCT telemetry_id FROM telemetry_events WHERE event = 'install'), l AS (SELECT telemetry_id, count(*) AS n FROM telemetry_events WHERE event IN ('session_end','session_crash') GROUP BY 1),
s AS (SELECT DISTINCT telemetry_id FROM telemetry_events WHERE event = 'session_start'),
o AS (SELECT max(n) AS max_one_id, sum(CASE WHEN rn <= 5 THEN n ELSE 0 END) AS top5, sum(n) AS total FROM (SELECT n, row_number() OVER (ORDER BY n DESC, telemetry_id) AS rn FROM l))
SELECT (SELECT count(*) FROM i) AS install_ids, (SELECT count(*) FROM l) AS lifecycle_ids, (SELECT count(*) FROM s) AS session_start_ids,
 (SELECT count(*) FROM l ANTI JOIN i USING (telemetry_id)) AS lifecycle_ids_without_install, max_one_id, top5, total,
 (SELECT round(count(*) FILTER (event IN ('session_end','session_crash')) / nullif(count(*) FILTER (event = 'session_start'), 0)::DOUBLE, 3) FROM telemetry_events) AS lifecycle_completion FROM o""")
def health(spark, d):
    e = ev(spark, d)
    # One row per id with its flags and counts; the panels are sums over it.
    per = e.where(F.col("event").isin("install", "session_start", *ENDED)).groupBy("telemetry_id").agg(
        F.max(flag(F.col("event") == "install")).alias("installed"), F.sum(flag(F.col("event") == "session_start")).alias("starts"), F.sum(flag(F.col("event").isin(*ENDED))).alias("ends")
    )
    top = per.where("ends > 0").orderBy(F.desc("ends"), "telemetry_id").limit(5).agg(F.sum("ends").alias("top5"))
    one = per.agg(
        F.sum("installed").alias("install_ids"), F.sum(flag(F.col("ends") > 0)).alias("lifecycle_ids"), F.sum(flag(F.col("starts") > 0)).alias("session_start_ids"),
        F.sum(flag((F.col("ends") > 0) & (F.col("installed") == 0))).alias("lifecycle_ids_without_install"), F.max(F.when(F.col("ends") > 0, F.col("ends"))).alias("max_one_id"),
        F.sum("ends").alias("total"), F.round(F.sum("ends") / F.nullif(F.sum("starts"), F.lit(0)), 3).alias("lifecycle_completion"),
    )
    return one.crossJoin(top)  # two single rows


@query(f"""WITH i AS (SELECT telemetry_id FROM telemetry_events WHERE event = 'install' AND is_ci = 0), m AS (SELECT telemetry_id FROM ({ROLLUP}) WHERE meaningful_active > 0 AND last_is_ci = 0)
SELECT (SELECT count(*) FROM (SELECT telemetry_id FROM i UNION SELECT telemetry_id FROM m)) AS total_users, (SELECT count(DISTINCT telemetry_id) FROM m) AS core_users,
 (SELECT count(DISTINCT telemetry_id) FROM i) AS installed_users, (SELECT count(DISTINCT telemetry_id) FROM telemetry_events) AS all_ids, (SELECT count(DISTINCT telemetry_id) FROM telemetry_events WHERE is_ci = 1) AS ci_ids""")
def user_totals(spark, d):
    e = ev(spark, d)
    installed = e.where("event = 'install' AND is_ci = 0").select("telemetry_id").distinct()
    core = daily_rollup(e).where("meaningful_active > 0 AND last_is_ci = 0").select("telemetry_id").distinct()
    total = installed.union(core).distinct().agg(F.count("*").alias("total_users"))
    every = e.groupBy("telemetry_id").agg(F.max("is_ci").alias("ci")).agg(F.count("*").alias("all_ids"), F.coalesce(F.sum("ci"), F.lit(0)).alias("ci_ids"))
    count = lambda df, n: df.agg(F.count("*").alias(n))
    return total.crossJoin(count(core, "core_users")).crossJoin(count(installed, "installed_users")).crossJoin(every)


# -- web --------------------------------------------------------------------------------------------------------------


def _web(spark, d, event: str, days: int) -> DataFrame:
    e = ev(spark, d)
    own = e.where((F.col("event") == event) & since(e, days)).select("event_id", "telemetry_id", "session_id", "os", "arch", "created_at")
    return own.join(web(spark, d).drop("received_at"), "event_id")


def _wsql(event: str, days: int) -> str:
    return f"FROM telemetry_events e JOIN web_details w USING (event_id) WHERE e.event = '{event}' AND e.created_at > {REF} - INTERVAL {days} DAY"


@query(f"SELECT w.path, w.metric_name, w.rating, count(*) AS samples, avg(w.metric_value) AS avg_value {_wsql('web_vital', 30)} GROUP BY ALL")
def web_vitals(spark, d):
    return _web(spark, d, "web_vital", 30).groupBy("path", "metric_name", "rating").agg(F.count("*").alias("samples"), F.avg("metric_value").alias("avg_value"))


@query(f"SELECT w.path, w.error_kind, count(*) AS errors {_wsql('web_error', 90)} GROUP BY ALL")
def web_errors(spark, d):
    return _web(spark, d, "web_error", 90).groupBy("path", "error_kind").agg(F.count("*").alias("errors")).orderBy(F.desc("errors"), "path", "error_kind")


@query(f"SELECT e.created_at::DATE AS day, count(DISTINCT w.visitor_id) AS visitors, count(*) AS pageviews {_wsql('web_pageview', 30)} GROUP BY ALL")
def daily_visitors(spark, d):
    return _web(spark, d, "web_pageview", 30).groupBy(F.to_date("created_at").alias("day")).agg(F.countDistinct("visitor_id").alias("visitors"), F.count("*").alias("pageviews"))


@query(f"""WITH v AS (SELECT count(DISTINCT w.visitor_id) AS n {_wsql('web_pageview', 30)} AND w.path = '/pricing')
SELECT w.cta, count(DISTINCT w.visitor_id) AS clickers, any_value(n) AS pricing_viewers, round(count(DISTINCT w.visitor_id) / greatest(1, any_value(n))::DOUBLE, 4) AS click_through FROM telemetry_events e JOIN web_details w USING (event_id), v
WHERE e.event = 'web_cta_click' AND e.created_at > {REF} - INTERVAL 30 DAY AND w.path = '/pricing' GROUP BY w.cta""")
def pricing_clicks(spark, d):
    seen = _web(spark, d, "web_pageview", 30).where("path = '/pricing'").agg(F.countDistinct("visitor_id").alias("pricing_viewers"))
    clicks = _web(spark, d, "web_cta_click", 30).where("path = '/pricing'").groupBy("cta").agg(F.countDistinct("visitor_id").alias("clickers"))
    return clicks.crossJoin(seen).withColumn("click_through", F.round(F.col("clickers") / F.greatest(F.lit(1), "pricing_viewers"), 4))  # a single row


@query(f"SELECT w.utm_source, w.utm_medium, w.utm_campaign, count(DISTINCT w.visitor_id) AS visitors {_wsql('web_pageview', 30)} GROUP BY ALL")
def traffic_sources(spark, d):
    return _web(spark, d, "web_pageview", 30).groupBy("utm_source", "utm_medium", "utm_campaign").agg(F.countDistinct("visitor_id").alias("visitors"))


STAGES = {"command_copied": ("command_copy", "success"), "script_requested": ("script_request", "success"), "installer_started": ("installer_start", "success"), "installer_succeeded": ("installer_finish", "success"), "installer_failed": ("installer_finish", "failure"), "first_run": ("first_run", "success")}


def _intents(spark, d):
    first = lambda c, other: F.coalesce(F.min_by(c, F.struct("created_at", "event_id")), F.lit(other)).alias(c)
    return (
        _web(spark, d, "web_cta_click", 90).where("conversion_id IS NOT NULL").groupBy("conversion_id")
        .agg(F.min("created_at").alias("intent_at"), F.max("visitor_id").alias("visitor_id"), F.max("install_method").alias("install_method"), first("utm_source", "(direct)"), first("placement", "(unknown)"))
    )


def _stages(spark, d):
    e = ev(spark, d)
    own = e.where(since(e, 90)).select("event_id", "created_at", "os", "arch")
    rows = table(spark, d, "install_details").where("conversion_id IS NOT NULL").drop("received_at").join(own, "event_id")
    hit = {k: (F.col("stage") == s) & (F.col("outcome") == o) for k, (s, o) in STAGES.items()}
    return rows.groupBy("conversion_id").agg(
        *(F.max(flag(c)).alias(k) for k, c in hit.items()), F.min(F.when(hit["first_run"], F.col("created_at"))).alias("first_run_at"), F.max(F.when(F.col("stage") == "installer_start", F.col("os"))).alias("os")
    )


_INTENTS = f"""intents AS (SELECT conversion_id, min(e.created_at) AS intent_at, max(w.visitor_id) AS visitor_id, max(w.install_method) AS install_method,
 coalesce(arg_min_null(w.utm_source, (e.created_at, event_id)), '(direct)') AS utm_source FROM telemetry_events e JOIN web_details w USING (event_id)
 WHERE e.event = 'web_cta_click' AND e.created_at > {REF} - INTERVAL 90 DAY AND w.conversion_id IS NOT NULL GROUP BY 1)"""
_STAGES = f"""stages AS (SELECT conversion_id, {', '.join(f"max(CASE WHEN stage = '{s}' AND outcome = '{o}' THEN 1 ELSE 0 END) AS {k}" for k, (s, o) in STAGES.items())},
 min(CASE WHEN stage = 'first_run' AND outcome = 'success' THEN e.created_at END) AS first_run_at, max(CASE WHEN stage = 'installer_start' THEN os END) AS os
 FROM install_details i JOIN telemetry_events e USING (event_id) WHERE e.created_at > {REF} - INTERVAL 90 DAY AND conversion_id IS NOT NULL GROUP BY 1)"""


@query(f"""WITH {_INTENTS}, {_STAGES} SELECT count(*) AS intents, count(DISTINCT visitor_id) AS visitors, {', '.join(f'sum(coalesce({k}, 0))::BIGINT AS {k}' for k in STAGES)},
 round(avg((epoch_us(first_run_at) - epoch_us(intent_at)) / 3.6e9), 2) AS avg_hours_to_first_run, round(sum(coalesce(first_run, 0)) / greatest(1, count(DISTINCT visitor_id))::DOUBLE, 4) AS visitor_to_first_run,
 round(sum(coalesce(installer_succeeded, 0)) / greatest(1, sum(coalesce(installer_started, 0)))::DOUBLE, 4) AS installer_success FROM intents LEFT JOIN stages USING (conversion_id)""")
def install_funnel(spark, d):
    j = _intents(spark, d).join(_stages(spark, d), "conversion_id", "left")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    n = {k: F.sum(F.coalesce(k, F.lit(0))) for k in STAGES}
    return j.agg(
        F.count("*").alias("intents"), F.countDistinct("visitor_id").alias("visitors"), *(c.alias(k) for k, c in n.items()),
        F.round(F.avg((micros("first_run_at") - micros("intent_at")) / 3.6e9), 2).alias("avg_hours_to_first_run"),
        F.round(n["first_run"] / F.greatest(F.lit(1), F.countDistinct("visitor_id")), 4).alias("visitor_to_first_run"), F.round(n["installer_succeeded"] / F.greatest(F.lit(1), n["installer_started"]), 4).alias("installer_success"),
    )


@query(f"WITH {_INTENTS}, {_STAGES} SELECT utm_source, count(*) AS intents, sum(coalesce(first_run, 0))::BIGINT AS first_runs, round(sum(coalesce(first_run, 0)) / count(*)::DOUBLE, 4) AS intent_to_first_run FROM intents LEFT JOIN stages USING (conversion_id) GROUP BY 1")
def funnel_by_source(spark, d):
    j = _intents(spark, d).join(_stages(spark, d), "conversion_id", "left")
    runs = F.sum(F.coalesce("first_run", F.lit(0)))
    return j.groupBy("utm_source").agg(F.count("*").alias("intents"), runs.alias("first_runs"), F.round(runs / F.count("*"), 4).alias("intent_to_first_run"))


@query(f"WITH {_STAGES} SELECT coalesce(os, '(unknown)') AS os, sum(installer_started)::BIGINT AS started, sum(installer_succeeded)::BIGINT AS succeeded, sum(installer_failed)::BIGINT AS failed FROM stages GROUP BY 1")
def funnel_by_platform(spark, d):
    total = lambda a, b: F.sum(a).alias(b)
    return _stages(spark, d).groupBy(F.coalesce("os", F.lit("(unknown)")).alias("os")).agg(total("installer_started", "started"), total("installer_succeeded", "succeeded"), total("installer_failed", "failed"))


@query("SELECT coalesce(failure_stage, '(unknown)') AS failure_stage, coalesce(os, '(unknown)') AS os, count(*) AS attempts, count(DISTINCT conversion_id) AS conversions FROM install_details JOIN telemetry_events USING (event_id) WHERE stage = 'installer_finish' AND outcome = 'failure' AND conversion_id IS NOT NULL GROUP BY ALL")
def installer_failures(spark, d):
    rows = table(spark, d, "install_details").where("stage = 'installer_finish' AND outcome = 'failure' AND conversion_id IS NOT NULL").drop("received_at")
    unknown = lambda c: F.coalesce(c, F.lit("(unknown)")).alias(c)
    return rows.join(ev(spark, d).select("event_id", "os"), "event_id").groupBy(unknown("failure_stage"), unknown("os")).agg(F.count("*").alias("attempts"), F.countDistinct("conversion_id").alias("conversions"))


@query("""WITH links AS (SELECT DISTINCT telemetry_id, coalesce(provider_end, '?') AS account FROM telemetry_events WHERE event = 'auth_success'), days AS (""" + ROLLUP + """)
SELECT account, count(DISTINCT activity_date) AS active_days, sum(turn_end_count)::BIGINT AS turns FROM links JOIN days USING (telemetry_id) WHERE meaningful_active > 0 GROUP BY 1""")
def usage_per_account(spark, d):
    e = ev(spark, d)
    links = e.where("event = 'auth_success'").select("telemetry_id", F.coalesce("provider_end", F.lit("?")).alias("account")).distinct()
    return daily_rollup(e).where("meaningful_active > 0").join(links, "telemetry_id").groupBy("account").agg(F.countDistinct("activity_date").alias("active_days"), F.sum("turn_end_count").alias("turns"))


@query("SELECT n_name AS country, c_mktsegment AS segment, count(*) AS customers, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def country_rollup(spark, d):
    nation = F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_name"))  # 25 rows by definition
    c = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("n_name").alias("country"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("customers"), F.sum("o_totalprice").alias("total"))


@query("""SELECT 'day' AS panel, created_at::DATE::VARCHAR AS bucket, sum(input_tokens)::BIGINT AS tokens, NULL::DOUBLE AS cached_pct FROM telemetry_events WHERE event = 'session_end' GROUP BY 2
UNION ALL SELECT 'model', model_end || ' (' || coalesce(provider_end, '?') || ')', sum(input_tokens)::BIGINT, round(100.0 * sum(cache_read_input_tokens) / nullif(sum(input_tokens), 0), 1) FROM telemetry_events WHERE event = 'session_end' GROUP BY 2
UNION ALL SELECT 'per_day_7d', 'all', (sum(input_tokens) // 7)::BIGINT, NULL FROM telemetry_events WHERE event = 'session_end' AND created_at >= """ + REF + " - INTERVAL 7 DAY")
def token_panels(spark, d):
    e = ev(spark, d)
    own = e.where("event = 'session_end'")
    n = F.sum("input_tokens")
    day = own.groupBy(F.to_date("created_at").cast("string").alias("bucket")).agg(n.alias("tokens")).select(F.lit("day").alias("panel"), "bucket", "tokens")
    name = F.concat("model_end", F.lit(" ("), F.coalesce("provider_end", F.lit("?")), F.lit(")"))
    model = own.groupBy(name.alias("bucket")).agg(n.alias("tokens"), F.round(100.0 * F.sum("cache_read_input_tokens") / F.nullif(n, F.lit(0)), 1).alias("cached_pct")).select(F.lit("model").alias("panel"), "bucket", "tokens", "cached_pct")
    rate = own.where(F.col("created_at") >= ref_ts(e) - F.expr("INTERVAL 7 DAYS")).agg(F.expr("sum(input_tokens) div 7").alias("tokens")).select(F.lit("per_day_7d").alias("panel"), F.lit("all").alias("bucket"), "tokens")
    return day.unionByName(model, allowMissingColumns=True).unionByName(rate, allowMissingColumns=True)

