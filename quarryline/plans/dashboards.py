"""Further dashboards: prompt users, countries, discovery, installs, transports, feedback, concurrency, token value, trials.

Countries stand in the order tables: an order is an event of its customer's nation, its priority the kind of event. Discovery
events stand in the install details: stage is the phase, source the category, install_method the chosen tool.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline.common import table
from quarryline.operators import series
from quarryline.operators.rollups import ENDED, flag
from quarryline.plans.telemetry import REF, ev, ref_ts

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_WINDOWS = {
    "dau_24h": ("INTERVAL 1 DAY", None), "dau_24h_week_ago": ("INTERVAL 8 DAY", "INTERVAL 7 DAY"), "wau": ("INTERVAL 7 DAY", None), "wau_previous": ("INTERVAL 14 DAY", "INTERVAL 7 DAY"),
}
_LONG = {"mau": ("INTERVAL 30 DAY", None), "mau_previous": ("INTERVAL 60 DAY", "INTERVAL 30 DAY")}


def _distinct(name, window):
    after, before = window
    return f"count(DISTINCT CASE WHEN created_at >= r - {after}{f' AND created_at < r - {before}' if before else ''} THEN telemetry_id END) AS {name}"


@query(f"""WITH p AS (SELECT {REF} AS r), a AS (SELECT {', '.join(_distinct(n, w) for n, w in _WINDOWS.items())}, count(DISTINCT CASE WHEN created_at >= date_trunc('day', r) THEN telemetry_id END) AS today_sofar,
 count(DISTINCT CASE WHEN created_at >= date_trunc('day', r - INTERVAL 1 DAY) AND created_at < date_trunc('day', r) THEN telemetry_id END) AS yesterday FROM telemetry_events, p
 WHERE is_ci = 0 AND created_at >= r - INTERVAL 14 DAY AND (event = 'turn_end' OR event IN ('session_end', 'session_crash') AND turns > 0)),
b AS (SELECT {', '.join(_distinct(n, w) for n, w in _LONG.items())}, count(DISTINCT telemetry_id) AS all_time FROM telemetry_events, p WHERE is_ci = 0 AND event IN ('session_end', 'session_crash') AND turns > 0)
SELECT *, round(100.0 * (dau_24h - dau_24h_week_ago) / nullif(dau_24h_week_ago, 0), 1) AS dau_pct, round(100.0 * (wau - wau_previous) / nullif(wau_previous, 0), 1) AS wau_pct, round(100.0 * (mau - mau_previous) / nullif(mau_previous, 0), 1) AS mau_pct FROM a, b""")
def prompt_users(spark, d):
    """Users with a prompt over several windows: each id's flags first, then their sums, instead of many distinct counts."""
    e = ev(spark, d)
    r, c = ref_ts(e), F.col("created_at")
    back = lambda x: r - F.expr(x)
    inside = lambda w: (c >= back(w[0])) & (F.lit(True) if w[1] is None else c < back(w[1]))
    day = lambda x: F.date_trunc("day", x).cast("timestamp_ntz")
    ended = F.col("event").isin(*ENDED) & (F.col("turns") > 0)
    recent = (c >= back("INTERVAL 14 DAY")) & ((F.col("event") == "turn_end") | ended)
    flags = {n: recent & inside(w) for n, w in _WINDOWS.items()} | {"today_sofar": recent & (c >= day(r)), "yesterday": recent & (c >= day(back("INTERVAL 1 DAY"))) & (c < day(r))}
    flags |= {n: ended & inside(w) for n, w in _LONG.items()} | {"all_time": ended}
    own = e.where((F.col("is_ci") == 0) & (F.col("event").isin("turn_end", *ENDED)) & F.col("telemetry_id").isNotNull())
    per = own.groupBy("telemetry_id").agg(*(F.max(flag(v)).alias(k) for k, v in flags.items()))
    one = per.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in flags))
    pct = lambda a, b: F.round(100.0 * (F.col(a) - F.col(b)) / F.nullif(F.col(b), F.lit(0)), 1)
    return one.withColumns({"dau_pct": pct("dau_24h", "dau_24h_week_ago"), "wau_pct": pct("wau", "wau_previous"), "mau_pct": pct("mau", "mau_previous")})


_COUNTRY = "(SELECT o_orderdate::DATE AS activity_date, coalesce(n_name, 'unknown') AS country, o_orderpriority AS event, (o_orderkey % 10 = 0)::INT AS is_ci, count(*) AS event_count FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"
_LAST = "(SELECT max(o_orderdate)::DATE FROM orders)"


def country_daily(spark, d):
    """The counter rollup: events per day, country, kind and ci."""
    # Customers are joined by a shuffle unless Spark knows them small; nations are 25 rows.
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return o.groupBy(F.to_date("o_orderdate").alias("activity_date"), F.coalesce("n_name", F.lit("unknown")).alias("country"), F.col("o_orderpriority").alias("event"), (F.col("o_orderkey") % 10 == 0).cast("int").alias("is_ci")).agg(F.count("*").alias("event_count"))


QUERIES["country_daily"] = country_daily
SQL["country_daily"] = f"SELECT * FROM {_COUNTRY}"


def _since(spark, d, days):
    last = table(spark, d, "orders").agg(F.max(F.to_date("o_orderdate"))).first()[0]
    return F.col("activity_date") >= F.date_sub(F.lit(last), days)


@query("SELECT n_name AS country, count(DISTINCT c_custkey) AS users FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey % 10 <> 0 GROUP BY 1 ORDER BY users DESC, 1 LIMIT 50")
def users_by_country(spark, d):
    """Users of each country, reduced to one row per user before the count."""
    o = table(spark, d, "orders").where("o_orderkey % 10 <> 0").select(F.col("o_custkey").alias("c_custkey")).distinct()
    u = o.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey").groupBy("c_nationkey").agg(F.count("*").alias("users"))
    return u.join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("country"), "users").orderBy(F.desc("users"), "country").limit(50)


@query(f"SELECT n_name AS country, count(DISTINCT c_custkey) AS users FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey % 10 <> 0 AND o_orderstatus = 'O' AND o_orderdate::DATE >= {_LAST} - 30 GROUP BY 1 ORDER BY users DESC, 1 LIMIT 50")
def active_users_by_country(spark, d):
    last = table(spark, d, "orders").agg(F.max(F.to_date("o_orderdate"))).first()[0]
    o = table(spark, d, "orders").where((F.col("o_orderkey") % 10 != 0) & (F.col("o_orderstatus") == "O") & (F.to_date("o_orderdate") >= F.date_sub(F.lit(last), 30))).select(F.col("o_custkey").alias("c_custkey")).distinct()
    u = o.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey").groupBy("c_nationkey").agg(F.count("*").alias("users"))
    return u.join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("country"), "users").orderBy(F.desc("users"), "country").limit(50)


@query(f"SELECT country, sum(event_count)::BIGINT AS installs FROM {_COUNTRY} WHERE event = '1-URGENT' AND is_ci = 0 AND activity_date >= {_LAST} - 90 GROUP BY 1 ORDER BY installs DESC, 1 LIMIT 50")
def installs_by_country(spark, d):
    c = country_daily(spark, d).where((F.col("event") == "1-URGENT") & (F.col("is_ci") == 0) & _since(spark, d, 90))
    return c.groupBy("country").agg(F.sum("event_count").alias("installs")).orderBy(F.desc("installs"), "country").limit(50)


@query(f"SELECT country, sum(event_count)::BIGINT AS pageviews FROM {_COUNTRY} WHERE event = '2-HIGH' AND activity_date >= {_LAST} - 30 GROUP BY 1 ORDER BY pageviews DESC, 1 LIMIT 50")
def pageviews_by_country(spark, d):
    c = country_daily(spark, d).where((F.col("event") == "2-HIGH") & _since(spark, d, 30))
    return c.groupBy("country").agg(F.sum("event_count").alias("pageviews")).orderBy(F.desc("pageviews"), "country").limit(50)


@query(f"SELECT activity_date, country, sum(event_count)::BIGINT AS events FROM {_COUNTRY} WHERE activity_date >= {_LAST} - 14 AND is_ci = 0 GROUP BY 1, 2 ORDER BY 1 DESC, events DESC, 2 LIMIT 200")
def country_trend(spark, d):
    c = country_daily(spark, d).where((F.col("is_ci") == 0) & _since(spark, d, 14))
    return c.groupBy("activity_date", "country").agg(F.sum("event_count").alias("events")).orderBy(F.desc("activity_date"), F.desc("events"), "country").limit(200)


_STEPS = "install_details d JOIN telemetry_events e ON e.event_id = d.event_id"


def _steps(spark, d):
    return table(spark, d, "install_details").drop("received_at").join(ev(spark, d).select("event_id", "telemetry_id", "created_at"), "event_id")


@query(f"SELECT install_method AS tool, count(*) AS selects, count(DISTINCT telemetry_id) AS users, min(created_at::DATE) AS first_day, max(created_at::DATE) AS last_day FROM {_STEPS} WHERE stage = 'installer_finish' AND outcome = 'success' GROUP BY 1")
def discovery_by_tool(spark, d):
    own = _steps(spark, d).where("stage = 'installer_finish' AND outcome = 'success'")
    day = F.to_date("created_at")
    return own.groupBy(F.col("install_method").alias("tool")).agg(F.count("*").alias("selects"), F.countDistinct("telemetry_id").alias("users"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


@query(f"""SELECT d.source AS category, sum((stage = 'script_request')::INT)::BIGINT AS browses, sum((stage = 'installer_finish')::INT)::BIGINT AS selects, count(DISTINCT CASE WHEN stage = 'script_request' THEN telemetry_id END) AS browse_users,
count(DISTINCT CASE WHEN stage = 'installer_finish' THEN telemetry_id END) AS select_users FROM {_STEPS} WHERE outcome = 'success' GROUP BY 1""")
def discovery_funnel(spark, d):
    """Browses and selections of each category; one row per (category, id) carries both counts and flags."""
    is_ = lambda s: F.coalesce(F.col("stage") == s, F.lit(False))
    own = _steps(spark, d).where("outcome = 'success'")
    per = own.groupBy(F.col("source").alias("category"), "telemetry_id").agg(F.sum(flag(is_("script_request"))).alias("b"), F.sum(flag(is_("installer_finish"))).alias("s"), F.count("stage").alias("n"))
    named = F.col("telemetry_id").isNotNull()
    total = lambda c: F.sum(F.when(F.col("n") > 0, F.col(c)))
    return per.groupBy("category").agg(total("b").alias("browses"), total("s").alias("selects"), F.sum(flag(named & (F.col("b") > 0))).cast("long").alias("browse_users"), F.sum(flag(named & (F.col("s") > 0))).cast("long").alias("select_users"))


@query("SELECT stage, failure_stage AS reason, count(*) AS n FROM install_details WHERE outcome = 'failure' GROUP BY 1, 2")
def discovery_failures(spark, d):
    return table(spark, d, "install_details").where("outcome = 'failure'").groupBy("stage", F.col("failure_stage").alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT telemetry_id) AS raw_installs, count(DISTINCT CASE WHEN is_ci = 0 THEN telemetry_id END) AS installs_noci FROM telemetry_events WHERE event = 'install'")
def installs(spark, d):
    per = ev(spark, d).where("event = 'install' AND telemetry_id IS NOT NULL").groupBy("telemetry_id").agg(F.max(flag(F.col("is_ci") == 0)).alias("noci"))
    return per.agg(F.count("*").alias("raw_installs"), F.coalesce(F.sum("noci"), F.lit(0)).alias("installs_noci"))


_TRANSPORTS = ["brindle", "router", "corvid", "aerie", "local"]


@query(f"SELECT {', '.join(f'sum((provider_end = {chr(39)}{t}{chr(39)})::INT)::BIGINT AS {t}' for t in _TRANSPORTS)}, sum((provider_end IS NULL)::INT)::BIGINT AS other FROM telemetry_events WHERE event IN ('session_end', 'session_crash')")
def transports(spark, d):
    """Sessions by the way they were served, a column each."""
    own = ev(spark, d).where(F.col("event").isin(*ENDED))
    return own.agg(*(F.sum((F.col("provider_end") == t).cast("int")).alias(t) for t in _TRANSPORTS), F.sum(F.col("provider_end").isNull().cast("int")).alias("other"))


@query("SELECT id, created_at, end_reason, version, build_channel FROM telemetry_events WHERE event = 'feedback' ORDER BY created_at DESC, id LIMIT 50")
def recent_feedback(spark, d):
    return ev(spark, d).where("event = 'feedback'").orderBy(F.desc("created_at"), "id").limit(50).select("id", "created_at", "end_reason", "version", "build_channel")


@query(f"""WITH s AS (SELECT id, telemetry_id, epoch_us(created_at) - coalesce(duration_secs, 0) * 1000000::BIGINT AS a, epoch_us(created_at) AS b FROM telemetry_events WHERE event IN ('session_end', 'session_crash') AND duration_secs >= 0 AND created_at > {REF} - INTERVAL 30 DAY AND telemetry_id IS NOT NULL),
o AS (SELECT *, max(b) OVER (PARTITION BY telemetry_id ORDER BY a, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > a OR lead(a) OVER (PARTITION BY telemetry_id ORDER BY a, id) < b AS multi FROM s)
SELECT round(avg(CASE WHEN multi THEN 1.0 ELSE 0.0 END), 9) AS multi_session_rate, count(*) AS sessions FROM o""")
def multi_session_rate(spark, d):
    """Share of sessions during which another session of the same id ran."""
    e = ev(spark, d)
    end = F.unix_micros(F.col("created_at").cast("timestamp"))
    s = e.where(F.col("event").isin(*ENDED) & (F.col("duration_secs") >= 0) & (F.col("created_at") > ref_ts(e) - F.expr("INTERVAL 30 DAYS")) & F.col("telemetry_id").isNotNull())
    s = s.select("id", "telemetry_id", (end - F.col("duration_secs").cast("long") * 1_000_000).alias("a"), end.alias("b"))
    w = Window.partitionBy("telemetry_id").orderBy("a", "id")
    multi = (F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)) > F.col("a")) | (F.lead("a").over(w) < F.col("b"))
    return s.withColumn("multi", multi).agg(F.round(F.avg(F.when(F.col("multi"), 1.0).otherwise(0.0)), 9).alias("multi_session_rate"), F.count("*").alias("sessions"))


@query(f"SELECT model_end AS tier, count(*) AS exhaustion_events, count(DISTINCT telemetry_id) AS accounts FROM telemetry_events WHERE event = 'subscription_budget_exhausted' AND created_at > {REF} - INTERVAL 30 DAY GROUP BY 1")
def budget_exhaustion(spark, d):
    e = ev(spark, d)
    own = e.where((F.col("event") == "subscription_budget_exhausted") & (F.col("created_at") > ref_ts(e) - F.expr("INTERVAL 30 DAYS")))
    return own.groupBy(F.col("model_end").alias("tier")).agg(F.count("*").alias("exhaustion_events"), F.countDistinct("telemetry_id").alias("accounts")).orderBy(F.desc("exhaustion_events"), "tier")


#: Rates per million tokens of a price table (a parameter; these stand in for one in the queries): model, input, output,
#: cache read, cache write, whether the input count holds the cached tokens. A missing rate follows the input's.
PRICES = [("aerie-mini", 1.0, 4.0, None, None, 1), ("aerie-large-2", 5.0, 25.0, 0.5, 6.25, 0), ("brindle-4", 3.0, 15.0, 0.3, None, 0), ("tansy-7b", 0.2, 0.2, None, None, 1), ("auto", None, None, None, None, 0)]


def valued(events, prices):
    """Events with the value of their tokens: billable input, cached tokens at a tenth and at 1.25 of the input's rate by
    default; models without a price count their tokens and no value. prices: a small table, broadcast."""
    p = prices.toDF("model_end", "r_in", "r_out", "r_read", "r_new", "holds_read")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n, out, read, new = (zero(c) for c in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"))
    billable = F.when(F.col("holds_read") == 1, F.greatest(n - read, F.lit(0))).otherwise(n)
    rate = F.col("r_in")
    usd = (billable * rate + out * F.coalesce("r_out", F.lit(0.0)) + read * F.coalesce(F.col("r_read"), rate * 0.1) + new * F.coalesce(F.col("r_new"), rate * 1.25)) / 1e6
    return events.join(F.broadcast(p), "model_end", "left").withColumns({"tokens": n + out + read + new, "usd": F.when(rate.isNotNull(), usd).otherwise(0.0), "priced": rate.isNotNull()})


_VALUES = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in row) + ")" for row in PRICES)
_VALUED = f"""(SELECT e.*, coalesce(input_tokens, 0) AS n, coalesce(output_tokens, 0) AS o, coalesce(cache_read_input_tokens, 0) AS rd, coalesce(cache_creation_input_tokens, 0) AS nw, r_in, n + o + rd + nw AS tokens,
 CASE WHEN r_in IS NULL THEN 0.0 ELSE (CASE WHEN holds = 1 THEN greatest(n - rd, 0) ELSE n END * r_in::DOUBLE + o * coalesce(r_out, 0)::DOUBLE + rd * coalesce(r_rd, r_in * 0.1)::DOUBLE + nw * coalesce(r_nw, r_in * 1.25)::DOUBLE) / 1e6 END AS usd
 FROM telemetry_events e LEFT JOIN (VALUES {_VALUES}) p(model, r_in, r_out, r_rd, r_nw, holds) ON model = model_end WHERE event = 'session_end' AND is_ci = 0)"""
_PRICE_SCHEMA = "model string, input double, output double, cache_read double, cache_write double, holds_read int"


@query(f"SELECT model_end, round(sum(usd), 4) AS usd, sum(tokens)::BIGINT AS tokens, count(*) AS sessions, round(100.0 * sum(CASE WHEN r_in IS NOT NULL THEN tokens ELSE 0 END) / nullif(sum(tokens), 0), 1) AS priced_pct FROM {_VALUED} GROUP BY 1")
def token_value(spark, d):
    v = valued(ev(spark, d).where("event = 'session_end' AND is_ci = 0"), spark.createDataFrame(PRICES, _PRICE_SCHEMA))
    pct = F.round(100.0 * F.sum(F.when(F.col("priced"), F.col("tokens")).otherwise(0)) / F.nullif(F.sum("tokens"), F.lit(0)), 1)
    return v.groupBy("model_end").agg(F.round(F.sum("usd"), 4).alias("usd"), F.sum("tokens").alias("tokens"), F.count("*").alias("sessions"), pct.alias("priced_pct"))


@query(f"SELECT created_at::DATE AS day, round(sum(usd), 4) AS usd, sum(tokens)::BIGINT AS tokens, count(*) AS sessions, count(DISTINCT telemetry_id) AS users, round(100.0 * sum(CASE WHEN r_in IS NOT NULL THEN tokens ELSE 0 END) / nullif(sum(tokens), 0), 1) AS priced_pct FROM {_VALUED} WHERE created_at >= {REF} - INTERVAL 60 DAY GROUP BY 1")
def token_value_daily(spark, d):
    e = ev(spark, d)
    v = valued(e.where((F.col("event") == "session_end") & (F.col("is_ci") == 0) & (F.col("created_at") >= ref_ts(e) - F.expr("INTERVAL 60 DAYS"))), spark.createDataFrame(PRICES, _PRICE_SCHEMA))
    pct = F.round(100.0 * F.sum(F.when(F.col("priced"), F.col("tokens")).otherwise(0)) / F.nullif(F.sum("tokens"), F.lit(0)), 1)
    return v.groupBy(F.to_date("created_at").alias("day")).agg(F.round(F.sum("usd"), 4).alias("usd"), F.sum("tokens").alias("tokens"), F.count("*").alias("sessions"), F.countDistinct("telemetry_id").alias("users"), pct.alias("priced_pct"))


@query("SELECT metric_name, rating, sum(CASE WHEN metric_value > 100 THEN 10 ELSE 1 END)::BIGINT AS samples FROM web_details WHERE metric_name IS NOT NULL GROUP BY 1, 2")
def sampled_counts(spark, d):
    """Counts of a sampled store: each row stands for as many as its sampling interval says."""
    weight = F.when(F.col("metric_value") > 100, 10).otherwise(1)
    return table(spark, d, "web_details").where("metric_name IS NOT NULL").groupBy("metric_name", "rating").agg(F.sum(weight).alias("samples"))


_CASES = "(SELECT c_custkey AS case_id, c_mktsegment AS expect, count(*) AS trials, count(*) FILTER (o_orderstatus = 'F') / count(*) AS hit_rate, count(*) FILTER (o_orderpriority = '1-URGENT') / count(*) AS call_rate, median(o_totalprice) AS median_time FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)"


def _cases(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    share = lambda c: F.count_if(c) / F.count("*")
    rates = o.groupBy(F.col("o_custkey").alias("case_id"), F.col("c_mktsegment").alias("expect")).agg(F.count("*").alias("trials"), share(F.col("o_orderstatus") == "F").alias("hit_rate"), share(F.col("o_orderpriority") == "1-URGENT").alias("call_rate"))
    middle = series.medians(table(spark, d, "orders"), ["o_custkey"], "o_totalprice").select(F.col("o_custkey").alias("case_id"), F.col("median").alias("median_time"))
    return rates.join(middle, "case_id", "left")


@query(f"SELECT expect, count(*) AS cases, sum(trials)::BIGINT AS trials, round(avg(hit_rate), 6) AS macro_hit_rate, round(sum(hit_rate * trials) / sum(trials), 6) AS micro_hit_rate, round(avg(1 - call_rate), 6) AS clean_rate, round(avg(median_time), 4) AS mean_median FROM {_CASES} GROUP BY 1")
def trial_rates(spark, d):
    """Rates of trials: each case's own first, then their plain mean and the mean by trials."""
    c = _cases(spark, d)
    return c.groupBy("expect").agg(F.count("*").alias("cases"), F.sum("trials").alias("trials"), F.round(F.avg("hit_rate"), 6).alias("macro_hit_rate"), F.round(F.sum(F.col("hit_rate") * F.col("trials")) / F.sum("trials"), 6).alias("micro_hit_rate"), F.round(F.avg(1 - F.col("call_rate")), 6).alias("clean_rate"), F.round(F.avg("median_time"), 4).alias("mean_median"))


@query(f"SELECT case_id, round(hit_rate, 9) AS hit_rate FROM {_CASES} ORDER BY hit_rate, case_id LIMIT 5")
def worst_cases(spark, d):
    return _cases(spark, d).select("case_id", F.round("hit_rate", 9).alias("hit_rate")).orderBy("hit_rate", "case_id").limit(5)


@query("""WITH t AS (SELECT o_custkey, o_orderdate, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS attempt FROM orders), h AS (SELECT o_custkey, min(attempt) FILTER (o_orderstatus = 'F') AS hit, (epoch(min(o_orderdate) FILTER (o_orderstatus = 'F')) - epoch(min(o_orderdate))) / 86400 AS days FROM t GROUP BY 1)
SELECT count(*) AS trials, count(hit) AS successful, count(*) FILTER (hit = 1) AS first_attempt, round(avg(hit), 3) AS mean_attempts, round(median(days), 3) AS median_days FROM h""")
def attempts_to_hit(spark, d):
    """Attempts of a trial until it succeeds, and how long that took."""
    o = table(spark, d, "orders")
    t = o.withColumn("attempt", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    hit = F.when(F.col("o_orderstatus") == "F", F.col("attempt"))
    at = lambda c: F.unix_micros(F.min(c).cast("timestamp"))
    per = t.groupBy("o_custkey").agg(F.min(hit).alias("hit"), ((at(F.when(hit.isNotNull(), F.col("o_orderdate"))) - at(F.col("o_orderdate"))) / 8.64e10).alias("days"))
    one = per.agg(F.count("*").alias("trials"), F.count("hit").alias("successful"), F.count_if(F.col("hit") == 1).alias("first_attempt"), F.round(F.avg("hit"), 3).alias("mean_attempts"))
    middle = series.medians(per.withColumn("k", F.lit(1)), ["k"], "days").agg(F.round(F.max("median"), 3).alias("median_days"))
    return one.crossJoin(middle)  # two single rows


@query("""SELECT kind, weight FROM (SELECT kind, CASE WHEN sum(n) OVER () > 0 THEN n / sum(n) OVER () ELSE 1.0 / count(*) OVER () END AS weight FROM (SELECT kind, coalesce(n, 0) AS n FROM (VALUES ('web_pageview'), ('feedback'), ('install'), ('no_such_event')) k(kind) LEFT JOIN (SELECT event, count(*) AS n FROM telemetry_events GROUP BY 1) ON event = kind))
UNION ALL SELECT kind || ' (empty)', 0.25 FROM (VALUES ('web_pageview'), ('feedback'), ('install'), ('no_such_event')) k(kind)""")
def action_weights(spark, d):
    """Shares of a fixed set of actions; where none was seen all count alike."""
    kinds = spark.createDataFrame([("web_pageview",), ("feedback",), ("install",), ("no_such_event",)], "kind string")
    one = Window.partitionBy(F.lit(0))  # four rows
    n, total = F.coalesce("n", F.lit(0)), F.sum(F.coalesce("n", F.lit(0))).over(one)
    weight = F.when(total > 0, n / F.nullif(total, F.lit(0))).otherwise(1.0 / F.count("*").over(one)).alias("weight")
    seen = ev(spark, d).groupBy(F.col("event").alias("kind")).agg(F.count("*").alias("n"))
    some = kinds.join(seen, "kind", "left").select("kind", weight)
    return some.unionByName(kinds.join(seen.limit(0), "kind", "left").select(F.concat("kind", F.lit(" (empty)")).alias("kind"), weight))
