"""Session and series queries: rollups of sessions, streaks, histograms, gaps, percentiles, comparisons, log series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline.common import table
from quarryline.functions import usage
from quarryline.operators import series
from quarryline.operators.rollups import flag

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def events(spark, d):
    return table(spark, d, "events")


DAYS = "(SELECT DISTINCT user_id, ts::DATE AS day FROM events)"
RUNS = f"(SELECT user_id, count(*) AS days, min(day) AS first_day, max(day) AS last_day FROM (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS island FROM {DAYS}) GROUP BY user_id, island)"


@query(f"SELECT user_id, max(days) AS longest, coalesce(max(CASE WHEN last_day >= (SELECT max(ts)::DATE FROM events) - 1 THEN days END), 0) AS current, sum(days)::BIGINT AS active_days FROM {RUNS} GROUP BY 1")
def streak_days(spark, d):
    e = events(spark, d)
    last = e.agg(F.max(F.to_date("ts"))).first()[0]
    return series.streak_summary(e.select("user_id", F.to_date("ts").alias("day")), "user_id", "day", F.lit(last))


@query(f"SELECT * FROM {RUNS}")
def streak_runs(spark, d):
    return series.streaks(events(spark, d).select("user_id", F.to_date("ts").alias("day")), "user_id", "day")


@query("SELECT user_id, count(gap) AS gaps, round(avg(gap), 3) AS mean_gap, round(min(gap), 6) AS min_gap, round(max(gap), 6) AS max_gap FROM (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events) GROUP BY 1")
def event_gaps(spark, d):
    g = series.gaps(events(spark, d), "user_id", "ts", "event_id")
    return g.groupBy("user_id").agg(F.count("gap_secs").alias("gaps"), F.round(F.avg("gap_secs"), 3).alias("mean_gap"), F.round(F.min("gap_secs"), 6).alias("min_gap"), F.round(F.max("gap_secs"), 6).alias("max_gap"))


@query("SELECT event_id, count(*) OVER w1 AS starts_24h, count(*) OVER w7 AS starts_7d FROM (SELECT *, floor(epoch(ts))::BIGINT AS s FROM events) WINDOW w1 AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW), w7 AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 604799 PRECEDING AND CURRENT ROW)")
def trailing_starts(spark, d):
    e = series.trailing_count(events(spark, d), "user_id", "ts", 86_400, "starts_24h")
    return series.trailing_count(e, "user_id", "ts", 604_800, "starts_7d").select("event_id", "starts_24h", "starts_7d")


@query("SELECT event_id, round(delta, 6) AS delta FROM (SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events) WHERE abs(delta) >= 20")
def value_spikes(spark, d):
    return series.spikes(events(spark, d), "user_id", "ts", "event_id", "value", 20).select("event_id", F.round("delta", 6).alias("delta"))


@query("""WITH s AS (SELECT user_id, ts::DATE AS day, min(ts) AS a, max(ts) AS b FROM events GROUP BY ALL), m AS (SELECT a AS t, 1 AS d, user_id || ':' || day AS k FROM s UNION ALL SELECT b, -1, user_id || ':' || day FROM s)
SELECT date_trunc('hour', t) AS bucket, max(run)::BIGINT AS peak FROM (SELECT *, sum(d) OVER (ORDER BY date_trunc('hour', t), t, d, k ROWS UNBOUNDED PRECEDING) AS run FROM m) WHERE d = 1 GROUP BY 1""")
def active_sessions(spark, d):
    s = events(spark, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return series.concurrency(s.withColumn("k", F.concat_ws(":", "user_id", "day")), "k", "a", "b", "hour").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) <= 3")
def capped_hits(spark, d):
    return series.cap_per_group(events(spark, d), ["user_id", "event_type"], [F.desc("value"), F.col("event_id")], 3).select("event_id", "user_id", "event_type")


@query("SELECT event_id, coalesce(list_aggregate(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 'string_agg', ','), '') AS before, coalesce(list_aggregate(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 'string_agg', ','), '') AS after FROM events")
def neighbour_context(spark, d):
    e = events(spark, d).withColumn("at", F.struct("ts", "event_id"))
    return series.neighbours(e, "user_id", "at", "event_type", 2).select("event_id", F.concat_ws(",", "before").alias("before"), F.concat_ws(",", "after").alias("after"))


@query("SELECT event_id, round(sum(least(coalesce(gap, 0), 3600.0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS offset_secs FROM (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events)")
def replay_timeline(spark, d):
    return series.timeline(events(spark, d), "user_id", "ts", "event_id", 3600.0).select("event_id", F.round("offset_secs", 3).alias("offset_secs"))


@query("SELECT event_type, n, " + ", ".join(f"list_sort(v)[floor((n - 1) * {p} + 0.5)::INT + 1] AS p{round(p * 100)}" for p in (0.5, 0.95, 0.99)) + " FROM (SELECT event_type, count(value) AS n, list(value) FILTER (value IS NOT NULL) AS v FROM events GROUP BY 1)")
def nearest_rank_percentiles(spark, d):
    return series.nearest_rank(events(spark, d), ["event_type"], "value", [0.5, 0.95, 0.99])


@query("SELECT event_type, median(value) AS median, avg(value) AS mean, stddev_samp(value) AS sample_stdev, CASE WHEN count(value) < 2 OR avg(value) = 0 THEN 0 ELSE stddev_pop(value) / avg(value) END AS variation, 0.4 * avg(value) + 0.6 * min(value) AS composite FROM events GROUP BY 1")
def value_summary(spark, d):
    v = F.col("value")
    variation = F.when((F.count(v) < 2) | (F.avg(v) == 0), 0.0).otherwise(F.stddev_pop(v) / F.nullif(F.avg(v), F.lit(0.0)))
    own = events(spark, d)
    per = own.groupBy("event_type").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sample_stdev"), variation.alias("variation"), (0.4 * F.avg(v) + 0.6 * F.min(v)).alias("composite"))
    return per.join(series.medians(own, ["event_type"], "value"), "event_type", "left")


@query("SELECT h AS hour, coalesce(n, 0) AS events, CASE WHEN h BETWEEN 5 AND 8 THEN 'Early Bird' WHEN h BETWEEN 9 AND 11 THEN 'Morning Person' WHEN h BETWEEN 12 AND 16 THEN 'Afternoon Operator' WHEN h BETWEEN 17 AND 20 THEN 'Evening Builder' WHEN h BETWEEN 21 AND 23 THEN 'Night Owl' ELSE 'Nocturnal Hacker' END AS label FROM range(24) r(h) LEFT JOIN (SELECT hour(ts) AS hh, count(*) AS n FROM events GROUP BY 1) ON hh = h")
def hour_histogram(spark, d):
    counts = events(spark, d).groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("events"))
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(F.broadcast(counts), "hour", "left").select("hour", F.coalesce("events", F.lit(0)).alias("events"), usage.chronotype(F.col("hour")).alias("label"))  # 24 rows


@query("SELECT isodow(ts) - 1 AS weekday, count(*) AS events, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1")
def weekday_histogram(spark, d):
    return events(spark, d).groupBy(F.weekday("ts").alias("weekday")).agg(F.count("*").alias("events"), F.countDistinct(F.to_date("ts")).alias("days"))


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def favourite_type(spark, d):
    n = events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "event_type"))
    return n.groupBy("user_id").agg(best.alias("b")).select("user_id", F.col("b.event_type").alias("event_type"), (-F.col("b.n")).alias("n"))


@query("SELECT (SELECT ts::DATE FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS busiest_day, (SELECT hour(ts) FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1) AS busiest_hour")
def busiest(spark, d):
    e = events(spark, d)
    day = e.groupBy(F.to_date("ts").alias("busiest_day")).count().orderBy(F.desc("count"), "busiest_day").limit(1).select("busiest_day")
    hour = e.groupBy(F.hour("ts").alias("busiest_hour")).count().orderBy(F.desc("count"), F.desc("busiest_hour")).limit(1).select("busiest_hour")
    return day.crossJoin(hour)  # two single rows


@query("SELECT user_id, round(sum(greatest(pow(0.5, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 8.64e10 / 21), 0.05)), 6) AS score, max(ts) AS last_used, count(*) AS uses FROM events GROUP BY 1")
def recency_score(spark, d):
    e = events(spark, d)
    last = e.agg(F.max("ts")).first()[0]
    age = (series.epoch_us(F.lit(last).cast("timestamp_ntz")) - series.epoch_us("ts")) / 8.64e10
    return e.groupBy("user_id").agg(F.round(F.sum(F.greatest(F.pow(F.lit(0.5), age / 21), F.lit(0.05))), 6).alias("score"), F.max("ts").alias("last_used"), F.count("*").alias("uses"))


@query("""SELECT user_id, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS views, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS purchases,
 min(CASE WHEN event_type = 'signup' THEN ts END) AS first_signup, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS had_error, round(sum(value), 6) AS total FROM events GROUP BY 1""")
def user_summary(spark, d):
    is_ = lambda t: F.col("event_type") == t
    return events(spark, d).groupBy("user_id").agg(F.sum(flag(is_("view"))).alias("views"), F.sum(flag(is_("purchase"))).alias("purchases"), F.min(F.when(is_("signup"), F.col("ts"))).alias("first_signup"), F.max(flag(is_("error"))).alias("had_error"), F.round(F.sum("value"), 6).alias("total"))


@query("""WITH a AS (SELECT event_type, avg(value) AS m, count(*) AS n FROM events WHERE day(ts) <= 15 GROUP BY 1), b AS (SELECT event_type, avg(value) AS m, count(*) AS n FROM events WHERE day(ts) > 15 GROUP BY 1)
SELECT coalesce(a.event_type, b.event_type) AS event_type, a.n AS n_before, b.n AS n_after, round(b.m - a.m, 6) AS diff, CASE WHEN coalesce(a.n, 0) = 0 AND coalesce(b.n, 0) = 0 THEN 0 WHEN coalesce(a.n, 0) = 0 THEN 'inf'::DOUBLE ELSE 100.0 * (coalesce(b.n, 0) - a.n) / a.n END AS pct, coalesce(b.m < a.m * 0.99, false) AS regressed FROM a FULL JOIN b ON a.event_type = b.event_type""")
def period_compare(spark, d):
    e = events(spark, d)
    side = lambda c, s: e.where(c).groupBy("event_type").agg(F.avg("value").alias(f"m_{s}"), F.count("*").alias(f"n_{s}"))
    j = side(F.dayofmonth("ts") <= 15, "before").join(side(F.dayofmonth("ts") > 15, "after"), "event_type", "full_outer")
    a, b = F.coalesce("n_before", F.lit(0)), F.coalesce("n_after", F.lit(0))
    pct = F.when((a == 0) & (b == 0), 0.0).when(a == 0, F.lit(float("inf"))).otherwise(100.0 * (b - a) / F.nullif(a, F.lit(0)))
    return j.select("event_type", "n_before", "n_after", F.round(F.col("m_after") - F.col("m_before"), 6).alias("diff"), pct.alias("pct"), F.coalesce(F.col("m_after") < F.col("m_before") * 0.99, F.lit(False)).alias("regressed"))


@query("SELECT CASE WHEN value >= 90 THEN '90+' WHEN value >= 70 THEN '70-90' WHEN value >= 40 THEN '40-70' ELSE '<40' END AS band, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share FROM events GROUP BY 1")
def value_bands(spark, d):
    v = F.col("value")
    bands = events(spark, d).groupBy(F.when(v >= 90, "90+").when(v >= 70, "70-90").when(v >= 40, "40-70").otherwise("<40").alias("band")).agg(F.count("*").alias("n"))
    return bands.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))  # four rows


@query("SELECT user_id, value AS peak, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def peak_per_user(spark, d):
    best = F.min(F.struct((-F.col("value")).alias("v"), "event_id", "event_type", "ts"))
    return events(spark, d).groupBy("user_id").agg(best.alias("b")).select("user_id", (-F.col("b.v")).alias("peak"), "b.event_id", "b.event_type", "b.ts")


@query("SELECT date_trunc('day', ts)::DATE AS day, date_trunc('month', ts)::DATE AS month, GROUPING(date_trunc('day', ts)::DATE) AS level, count(*) AS n FROM events GROUP BY GROUPING SETS ((date_trunc('day', ts)::DATE), (date_trunc('month', ts)::DATE))")
def tumbling_counters(spark, d):
    e = events(spark, d).select(F.to_date("ts").alias("day"), F.trunc(F.to_date("ts"), "month").alias("month"))
    return e.groupingSets([[F.col("day")], [F.col("month")]], F.col("day"), F.col("month")).agg(F.grouping("day").cast("int").alias("level"), F.count("*").alias("n"))


@query("""SELECT user_id, fails_in_row FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS fails_in_row, grp FROM (SELECT *, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM events) GROUP BY user_id, grp)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY fails_in_row DESC) = 1""")
def failure_streak(spark, d):
    """Longest run of errors not interrupted by anything else."""
    runs = series.running_sum(events(spark, d), "user_id", "ts", "event_id", "grp", flag(F.col("event_type") != "error")).groupBy("user_id", "grp").agg(F.sum(flag(F.col("event_type") == "error")).alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias("fails_in_row"))


@query("SELECT p_brand, CASE WHEN sum(p_size) = 0 THEN NULL ELSE (sum(p_size * l_quantity)::BIGINT + sum(p_size)::BIGINT // 2) // sum(p_size)::BIGINT END AS weighted_mean FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def weighted_mean(spark, d):
    """Integer mean by weight, halves rounded up."""
    j = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_brand").agg(F.expr("(cast(sum(p_size * l_quantity) as bigint) + sum(p_size) div 2) div nullif(sum(p_size), 0)").alias("weighted_mean"))


@query("SELECT l_returnflag, l_suppkey, n, n::DOUBLE / sum(n) OVER (PARTITION BY l_returnflag) AS weight FROM (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)")
def normalised_weights(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n"))
    return n.withColumn("weight", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("l_returnflag")))


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 11 <> 0)
SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change, count(*) AS n FROM a FULL JOIN b USING (k) WHERE a.v IS DISTINCT FROM b.v GROUP BY 1""")
def snapshot_diff(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    a = o.where("k % 10 <> 0").withColumn("a", F.lit(1))
    b = o.where("k % 11 <> 0").select("k", F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("v")).alias("w")).withColumn("b", F.lit(1))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return a.join(b, "k", "full_outer").where(~F.col("v").eqNullSafe(F.col("w"))).groupBy(change.alias("change")).agg(F.count("*").alias("n"))


@query("SELECT session_id, count(*) AS messages, count(*) FILTER (role = 'user') AS prompts, count(*) FILTER (role = 'assistant') AS answers, sum(coalesce(len(tool_calls), 0))::BIGINT AS tool_calls, min(created_at) AS first_at, max(created_at) AS last_at, sum(coalesce(length(content), 0))::BIGINT AS chars FROM display_messages GROUP BY 1")
def session_rollup(spark, d):
    m = table(spark, d, "display_messages")
    calls = F.sum(F.greatest(F.coalesce(F.size("tool_calls"), F.lit(0)), F.lit(0)))
    return m.groupBy("session_id").agg(F.count("*").alias("messages"), F.sum(flag(F.col("role") == "user")).alias("prompts"), F.sum(flag(F.col("role") == "assistant")).alias("answers"), calls.alias("tool_calls"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.sum(F.coalesce(F.char_length("content"), F.lit(0))).cast("long").alias("chars"))


@query("SELECT split_part(c, ' ', 1) AS tool, count(*) AS uses, count(DISTINCT session_id) AS sessions FROM (SELECT session_id, unnest(tool_calls) AS c FROM display_messages) WHERE c <> '' GROUP BY 1")
def tool_tally(spark, d):
    c = table(spark, d, "display_messages").select("session_id", F.explode("tool_calls").alias("c")).where("c <> ''")
    return c.groupBy(F.split("c", " ")[0].alias("tool")).agg(F.count("*").alias("uses"), F.countDistinct("session_id").alias("sessions")).orderBy(F.desc("uses"), "tool")


@query("""SELECT session_id, round(0.5 * least(1, n / 50.0) + 0.3 * least(1, t / 20.0) + 0.2 * least(1, dd / 5.0), 6) AS score, CASE WHEN t * 3 >= n AND t > 0 THEN 'tools' WHEN u * 2 >= n THEN 'talk' ELSE 'answers' END AS style
FROM (SELECT session_id, count(*) AS n, count(*) FILTER (role = 'tool') AS t, count(*) FILTER (role = 'user') AS u, count(DISTINCT created_at::DATE) AS dd FROM display_messages GROUP BY 1)""")
def session_style(spark, d):
    m = table(spark, d, "display_messages").groupBy("session_id").agg(F.count("*").alias("n"), F.sum(flag(F.col("role") == "tool")).alias("t"), F.sum(flag(F.col("role") == "user")).alias("u"), F.countDistinct(F.to_date("created_at")).alias("dd"))
    part = lambda c, k: F.least(F.lit(1.0), F.col(c) / k)
    style = F.when((F.col("t") * 3 >= F.col("n")) & (F.col("t") > 0), "tools").when(F.col("u") * 2 >= F.col("n"), "talk").otherwise("answers")
    return m.select("session_id", F.round(0.5 * part("n", 50.0) + 0.3 * part("t", 20.0) + 0.2 * part("dd", 5.0), 6).alias("score"), style.alias("style"))


@query("SELECT path, count(*) AS samples, count(DISTINCT line_no) AS lines, min(received_at) AS first_at, max(received_at) AS last_at, arg_max(sample_id, received_at::VARCHAR || lpad(sample_id::VARCHAR, 20, '0')) AS last_sample FROM memory_samples GROUP BY 1")
def log_inventory(spark, d):
    latest = F.max_by("sample_id", F.struct("received_at", "sample_id"))
    return table(spark, d, "memory_samples").groupBy("path").agg(F.count("*").alias("samples"), F.countDistinct("line_no").alias("lines"), F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at"), latest.alias("last_sample"))
