"""Session summaries folded into a report: totals, histograms, busiest times, streaks, score, archetype and badges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.common import table
from quarryline.functions.usage import canonical_tool, chronotype
from quarryline.operators import series

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def summaries(spark, d) -> DataFrame:
    """A row per session: messages by role, tools as a map, hours and weekdays as arrays, days it was active on."""
    m = table(spark, d, "display_messages").where("session_id IS NOT NULL")
    counts = lambda f, n: F.array(*(F.count_if(f("created_at") == i) for i in range(n)))
    role = lambda r: F.count_if(F.col("role") == r)
    base = m.groupBy("session_id").agg(
        role("user").alias("user_msgs"), role("assistant").alias("assistant_msgs"), counts(F.hour, 24).alias("hours"), counts(F.weekday, 7).alias("weekdays"), F.array_sort(F.collect_set(F.to_date("created_at"))).alias("active_dates"),
        F.sum(F.when(F.col("role") == "assistant", F.char_length("content"))).alias("assistant_chars"), F.first(F.substring("session_id", 1, 9)).alias("project"),
    )
    tools = m.select("session_id", F.explode("tool_calls").alias("c")).where("c <> ''").groupBy("session_id", canonical_tool(F.split("c", " ")[0]).alias("tool")).agg(F.count("*").alias("n"))
    maps = tools.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("tools"))
    return base.join(maps, "session_id", "left").withColumn("msgs", F.col("user_msgs") + F.col("assistant_msgs"))


_S = """WITH s AS (SELECT session_id, count(*) FILTER (role = 'user') AS user_msgs, count(*) FILTER (role = 'assistant') AS assistant_msgs, count(*) FILTER (role IN ('user', 'assistant')) AS msgs, sum(length(content)) FILTER (role = 'assistant') AS assistant_chars, left(session_id, 9) AS project FROM display_messages WHERE session_id IS NOT NULL GROUP BY session_id),
t AS (SELECT CASE WHEN tool = 'todowrite' THEN 'todo' ELSE tool END AS tool, count(*) AS n FROM (SELECT split_part(c, ' ', 1) AS tool FROM (SELECT unnest(tool_calls) AS c FROM display_messages WHERE session_id IS NOT NULL) WHERE c <> '') GROUP BY 1),
d AS (SELECT DISTINCT session_id, created_at::DATE AS day FROM display_messages WHERE session_id IS NOT NULL AND created_at IS NOT NULL), dm AS (SELECT day, sum(greatest(msgs, 1))::BIGINT AS n FROM d JOIN s USING (session_id) GROUP BY 1),
h AS (SELECT hour(created_at) AS hour, count(*) AS n FROM display_messages WHERE session_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1), w AS (SELECT isodow(created_at) - 1 AS weekday, count(*) AS n FROM display_messages WHERE session_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1),
runs AS (SELECT count(*) AS days FROM (SELECT day - row_number() OVER (ORDER BY day)::INT AS island FROM dm) GROUP BY island),
a AS (SELECT count(*) AS sessions, sum(msgs)::BIGINT AS messages, sum(user_msgs)::BIGINT AS prompts, coalesce(sum(assistant_chars), 0)::BIGINT // 4 AS output_tokens, count(DISTINCT project) AS projects, max(msgs) AS longest_session FROM s),
b AS (SELECT coalesce(sum(n), 0)::BIGINT AS tool_calls, coalesce(sum(n) FILTER (tool IN ('edit', 'write', 'multiedit', 'apply_patch')), 0)::BIGINT AS edits, coalesce(sum(n) FILTER (tool = 'bash'), 0)::BIGINT AS commands, coalesce(sum(n) FILTER (tool IN ('grep', 'agentgrep', 'glob')), 0)::BIGINT AS searches, coalesce(sum(n) FILTER (tool IN ('browser', 'websearch', 'webfetch')), 0)::BIGINT AS web FROM t),
c AS (SELECT count(*) AS active_days, max(day) - min(day) + 1 AS span_days, arg_max(day, {n: n, x: -epoch(day)}) AS busiest_day, max(n) AS busiest_messages FROM dm)
"""


@query(_S + """, r AS (SELECT *, (SELECT max(days) FROM runs) AS longest_streak, (SELECT arg_max(hour, {n: n, h: hour}) FROM h) AS peak_hour, (SELECT sum(n) FILTER (weekday >= 5) / sum(n) FROM w) AS weekend FROM a, b, c)
SELECT sessions, messages, prompts, output_tokens, projects, longest_session, tool_calls, edits, commands, searches, web, active_days, span_days, busiest_day, busiest_messages, longest_streak, peak_hour,
 CASE WHEN peak_hour <= 4 THEN 'Nocturnal Hacker' WHEN peak_hour <= 8 THEN 'Early Bird' WHEN peak_hour <= 11 THEN 'Morning Person' WHEN peak_hour <= 16 THEN 'Afternoon Operator' WHEN peak_hour <= 20 THEN 'Evening Builder' ELSE 'Night Owl' END AS chronotype,
 round(tool_calls + edits * 4.0 + prompts * 2.0 + active_days * 25.0 + longest_streak * 15.0 + projects * 10.0 + output_tokens / 1000)::BIGINT AS power_score,
 CASE WHEN greatest(edits, commands, searches, web * 3) / greatest(prompts, 1) <= 0.0001 THEN 'The Conversationalist' WHEN edits >= greatest(commands, searches, web * 3) THEN 'The Shipper' WHEN commands >= greatest(searches, web * 3) THEN 'The Operator' WHEN searches >= web * 3 THEN 'The Explorer' ELSE 'The Researcher' END AS archetype,
 array_to_string(list_filter([CASE WHEN longest_streak >= 7 THEN longest_streak || '-day streak' END, CASE WHEN projects >= 10 THEN projects || ' projects' END, CASE WHEN output_tokens >= 10000000 THEN '10M+ tokens generated' END, CASE WHEN edits >= 1000 THEN edits || ' code edits' END,
  CASE WHEN peak_hour <= 4 OR peak_hour >= 22 THEN 'Night owl' END, CASE WHEN sessions >= 1000 THEN sessions || ' sessions' END, CASE WHEN weekend > 0.3 THEN 'Weekend warrior' END], lambda x: x IS NOT NULL), ', ') AS badges FROM r""")
def productivity_report(spark, d):
    """All sessions in one row. A session's messages count on every day it was active; ties: earliest day, latest hour."""
    s = summaries(spark, d)
    c = F.col
    tool = lambda *names: sum((F.coalesce(F.sum(F.element_at("tools", n)), F.lit(0)) for n in names), F.lit(0))
    every = F.coalesce(F.aggregate(F.map_values("tools"), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    a = s.agg(
        F.count("*").alias("sessions"), F.sum("msgs").alias("messages"), F.sum("user_msgs").alias("prompts"), F.expr("coalesce(sum(assistant_chars), 0) div 4").alias("output_tokens"), F.countDistinct("project").alias("projects"), F.max("msgs").alias("longest_session"),
        F.sum(every).alias("tool_calls"), tool("edit", "write", "multiedit", "apply_patch").alias("edits"), tool("bash").alias("commands"), tool("grep", "agentgrep", "glob").alias("searches"), tool("browser", "websearch", "webfetch").alias("web"),
        F.array(*(F.sum(F.element_at("hours", i + 1)) for i in range(24))).alias("hours"), F.array(*(F.sum(F.element_at("weekdays", i + 1)) for i in range(7))).alias("weekdays"),
    )
    days = s.select(F.explode("active_dates").alias("day"), F.greatest("msgs", F.lit(1)).alias("n")).groupBy("day").agg(F.sum("n").alias("n"))
    b = days.agg(F.count("*").alias("active_days"), (F.datediff(F.max("day"), F.min("day")) + 1).alias("span_days"), F.max_by("day", F.struct("n", -F.unix_date("day"))).alias("busiest_day"), F.max("n").alias("busiest_messages"))
    runs = series.streaks(days.select(F.lit(1).alias("k"), "day"), "k", "day").agg(F.max("days").alias("longest_streak"))
    peak = F.array_max(F.transform("hours", lambda n, h: F.struct(n.alias("n"), h.alias("h"))))["h"]
    weekend = (F.element_at("weekdays", 6) + F.element_at("weekdays", 7)) / F.aggregate("weekdays", F.lit(0).cast("long"), lambda x, y: x + y)
    r = a.crossJoin(b).crossJoin(runs).withColumns({"peak_hour": peak, "weekend": weekend})  # three single rows
    score = c("tool_calls") + c("edits") * 4.0 + c("prompts") * 2.0 + c("active_days") * 25.0 + c("longest_streak") * 15.0 + c("projects") * 10.0 + c("output_tokens") / 1000
    kinds = F.array(*(F.struct((c(n) * w / F.greatest(c("prompts"), F.lit(1))).alias("share"), F.lit(-i).alias("i"), F.lit(t).alias("name")) for i, (n, w, t) in enumerate((("edits", 1, "The Shipper"), ("commands", 1, "The Operator"), ("searches", 1, "The Explorer"), ("web", 3, "The Researcher")))))
    best = F.array_max(kinds)
    text = lambda n, t: F.concat(c(n).cast("string"), F.lit(t))
    badges = [
        (c("longest_streak") >= 7, text("longest_streak", "-day streak")), (c("projects") >= 10, text("projects", " projects")), (c("output_tokens") >= 10_000_000, F.lit("10M+ tokens generated")), (c("edits") >= 1000, text("edits", " code edits")),
        ((c("peak_hour") <= 4) | (c("peak_hour") >= 22), F.lit("Night owl")), (c("sessions") >= 1000, text("sessions", " sessions")), (c("weekend") > 0.3, F.lit("Weekend warrior")),
    ]
    return r.select(
        *("sessions messages prompts output_tokens projects longest_session tool_calls edits commands searches web active_days span_days busiest_day busiest_messages longest_streak peak_hour".split()), chronotype(c("peak_hour")).alias("chronotype"),
        F.round(score).cast("long").alias("power_score"), F.when(best["share"] <= 0.0001, "The Conversationalist").otherwise(best["name"]).alias("archetype"),
        F.array_join(F.filter(F.array(*(F.when(k, v) for k, v in badges)), lambda x: x.isNotNull()), ", ").alias("badges"),
    )


@query("SELECT hour, weekday, n FROM (SELECT 'h' AS k, hour(created_at) AS hour, NULL::BIGINT AS weekday, count(*) AS n FROM display_messages WHERE session_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 2 UNION ALL SELECT 'w', NULL, isodow(created_at) - 1, count(*) FROM display_messages WHERE session_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 3)")
def summed_histograms(spark, d):
    """Element-wise sums of the sessions' hour and weekday arrays, hours and days without messages left out."""
    s = summaries(spark, d)
    part = lambda a, hour, day: s.select(F.posexplode(a).alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).where("n > 0").select(hour.alias("hour"), day.alias("weekday"), "n")
    none = F.lit(None).cast("long")
    return part("hours", F.col("i").cast("long"), none).unionByName(part("weekdays", none, F.col("i").cast("long")))


@query("""WITH e AS (SELECT session_id, telemetry_id, bool_or(event = 'session_start') AS started, bool_or(event = 'session_end') AS ended, bool_or(event = 'session_crash') AS crashed, count(*) AS events FROM telemetry_events WHERE session_id IS NOT NULL GROUP BY 1, 2)
SELECT CASE WHEN crashed AND ended THEN 'recovered' WHEN crashed THEN 'lost' WHEN started AND ended THEN 'complete' WHEN started THEN 'open' ELSE 'unknown' END AS verdict, count(*) AS sessions, sum(events)::BIGINT AS events FROM e GROUP BY 1""")
def correlated_verdicts(spark, d):
    """Events folded to a record by two keys, session and installation, and a verdict for each."""
    e = table(spark, d, "telemetry_events").where("session_id IS NOT NULL")
    seen = lambda k: F.coalesce(F.bool_or(F.col("event") == k), F.lit(False))
    per = e.groupBy("session_id", "telemetry_id").agg(seen("session_start").alias("started"), seen("session_end").alias("ended"), seen("session_crash").alias("crashed"), F.count("*").alias("events"))
    c = F.col
    verdict = F.when(c("crashed") & c("ended"), "recovered").when(c("crashed"), "lost").when(c("started") & c("ended"), "complete").when(c("started"), "open").otherwise("unknown")
    return per.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


@query("""SELECT sum(n)::BIGINT AS total, sum(n) FILTER (outcome = 'success')::BIGINT AS good, round(coalesce(sum(n) FILTER (outcome = 'success'), 0) / greatest(sum(n), 1), 6) AS conversion_rate, round(coalesce(sum(n) FILTER (outcome = 'failure'), 0) / greatest(sum(n), 1), 6) AS degradation_rate, count(*) AS labels
FROM (SELECT outcome, count(*) AS n FROM install_details GROUP BY 1)""")
def outcome_rates(spark, d):
    """Counts by label and their shares of all, guarded where there is none."""
    n = table(spark, d, "install_details").groupBy("outcome").agg(F.count("*").alias("n"))
    of = lambda k: F.sum(F.when(F.col("outcome") == k, F.col("n")))
    share = lambda k: F.round(F.coalesce(of(k), F.lit(0)) / F.greatest(F.sum("n"), F.lit(1)), 6)
    return n.agg(F.sum("n").alias("total"), of("success").alias("good"), share("success").alias("conversion_rate"), share("failure").alias("degradation_rate"), F.count("*").alias("labels"))


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS active, arg_max(o_orderkey, {d: o_orderdate, k: o_orderkey}) AS latest, arg_max(o_orderstatus, {d: o_orderdate, k: o_orderkey}) AS latest_status FROM orders GROUP BY 1")
def status_buckets(spark, d):
    """Items by status and the latest one, per owner."""
    o = table(spark, d, "orders")
    last = F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("x")
    is_ = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return o.groupBy("o_custkey").agg(is_("F").alias("done"), is_("O").alias("open"), is_("P").alias("active"), last).select("o_custkey", "done", "open", "active", F.col("x.o_orderkey").alias("latest"), F.col("x.o_orderstatus").alias("latest_status"))


@query("""WITH k AS (SELECT o_custkey AS task, count(*) FILTER (o_orderkey % 2 = 0) AS n_a, count(*) FILTER (o_orderkey % 2 = 0 AND o_orderstatus = 'F') AS hit_a, count(*) FILTER (o_orderkey % 2 = 1) AS n_b, count(*) FILTER (o_orderkey % 2 = 1 AND o_orderstatus = 'F') AS hit_b FROM orders GROUP BY 1)
SELECT round(avg(hit_a / n_a) FILTER (n_a > 0), 6) AS macro_a, round(avg(hit_b / n_b) FILTER (n_b > 0), 6) AS macro_b, round(sum(hit_a) / sum(n_a), 6) AS micro_a, round(sum(hit_b) / sum(n_b), 6) AS micro_b, count(*) FILTER (n_a > 0 AND n_b > 0 AND hit_b / n_b < hit_a / n_a) AS regressed FROM k""")
def compared_runs(spark, d):
    """Two runs over the same tasks: mean of the tasks' rates, rate over all trials, and tasks that got worse."""
    o, half = table(spark, d, "orders"), F.col("o_orderkey") % 2
    hit = F.col("o_orderstatus") == "F"
    k = o.groupBy("o_custkey").agg(F.count_if(half == 0).alias("n_a"), F.count_if((half == 0) & hit).alias("hit_a"), F.count_if(half == 1).alias("n_b"), F.count_if((half == 1) & hit).alias("hit_b"))
    rate = lambda x: F.col(f"hit_{x}") / F.nullif(F.col(f"n_{x}"), F.lit(0))
    micro = lambda x: F.round(F.sum(f"hit_{x}") / F.sum(f"n_{x}"), 6)
    return k.agg(F.round(F.avg(rate("a")), 6).alias("macro_a"), F.round(F.avg(rate("b")), 6).alias("macro_b"), micro("a").alias("micro_a"), micro("b").alias("micro_b"), F.count_if(rate("b") < rate("a")).alias("regressed"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderdate AS sent, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders), p AS (SELECT *, prev IS NULL OR prev % 50 = 0 AS is_root FROM o), g AS (SELECT *, sum(is_root::INT) OVER (PARTITION BY c ORDER BY id) AS chain FROM p),
r AS (SELECT id AS root, c, chain, sent AS root_at FROM g WHERE is_root) SELECT g.id, row_number() OVER (PARTITION BY g.c ORDER BY root_at, root, g.id) AS position FROM g JOIN r ON g.c = r.c AND g.chain = r.chain""")
def ordered_chains(spark, d):
    """Messages (here orders) by their chain of parents: chains by their root's time, then down the chain.

    A parent that isn't there (each 50th order is not a message) makes a root.
    """
    from quarryline.operators import graph as G

    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    before = F.lag("o_orderkey").over(w)
    own = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("at"), F.when(before % 50 != 0, before).alias("parent"))
    chains = G.chain_roots(own.select("id", "parent"))
    rows = chains.join(own.select("id", "c"), "id").join(own.select(F.col("id").alias("root"), F.col("at").alias("root_at")), "root")
    return rows.select("id", F.row_number().over(Window.partitionBy("c").orderBy("root_at", "root", "depth")).alias("position"))
