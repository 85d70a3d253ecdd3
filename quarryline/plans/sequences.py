"""Queries on ordered conversations and correlated events: cadence, verdicts, carry-over, set differences, safe cuts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline.common import table
from quarryline.functions import usage
from quarryline.operators import retrieval as R
from quarryline.operators import series
from quarryline.functions import scores
from quarryline.operators.rollups import flag

QUERIES, SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


@query("""SELECT message_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, topic ORDER BY seq, message_id) AS nth FROM (
 SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq, message_id ROWS UNBOUNDED PRECEDING) AS topic FROM display_messages)) WHERE (nth - 1) % 3 = 0""")
def rerank_turns(spark, d):
    """Turns at which a ranking is renewed: the first of a session, every change of topic, and each third since."""
    w = Window.partitionBy("session_id").orderBy("seq", "message_id")
    m = table(spark, d, "display_messages").select("message_id", "session_id", "seq", "role")
    m = m.withColumn("topic", F.sum(flag(F.col("role") == "user")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.row_number().over(Window.partitionBy("session_id", "topic").orderBy("seq", "message_id"))
    return m.withColumn("nth", nth).where("(nth - 1) % 3 = 0").select("message_id")


@query("""SELECT verdict, count(*) AS sessions FROM (SELECT session_id, CASE WHEN max(CASE WHEN event = 'session_crash' THEN 1 ELSE 0 END) = 1 THEN 'crashed' WHEN max(CASE WHEN event = 'session_end' THEN 1 ELSE 0 END) = 1 THEN 'ended'
 WHEN max(CASE WHEN event = 'turn_end' THEN 1 ELSE 0 END) = 1 THEN 'worked' WHEN max(CASE WHEN event = 'session_start' THEN 1 ELSE 0 END) = 1 THEN 'started' ELSE 'unseen' END AS verdict FROM telemetry_events WHERE session_id IS NOT NULL GROUP BY 1) GROUP BY 1""")
def session_verdicts(spark, d):
    """Events of a session folded to one record, and the furthest it got."""
    had = lambda e: F.max(flag(F.col("event") == e)) == 1
    verdict = F.when(had("session_crash"), "crashed").when(had("session_end"), "ended").when(had("turn_end"), "worked").when(had("session_start"), "started").otherwise("unseen")
    per = table(spark, d, "telemetry_events").where("session_id IS NOT NULL").groupBy("session_id").agg(verdict.alias("verdict"))
    return per.groupBy("verdict").agg(F.count("*").alias("sessions"))


@query("""WITH o AS (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders), l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
SELECT o.o_orderkey, count(*) AS shared FROM o JOIN l a ON a.l_orderkey = o.o_orderkey JOIN l b ON b.l_orderkey = o.before AND b.l_suppkey = a.l_suppkey GROUP BY 1""")
def carry_over(spark, d):
    """Suppliers an order shares with the customer's previous one."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, d, "orders").withColumn("before", F.lag("o_orderkey").over(w)).where("before IS NOT NULL").select("o_orderkey", "before")
    own = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"))  # an order has few lines
    a = o.join(own.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    both = a.join(own.select(F.col("l_orderkey").alias("before"), F.col("s").alias("t")), "before")
    return both.select("o_orderkey", F.size(F.array_intersect("s", "t")).cast("long").alias("shared")).where("shared > 0")


@query("""SELECT telemetry_id FROM telemetry_events WHERE created_at >= (SELECT max(received_at) FROM telemetry_events) - INTERVAL 30 DAY EXCEPT
SELECT telemetry_id FROM telemetry_events WHERE created_at < (SELECT max(received_at) FROM telemetry_events) - INTERVAL 30 DAY""")
def new_ids(spark, d):
    """Ids seen in the last 30 days and never before; one row per id with its first time, no set is built twice."""
    e = table(spark, d, "telemetry_events")
    last = e.agg(F.max("received_at")).first()[0]
    first = e.where("created_at IS NOT NULL").groupBy("telemetry_id").agg(F.min("created_at").alias("first"))
    return first.where(F.col("first") >= F.lit(last).cast("timestamp_ntz") - F.expr("INTERVAL 30 DAYS")).select("telemetry_id")


@query("SELECT session_id, coalesce(max(CASE WHEN role <> 'tool' AND after <> 'tool' AND rest >= 4 THEN seq END), 0) AS cut_after FROM (SELECT *, coalesce(lead(role) OVER w, '') AS after, count(*) OVER (PARTITION BY session_id) - row_number() OVER w AS rest FROM display_messages WINDOW w AS (PARTITION BY session_id ORDER BY seq, message_id)) GROUP BY 1")
def safe_cutoffs(spark, d):
    """Last place to cut a conversation that keeps four messages and splits no call from its result."""
    w = Window.partitionBy("session_id").orderBy("seq", "message_id")
    m = table(spark, d, "display_messages").select("session_id", "message_id", "seq", "role")
    m = m.withColumn("after", F.coalesce(F.lead("role").over(w), F.lit(""))).withColumn("rest", F.count("*").over(Window.partitionBy("session_id")) - F.row_number().over(w))
    safe = (F.col("role") != "tool") & (F.col("after") != "tool") & (F.col("rest") >= 4)
    return m.groupBy("session_id").agg(F.coalesce(F.max(F.when(safe, F.col("seq"))), F.lit(0)).alias("cut_after"))


@query("""SELECT event_id, round(least(1.0, value / 100.0 * exp(-floor((epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 8.64e10) / CASE event_type WHEN 'signup' THEN 365.0 WHEN 'purchase' THEN 90.0 WHEN 'view' THEN 30.0 WHEN 'click' THEN 60.0 ELSE 45.0 END * 0.693) * (1 + 0.1 * ln((props->>'$.k')::INT + 1.0))), 8) AS confidence FROM events""")
def decayed_confidence(spark, d):
    """Confidence of an event by its age, kind and use."""
    e = table(spark, d, "events")
    last = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp")
    age = (F.unix_micros(last) - F.unix_micros(F.col("ts").cast("timestamp"))) / 8.64e10
    names = {"signup": "correction", "purchase": "preference", "view": "fact", "click": "entity"}
    kind = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in names.items()), F.lit("other"))
    score = scores.decayed_confidence(F.col("value") / 100.0, age, kind, F.get_json_object("props", "$.k").cast("int"))
    return e.select("event_id", F.round(score, 8).alias("confidence"))


@query("""SELECT event_id, CASE WHEN d <= 0 THEN 1.0 WHEN d < 6 THEN 0.92 WHEN d < 660 THEN 0.68 WHEN d < 25200 THEN 0.45 ELSE 0.25 END::DOUBLE AS freshness FROM (SELECT upload_id AS event_id, (epoch_us(received_at) - epoch_us(created_at)) / 1e6 AS d FROM transcript_uploads)""")
def upload_freshness(spark, d):
    return table(spark, d, "transcript_uploads").select(F.col("upload_id").alias("event_id"), scores.freshness(F.col("created_at"), F.col("received_at")).alias("freshness"))


_PLACES = "(SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS place, count(*) OVER (PARTITION BY l_orderkey) AS n, l_linenumber, l_suppkey FROM lineitem)"


@query(f"""WITH m AS {_PLACES}, r AS (SELECT k, greatest(place - 1 - l_suppkey % 3, 0) AS a, place AS b FROM m WHERE l_linenumber % 2 = 0 AND place > 0), s AS (SELECT DISTINCT k, greatest(n - 2, 0) AS cut FROM m)
SELECT s.k, max(c) AS cut FROM s, unnest(range(0, s.cut + 1)) u(c) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = s.k AND r.a < c AND c <= r.b) GROUP BY 1""")
def paired_cutoffs(spark, d):
    """Where to cut sequences two rows before their end without parting a result from its call."""
    w = Window.partitionBy("l_orderkey")
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1).alias("place"), F.count("*").over(w).alias("n"), "l_linenumber", "l_suppkey")
    call = F.col("place") - 1 - F.col("l_suppkey") % 3
    results = m.where("l_linenumber % 2 = 0 AND place > 0").select("k", F.when(call >= 0, call).alias("call"), "place")
    return series.safe_cuts(results, m.select("k", F.greatest(F.col("n") - 2, F.lit(0)).alias("cut")).distinct(), "k")


@query("SELECT status, status IN ('completed', 'done') AS completed, status IN ('completed', 'done', 'failed', 'stopped', 'crashed') AS terminal, status IN ('running', 'running_stale') AS active, status IN ('failed', 'stopped', 'crashed') AS failed, status IN ('queued', 'ready', 'pending', 'todo') AS runnable, count(*) AS n FROM (SELECT (['done', 'failed', 'running_stale', 'queued', 'odd'])[o_orderkey % 5 + 1] AS status FROM orders) GROUP BY ALL")
def status_classes(spark, d):
    """Classes of an item's status."""
    status = F.element_at(F.array(*map(F.lit, ("done", "failed", "running_stale", "queued", "odd"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    own = table(spark, d, "orders").select(status.alias("status"))
    return own.groupBy("status", *(c.alias(n) for n, c in usage.status_classes(F.col("status")).items())).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 30), j AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS new_rank FROM c WHERE rank % 3 = 0)
SELECT doc_id, row_number() OVER (ORDER BY coalesce(new_rank, rank + 1000000), doc_id) AS position FROM c LEFT JOIN j USING (doc_id)""")
def composed_ranking(spark, d):
    """Candidates in the order a given ranking puts them, the rest behind; the ranking itself is an input (a table)."""
    c = R.ranked(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 30).select("doc_id", "rank")
    given = c.where("rank % 3 = 0").select("doc_id", F.row_number().over(Window.orderBy("doc_id")).alias("rank"))  # at most 30 rows
    both = R.compose(c, given, "doc_id", keep_rest=True)
    return both.select("doc_id", F.row_number().over(Window.orderBy("position", "doc_id")).cast("long").alias("position"))


@query("""SELECT model, provider, cost FROM (SELECT lower('P-' || p_size) AS model, lower(p_brand) AS provider, p_retailprice AS cost, CASE lower(p_brand) WHEN 'brand#11' THEN 0 WHEN 'brand#23' THEN 1 ELSE 999 END AS pref FROM part WHERE p_retailprice > 0) QUALIFY row_number() OVER (PARTITION BY model ORDER BY pref, cost, provider) = 1""")
def flat_catalogue(spark, d):
    """A nested catalogue (provider to model to cost, as JSON) flattened; of each model the preferred provider's entry."""
    p = table(spark, d, "part")
    entry = F.to_json(F.create_map(F.lower("p_brand"), F.struct(F.create_map(F.concat(F.lit("P-"), F.col("p_size").cast("string")), F.struct(F.struct(F.col("p_retailprice").alias("input")).alias("cost"))).alias("models"))))
    parsed = p.select(F.from_json(entry, "map<string,struct<models:map<string,struct<cost:struct<input:double>>>>>").alias("c"))
    return nested_catalogue(parsed, "c", ["brand#11", "brand#23"])


def nested_catalogue(df, column, preference):
    """model, provider, cost of provider -> models -> cost: entries without a cost left out, one per model by preference, then cost."""
    rows = df.select(F.explode(column).alias("provider", "p")).select("provider", F.explode("p.models").alias("model", "m")).where("m.cost.input IS NOT NULL")
    place = F.coalesce(F.create_map(*(x for i, n in enumerate(preference) for x in (F.lit(n), F.lit(i))))[F.col("provider")], F.lit(999))
    best = F.min(F.struct(place.alias("place"), F.col("m.cost.input").alias("cost"), "provider")).alias("b")
    return rows.groupBy(F.lower("model").alias("model")).agg(best).select("model", "b.provider", "b.cost")


def nation_order(spark, d):
    """Nations in an order with little weight of supplies running backwards; the graph has a node per nation."""
    from quarryline.operators.graph import feedback_order

    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    buyers = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_nationkey").alias("dst"))
    edges = li.join(s, "l_suppkey").join(buyers, "l_orderkey").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return feedback_order(edges)


QUERIES["nation_order"] = nation_order


def redacted_calls(spark, d):
    """Arguments of tool calls with secrets and the values of sensitive keys hidden, at any depth."""
    from quarryline.plans.filters import calls
    from quarryline.sources.transcripts import redact_json_of

    return calls(spark, d).where("args <> ''").select("message_id", "tool", redact_json_of(F.col("args")).alias("args"))


QUERIES["redacted_calls"] = redacted_calls
