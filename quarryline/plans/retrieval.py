"""Queries of session search, the stored index, memory recall, ranking rules and log mining."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline.common import shared_folder, table
from quarryline.functions import filters as C
from quarryline.functions import scores
from quarryline.functions import text as X
from quarryline.functions import usage as U
from quarryline.operators import retrieval as R
from quarryline.operators import search_index as I
from quarryline.operators import series

QUERIES, SQL = {}, {}
QUERY = "session index cache"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def docs(spark, d):
    return table(spark, d, "documents")


def _index(spark, d):
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    stamp = F.concat_ws("/", F.octet_length("text").cast("string"), F.col("created_at").cast("string"))
    # Half of the documents first, then all: the second call adds the rest only.
    I.build(docs(spark, d).where("doc_id % 2 = 0"), "doc_id", "text", stamp, folder)
    I.build(docs(spark, d), "doc_id", "text", stamp, folder)
    return folder


_W = "(SELECT doc_id, list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL)"


@query(f"SELECT doc_id AS doc FROM {_W.format(t='strip_accents(text)')} WHERE list_contains(w, 'session')::INT + list_contains(w, 'index')::INT + list_contains(w, 'cache')::INT >= 2")
def index_candidates(spark, d):
    """Documents the index offers for a query, by whole words."""
    return I.candidates(spark, _index(spark, d), QUERY)


@query(f"""WITH c AS (SELECT doc_id, len(w) AS dl, len(list_filter(w, lambda x: x = 'session')) AS a, len(list_filter(w, lambda x: x = 'index')) AS b, len(list_filter(w, lambda x: x = 'cache')) AS e FROM {_W.format(t='text')}),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db, count(*) FILTER (e > 0) AS de FROM c)
SELECT doc_id AS doc, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl))
 + ln(1 + (n - de + 0.5) / (de + 0.5)) * e * 2.2 / (e + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM c, s WHERE a + b + e > 0""")
def indexed_bm25(spark, d):
    """BM25 from the stored index; the texts aren't read by the query."""
    return I.bm25(spark, _index(spark, d), QUERY).select("doc", F.round("score", 6).alias("score"))


_SCORE = """(CASE WHEN contains(lower({t}), 'memory panel') THEN 4.0 ELSE 0.0 END + {f} / 2.0 * 3.0 + {f} * 0.25 + ({h}) / (strlen({t}) + 1.0) * 200.0)"""


def _scored_sql(t):
    f = f"(contains(lower({t}), 'memory')::INT + contains(lower({t}), 'panel')::INT)"
    h = " + ".join(f"(length(lower({t})) - length(replace(lower({t}), '{w}', ''))) // {len(w)}" for w in ("memory", "panel"))
    return _SCORE.format(t=t, f=f, h=h), f


_TEXT = "concat_ws(chr(10), nullif(content, ''), nullif(array_to_string(tool_calls, chr(10)), ''))"
_META = "'Session ID: ' || session_id || chr(10) || 'Title: memory panel ' || left(session_id, 12)"
_M, _MF = _scored_sql("body")


@query(f"""WITH m AS (SELECT session_id, message_id, created_at, role NOT IN ('user', 'assistant', 'tool') OR starts_with(ltrim(coalesce(content, '')), '<system-reminder>') AS hidden, coalesce(trim(content), '') = '' AND len(coalesce(tool_calls, [])) > 0 AS only_tools, {_TEXT} AS body FROM display_messages),
hits AS (SELECT session_id, message_id, created_at, 'message' AS kind, {_M} * CASE WHEN only_tools THEN 0.4 ELSE 1.0 END AS score FROM m WHERE NOT hidden AND {_MF} >= 2 AND created_at BETWEEN '2026-03-01' AND '2026-05-31'),
s AS (SELECT session_id, max(created_at) AS created_at FROM display_messages WHERE session_id IS NOT NULL GROUP BY 1), meta AS (SELECT session_id, NULL::BIGINT AS message_id, created_at, 'metadata' AS kind, {_M} + 2.0 AS score FROM (SELECT *, {_META} AS body FROM s) WHERE created_at BETWEEN '2026-03-01' AND '2026-05-31')
SELECT session_id, message_id, kind, round(score, 6) AS score FROM (SELECT * FROM hits UNION ALL SELECT * FROM meta) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY round(score, 6) DESC, created_at DESC, message_id NULLS FIRST) <= 3""")
def session_search(spark, d):
    """Hits in messages and in what is known of sessions: filtered, scored (metadata gains 2, tool-only messages count
    two fifths), the best three of each session by score, time and place."""
    wanted, m = "memory panel", table(spark, d, "display_messages")
    body = F.concat_ws("\n", F.nullif("content", F.lit("")), F.nullif(F.array_join("tool_calls", "\n"), F.lit("")))
    from datetime import datetime

    inside = C.within(F.col("created_at"), *(F.lit(datetime(2026, *x)).cast("timestamp_ntz") for x in ((3, 1), (5, 31))))
    hidden = C.system_like(F.when(F.col("role") == "tool", "user").otherwise(F.col("role")), F.col("content"))
    tools = C.tool_only(F.col("content"), F.col("tool_calls"))
    hits = m.where(~hidden & inside).select("session_id", "message_id", "created_at", F.lit("message").alias("kind"), (X.lexical_score(body, wanted) * F.when(tools, 0.4).otherwise(1.0)).alias("score"))
    s = m.where("session_id IS NOT NULL").groupBy("session_id").agg(F.max("created_at").alias("created_at"))
    meta = F.concat(F.lit("Session ID: "), "session_id", F.lit("\nTitle: memory panel "), F.substring("session_id", 1, 12))
    of_sessions = s.where(inside).select("session_id", F.lit(None).cast("long").alias("message_id"), "created_at", F.lit("metadata").alias("kind"), (X.lexical_score(meta, wanted) + 2.0).alias("score"))
    both = hits.unionByName(of_sessions).where("score IS NOT NULL").withColumn("score", F.round("score", 6))
    best = series.cap_per_group(both, ["session_id"], [F.desc("score"), F.desc("created_at"), F.asc_nulls_first("message_id")], 3)
    return best.select("session_id", "message_id", "kind", "score")


@query("""SELECT session_id, message_id, score FROM (SELECT session_id, message_id, seq, created_at, (length(lower(content)) - length(replace(lower(content), 'the', ''))) // 3 AS score FROM display_messages WHERE content IS NOT NULL)
ORDER BY score DESC, created_at DESC, session_id, seq, message_id LIMIT 100""")
def ordered_hits(spark, d):
    """Hits in the order of score, time, session and position."""
    m = table(spark, d, "display_messages").where("content IS NOT NULL").withColumn("score", X.occurrences(F.lower("content"), "the").cast("long"))
    return m.orderBy(F.desc("score"), F.desc("created_at"), "session_id", "seq", "message_id").limit(100).select("session_id", "message_id", "score")


@query("SELECT session_id, coalesce(last_active, updated) AS recent FROM (SELECT session_id, max(CASE WHEN role = 'user' THEN created_at END) AS last_active, max(created_at) AS updated FROM display_messages WHERE session_id IS NOT NULL GROUP BY 1) ORDER BY recent DESC, session_id LIMIT 50")
def recent_sessions(spark, d):
    m = table(spark, d, "display_messages").where("session_id IS NOT NULL")
    s = m.groupBy("session_id").agg(F.coalesce(F.max(F.when(F.col("role") == "user", F.col("created_at"))), F.max("created_at")).alias("recent"))
    return s.orderBy(F.desc("recent"), "session_id").limit(50)


@query("SELECT provider_end, model_end, arg_min(id, {rank: CASE build_channel WHEN 'release' THEN 0 WHEN 'ci_release' THEN 1 ELSE 2 END, id: id}) AS id FROM telemetry_events WHERE event = 'session_end' AND provider_end IS NOT NULL AND model_end IS NOT NULL GROUP BY 1, 2")
def preferred_routes(spark, d):
    """One row per provider and model: the preferred channel's first."""
    rank = U.pick(F.col("build_channel"), {"release": 0, "ci_release": 1}, 2)
    e = table(spark, d, "telemetry_events").where("event = 'session_end' AND provider_end IS NOT NULL AND model_end IS NOT NULL")
    return e.groupBy("provider_end", "model_end").agg(F.min_by("id", F.struct(rank, "id")).alias("id"))


@query("SELECT doc_id FROM documents WHERE contains(trim(regexp_replace(lower(text), '[\\s\\-_/\\\\.:]+', ' ', 'g')), 'side panel')")
def memory_search(spark, d):
    """Documents that hold a phrase, both in search form."""
    return docs(spark, d).where(X.search_normalise(F.col("text")).contains("side panel")).select("doc_id")


@query("""WITH s AS (SELECT doc_id, rank() OVER (ORDER BY doc_id) AS k FROM documents WHERE contains(lower(text), 'panel') AND doc_id NOT IN (SELECT doc_id - 1 FROM documents WHERE doc_id % 5 = 0)) SELECT doc_id FROM s""")
def current_hits(spark, d):
    """Hits without the documents that another one supersedes (here each fifth the one before it)."""
    t = docs(spark, d)
    gone = t.where("doc_id % 5 = 0").select((F.col("doc_id") - 1).alias("doc_id"))
    return t.where(F.lower("text").contains("panel")).select("doc_id").join(gone, "doc_id", "left_anti")


_ENDPOINTS = "(SELECT s_suppkey, s_nationkey, s_acctbal / 50.0 AS speed, 90 + s_suppkey % 11 AS uptime, (s_suppkey % 7) / 1e6::DOUBLE AS cost, s_suppkey % 4 = 0 AS caches, s_suppkey % 9 = 1 AS down FROM supplier)"


@query(f"""WITH e AS (SELECT *, bool_or(caches) OVER (PARTITION BY s_nationkey) AS any_cache, bool_or(caches AND NOT down) OVER (PARTITION BY s_nationkey) AS usable FROM {_ENDPOINTS})
SELECT s_nationkey, s_suppkey, round(0.5::DOUBLE * least(greatest(speed, 0), 200) / 200 + 0.3::DOUBLE * uptime / 100 + 0.2::DOUBLE * CASE WHEN cost > 0 THEN 1 / (1 + cost * 1e6) ELSE 0.5 END, 9) AS score FROM e WHERE NOT down AND (caches OR NOT any_cache OR NOT usable)""")
def ranked_endpoints(spark, d):
    """Endpoints that are up by throughput, uptime and cost; those that cache alone where one of them is up."""
    s = table(spark, d, "supplier")
    e = s.select("s_suppkey", "s_nationkey", (F.col("s_acctbal") / 50.0).alias("speed"), (F.col("s_suppkey") % 11 + 90).alias("uptime"), ((F.col("s_suppkey") % 7) / 1e6).alias("cost"), (F.col("s_suppkey") % 4 == 0).alias("caches"), (F.col("s_suppkey") % 9 == 1).alias("down"))
    w = Window.partitionBy("s_nationkey")
    usable = F.bool_or(F.col("caches") & ~F.col("down")).over(w)
    score = 0.5 * F.least(F.greatest(F.col("speed"), F.lit(0.0)), F.lit(200.0)) / 200 + 0.3 * F.col("uptime") / 100 + 0.2 * F.when(F.col("cost") > 0, 1 / (1 + F.col("cost") * 1e6)).otherwise(0.5)
    return e.withColumn("usable", usable).where(~F.col("down") & (F.col("caches") | ~F.col("usable"))).select("s_nationkey", "s_suppkey", F.round(score, 9).alias("score"))


_BASE = {"BUILDING": 50.0, "MACHINERY": 30.0, "AUTOMOBILE": 20.0, "FURNITURE": 10.0}
_RELEVANT = "(SELECT c_custkey, c_mktsegment, round((100.0 / (1 + (c_custkey % 500) / 24.0::DOUBLE) + sqrt(c_custkey % 13) * 10 + CASE c_mktsegment WHEN 'BUILDING' THEN 50 WHEN 'MACHINERY' THEN 30 WHEN 'AUTOMOBILE' THEN 20 WHEN 'FURNITURE' THEN 10 ELSE 5 END) * CASE c_custkey % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.7 END::DOUBLE + ln(1 + c_custkey % 5) * 5, 6) AS score FROM customer WHERE c_acctbal > 0 ORDER BY score DESC, c_custkey LIMIT 40)"


def _relevant(spark, d):
    c, k = table(spark, d, "customer").where("c_acctbal > 0"), F.col("c_custkey")
    trust = F.when(k % 3 == 0, 1.5).when(k % 3 == 1, 1.0).otherwise(0.7)
    score = scores.relevance(k % 500, k % 13, U.pick(F.col("c_mktsegment"), _BASE, 5.0), trust, k % 5 + 1)
    return R.top_k(c.select("c_custkey", "c_mktsegment", F.round(score, 6).alias("score")), "score", "c_custkey", 40)


@query(f"SELECT c_custkey, score FROM {_RELEVANT}")
def relevant_records(spark, d):
    """The most relevant of the active records."""
    return _relevant(spark, d).select("c_custkey", "score")


@query(f"""SELECT string_agg(section, chr(10) ORDER BY place, title) AS prompt FROM (SELECT place, title, '## ' || title || chr(10) || string_agg(line, '' ORDER BY k) AS section FROM (SELECT title, place, k, k || '. item ' || c_custkey || chr(10) AS line FROM (SELECT c_custkey,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'Corrections' WHEN 'MACHINERY' THEN 'Facts' WHEN 'AUTOMOBILE' THEN 'Preferences' ELSE c_mktsegment END AS title, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 WHEN 'AUTOMOBILE' THEN 2 ELSE 9 END AS place, row_number() OVER (PARTITION BY c_mktsegment ORDER BY score DESC, c_custkey) AS k FROM {_RELEVANT})) GROUP BY 1, 2)""")
def prompt_sections(spark, d):
    """Relevant records as text: sections in a fixed order, others by name, items numbered by score."""
    names = {"BUILDING": "Corrections", "MACHINERY": "Facts", "AUTOMOBILE": "Preferences"}
    place = U.pick(F.col("c_mktsegment"), {"BUILDING": 0, "MACHINERY": 1, "AUTOMOBILE": 2}, 9)
    own = _relevant(spark, d).select(U.pick(F.col("c_mktsegment"), names, F.col("c_mktsegment")).alias("title"), place.alias("place"), F.struct((-F.col("score")).alias("s"), "c_custkey").alias("item"))
    per = own.groupBy("place", "title").agg(F.array_sort(F.collect_list("item")).alias("items"))  # at most the 40 chosen
    lines = F.transform("items", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". item "), x["c_custkey"].cast("string"), F.lit("\n")))
    sections = per.select("place", "title", F.concat(F.lit("## "), "title", F.lit("\n"), F.array_join(lines, "")).alias("section"))
    return sections.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "title", "section"))), lambda x: x["section"]), "\n").alias("prompt"))


@query("SELECT doc_id, n_nationkey FROM (SELECT doc_id, upper(CASE doc_id % 4 WHEN 0 THEN 'France' WHEN 1 THEN 'kenya' WHEN 2 THEN 'nowhere' ELSE 'N-07' END) AS name FROM documents) JOIN nation ON name = upper(n_name) OR name = 'N-' || lpad(n_nationkey::VARCHAR, 2, '0')")
def resolved_identities(spark, d):
    """Records meant by a name, whatever its case: it is one of their keys or aliases."""
    n = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(F.lower("n_name"), F.format_string("n-%02d", F.col("n_nationkey")))).alias("name"))
    k = F.col("doc_id") % 4
    asked = docs(spark, d).select("doc_id", F.lower(F.when(k == 0, "France").when(k == 1, "kenya").when(k == 2, "nowhere").otherwise("N-07")).alias("name"))
    return asked.join(F.broadcast(n), "name").select("doc_id", "n_nationkey").distinct()  # two names a nation


@query("SELECT project, max(created_at) AS last FROM documents WHERE coalesce(trim(project), '') NOT IN ('', 'skerry') GROUP BY 1 ORDER BY last DESC, 1 LIMIT 1")
def latest_project(spark, d):
    """The project used last, left-out ones aside; ties by name."""
    p = docs(spark, d).where("coalesce(trim(project), '') NOT IN ('', 'skerry')").groupBy("project").agg(F.max("created_at").alias("last"))
    return p.orderBy(F.desc("last"), "project").limit(1)


_E = "(SELECT user_id, value, epoch_ms(ts) AS t, epoch_ms(ts) - lag(epoch_ms(ts)) OVER w AS gap, epoch_ms(ts) - min(epoch_ms(ts)) OVER (PARTITION BY user_id) AS since FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query(f"""WITH e AS {_E}, s AS (SELECT user_id, count(*) AS events, avg(value) AS mean_chunk, max(value) AS max_chunk, avg(gap) AS mean_gap, max(gap) AS max_gap, max(since) AS span FROM e GROUP BY 1),
n AS (SELECT user_id, greatest(span // 86400000, 1) + 1 AS buckets FROM s), b AS (SELECT user_id, least(since // 86400000, buckets - 1) AS k, sum(value) AS v FROM e JOIN n USING (user_id) GROUP BY ALL),
c AS (SELECT user_id, sum(v) / any_value(buckets) AS m, sum(v * v) / any_value(buckets) AS q, max(v) AS top FROM b JOIN n USING (user_id) GROUP BY 1)
SELECT s.user_id, events, round(mean_chunk, 6) AS mean_chunk, max_chunk, round(mean_gap, 3) AS mean_gap_ms, max_gap AS max_gap_ms, span AS span_ms, round(CASE WHEN m = 0 THEN 0 ELSE sqrt(greatest(q - m * m, 0)) / m END, 6) AS bucket_variation, round(greatest(top, 0), 6) AS bucket_max FROM s JOIN c USING (user_id)""")
def series_stats(spark, d):
    """Chunks, gaps and buckets (a day wide here) of each series; buckets without events count as 0."""
    return series.series_stats(table(spark, d, "events"), "user_id", "ts", "event_id", "value", 86_400_000)


@query("SELECT l_partkey AS path, max(l_quantity) AS structure, max(l_discount) AS body, max(l_tax) AS version, count(DISTINCT l_shipmode) AS reasons FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1")
def merged_context(spark, d):
    """What is known of a file from several sights: the most of each confidence, and all reasons."""
    li = table(spark, d, "lineitem")
    reasons = F.collect_set(F.concat("l_returnflag", "l_linestatus"))
    return li.groupBy(F.col("l_partkey").alias("path")).agg(F.max("l_quantity").alias("structure"), F.max("l_discount").alias("body"), F.max("l_tax").alias("version"), F.size(reasons).cast("long").alias("reasons"))


@query("""SELECT message_id, round(CASE WHEN old THEN 0.42 WHEN r >= 0.85 THEN 1.0 WHEN r >= 0.6 THEN 0.88 ELSE 0.72 END * 0.8::DOUBLE, 9) AS body, round(0.9::DOUBLE * (0.75 + 0.25 * CASE WHEN old THEN 0.42 WHEN r >= 0.85 THEN 1.0 WHEN r >= 0.6 THEN 0.88 ELSE 0.72 END::DOUBLE), 9) AS structure
FROM (SELECT message_id, k < n // 10 AS old, CASE WHEN n <= 1 THEN 1.0 ELSE (k + 1) / n::DOUBLE END AS r FROM (SELECT message_id, row_number() OVER (PARTITION BY session_id ORDER BY seq, message_id) - 1 AS k, count(*) OVER (PARTITION BY session_id) AS n FROM display_messages))""")
def exposure_confidence(spark, d):
    """Confidences by how far back in its session something was seen, and whether that part was compacted since."""
    w = Window.partitionBy("session_id")
    m = table(spark, d, "display_messages").select("message_id", (F.row_number().over(w.orderBy("seq", "message_id")) - 1).alias("k"), F.count("*").over(w).alias("n"))
    body, structure = scores.exposure(F.lit(0.8), F.lit(0.9), F.col("k"), F.col("n"), F.expr("n div 10"))
    return m.select("message_id", F.round(body, 9).alias("body"), F.round(structure, 9).alias("structure"))


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN contains(line, 'EVENT event=SERVER_REQUEST') AND contains(line, 'phase=received') THEN 'req_' || regexp_extract(line, 'kind=([a-z_]+)', 1) WHEN contains(line, 'EVENT event=TOOL') AND contains(line, 'phase=start') THEN 'tool_start' WHEN contains(line, 'Assistant:') AND NOT contains(line, 'EVENT event=') THEN 'assistant_turns' END AS kind
FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'EVENT event=SERVER_REQUEST_LIFECYCLE phase=received kind=message' WHEN 1 THEN 'EVENT event=SERVER_REQUEST_LIFECYCLE phase=done kind=message' WHEN 2 THEN 'EVENT event=TOOL_LIFECYCLE phase=start' WHEN 3 THEN 'Assistant: ok' ELSE 'idle' END AS line FROM orders)) WHERE kind IS NOT NULL GROUP BY 1""")
def mined_usage(spark, d):
    """Counts of what log lines mark; one per request."""
    k = F.col("o_orderkey") % 5
    line = F.when(k == 0, "EVENT event=SERVER_REQUEST_LIFECYCLE phase=received kind=message").when(k == 1, "EVENT event=SERVER_REQUEST_LIFECYCLE phase=done kind=message").when(k == 2, "EVENT event=TOOL_LIFECYCLE phase=start").when(k == 3, "Assistant: ok").otherwise("idle")
    return X.log_marks(table(spark, d, "orders").select(line.alias("line")), "line")


@query("""SELECT provider, count(*) AS uses, sum(new)::BIGINT AS new_tokens, sum(read)::BIGINT AS read_tokens, count(*) FILTER (new + read > 1024 AND read = 0) AS cold, count(*) FILTER (pct >= 90) AS p90, count(*) FILTER (pct >= 70 AND pct < 90) AS p70, count(*) FILTER (pct >= 50 AND pct < 70) AS p50, count(*) FILTER (pct > 0 AND pct < 50) AS p1, count(*) FILTER (pct = 0) AS p0
FROM (SELECT 's' || l_suppkey % 3 AS provider, l_partkey AS new, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_orderkey END AS read, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity * 2 END AS pct FROM lineitem) GROUP BY 1""")
def cache_log(spark, d):
    """Use of a cache by provider from key=value log lines: tokens, cold requests, and how much was read."""
    li = table(spark, d, "lineitem")
    read = F.when(F.col("l_linenumber") == 1, 0).otherwise(F.col("l_orderkey"))
    pct = F.when(F.col("l_linenumber") == 2, "None").otherwise((F.col("l_quantity") * 2).cast("string"))
    line = F.format_string("KV_CACHE_USAGE provider=s%d input=%d cache_read=%d read_pct=%s", F.col("l_suppkey") % 3, "l_partkey", read, pct)
    return X.cache_usage(li.select(line.alias("line")), "line")


@query("SELECT target, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])(?:src|docs|lib)/([a-z_]+)', 1)) AS target FROM documents) GROUP BY 1")
def module_references(spark, d):
    """References to modules in texts, as weights of edges."""
    r = docs(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|[^A-Za-z0-9_])(?:src|docs|lib)/([a-z_]+)"), F.lit(1))).alias("target"))
    return r.groupBy("target").agg(F.count("*").alias("n"))


def focused_queries(spark, d):
    """Each document that is a conversation as a query, the user's last words first."""
    own = docs(spark, d).where(F.col("text").rlike(r"(?m)^(?:user|assistant):"))
    marked = F.regexp_replace(F.regexp_replace("text", r"(?m)^user:", "User:"), r"(?m)^assistant:", "Assistant:")
    return own.select("doc_id", X.focused_query(F.regexp_replace(marked, r"(?m)^\[([a-z_]+)\]", "[Tool: $1]")).alias("query"))


QUERIES["focused_queries"] = focused_queries
