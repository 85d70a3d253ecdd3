"""Queries of searches' and reports' filters, of tool calls, plans, model labels and pages."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from quarryline.common import table
from quarryline.functions import filters as C
from quarryline.functions import text as X
from quarryline.functions import usage as U

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _time(text: str):
    return F.lit(datetime.datetime.fromisoformat(text)).cast("timestamp_ntz")


@query("""SELECT model_end, count(*) AS sessions FROM telemetry_events WHERE event = 'session_end' AND contains(lower(model_end), 'mini') AND contains(lower(provider_end), 'r')
AND coalesce(is_ci, 0) = 0 AND build_channel = 'release' AND created_at BETWEEN '2026-03-10' AND '2026-05-20 12:00:00' GROUP BY 1""")
def filtered_sessions(spark, d):
    """Sessions by model and provider text, flags and a time range, both ends included."""
    c = F.col
    own = table(spark, d, "telemetry_events").where(
        (c("event") == "session_end") & C.field_matches(c("model_end"), "MINI") & C.field_matches(c("provider_end"), "r") & C.flag_matches(c("is_ci"), False)
        & C.flag_matches(c("build_channel") == "release", True) & C.within(c("created_at"), _time("2026-03-10"), _time("2026-05-20 12:00:00"))
    )
    return own.groupBy("model_end").agg(F.count("*").alias("sessions"))


@query("""SELECT 'folder' AS kind, count(*) AS n FROM memory_samples WHERE lower(path) = 'node-00' OR starts_with(lower(path), 'node-00/') OR contains(lower(path), 'node-00')
UNION ALL SELECT 'prefix', count(*) FROM memory_samples WHERE lower(path) = 'node-00/server' OR starts_with(lower(path), 'node-00/server/')
UNION ALL SELECT 'fragment', count(*) FROM memory_samples WHERE contains(lower(path), 'client-runtime')""")
def path_filters(spark, d):
    """Samples by folder, by a path that isn't one, and by a fragment of the path."""
    m = table(spark, d, "memory_samples")
    wanted = {"folder": "Node-00/", "prefix": "node-00\\server", "fragment": "client-runtime"}
    counts = m.agg(*(F.count_if(C.path_matches(F.col("path"), w)).alias(k) for k, w in wanted.items()))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in wanted))))


@query("""SELECT role NOT IN ('user', 'assistant') OR coalesce(starts_with(ltrim(content), '<system-reminder>'), false) AS system_like, len(tool_calls) > 0 AND coalesce(trim(content), '') = '' IS TRUE AS tool_only, count(*) AS n
FROM (SELECT role, content, coalesce(tool_calls, []) AS tool_calls FROM display_messages) GROUP BY ALL""")
def message_kinds(spark, d):
    m = table(spark, d, "display_messages")
    kinds = C.system_like(F.col("role"), F.col("content")).alias("system_like"), C.tool_only(F.col("content"), F.col("tool_calls")).alias("tool_only")
    return m.groupBy(*kinds).agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS valid FROM orders, (SELECT max(o_orderdate) AS now FROM orders) WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' AND now >= o_orderdate
AND (o_custkey % 3 = 0 OR now < o_orderdate + INTERVAL 400 DAY)""")
def valid_records(spark, d):
    """Records active, not deprecated and within their time, a third of them without an end."""
    o = table(spark, d, "orders")
    now = F.lit(o.agg(F.max("o_orderdate")).first()[0])
    status, end = F.when(F.col("o_orderstatus") == "O", "active"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS"))
    return o.where(C.retrievable(status, F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate"), end, now)).agg(F.count("*").alias("valid"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN ts::DATE::TIMESTAMP WHEN 1 THEN date_trunc('second', ts) END AS parsed FROM events""")
def parsed_times(spark, d):
    """Times written as a date, as RFC 3339 with an offset, and in a form that isn't accepted."""
    e, k = table(spark, d, "events"), F.col("event_id") % 3
    later = F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k == 0, F.date_format("ts", " yyyy-MM-dd")).when(k == 1, F.concat(later, F.lit("+02:00"))).otherwise(F.date_format("ts", "dd.MM.yyyy"))
    return e.select("event_id", C.parsed_time(text).cast("timestamp_ntz").alias("parsed"))


@query("""SELECT label, regexp_matches(lower(label), '^mock$|^unknown$|^default$|^auto(/.*)?$|^pool[0-9]*$|^free$|^openrouter/free$|:free$|-free$|^ollama/|:cloud$|^qwen[0-9.]*(-coder)?:[0-9]+b$|^qwen[0-9][0-9.]*:[0-9]+b$|-coding-plan/|-token-plan') AS free, count(*) AS sessions
FROM (SELECT CASE WHEN id % 7 = 0 THEN model_end || ':free' WHEN id % 11 = 0 THEN 'ollama/' || model_end ELSE model_end END AS label FROM telemetry_events WHERE event = 'session_end') GROUP BY ALL""")
def free_models(spark, d):
    label = F.when(F.col("id") % 7 == 0, F.concat("model_end", F.lit(":free"))).when(F.col("id") % 11 == 0, F.concat(F.lit("ollama/"), "model_end")).otherwise(F.col("model_end"))
    own = table(spark, d, "telemetry_events").where("event = 'session_end'").select(label.alias("label"))
    return own.groupBy("label", C.free_label(F.col("label")).alias("free")).agg(F.count("*").alias("sessions"))


_CALLS = "(SELECT message_id, session_id, split_part(c, ' ', 1) AS tool, regexp_extract(c, '(\\{.*\\})', 1) AS args FROM (SELECT message_id, session_id, unnest(tool_calls) AS c FROM display_messages))"


def calls(spark, d):
    c = table(spark, d, "display_messages").select("message_id", "session_id", F.explode("tool_calls").alias("c"))
    return c.select("message_id", "session_id", F.split("c", " ")[0].alias("tool"), F.regexp_extract("c", r"(\{.*\})", 1).alias("args"))


@query(f"""SELECT tool, count(*) AS calls, count(*) FILTER (regexp_matches(lower(tool), 'cargo test|pytest|jest| test') OR regexp_matches(coalesce(lower(TRY_CAST(args AS JSON)->>'$.command'), ''), 'cargo test|npm test|pytest|jest|go test|rspec| test')) AS test_runs FROM {_CALLS} GROUP BY 1""")
def test_runs(spark, d):
    return calls(spark, d).groupBy("tool").agg(F.count("*").alias("calls"), F.count_if(U.test_run(F.col("tool"), F.col("args"))).alias("test_runs"))


@query("SELECT tool, count(*) AS uses FROM (SELECT unnest(CASE WHEN l_linenumber = 1 THEN ['batch', 'read', 'edit'] ELSE [CASE l_linenumber WHEN 2 THEN 'read' WHEN 3 THEN 'todo' ELSE 'bash' END] END) AS tool FROM lineitem) GROUP BY 1")
def expanded_calls(spark, d):
    """Calls by canonical name, inner calls of batches counted beside the batch."""
    k = F.col("l_linenumber")
    name = F.when(k == 1, "batch").when(k == 2, "file_read").when(k == 3, "todowrite").otherwise("bash")
    args = F.when(k == 1, '{"tool_calls":[{"tool":"read"},{"tool":"file_edit"},{"other":1}]}')
    return table(spark, d, "lineitem").select(F.explode(U.expanded_tools(name, args)).alias("tool")).groupBy("tool").agg(F.count("*").alias("uses"))


@query("SELECT server, count(*) AS n FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'docs' WHEN 1 THEN 'files' END AS server FROM part) GROUP BY 1")
def mcp_servers(spark, d):
    k = F.col("p_size") % 4
    name = F.when(k == 0, "mcp__docs__find").when(k == 3, "bash").otherwise("mcp")
    args = F.when(k == 1, '{"server":"\x1b[1mfiles\x1b[0m "}').otherwise('{"server":"  "}')
    return table(spark, d, "part").select(U.mcp_server(name, args).alias("server")).groupBy("server").agg(F.count("*").alias("n"))


@query(f"""SELECT session_id, bool_or(tool IN ('write', 'edit', 'multiedit', 'patch', 'apply_patch')) AS coding, bool_or(tool IN ('webfetch', 'websearch', 'codesearch', 'open')) AS research, bool_or(tool = 'swarm') AS swarm,
 bool_or(prompt) AND NOT (bool_or(tool IN ('write', 'edit', 'multiedit', 'patch', 'apply_patch')) OR bool_or(tool IN ('webfetch', 'websearch', 'codesearch', 'open')) OR bool_or(tool = 'swarm')) AS chat_only
FROM (SELECT session_id, role = 'user' AS prompt, split_part(unnest(CASE WHEN len(coalesce(tool_calls, [])) = 0 THEN [''] ELSE tool_calls END), ' ', 1) AS tool FROM display_messages) GROUP BY 1""")
def workflow(spark, d):
    """How each session was used; chat_only: a prompt and nothing else."""
    m = table(spark, d, "display_messages").select("session_id", (F.col("role") == "user").alias("prompt"), F.explode_outer("tool_calls").alias("c"))
    tool = F.coalesce(F.split("c", " ")[0], F.lit(""))
    per = m.groupBy("session_id").agg(F.bool_or("prompt").alias("prompt"), *(F.bool_or(X.tool_category(tool) == k).alias(n) for n, k in (("coding", "write"), ("research", "web"), ("swarm", "swarm"))))
    flags = U.workflow_flags(F.col("prompt"), coding=F.col("coding"), research=F.col("research"), swarm=F.col("swarm"))
    return per.select("session_id", *(v.alias(k) for k, v in flags.items()))


@query("SELECT doc_id, len(list_distinct(list_filter([CASE WHEN x = 'rs' THEN 'rust' WHEN x IN ('js', 'jsx', 'ts', 'tsx') THEN 'js' WHEN x = 'py' THEN 'python' WHEN x = 'go' THEN 'go' WHEN x IN ('md', 'mdx') THEN 'md' END FOR x IN regexp_extract_all(text, '[\\w/-]+\\.(rs|jsx|tsx|js|ts|py|go|mdx|md)\\b', 1)], lambda x: x IS NOT NULL))) > 1 AS mixed FROM documents WHERE text IS NOT NULL")
def mixed_languages(spark, d):
    """Documents that name files of more than one language."""
    files = F.regexp_extract_all("text", F.lit(r"([\w/-]+\.(?:rs|jsx|tsx|js|ts|py|go|mdx|md)\b)"), F.lit(1))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", U.mixed_languages(files).alias("mixed"))


@query("SELECT message_id, left(trim(regexp_replace(content, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)), 2000) AS feedback FROM display_messages WHERE role = 'user'")
def clean_feedback(spark, d):
    return table(spark, d, "display_messages").where("role = 'user'").select("message_id", U.clean_feedback(F.col("content")).alias("feedback"))


@query("SELECT id, least(first_tool_call_ms, 300000) // 100 * 100 AS bucket_ms FROM telemetry_events WHERE first_tool_call_ms >= 0")
def time_buckets(spark, d):
    return table(spark, d, "telemetry_events").where("first_tool_call_ms >= 0").select("id", U.time_bucket(F.col("first_tool_call_ms")).alias("bucket_ms"))


@query("SELECT hour(l) AS hour, isodow(l) - 1 AS weekday, count(DISTINCT l::DATE) AS days, count(*) AS n FROM (SELECT ((ts::TIMESTAMP AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS l FROM events) GROUP BY ALL")
def local_hours(spark, d):
    hour, weekday, day = U.local_parts(F.col("ts"), "America/New_York")
    return table(spark, d, "events").groupBy(hour.alias("hour"), weekday.alias("weekday")).agg(F.countDistinct(day).alias("days"), F.count("*").alias("n"))


@query("SELECT CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 0 WHEN '3' THEN 1 WHEN '5' THEN 2 ELSE 1 END AS rank, count(*) AS n FROM orders GROUP BY 1")
def priority_ranks(spark, d):
    words = U.pick(F.substring("o_orderpriority", 1, 1), {"1": "urgent", "2": "high", "3": "medium", "5": "p2"}, "none given")
    return table(spark, d, "orders").groupBy(U.priority_rank(words).alias("rank")).agg(F.count("*").alias("n"))


_NORMAL = "trim(regexp_replace(lower({}), '[\\s\\-_/\\\\.:]+', ' ', 'g'))"


@query(f"SELECT doc_id, {_NORMAL.format('text')} || ' ' || {_NORMAL.format('project')} AS searchable FROM documents WHERE {_NORMAL.format('text')} <> '' AND {_NORMAL.format('project')} <> ''")
def tagged_texts(spark, d):
    """A document with its project as a tag, in search form."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", U.tagged_text(t, F.array("project", F.lit(" "))).alias("searchable"), X.search_normalise(t).alias("a"), X.search_normalise(F.col("project")).alias("b")).where("a <> '' AND b <> ''").drop("a", "b")


@query(f"""SELECT doc_id, CASE WHEN hits < 2 THEN 0.0 WHEN hits = 2 THEN 0.08 WHEN hits = 3 THEN 0.14 ELSE 0.2 END::DOUBLE AS bonus FROM (SELECT doc_id, contains(n, 'session')::INT + contains(n, 'cache')::INT + contains(n, 'index')::INT + contains(n, 'panel')::INT AS hits
FROM (SELECT doc_id, {_NORMAL.format('text')} AS n FROM documents WHERE text IS NOT NULL))""")
def skill_bonuses(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", U.skill_bonus(F.col("text"), "what session/cache index_panel with").alias("bonus"))


@query("SELECT doc_id, strlen(text) <= 50 AS whole FROM documents WHERE text IS NOT NULL")
def byte_cuts(spark, d):
    """Prefixes of at most 50 bytes: whole where the text has no more, never longer, never a split character."""
    cut, t = U.cut_bytes(F.col("text"), 50), F.col("text")
    fits = (F.octet_length(cut) <= 50) & t.startswith(cut) & (F.octet_length(F.substr(t, F.lit(1), F.char_length(cut) + 1)) > 50)
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.when((cut == t) | fits, cut == t).alias("whole"))


@query(f"""SELECT session_id, sum(size) AS bytes, sum(size) // 4 + 18000 AS about_tokens FROM (
SELECT session_id, CASE WHEN role = 'tool' THEN coalesce(strlen(content), 0) + 20 WHEN role = 'error' THEN 6400 ELSE coalesce(strlen(content), 0) END AS size FROM display_messages
UNION ALL SELECT session_id, strlen(args) + 50 FROM {_CALLS}) GROUP BY 1""")
def session_sizes(spark, d):
    """Bytes and about the tokens of a session's blocks: texts, calls, results, images (here the errors)."""
    m = table(spark, d, "display_messages")
    none = F.lit(None).cast("string")
    kind = F.when(F.col("role") == "tool", "tool_result").when(F.col("role") == "error", "image").otherwise("text")
    blocks = m.select("session_id", U.block_size(kind, F.col("content"), none).alias("size")).unionByName(calls(spark, d).select("session_id", U.block_size(F.lit("tool_use"), none, F.col("args")).alias("size")))
    return blocks.groupBy("session_id").agg(F.sum("size").alias("bytes")).withColumn("about_tokens", U.estimated_tokens(F.col("bytes")))


@query("""SELECT provider_end, count(*) AS sessions, sum(CASE WHEN n = 0 THEN 0 WHEN coalesce(contains(lower(provider_end), 'claude'), false) OR new > 0 OR read > n THEN n + read + new ELSE n END)::BIGINT AS context_tokens
FROM (SELECT provider_end, coalesce(input_tokens, 0) AS n, coalesce(cache_read_input_tokens, 0) AS read, coalesce(cache_creation_input_tokens, 0) AS new FROM telemetry_events WHERE event = 'session_end') GROUP BY 1""")
def context_sizes(spark, d):
    e = table(spark, d, "telemetry_events").where("event = 'session_end'")
    size = U.context_tokens(F.col("provider_end"), F.col("input_tokens"), F.col("cache_read_input_tokens"), F.col("cache_creation_input_tokens"))
    return e.groupBy("provider_end").agg(F.count("*").alias("sessions"), F.sum(size).alias("context_tokens"))


@query("SELECT doc_id, confidence, least(1.0, confidence + 0.3) AS boosted, greatest(0.0, confidence - 0.3) AS lowered FROM (SELECT doc_id, (doc_id % 11) / 10.0::DOUBLE AS confidence FROM documents)")
def confidence_steps(spark, d):
    c = (F.col("doc_id") % 11) / 10.0
    return table(spark, d, "documents").select("doc_id", c.alias("confidence"), U.boosted(c, 0.3).alias("boosted"), U.lowered(c, 0.3).alias("lowered"))


@query("""SELECT method, rank, count(*) AS n, count(*) FILTER (confidence >= threshold) AS admitted FROM (SELECT (o_custkey % 10) / 10.0::DOUBLE AS confidence, substr(o_orderpriority, 1, 1)::INT AS k FROM orders)
JOIN (VALUES (1, 'user_stated', 5, 0.0::DOUBLE), (2, 'structured_mapping', 4, 0.0), (3, 'rule_extraction', 3, 0.7), (4, 'llm_extraction', 2, 0.7), (5, 'rule_inference', 1, 0.8)) t(k, method, rank, threshold) USING (k) GROUP BY ALL""")
def admissions(spark, d):
    """Records of each way of learning that pass its least confidence."""
    method = U.pick(F.substring("o_orderpriority", 1, 1), dict(zip("12345", U.AUTHORITY, strict=True)))
    o = table(spark, d, "orders").select(method.alias("method"), ((F.col("o_custkey") % 10) / 10.0).alias("confidence"))
    return o.groupBy("method", U.authority(F.col("method")).alias("rank")).agg(F.count("*").alias("n"), F.count_if(U.admissible(F.col("method"), F.col("confidence"))).alias("admitted"))


@query("""SELECT DISTINCT label, candidate FROM (SELECT label, unnest([label, CASE WHEN k = 1 THEN model_end END, CASE WHEN k = 2 THEN model_end END]) AS candidate FROM (
SELECT model_end, id % 3 AS k, CASE id % 3 WHEN 0 THEN model_end WHEN 1 THEN 'route/' || model_end ELSE model_end || '-20250101' END AS label FROM telemetry_events WHERE model_end IN ('aerie-mini', 'corvid-coder', 'brindle-4-fast'))) WHERE candidate IS NOT NULL""")
def model_candidates(spark, d):
    """Catalogue names of model labels written as they are, behind a route, and with a date."""
    k = F.col("id") % 3
    label = F.when(k == 0, F.col("model_end")).when(k == 1, F.concat(F.lit("route/"), "model_end")).otherwise(F.concat("model_end", F.lit("-20250101")))
    own = table(spark, d, "telemetry_events").where(F.col("model_end").isin("aerie-mini", "corvid-coder", "brindle-4-fast")).select(label.alias("label")).distinct()
    return own.select("label", F.explode(U.model_candidates(F.col("label"))).alias("candidate"))


@query("""SELECT o_custkey, CASE WHEN n >= 3 AND done = n THEN 9 WHEN n >= 3 AND done >= greatest(2, n * 0.6) THEN 9 WHEN n >= 3 THEN 8 WHEN n >= 2 AND done >= n * 0.5 THEN 7 WHEN n >= 2 AND open > 0 THEN 5 WHEN n >= 2 THEN 6 WHEN open > 0 THEN 2 ELSE 4 END AS score
FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders GROUP BY 1)""")
def plan_scores(spark, d):
    """Quality of plans whose items are a customer's orders: specific, 38 characters or more, written twice."""
    text = F.concat(F.lit("verify and document the order numbered "), F.col("o_orderkey").cast("string"))
    state = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("cancelled")
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(text).alias("contents"), F.collect_list(state).alias("statuses"))
    return per.select("o_custkey", U.plan_quality(F.col("contents"), F.col("statuses"), F.lit(2), F.lit(False)).alias("score"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'captcha' WHEN 1 THEN 'bot check' WHEN 2 THEN 'cloudflare challenge' END AS kind FROM part")
def robot_pages(spark, d):
    k = F.col("p_partkey") % 4
    page = F.when(k == 0, "<div class='CAPTCHA g-recaptcha'>").when(k == 1, "Are you a ROBOT?").when(k == 2, "<script src=/cf-challenge/x.js>").otherwise("<p>plain</p>")
    return table(spark, d, "part").select("p_partkey", X.robot_page(F.concat(F.col("p_name"), page)).alias("kind"))


@query("SELECT message_id, CASE WHEN length(t) > 80 THEN left(t, 80) || '…' ELSE t END AS title FROM (SELECT message_id, trim(content, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM display_messages WHERE role = 'user')  WHERE t <> ''")
def message_titles(spark, d):
    m = table(spark, d, "display_messages").where("role = 'user'")
    return m.select("message_id", X.title_candidate(F.col("content")).alias("title")).where("title IS NOT NULL")


@query(f"SELECT doc_id, translate(text, '{''.join(x for x, _ in X.ACCENTED)}', '{''.join(y for _, y in X.ACCENTED)}') AS plain FROM documents")
def unaccented(spark, d):
    """Texts without the accents of Latin letters, as the full-text index sees them."""
    return table(spark, d, "documents").select("doc_id", X.without_accents(F.col("text")).alias("plain"))


@query("SELECT p_partkey, [(p_size - 1) % 5, 1]::BIGINT[] AS ranking FROM part WHERE (p_size - 1) % 5 <> 1")
def rankings(spark, d):
    """Rankings read from prose: numbers out of range and repeated ones left out."""
    prose = F.concat(F.lit("Best first: ["), ((F.col("p_size") - 1) % 5 + 1).cast("string"), F.lit(", 9, 2, 0, -3, 2] as asked."))
    return table(spark, d, "part").where("(p_size - 1) % 5 <> 1").select("p_partkey", X.ranking(prose, 5).alias("ranking"))


@query("SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^[^:\\n]+:\\d+:')) AS h FROM documents) GROUP BY 1")
def path_hits(spark, d):
    own = table(spark, d, "documents").select("doc_id", F.explode(X.path_line_hits(F.col("text"))).alias("h"))
    return own.groupBy("doc_id").agg(F.count("*").alias("hits"))


@query("SELECT doc_id, length(text) AS chars FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, 'sk-|ghp_|AIza|xox|AKIA|eyJ|-----BEGIN|(?i)token|secret|password|cookie|authorization|bearer |api_key')")
def untouched_by_redaction(spark, d):
    """Texts without a hint of a secret come through as they are."""
    t = F.col("text")
    hint = r"sk-|ghp_|AIza|xox|AKIA|eyJ|-----BEGIN|(?i)token|secret|password|cookie|authorization|bearer |api_key"
    return table(spark, d, "documents").where(t.isNotNull() & ~t.rlike(hint) & (X.redact_secrets(t) == t)).select("doc_id", F.char_length(t).cast("long").alias("chars"))
