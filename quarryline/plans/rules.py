"""Queries of lifecycle rules, validation, rule dispatch, gates, activities and work assignment over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.common import table
from quarryline.functions.usage import pick, priority_rank
from quarryline.operators import rules as R

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


KINDS = ["has_tag", "in_cluster", "relates_to", "supersedes", "contradicts", "derived_from"]
STATES = ["active", "expired", "archived", "disputed"]
METHODS = [None, "user_stated", "rule_extraction", "rule_inference"]


def nth(c, values):
    return F.element_at(F.array(*map(F.lit, values)), c.cast("int") + 1)


def _sql_nth(c, values):
    return f"([{', '.join('NULL' if v is None else repr(v) for v in values)}])[{c} + 1]"


@query(f"""SELECT kind, round(avg(CASE kind WHEN 'has_tag' THEN 0.8 WHEN 'in_cluster' THEN 0.6 WHEN 'supersedes' THEN 0.9 WHEN 'contradicts' THEN 0.3 WHEN 'derived_from' THEN 0.7 ELSE l_discount END::DOUBLE), 9) AS weight, count(*) AS n
FROM (SELECT *, {_sql_nth('l_linenumber % 6', KINDS)} AS kind FROM lineitem) GROUP BY 1""")
def edge_weights(spark, d):
    e = table(spark, d, "lineitem").select(nth(F.col("l_linenumber") % 6, KINDS).alias("kind"), "l_discount")
    return e.groupBy("kind").agg(F.round(F.avg(R.edge_weight(F.col("kind"), F.col("l_discount"))), 9).alias("weight"), F.count("*").alias("n"))


@query(f"""SELECT old, new, count(*) AS n, bool_and(old = new OR (old, new) IN (('active', 'expired'), ('active', 'archived'), ('active', 'disputed'), ('expired', 'active'), ('expired', 'archived'), ('archived', 'active'), ('disputed', 'active'), ('disputed', 'archived'))) AS allowed
FROM (SELECT {_sql_nth('o_orderkey % 4', STATES)} AS old, {_sql_nth('o_custkey % 4', STATES)} AS new FROM orders) GROUP BY ALL""")
def status_changes(spark, d):
    o = table(spark, d, "orders").select(nth(F.col("o_orderkey") % 4, STATES).alias("old"), nth(F.col("o_custkey") % 4, STATES).alias("new"))
    return o.groupBy("old", "new", R.may_change(F.col("old"), F.col("new")).alias("allowed")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'fresh' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT c_custkey + 10000000, 'fresh' FROM customer WHERE c_custkey % 5 = 0""")
def upserted_nodes(spark, d):
    """Nodes with later ones in place of those of the same key; new keys are added."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    versions = F.array(*(F.struct(F.lit(n).alias("seq"), F.lit(x).alias("segment")) for n, x in ((1, "stale"), (2, "fresh"))))
    keys = c.where("id % 5 = 0").select(F.explode(F.array("id", F.col("id") + 10_000_000)).alias("id"))
    fresh = keys.select("id", F.inline(versions))
    return R.upserted(c, fresh, "id")


@query("SELECT dst, count(*) AS members FROM (SELECT DISTINCT doc_id, 'tag:' || tag AS dst FROM (SELECT doc_id, unnest([project, lower(trim(source)), project]) AS tag FROM documents) WHERE tag IS NOT NULL) WHERE dst IN ('tag:ferrule', 'tag:skerry', 'tag:withy') GROUP BY 1")
def tag_members(spark, d):
    """Members of some tags: edges from documents to their tags, read backwards."""
    nodes = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.filter(F.array("project", F.lower(F.trim("source")), "project"), lambda x: x.isNotNull()).alias("tags"))
    wanted = spark.createDataFrame([("tag:ferrule",), ("tag:skerry",), ("tag:withy",)], "dst string")
    return R.incoming(R.tag_edges(nodes), wanted).groupBy("dst").agg(F.count("*").alias("members"))


def records(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    return o.select(
        F.when(k % 97 == 0, F.concat(F.lit("tag:"), k.cast("string"))).when(k % 101 == 0, " ").otherwise(k.cast("string")).alias("id"), F.when(k % 13 == 0, " ").otherwise("x").alias("content"),
        nth(k % 4, METHODS).alias("method"), ((F.col("o_custkey") % 14) / 10.0).alias("confidence"), ((F.col("o_custkey") % 11) / 10.0).alias("own_confidence"),
        (k % 17 == 0).alias("critical"), nth(F.col("o_custkey") % 4, STATES).alias("status"), (k % 3 > 0).alias("active"), (k % 19 == 0).alias("deprecated"),
        F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.make_interval(days=(k % 29 - 2).cast("int"))).alias("valid_to"),
    )


@query(f"""WITH r AS (SELECT *, {_sql_nth('k % 4', METHODS)} AS method, (o_custkey % 14) / 10.0::DOUBLE AS confidence, {_sql_nth('o_custkey % 4', STATES)} AS status FROM (SELECT o_orderkey AS k, o_custkey FROM orders))
SELECT code, count(*) AS n FROM (SELECT unnest([CASE WHEN k % 97 = 0 OR k % 101 = 0 THEN 'E01' END, CASE WHEN k % 13 = 0 THEN 'E20' END, CASE WHEN method = 'rule_extraction' AND confidence < 0.7 OR method = 'rule_inference' AND confidence < 0.8 THEN 'E22' END,
 CASE WHEN method IS NOT NULL AND confidence > 1 THEN 'E23' END, CASE WHEN k % 17 = 0 AND method IS NULL THEN 'E24' END, CASE WHEN status = 'archived' AND k % 3 > 0 THEN 'E40' END, CASE WHEN k % 29 < 2 THEN 'E41' END,
 CASE WHEN status = 'disputed' AND k % 17 = 0 THEN 'W02' END, CASE WHEN status = 'active' AND k % 19 = 0 THEN 'W03' END]) AS code FROM r) WHERE code IS NOT NULL GROUP BY 1""")
def record_faults(spark, d):
    return R.validate_records(records(spark, d)).groupBy("code").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT o_orderkey AS k, o_custkey AS src, (o_orderkey * 7) % 1600 AS dst, o_totalprice / 450000.0 AS w FROM orders), n AS (SELECT c_custkey AS id FROM customer)
SELECT code, count(*) AS n FROM (SELECT 'E30' AS code FROM e ANTI JOIN n ON src = id UNION ALL SELECT 'E31' FROM e ANTI JOIN n ON dst = id UNION ALL SELECT 'E32' FROM e WHERE w > 1 AND k % 6 = 2
UNION ALL SELECT 'W01' FROM (SELECT dst AS src, src AS dst FROM e WHERE k % 5 = 0) r ANTI JOIN e ON r.src = e.src AND r.dst = e.dst) GROUP BY 1""")
def edge_faults(spark, d):
    s = lambda c: F.col(c).cast("string")
    e = table(spark, d, "orders").withColumn("dst", (F.col("o_orderkey") * 7) % 1600)
    e = e.select("o_orderkey", s("o_custkey").alias("src"), s("dst").alias("dst"), (F.col("o_totalprice") / 450000.0).alias("weight"), nth(F.col("o_orderkey") % 6, KINDS).alias("kind"))
    back = e.where("o_orderkey % 5 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return R.validate_edges(e, back, table(spark, d, "customer").select(s("c_custkey").alias("id"))).groupBy("code").agg(F.count("*").alias("n"))


RULES = [
    ("keep", "O", [], [("has_content", ""), ("confidence_at_least", "0.5")], [("add_tag", "kept"), ("transition", "archived")]),
    ("review", "O", ["1-URGENT", "2-HIGH"], [("source_at_least", "3")], [("add_tag", "review"), ("transition", "disputed")]),
    ("drop", "F", [], [("similarity_at_least", "0.6"), ("custom", "anything")], [("transition", "expired"), ("remove_tag", "old")]),
]


def _plans(spark, d):
    schema = "rule_id string, event string, types array<string>, conditions array<struct<kind:string,arg:string>>, effects array<struct<kind:string,arg:string>>"
    k = F.col("o_orderkey")
    events = table(spark, d, "orders").select(
        k.alias("seq"), F.col("o_orderstatus").alias("event"), F.col("o_orderpriority").alias("type"), F.lit(False).alias("exists"), F.when(k % 13 == 0, " ").otherwise("x").alias("content"), F.lit(True).alias("embedded"),
        nth(k % 4, METHODS).alias("method"), ((F.col("o_custkey") % 10) / 10.0).alias("confidence"), ((F.col("o_custkey") % 9) / 9.0).alias("similarity"), nth(F.col("o_custkey") % 4, STATES).alias("status"),
    )
    return R.dispatch(events, spark.createDataFrame(RULES, schema))


_DISPATCH = f"""(SELECT k, 'keep' AS rule_id, CASE WHEN k % 13 = 0 THEN 'condition has_content' WHEN c % 10 < 5 THEN 'condition confidence_at_least' ELSE 'applied' END AS outcome, 'archived' AS aim, s FROM o WHERE e = 'O'
UNION ALL SELECT k, 'review', CASE WHEN p NOT IN ('1-URGENT', '2-HIGH') THEN 'type' WHEN k % 4 IN (0, 3) THEN 'condition source_at_least' ELSE 'applied' END, 'disputed', s FROM o WHERE e = 'O'
UNION ALL SELECT k, 'drop', CASE WHEN (c % 9) / 9.0::DOUBLE < 0.6 THEN 'condition similarity_at_least' ELSE 'applied' END, 'expired', s FROM o WHERE e = 'F')"""
_O = f"WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS e, o_orderpriority AS p, {_sql_nth('o_custkey % 4', STATES)} AS s FROM orders)"
_LEGAL = "(s = aim OR (s, aim) IN (('active', 'expired'), ('active', 'archived'), ('active', 'disputed'), ('expired', 'archived'), ('disputed', 'archived')))"


@query(f"{_O} SELECT rule_id, outcome, count(*) AS n, sum(CASE WHEN outcome = 'applied' THEN 1 + {_LEGAL}::INT ELSE 0 END)::BIGINT AS effects FROM {_DISPATCH} GROUP BY ALL")
def dispatched_rules(spark, d):
    return _plans(spark, d).groupBy("rule_id", "outcome").agg(F.count("*").alias("n"), F.sum(F.size("effects")).alias("effects"))


@query(f"""{_O}, w AS (SELECT k, bool_or(rule_id = 'keep') AS keep, bool_or(rule_id = 'review') AS review, bool_or(rule_id = 'drop') AS gone FROM {_DISPATCH} WHERE outcome = 'applied' GROUP BY 1),
n AS (SELECT o.*, coalesce(keep, false) AS keep, coalesce(review, false) AS review, coalesce(gone, false) AS gone FROM o LEFT JOIN w USING (k)),
a AS (SELECT *, CASE WHEN keep AND s IN ('active', 'expired', 'disputed') THEN 'archived' ELSE s END AS s1 FROM n),
b AS (SELECT *, CASE WHEN review AND s1 = 'active' THEN 'disputed' WHEN gone AND s1 = 'active' THEN 'expired' ELSE s1 END AS s2 FROM a)
SELECT s2 AS status, s2 <> 'archived' AS active, keep::INT + review::INT + (NOT gone)::INT AS tags, count(*) AS n FROM b GROUP BY ALL""")
def applied_effects(spark, d):
    """Records after the effects of all rules: tags, status and whether they are active."""
    k = F.col("o_orderkey")
    own = table(spark, d, "orders").select(k.alias("id"), F.array(F.lit("old")).alias("tags"), nth(F.col("o_custkey") % 4, STATES).alias("status"), F.lit(True).alias("active"))
    plans = _plans(spark, d).select(F.col("seq").alias("id"), F.col("rule_id").alias("seq"), "effects")  # keep before review
    return R.apply_effects(own, plans).groupBy("status", "active", F.size("tags").alias("tags")).agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT c_custkey AS id FROM customer), p AS (SELECT o_orderkey % 2000 AS id, o_custkey AS other, o_orderkey % 4 AS k FROM orders), q AS (SELECT p.* FROM p SEMI JOIN n ON p.other = n.id)
SELECT kind, count(*) AS n FROM (SELECT id AS s, other AS t, 'supersedes' AS kind FROM q WHERE k = 0 UNION SELECT other, id, 'derived_from' FROM q WHERE k = 1 UNION SELECT id, other, 'relates_to' FROM q WHERE k = 2
UNION SELECT id, other, 'contradicts' FROM q WHERE k = 3 UNION SELECT other, id, 'contradicts' FROM q WHERE k = 3) GROUP BY 1""")
def effect_edges(spark, d):
    k, other = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    name = nth(k, ["supersede", "derive", "link", "contradict"])
    arg = F.when(k == 1, F.concat(F.lit("cites:"), other)).when(k == 2, F.concat(F.lit("near:"), other)).otherwise(other)
    plans = table(spark, d, "orders").select((F.col("o_orderkey") % 2000).cast("string").alias("id"), F.array(F.struct(name.alias("kind"), arg.alias("arg"))).alias("effects"))
    return R.effect_edges(plans, table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"))).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH o AS (SELECT *, o_orderkey AS k, count(*) OVER (PARTITION BY o_custkey) AS affected FROM orders), g AS (SELECT k, k % 17 = 0 AS critical, k % 4 = 1 AND k % 3 = 0 AS authoritative,
 {_sql_nth('k % 4', STATES)} <> {_sql_nth('o_custkey % 4', STATES)} OR o_orderpriority = '5-LOW' AS status, affected * 5 > 60 AS batch FROM o)
SELECT critical, authoritative, status, batch, count(*) AS n FROM g GROUP BY ALL""")
def change_gates(spark, d):
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    old = {"critical": k % 17 == 0, "method": nth(k % 4, METHODS), "content": F.lit("a"), "status": nth(k % 4, STATES)}
    new = {"critical": F.lit(None).cast("boolean"), "content": F.when(k % 3 == 0, "b").otherwise("a"), "status": nth(F.col("o_custkey") % 4, STATES)}
    action = F.when(F.col("o_orderpriority") == "5-LOW", "forget").otherwise("edit")
    names = R.gates(old, new, action, F.count("*").over(Window.partitionBy("o_custkey")), F.lit(60))
    own = table(spark, d, "orders").select(names.alias("g"))
    return own.groupBy(*(F.array_contains("g", n).alias(n) for n in ("critical", "authoritative", "status", "batch"))).agg(F.count("*").alias("n"))


@query("""SELECT activity, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'turn' WHEN 1 THEN 'topic' WHEN 2 THEN 'finalize' ELSE 'tick' END AS kind, value / 100 AS sim, value * 30 AS idle FROM events)
JOIN (VALUES ('extract', 'turn'), ('refocus', 'topic'), ('close', 'finalize'), ('sweep', 'tick')) a(activity, trig) ON kind = trig WHERE kind <> 'topic' AND kind <> 'tick' OR kind = 'topic' AND sim <= 0.3 OR kind = 'tick' AND greatest(idle, 0) >= 600 GROUP BY 1""")
def scheduled_activities(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), nth(F.col("event_id") % 4, ["turn", "topic", "finalize", "tick"]).alias("kind"), (F.col("value") / 100).alias("similarity"), (F.col("value") * 30).alias("idle_secs"))
    rows = [("extract", "turn", None, None, ["fresh_user_turn"]), ("never", "turn", None, None, ["idle"]), ("refocus", "topic", 0.3, None, []), ("close", "finalize", None, None, []), ("sweep", "tick", None, 10, [])]
    plan = spark.createDataFrame(rows, "activity string, trigger string, threshold double, every_minutes int, states array<string>")
    return R.scheduled(e, plan).groupBy("activity").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS type, property, CASE WHEN n_nationkey % 2 = 0 AND property = 'own' THEN 'set' ELSE r_name END AS value FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('own'), ('name')) p(property) UNION ALL SELECT 1000 + r_regionkey, p, r_name FROM region, (VALUES ('own'), ('name')) q(p)")
def inherited_properties(spark, d):
    """Properties of nations: their own, else those of their region."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    names = F.explode(F.array(F.lit("own"), F.lit("name"))).alias("property")
    base = r.select((F.col("r_regionkey") + 1000).cast("long").alias("type"), names, F.col("r_name").alias("value"))
    own = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("type"), F.lit("own").alias("property"), F.lit("set").alias("value"))
    kinds = n.select(F.col("n_nationkey").cast("long").alias("type"), (F.col("n_regionkey") + 1000).cast("long").alias("parent"))
    return R.inherited(kinds, base.unionByName(own))


@query("SELECT o_custkey % 20 AS worker, count(*) AS load FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 20 <> 7 GROUP BY 1")
def assignment_loads(spark, d):
    """Open items per worker; items without one don't count."""
    o = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.nullif(F.col("o_custkey") % 20, F.lit(7)).alias("worker"))
    return o.where("worker IS NOT NULL").groupBy("worker").agg(F.count("*").alias("load"))


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 20 IN (3, 4) AND o_orderkey % 5 < 3 ORDER BY CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 0 WHEN '5' THEN 2 ELSE 1 END, id LIMIT 50""")
def stranded_tasks(spark, d):
    """The next ready items whose worker is gone and that were taken back less than three times."""
    o = table(spark, d, "orders").where("o_orderstatus = 'O'")
    alive = spark.range(20).where("id NOT IN (3, 4)").select(F.col("id").alias("worker"))
    own = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("worker"), (F.col("o_orderkey") % 5).alias("reclaims"), priority_rank(pick(F.substring("o_orderpriority", 1, 1), {"1": "urgent", "2": "high", "5": "low"}, "normal")).alias("rank"))
    return own.where("reclaims < 3").join(F.broadcast(alive), "worker", "left_anti").orderBy("rank", "id").limit(50).select("id")  # 20 workers


@query("""WITH i AS (SELECT o_orderkey AS id, o_custkey % 20 AS owner, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dep FROM orders), p AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS file FROM lineitem),
c AS (SELECT file, owner, count(*) AS n FROM p JOIN i USING (id) GROUP BY ALL), f AS (SELECT p.id, c.owner, sum(n - CASE WHEN c.owner = i.owner THEN 1 ELSE 0 END) AS points FROM p JOIN c USING (file) LEFT JOIN i ON i.id = p.id GROUP BY ALL)
SELECT id, owner, sum(points)::BIGINT AS points FROM (SELECT a.id, b.owner, 1 AS points FROM i a JOIN i b ON a.dep = b.id UNION ALL SELECT * FROM f) GROUP BY ALL HAVING sum(points) > 0""")
def assignment_affinity(spark, d):
    """How close each worker is to each task: dependencies it owns, and files its other tasks share with it.

    Files are reduced to one count per file and worker before tasks meet them, so tasks of a file aren't paired.
    """
    from pyspark.sql import Window

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("owner"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("dep"))
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("file")).distinct()
    per = files.join(o.select("id", "owner"), "id").groupBy("file", "owner").agg(F.count("*").alias("n"))
    own = files.join(o.select("id", F.col("owner").alias("self")), "id", "left")
    shared = own.join(per, "file").groupBy("id", "owner").agg(F.sum(F.col("n") - F.when(F.col("owner") == F.col("self"), 1).otherwise(0)).alias("points"))
    deps = o.where("dep IS NOT NULL").select("id", "dep").join(o.select(F.col("id").alias("dep"), "owner"), "dep").select("id", "owner", F.lit(1).cast("long").alias("points"))
    return shared.unionByName(deps).groupBy("id", "owner").agg(F.sum("points").alias("points")).where("points > 0")


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderstatus AS s, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dep FROM orders)
SELECT a.id, 'do ' || a.id || CASE WHEN b.id IS NULL THEN '' ELSE chr(10) || '## ' || b.id || ' (task)' END AS input FROM o a LEFT JOIN o b ON a.dep = b.id WHERE a.s = 'O' AND (a.dep IS NULL OR b.s = 'F')""")
def ready_inputs(spark, d):
    """Runnable items with their own text and the sections of their finished dependencies, in order of id."""
    from pyspark.sql import Window

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("dep"))
    deps = o.where("dep IS NOT NULL").select("id", "dep").join(o.select(F.col("id").alias("dep"), (F.col("s") == "F").alias("done")), "dep", "left")
    per = deps.groupBy("id").agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("met"), F.sort_array(F.collect_list("dep")).alias("deps"))
    parts = F.transform(F.coalesce("deps", F.array().cast("array<bigint>")), lambda x: F.concat(F.lit("\n## "), x.cast("string"), F.lit(" (task)")))
    ready = o.where("s = 'O'").join(per, "id", "left").where("coalesce(met, true)")
    return ready.select("id", F.concat(F.lit("do "), F.col("id").cast("string"), F.array_join(parts, "")).alias("input"))


@query("""WITH n AS (SELECT l_orderkey AS gate, l_linenumber AS id, l_quantity > 25 AS high, l_quantity < 5 AS low, bool_or(l_tax > 0.02) OVER (PARTITION BY l_orderkey, l_linenumber) AS named, l_linestatus = 'F' AS done FROM lineitem)
SELECT gate, CASE WHEN bool_or(NOT done) THEN 'stale' WHEN bool_or(low AND NOT named) THEN 'low confidence' WHEN bool_or(NOT named) THEN 'uncovered' ELSE 'passed' END AS outcome, count(*) FILTER (low AND done) AS low_confidence FROM n GROUP BY 1""")
def gate_checks(spark, d):
    """Whether a gate covers its scope: all items done, those of low confidence and (of at most 20 items) all named by id.

    Of wider scopes only items without high confidence must be named. An id counts as named where no letter or digit
    stands beside it.
    """
    li = table(spark, d, "lineitem")
    name = F.concat(F.lit("item-"), F.col("l_linenumber").cast("string"))
    notes = li.groupBy("l_orderkey").agg(F.concat_ws("; ", F.collect_list(F.when(F.col("l_tax") > 0.02, F.concat(F.lit("checked "), name)))).alias("findings"))
    own = li.join(notes, "l_orderkey").withColumn("named", F.expr("findings RLIKE concat('(^|[^A-Za-z0-9_-])item-', l_linenumber, '([^A-Za-z0-9_-]|$)')"))
    low, high, done = F.col("l_quantity") < 5, F.col("l_quantity") > 25, F.col("l_linestatus") == "F"
    per = own.groupBy(F.col("l_orderkey").alias("gate")).agg(F.bool_or(~done).alias("stale"), F.bool_or(low & ~F.col("named")).alias("doubt"), F.bool_or(~F.col("named")).alias("open"), F.bool_or(~high & ~F.col("named")).alias("unsure"), F.count("*").alias("n"), F.count_if(low & done).alias("low_confidence"))
    uncovered = F.when(F.col("n") <= 20, F.col("open")).otherwise(F.col("unsure"))
    return per.select("gate", F.when(F.col("stale"), "stale").when(F.col("doubt"), "low confidence").when(uncovered, "uncovered").otherwise("passed").alias("outcome"), "low_confidence")
