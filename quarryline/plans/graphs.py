"""Graph and dependency queries over graphs derived from the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline.common import table
from quarryline.operators import graph as G

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def parts(spark, d):
    """Supplier graph: a supplier points to the next one of each of its parts."""
    own = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("src")).distinct()
    nxt = F.lead("src").over(Window.partitionBy("p").orderBy("src"))
    pairs = own.withColumn("dst", nxt).where("dst IS NOT NULL").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return pairs.select("src", "dst", (F.col("n") / (F.col("n") + 1.0)).alias("weight"))


_EDGES = "(SELECT src, dst, count(*) / (count(*) + 1.0) AS weight FROM (SELECT src, lead(src) OVER (PARTITION BY p ORDER BY src) AS dst FROM (SELECT DISTINCT l_partkey AS p, l_suppkey AS src FROM lineitem)) WHERE dst IS NOT NULL GROUP BY ALL)"


@query(f"SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM {_EDGES} UNION ALL SELECT dst, 0, 1 FROM {_EDGES}) GROUP BY 1")
def node_degrees(spark, d):
    return G.degrees(parts(spark, d))


@query(f"""WITH e AS {_EDGES}, m AS (SELECT s_suppkey AS node, s_nationkey AS tag FROM supplier), s AS (SELECT s_suppkey AS node, 1.0::DOUBLE AS score FROM supplier WHERE s_suppkey < 3),
f1 AS (SELECT dst AS node, score * weight * 0.7 AS score FROM s JOIN e ON s.node = e.src UNION ALL SELECT m.node, t.score * 0.8 * 0.7 FROM (SELECT tag, max(score) AS score FROM s JOIN m USING (node) GROUP BY 1) t JOIN m USING (tag) UNION ALL SELECT * FROM s),
r1 AS (SELECT node, max(score) AS score FROM f1 GROUP BY 1), n1 AS (SELECT * FROM r1 WHERE node NOT IN (SELECT node FROM s)),
f2 AS (SELECT dst AS node, score * weight * 0.7 ** 2 AS score FROM n1 JOIN e ON n1.node = e.src UNION ALL SELECT m.node, t.score * 0.8 * 0.7 ** 2 FROM (SELECT tag, max(score) AS score FROM n1 JOIN m USING (node) GROUP BY 1) t JOIN m USING (tag) UNION ALL SELECT * FROM r1)
SELECT node, round(max(score), 8) AS score FROM f2 GROUP BY 1""")
def cascade_scores(spark, d):
    s = table(spark, d, "supplier")
    members = s.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("tag"))
    seeds = s.where("s_suppkey < 3").select(F.col("s_suppkey").alias("node"), F.lit(1.0).alias("score"))
    return G.cascade(parts(spark, d), members, seeds, 2).select("node", F.round("score", 8).alias("score"))


@query("""WITH e AS (SELECT o_custkey AS src, (o_orderkey * 7) % 1600 AS dst, o_totalprice / 450000.0 AS weight FROM orders), n AS (SELECT c_custkey AS node FROM customer)
SELECT code, count(*) AS n FROM (SELECT 'E01' AS code FROM e ANTI JOIN n ON src = node UNION ALL SELECT 'E02' FROM e ANTI JOIN n ON dst = node UNION ALL SELECT 'E10' FROM e WHERE src = dst UNION ALL SELECT 'E32' FROM e WHERE weight < 0 OR weight > 1) GROUP BY 1""")
def graph_validation(spark, d):
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 7) % 1600).alias("dst"), (F.col("o_totalprice") / 450000.0).alias("weight"))
    return G.validate(table(spark, d, "customer").select(F.col("c_custkey").alias("node")), e).groupBy("code").agg(F.count("*").alias("n"))


_LINKS = "(SELECT DISTINCT o_custkey AS src, (o_orderkey * 7) % (SELECT max(o_custkey) + 1 FROM orders) AS dst FROM orders)"


def _links(spark, d):
    """A link per order, from its customer to any other."""
    o = table(spark, d, "orders")
    size = o.agg((F.max("o_custkey") + 1).alias("size"))
    return o.join(F.broadcast(size)).select(F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 7) % F.col("size")).alias("dst")).distinct()


@query(f"WITH l AS {_LINKS} SELECT a.src, a.dst FROM l a JOIN l b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def mutual_links(spark, d):
    return G.contradictions(_links(spark, d))


def _needs(spark, d):
    """Tasks are orders; each needs the customer's previous one, every 50th also a later one (a cycle), every 70th one that isn't there."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("status"))
    w = Window.partitionBy("c").orderBy("id")
    chain = o.withColumn("dep", F.lag("id").over(w)).where("dep IS NOT NULL").select("id", "dep")
    back = o.withColumn("dep", F.lead("id").over(w)).where("dep IS NOT NULL AND id % 50 = 0").select("id", "dep")
    gone = o.where("id % 70 = 0").select("id", (-F.col("id") - 1).alias("dep"))
    return o, chain, chain.unionByName(back).unionByName(gone)


_CHAIN = "(SELECT id, dep FROM (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dep FROM orders) WHERE dep IS NOT NULL)"
_NEEDS = f"(SELECT * FROM {_CHAIN} UNION ALL SELECT id, dep FROM (SELECT o_orderkey AS id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dep FROM orders) WHERE dep IS NOT NULL AND id % 50 = 0 UNION ALL SELECT o_orderkey, -o_orderkey - 1 FROM orders WHERE o_orderkey % 70 = 0)"


@query(f"""WITH s AS (SELECT o_orderkey AS id, o_orderstatus = 'F' AS done, o_orderstatus = 'P' AS active FROM orders),
p AS (SELECT n.id, count(*) FILTER (s.id IS NULL) AS missing, count(*) FILTER (s.id IS NULL OR NOT s.done) AS unresolved FROM {_NEEDS} n LEFT JOIN s ON s.id = n.dep GROUP BY 1)
SELECT s.id, CASE WHEN done THEN 'done' WHEN active THEN 'active' WHEN coalesce(unresolved, 0) > 0 THEN 'blocked' ELSE 'ready' END AS state, coalesce(missing, 0) AS missing, coalesce(unresolved, 0) AS unresolved FROM s LEFT JOIN p USING (id)""")
def plan_states(spark, d):
    o, _, needs = _needs(spark, d)
    return G.plan_state(o, needs, F.col("status") == "F", F.col("status") == "P")


@query(f"SELECT o_orderkey AS id FROM orders o WHERE EXISTS (SELECT 1 FROM orders q WHERE q.o_custkey = o.o_custkey AND q.o_orderkey % 50 = 0 AND q.o_orderkey <= o.o_orderkey AND EXISTS (SELECT 1 FROM orders z WHERE z.o_custkey = q.o_custkey AND z.o_orderkey > q.o_orderkey))")
def cycle_items(spark, d):
    o, _, needs = _needs(spark, d)
    return G.stuck_in_cycles(o, needs)


@query(f"SELECT o_orderkey AS id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS depth FROM orders")
def dependency_depth(spark, d):
    o, chain, _ = _needs(spark, d)
    return G.longest_paths(o, chain)


@query("SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS root, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS depth FROM orders")
def parent_chains(spark, d):
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return G.chain_roots(o.select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(w).alias("parent")))


def strong_components(spark, d):
    """Components over the links of all orders; recursive SQL is too slow for them, tests compare small graphs."""
    return G.components(_links(spark, d))


QUERIES["strong_components"] = strong_components


@query(f"SELECT id, o_orderpriority AS priority FROM (SELECT o_orderkey AS id, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT n.id FROM {_NEEDS} n LEFT JOIN orders s ON s.o_orderkey = n.dep WHERE s.o_orderkey IS NULL OR s.o_orderstatus <> 'F')) ORDER BY o_orderpriority, id LIMIT 20")
def next_tasks(spark, d):
    o, _, needs = _needs(spark, d)
    ready = G.plan_state(o, needs, F.col("status") == "F", F.col("status") == "P").where("state = 'ready'")
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    return ready.select("id").join(p, "id").orderBy("priority", "id").limit(20)


@query("SELECT project, count(*) AS documents, count(DISTINCT lower(trim(source))) AS sources FROM documents GROUP BY 1")
def tag_counts(spark, d):
    return table(spark, d, "documents").groupBy("project").agg(F.count("*").alias("documents"), F.countDistinct(F.lower(F.trim("source"))).alias("sources"))


@query("SELECT label, round(min(c), 5) AS least, count(*) FILTER (c < 0.3) AS topic_changes FROM (SELECT label, list_cosine_similarity(embedding::DOUBLE[], lag(embedding) OVER (PARTITION BY label ORDER BY vec_id)::DOUBLE[]) AS c FROM embeddings) GROUP BY 1")
def topic_changes(spark, d):
    from quarryline.operators.retrieval import cosine

    before = F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    v = table(spark, d, "embeddings").withColumn("b", before).withColumn("c", F.when(F.col("b").isNotNull(), cosine(F.col("embedding"), F.col("b"))))
    return v.groupBy("label").agg(F.round(F.min("c"), 5).alias("least"), F.count_if(F.col("c") < 0.3).alias("topic_changes"))
