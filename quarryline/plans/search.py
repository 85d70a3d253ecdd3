"""Text, log and retrieval queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline.common import table
from quarryline.functions import text as X
from quarryline.operators import retrieval as R

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


def vectors(spark, d):
    return table(spark, d, "embeddings")


_HITS = lambda t: f"((length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)})"
_FOUND = "(contains(lower(text), 'session')::INT + contains(lower(text), 'index')::INT + contains(lower(text), 'cache')::INT)"
_LEXICAL = f"""SELECT doc_id, round(CASE WHEN contains(lower(text), '{QUERY}') THEN 4.0 ELSE 0.0 END + {_FOUND} / 3.0 * 3.0 + {_FOUND} * 0.25 + ({_HITS('session')} + {_HITS('index')} + {_HITS('cache')}) / (strlen(text) + 1.0) * 200.0, 6) AS score
FROM documents WHERE contains(lower(text), '{QUERY}') OR {_FOUND} >= 2"""


@query(_LEXICAL)
def lexical_search(spark, d):
    return docs(spark, d).select("doc_id", F.round(X.lexical_score(F.col("text"), QUERY), 6).alias("score")).where("score IS NOT NULL")


@query(f"SELECT doc_id, project, score FROM ({_LEXICAL}) JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY project ORDER BY score DESC, doc_id) <= 3")
def lexical_top_per_project(spark, d):
    """Best three per project: the cap of hits per group."""
    hits = docs(spark, d).select("doc_id", "project", F.round(X.lexical_score(F.col("text"), QUERY), 6).alias("score")).where("score IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("score"), "doc_id"))
    return hits.withColumn("nth", nth).where("nth <= 3").drop("nth")


def search_snippets(spark, d):
    return docs(spark, d).where(X.lexical_score(F.col("text"), QUERY).isNotNull()).select("doc_id", X.snippet(F.col("text"), QUERY).alias("snippet"))


QUERIES["search_snippets"] = search_snippets

_BM25 = """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS dl, len(list_filter(w, lambda x: x = 'session')) AS a, len(list_filter(w, lambda x: x = 'index')) AS b, len(list_filter(w, lambda x: x = 'cache')) AS e FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db, count(*) FILTER (e > 0) AS de FROM c)
SELECT doc_id, ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl))
 + ln(1 + (n - de + 0.5) / (de + 0.5)) * e * 2.2 / (e + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM c, s WHERE a + b + e > 0"""


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({_BM25})")
def bm25_search(spark, d):
    return _bm25(spark, d)


def _bm25(spark, d):
    return R.bm25(docs(spark, d), "doc_id", "text", QUERY).withColumn("score", F.round("score", 6))


def _scored(spark, d, **how):
    """Scores of all rows for every query: each row whose id is divisible by 20."""
    v = vectors(spark, d)
    return R.scores_of_all(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", **how)


_QS = "(SELECT vec_id AS query, label AS own, embedding AS q FROM embeddings WHERE vec_id % 20 = 0)"
_COS, _DOT = (f"round(list_{f}(embedding::DOUBLE[], q::DOUBLE[]), 9)" for f in ("cosine_similarity", "inner_product"))


@query(f"SELECT query, vec_id, round({_COS}, 5) AS score FROM embeddings, {_QS} WHERE {_COS} >= 0.1")
def dense_search(spark, d):
    found = _scored(spark, d, least=0.1)
    return found.select("query", F.col("key").alias("vec_id"), F.round("score", 5).alias("score"))


@query(f"SELECT query, vec_id, row_number() OVER (PARTITION BY query ORDER BY {_DOT} DESC, vec_id) AS rank FROM embeddings, {_QS} QUALIFY rank <= 10")
def dense_top_k(spark, d):
    return _scored(spark, d, k=10, norm=False).select("query", F.col("key").alias("vec_id"), "rank")


@query("""WITH m AS (SELECT label, i - 1 AS dim, avg(embedding[i]::DOUBLE) AS mean FROM embeddings, range(1, 65) r(i) GROUP BY ALL)
SELECT label, dim, round(mean, 6) AS mean, round(mean / nullif(sqrt(sum(mean * mean) OVER (PARTITION BY label)), 0), 6) AS unit FROM m""")
def centroids(spark, d):
    """Mean vector of each cluster, and the same with length 1."""
    m = vectors(spark, d).select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.avg(F.col("x").cast("double")).alias("m"))
    length = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("label")))
    return m.select("label", "dim", F.round("m", 6).alias("mean"), F.round(F.col("m") / F.nullif(length, F.lit(0.0)), 6).alias("unit"))


DIMENSIONS = 64


def _bucket(w):
    """Dimension of a word, by its first character and its length."""
    return (F.ascii(w) * 31 + F.char_length(w)) % DIMENSIONS


def hashed_cosine(documents, key: str, text: str, query: str):
    """key, score: cosine of the query's and the documents' word counts, words hashed to 64 dimensions.

    A document's words become dimensions in the scan and counts in the same task, batch by batch; nothing is shuffled.
    """
    wanted = np.zeros(DIMENSIONS)
    for t in X.query_terms(query):
        wanted[(ord(t[0]) * 31 + len(t)) % DIMENSIONS] += 1

    def score(batches):
        for batch in batches:
            lists = batch.column("dims")
            rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            counts = np.bincount(rows * DIMENSIONS + lists.flatten().to_numpy(zero_copy_only=False), minlength=len(lists) * DIMENSIONS).reshape(-1, DIMENSIONS)
            norm = np.sqrt((counts * counts).sum(1)) * np.sqrt((wanted * wanted).sum())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array((counts @ wanted) / norm)], names=["key", "score"])

    words = X.tokens(F.col(text))
    own = documents.select(F.col(key).cast("long").alias("key"), F.transform(words, _bucket).alias("dims")).where(F.size("dims") > 0)
    return own.mapInArrow(score, "key long, score double")


_WORDS = "(SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS w FROM documents)"
_HASHED = f"""(SELECT doc_id, round(sum(c * coalesce(n, 0)) / (sqrt(sum(c * c)) * sqrt((SELECT sum(n * n) FROM qv))), 9) AS score FROM (SELECT doc_id, (unicode(w) * 31 + length(w)) % 64 AS b, count(*) AS c FROM {_WORDS} GROUP BY ALL) LEFT JOIN qv USING (b) GROUP BY 1)"""
_QV = "qv AS (SELECT (unicode(w) * 31 + length(w)) % 64 AS b, count(*) AS n FROM (SELECT unnest(['session', 'index', 'cache']) AS w) GROUP BY 1)"


@query(f"""WITH {_QV}, l AS (SELECT doc_id AS key, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, round(score, 6) AS score FROM ({_BM25})) QUALIFY rank <= 50),
v AS (SELECT doc_id AS key, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM {_HASHED} QUALIFY rank <= 50)
SELECT key, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM l UNION ALL SELECT * FROM v) GROUP BY 1""")
def hybrid_search(spark, d):
    """Ranks of the documents by words and by their vectors fused: both lists are of doc_id."""
    lexical = R.ranked(_bm25(spark, d), "score", "doc_id", 50)
    dense = hashed_cosine(docs(spark, d), "doc_id", "text", QUERY).withColumn("score", F.round("score", 9))
    return R.fuse((lexical, "doc_id"), (R.ranked(dense, "score", "key", 50), "key")).withColumn("score", F.round("score", 9))


@query(f"""WITH t AS (SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM ({_BM25}) QUALIFY rank <= 20)
SELECT doc_id, score, rank FROM (SELECT *, max(CASE WHEN r < 0.8 THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS cut FROM (SELECT *, coalesce(score / lag(score) OVER (ORDER BY rank), 1.0) AS r FROM t)) WHERE cut = 0""")
def gated_search(spark, d):
    return R.gate(_bm25(spark, d), "score", "doc_id", 20).select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""WITH b AS (SELECT c_nationkey AS ballot, c_custkey % 40 AS item, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 10)
SELECT item, count(*) AS votes, min(rank) AS best_rank FROM b GROUP BY 1 HAVING count(*) >= 5""")
def vote_consensus(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    b = table(spark, d, "customer").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 10").select((F.col("c_custkey") % 40).alias("item"), "rank")
    return R.consensus(b, "item", "rank", 5)


@query(f"""WITH r AS (SELECT query, own, label, row_number() OVER (PARTITION BY query ORDER BY {_COS} DESC, vec_id) AS rank FROM embeddings, {_QS} QUALIFY rank <= 10),
w AS (SELECT label AS own, count(*) AS wanted FROM embeddings GROUP BY 1), h AS (SELECT query, own, count(*) FILTER (label = own) AS hits, min(rank) FILTER (label = own) AS first FROM r GROUP BY ALL)
SELECT avg(hits / wanted) AS recall, avg(hits / 10) AS precision, avg(coalesce(1 / first, 0)) AS mrr, count(*) AS queries FROM h JOIN w USING (own)""")
def retrieval_quality(spark, d):
    v = vectors(spark, d)
    results = _scored(spark, d, k=10)
    own = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "label")
    return R.quality(results, own.join(v.select("label", F.col("vec_id").alias("key")), "label").select("query", "key"), 10)


def fuzzy_search(spark, d):
    return R.fuzzy(table(spark, d, "part"), "p_partkey", "p_name", "smal wigdet")


QUERIES["fuzzy_search"] = fuzzy_search


@query("SELECT doc_id, trim(regexp_replace(lower(title), '[\\s\\-_/\\\\.:]+', ' ', 'g')) AS normal FROM (SELECT doc_id, project AS title FROM documents)")
def normalised_projects(spark, d):
    return docs(spark, d).select("doc_id", X.search_normalise(F.col("project")).alias("normal"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g'))")
def dedup_first(spark, d):
    """First of the texts alike but for case and white space; the text itself is shuffled as a digest."""
    key = F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\r]+", " "))
    own = docs(spark, d).where("text IS NOT NULL").select("doc_id", F.sha2(key, 256).alias("key"))
    return own.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("key")


@query("SELECT max(doc_id) AS doc_id, text_hash FROM (SELECT doc_id, md5(text) AS text_hash FROM documents WHERE text IS NOT NULL) GROUP BY 2")
def dedup_last(spark, d):
    return docs(spark, d).where("text IS NOT NULL").groupBy(F.md5(F.col("text").cast("binary")).alias("text_hash")).agg(F.max("doc_id").alias("doc_id"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS short, strlen(text) AS bytes, length(text) // 4 AS about_tokens FROM documents")
def text_sizes(spark, d):
    c = F.col("text")
    return docs(spark, d).select("doc_id", X.truncate(c, 80).alias("short"), F.octet_length(c).cast("long").alias("bytes"), F.expr("char_length(text) div 4").alias("about_tokens"))


def _classes_sql() -> str:
    cases = " ".join(f"WHEN tool IN ({', '.join(repr(t) for t in tools)}) THEN '{name}'" for name, tools in X.TOOL_CLASSES.items())
    return f"SELECT tool, CASE WHEN starts_with(tool, 'mcp__') THEN 'mcp' {cases} ELSE 'other' END AS category, count(*) AS n FROM (SELECT split_part(unnest(tool_calls), ' ', 1) AS tool FROM display_messages) GROUP BY ALL"


@query(_classes_sql())
def tool_categories(spark, d):
    tool = F.split(F.col("c"), " ")[0]
    c = table(spark, d, "display_messages").select(F.explode("tool_calls").alias("c"))
    return c.groupBy(tool.alias("tool"), X.tool_category(tool).alias("category")).agg(F.count("*").alias("n"))


def _redacted_sql() -> str:
    out = "text"
    for p in X.SECRETS:
        out = f"regexp_replace({out}, '{p}', '{X.MARK}', 'g')"
    for p in X.ASSIGNMENTS:
        out = f"regexp_replace({out}, '{p}', '\\1{X.MARK}', 'g')"
    return f"SELECT doc_id, {out} AS text FROM documents"


@query(_redacted_sql())
def redacted_documents(spark, d):
    return docs(spark, d).select("doc_id", X.redact_secrets(F.col("text")).alias("text"))




@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT file_name, count(*) AS lines, count(*) FILTER (TRY_CAST(body AS JSON) IS NULL OR body = '') AS blank FROM raw_batches WHERE body = '' OR body IS NULL GROUP BY 1")
def blank_lines(spark, d):
    return table(spark, d, "raw_batches").where("body = '' OR body IS NULL").groupBy("file_name").agg(F.count("*").alias("lines"), F.count("*").alias("blank"))


@query("SELECT regexp_extract(path, '([^/]+)$', 1) AS name, regexp_extract(path, '(\\d{4}-\\d{2}-\\d{2})', 1) AS file_date, count(*) AS n FROM memory_samples WHERE regexp_extract(path, '(\\d{4}-\\d{2}-\\d{2})', 1) >= '2026-04-01' GROUP BY ALL")
def log_files_by_date(spark, d):
    date = F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})", 1)
    return table(spark, d, "memory_samples").where(date >= "2026-04-01").groupBy(X.basename(F.col("path")).alias("name"), date.alias("file_date")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\w./-]+\\.(?:rs|ts|py|md)')) AS files, regexp_matches(text, '(^|[^0-9])413([^0-9]|$)') AS has_413 FROM documents WHERE text IS NOT NULL")
def file_references(spark, d):
    files = F.regexp_extract_all("text", F.lit(r"([\w./-]+\.(?:rs|ts|py|md))"), F.lit(1))
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", F.size(files).cast("long").alias("files"), F.col("text").rlike("(^|[^0-9])413([^0-9]|$)").alias("has_413"))
