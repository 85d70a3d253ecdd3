"""A stored full-text index: postings by term and sizes by document, built once, extended by what is new, read by term.

Two tables in a folder: `postings` (term, doc, tf, bucket), partitioned by `bucket`, a hash of the term, and `sizes` (doc,
stamp, dl). A query reads only the buckets of its terms and, of sizes, two columns; texts aren't read. An index is
incremental: a document whose stamp (say, length and time) is known is left alone, changed ones get new rows with their
stamp, and readers keep the rows of each document's current stamp only. Words are lower-case, without accents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import least_terms, query_terms, tokens, without_accents

BUCKETS = 64


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(docs: DataFrame, key: str, text: str, stamp: Column) -> DataFrame:
    """term, doc, stamp, tf of every distinct word of every document; counted where the document lies."""
    words = docs.select(F.col(key).alias("doc"), stamp.alias("stamp"), F.explode(tokens(without_accents(F.col(text)))).alias("term"))
    return words.groupBy("term", "doc", "stamp").agg(F.count("*").alias("tf"))


def build(docs: DataFrame, key: str, text: str, stamp: Column, folder: str) -> None:
    """Adds what the index at the folder doesn't hold yet in its present form; a new folder gets all."""
    spark = docs.sparkSession
    own = docs.where(F.col(text).isNotNull()).withColumn("__stamp", stamp.cast("string"))
    if exists(spark, folder):
        known = spark.read.parquet(f"{folder}/sizes").select(F.col("doc").alias(key), F.col("stamp").alias("__stamp"))
        own = own.join(known, [key, "__stamp"], "left_anti")
    # Written by bucket: a bucket's rows come from one shuffle and lie in few files.
    rows = postings(own, key, text, F.col("__stamp")).withColumn("bucket", _bucket(F.col("term")))
    rows.repartition("bucket").sortWithinPartitions("term").write.mode("append").partitionBy("bucket").parquet(f"{folder}/postings")
    sizes = own.select(F.col(key).alias("doc"), F.col("__stamp").alias("stamp"), F.size(tokens(F.col(text))).alias("dl"), F.current_timestamp().alias("at"))
    sizes.write.mode("append").parquet(f"{folder}/sizes")


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/sizes")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def current(spark: SparkSession, folder: str) -> DataFrame:
    """doc, stamp, dl of each document's latest form."""
    return spark.read.parquet(f"{folder}/sizes").groupBy("doc").agg(F.max_by(F.struct("stamp", "dl"), F.struct("at", "stamp")).alias("s")).select("doc", "s.*")


def matches(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """doc, stamp, terms (of the query it holds) and tf<i> for documents with a term of the query."""
    terms = query_terms(query)
    buckets = spark.range(1).select(*(_bucket(F.lit(t)).alias(f"b{i}") for i, t in enumerate(terms))).first()
    rows = spark.read.parquet(f"{folder}/postings").where(F.col("bucket").isin(*set(buckets)) & F.col("term").isin(*terms))
    return rows.groupBy("doc", "stamp").agg(F.count("*").alias("terms"), *(F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(terms)))


def candidates(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """Documents that hold as many terms as a query of that size needs: what is worth scoring in full."""
    least = least_terms(len(query_terms(query)))
    return matches(spark, folder, query).join(current(spark, folder), ["doc", "stamp"]).where(F.col("terms") >= least).select("doc")


def bm25(spark: SparkSession, folder: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc, score from the index alone."""
    now, terms = current(spark, folder), query_terms(query)
    hits = matches(spark, folder, query).join(now, ["doc", "stamp"])
    one = now.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    found = hits.agg(*(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = math.log(1 + (one["n"] - found[f"df{i}"] + 0.5) / (found[f"df{i}"] + 0.5))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / float(one["avgdl"] or 1)))
    return hits.select("doc", score.alias("score"))
