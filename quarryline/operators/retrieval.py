"""Retrieval: BM25, dense similarity, rank fusion, gating, consensus, reranking, quality, fuzzy matching."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.common import cut
from quarryline.functions.text import query_terms, tokens

#: Parameters of our choice: the usual BM25 and reciprocal-rank constants.
K1, B, RRF_K = 1.2, 0.75, 60
GATE = 0.8


def top_k(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """Best k rows, ties by key; k = 0 gives none."""
    return df.orderBy(F.desc(score), F.col(key)).limit(k)


def _term_count(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def bm25(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """key, score of documents that hold a query term.

    Term frequencies are counted inside each row, so nothing of the text is shuffled: one scan of the texts gives a narrow
    row of counts per document, kept once; the corpus figures and the scores are read from those. Texts indexed before
    (`search_index`) aren't read at all.
    """
    terms = query_terms(query)
    own = docs.select(key, tokens(F.col(text)).alias("w"))
    counted = own.select(key, F.size("w").alias("dl"), *(_term_count("w", t).alias(f"tf{i}") for i, t in enumerate(terms)))
    counted = cut(counted)
    corpus = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(terms))))
    one = corpus.first()
    if not one["n"] or not terms:
        return counted.select(key, F.lit(0.0).alias("score")).limit(0)
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = float(np.log(1 + (one["n"] - one[f"df{i}"] + 0.5) / (one[f"df{i}"] + 0.5)))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / float(one["avgdl"])))
    any_ = sum((F.col(f"tf{i}") for i in range(len(terms))), F.lit(0)) > 0
    return counted.where(any_).select(key, score.alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length or zero norm."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / F.nullif(norm, F.lit(0.0))).otherwise(0.0)


def fuse(*ranked: tuple[DataFrame, str]) -> DataFrame:
    """Reciprocal-rank fusion of candidate lists (key, rank): sum of 1 / (60 + rank), a missing list adds nothing."""
    parts = None
    for df, key in ranked:
        own = df.select(F.col(key).alias("key"), (1.0 / (RRF_K + F.col("rank"))).alias("part"))
        parts = own if parts is None else parts.unionByName(own)
    return parts.groupBy("key").agg(F.sum("part").alias("score"))


def ranked(df: DataFrame, score: str, key: str, pool: int) -> DataFrame:
    """The best `pool` rows with their rank; the window runs over at most `pool` rows."""
    best = df.orderBy(F.desc(score), F.col(key)).limit(pool)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.col(key))))


def gate(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """Of the best k, those before the first drop below GATE times the one before; at least the first."""
    top = ranked(df, score, key, k)
    w = Window.orderBy("rank")
    drop = F.coalesce(F.col(score) / F.nullif(F.lag(score).over(w), F.lit(0.0)), F.lit(1.0)) < GATE
    return top.withColumn("cut", F.max(drop.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("cut = 0").drop("cut")


def consensus(votes: DataFrame, item: str, rank: str, least: int) -> DataFrame:
    """Items with enough votes, most votes first, then best rank."""
    return votes.groupBy(item).agg(F.count("*").alias("votes"), F.min(rank).alias("best_rank")).where(F.col("votes") >= least).orderBy(F.desc("votes"), "best_rank", item)


def compose(candidates: DataFrame, reranked: DataFrame, key: str, keep_rest: bool) -> DataFrame:
    """Reranked items first, in their order; the rest after them (recall mode) or not at all (precision mode)."""
    both = candidates.join(reranked.select(key, F.col("rank").alias("new_rank")), key, "left" if keep_rest else "inner")
    return both.withColumn("position", F.coalesce("new_rank", F.col("rank") + 1_000_000))


def quality(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """recall@k, precision@k and mean reciprocal rank. results: query, key, rank. relevant: query, key."""
    hit = results.where(F.col("rank") <= k).join(relevant.withColumn("hit", F.lit(1)), ["query", "key"])
    per = relevant.groupBy("query").agg(F.count("*").alias("wanted")).join(hit.groupBy("query").agg(F.count("*").alias("hits"), F.min("rank").alias("first")), "query", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return per.agg(F.avg(zero(F.col("hits") / F.col("wanted"))).alias("recall"), F.avg(zero(F.col("hits") / F.lit(k))).alias("precision"), F.avg(zero(1 / F.col("first"))).alias("mrr"), F.count("*").alias("queries"))


#: Scores of the fuzzy alignment (fixed values).
MATCH, CONSECUTIVE, BOUNDARY, FIRST, GAP, SUBSTITUTION, DELETION, TRANSPOSITION, EXACT = 16, 8, 9, 12, -3, -10, -12, 10, 32
LOST = -(10**6)
#: Cells of a matrix of words at most, but for a single longer word.
MATRIX = 1 << 21


def fuzzy_scores(pattern: str, words: list[str]) -> np.ndarray:
    """Best alignment score of a pattern in each word, or LOST: one pass over all words at once.

    Words are rows of a matrix of code points; for every number of errors, `end` holds the best score with the last
    pattern character matched at this column and `any_` the best one at or before it, gaps paid.
    """
    if len(words) * max([len(w) for w in words], default=0) > MATRIX and len(words) > 1:
        # Words of like length together: a matrix is as wide as its longest word.
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        half, out = len(order) // 2, np.empty(len(words), np.int64)
        for part in (order[:half], order[half:]):
            out[part] = fuzzy_scores(pattern, [words[i] for i in part])
        return out
    p = [ord(c) for c in pattern.lower()]
    budget = 0 if len(p) <= 2 else 1 if len(p) <= 8 else 2
    width = max([len(w) for w in words], default=0)
    if not p or not width:
        return np.full(len(words), LOST)
    hay = np.full((len(words), width), -1)
    for i, w in enumerate(words):
        hay[i, : len(w)] = [ord(c) for c in w.lower()]
    before = np.concatenate([np.full((len(words), 1), ord(" ")), hay[:, :-1]], axis=1)
    letters = ((before >= 48) & (before <= 57)) | ((before >= 97) & (before <= 122)) | (before > 127)
    bonus = np.where(letters, 0, BOUNDARY)
    shape = (budget + 1, len(words), width + 1)
    end, any_ = np.full(shape, LOST), np.full(shape, LOST)
    any_[0] = GAP * np.arange(width + 1)
    older = None
    for i, c in enumerate(p):
        new_end, new_any = np.full(shape, LOST), np.full(shape, LOST)
        same = hay == c
        for e in range(budget + 1):
            # Matched here: after anything (gaps were paid), or right after the previous match.
            hit = np.maximum(any_[e][:, :-1], end[e][:, :-1] + CONSECUTIVE) + MATCH + bonus
            if i == 0:
                hit[:, 0] += FIRST
            new_end[e][:, 1:] = np.where(same, hit, LOST)
            if e:
                swap = np.where(~same & (hay >= 0), np.maximum(any_[e - 1][:, :-1], end[e - 1][:, :-1]) + SUBSTITUTION, LOST)
                new_any[e][:, 1:] = swap
                new_any[e] = np.maximum(new_any[e], np.maximum(any_[e - 1], end[e - 1]) + DELETION)
                if older is not None and width >= 2 and p[i - 1] != c:
                    turned = (hay[:, :-1] == c) & (hay[:, 1:] == p[i - 1])
                    moved = np.where(turned, older[e - 1][:, :-2] + TRANSPOSITION + bonus[:, :-1], LOST)
                    new_any[e][:, 2:] = np.maximum(new_any[e][:, 2:], moved)
            run = np.maximum(new_any[e], new_end[e])
            for j in range(1, width + 1):
                run[:, j] = np.maximum(run[:, j], run[:, j - 1] + GAP)
            new_any[e] = run
        older, end, any_ = any_, new_end, new_any
    valid = np.concatenate([np.ones((len(words), 1), bool), hay >= 0], axis=1)
    best = np.where(valid, end, LOST).max(axis=(0, 2))
    best += np.where([w.lower() == pattern.lower() for w in words], EXACT, 0)
    return np.where(best >= 12 * len(p), best, LOST)


def fuzzy(df: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """key, score: every word of the query must match some word; the score sums the best ones.

    Rows lacking too many of the query's characters are left out before Python.
    """
    words = query.lower().split()
    own = df.where(F.col(text).isNotNull())
    for w in words:
        budget = 0 if len(w) <= 2 else 1 if len(w) <= 8 else 2
        missing = sum((F.when(F.lower(text).contains(c), 0).otherwise(1) for c in w), F.lit(0))
        own = own.where(missing <= budget)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            vocabulary = sorted({t for x in b["text"] for t in x.lower().split()})
            best = [dict(zip(vocabulary, fuzzy_scores(w, vocabulary), strict=True)) for w in words]
            for k, x in zip(b["key"], b["text"], strict=True):
                parts = [max((table[t] for t in x.lower().split()), default=LOST) for table in best]
                if all(p > LOST for p in parts):
                    rows.append((k, int(sum(parts))))
            yield pd.DataFrame(rows, columns=["key", "score"])

    return own.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInPandas(score, "key long, score long")


def batch_scores(df: DataFrame, key: str, vector: str, queries: list[tuple[int, list[float]]], k: int | None = None, least: float | None = None, norm: bool = True) -> DataFrame:
    """query, key, score (cosine, or inner product if not `norm`) of all queries against all rows, by blocks of matrix products.

    With k, the best k of each query, ties by key: each block of rows hands on its own best k at most. With least, scores
    from that on. Vectors of another length and zero norms score 0.
    """
    width = len(queries[0][1]) if queries else 0
    ids = [q for q, _ in queries]
    q = np.array([v for _, v in queries], float).reshape(len(queries), width)

    def unit(x: np.ndarray) -> np.ndarray:
        n = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    side = unit(q) if norm else q

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = b["key"].to_numpy()
            rows = np.zeros((len(b), width))
            for i, v in enumerate(b["vector"]):
                if v is not None and len(v) == width:
                    rows[i] = v
            all_ = np.round(side @ (unit(rows) if norm else rows).T, 9)
            for j, name in enumerate(ids):
                take = np.lexsort((keys, -all_[j]))[:k] if k is not None else np.flatnonzero(all_[j] >= least) if least is not None else np.arange(len(b))
                yield pd.DataFrame({"query": name, "key": keys[take], "score": all_[j][take]})

    out = df.select(F.col(key).alias("key"), F.col(vector).alias("vector")).mapInPandas(score, "query long, key long, score double")
    return out if k is None else best_of_each(out, k)


def best_of_each(scores: DataFrame, k: int) -> DataFrame:
    """query, key, score, rank of the best k of each query, ties by key."""
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return scores.withColumn("rank", nth).where(F.col("rank") <= k)


#: Query vectors that are scored in one pass over the rows; more take further passes.
QUERY_BLOCK = 20_000


def scores_of_all(df: DataFrame, queries: DataFrame, key: str, vector: str, **how) -> DataFrame:
    """`batch_scores` of any number of queries (key, vector), block after block; the driver holds one block of them."""
    rows, out = queries.select(key, vector).toLocalIterator(), None
    while block := [(r[0], r[1]) for r in islice(rows, QUERY_BLOCK)]:
        part = batch_scores(df, key, vector, block, **how)
        if out is not None or len(block) == QUERY_BLOCK:
            part = cut(part)
        out = part if out is None else out.unionByName(part)
    return batch_scores(df.limit(0), key, vector, [], **how) if out is None else out
