"""Sources mixed to target shares of the tokens by Poisson replication.

Every document draws a uniform number from a 63-bit hash of (seed, mix, document) and inverts a Poisson distribution with
it: that many copies, at most the cap. The mean of each source is set so that the tokens drawn, not only the expected
ones, meet the source's share: for the drawn numbers fixed, the tokens selected grow with the mean, so it is found by
bisection over the tokens per slice of drawn numbers. Slices only serve to find the mean: a first pass takes SLICES of
them, a second cuts those finer in which the number of copies changes near the mean found, so that the mean is known to
the document even where a share is tiny. Both are a bounded number of rows per source and mix, whatever the documents.

Target shares are divided by their sum over the sources that have documents with tokens; a source without any gets
nothing and is reported. A mix is as large as the caps allow, and at most as large as its sources together; a source whose
target is all its caps allow is used `max_repeats` times throughout (the limit of a growing mean). Null cap: no cap. Null
or non-positive shares, documents without tokens and sources outside the mix are not selected. Repeated texts are
documents of their own. A share below half of a source's last drawn document selects none of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.common import cut
from quarryline.llm.tokens import source_name

SLICES = 4096
#: Rows of the second histogram per target, over all its slices that are cut finer.
FINE = 16_384
MAX_TARGETS = 1000
WIDTH = float(1 << 63)


def log_factorial(k: np.ndarray) -> np.ndarray:
    """ln k!, by Stirling's series (its error is below 1e-9 from 10 on) and exactly below."""
    exact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 10)))])
    x = np.maximum(k, 10).astype(float)
    series = x * np.log(x) - x + 0.5 * np.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(k < 10, exact[np.minimum(k, 9)], series)


def thresholds(mean: float, cap: int | None) -> tuple[int, np.ndarray]:
    """The Poisson distribution function from its first notable value on: (that value, its cumulated probabilities).

    A drawn number u gives first + (how many of them are at most u) copies.
    """
    if mean <= 0:
        return 0, np.array([1.0])
    first, last = max(0, int(mean - 12 * math.sqrt(mean) - 20)), int(mean + 12 * math.sqrt(mean) + 20)
    if cap is not None:
        last = min(last, cap - 1)
        first = min(first, cap)
    k = np.arange(first, last + 1)
    return first, np.minimum(np.cumsum(np.exp(-mean + k * math.log(mean) - log_factorial(k))), 1.0)


def copies_of(u: np.ndarray, mean: float, cap: int | None) -> np.ndarray:
    """Copies of each drawn number: the distribution inverted, at most the cap; an infinite mean gives the cap."""
    if math.isinf(mean):
        return np.full(len(u), cap, np.int64)
    first, steps = thresholds(mean, cap)
    return first + np.searchsorted(steps, u, "right")


def fitted_mean(u: np.ndarray, tokens: np.ndarray, wanted: float, cap: int | None) -> float:
    """The mean whose selection comes closest to `wanted`, drawn numbers u with tokens each."""
    total = float(tokens.sum())
    if cap is not None and wanted >= cap * total:
        return math.inf
    drawn = lambda mean: float((copies_of(u, mean, cap) * tokens).sum())
    low, high = 0.0, max(1.0, 2 * wanted / total)
    while drawn(high) < wanted:
        low, high = high, 2 * high
    for _ in range(80):
        mean = (low + high) / 2
        low, high = (mean, high) if drawn(mean) < wanted else (low, mean)
    return low if wanted - drawn(low) < drawn(high) - wanted else high


def _slices_to_cut(mean: float, cap: int | None, tokens: np.ndarray) -> np.ndarray:
    """Slices in which the number of copies may change for means near the one found (off by a slice's tokens)."""
    if math.isinf(mean) or not tokens.any():
        return np.empty(0, np.int64)
    edges = np.arange(SLICES + 1) / SLICES
    slack = max(4.0 * tokens.max() / tokens.sum(), 4.0 / SLICES)
    low, high = copies_of(edges[:-1], max(0.0, mean - slack), cap), copies_of(np.nextafter(edges[1:], 0), mean + slack, cap)
    return np.flatnonzero(low != high)


def _replicated(batches: Iterator[pa.RecordBatch], means: dict[tuple[int, str], tuple[float, int | None]]) -> Iterator[pa.RecordBatch]:
    """The documents with their copies by the mean of their target, those with none left out."""
    for batch in batches:
        u = batch.column("u").to_numpy()
        mixes, sources = batch.column("mix_id").to_numpy(), batch.column("source").dictionary_encode()
        names, at = sources.dictionary.to_pylist(), sources.indices.to_numpy()
        copies = np.zeros(len(u), np.int64)
        for code in np.unique(mixes.astype(np.int64) * len(names) + at) if len(u) else ():
            m, s = divmod(int(code), len(names))
            if (m, names[s]) in means:
                rows = (mixes == m) & (at == s)
                copies[rows] = copies_of(u[rows], *means[m, names[s]])
        kept = pa.array(copies > 0)
        out = batch.select(["mix_id", "doc_id", "source", "n_tokens"]).filter(kept)
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(copies[copies > 0])], names=["mix_id", "doc_id", "source", "n_tokens", "copies"])


def drawn_number(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_id", "doc_id"), 1).cast("double") / F.lit(WIDTH)


def mix(tokens: DataFrame, targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The selection (mix_id, doc_id, source, copy_no, n_tokens, shuffle_key; in global random order) and the report."""
    spark = tokens.sparkSession
    rows = targets.groupBy("mix_id", source_name(F.col("source")).alias("source")).agg(
        F.sum("target_share").alias("share"), F.min("max_repeats").alias("cap")
    ).limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    wanted = sorted((r for r in rows if r["source"] is not None), key=lambda r: (r["mix_id"], r["source"]))
    tokens = cut(tokens.where("n_tokens > 0 and source is not null"))
    plan = spark.createDataFrame([(r["mix_id"], r["source"]) for r in wanted], "mix_id int, source string")
    drawn = tokens.join(F.broadcast(plan), "source").withColumn("u", drawn_number(seed))  # at most MAX_TARGETS rows
    sliced = drawn.withColumn("slice", F.least(F.floor(F.col("u") * SLICES), F.lit(SLICES - 1)).cast("int"))
    sizes: dict[tuple, np.ndarray] = {}
    for r in sliced.groupBy("mix_id", "source", "slice").agg(F.sum("n_tokens").alias("n")).collect():  # SLICES per target
        sizes.setdefault((r["mix_id"], r["source"]), np.zeros(SLICES, np.int64))[r["slice"]] = r["n"]

    aims, goals = [], {}
    for m in sorted({r["mix_id"] for r in wanted}):
        own = [r for r in wanted if r["mix_id"] == m]
        usable = [r for r in own if (m, r["source"]) in sizes and (r["share"] or 0) > 0 and (r["cap"] is None or r["cap"] > 0)]
        shares = sum(r["share"] for r in usable)
        available = {r["source"]: float(sizes[m, r["source"]].sum()) for r in usable}
        limits = [r["cap"] * available[r["source"]] * shares / r["share"] for r in usable if r["cap"] is not None]
        size = min([sum(available.values()), *limits], default=0.0)
        for r in own:
            aim = r["share"] / shares if r in usable else 0.0
            aims.append((m, r["source"], r["share"], aim, r["cap"]))
            if r in usable:
                goals[m, r["source"]] = aim * size, r["cap"]
    middles = (np.arange(SLICES) + 0.5) / SLICES
    cuts = {t: _slices_to_cut(fitted_mean(middles, sizes[t], *goal), goal[1], sizes[t]) for t, goal in goals.items()}
    means = _exact_means(spark, sliced, sizes, goals, cuts)
    schema = "mix_id int, doc_id long, source string, n_tokens int, copies long"
    selected = (
        drawn.select("mix_id", "doc_id", "source", "n_tokens", "u")
        .mapInArrow(partial(_replicated, means=means), schema)
        .select("mix_id", "doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_no"), "n_tokens")
        .withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), "mix_id", "doc_id", "copy_no"))
    )
    used = selected.groupBy("mix_id", "source").agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("records"), F.countDistinct("doc_id").alias("documents"), F.max("copy_no").alias("most_repeats")
    )
    aimed = spark.createDataFrame(aims, "mix_id int, source string, target_share double, aimed_share double, max_repeats int")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    shares = (
        F.broadcast(aimed).join(used, ["mix_id", "source"], "left").select("mix_id", "source", "target_share", "aimed_share", "max_repeats", *map(zero, ("tokens", "records", "documents", "most_repeats")))
    )
    all_tokens = shares.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    report = shares.join(all_tokens, "mix_id").withColumn("actual_share", F.round(F.col("tokens") / F.nullif("mix_tokens", F.lit(0)), 6))
    return selected.orderBy("mix_id", "shuffle_key"), report


def _exact_means(spark, sliced: DataFrame, sizes: dict, goals: dict, cuts: dict) -> dict[tuple[int, str], tuple[float, int | None]]:
    """The mean of each target, by its slices and those of `cuts` in finer ones."""
    parts = {t: max(1, FINE // max(1, len(c))) for t, c in cuts.items()}
    rows = [(m, s, int(k), parts[m, s]) for (m, s), c in cuts.items() for k in c]  # at most SLICES per target
    fine: dict[tuple, dict[int, dict[int, int]]] = {}
    if rows:
        which = spark.createDataFrame(rows, "mix_id int, source string, slice int, parts int")
        within = sliced.join(F.broadcast(which), ["mix_id", "source", "slice"])
        part = F.least(F.floor((F.col("u") * SLICES - F.col("slice")) * F.col("parts")), F.col("parts") - 1).alias("part")
        for r in within.groupBy("mix_id", "source", "slice", part).agg(F.sum("n_tokens").alias("n")).collect():  # FINE per target
            fine.setdefault((r["mix_id"], r["source"]), {}).setdefault(r["slice"], {})[r["part"]] = r["n"]
    means = {}
    for t, (goal, cap) in goals.items():
        whole = np.ones(SLICES, bool)
        whole[cuts[t]] = False
        u, n = [(np.flatnonzero(whole) + 0.5) / SLICES], [sizes[t][whole]]
        for k, own in fine.get(t, {}).items():
            at = np.array(sorted(own))
            u.append((k + (at + 0.5) / parts[t]) / SLICES)
            n.append(np.array([own[i] for i in at]))
        means[t] = fitted_mean(np.concatenate(u), np.concatenate(n), goal, cap), cap
    return means
