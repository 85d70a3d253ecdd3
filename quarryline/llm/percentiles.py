"""Percentiles per group of very large numeric columns, with a stated error, from partials that can be combined.

Partials are counts of value cells: a value keeps its `bits` leading bits, so a cell is at most 2^(1-bits) of its value
wide; below 2^bits cells are exact. Counts of cells add up, so partials of days, files or partitions merge exactly.

Ranks are found over merged cells by distributed multi-select: blocks of every partition propose their local (weighted)
medians, the weighted median of proposals becomes the pivot of each (group, percentile), one pass counts three ways and
proposes for both sides, the ranges ruled out are discarded; repeated until each rank is found. No value is shuffled.

The nearest-rank percentile p of n values is the ceil(p n)-th smallest. Null values are left out, null groups are one
group; negative values are values. An empty table gives no rows. Ties and repeated rows count as often as they occur.
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

BITS = 8
MAX_TARGETS = 200_000
BLOCK = 1 << 18
#: Rounds between two prunings: cells outside all open ranges of their group are then left behind.
PRUNE = 4


def cell_shift(value: Column, bits: int) -> Column:
    """How many low bits the cell of a value leaves out."""
    return F.greatest(F.length(F.bin(F.abs(value))) - bits, F.lit(0))


def cell_low(value: Column, bits: int = BITS) -> Column:
    """The value of a cell that is nearest to zero."""
    size = F.call_function("shiftleft", F.lit(1).cast("long"), cell_shift(value, bits))
    return value - value % size


def daily_partials(df: DataFrame, day: Column, group: Column, metrics: list[str], bits: int = BITS) -> DataFrame:
    """day, grp, metric, cell, n: the mergeable partial results."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("value")) for m in metrics))
    rows = df.select(day.alias("day"), group.alias("grp"), F.inline(pairs)).where("value is not null")
    return rows.groupBy("day", "grp", "metric", cell_low(F.col("value"), bits).alias("cell")).agg(F.count("*").alias("n"))


def merge(partials: DataFrame, *keys: str) -> DataFrame:
    """Partials of any origin to one count per cell and group."""
    return partials.groupBy(*keys, "cell").agg(F.sum("n").alias("n"))


def _weighted_median(values: np.ndarray, weights: np.ndarray) -> int:
    """Of sorted values."""
    total = np.cumsum(weights)
    return int(values[np.searchsorted(total, (total[-1] + 1) // 2)])


def _round(batches: Iterator[pa.RecordBatch], groups: list, targets: dict[int, list[tuple]]) -> Iterator[pa.RecordBatch]:
    """Per block and target: counts below, at and above its pivot within its range, and the local medians of both sides.

    A target is (number, low, high, pivot), its range low < value < high; pivot None asks for proposals only.
    """
    code = {g: i for i, g in enumerate(groups)}
    names = ["target", "below", "at", "above", "median_below", "median_above"]

    def block(who: np.ndarray, value: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((value, who))
        who, value, n = who[order], value[order], n[order]
        out: list[tuple] = []
        for g in np.unique(who):
            a, b = np.searchsorted(who, [g, g + 1])
            v, w = value[a:b], n[a:b]
            sums = np.concatenate([[0], np.cumsum(w)])
            for k, low, high, pivot in targets.get(int(g), ()):
                i, j = np.searchsorted(v, low, "right"), np.searchsorted(v, high, "left")
                x, y = (i, i) if pivot is None else (np.searchsorted(v[i:j], pivot, "left") + i, np.searchsorted(v[i:j], pivot, "right") + i)
                if i < j:
                    out.append(
                        (
                            k,
                            int(sums[x] - sums[i]),
                            int(sums[y] - sums[x]),
                            int(sums[j] - sums[y]),
                            _weighted_median(v[i:x], w[i:x]) if i < x else None,
                            _weighted_median(v[y:j], w[y:j]) if y < j else None,
                        )
                    )
        columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    held: list[tuple] = []
    for batch in batches:
        keys = batch.column("grp").dictionary_encode(null_encoding="encode")
        to = np.array([code.get(g, -1) for g in keys.dictionary.to_pylist()], dtype=np.int64)
        who = to[keys.indices.to_numpy()]
        own = who >= 0
        held.append((who[own], batch.column("cell").to_numpy()[own], batch.column("n").to_numpy()[own]))
        if sum(len(x[0]) for x in held) >= BLOCK:
            yield block(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
    if held:
        yield block(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _open_cells(batches: Iterator[pa.RecordBatch], groups: list, ranges: dict[int, list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """Cells within an open range of their group."""
    code = {g: i for i, g in enumerate(groups)}
    for batch in batches:
        keys = batch.column("grp").dictionary_encode(null_encoding="encode")
        who = np.array([code.get(g, -1) for g in keys.dictionary.to_pylist()], dtype=np.int64)[keys.indices.to_numpy()]
        cell, keep = batch.column("cell").to_numpy(), np.zeros(batch.num_rows, bool)
        order = np.argsort(who, kind="stable")
        for g in np.unique(who):
            rows = order[slice(*np.searchsorted(who[order], [g, g + 1]))]
            for low, high in ranges.get(int(g), ()):
                keep[rows] |= (cell[rows] > low) & (cell[rows] < high)
        yield batch.filter(pa.array(keep))


def select_ranks(cells: DataFrame, percentiles: list[float], max_rounds: int = 200) -> DataFrame:
    """grp, values, percentile, cell: the nearest-rank cell of each percentile of each group.

    cells: grp string, cell long, n long. Only ranges and pivots of (group, percentile) pairs stand on the driver; groups
    are taken in turns of at most MAX_TARGETS pairs, each a selection of its own.
    """
    spark = cells.sparkSession
    cells = cut(cells.select("grp", "cell", "n"))
    totals = cut(cells.groupBy("grp").agg(F.sum("n").alias("n"), F.min("cell").alias("low"), F.max("cell").alias("high")))
    turns = max(1, -(-totals.count() * len(percentiles) // MAX_TARGETS))
    turn = F.pmod(F.xxhash64("grp"), F.lit(turns))
    schema = "grp string, `values` long, percentile double, cell long"
    out = spark.createDataFrame([], schema)
    for t in range(turns):
        own = cells if turns == 1 else cells.where(turn == t)
        rows = _select(own, (totals if turns == 1 else totals.where(turn == t)).collect(), percentiles, max_rounds)
        part = spark.createDataFrame(rows, schema)
        # A turn's ranks leave the driver before the next one begins.
        out = part if turns == 1 else out.unionByName(cut(part))
    return out


def _select(cells: DataFrame, totals: list, percentiles: list[float], max_rounds: int) -> list[tuple]:
    groups = [r["grp"] for r in totals]
    # Of each target: group, rank within the open range (low, high), range, pivot.
    state = [
        {"g": g, "p": p, "k": max(1, math.ceil(p * r["n"] - 1e-9)), "low": r["low"] - 1, "high": r["high"] + 1, "pivot": None, "n": r["n"]}
        for g, r in enumerate(totals)
        for p in percentiles
    ]
    found: dict[int, int] = {}
    for n in range(max_rounds):
        left: dict[int, list[tuple]] = {}
        for t, s in enumerate(state):
            if t not in found:
                if s["high"] - s["low"] == 2:
                    found[t] = s["low"] + 1
                else:
                    left.setdefault(s["g"], []).append((t, s["low"], s["high"], s["pivot"]))
        if not left:
            break
        if n and n % PRUNE == 0:
            ranges = {g: sorted({(low, high) for _, low, high, _ in own}) for g, own in left.items()}
            cells = cut(cells.mapInArrow(partial(_open_cells, groups=groups, ranges=ranges), "grp string, cell long, n long"))
        median = lambda side: F.percentile(f"median_{side}", 0.5, F.col(side)).alias(f"median_{side}")
        proposed = (
            cells.mapInArrow(partial(_round, groups=groups, targets=left), "target long, below long, at long, above long, median_below long, median_above long")
            .groupBy("target")
            .agg(F.sum("below").alias("n_below"), F.sum("at").alias("n_at"), F.sum("above").alias("n_above"), median("below"), median("above"))
            .collect()
        )
        for r in proposed:
            s = state[r["target"]]
            if s["pivot"] is not None and s["k"] <= r["n_below"]:
                s["high"], pivot = s["pivot"], r["median_below"]
            elif s["pivot"] is not None and s["k"] <= r["n_below"] + r["n_at"]:
                found[r["target"]] = s["pivot"]
                continue
            else:
                s["k"] -= r["n_below"] + r["n_at"]
                s["low"], pivot = s["pivot"] if s["pivot"] is not None else s["low"], r["median_above"]
            s["pivot"] = min(s["high"] - 1, max(s["low"] + 1, math.floor(pivot)))
    if len(found) < len(state):
        raise RuntimeError("ranks not found")
    return [(groups[s["g"]], s["n"], s["p"], found[t]) for t, s in enumerate(state)]


def with_error(found: DataFrame, bits: int = BITS) -> DataFrame:
    """Adds the cell's bounds, the estimate (its middle) and the largest possible error."""
    size = F.call_function("shiftleft", F.lit(1).cast("long"), cell_shift(F.col("cell"), bits))
    far = F.when(F.col("cell") < 0, F.col("cell") - size + 1).otherwise(F.col("cell") + size - 1)
    return (
        found.withColumn("lower", F.least("cell", far))
        .withColumn("upper", F.greatest("cell", far))
        .withColumn("estimate", (F.col("lower") + F.col("upper")) / 2)
        .withColumn("max_error", (F.col("upper") - F.col("lower")) / 2)
        .drop("cell")
    )


def version_name(c: Column) -> Column:
    """One name for the spellings of a version; blank and null are '(unknown)'."""
    own = F.regexp_replace(F.lower(F.trim(c)), "^v(?=[0-9])", "")
    return F.coalesce(F.when(own != "", own), F.lit("(unknown)"))


def version_percentiles(events: DataFrame, metrics: list[str], percentiles: list[float], bits: int = BITS) -> DataFrame:
    """Percentiles of each metric per version, for each day and for all days ('(all)'); every stored row counts.

    All come from the same daily partials: a day's own, and the sum over the days.
    """
    partials = daily_partials(events, F.to_date("created_at"), version_name(F.col("version")), metrics, bits)
    day = F.coalesce(F.col("day").cast("string"), F.lit("(unknown)"))
    periods = partials.select(F.explode(F.array(day, F.lit("(all)"))).alias("period"), "grp", "metric", "cell", "n")
    key = F.concat_ws("\t", "period", "metric", "grp")
    cells = merge(periods, "period", "grp", "metric").select(key.alias("grp"), "cell", "n")
    found = with_error(select_ranks(cells, percentiles), bits)
    parts = F.split("grp", "\t", 3)
    return found.select(parts[0].alias("period"), parts[2].alias("version"), parts[1].alias("metric"), "percentile", "values", "estimate", "lower", "upper", "max_error")
