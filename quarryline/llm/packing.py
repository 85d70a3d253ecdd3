"""Texts into containers of fixed capacity, by best-fit decreasing over all items of a packing.

Sizes are whole tokens, so items of a size are alike and bins of a remaining capacity are too: the plan needs only the
histogram of sizes. A segment tree over remaining capacities finds the tightest open bins for a size in logarithmic
time, runs of equal bins take runs of equal items in one step, and the result is the one of best-fit decreasing item by
item. The histogram has at most `capacity` rows however many documents there are; the plan is bounded by the histogram.
Documents then get their rank among those of their size by counts per partition, and look their bin up in the plan.

A text longer than a container is cut: full pieces fill a container each, the rest is an item like any other. Null and
empty texts have no tokens: they come out with no container. Repeated texts are items of their own. A packing whose
source has no documents gives no rows. Packings with a null or non-positive capacity are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.common import cut
from quarryline.llm.tokens import source_name

MAX_CAPACITY = 1 << 20
MAX_PACKS = 1000
#: A packing's sizes stand at its number times this in the plan.
KEY = MAX_CAPACITY + 1


class OpenBins:
    """Runs of open bins by remaining capacity, with a segment tree to find the tightest one that fits."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, remaining: int, first: int, count: int) -> None:
        if remaining <= 0 or count <= 0:
            return
        self.runs.setdefault(remaining, []).append((first, count))
        at = self.leaves + remaining
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of an open bin that holds `size`."""
        at = self.leaves + size
        if self.any[at]:
            return size
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None

    def take(self, remaining: int) -> tuple[int, int]:
        runs = self.runs[remaining]
        run = runs.pop()
        if not runs:
            del self.runs[remaining]
            at = self.leaves + remaining
            self.any[at] = 0
            while at > 1 and not self.any[at ^ 1]:
                at >>= 1
                self.any[at] = 0
        return run


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Steps (size, first rank, items, first bin, items per bin), and the number of bins."""
    bins, opened, steps = OpenBins(capacity), 0, []
    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            r = bins.tightest(size)
            if r is None:
                r, first, count = capacity, opened, -(-left // (capacity // size))
                opened += count
            else:
                first, count = bins.take(r)
            each = r // size
            full = min(count, left // each)
            rest = min(left - full * each, each) if full < count else 0
            steps.append((size, rank, full * each + rest, first, each))
            bins.add(r - each * size, first, full)
            if rest:
                bins.add(r - rest * size, first + full, 1)
            bins.add(r, first + full + bool(rest), count - full - bool(rest))
            rank += full * each + rest
            left -= full * each + rest
    return steps, opened


class Seen:
    """Items counted so far by size; only sizes that occur are kept."""

    def __init__(self) -> None:
        self.counts: dict[int, int] = {}

    def add(self, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Adds counts of distinct sizes; what was counted before of each."""
        before = np.array([self.counts.get(x, 0) for x in sizes.tolist()], np.int64)
        self.counts.update(zip(sizes.tolist(), (before + counts).tolist(), strict=True))
        return before


def _items(batches: Iterator[pa.RecordBatch], packs: list[tuple[int, int, str | None]]) -> Iterator[pa.RecordBatch]:
    """(pack number, doc, full pieces, rest, ranks within this partition of both) of every document of every packing."""
    seen = [Seen() for _ in packs]
    for batch in batches:
        doc, n = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("n_tokens").to_numpy().astype(np.int64)
        source = np.array(batch.column("source").to_pylist(), dtype=object)
        for k, (_, capacity, own) in enumerate(packs):
            at = np.arange(len(n)) if own is None else np.flatnonzero(source == own)
            if not len(at):
                continue
            full, rest = n[at] // capacity, n[at] % capacity
            # The rank of an item is the number of items of its size before it.
            order = np.argsort(rest, kind="stable")
            sizes, start, counts = np.unique(rest[order], return_index=True, return_counts=True)
            rest_rank = np.empty(len(at), np.int64)
            rest_rank[order] = np.arange(len(at)) + np.repeat(seen[k].add(sizes, counts) - start, counts)
            full_rank = seen[k].add(np.array([capacity]), full.sum(keepdims=True)) + np.cumsum(full) - full
            yield pa.RecordBatch.from_pydict(
                {
                    "pack": pa.array(np.full(len(at), k, np.int32)),
                    "doc_id": pa.array(doc[at]),
                    "full": pa.array(full),
                    "rest": pa.array(rest),
                    "full_rank": pa.array(full_rank),
                    "rest_rank": pa.array(rest_rank),
                }
            )


def _counts(batches: Iterator[pa.RecordBatch], packs: list[tuple[int, int, str | None]]) -> Iterator[pa.RecordBatch]:
    """(pack number, size, items) of this partition."""
    seen = [Seen() for _ in packs]
    for batch in batches:
        n = batch.column("n_tokens").to_numpy().astype(np.int64)
        source = np.array(batch.column("source").to_pylist(), dtype=object)
        for k, (_, capacity, own) in enumerate(packs):
            mine = n if own is None else n[source == own]
            seen[k].add(*np.unique(mine % capacity, return_counts=True))
            seen[k].add(np.array([capacity]), (mine // capacity).sum(keepdims=True))
    for k, s in enumerate(seen):
        own = [(size, n) for size, n in s.counts.items() if size and n]
        yield pa.RecordBatch.from_pydict({"pack": pa.array(np.full(len(own), k, np.int32)), "size": pa.array([x for x, _ in own], pa.int64()), "n": pa.array([n for _, n in own], pa.int64())})


def _place(batches: Iterator[pa.RecordBatch], packs: list[tuple[int, int, str | None]], plan) -> Iterator[pa.RecordBatch]:
    keys, base, starts, first, each = plan.value
    names = ["pack_id", "doc_id", "piece_no", "start_token", "n_tokens", "container_id"]

    def look(pack: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        item = base[np.searchsorted(keys, pack.astype(np.int64) * KEY + size)] + rank
        step = np.searchsorted(starts, item, "right") - 1
        return first[step] + (item - starts[step]) // each[step]

    ids, capacities = np.array([p[0] for p in packs]), np.array([p[1] for p in packs])
    for batch in batches:
        c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        pack, capacity = c["pack"], capacities[c["pack"]]
        out = []
        if (whole := np.flatnonzero(c["full"])).size:
            times = c["full"][whole]
            row = np.repeat(whole, times)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            rank = c["full_rank"][row] + c["full_offset"][row] + piece
            out.append((ids[pack[row]], c["doc_id"][row], piece, piece * capacity[row], capacity[row], look(pack[row], capacity[row], rank)))
        if (row := np.flatnonzero(c["rest"])).size:
            rank = c["rest_rank"][row] + c["rest_offset"][row]
            out.append((ids[pack[row]], c["doc_id"][row], c["full"][row], c["full"][row] * capacity[row], c["rest"][row], look(pack[row], c["rest"][row], rank)))
        if (row := np.flatnonzero((c["rest"] == 0) & (c["full"] == 0))).size:
            zero = np.zeros(len(row), np.int64)
            out.append((ids[pack[row]], c["doc_id"][row], zero, zero, zero, zero - 1))
        if out:
            columns = [np.concatenate(x) for x in zip(*out, strict=True)]
            arrays = [pa.array(x.astype(np.int64)) for x in columns[:5]] + [pa.array(columns[5], pa.int64(), mask=columns[5] < 0)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def pack(tokens: DataFrame, pack_sizes: DataFrame) -> DataFrame:
    """pack_id, doc_id, piece_no, start_token, n_tokens, container_id: every piece of every document of each packing.

    tokens: doc_id, source, n_tokens (`tokens.token_counts`). pack_sizes: pack_id, capacity_tokens, source (null: all).
    """
    spark = tokens.sparkSession
    rows = pack_sizes.select("pack_id", "capacity_tokens", source_name(F.col("source")).alias("source")).where("capacity_tokens > 0").distinct().limit(MAX_PACKS + 1).collect()
    packs = sorted(((r[0], r[1], r[2]) for r in rows), key=lambda p: (p[0], p[1], p[2] or ""))
    if len(packs) > MAX_PACKS or any(c > MAX_CAPACITY for _, c, _ in packs):
        raise ValueError(f"more than {MAX_PACKS} packings, or a capacity above {MAX_CAPACITY}")
    schema = "pack_id long, doc_id long, piece_no long, start_token long, n_tokens long, container_id long"
    if not packs:
        return spark.createDataFrame([], schema)
    # Written once: partitions and their order stay the same for the two passes.
    tokens = cut(tokens)
    part = F.spark_partition_id().alias("part")
    counts = tokens.mapInArrow(partial(_counts, packs=packs), "pack int, size long, n long").select(part, "pack", "size", "n")
    before = Window.partitionBy("pack", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))))

    histograms: dict[int, dict[int, int]] = {}
    for r in counts.groupBy("pack", "size").agg(F.sum("n").alias("n")).collect():  # at most the sum of the capacities
        histograms.setdefault(r["pack"], {})[r["size"]] = r["n"]
    base: dict[int, int] = {}  # sizes that occur only
    starts, first, each, total = [], [], [], 0
    for k, (_, capacity, _) in enumerate(packs):
        histogram = histograms.get(k, {})
        for size in sorted(histogram, reverse=True):
            base[k * KEY + size] = total
            total += histogram[size]
        for size, rank, _, bin_, per_bin in best_fit_decreasing(histogram, capacity)[0]:
            starts.append(base[k * KEY + size] + rank)
            first.append(bin_)
            each.append(per_bin)
    keys = sorted(base)
    plan = spark.sparkContext.broadcast(tuple(np.array(x, np.int64) for x in (keys, [base[k] for k in keys], starts, first, each)))

    items = tokens.mapInArrow(partial(_items, packs=packs), "pack int, doc_id long, full long, rest long, full_rank long, rest_rank long").withColumn("part", F.spark_partition_id())
    offsets = counts.select("part", "pack", "size", "offset")
    sizes = F.array(*(F.lit(c) for _, c, _ in packs))
    whole = offsets.where(F.col("size") == F.element_at(sizes, F.col("pack") + 1)).select("part", "pack", F.col("offset").alias("full_offset"))
    placed = (
        items.join(whole, ["part", "pack"], "left")
        .join(offsets.select("part", "pack", F.col("size").alias("rest"), F.col("offset").alias("rest_offset")), ["part", "pack", "rest"], "left")
        .select("pack", "doc_id", "full", "rest", "full_rank", "rest_rank", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("full_offset", "rest_offset")))
    )
    return placed.mapInArrow(partial(_place, packs=packs, plan=plan), schema)


def report(placed: DataFrame, pack_sizes: DataFrame) -> DataFrame:
    """Per packing: documents, tokens, containers, the least number possible, and the share of unused space."""
    used = placed.groupBy("pack_id").agg(
        F.countDistinct("doc_id").alias("documents"), F.sum("n_tokens").alias("tokens"), (F.max("container_id") + 1).alias("containers")
    )
    room = F.col("containers") * F.col("capacity_tokens")
    return used.join(pack_sizes.select("pack_id", "capacity_tokens"), "pack_id").select(
        "pack_id", "capacity_tokens", "documents", "tokens", "containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), F.round(1 - F.col("tokens") / room, 6).alias("unused_share")
    )
