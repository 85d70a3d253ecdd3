"""References to records that do not exist, are deleted, or arrive later.

Keys are spread over ranges of their 128-bit digest. Parents of a range are kept as sorted arrays, reference
batches stream past them and are probed by vectorised binary search; only misses leave the task. Parents are
reduced to one row per key before the shuffle, references to nothing but their columns. A range whose share of the
references is above `hot_factor` times the mean is split: its references get a salt, its parents one copy per salt,
so a key that a third of all references point to is probed by many tasks.

Nulls: a null or blank reference is no reference; a null `received_at` on either side is never late; null parents
and null deleted keys are ignored. Empty tables give no parents (all missing) or no rows. Repeated records give one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.common import digest16, shuffle_width, uuid_key

PARENT, DELETED, REFERENCE = 0, 1, 2
#: Parents a range holds at most, before copies of a key are counted once.
RANGE_ROWS = 4_000_000

MISSES = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("ref_field", T.StringType()),
        T.StructField("received_at", T.TimestampNTZType()),
        T.StructField("ref_state", T.StringType()),
    ]
)


def _words(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """16-byte digests as two arrays of big-endian 64-bit words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=">u8").reshape(-1, 2)
    return raw[:, 0].astype(np.uint64), raw[:, 1].astype(np.uint64)


class _Sorted:
    """Distinct (target, digest) keys, sorted by the first word; `find` gives a row or -1."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, target: np.ndarray, seen: np.ndarray) -> None:
        order = np.lexsort((target, lo, hi))
        self.hi, self.lo, self.target, self.seen = hi[order], lo[order], target[order], seen[order]

    def find(self, hi: np.ndarray, lo: np.ndarray, target: np.ndarray) -> np.ndarray:
        found = np.full(len(hi), -1, dtype=np.int64)
        at, end = np.searchsorted(self.hi, hi, "left"), np.searchsorted(self.hi, hi, "right")
        open_ = at < end
        while open_.any():
            rows = np.flatnonzero(open_)
            here = at[rows]
            hit = (self.lo[here] == lo[rows]) & (self.target[here] == target[rows])
            found[rows[hit]] = here[hit]
            at[rows] += 1
            open_[rows] = ~hit & (at[rows] < end[rows])
        return found


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple]] = {PARENT: [], DELETED: []}
    index: dict[int, _Sorted] = {}
    schema = pa.schema(
        [("table_name", pa.string()), ("record_id", pa.string()), ("ref_field", pa.string()), ("received_at", pa.timestamp("us")), ("ref_state", pa.string())]
    )
    for whole in batches:
        kinds = whole.column("kind").to_numpy()
        for kind in np.unique(kinds):
            batch = whole.filter(pa.array(kinds == kind)) if (kinds != kind).any() else whole
            hi, lo = _words(batch.column("digest"))
            target = batch.column("target").to_numpy()
            stamp = batch.column("received_at").cast(pa.int64())
            known = stamp.is_valid().to_numpy(zero_copy_only=False)
            when = stamp.fill_null(0).to_numpy()
            if kind != REFERENCE:
                held[int(kind)].append((hi, lo, target, np.where(known, when, np.iinfo(np.int64).min)))
                continue
            if not index:
                empty = (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int64))
                for k, parts in held.items():
                    index[k] = _Sorted(*(np.concatenate(x) for x in zip(*parts or [empty], strict=True)))
                held.clear()
            at = index[PARENT].find(hi, lo, target)
            there = at >= 0
            late = np.zeros(len(at), bool)
            late[there] = index[PARENT].seen[at[there]] > when[there]
            late &= known
            gone = ~there & (index[DELETED].find(hi, lo, target) >= 0)
            pick = ~there | late
            if not pick.any():
                continue
            state = np.where(late, "late", np.where(gone, "deleted", "missing"))[pick]
            out = batch.filter(pa.array(pick))
            yield pa.RecordBatch.from_arrays(
                [out.column("table_name"), out.column("record_id"), out.column("ref_field"), out.column("received_at").cast(pa.timestamp("us")), pa.array(state, pa.string())],
                schema=schema,
            )


def orphan_references(
    references: DataFrame, parents: DataFrame, deleted: DataFrame, ranges: int | None = None, hot_factor: float = 2.0, parent_rows: int | None = None
) -> DataFrame:
    """References whose key has no parent, a deleted parent, or a parent first received later than the record.

    references: target int, table_name, record_id, ref_field, key string, received_at. parents: target, key, received_at.
    deleted: target, key. `target` numbers the (table, column) pointed to. One row per distinct miss. The number of ranges
    follows the parents (`parent_rows`, where the caller knows them), so that a range's sorted arrays stay within RANGE_ROWS
    keys (28 bytes each) in a task's memory.
    """
    n = ranges or max(8, shuffle_width(references), -(-(parents.count() if parent_rows is None else parent_rows) // RANGE_ROWS))
    digest = digest16(F.col("key"))
    at = F.pmod(F.conv(F.hex(F.substring(F.col("digest"), 1, 4)), 16, 10).cast("long") * F.lit(n) / F.lit(2**32), F.lit(n)).cast("int")
    none = lambda t: F.lit(None).cast(t)

    parents = parents.where("key is not null").groupBy("target", "key").agg(F.min("received_at").alias("received_at"))
    deleted = deleted.where("key is not null").select("target", "key").distinct()
    built = (
        parents.select(F.lit(PARENT).alias("kind"), "target", "key", "received_at")
        .unionByName(deleted.select(F.lit(DELETED).alias("kind"), "target", "key", none("timestamp_ntz").alias("received_at")))
        .select("kind", "target", digest.alias("digest"), "received_at", none("string").alias("table_name"), none("string").alias("record_id"), none("string").alias("ref_field"))
        .withColumn("slot", at)
    )
    refs = (
        references.where("key is not null")
        .select(F.lit(REFERENCE).alias("kind"), "target", digest.alias("digest"), "received_at", "table_name", "record_id", "ref_field")
        .withColumn("slot", at)
    )

    # One small row per range: how many tasks share it.
    counts = {r["slot"]: r["n"] for r in refs.groupBy("slot").agg(F.count("*").alias("n")).collect()}
    mean = max(1.0, sum(counts.values()) / n)
    copies = [max(1, round(counts.get(i, 0) / mean)) if counts.get(i, 0) > hot_factor * mean else 1 for i in range(n)]
    # Only ranges that are split stand in the plan; the others keep their number, copies follow all of them.
    split = {i: c for i, c in enumerate(copies) if c > 1}
    beyond = n + np.concatenate([[0], np.cumsum([c - 1 for c in split.values()])])
    width, base = F.lit(1), F.lit(0)
    for (i, c), b in zip(split.items(), beyond.tolist(), strict=False):
        width, base = F.when(F.col("slot") == i, c).otherwise(width), F.when(F.col("slot") == i, b).otherwise(base)
    task = lambda k: F.when(k == 0, F.col("slot")).otherwise(base + k - 1).cast("int")
    built = built.select("*", F.explode(F.transform(F.sequence(F.lit(0), width - 1), task)).alias("task")).drop("slot")
    refs = refs.select("*", task(F.pmod(F.xxhash64("table_name", "record_id"), width)).alias("task")).drop("slot")
    return (
        built.unionByName(refs)
        .repartitionById(int(beyond[-1]), F.col("task"))
        .sortWithinPartitions("kind")
        .mapInArrow(_probe, MISSES)
        .dropDuplicates()
    )


#: Tables and columns that references point to.
TARGETS = {("telemetry_events", "event_id"): 0, ("web_details", "conversion_id"): 1, ("telemetry_events", "telemetry_id"): 2}


def telemetry_orphans(telemetry: DataFrame, web: DataFrame, install: DataFrame, uploads: DataFrame, deleted: DataFrame) -> DataFrame:
    """Orphans among the references of web, install and upload records to events, clicks and installations."""

    def keyed(df: DataFrame, *columns: tuple[int, str, str, str]) -> DataFrame:
        """One row per reference: (target, table name, own id, reference field)."""
        made = F.array(
            *(
                F.struct(F.lit(t).alias("target"), F.lit(name).alias("table_name"), F.col(own).alias("record_id"), F.lit(ref).alias("ref_field"), uuid_key(F.col(ref)).alias("key"))
                for t, name, own, ref in columns
            )
        )
        return df.select("received_at", F.inline(made))

    refs = (
        keyed(web, (0, "web_details", "event_id", "event_id"))
        .unionByName(keyed(install, (0, "install_details", "event_id", "event_id"), (1, "install_details", "event_id", "conversion_id")))
        .unionByName(keyed(uploads, (2, "transcript_uploads", "upload_id", "telemetry_id")))
    )
    key = lambda t, c: F.struct(F.lit(t).alias("target"), uuid_key(F.col(c)).alias("key"))
    parents = telemetry.select("received_at", F.inline(F.array(key(0, "event_id"), key(2, "telemetry_id")))).unionByName(
        web.select("received_at", F.inline(F.array(key(1, "conversion_id"))))
    )
    which = F.coalesce(*(F.when((F.col("table_name") == t) & (F.col("key_column") == c), F.lit(n)) for (t, c), n in TARGETS.items()))
    gone = deleted.select(which.alias("target"), uuid_key(F.col("key_value")).alias("key")).where("target is not null")
    # Row counts stand in the Parquet footers.
    return orphan_references(refs, parents, gone, parent_rows=2 * telemetry.count() + web.count())
