"""One feature row per entity from an event log: count and last time per event type, and totals.

Resent events (one event id) count once: the row stored first is kept. Rows are then folded where they lie: each task
encodes (entity, type) as one index and fills dense blocks by numpy bincount and maximum scatter; a full block leaves as
its non-zero cells, so a hot entity costs one cell per type and task however many events it has. Cells are hash-bucketed
by entity, sorted there, folded again into dense blocks and written as Arrow columns, a pair for each event type.

Nulls: a null or blank event id is nobody's resend; null measures add nothing; a null time gives no last time; rows with
a null type count in the totals only; rows of a null entity form an entity of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEVER = np.iinfo(np.int64).min
#: Cells of a dense block: entities times types.
BLOCK_CELLS = 1 << 21


def first_stored(df: DataFrame, event_id: str = "event_id", stored: str = "received_at", row_id: str = "id") -> DataFrame:
    """One row per event id, the one stored first; rows without an id all stay."""
    blank = F.coalesce(F.trim(F.col(event_id)), F.lit("")) == ""
    own = F.when(blank, F.concat(F.lit("row:"), F.col(row_id).cast("string"))).otherwise(F.col(event_id))
    order = Window.partitionBy("__event").orderBy(F.col(stored).asc_nulls_last(), F.col(row_id))
    return df.withColumn("__event", own).withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__event", "__nth")


class _Block:
    """Dense count and last-time cells of a bounded number of entities."""

    def __init__(self, types: int, totals: int) -> None:
        self.types, self.room = types, max(1, BLOCK_CELLS // types)
        self.codes: dict = {}
        self.count = np.zeros(self.room * types, np.int64)
        self.last = np.full(self.room * types, NEVER, np.int64)
        self.totals = [np.zeros(self.room, np.int64) for _ in range(totals)]

    def encode(self, entities: pa.Array) -> tuple[np.ndarray, int]:
        """Codes of the leading entities that fit, and how many rows they cover."""
        if isinstance(entities, pa.ChunkedArray):
            entities = entities.combine_chunks()
        own = entities.dictionary_encode(null_encoding="encode")
        lookup, fits = np.empty(len(own.dictionary), np.int64), len(entities)
        at = own.indices.to_numpy()
        for i, e in enumerate(own.dictionary.to_pylist()):
            if e not in self.codes and len(self.codes) >= self.room:
                fits = int(np.argmax(at == i))  # a dictionary is in order of appearance
                break
            lookup[i] = self.codes.setdefault(e, len(self.codes))
        return lookup[at[:fits]], fits

    def add(self, who: np.ndarray, what: np.ndarray, count: np.ndarray | None, last: np.ndarray, totals: list[np.ndarray]) -> None:
        typed = what >= 0
        cell = who[typed] * self.types + what[typed]
        if len(cell):
            low, high = cell.min(), cell.max() + 1
            self.count[low:high] += np.bincount(cell - low, None if count is None else count[typed], high - low).astype(np.int64)
            np.maximum.at(self.last, cell, last[typed])
        for sums, values in zip(self.totals, totals, strict=True):
            # Integer scatter: bincount weights are doubles and round beyond 2^53.
            np.add.at(sums, who, values)

    def clear(self) -> None:
        self.codes = {}
        self.count[:] = 0
        self.last[:] = NEVER
        for x in self.totals:
            x[:] = 0


def _ints(batch: pa.RecordBatch, name: str, fill: int = 0) -> np.ndarray:
    return pc.fill_null(batch.column(name).cast(pa.int64()), fill).to_numpy(zero_copy_only=False)


def _cells(batches: Iterator[pa.RecordBatch], types: list[str], totals: list[str]) -> Iterator[pa.RecordBatch]:
    """Events to the non-zero cells of this task; an entity's totals stand on a cell of type -1."""
    block, vocabulary = _Block(len(types), len(totals)), pa.array(types, pa.string())

    def flush() -> Iterator[pa.RecordBatch]:
        names = np.array(list(block.codes), dtype=object)
        used = np.flatnonzero(block.count[: len(names) * block.types])
        n, zero = len(names), np.zeros(len(names), np.int64)
        who = np.concatenate([used // block.types, np.arange(n)])
        last = np.concatenate([block.last[used], np.full(n, NEVER)])
        fields = {
            "entity": pa.array(names[who], pa.string()),
            "what": pa.array(np.concatenate([used % block.types, np.full(n, -1)]), pa.int32()),
            "n": pa.array(np.concatenate([block.count[used], zero])),
            "last": pa.array(last),
        } | {f"t{k}": pa.array(np.concatenate([np.zeros(len(used), np.int64), x[:n]])) for k, x in enumerate(block.totals)}
        yield from pa.table(fields).to_batches(max_chunksize=50_000)
        block.clear()

    for batch in batches:
        what = pc.fill_null(pc.index_in(batch.column("type"), vocabulary), -1).to_numpy(zero_copy_only=False)
        last, sums, done = _ints(batch, "at", NEVER), [_ints(batch, f"t{k}") for k in range(len(totals))], 0
        while done < batch.num_rows:
            who, fits = block.encode(batch.column("entity").slice(done))
            to = slice(done, done + fits)
            block.add(who, what[to], None, last[to], [x[to] for x in sums])
            done += fits
            if done < batch.num_rows:
                yield from flush()
    if block.codes:
        yield from flush()


def _columns(batches: Iterator[pa.RecordBatch], types: int, totals: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Cells sorted by entity to feature rows."""
    block = _Block(types, totals)
    rows = max(1, min(2048, block.room - 1))
    block.room = rows + 1

    def flush(keep_last: bool) -> Iterator[pa.RecordBatch]:
        """All entities, or all but the one that may go on in the next batch."""
        names = list(block.codes)
        n = len(names) - keep_last
        if n > 0:
            count, last = block.count[: n * types].reshape(n, types), block.last[: n * types].reshape(n, types)
            cells = []
            for k in range(types):
                at = np.ascontiguousarray(last[:, k])
                cells += [pa.array(np.ascontiguousarray(count[:, k])), pa.array(at, pa.int64(), mask=at == NEVER).cast(pa.timestamp("us"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[:n], pa.string()), pa.array(count.sum(axis=1)), *(pa.array(x[:n].copy()) for x in block.totals), *cells], schema=schema
            )
        if keep_last and names:
            end = slice(n * types, (n + 1) * types)
            kept = names[n], block.count[end].copy(), block.last[end].copy(), [int(x[n]) for x in block.totals]
            block.clear()
            block.codes[kept[0]] = 0
            block.count[:types], block.last[:types] = kept[1], kept[2]
            for x, v in zip(block.totals, kept[3], strict=True):
                x[0] = v
        else:
            block.clear()

    for batch in batches:
        what, n, last = _ints(batch, "what"), _ints(batch, "n"), _ints(batch, "last")
        sums, done = [_ints(batch, f"t{k}") for k in range(totals)], 0
        while done < batch.num_rows:
            who, fits = block.encode(batch.column("entity").slice(done))
            to = slice(done, done + fits)
            block.add(who, what[to], n[to], last[to], [x[to] for x in sums])
            done += fits
            if len(block.codes) >= rows:
                yield from flush(True)
    yield from flush(False)


def event_types(events: DataFrame, event_type: str, max_types: int = 5000) -> list[str]:
    """All event types, sorted; more than `max_types` raise, as columns of a table can't grow with the data."""
    types = sorted(r[0] for r in events.select(F.col(event_type)).where(F.col(event_type).isNotNull()).distinct().limit(max_types + 1).collect())
    if len(types) > max_types:
        raise ValueError(f"more than {max_types} event types")
    return types


def entity_features(
    events: DataFrame, entity: str, event_type: str, at: str, totals: list[str], types: list[str] | None = None, buckets: int | None = None
) -> DataFrame:
    """One row per entity: `<type>_events` and `<type>_last` for each type, `events`, and `<total>_total` for each of `totals`.

    `events` must already be free of resends (`first_stored`). Types are taken from the data unless given.
    """
    if types is None:
        types = event_types(events, event_type)
    shown, types = types, types or [""]
    sums = [F.col(c).cast("long").alias(f"t{k}") for k, c in enumerate(totals)]
    rows = events.select(F.col(entity).cast("string").alias("entity"), F.col(event_type).alias("type"), F.col(at).cast("timestamp_ntz").alias("at"), *sums)
    cells = rows.mapInArrow(
        partial(_cells, types=types, totals=totals), "entity string, what int, n long, last long" + "".join(f", t{k} long" for k in range(len(totals)))
    )
    head = [(entity, T.StringType()), ("events", T.LongType()), *((f"{c}_total", T.LongType()) for c in totals)]
    pairs = [x for t in types for x in ((f"{t}_events", T.LongType()), (f"{t}_last", T.TimestampNTZType()))]
    spark_schema = T.StructType([T.StructField(n, t) for n, t in head + pairs])
    kinds = {T.StringType: pa.string(), T.LongType: pa.int64(), T.TimestampNTZType: pa.timestamp("us")}
    arrow_schema = pa.schema([(f.name, kinds[type(f.dataType)]) for f in spark_schema])
    spread = cells.repartition(buckets, "entity") if buckets else cells.repartition("entity")
    out = spread.sortWithinPartitions("entity").mapInArrow(partial(_columns, types=len(types), totals=len(totals), schema=arrow_schema), spark_schema)
    return out if shown else out.select(*(n for n, _ in head))
