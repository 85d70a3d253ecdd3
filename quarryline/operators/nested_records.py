"""Deeply nested JSON records to related flat tables, by Merkle identities of their subtrees.

Every record is parsed once. Objects are canonicalised and hashed bottom-up: an object's identity is the digest of its own
scalars and its children's identities, so equal objects have one identity wherever they stand. `occurrences` is the
bridge: a row per object occurrence with its parent, its position and both paths. `nodes` stores each distinct object once.

JSON kept as text inside a value is read as if it weren't quoted. An object in a field that in other records holds an
array of objects is element [0] of a one-element array; which fields those are is found in a first pass over all records.
Array elements that aren't objects take a position but no row of their own; empty, null and missing parts give no rows.
Unreadable records (no JSON object: cut off, blank, null, other text) give no occurrences; `samples` keeps them, marked.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OCCURRENCE = (
    "record_id long, parent_path string, child_path string, holder_path string, field string, ordinal int, depth int, in_array boolean, node_id string, parent_node_id string"
)
#: More array fields than this and they are joined per record instead of being sent to the tasks.
MAX_SENT_PATHS = 20_000
CHUNK = 20_000
POSITION = re.compile(r"\[\d+\]")
#: The walk goes as deep as a record does.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))


def unquoted(value):
    """JSON text inside values replaced by what it says, to any depth."""
    if isinstance(value, str):
        bare = value.strip()
        if bare[:1] in ("{", "[") and bare[-1:] in ("}", "]"):
            try:
                inner = json.loads(bare)
            except (ValueError, RecursionError):
                return value
            return unquoted(inner)
        return value
    if isinstance(value, dict):
        return {k: unquoted(v) for k, v in value.items()}
    if isinstance(value, list):
        return [unquoted(v) for v in value]
    return value


def readable(raw: str | None) -> dict | None:
    """The record, or None if it isn't a JSON object."""
    try:
        value = json.loads(raw.lstrip("﻿")) if raw else None
        for _ in range(3):
            if not isinstance(value, str):
                break
            value = json.loads(value)
        return unquoted(value) if isinstance(value, dict) else None
    except (ValueError, RecursionError):
        return None


def _array_fields(value, path: str, into: set[str]) -> None:
    """Key paths (positions left out) that hold an array with an object in it."""
    if isinstance(value, dict):
        for k, v in value.items():
            at = f"{path}.{k}" if path else k
            if isinstance(v, list) and any(isinstance(x, dict) for x in v):
                into.add(at)
            _array_fields(v, at, into)
    elif isinstance(value, list):
        for v in value:
            _array_fields(v, path, into)


def _object_fields(value, path: str, into: set[str]) -> None:
    """Key paths that hold an object outside an array."""
    if isinstance(value, dict):
        for k, v in value.items():
            at = f"{path}.{k}" if path else k
            if isinstance(v, dict):
                into.add(at)
            _object_fields(v, at, into)
    elif isinstance(value, list):
        for v in value:
            _object_fields(v, path, into)


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _scalar(value):
    """Equal numbers have one form: 2.0 is 2."""
    return int(value) if isinstance(value, float) and value.is_integer() and abs(value) < 2**53 else value


def decompose(record: dict, arrays: set[str]) -> tuple[list[tuple], dict[str, str]]:
    """Occurrence rows (without the record's id) and {identity: canonical form} of all objects of a record."""
    rows: list[list] = []
    nodes: dict[str, str] = {}

    def visit(value, path: str, keys: str, case: str, holder: str, field: str, ordinal: int, depth: int, in_array: bool, above: list[int]):
        """The canonical form of `value`: scalars as they are, objects as {"#": identity}."""
        if isinstance(value, dict):
            at = len(rows)
            rows.append([case, path, holder, field, ordinal, depth, in_array, None, above[-1] if above else -1])
            own = path if in_array else case
            form = {}
            for k in value:
                v, p = value[k], f"{path}.{k}" if path else k
                q = f"{keys}.{k}" if keys else k
                if isinstance(v, dict) and q in arrays:
                    v = [v]
                form[k] = visit(v, p, q, own, path, k, -1, depth + 1, False, [*above, at])
            canonical = json.dumps(form, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
            node = _digest(canonical)
            nodes[node] = canonical
            rows[at][7] = node
            return {"#": node}
        if isinstance(value, list):
            return [visit(v, f"{path}[{i}]", keys, case, holder, field, i, depth, True, above) for i, v in enumerate(value)]
        return _scalar(value)

    visit(record, "", "", "", "", "", -1, 0, False, [])
    return [(*r[:8], rows[r[8]][7] if r[8] >= 0 else None) for r in rows], nodes


def _find_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: set[str] = set()
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            if (record := readable(raw)) is not None:
                _array_fields(record, "", found)
    yield pa.RecordBatch.from_pydict({"path": pa.array(sorted(found), pa.string())})


def _objects_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, paths = [], []
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (record := readable(raw)) is not None:
                found: set[str] = set()
                _object_fields(record, "", found)
                ids += [key] * len(found)
                paths += found
        yield pa.RecordBatch.from_pydict({"record_id": pa.array(ids, pa.int64()), "path": pa.array(paths, pa.string())})


OBJECT = "record_id long, parent_path string, child_path string, ordinal int, node_id string, parent_node_id string, body string"
NODE = "node_id string, body string"


def _walk(batches: Iterator[pa.RecordBatch], sent: frozenset[str] | None, what: str) -> Iterator[pa.RecordBatch]:
    """Occurrences, distinct nodes, or (any other `what`) the objects at that path, array positions left out."""
    names = [f.split()[0] for f in {"occurrences": OCCURRENCE, "nodes": NODE}.get(what, OBJECT).split(", ")]
    types = {"record_id": pa.int64(), "ordinal": pa.int32(), "depth": pa.int32(), "in_array": pa.bool_()}
    schema = pa.schema([(n, types.get(n, pa.string())) for n in names])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, schema.field(i).type) for i, c in enumerate(columns)], schema=schema)

    rows: list[tuple] = []
    seen: set[str] = set()
    for batch in batches:
        wrapped = batch.column(2).to_pylist() if sent is None else None
        for i, (key, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            record = readable(raw)
            if record is None:
                continue
            found, nodes = decompose(record, sent if wrapped is None else frozenset(wrapped[i] or ()))
            if what == "occurrences":
                rows += [(key, r[0], r[1], *r[2:]) for r in found]
            elif what != "nodes":
                rows += [(key, r[0], r[1], r[4], r[7], r[8], nodes[r[7]]) for r in found if POSITION.sub("", r[1]) == what]
            else:
                rows += [(k, v) for k, v in nodes.items() if k not in seen]
                seen.update(nodes)
                if len(seen) > 200_000:
                    seen.clear()
            if len(rows) >= CHUNK:
                yield out(rows)
                rows = []
    yield out(rows)


def _records(df: DataFrame, record_id: str, raw: str) -> tuple[DataFrame, frozenset[str] | None]:
    own = df.select(F.col(record_id).cast("long").alias("record_id"), F.col(raw).alias("raw"))
    arrays = own.select("raw").mapInArrow(_find_arrays, "path string").distinct()
    few = [r[0] for r in arrays.limit(MAX_SENT_PATHS + 1).collect()]
    if len(few) <= MAX_SENT_PATHS:
        return own, frozenset(few)
    wrapped = own.mapInArrow(_objects_of, "record_id long, path string").join(arrays, "path").groupBy("record_id").agg(F.collect_set("path").alias("wrapped"))
    return own.join(wrapped, "record_id", "left"), None


def occurrences(df: DataFrame, record_id: str, raw: str) -> DataFrame:
    """The bridge: a row per object occurrence, the record itself at path ''.

    `child_path` and `parent_path` follow arrays: the parent of an object is the nearest array element around it (or '').
    `holder_path` is the object directly around it, `ordinal` its position in its array (-1: none).
    """
    own, sent = _records(df, record_id, raw)
    return own.mapInArrow(partial(_walk, sent=sent, what="occurrences"), OCCURRENCE)


def nodes(df: DataFrame, record_id: str, raw: str) -> DataFrame:
    """Each distinct object once: its identity and its canonical form, nested objects given as {"#": identity}."""
    own, sent = _records(df, record_id, raw)
    return own.mapInArrow(partial(_walk, sent=sent, what="nodes"), "node_id string, body string").groupBy("node_id").agg(F.min("body").alias("body"))


def flat_table(df: DataFrame, record_id: str, raw: str, path: str, columns: dict[str, str]) -> DataFrame:
    """A typed table of the objects at a path (array positions left out), one row per occurrence, in one pass.

    record_id, parent_path (of the nearest array element around it), child_path, ordinal (-1: not in an array), node_id and
    parent_node_id (the identities of the object and of the one directly around it), and the columns: name to kind (long,
    boolean, string). Numbers may stand as text; what isn't of the kind gives null.
    """
    own, sent = _records(df, record_id, raw)
    rows = own.mapInArrow(partial(_walk, sent=sent, what=path), OBJECT)
    field = lambda n: F.get_json_object("body", f"$['{n}']")
    typed = {"long": lambda c: F.round(c.try_cast("double")).cast("long"), "boolean": lambda c: F.lower(c).try_cast("boolean"), "string": lambda c: c}
    return rows.select("record_id", "parent_path", "child_path", "ordinal", "node_id", "parent_node_id", *(typed[k](field(n)).alias(n) for n, k in columns.items()))


def array_cases(df: DataFrame, record_id: str, raw: str) -> DataFrame:
    """Objects that are elements of arrays, each with the path of the nearest such object around it."""
    return occurrences(df, record_id, raw).where("in_array").select(F.col("record_id").alias(record_id), "parent_path", "child_path")


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def number(record, *path):
        for k in path:
            record = record.get(k) if isinstance(record, dict) else None
        try:
            return None if record is None or isinstance(record, bool) else round(float(record))
        except (TypeError, ValueError, OverflowError):
            return None

    for batch in batches:
        rows = []
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            r = readable(raw)
            rows.append(
                (
                    key,
                    r is not None,
                    number(r, "timestamp_ms"),
                    r.get("source") if r and isinstance(r.get("source"), str) else None,
                    r.get("kind") if r and isinstance(r.get("kind"), str) else None,
                    number(r, "process", "rss_bytes"),
                    number(r, "process", "os", "pss_bytes"),
                    number(r, "process", "allocator", "stats", "allocated_bytes"),
                    number(r, "sessions", "live_count"),
                    number(r, "totals", "total_attributed_bytes"),
                )
            )
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5]
        names = "record_id readable timestamp_ms source kind rss_bytes pss_bytes allocated_bytes live_sessions attributed_bytes".split()
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def samples(df: DataFrame, record_id: str, raw: str) -> DataFrame:
    """One row per record with its leading figures; unreadable ones with nulls and `readable` false."""
    kinds = "record_id long, readable boolean, timestamp_ms long, source string, kind string, rss_bytes long, pss_bytes long, allocated_bytes long, live_sessions long, attributed_bytes long"
    return df.select(F.col(record_id).cast("long").alias("record_id"), F.col(raw).alias("raw")).mapInArrow(_samples, kinds)
