"""Schemas that drift between files: every change reported, every file read into one table.

Each file's schema is a tree of keys, every node with its type. Neighbouring files of a feed are compared as unordered trees
and the least-cost edit script is found: a path on both sides costs nothing (or a retype); of what is left, nodes are
paired across the trees by an exact assignment, where a rename or a move costs the dissimilarity of two subtrees and an
addition or a removal a constant, so unlike fields are rather removed and added. The dissimilarity of two objects is their
tree edit distance: their children are again assigned exactly, and so on down to fields, which are compared by what they
hold. The script's renames compile into a projection per file, applied to its rows.

A first pass reads only paths and types of every row and packs them to one row per file (`trees`), with a digest: files
with the digest of the one before are done. Of the others, fields that only one of the two has get a second pass: counts of
every value of every row (of arrays: of each item), values known by hash, shape and number. Counts add up, so any
partitioning gives the same; fields that stay where they are send no content anywhere.

Unreadable lines, lines that aren't objects, nulls and repeated lines change nothing. A file without a readable object
is no file. Empty tables give no rows.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cached_property, lru_cache, partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.common import cut

TYPES = ("string", "number", "boolean", "array", "object")
#: Counted values that a task holds at most before it hands them on.
HELD = 200_000
#: Wanted paths that are sent to all tasks at most (some 20 MB).
SENT = 200_000
#: Cost of an addition plus a removal; a rename must be cheaper.
ADD_AND_REMOVE = 0.46
#: A file's fields: path, and how often each of TYPES occurs there.
NODES = "array<struct<path:string,n:array<long>>>"
OUTLINE = f"feed string, stream string, file_no int, nodes {NODES}"
TREE = f"feed string, stream string, file_no int, digest long, nodes {NODES}"
FIELD = "struct<path:string,held:array<struct<item:boolean,h:long,shape:long,digit:boolean,x:double,n:long>>,places:array<struct<at:double,n:long>>>"
CONTENT = f"feed string, file_no int, fields array<{FIELD}>"


def type_name(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def parse(body: str | None) -> dict | None:
    try:
        value = json.loads(body) if body else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _fields(value: dict, path: str = "") -> Iterator[tuple[str, object, float]]:
    """(path, value, relative position among its siblings), depth first; nulls don't occur."""
    n = max(1, len(value) - 1)
    for i, (k, v) in enumerate(value.items()):
        if v is None:
            continue
        at = f"{path}.{k}" if path else k
        yield at, v, i / n
        if isinstance(v, dict):
            yield from _fields(v, at)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


@lru_cache(100_000)
def _about(text: str) -> tuple[int, int, bool, float | None]:
    """Hash, hash of the shape, whether it has a digit, and the number of a value."""
    return _hash(text), _hash(_shape(text)), re.search(r"\d", text) is not None, _number(text)


def _texts(value) -> Iterator[tuple[bool, str]]:
    """What is counted of a value: itself, or an array's items; an object is its fields."""
    if isinstance(value, list):
        for i in value:
            yield True, json.dumps(i, sort_keys=True) if not isinstance(i, dict) else "{" + ",".join(sorted(i)) + "}"
    elif not isinstance(value, dict):
        yield False, value if isinstance(value, str) else json.dumps(value)


_NODES = pa.list_(pa.struct([("path", pa.string()), ("n", pa.list_(pa.int64()))]))


def _packed(files: dict[tuple, dict[str, list[int]]]) -> pa.RecordBatch:
    rows = [(*key, [{"path": p, "n": n} for p, n in nodes.items()]) for key, nodes in files.items()]
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    types = [pa.string(), pa.string(), pa.int32(), _NODES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["feed", "stream", "file_no", "nodes"])


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fields of each file in this task, how often each type occurs there."""
    files: dict[tuple, dict[str, list[int]]] = {}
    size = 0
    for batch in batches:
        for feed, stream, file_no, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            record = parse(body)
            if record is None:
                continue
            nodes = files.setdefault((feed, stream, file_no), {})
            before = len(nodes)
            for path, value, _ in _fields(record):
                nodes.setdefault(path, [0] * 5)[TYPES.index(type_name(value))] += 1
            size += len(nodes) - before
            if size > HELD:
                yield _packed(files)
                files, size = {}, 0
    yield _packed(files)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each file's parts as one tree with the digest of its paths and types."""
    for batch in batches:
        files, digests = {}, []
        for first in range(batch.num_rows):
            r = batch.slice(first, 1).to_pylist()[0]
            nodes: dict[str, list[int]] = {}
            for x in r["nodes"]:
                nodes[x["path"]] = [a + b for a, b in zip(nodes.get(x["path"], [0] * 5), x["n"], strict=True)]
            files[r["feed"], r["stream"], r["file_no"]] = nodes
            digests.append(_hash(json.dumps(sorted((p, n.index(max(n))) for p, n in nodes.items()))))
        out = _packed(files)
        yield pa.RecordBatch.from_arrays([*out.columns[:3], pa.array(digests, pa.int64()), out.columns[3]], names=["feed", "stream", "file_no", "digest", "nodes"])


def trees(raw: DataFrame) -> DataFrame:
    """One row per file: its stream, the digest of its paths and types, and its fields with the counts of their types."""
    parts = raw.select("feed", "stream", F.col("file_no").cast("int").alias("file_no"), "body").mapInArrow(_outline, OUTLINE)
    whole = parts.groupBy("feed", "file_no").agg(F.max("stream").alias("stream"), F.flatten(F.collect_list("nodes")).alias("nodes"))
    return whole.select("feed", "stream", "file_no", "nodes").mapInArrow(_merged, TREE)


def outline(raw: DataFrame) -> DataFrame:
    """feed, file_no, path, stream and how often each type occurs there."""
    rows = trees(raw).select("feed", "file_no", "stream", F.inline("nodes"))
    return rows.select("feed", "file_no", "path", "stream", *(F.col("n")[i].alias(f"n_{t}") for i, t in enumerate(TYPES)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the wanted paths of each row's file hold: counts of values and of places among the siblings."""
    files: dict[tuple, dict[str, tuple[Counter, Counter]]] = {}
    held = pa.struct([("item", pa.bool_()), ("h", pa.int64()), ("shape", pa.int64()), ("digit", pa.bool_()), ("x", pa.float64()), ("n", pa.int64())])
    fields = pa.list_(pa.struct([("path", pa.string()), ("held", pa.list_(held)), ("places", pa.list_(pa.struct([("at", pa.float64()), ("n", pa.int64())])))]))

    def flush() -> pa.RecordBatch:
        rows = []
        for key, paths in files.items():
            packed = [
                {"path": p, "held": [{"item": item, "h": h, "shape": shape, "digit": digit, "x": x, "n": n} for (item, (h, shape, digit, x)), n in values.items()], "places": [{"at": a, "n": n} for a, n in at.items()]}
                for p, (values, at) in paths.items()
            ]
            rows.append((*key, packed))
        files.clear()
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), fields), strict=True)], names=["feed", "file_no", "fields"])

    size = 0
    for batch in batches:
        for feed, file_no, body, paths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            record, wanted = parse(body), set(paths)
            if record is None:
                continue
            nodes = files.setdefault((feed, file_no), {})
            for path, value, at in _fields(record):
                if path not in wanted:
                    continue
                values, places = nodes.setdefault(path, (Counter(), Counter()))
                before = len(values)
                for item, text in _texts(value):
                    values[item, _about(text)] += 1
                places[at] += 1
                size += 1 + len(values) - before
            if size > HELD:
                yield flush()
                size = 0
    yield flush()


def contents(raw: DataFrame, wanted: DataFrame) -> DataFrame:
    """feed, file_no, fields: what the wanted paths (feed, file_no, path) hold, in as many parts as tasks saw of a file.

    The wanted paths of a file are one row; up to SENT paths are sent to all tasks, so that no row of the table moves, more
    are joined by file.
    """
    per = wanted.groupBy("feed", "file_no").agg(F.collect_set("path").alias("paths"))
    if wanted.count() <= SENT:
        per = F.broadcast(per)
    own = raw.select("feed", F.col("file_no").cast("int").alias("file_no"), "body").join(per, ["feed", "file_no"]).select("feed", "file_no", "body", "paths")
    return own.mapInArrow(_counts, CONTENT).groupBy("feed", "file_no").agg(F.flatten(F.collect_list("fields")).alias("fields"))


class Content:
    """Counts of the values of a field, or of the items of its arrays."""

    def __init__(self, rows: list[dict]) -> None:
        self.values, self.shapes, self.numbers = Counter(), Counter(), Counter()
        self.digits: set[int] = set()
        for r in rows:
            self.values[r["h"]] += r["n"]
            self.shapes[r["shape"]] += r["n"]
            if r["x"] is not None:
                self.numbers[r["x"]] += r["n"]
            if r["digit"]:
                self.digits.add(r["h"])
        self.n = sum(self.values.values())
        self.numeric = sum(self.numbers.values()) == self.n
        self.few = len(self.values) <= 0.7 * self.n


def _median(counts: Counter) -> float:
    """The median of all counted values."""
    n, seen, low = sum(counts.values()), 0, None
    for x in sorted(counts):
        seen += counts[x]
        if low is None and 2 * seen >= n:
            low = x
        if 2 * seen > n:
            return (low + x) / 2
    return 0.0


class Node:
    """A field of one file's schema."""

    def __init__(self, path: str, counts: list[int]) -> None:
        self.path = path
        self.parent, _, self.name = path.rpartition(".")
        self.n = sum(counts)
        self.type = TYPES[counts.index(max(counts))]
        self.held: list[dict] = []
        self.places: Counter = Counter()

    def add(self, field: dict) -> None:
        """What a part of the rows holds there."""
        self.held += field["held"]
        for x in field["places"]:
            self.places[x["at"]] += x["n"]

    @cached_property
    def at(self) -> float:
        return _median(self.places)

    @cached_property
    def content(self) -> Content:
        return Content([x for x in self.held if x["item"] == (self.type == "array")])


def _shape(text: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", re.sub(r"[a-f0-9]{4,}", "x", re.sub(r"[^\W\d_]", "a", re.sub(r"[a-f0-9]*\d[a-f0-9]*", lambda m: "0" * len(m.group()), text.lower()))))


def _overlap(a: Counter, b: Counter) -> float:
    """Shared probability of two value distributions."""
    n, m = sum(a.values()) or 1, sum(b.values()) or 1
    return sum(min(a[k] / n, b[k] / m) for k in a.keys() & b.keys())


def _strings(a: Content, b: Content) -> float:
    same = _overlap(a.values, b.values)
    few = a.few and b.few
    union = a.values.keys() | b.values.keys()
    shared = len(a.values.keys() & b.values.keys()) / max(1, min(len(a.values), len(b.values)))
    shape = _overlap(a.shapes, b.shapes)
    digits = bool(a.digits or b.digits)
    if shared == 0 and few and len(union) <= 12 and not digits:
        return 0.15 * shape  # two closed vocabularies without a word in common
    return max(shape if not few or digits else 0.3 * shape, min(1.0, 0.35 + same * 0.9) if same else 0, shared * 0.9)


def _numbers(a: Counter, b: Counter) -> float:
    """Closeness of level and of spread, on a log scale."""
    level = [math.log10(1 + abs(_median(x))) for x in (a, b)]
    spread = [math.log10(1 + max(x) - min(x)) for x in (a, b)]
    flat = [len(x) == 1 for x in (a, b)]
    gap = abs(level[0] - level[1]) + 0.5 * abs(spread[0] - spread[1]) + 0.4 * (flat[0] != flat[1])
    return max(0.0, 1 - gap)


def _number(text: str) -> float | None:
    try:
        return x if math.isfinite(x := float(text)) else None
    except ValueError:
        return None


def content(a: Node, b: Node, trees: tuple[dict, dict]) -> float:
    """0 to 1: how alike what two fields hold is."""
    if a.type != b.type:
        return 0.0
    if a.type == "object":
        return 1 - tree_distance(a, b, trees)
    if a.type == "boolean":
        return 0.55
    x, y = a.content, b.content
    if not x.n or not y.n:
        return 0.3
    if a.type == "number" or x.numeric and y.numeric:
        return _numbers(x.numbers, y.numbers) if x.numbers and y.numbers else 0.3
    return _strings(x, y)


def children(node: Node, tree: dict[str, Node]) -> dict[str, Node]:
    return {n.name: n for n in tree.values() if n.parent == node.path}


def tree_distance(a: Node, b: Node, trees: tuple[dict, dict]) -> float:
    """Edit distance of two objects' subtrees, as a share of dropping one and building the other (0 to 1).

    Children are matched at least total cost: those of one name stand for each other, others may be renamed (at half the
    gain), and what is left is dropped or added; a pair of objects costs its own tree distance.
    """
    kids = [children(x, t) for x, t in ((a, trees[0]), (b, trees[1]))]
    if not kids[0] or not kids[1]:
        return 0.0 if not kids[0] and not kids[1] else 1.0
    both = kids[0].keys() & kids[1].keys()
    gain = sum(content(kids[0][k], kids[1][k], trees) for k in both)
    rest = [{k: n for k, n in side.items() if k not in both} for side in kids]
    costs = [(-g / 2, i, j) for i, x in rest[0].items() for j, y in rest[1].items() if names_alike(i, j) >= 0.5 and (g := content(x, y, trees)) > 0.5]
    renamed = _assign(costs)
    won = {(i, j): -c for c, i, j in costs}
    gain += sum(won[p] for p in renamed)
    return 1 - gain / (len(kids[0].keys() | kids[1].keys()) - len(renamed))


def _words(name: str) -> set[str]:
    return {w for w in re.split(r"[_\W]+", re.sub(r"([a-z])([A-Z])", r"\1_\2", name).lower()) if w}


def names_alike(a: str, b: str) -> float:
    x, y = _words(a), _words(b)
    stems = sum(any(s == t or (min(len(s), len(t)) >= 3 and (s.startswith(t[:4]) or t.startswith(s[:4]))) for t in y) for s in x)
    return max(stems / max(1, min(len(x), len(y))), SequenceMatcher(None, a.lower(), b.lower()).ratio())


def rename_cost(a: Node, b: Node, trees: tuple[dict, dict]) -> float:
    """0 (the same content in the same place) to 1."""
    like = content(a, b, trees)
    if like < 0.2:
        return 1.0
    moved = a.parent != b.parent
    name = names_alike(a.name, b.name)
    if moved and name < 0.99:
        return 1.0  # a move keeps its name
    place = 0.4 if moved else max(0.0, 1 - 4 * abs(a.at - b.at))
    if not moved and name >= 0.9:
        place = max(place, 0.5)  # siblings that come or go shift a field in a small object
    often = 1 - abs(a.n - b.n) / max(a.n, b.n)
    if a.type == "boolean" and not moved and name < 0.6 and place < 0.6:
        return 1.0
    return 1 - (0.5 * like + 0.22 * place + 0.23 * name + 0.05 * often)


def _hungarian(cost: list[list[float]]) -> list[int]:
    """The column of each row at least total cost; at least as many columns as rows."""
    n, m = len(cost), len(cost[0])
    u, v, row_of = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j, way = i, 0, [0] * (m + 1)
        least, used = [math.inf] * (m + 1), [False] * (m + 1)
        while row_of[j]:
            used[j], k = True, row_of[j]
            for c in range(1, m + 1):
                if not used[c] and (x := cost[k - 1][c - 1] - u[k] - v[c]) < least[c]:
                    least[c], way[c] = x, j
            to = min((c for c in range(1, m + 1) if not used[c]), key=least.__getitem__)
            step = least[to]
            for c in range(m + 1):
                if used[c]:
                    u[row_of[c]] += step
                    v[c] -= step
                else:
                    least[c] -= step
            j = to
        while j:
            row_of[j] = row_of[way[j]]
            j = way[j]
    found = [0] * n
    for c in range(1, m + 1):
        if row_of[c]:
            found[row_of[c] - 1] = c - 1
    return found


def _assign(costs: list[tuple[float, str, str]]) -> list[tuple[str, str]]:
    """Pairs of least total cost, each path in one pair at most: exact, by connected component of the candidates.

    A candidate's cost is relative to leaving both alone: below 0.
    """
    links: dict[tuple[int, str], list[tuple[int, str]]] = defaultdict(list)
    for _, a, b in costs:
        links[0, a].append((1, b))
        links[1, b].append((0, a))
    cost = {(a, b): c for c, a, b in costs}
    best: list[tuple[str, str]] = []
    seen: set[tuple[int, str]] = set()
    for start in sorted(links):
        if start in seen:
            continue
        seen.add(start)
        part, open_ = [start], [start]
        while open_:
            for x in links[open_.pop()]:
                if x not in seen:
                    seen.add(x)
                    part.append(x)
                    open_.append(x)
        old, new = (sorted(p for side, p in part if side == k) for k in (0, 1))
        # Pairs that aren't candidates cost more than any choice among the others; a column per row leaves it alone.
        table = [[cost.get((a, b), len(old) + 1.0) for b in new] + [0.0] * len(old) for a in old]
        best += [(a, new[c]) for a, c in zip(old, _hungarian(table), strict=True) if c < len(new)]
    return best


def edit_script(before: dict[str, Node], after: dict[str, Node]) -> list[tuple[str, str, str]]:
    """(change, path, new path) that turn one schema tree into the next at least cost."""
    gone, new = before.keys() - after.keys(), after.keys() - before.keys()
    changes = [("retyped", p, "") for p in before.keys() & after.keys() if before[p].type != after[p].type]
    shut = {p for _, p, _ in changes}

    def under(path: str, tops: set[str]) -> bool:
        return any(path[:i] in tops for i, c in enumerate(path) if c == ".")

    # Of a subtree that came or went, only the root is an edit of its own; its nodes may still have moved out of it, or
    # into it from elsewhere: then the other end's edit is saved, but not one for them.
    gone, new = ({p for p in side if not under(p, shut)} for side in (gone, new))
    old_roots, new_roots = ({p for p in side if not under(p, side)} for side in (gone, new))
    trees = (before, after)
    costs = []
    for a in gone:
        for b in new:
            roots = (a in old_roots) + (b in new_roots)
            if roots == 2 or roots == 1 and names_alike(before[a].name, after[b].name) >= 0.99:
                if (c := rename_cost(before[a], after[b], trees) - ADD_AND_REMOVE * roots / 2) < 0:
                    costs.append((c, a, b))
    while True:
        pairs = _assign(costs)
        # What lies in a renamed object went with it.
        tops = [{p[k] for p in pairs} for k in (0, 1)]
        kept = [x for x in costs if not ((x[1], x[2]) in pairs and (under(x[1], tops[0]) or under(x[2], tops[1])))]
        if len(kept) == len(costs):
            break
        costs = kept
    changes += [("renamed", a, b) for a, b in pairs]
    changes += [("removed", a, "") for a in old_roots - {a for a, _ in pairs}] + [("added", b, "") for b in new_roots - {b for _, b in pairs}]
    # A renamed object's own fields changed under it: not reported.
    return sorted(changes)


def _tree(nodes: list[dict], fields: list[dict] | None) -> dict[str, Node]:
    tree = {x["path"]: Node(x["path"], x["n"]) for x in nodes}
    for f in fields or ():
        tree[f["path"]].add(f)
    return tree


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fields whose content decides: those that only one of two neighbouring files has, if both have such."""
    for batch in batches:
        rows: list[tuple] = []
        for first in range(batch.num_rows):
            r = batch.slice(first, 1).to_pylist()[0]
            old, new = ({x["path"] for x in r[side]} for side in ("old", "new"))
            if old - new and new - old:
                rows += [(r["feed"], r["before"], p) for p in old - new] + [(r["feed"], r["file_no"], p) for p in new - old]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string()), strict=True)], names=["feed", "file_no", "path"])


def _scripts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = "feed stream file_no change_type field_path new_path old_type new_type".split()
    for batch in batches:
        rows: list[tuple] = []
        for first in range(batch.num_rows):  # one pair of files in Python at a time
            r = batch.slice(first, 1).to_pylist()[0]
            old, new = _tree(r["old"], r["old_fields"]), _tree(r["new"], r["new_fields"])
            rows += [(r["feed"], r["stream"], r["file_no"], *c, old[c[1]].type if c[1] in old else None, new[c[2] or c[1]].type if (c[2] or c[1]) in new else None) for c in edit_script(old, new)]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "file_no" else pa.string()) for c, n in zip(columns, names, strict=True)], names=names)


def changes(raw: DataFrame) -> DataFrame:
    """Every difference of a file from the file before it in its feed, with the types on both sides.

    Only numbers and digests of files pass through the window of a feed; trees and contents meet by file, so a feed with a
    third of all files is many groups.
    """
    tree = cut(trees(raw))
    w = Window.partitionBy("feed").orderBy("file_no")
    pairs = tree.select("feed", "file_no", "digest").withColumn("before", F.lag("file_no").over(w)).withColumn("was", F.lag("digest").over(w))
    pairs = pairs.where("before IS NOT NULL AND digest <> was").select("feed", "before", "file_no")
    new = tree.select("feed", "file_no", "stream", F.col("nodes").alias("new"))
    old = tree.select("feed", F.col("file_no").alias("before"), F.col("nodes").alias("old"))
    both = cut(pairs.join(new, ["feed", "file_no"]).join(old, ["feed", "before"]))
    wanted = both.select("feed", "before", "file_no", "old", "new").mapInArrow(_wanted, "feed string, file_no int, path string").distinct()
    wanted = cut(wanted)
    found = cut(contents(raw, wanted))
    after = found.withColumnRenamed("fields", "new_fields")
    prior = found.select("feed", F.col("file_no").alias("before"), F.col("fields").alias("old_fields"))
    whole = both.join(after, ["feed", "file_no"], "left").join(prior, ["feed", "before"], "left")
    return whole.mapInArrow(_scripts, "feed string, stream string, file_no int, change_type string, field_path string, new_path string, old_type string, new_type string")


# -- one table per stream -----------------------------------------------------------------------------------------------


def projections(raw: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Per (feed, file): `names`, a map from today's path of each renamed field to its first name in the feed."""

    def compile_feed(key, rows, files):
        import pandas as pd

        now: dict[str, str] = {}
        by = defaultdict(list)
        for r in rows.itertuples():
            by[r.file_no].append((r.change_type, r.field_path, r.new_path))
        out = []
        for n in sorted(files["file_no"]):
            then = dict(now)
            for kind, old, new in by[n]:
                if kind == "renamed":
                    for p in [p for p in now if p.startswith(old + ".")]:
                        then.pop(p, None)
                        then[new + p[len(old) :]] = now[p]
                    then.pop(old, None)
                    then[new] = now.get(old, old)
                elif kind in ("removed", "added"):
                    then.pop(old, None)
            now = then
            out.append((key[0], n, json.dumps(now)))
        return pd.DataFrame(out, columns=["feed", "file_no", "names"])

    renames = (changes(raw) if found is None else found).select("feed", "file_no", "change_type", "field_path", "new_path")
    files = raw.select("feed", "file_no").where("feed is not null and file_no is not null").distinct()
    return renames.groupBy("feed").cogroup(files.groupBy("feed")).applyInPandas(compile_feed, "feed string, file_no int, names string")


def _first_name(path: str, names: dict[str, str]) -> str:
    """The first name of a path, by its own rename or that of the closest object around it."""
    head = path
    while head:
        if head in names:
            return names[head] + path[len(head) :]
        head = head.rpartition(".")[0]
    return path


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        for r in batch.to_pylist():
            names = json.loads(r["names"] or "{}")
            counts = {t: r[f"n_{t}"] for t in TYPES}
            for t, n in counts.items():
                if n:
                    seen[(_first_name(r["path"], names), t)] += n
        columns = list(zip(*((p, t, n) for (p, t), n in seen.items()), strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["path", "type", "n"])


def _cast(value, kind: str):
    """A value in its column's type, or None; a wrapper ({"value": x} or [x]) around a scalar is taken off."""
    if kind in ("string", "number", "boolean"):
        for _ in range(3):
            if isinstance(value, dict) and len(value) == 1:
                value = next(iter(value.values()))
            elif isinstance(value, list) and len(value) == 1:
                value = value[0]
            else:
                break
    if value is None:
        return None
    if kind == "number":
        if isinstance(value, bool):
            return float(value)
        try:
            return float(value)
        except (TypeError, ValueError):
            return None
    if kind == "boolean":
        if isinstance(value, bool):
            return value
        return {"true": True, "false": False, "1": True, "0": False}.get(str(value).lower())
    return value if isinstance(value, str) else json.dumps(value, sort_keys=True)


def _project(batches: Iterator[pa.RecordBatch], columns: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    arrow = {"number": pa.float64(), "boolean": pa.bool_()}
    compiled: dict[str, dict[str, str]] = {}
    for batch in batches:
        out: list[list] = [[] for _ in columns]
        keep = []
        for i, (body, text) in enumerate(zip(batch.column("body").to_pylist(), batch.column("names").to_pylist(), strict=True)):
            record = parse(body)
            if record is None:
                continue
            keep.append(i)
            names = compiled.get(text)
            if names is None:
                if len(compiled) > 1000:
                    compiled.clear()
                names = compiled[text] = json.loads(text or "{}")
            values: dict[str, object] = {}
            for path, value, _ in _fields(record):
                values.setdefault(_first_name(path, names), value)
            for c, (path, kind) in zip(out, columns, strict=True):
                c.append(_cast(values.get(path), kind))
        head = batch.select(["raw_id", "feed", "file_no", "line_no", "received_at"]).take(pa.array(keep, pa.int64()))
        arrays = [pa.array(c, arrow.get(k, pa.string())) for c, (_, k) in zip(out, columns, strict=True)]
        yield pa.RecordBatch.from_arrays([*head.columns, *arrays], names=[*head.schema.names, *(p.replace(".", "__") for p, _ in columns)])


def unified_table(raw: DataFrame, stream: str, max_columns: int = 2000) -> DataFrame:
    """All readable lines of a stream in one schema: each field under its first name, in its most frequent type.

    Paths become columns with `__` for `.`; arrays stay JSON text, objects give a column per field. More than
    `max_columns` fields raise.
    """
    own = raw.where(F.col("stream") == stream)
    names = projections(own)
    scripted = outline(own).join(names, ["feed", "file_no"], "left")
    kinds = (
        scripted.mapInArrow(_leaves, "path string, type string, n long")
        .groupBy("path", "type")
        .agg(F.sum("n").alias("n"))
        .groupBy("path")
        .agg(F.max(F.struct("n", "type"))["type"].alias("type"))
        .where("type <> 'object'")
        .orderBy("path")
        .limit(max_columns + 1)
        .collect()
    )
    if len(kinds) > max_columns:
        raise ValueError(f"more than {max_columns} fields")
    # A wrapper's own field is the wrapped field.
    paths = {r["path"]: r["type"] for r in kinds}
    columns = [(p, t) for p, t in paths.items() if p.rpartition(".")[0] not in paths]
    spark_types = {"number": T.DoubleType(), "boolean": T.BooleanType()}
    head = [T.StructField("raw_id", T.LongType()), T.StructField("feed", T.StringType()), T.StructField("file_no", T.IntegerType()), T.StructField("line_no", T.IntegerType()), T.StructField("received_at", T.TimestampNTZType())]
    schema = T.StructType(head + [T.StructField(p.replace(".", "__"), spark_types.get(t, T.StringType())) for p, t in columns])
    rows = own.select(F.col("raw_id").cast("long").alias("raw_id"), "feed", F.col("file_no").cast("int").alias("file_no"), F.col("line_no").cast("int").alias("line_no"), F.col("received_at").cast("timestamp_ntz").alias("received_at"), "body")
    return rows.join(names, ["feed", "file_no"], "left").mapInArrow(partial(_project, columns=columns), schema)
