import datetime
import random
from collections import defaultdict

from quarryline.operators import entity_features as E

SCHEMA = "id long, event_id string, telemetry_id string, event string, created_at timestamp_ntz, received_at timestamp_ntz, tool_calls int, turns int, entity string, type int, t0 string"


def day(n):
    return datetime.datetime(2026, 3, 1) + datetime.timedelta(hours=n)


def rows():
    r = random.Random(3)
    out = []
    for i in range(3000):
        who = "hot" if r.random() < 0.35 else r.choice(["a", "b", "", None, "c" * 50]) if r.random() < 0.1 else f"u{r.randint(0, 300)}"
        event = r.choice(["x", "y", "z", None])
        key = r.choice([None, "", f"e{r.randint(0, 1500)}"])
        out.append((i, key, who, event, r.choice([None, day(r.randint(0, 500))]), day(r.randint(0, 500)), r.choice([None, -1, 5, 2**31 - 1]), r.choice([None, 3]), "e", 1, None))
    return out


def brute(data):
    first = {}
    for r in data:
        key = r[1] if r[1] else ("row", r[0])
        if key not in first or (r[5], r[0]) < (first[key][5], first[key][0]):
            first[key] = r
    out = defaultdict(lambda: [0, 0, 0, defaultdict(int), {}])
    for r in first.values():
        o = out[r[2]]
        o[1] += r[6] or 0
        o[2] += r[7] or 0
        if r[3]:
            o[0] += 1
            o[3][r[3]] += 1
            if r[4] and (r[3] not in o[4] or o[4][r[3]] < r[4]):
                o[4][r[3]] = r[4]
    return out


def test_against_brute_force(spark, monkeypatch):
    data = rows()
    want = brute(data)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    found = E.entity_features(E.first_stored(df), "telemetry_id", "event", "created_at", ["tool_calls", "turns"])
    seen = {r["telemetry_id"]: r.asDict() for r in found.collect()}
    assert seen.keys() == want.keys()
    for who, (n, tools, turns, counts, last) in want.items():
        r = seen[who]
        assert (r["events"], r["tool_calls_total"], r["turns_total"]) == (n, tools, turns)
        for t in "xyz":
            assert (r[f"{t}_events"], r[f"{t}_last"]) == (counts[t], last.get(t))


def test_small_blocks_give_the_same(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(E, "BLOCK_CELLS", 12)
    r = random.Random(1)
    who, what = [f"u{r.randint(0, 40)}" for _ in range(999)], [r.choice("abc") for _ in range(999)]
    batches = [pa.RecordBatch.from_pydict({"entity": pa.array(who[i : i + 70]), "type": pa.array(what[i : i + 70]), "at": pa.array(range(i, i + len(who[i : i + 70])), pa.int64())}) for i in range(0, 999, 70)]
    got = defaultdict(int)
    for b in E._cells(iter(batches), ["a", "b", "c"], []):
        for e, w, n in zip(b["entity"].to_pylist(), b["what"].to_pylist(), b["n"].to_pylist(), strict=True):
            if w >= 0:
                got[e, "abc"[w]] += n
    want = defaultdict(int)
    for p in zip(who, what, strict=True):
        want[p] += 1
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert E.entity_features(E.first_stored(df), "telemetry_id", "event", "created_at", ["turns"]).count() == 0
