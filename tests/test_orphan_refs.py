import datetime
import random
import uuid

from quarryline.operators import orphan_refs as O

T0 = datetime.datetime(2026, 3, 1)


def at(n):
    return None if n is None else T0 + datetime.timedelta(minutes=n)


def brute(refs, parents, deleted):
    first = {}
    for t, k, a in parents:
        if k is not None:
            known = first.setdefault((t, k), a)
            if a is not None and (known is None or a < known):
                first[t, k] = a
    gone = {(t, k) for t, k in deleted if k is not None}
    out = set()
    for t, name, rid, field, k, a in refs:
        if k is None:
            continue
        if (t, k) not in first:
            out.add((name, rid, field, "deleted" if (t, k) in gone else "missing"))
        elif a is not None and first[t, k] is not None and first[t, k] > a:
            out.add((name, rid, field, "late"))
    return out


def test_against_brute_force_with_a_hot_key(spark):
    r = random.Random(5)
    keys = [f"k{i}" for i in range(400)]
    parents = [(r.randint(0, 1), r.choice([None, *keys[:250]]), at(r.choice([None, *range(300)]))) for _ in range(900)]
    deleted = [(r.randint(0, 1), r.choice([None, *keys[200:320]])) for _ in range(100)]
    refs = [(r.randint(0, 1), "t", f"r{r.randint(0, 900)}", "f", "k399" if r.random() < 0.35 else r.choice([None, *keys]), at(r.choice([None, *range(300)]))) for _ in range(2000)]
    frames = (
        spark.createDataFrame(refs, "target int, table_name string, record_id string, ref_field string, key string, received_at timestamp_ntz").selectExpr("*", "1 AS kind", "'x' AS digest", "2 AS slot"),
        spark.createDataFrame(parents, "target int, key string, received_at timestamp_ntz").selectExpr("*", "1 AS kind", "3 AS task"),
        spark.createDataFrame(deleted, "target int, key string"),
    )
    for ranges in (1, 16):
        found = O.orphan_references(*frames, ranges=ranges).select("table_name", "record_id", "ref_field", "ref_state")
        assert {tuple(x) for x in found.collect()} == brute(refs, parents, deleted)


def test_spellings_and_empty(spark):
    u = str(uuid.UUID(int=77 << 64))
    spelled = [u.upper(), "{" + u + "} ", u.replace("-", ""), "urn:uuid:" + u, " " + u, u + "\t"]
    stamp = "received_at timestamp_ntz"
    tele = spark.createDataFrame([(u, u, at(0))], f"event_id string, telemetry_id string, {stamp}")
    web = spark.createDataFrame([(s, None, at(5)) for s in [*spelled, "", None, "odd key"]], f"event_id string, conversion_id string, {stamp}")
    inst = spark.createDataFrame([], f"event_id string, conversion_id string, {stamp}")
    up = spark.createDataFrame([("up", "nobody", at(1))] * 2, f"upload_id string, telemetry_id string, {stamp}")
    gone = spark.createDataFrame([("telemetry_events", "telemetry_id", " nobody "), ("other", "x", "y")], "table_name string, key_column string, key_value string")
    found = O.telemetry_orphans(tele, web, inst, up, gone)
    assert {(r["table_name"], r["record_id"], r["ref_state"]) for r in found.collect()} == {("web_details", "odd key", "missing"), ("transcript_uploads", "up", "deleted")}
    none = [d.limit(0) for d in (tele, web, inst, up, gone)]
    assert O.telemetry_orphans(*none).count() == 0
