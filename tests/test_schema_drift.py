import datetime
import itertools
import json
import random

from quarryline.operators import schema_drift as D

SCHEMA = "raw_id long, feed string, stream string, file_no int, line_no int, received_at timestamp_ntz, body string, path string, n_string int"


def raw(spark, files, feed="f", stream="s"):
    rows, k = [], 0
    for n, bodies in files.items():
        for i, b in enumerate(bodies):
            k += 1
            rows.append((k, feed, stream, n, i, datetime.datetime(2026, 3, n), b if b is None or isinstance(b, str) else json.dumps(b), "p", 1))
    return spark.createDataFrame(rows, SCHEMA)


def record(r, **more):
    return {"version": "0.3.1", "session": f"s-{r.randint(0, 9**9):09d}", "model": r.choice(["alpha", "beta", "gamma"]), "size": r.randint(100, 900), "box": {"ok": True, "w": r.randint(1, 9)}} | more


def test_changes(spark):
    r = random.Random(2)
    one = [record(r) for _ in range(12)] + ["{bad", "", None, "[1]"]
    two = [{("model_name" if k == "model" else k): v for k, v in record(r, extra={"a": {"b": 1}}).items()} for _ in range(12)]
    three = [{k: v for k, v in x.items() if k != "size"} | {"version": 3, "box": None, "extra": {"a": {"b": 2}}} for x in two]
    found = {(x["file_no"], x["change_type"], x["field_path"], x["new_path"]) for x in D.changes(raw(spark, {1: one, 4: two, 9: three})).collect()}
    assert found == {(4, "renamed", "model", "model_name"), (4, "added", "extra", ""), (9, "removed", "size", ""), (9, "removed", "box", ""), (9, "retyped", "version", "")}


def test_move_keeps_its_name(spark):
    r = random.Random(4)
    one = [record(r) for _ in range(10)]
    two = [{k: v for k, v in x.items() if k != "model"} | {"box": x["box"] | {"model": x["model"]}} for x in (record(r) for _ in range(10))]
    found = [(x["change_type"], x["field_path"], x["new_path"]) for x in D.changes(raw(spark, {1: one, 2: two})).collect()]
    assert found == [("renamed", "model", "box.model")]


def renamed(spark, one, two):
    return [(x["change_type"], x["field_path"], x["new_path"]) for x in D.changes(raw(spark, {1: one, 2: two})).collect()]


def test_long_values_count_as_a_whole(spark):
    r = random.Random(6)
    words = ["".join(r.choice("ghijklmnop") for _ in range(9)) for _ in range(60)]
    lines = lambda name: [{"id": f"s-{i:05d}", name: r.sample(words, 40)} for i in range(10)]
    assert renamed(spark, lines("words"), lines("zq")) == [("renamed", "words", "zq")]
    before, after = ([{"id": f"s-{i:05d}", name: "x" * 200 + tail[i % 2]} for i in range(10)] for name, tail in (("note", ("yes", "no")), ("zq", ("left", "up down"))))
    assert sorted(renamed(spark, before, after)) == [("added", "zq", ""), ("removed", "note", "")]


def test_content_is_of_all_rows(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("ghijklmnop") for _ in range(9))
    one, two = ([{"id": f"s-{i:05d}", name: words[i % 200]} for i in range(1200)] for name, words in (("mood", [word() for _ in range(200)]), ("zq", [word() for _ in range(200)])))
    # Two vocabularies, each closed over all rows, without a word in common.
    assert sorted(renamed(spark, one, two)) == [("added", "zq", ""), ("removed", "mood", "")]


def test_one_table(spark):
    r = random.Random(2)
    one = [record(r) for _ in range(12)]
    two = [{("model_name" if k == "model" else k): ({"value": v} if k == "size" else v) for k, v in record(r).items()} for _ in range(6)]
    t = D.unified_table(raw(spark, {1: one, 2: [*two, "{bad"]}), "s")
    assert t.count() == 18
    assert t.where("model IS NULL OR size IS NULL").count() == 0
    assert {"box__w", "version"} <= set(t.columns) and not {"model_name", "size__value"} & set(t.columns)


def test_assignment_against_brute_force():
    r = random.Random(9)
    pairs = [("a1", "b1", -0.36), ("a1", "b2", -0.34), ("a2", "b1", -0.34)]
    assert sorted(D._assign([(c, f"{i:02d}{a}", f"{i:02d}{b}") for i in range(13) for a, b, c in pairs])) == sorted((f"{i:02d}{a}", f"{i:02d}{b}") for i in range(13) for a, b in (("a1", "b2"), ("a2", "b1")))
    for _ in range(40):
        cost = {(a, b): -r.random() for a in "abcd" for b in "wxyz" if r.random() < 0.6}
        total = min(sum(cost.get(p, 0) for p in zip("abcd", order, strict=True)) for order in itertools.permutations("wxyz"))
        found = D._assign([(c, *p) for p, c in cost.items()])
        assert len({a for a, _ in found}) == len({b for _, b in found}) == len(found)
        assert abs(sum(cost[p] for p in found) - total) < 1e-9


def test_move_into_a_new_object(spark):
    r = random.Random(4)
    one = [record(r) for _ in range(10)]
    two = [{k: v for k, v in x.items() if k != "model"} | {"fresh": {"model": x["model"], "since": 1}} for x in one]
    assert sorted(renamed(spark, one, two)) == [("added", "fresh", ""), ("renamed", "model", "fresh.model")]


def test_empty(spark):
    none = raw(spark, {1: [record(random.Random(1))]}).limit(0)
    assert D.changes(none).count() == 0
    assert D.unified_table(none, "s").count() == 0
    assert D.changes(raw(spark, {1: ["", "{", None], 2: ["x"]})).count() == 0


def test_many_wanted_paths_are_joined(spark, monkeypatch):
    r = random.Random(5)
    one = [record(r) for _ in range(12)]
    two = [{("model_name" if k == "model" else k): v for k, v in record(r).items()} for _ in range(12)]
    monkeypatch.setattr(D, "SENT", 0)
    assert renamed(spark, one, two) == [("renamed", "model", "model_name")]


def test_objects_by_tree_distance(spark):
    """An object with a renamed field inside is still the same object under another name."""
    r = random.Random(6)
    box = lambda: {"width": r.randint(1, 900), "label": f"L-{r.randint(0, 9**6):06d}", "tags": r.sample(["red", "blue", "green", "grey"], 2), "on": r.random() < 0.5}
    one = [{"id": f"s-{i:04d}", "box": box()} for i in range(30)]
    two = [{"id": f"s-{i:04d}", "box_info": {("label_text" if k == "label" else k): v for k, v in box().items()}} for i in range(30)]
    assert renamed(spark, one, two) == [("renamed", "box", "box_info")]


def test_forty_renamed_fields(spark):
    r = random.Random(7)
    row = lambda name: {f"{name}{i}": f"{'abcdefgh'[i % 8]}{i:02d}-{r.randint(0, 9**(3 + i % 5))}" for i in range(40)}
    found = renamed(spark, [row("field_") for _ in range(12)], [row("column_field_") for _ in range(12)])
    assert sorted(found) == sorted(("renamed", f"field_{i}", f"column_field_{i}") for i in range(40))
