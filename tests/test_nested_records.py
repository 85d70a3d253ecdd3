import json

from quarryline.operators import nested_records as N

RAW = [
    (1, json.dumps({"a": {"b": [{"c": [1, {"d": 1}, None]}, 5, {"c": {"d": 2}}]}})),
    (2, json.dumps({"a": json.dumps({"b": {"c": []}})})),
    (3, '{"a": {"b": [{"c": '),
    (4, None),
    (5, ""),
    (6, "[1, 2]"),
    (7, json.dumps({"g": [[{"x": 1}], [2, {"x": 1}]], "n": None, "e": []})),
    (7, json.dumps({"g": [[{"x": 1}], [2, {"x": 1}]], "n": None, "e": []})),
]


def frame(spark, rows=RAW):
    return spark.createDataFrame(rows, "sample_id long, raw string").selectExpr("sample_id", "raw", "'x' AS record_id", "1 AS path", "2 AS body")


def test_cases(spark):
    found = sorted(map(tuple, N.array_cases(frame(spark), "sample_id", "raw").collect()))
    assert found == [
        (1, "", "a.b[0]"),
        (1, "", "a.b[2]"),
        (1, "a.b[0]", "a.b[0].c[1]"),
        (1, "a.b[2]", "a.b[2].c[0]"),  # an object where others hold an array
        (2, "", "a.b[0]"),  # and JSON kept as text
        *[(7, "", "g[0][0]"), (7, "", "g[0][0]"), (7, "", "g[1][1]"), (7, "", "g[1][1]")],
    ]


def test_paths_joined_beyond_the_bound(spark, monkeypatch):
    want = sorted(map(tuple, N.array_cases(frame(spark, RAW[:6]), "sample_id", "raw").collect()))
    monkeypatch.setattr(N, "MAX_SENT_PATHS", 0)
    assert sorted(map(tuple, N.array_cases(frame(spark, RAW[:6]), "sample_id", "raw").collect())) == want


def test_equal_objects_are_stored_once(spark):
    bridge = N.occurrences(frame(spark), "sample_id", "raw")
    stored = N.nodes(frame(spark), "sample_id", "raw")
    assert stored.count() == bridge.select("node_id").distinct().count() < bridge.count()
    assert bridge.where("parent_node_id IS NOT NULL").join(stored, bridge["parent_node_id"] == stored["node_id"], "left_anti").count() == 0
    assert {r["ordinal"] for r in bridge.where("child_path LIKE 'g[1]%'").collect()} == {1}


def test_round_trip():
    record = json.loads(RAW[0][1])
    rows, nodes = N.decompose(record, set())

    def back(node):
        def undo(v):
            return back(v["#"]) if isinstance(v, dict) else [undo(x) for x in v] if isinstance(v, list) else v

        return {k: undo(v) for k, v in json.loads(nodes[node]).items()}

    assert back(rows[0][7]) == record


def test_samples_and_empty(spark):
    rows = [(1, json.dumps({"process": {"os": {"pss_bytes": "12"}, "allocator": {"stats": {"allocated_bytes": 3.0}}}})), (2, "--"), (3, None)]
    found = {r["record_id"]: (r["readable"], r["pss_bytes"], r["allocated_bytes"]) for r in N.samples(frame(spark, rows), "sample_id", "raw").collect()}
    assert found == {1: (True, 12, 3), 2: (False, None, None), 3: (False, None, None)}
    assert N.array_cases(frame(spark, []), "sample_id", "raw").count() == 0
    assert N.nodes(frame(spark, []), "sample_id", "raw").count() == 0


def test_deep_and_long(spark):
    deep = '{"a":' * 400 + "[{}]" + "}" * 400
    wide = json.dumps({"a": [{"k": i} for i in range(30_000)]})
    found = N.array_cases(frame(spark, [(1, deep), (2, wide)]), "sample_id", "raw").groupBy("sample_id").count()
    assert dict(map(tuple, found.collect())) == {1: 2, 2: 30_000}  # `a` holds an array in the other record
