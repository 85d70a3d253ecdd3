import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import graph as G
from quarryline.operators import retrieval as R
from quarryline.operators import series as S
from quarryline.plans import graphs, streams
from quarryline.sources import files
from quarryline.streaming import events as E
from tests.compare import DATA


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "c string").select(make(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "make,value,want",
    [
        (X.html_to_text, "<html><style>x{}</style><body><p>A &amp;lt; b</p><!-- no --><script>bad()</script>c<br/>d</body></html>", "A &lt; b\n\nc\nd"),
        (X.html_to_markdown, '<h2>T</h2><p>see <a href="u">here</a> <b>now</b></p><ul><li>x</li></ul>', "## T\nsee [here](u) **now**\n\n- x"),
        (X.redact_secrets, "key ghp_" + "a1" * 12 + "\nMY_TOKEN = abc\nrest", "key [REDACTED_SECRET]\nMY_TOKEN = [REDACTED_SECRET]\nrest"),
        (X.redact_secrets, "nothing here", "nothing here"),
        (X.search_normalise, "  Foo-Bar_baz/QUX.rs: x ", "foo bar baz qux rs x"),
        (X.strip_controls, "\x1b[31mred\x1b[0m\x07 ", "red"),
        (X.basename, "/a/b/c.txt", "c.txt"),
        (lambda c: X.truncate(c, 3), "abcdef", "abc…"),
        (lambda c: X.longest_run(c, "a"), "aabaaab", 3),
        (lambda c: X.longest_run(c, "z"), "aab", 0),
        (lambda c: X.log_fields(c)["b"], "a=1 b=2, b=3", "3"),
        (lambda c: X.head_and_tail(c, 2, 2), "abc", "abc"),
        (X.html_to_text, None, None),
    ],
)
def test_text(spark, make, value, want):
    assert one(spark, make, value) == want


def test_query_terms():
    assert X.query_terms("How is the Session-index of 7 a?") == ["session", "index", "7"]
    assert [X.least_terms(n) for n in range(7)] == [0, 1, 2, 2, 2, 2, 3]


def test_snippet(spark):
    long = "alpha " * 60 + "needle here " + "omega " * 60
    s = one(spark, lambda c: X.snippet(c, "needle", 40), long)
    assert s.startswith("...") and s.endswith("...") and "needle here" in s and len(s) < 70
    assert one(spark, lambda c: X.snippet(c, "absent", 5), "abcdefgh") == "abcde"


def test_gate_known_answers(spark):
    for scores, k, want in (([0.0163, 0.0161, 0.0100, 0.0098, 0.0097], 5, 2), ([0.0200, 0.0100, 0.0090], 5, 1), ([0.0160] * 8, 5, 5)):
        df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "key int, score double")
        assert R.gate(df, "score", "key", k).count() == want


def test_fusion_lets_a_lexical_match_win(spark):
    lexical = spark.createDataFrame([(7, 1)], "key int, rank int")
    dense = spark.createDataFrame([(i, i) for i in range(1, 6)] + [(7, 6)], "key int, rank int")
    assert R.fuse((lexical, "key"), (dense, "key")).orderBy(F.desc("score")).first()["key"] == 7


def test_compose(spark):
    c = spark.createDataFrame([(i, i) for i in range(1, 5)], "key int, rank int")
    again = spark.createDataFrame([(3, 1), (1, 2)], "key int, rank int")
    assert [r["key"] for r in R.compose(c, again, "key", True).orderBy("position").collect()] == [3, 1, 2, 4]
    assert [r["key"] for r in R.compose(c, again, "key", False).orderBy("position").collect()] == [3, 1]


def test_fuzzy():
    words = ["session", "sesion", "cessation", "zebra"]
    s = dict(zip(words, R.fuzzy_scores("session", words), strict=True))
    assert s["session"] > s["sesion"] > R.LOST and s["zebra"] == R.LOST
    assert R.fuzzy_scores("", ["a"])[0] == R.LOST and len(R.fuzzy_scores("a", [])) == 0


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", 5.0), ("b", None)], "k string, v double")
    assert {(r["k"], r["p50"], r["n"]) for r in S.nearest_rank(df, ["k"], "v", [0.5]).collect()} == {("a", 3.0, 4), ("b", 5.0, 1)}


def test_graph_small(spark):
    needs = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 1), (5, 6), (6, 99), (6, 99)], "id int, dep int")
    items = spark.createDataFrame([(i,) for i in range(1, 7)], "id int")
    assert {r["id"] for r in G.stuck_in_cycles(items, needs).collect()} == {1, 2, 3, 4}
    state = {r["id"]: (r["state"], r["missing"]) for r in G.plan_state(items, needs, F.col("id") == 3, F.lit(False)).collect()}
    assert state[3][0] == "done" and state[2][0] == "ready" and state[6] == ("blocked", 2)
    roots = {r["id"]: (r["root"], r["depth"]) for r in G.chain_roots(spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 50), (5, 6), (6, 5)], "id int, parent int")).collect()}
    assert roots == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (4, 0)}
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (5, 5)], "src int, dst int")
    assert {r["node"]: r["component"] for r in G.components(edges).collect()} == {1: 2, 2: 2, 3: 4, 4: 4, 5: 5}
    assert G.components(edges.limit(0)).count() == 0


def test_graph_deep(spark):
    n = 300
    path = spark.createDataFrame([(i, i - 1) for i in range(n, 1, -1)], "src int, dst int")
    assert {(r["node"], r["component"]) for r in G.components(path).collect()} == {(i, i) for i in range(1, n + 1)}
    n = 12_000  # more than 10,000 layers
    items = spark.range(1, n + 1).select(F.col("id").cast("int").alias("id"))
    chain = items.where("id > 1").select("id", (F.col("id") - 1).alias("dep"))
    assert G.stuck_in_cycles(items, chain).count() == 0
    assert {(r["id"], r["depth"]) for r in G.longest_paths(items, chain).collect()} == {(i, i - 1) for i in range(1, n + 1)}
    closed = chain.unionByName(spark.createDataFrame([(6000, 6001)], "id int, dep int"))
    assert G.stuck_in_cycles(items, closed).agg(F.min("id"), F.count("*")).first()[:] == (6000, n - 5999)
    with pytest.raises(ValueError):
        G.longest_paths(items.limit(3), spark.createDataFrame([(1, 2), (2, 1)], "id int, dep int"))


def test_graph_against_brute_force(spark):
    r = random.Random(5)
    n, m = 14, 20
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
    reach = {(a, b) for a, b in pairs}
    for k in range(n):
        reach |= {(a, b) for a in range(n) for b in range(n) if (a, k) in reach and (k, b) in reach}
    nodes = {x for p in pairs for x in p}
    want = {(a, max([a, *(b for b in nodes if (a, b) in reach and (b, a) in reach)])) for a in nodes}
    edges = spark.createDataFrame(pairs, "src int, dst int")
    assert {(x["node"], x["component"]) for x in G.components(edges).collect()} == want
    items = spark.createDataFrame([(i,) for i in range(n)], "id int")
    stuck = {a for a in nodes if (a, a) in reach or any((a, b) in reach and (b, b) in reach for b in nodes)}
    assert {x["id"] for x in G.stuck_in_cycles(items, edges.toDF("id", "dep")).collect()} == stuck
    down = sorted({(max(p), min(p)) for p in pairs if p[0] != p[1]})
    depth = {}
    for i in range(n):
        depth[i] = max([0, *(depth[d] + 1 for a, d in down if a == i)])
    assert {x["id"]: x["depth"] for x in G.longest_paths(items, spark.createDataFrame(down, "id int, dep int")).collect()} == depth


def test_links_of_all_customers(spark, tmp_path):
    r = random.Random(8)
    orders = [(k, r.randrange(1, 150)) for k in range(1, 260)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    size = max(c for _, c in orders) + 1
    links = {(c, k * 7 % size) for k, c in orders}
    nodes = {x for p in links for x in p}
    reach = {a: {a} for a in nodes}
    for _ in nodes:
        for a, b in links:
            reach[a] |= reach[b]
    want = {(a, max(b for b in reach[a] if a in reach[b])) for a in nodes}
    assert {(x["node"], x["component"]) for x in graphs.strong_components(spark, str(tmp_path)).collect()} == want
    mutual = {(x["src"], x["dst"]) for x in graphs.mutual_links(spark, str(tmp_path)).collect()}
    assert mutual == {(a, b) for a, b in links if a < b and (b, a) in links}
    assert max(a for a, _ in want) >= 97 and any(a != c for a, c in want)


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.JSONL").write_text('{"role":"user","content":"hi","session_id":"s","timestamp":"2026-03-01T00:00:00Z"}\n{bad\n{"role":"tool","content":"x"}\n')
    (tmp_path / "b.txt").write_text("level=warn took=12ms\nnone\n")
    found = files.listing(spark, str(tmp_path), "jsonl")
    assert [r["path"].rsplit("/", 1)[1] for r in files.newest(found, 5).collect()] == ["a.JSONL"]
    good, bad = files.json_lines(spark, str(tmp_path / "sub"), "role string, content string")
    assert good.count() == 2 and bad.count() == 1
    m = files.all_messages({"plain": spark.read.text(str(tmp_path / "sub"))}).collect()
    assert [(r["session_id"], r["role"], r["text"]) for r in m] == [("s", "user", "hi")]
    logs = files.log_lines(spark, str(tmp_path / "b.txt"), {"took": r"took=(\d+)ms"}).collect()
    assert [r["took"] for r in logs] == ["12", None]
    valid, anew = files.refresh(found, found)
    assert valid.count() == 1 and anew.count() == 0
    log = spark.createDataFrame([("k", 1, False), ("k", 2, True), ("j", 1, None)], "key string, at int, deleted boolean")
    assert [r["key"] for r in files.replay(log, "key", "at", "deleted").collect()] == ["j"]
    assert json.loads(good.toJSON().first())["role"] == "user"


def test_streams_of_many_files(spark, tmp_path):
    kind = spark.read.parquet(f"{DATA}/telemetry_events.parquet")
    rows = kind.orderBy(F.desc("received_at"), "id").limit(300).collect()
    rows[-20:] = [Row(**(x.asDict() | {"event_id": rows[0]["event_id"]})) for x in rows[-20:]]  # resent days apart
    kind = kind.schema
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/whole/telemetry_events.parquet")
    for i in range(9):  # latest first
        spark.createDataFrame(rows[i * 34 : (i + 1) * 34], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/parts/telemetry_events.parquet")
    got = [sorted(map(str, streams.QUERIES["stream_dedup"](spark, f"{tmp_path}/{x}").collect())) for x in ("whole", "parts")]
    assert got[0] == got[1] and len(got[1]) == len({x["event_id"] for x in rows})
    once = E.run_once(E.sessions(E.read(spark, f"{tmp_path}/whole/telemetry_events*.parquet", kind)), str(tmp_path))
    got = [sorted(map(str, x.collect())) for x in (once, *(streams.QUERIES["stream_sessions"](spark, f"{tmp_path}/{x}") for x in ("whole", "parts")))]
    assert got[0] and got[0] == got[1] == got[2]


def test_validation(spark):
    df = spark.createDataFrame([("a", "x"), ("z", "x"), ("a", ""), ("a", "y" * 300), (None, "x")], "event string, telemetry_id string")
    good, bad = E.validated(df, ["a"])
    assert good.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["id too long", "no id", "unknown event", "unknown event"]
