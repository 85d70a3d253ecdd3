"""Readers and writers: transcripts, pages, snapshots, dated files, streams' sinks, the stored index."""

import json
import random
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarryline.operators import search_index, series
from quarryline.sources import files, transcripts
from quarryline.streaming import events as E


def lines(spark, path, records):
    rows = [(path, i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "path string, line_no int, value string")


@pytest.mark.parametrize(
    "value,tools,want",
    [
        (None, False, None), ("", False, None), ("plain", False, "plain"), ('"quoted"', False, "quoted"), ("[]", False, None),
        ('[{"type":"text","text":" a "},{"type":"tool_use","input":{"text":"b"}},"c"]', False, "a\nc"),
        ('[{"type":"text","text":"a"},{"type":"tool_result","content":"b"}]', True, "a\nb"),
        ('{"x":{"y":[{"text":"deep"}]},"content":"no"}', False, "deep"),
        ("[" * 900 + '"x"' + "]" * 900, False, "x"),
    ],
)
def test_content_text(value, tools, want):
    assert transcripts.content_text(value, tools) == want


@pytest.mark.parametrize("value,want", [(None, None), ("null", ""), ("plain", "plain"), ('"x"', "x"), ('[{"type":"image"},{"text":" t "},{"content":"c"}," "]', "[image]\nt\nc"), ('{"text":"odd"}', "odd")])
def test_result_text(value, want):
    assert transcripts.result_text(value) == want


def test_transcripts(spark):
    at = "2026-04-01T10:00:00Z"
    sources = {
        "claude": lines(spark, "/h/one.jsonl", [{"type": "user", "uuid": "u", "timestamp": at, "sessionId": "c1", "message": {"role": "user", "content": [{"type": "text", "text": "hi"}]}}, {"type": "summary"}, "{bad", None]),
        "codex": lines(spark, "/h/two.jsonl", [{"type": "session_meta", "payload": {"id": "x1"}}, {"type": "response_item", "timestamp": at, "payload": {"type": "message", "role": "assistant", "content": [{"text": "yo"}]}}, {"type": "response_item", "payload": {"type": "reasoning"}}, {"type": "message", "role": "user", "content": "old"}]),
        "pi": lines(spark, "/h/three.jsonl", [{"type": "session", "id": "p1"}, {"type": "message", "id": "m", "message": {"role": "user", "content": "ask"}}, {"type": "message", "message": {"role": "toolResult", "content": "no"}}]),
        "opencode": lines(spark, "/h/four.json", [{"id": "m", "sessionID": "o1", "role": "user", "time": {"created": 1775037600000}, "parts": [{"type": "text", "text": "part"}]}]),
        "cursor": lines(spark, "/h/five.jsonl", [{"role": "USER", "message": {"content": [{"text": "q"}]}}, {"role": "assistant", "content": ""}]),
    }
    found = [(r["form"], r["session_id"], r["role"], r["text"], r["sent_at"] and r["sent_at"].hour) for r in transcripts.all_messages(sources).orderBy("path", "line_no").collect()]
    assert sorted(found) == sorted([("claude", "c1", "user", "hi", 10), ("codex", "x1", "assistant", "yo", 10), ("codex", "x1", "user", "old", None), ("pi", "p1", "user", "ask", None), ("opencode", "o1", "user", "part", 10), ("cursor", "five", "user", "q", None)])
    assert transcripts.messages(sources["claude"].limit(0), "claude").count() == 0


def test_pdf(spark, tmp_path):
    page = zlib.compress(b"BT /F1 12 Tf (Hello \\(you\\)) Tj [(Sp) -20 (lit)] TJ ET")
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n1 0 obj << >>\nstream\n" + page + b"\nendstream\nendobj")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4\nnothing")
    assert {r["path"][-5:]: r["text"] for r in files.pdf_texts(spark, str(tmp_path / "*.pdf")).collect()} == {"a.pdf": "Hello (you)\nSplit", "b.pdf": None}


def test_dated_files(spark, tmp_path):
    for d in ("2026-03-01", "2026-03-02", "2026-03-05"):
        (tmp_path / f"server-{d}.jsonl").write_text(f'{{"d":"{d}"}}\n\n')
    (tmp_path / "other.jsonl").write_text("{}\n")
    assert [r["line"] for r in files.dated_files(spark, str(tmp_path), "2026-03-02", "2026-03-04").collect()] == ['{"d":"2026-03-02"}']
    assert files.dated_files(spark, str(tmp_path), "2027-01-01").count() == 0 and files.dated_files(spark, str(tmp_path)).count() == 3


def test_snapshots(spark, tmp_path):
    path = f"{tmp_path}/state"
    assert files.snapshot(spark, path) is None
    for n in (3, 5, 2):
        files.replace_snapshot(spark.range(n), path)
        assert spark.read.parquet(files.snapshot(spark, path)).count() == n
    assert len(list((tmp_path / "state").glob("data-*"))) == 2  # the present one and the one before
    broken = spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception):
        files.replace_snapshot(broken, path)
    assert spark.read.parquet(files.snapshot(spark, path)).count() == 2


def test_summaries_are_kept(spark, tmp_path):
    listed = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "path string, bytes long, modified long")
    cached = spark.createDataFrame([("a", 1, 1, "old"), ("b", 1, 2, "old"), ("gone", 1, 1, "old")], "path string, bytes long, modified long, about string")
    fresh = lambda f: f.withColumn("about", F.lit("new"))
    out = files.summarised(listed, cached, fresh, f"{tmp_path}/cache")
    assert {(r["path"], r["about"]) for r in out.collect()} == {("a", "old"), ("b", "new")}


def test_tables_as_text(spark):
    df = spark.createDataFrame([("a", 1, None), ("bb", 22, 1.5)], "name string, n int, x double")
    assert files.text_table(df) == "name   n    x\n----  --  ---\na      1\nbb    22  1.5"
    assert files.text_table(df, 1).endswith("...") and files.text_table(df.limit(0)).count("\n") == 1
    assert json.loads(files.json_rows(df).first()["value"]) == {"name": "a", "n": 1, "x": None}


def test_rollup_increments(spark, tmp_path):
    from quarryline.operators.rollups import daily_rollup
    from tests.compare import DATA

    e = spark.read.parquet(f"{DATA}/telemetry_events.parquet")
    sink, target = E.rollup_sink(f"{tmp_path}/r"), f"{tmp_path}/r"
    assert E.read_rollup(spark, target) is None
    for n in range(4):
        sink(e.where(F.col("id") % 4 == n), n)
    sink(e.where(F.col("id") % 4 == 3), 3)  # delivered again
    want = sorted(map(str, daily_rollup(e).select(sorted(daily_rollup(e).columns)).collect()))
    got = lambda: sorted(map(str, (r := E.read_rollup(spark, target)).select(sorted(r.columns)).collect()))
    assert got() == want
    E.compact_rollup(spark, target, 2)
    assert got() == want and sorted(p.name for p in (tmp_path / "r").glob("batch=*")) == ["batch=2", "batch=3"]


def test_dual_sink(spark, tmp_path):
    stored, failures = [], []

    def store(batch, number):
        if number == 1:
            raise OSError("full")
        stored.append(batch.count())

    sink = E.dual_sink(f"{tmp_path}/fire", store, lambda n, e: failures.append((n, str(e))))
    for n in (0, 1, 1):
        sink(spark.range(n + 2), n)
    assert stored == [2] and failures == [(1, "full")] * 2 and spark.read.parquet(f"{tmp_path}/fire").count() == 5


def test_folded_sessions_against_a_loop():
    r = random.Random(3)
    for _ in range(200):
        rows = [(i, r.choice(["session_start", "turn_end", "session_end", "session_crash", "x"]), r.choice([None, 1, 4]), r.randint(0, 4)) for i in range(r.randint(1, 9))]
        held = r.choice([(0, 0, 0), (2, 1, 3)])
        n, turns, tools = held
        want = []
        for _, event, calls, _ in sorted(rows, key=lambda x: (x[3], x[0])):
            if event == "session_start" and n:
                want.append((n, turns, tools, "superseded"))
                n = turns = tools = 0
            n, turns, tools = n + 1, turns + (event == "turn_end"), tools + (calls or 0)
            if event in E.ENDS:
                want.append((n, turns, tools, event))
                n = turns = tools = 0
        done, left = E.fold_sessions("k", pd.DataFrame(rows, columns=["id", "event", "tool_calls", "created_at"]), held)
        assert [tuple(x)[1:] for x in done.itertuples(index=False)] == want and left == (n, turns, tools)


def test_index_is_incremental(spark, tmp_path):
    docs = lambda *rows: spark.createDataFrame(rows, "id int, text string, at string")
    folder = f"{tmp_path}/index"
    stamp = F.col("at")
    search_index.build(docs((1, "Café cache session", "a"), (2, "other words", "a"), (3, None, "a")), "id", "text", stamp, folder)
    before = spark.read.parquet(f"{folder}/postings").count()
    search_index.build(docs((1, "Café cache session", "a"), (2, "session index cache cache", "b"), (4, "cafe", "a")), "id", "text", stamp, folder)
    assert spark.read.parquet(f"{folder}/postings").count() == before + 4
    assert {r["doc"] for r in search_index.candidates(spark, folder, "session cache").collect()} == {1, 2}
    assert {r["doc"] for r in search_index.candidates(spark, folder, "cafe").collect()} == {1, 4}
    assert search_index.candidates(spark, folder, "other words").count() == 0  # the document has changed
    assert {r["doc"] for r in search_index.bm25(spark, folder, "cache").collect()} == {1, 2}


def test_order_statistics(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), r.choice([5.0, None, r.gauss(0, 1e6), float(r.randint(0, 9))])) for _ in range(3000)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    found = {x["k"]: x for x in series.nearest_rank(df, ["k"], "v", [0.0, 0.37, 0.95, 1.0]).collect()}
    middle = {x["k"]: x["median"] for x in series.medians(df, ["k"], "v").collect()}
    assert set(found) == {"a", "b", "one"}
    for k, x in found.items():
        values = sorted(v for g, v in rows if g == k and v is not None)
        assert x["n"] == len(values) and [x["p0"], x["p37"], x["p95"], x["p100"]] == [values[int((len(values) - 1) * p + 0.5)] for p in (0, 0.37, 0.95, 1)]
        assert middle[k] == pytest.approx((values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2)
    assert series.nearest_rank(df.limit(0), ["k"], "v", [0.5]).count() == 0


def test_series_by_day_against_a_loop(spark):
    """Null keys and times, ties, several days: what one ordered window would give."""
    import datetime

    r = random.Random(8)
    base = datetime.datetime(2026, 3, 1)
    rows = [(r.choice(["a", "b", None]), r.choice([None, base + datetime.timedelta(hours=r.randint(0, 200))]), i, r.choice([None, r.randint(0, 9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, tie int, v int")
    lag = {x["tie"]: x["p"] for x in series.lagged(df, "k", "at", "tie", p=F.col("v")).collect()}
    total = {x["tie"]: x["s"] for x in series.running_sum(df, "k", "at", "tie", "s", F.col("v")).collect()}
    count = {x["tie"]: x["n"] for x in series.trailing_count(df, "k", "at", 36_000, "n").collect()}
    assert len(lag) == len(total) == len(count) == len(rows)
    for key in ("a", "b", None):
        mine = sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] is not None, x[1] or base, x[2]))
        before, s = None, 0
        for _, at, tie, v in mine:
            s += v or 0
            assert lag[tie] == before and total[tie] == s
            near = [x for x in mine if at is not None and x[1] is not None and 0 <= (at - x[1]).total_seconds() < 36_000]
            assert count[tie] == len(near)
            before = v


def test_series_stats_rounds_times_like_sql(spark, tmp_path):
    """Equal to the millisecond, which a tolerance for floats doesn't show: parts of a millisecond, times before 1970, a bucket's edge."""
    import duckdb

    from quarryline import plans

    rows = [
        (1, 0, 2.0), (1, 1_400, 3.0), (1, 2_500, 5.0), (1, 3_600, 7.0),  # 0, 1, 3, 4 ms
        (2, -2_500, 1.0), (2, -1_499, 1.0), (2, -500, 1.0), (2, -499, 1.0), (2, 499, 1.0),  # -3, -1, -1, 0, 0 ms
        (3, 0, 4.0), (3, 86_399_999_600, 8.0), (3, 172_800_000_000, 2.0),  # the second is of the second day
        (4, 700, None), (5, None, 1.0), (5, 999, 2.0), (None, 5, 1.0),
    ]
    con = duckdb.connect()
    con.execute("CREATE TABLE raw (user_id BIGINT, us BIGINT, value DOUBLE, event_id BIGINT)")
    con.executemany("INSERT INTO raw VALUES (?, ?, ?, ?)", [(*r, i) for i, r in enumerate(rows)])
    con.execute("CREATE TABLE events AS SELECT user_id, make_timestamp(us) AS ts, value, event_id FROM raw")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    found = plans.queries()["series_stats"](spark, str(tmp_path))
    ours = {r["user_id"]: tuple(r) for r in found.collect()}
    assert {k: (r[5], r[6]) for k, r in ours.items()} == {1: (2, 4), 2: (2, 3), 3: (86_400_000, 172_800_000), 4: (None, 0), 5: (None, 0)}
    assert ours[3][8] == 8.0
    theirs = con.execute(f"SELECT {', '.join(found.columns)} FROM ({plans.sql()['series_stats']})").fetchall()
    assert {r[0]: r for r in theirs} == ours
