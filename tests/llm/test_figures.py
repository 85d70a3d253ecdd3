"""Percentiles, distinct counts, packing and mixing against brute force."""

import bisect
import datetime
import math
import random

import pytest

from quarryline.llm import distinct, mixing, packing, percentiles, queries, tokens
from tests.compare import DATA, check, connect

con = connect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    check(queries.QUERIES[name](spark, DATA), queries.SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def events(spark, n=2000):
    r = random.Random(9)
    rows = [(i, datetime.datetime(2026, 3, r.randint(1, 5)), "hot" if r.random() < 0.4 else r.choice(["v1.0", "1.0", None, "", "2"]), r.choice([None, -5, 0, 7, 7, 7, r.randint(0, 10**7)])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, created_at timestamp_ntz, version string, ms int").selectExpr("*", "1 AS cell", "2 AS n", "'x' AS grp")


def test_percentiles_are_within_their_error(spark):
    rows, df = events(spark)
    found = percentiles.version_percentiles(df, ["ms"], [0.01, 0.5, 0.99]).collect()
    by = {}
    for _, day, v, x in rows:
        if x is not None:
            name = {"v1.0": "1.0", None: "(unknown)", "": "(unknown)"}.get(v, v)
            for period in ("(all)", day.date().isoformat()):
                by.setdefault((period, name), []).append(x)
    assert len(found) == 3 * len(by)
    for r in found:
        values = sorted(by[r["period"], r["version"]])
        true = values[max(1, math.ceil(r["percentile"] * len(values) - 1e-9)) - 1]
        assert r["lower"] <= true <= r["upper"] and abs(r["estimate"] - true) <= r["max_error"] <= abs(true) / 128


def test_select_in_turns_and_blocks(spark, monkeypatch):
    r = random.Random(1)
    rows = [(r.choice("abcdefg"), r.randint(-50, 50), r.randint(1, 4)) for _ in range(500)]
    cells = spark.createDataFrame(rows, "grp string, cell long, n long").repartition(6)
    monkeypatch.setattr(percentiles, "MAX_TARGETS", 5)
    for x in percentiles.select_ranks(cells, [0.5, 0.9]).collect():
        values = sorted(c for g, c, n in rows if g == x["grp"] for _ in range(n))
        assert x["cell"] == values[math.ceil(x["percentile"] * len(values) - 1e-9) - 1]


def test_percentiles_of_nothing(spark):
    assert percentiles.version_percentiles(events(spark)[1].limit(0), ["ms"], [0.5]).count() == 0


def test_distinct_estimates_and_merging(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), f"id{r.randint(0, 20_000)}" if r.random() < 0.6 else r.choice(["hot", "", None])) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "k string, m string").selectExpr("coalesce(k, '(unknown)') AS k", "m", "1 AS word", "2 AS bits")
    m = distinct.bitmap_bits(len(rows), 0.01)
    parts = distinct.partial_bitmaps(df, ["k"], df["m"], m)
    twice = distinct.union_bitmaps(parts.unionByName(parts), ["k"])
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, parts.collect()))
    found = {x["k"]: x for x in distinct.estimates(distinct.cube_bitmaps(parts, [], ["k"]), ["k"], m).collect()}
    for k in ("a", "b", "(unknown)", "(all)"):
        true = len({i for g, i in rows if i and (k == "(all)" or (g or "(unknown)") == k)})
        assert abs(found[k]["estimate"] - true) <= 4 * max(found[k]["standard_error"], 0.001) * true
        assert found[k]["standard_error"] <= 0.01
    assert distinct.estimates(distinct.cube_bitmaps(parts.limit(0), [], ["k"]), ["k"], m).count() == 0


def test_partials_of_runs_of_different_size(spark):
    ids = spark.range(3000).selectExpr("'a' AS k", "concat('id', id) AS m")
    parts = lambda df, m: distinct.partial_bitmaps(df, ["k"], df["m"], m).selectExpr("*", f"{m}L AS bitmap_bits")
    both = distinct.union_bitmaps(parts(ids.limit(2000), 1 << 14).unionByName(parts(ids, 1 << 16)), ["k"])
    assert sorted(map(tuple, both.select("k", "word", "bits", "bitmap_bits").collect())) == sorted(map(tuple, parts(ids, 1 << 14).select("k", "word", "bits", "bitmap_bits").collect()))


def test_daily_partials_carry_their_size(spark):
    most = sum(spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("telemetry_events", "web_details"))
    found = queries.QUERIES["p7_daily_partials"](spark, DATA).select("bitmap_bits").distinct().collect()
    assert [r[0] for r in found] == [distinct.bitmap_bits(most, 0.01)]


def documents(spark, texts):
    rows = [(i, t, s) for i, (t, s) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS n_tokens", "2 AS pack", "3 AS slice")


def test_token_sizes():
    c = tokens.counter(tokens.default_tokenizer())
    r = random.Random(3)
    for _ in range(300):
        t = "".join(r.choice(["word", " ", "  ", "\n", "\t", "1234", "é", "漢字", "'s", "<|endoftext|>", "...", "\x1c", "½", "🙂", "x" * 70]) for _ in range(r.randint(0, 30)))
        assert c.size(t) == len(c.encode(t))
    assert c.size(None) == c.size("") == 0


def brute_bins(sizes, capacity):
    left = []
    for x in sorted(sizes, reverse=True):
        i = bisect.bisect_left(left, x)
        rest = (left.pop(i) if i < len(left) else capacity) - x
        bisect.insort(left, rest)
    return left


def test_plan_is_best_fit_decreasing():
    r = random.Random(4)
    for _ in range(200):
        capacity = r.choice([1, 7, 64, 300])
        sizes = [r.randint(1, capacity) for _ in range(r.randint(0, 200))]
        histogram = {}
        for s in sizes:
            histogram[s] = histogram.get(s, 0) + 1
        steps, opened = packing.best_fit_decreasing(histogram, capacity)
        fill = [0] * opened
        for size, _, n, first, each in steps:
            for k in range(n):
                fill[first + k // each] += size
        assert sorted(capacity - f for f in fill) == brute_bins(sizes, capacity)


def test_packing(spark):
    r = random.Random(5)
    texts = [(None, "a"), ("", "a"), (" ", None), *[(" ".join(["tok"] * (40 if r.random() < 0.35 else r.randint(1, 150))), r.choice(["a", "A ", "b"])) for _ in range(400)], ("word " * 3000, "b")]
    sizes = tokens.token_counts(documents(spark, texts).repartition(5))
    packs = spark.createDataFrame([(1, 64, None), (2, 100, "a"), (3, 50, "none"), (4, None, None)], "pack_id int, capacity_tokens int, source string")
    n = {x["doc_id"]: (x["n_tokens"], x["source"]) for x in sizes.collect()}
    placed = packing.pack(sizes, packs).collect()
    for pack, capacity, own in ((1, 64, None), (2, 100, "a")):
        mine = [x for x in placed if x["pack_id"] == pack]
        by, fill = {}, {}
        for x in mine:
            by.setdefault(x["doc_id"], []).append(x)
            if x["n_tokens"]:
                fill[x["container_id"]] = fill.get(x["container_id"], 0) + x["n_tokens"]
            else:
                assert x["container_id"] is None
        assert by.keys() == {d for d, (_, s) in n.items() if own is None or s == own}
        items = []
        for doc, pieces in by.items():
            pieces.sort(key=lambda x: x["piece_no"])
            assert sum(x["n_tokens"] for x in pieces) == n[doc][0]
            assert [x["start_token"] for x in pieces] == [capacity * k for k in range(len(pieces))]
            assert len(pieces) == max(1, -(-n[doc][0] // capacity))
            items += [x["n_tokens"] for x in pieces if x["n_tokens"]]
        assert sorted(capacity - f for f in fill.values()) == brute_bins(items, capacity)
        assert set(fill) == set(range(len(fill)))
    assert not [x for x in placed if x["pack_id"] in (3, 4)]
    assert packing.pack(sizes.limit(0), packs).count() == 0
    assert packing.pack(sizes, packs.limit(0)).count() == 0


def test_mixing(spark):
    r = random.Random(6)
    texts = [(" ".join(["tok"] * r.randint(1, 60)), r.choice(["big"] * 8 + ["Mid-One"] * 3 + ["small"])) for _ in range(1500)] + [(None, "big"), ("x", None), ("", "small")]
    sizes = tokens.token_counts(documents(spark, texts))
    targets = spark.createDataFrame([(1, "big", 0.5, 1), (1, "mid_one", 0.3, 2), (1, "small", 0.4, 5), (1, "gone", 0.2, 3), (2, "small", 1.0, None), (3, "gone", 1.0, 1)], "mix_id int, source string, target_share double, max_repeats int")
    rows, report = mixing.mix(sizes, targets)
    caps = {(1, "big"): 1, (1, "mid_one"): 2, (1, "small"): 5, (2, "small"): 10**9}
    for x in rows.groupBy("mix_id", "doc_id", "source").count().collect():
        assert x["count"] <= caps[x["mix_id"], x["source"]]
    found = {(x["mix_id"], x["source"]): x for x in report.collect()}
    for s, share in (("big", 0.5), ("mid_one", 0.3), ("small", 0.4)):
        assert abs(found[1, s]["actual_share"] - share / 1.2) < 0.01
    assert found[1, "gone"]["tokens"] == found[3, "gone"]["tokens"] == 0 and found[2, "small"]["actual_share"] == 1
    assert mixing.mix(sizes, targets)[0].collect() == rows.collect()  # the seed decides
    assert mixing.mix(sizes.limit(0), targets)[0].count() == 0
    assert mixing.mix(sizes, targets.limit(0))[1].count() == 0


def test_mean_of_drawn_numbers():
    r = random.Random(8)
    for mean in (0.001, 0.7, 3.0, 40.0, 2000.0):
        for cap in (None, 1, 50):
            u = [r.random() for _ in range(50)]
            for x, got in zip(u, mixing.copies_of(mixing.np.array(u), mean, cap).tolist(), strict=True):
                k, p, total = 0, -mean, 0.0
                while True:
                    total += math.exp(p)
                    if x < total or k > 4000:
                        break
                    k += 1
                    p += math.log(mean / k)
                assert got == (k if cap is None else min(k, cap))


def test_tiny_and_uncapped_shares(spark):
    """A share of 1e-5 takes documents of its source, and a source without cap repeats as often as it must."""
    r = random.Random(12)
    rows = [(i, "big", r.randint(1, 400)) for i in range(20_000)] + [(10**6 + i, "small", 3) for i in range(5)] + [(2 * 10**6, "rest", 5)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int")
    whole = sum(n for _, s, n in rows if s == "big")
    targets = spark.createDataFrame([(1, "big", 1e-3, None), (1, "small", 1 - 1e-3, None), (2, "small", 0.5, 1), (2, "big", 0.5, 1), (3, "big", 0.02, None), (3, "rest", 0.98, None)], "mix_id int, source string, target_share double, max_repeats int")
    found = {(x["mix_id"], x["source"]): x for x in mixing.mix(sizes, targets)[1].collect()}
    assert abs(found[1, "big"]["tokens"] - 1e-3 * (whole + 15)) <= 400
    assert abs(found[1, "small"]["actual_share"] - 0.999) < 1e-3 and found[1, "small"]["most_repeats"] > 600
    assert found[2, "small"]["tokens"] == 15 and 0 < found[2, "big"]["tokens"] <= 400
    assert abs(found[3, "big"]["actual_share"] - 0.02) < 1e-3


def test_packing_at_the_largest_capacity(spark):
    sizes = spark.createDataFrame([(1, "a", 3_000_000), (2, "a", 5), (3, "b", 5), (4, "b", packing.MAX_CAPACITY)], "doc_id long, source string, n_tokens int")
    packs = spark.createDataFrame([(i, packing.MAX_CAPACITY - i, None) for i in range(40)], "pack_id int, capacity_tokens int, source string")
    placed = packing.pack(sizes, packs).collect()
    assert {x["pack_id"] for x in placed} == set(range(40))
    for p in range(40):
        mine = [x for x in placed if x["pack_id"] == p]
        fill = {}
        for x in mine:
            fill[x["container_id"]] = fill.get(x["container_id"], 0) + x["n_tokens"]
        assert sum(fill.values()) == 3_000_010 + packing.MAX_CAPACITY and max(fill.values()) <= packing.MAX_CAPACITY - p


def test_bitmaps_of_a_set_size(spark):
    web, events_ = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("web_details", "telemetry_events"))
    assert [r[0] for r in distinct.distinct_members(events_, web, bits=1 << 15)[0].select("bitmap_bits").distinct().collect()] == [1 << 15]
    with pytest.raises(ValueError):
        distinct.distinct_members(events_, web, bits=5000)
