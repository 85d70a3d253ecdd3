"""Ordered-series operators: streaks, gaps, spikes, trailing counts, concurrency, caps per group, timelines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def epoch_us(c: str | Column) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def epoch_ms(c: str | Column) -> Column:
    """To the nearest millisecond, halves away from the epoch, as SQL's epoch_ms; unix_millis would round down."""
    us = epoch_us(c)
    return F.call_function("div", us + F.when(us < 0, -500).otherwise(500), F.lit(1000))


def streaks(days: DataFrame, key: str, day: str) -> DataFrame:
    """Runs of consecutive days (gaps and islands): one row per key and run."""
    own = days.select(key, day).distinct()
    nth = F.row_number().over(Window.partitionBy(key).orderBy(day))
    runs = own.withColumn("island", F.date_sub(F.col(day), nth))
    return runs.groupBy(key, "island").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("days")).drop("island")


def streak_summary(days: DataFrame, key: str, day: str, today: Column) -> DataFrame:
    """Longest run, and the current one: the run that reaches today or yesterday, else 0."""
    s = streaks(days, key, day)
    return s.groupBy(key).agg(
        F.max("days").alias("longest"), F.coalesce(F.max(F.when(F.col("last_day") >= F.date_sub(today, 1), F.col("days"))), F.lit(0)).alias("current"), F.sum("days").alias("active_days")
    )


def _join_stretches(rows: DataFrame, carried: DataFrame, key: str) -> DataFrame:
    """Rows with what is carried into their stretch (key, __stretch); null keys and times match each other."""
    other = carried.withColumnsRenamed({key: "__key", "__stretch": "__at"})
    return rows.join(other, F.col(key).eqNullSafe(F.col("__key")) & F.col("__stretch").eqNullSafe(F.col("__at")), "left").drop("__key", "__at")


def lagged(df: DataFrame, key: str, at: str, tie: str, **columns: Column) -> DataFrame:
    """The rows with each column's value at the key's previous row (by time, then tie).

    A key's days are ordered apart from each other, so a key with a third of all rows is many tasks; the first row of a
    day takes the last values of the day before it, of which there is one row per key and day.
    """
    own = df.withColumn("__stretch", F.to_date(at)).withColumn("__v", F.struct(*(c.alias(n) for n, c in columns.items())))
    last = own.groupBy(key, "__stretch").agg(F.max_by("__v", F.struct(at, tie)).alias("__l"))
    carried = last.select(key, "__stretch", F.lag("__l").over(Window.partitionBy(key).orderBy("__stretch")).alias("__c"))
    inside = own.withColumn("__p", F.lag("__v").over(Window.partitionBy(key, "__stretch").orderBy(at, tie)))
    both = _join_stretches(inside, carried, key).withColumn("__p", F.coalesce("__p", "__c"))
    return both.select("*", *(F.col("__p")[n].alias(n) for n in columns)).drop("__stretch", "__v", "__p", "__c")


def running_sum(df: DataFrame, key: str, at: str, tie: str, name: str, value: Column) -> DataFrame:
    """The rows with the sum of a column over the key's rows up to each one, day by day like `lagged`."""
    own = df.withColumn("__stretch", F.to_date(at)).withColumn("__v", value)
    total = own.groupBy(key, "__stretch").agg(F.sum("__v").alias("__t"))
    carried = total.select(key, "__stretch", F.coalesce(F.sum("__t").over(Window.partitionBy(key).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__c"))
    inside = own.withColumn(name, F.sum("__v").over(Window.partitionBy(key, "__stretch").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)))
    both = _join_stretches(inside, carried, key)
    return both.withColumn(name, F.coalesce(name, F.lit(0)) + F.col("__c")).drop("__stretch", "__v", "__c")


def gaps(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Seconds since the key's previous row."""
    return lagged(df, key, at, tie, __before=epoch_us(at)).withColumn("gap_secs", (epoch_us(at) - F.col("__before")) / 1e6).drop("__before")


def trailing_count(df: DataFrame, key: str, at: str, seconds: int, name: str) -> DataFrame:
    """Rows of the key in the trailing window, the row itself included.

    Time is cut into stretches as long as the window: a row also stands, as an echo, in the next one, so that each
    stretch is counted by itself and a key with a third of all rows is many tasks. Rows without a time count none.
    """
    secs = F.unix_seconds(F.col(at).cast("timestamp"))
    own = df.withColumn("__s", secs).withColumn("__stretch", F.floor(secs / seconds))
    echo = F.explode(F.when(F.col("__s").isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    both = own.withColumn("__echo", echo).withColumn("__stretch", F.col("__stretch") + F.col("__echo"))
    w = Window.partitionBy(key, "__stretch").orderBy("__s").rangeBetween(-seconds + 1, 0)
    return both.withColumn(name, F.count("__s").over(w)).where("__echo = 0").drop("__s", "__stretch", "__echo")


def spikes(df: DataFrame, key: str, at: str, tie: str, value: str, threshold: float) -> DataFrame:
    """Rows whose value differs from the key's previous one by at least the threshold."""
    before = lagged(df, key, at, tie, __before=F.col(value))
    return before.withColumn("delta", F.col(value) - F.col("__before")).drop("__before").where(F.abs("delta") >= threshold)


def concurrency(intervals: DataFrame, key: str, start: str, end: str, bucket: str) -> DataFrame:
    """Highest number of open intervals per bucket of time, at the moments an interval starts.

    Only per-bucket sums of openings and closings meet in one ordered window; the running sum inside a bucket is
    partitioned by it.
    """
    moves = intervals.select(F.col(start).alias("t"), F.lit(1).alias("d"), F.col(key).alias("k")).unionByName(intervals.select(F.col(end).alias("t"), F.lit(-1).alias("d"), F.col(key).alias("k")))
    moves = moves.where("t is not null").withColumn("bucket", F.date_trunc(bucket, "t"))
    net = moves.groupBy("bucket").agg(F.sum("d").alias("net"))
    # One row per bucket of time: its number grows with the span covered, not with the rows.
    carried = net.select("bucket", F.coalesce(F.sum("net").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carried"))
    inside = Window.partitionBy("bucket").orderBy("t", "d", "k").rowsBetween(Window.unboundedPreceding, 0)
    run = moves.withColumn("run", F.sum("d").over(inside)).where("d = 1").groupBy("bucket").agg(F.max("run").alias("peak"))
    return run.join(carried, "bucket").select("bucket", (F.col("peak") + F.col("carried")).alias("peak"))


def cap_per_group(df: DataFrame, group: list[str], order: list[Column], cap: int) -> DataFrame:
    """At most `cap` rows of each group, the first by `order`."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__nth") <= cap).drop("__nth")


def neighbours(df: DataFrame, key: str, at: str, value: str, k: int) -> DataFrame:
    """Each row with the values of the `k` rows before and after it by position."""
    w = Window.partitionBy(key).orderBy(at)
    return df.withColumn("before", F.collect_list(value).over(w.rowsBetween(-k, -1))).withColumn("after", F.collect_list(value).over(w.rowsBetween(1, k)))


def timeline(df: DataFrame, key: str, at: str, tie: str, cap_secs: float) -> DataFrame:
    """Offsets from the key's first row, idle gaps cut to `cap_secs`."""
    own = gaps(df, key, at, tie)
    return running_sum(own, key, at, tie, "offset_secs", F.least(F.coalesce("gap_secs", F.lit(0.0)), F.lit(cap_secs))).drop("gap_secs")


#: Parts a group's distinct values are cut into, by an approximate quantile sketch, before ranks are looked for in one.
PARTS = 32


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys, n and the value at each zero-based rank (a function of n) among the group's values in order; exact.

    No group is gathered: rows become counts per distinct value, a mergeable sketch cuts a group's values into PARTS
    ranges, counts per range tell which of them holds a rank, and only the values of those ranges are put in order, a range
    at a time. A value repeated any number of times is one row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    per = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"), F.percentile_approx("__v", [i / PARTS for i in range(1, PARTS)], 1000).alias("__cuts"))
    part = sum((F.when(F.col("__cuts")[i] < F.col("__v"), 1).otherwise(0) for i in range(PARTS - 1)), F.lit(0))
    placed = counts.join(per, keys).select(*keys, "__v", "__c", "__n", part.alias("__part"))
    parts = placed.groupBy(*keys, "__part").agg(F.sum("__c").alias("__c"), F.first("__n").alias("__n"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("__before", before)  # at most PARTS rows a group
    wanted = F.array(*(F.struct(F.lit(k).alias("name"), f(F.col("__n")).cast("long").alias("rank")) for k, f in ranks.items()))
    inside = parts.withColumn("__w", F.filter(wanted, lambda w: (w["rank"] >= F.col("__before")) & (w["rank"] < F.col("__before") + F.col("__c")))).where(F.size("__w") > 0)
    rows = placed.select(*keys, "__part", "__v", F.col("__c").alias("__m")).join(inside.select(*keys, "__part", "__n", "__before", "__w"), [*keys, "__part"])
    upto = F.col("__before") + F.sum("__m").over(Window.partitionBy(*keys, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    hits = rows.withColumn("__upto", upto).select(*keys, "__n", "__v", F.explode(F.filter("__w", lambda w: (w["rank"] < F.col("__upto")) & (w["rank"] >= F.col("__upto") - F.col("__m")))).alias("__w"))
    return hits.groupBy(*keys).agg(F.first("__n").alias("n"), *(F.max(F.when(F.col("__w.name") == k, F.col("__v"))).alias(k) for k in ranks))


def nearest_rank(df: DataFrame, keys: list[str], value: str, ps: list[float]) -> DataFrame:
    """sorted[round((n - 1) p)] per group."""
    at = lambda p: lambda n: F.floor((n - 1) * p + 0.5)
    return order_statistics(df, keys, value, {f"p{round(p * 100)}": at(p) for p in ps})


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median: the middle value, or the mean of the two in the middle."""
    both = order_statistics(df, keys, value, {"__low": lambda n: F.floor((n - 1) / 2), "__high": lambda n: F.floor(n / 2)})
    return both.select(*keys, ((F.col("__low") + F.col("__high")) / 2).alias("median"))


def series_stats(df: DataFrame, key: str, at: str, tie: str, value: str, width_ms: int) -> DataFrame:
    """Per series: events, mean and most of a chunk, mean and longest gap, span, and variation and most of time buckets.

    Buckets are `width_ms` wide from the first event on, at least two; empty ones count as 0 without being made: sums over
    the buckets that have events are divided by the number there are.
    """
    ms = epoch_ms(at)
    own = df.select(F.col(key), F.col(value).alias("v"), ms.alias("t"), (ms - F.lag(ms).over(Window.partitionBy(key).orderBy(at, tie))).alias("gap"))
    s = own.groupBy(key).agg(F.count("*").alias("events"), F.round(F.avg("v"), 6).alias("mean_chunk"), F.max("v").alias("max_chunk"), F.round(F.avg("gap"), 3).alias("mean_gap_ms"), F.max("gap").alias("max_gap_ms"), F.min("t").alias("t0"), (F.max("t") - F.min("t")).alias("span_ms"))
    s = s.withColumn("n", F.greatest(F.floor(F.col("span_ms") / width_ms), F.lit(1)) + 1)
    b = own.join(s.select(key, "t0", "n"), key).groupBy(key, "n", F.least(F.floor((F.col("t") - F.col("t0")) / width_ms), F.col("n") - 1).alias("k")).agg(F.sum("v").alias("v"))
    c = b.groupBy(key).agg((F.sum("v") / F.first("n")).alias("m"), (F.sum(F.col("v") * F.col("v")) / F.first("n")).alias("q"), F.max("v").alias("top"))
    spread = F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0)))
    variation = F.when(F.col("m") == 0, 0.0).otherwise(spread / F.nullif("m", F.lit(0.0)))
    return s.join(c, key).select(key, "events", "mean_chunk", "max_chunk", "mean_gap_ms", "max_gap_ms", "span_ms", F.round(variation, 6).alias("bucket_variation"), F.round(F.greatest(F.col("top"), F.lit(0.0)), 6).alias("bucket_max"))


def safe_cuts(results: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """key, cut: the greatest place up to the wanted one where a sequence may be cut without parting a result from its call.

    results: key, call (place of the call, null: there is none), place of the result, from 0 on. wanted: key, cut. Cutting
    before place c parts a pair if call < c <= result; overlapping pairs are joined to stretches, and a cut within one
    moves to its beginning (0 where a call is missing).
    """
    pairs = results.select(key, F.coalesce("call", F.lit(0)).cast("long").alias("a"), F.col("place").cast("long").alias("b")).where("a < b OR b = 0")
    w = Window.partitionBy(key).orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("a") > reach, F.lit(True)).cast("int")
    stretch = pairs.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stretch = stretch.groupBy(key, "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    inside = wanted.join(stretch, key).where((F.col("a") < F.col("cut")) & (F.col("cut") <= F.col("b"))).select(key, F.col("a").alias("moved"))
    return wanted.join(inside, key, "left").select(key, F.coalesce("moved", "cut").alias("cut"))
