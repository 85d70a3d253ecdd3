"""Distinct counts by linear counting: hashed bits in fixed bitmaps, merged by bitwise union.

A bitmap of m bits is kept as its non-empty 64-bit words, so small sets stay small and a union is a bit_or per word.
m is a power of two, the least whose standard error at the largest possible set (the rows read) is within the target:
sqrt(m (e^t - t - 1)) / n at n members, t = n / m; smaller sets err less. The estimate is -m ln(empty bits / m).
Partials of days, files or groups merge exactly, in any order; each carries its m, and of different ones the larger are
folded to the smallest (a power of two divides the next, so a bit's place is its place modulo the smaller m).

Null and blank identifiers are no members; null keys are a value of their own, '(unknown)'. An empty table gives no
rows. A bitmap without an empty bit is counted as if it had one (and marked `saturated`).
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relative_error(n: float, m: int) -> float:
    """Standard error of the estimate of n members in m bits, as a share of n."""
    t = n / m
    return math.inf if t > 60 else math.sqrt(m * (math.exp(t) - t - 1)) / n


def bitmap_bits(most: int, target: float) -> int:
    """The least power of two, from 2^12 on, that keeps the error of sets of up to `most` members within the target."""
    m = 1 << 12
    while relative_error(max(1, most), m) > target:
        m *= 2
    return m


def partial_bitmaps(df: DataFrame, keys: list[str], member: Column, m: int) -> DataFrame:
    """keys, word, bits: the non-empty words of a bitmap per combination of keys."""
    at = F.pmod(F.conv(F.substring(F.md5(member.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(m))
    own = df.where(member.isNotNull() & (F.trim(member) != "")).select(*keys, at.alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    return own.groupBy(*keys, F.expr("at div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))


def fold_bitmaps(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Partials with their bitmap_bits, runs of any size, in the smallest bitmap among them."""
    least = partials.agg(F.min("bitmap_bits").alias("least"))
    own = partials.join(F.broadcast(least)).withColumn("word", F.expr("word % (least div 64)"))
    return own.groupBy(*keys, "word", F.col("least").alias("bitmap_bits")).agg(F.bit_or("bits").alias("bits"))


def union_bitmaps(partials: DataFrame, keys: list[str]) -> DataFrame:
    if "bitmap_bits" in partials.columns:
        return fold_bitmaps(partials, keys)
    return partials.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))


def cube_bitmaps(partials: DataFrame, fixed: list[str], keys: list[str], every: str = "(all)") -> DataFrame:
    """Unions for every combination of `keys`, left-out ones marked `every`."""
    sets = [[*fixed, "word", *c] for n in range(len(keys) + 1) for c in combinations(keys, n)]
    cube = partials.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in [*fixed, "word", *keys])).agg(F.bit_or("bits").alias("bits"))
    return cube.select(*fixed, "word", "bits", *(F.coalesce(F.col(k).cast("string"), F.lit(every)).alias(k) for k in keys))


def estimates(bitmaps: DataFrame, keys: list[str], m: int) -> DataFrame:
    """keys, estimate, bits_set, bitmap_bits, standard_error (a share of the estimate), saturated."""
    ones = bitmaps.groupBy(*keys).agg(F.sum(F.bit_count("bits")).cast("long").alias("bits_set"))
    n = -F.lit(float(m)) * F.log((F.lit(float(m)) - F.least(F.col("bits_set"), F.lit(m - 1))) / F.lit(float(m)))
    t = F.col("estimate") / F.lit(float(m))
    error = F.when(F.col("estimate") > 0, F.sqrt(F.greatest(F.lit(0.0), F.lit(float(m)) * (F.exp(t) - t - 1))) / F.col("estimate"))
    return (
        ones.withColumn("estimate", n)
        .withColumn("bitmap_bits", F.lit(m).cast("long"))
        .withColumn("standard_error", F.round(error, 6))
        .withColumn("saturated", F.col("bits_set") >= m)
        .withColumn("estimate", F.round("estimate", 3))
    )


def _os_name(c: Column) -> Column:
    own = F.lower(F.trim(c))
    own = F.when(own.isin("darwin", "mac", "mac os", "os x"), "macos").otherwise(own)
    return F.coalesce(F.when(own != "", own), F.lit("(unknown)"))


def _day(c: str) -> Column:
    return F.coalesce(F.to_date(c).cast("string"), F.lit("(unknown)")).alias("day")


def active_members(telemetry: DataFrame, web: DataFrame) -> DataFrame:
    """kind, day, version, os, member: installations of all events, and visitors of web events.

    A visitor's version and os are those of the web event's own telemetry row (null where there is none); the day of an
    installation is the event's, that of a visitor the one the web record was received on.
    """
    from quarryline.common import uuid_key
    from quarryline.llm.percentiles import version_name

    events = telemetry.select(
        F.lit("telemetry_id").alias("kind"), _day("created_at"), version_name(F.col("version")).alias("version"), _os_name(F.col("os")).alias("os"), uuid_key(F.col("telemetry_id")).alias("member")
    )
    sources = telemetry.select(uuid_key(F.col("event_id")).alias("key"), version_name(F.col("version")).alias("version"), _os_name(F.col("os")).alias("os"))
    keyed = web.select(uuid_key(F.col("event_id")).alias("key"), _day("received_at"), uuid_key(F.col("visitor_id")).alias("member")).where("member is not null")
    # Only events that web records name: one row per key, before and after a semi-join reduced shuffle.
    known = sources.where("key is not null").join(keyed.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("version").alias("version"), F.min("os").alias("os"))
    unknown = F.lit("(unknown)")
    visitors = keyed.join(known, "key", "left").select(
        F.lit("visitor_id").alias("kind"), "day", F.coalesce("version", unknown).alias("version"), F.coalesce("os", unknown).alias("os"), "member"
    )
    return events.unionByName(visitors)


def distinct_members(telemetry: DataFrame, web: DataFrame, target: float = 0.01, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Daily partial bitmaps, and the estimates of every combination of day, version and os.

    `bits` (a power of two, 2^12 at least) sizes the bitmaps of a series of runs alike: take `bitmap_bits` of the largest
    set the series is to hold. Without it they are sized for the rows of this run; partials carry their size either way,
    and `union_bitmaps` folds larger ones.
    """
    if bits is not None and (bits < 1 << 12 or bits & (bits - 1)):
        raise ValueError("bits must be a power of two from 4096 on")
    # Row counts stand in the Parquet footers.
    m = bits or bitmap_bits(telemetry.count() + web.count(), target)
    partials = partial_bitmaps(active_members(telemetry, web), ["kind", "day", "version", "os"], F.col("member"), m)
    keys = ["day", "version", "os"]
    return partials.withColumn("bitmap_bits", F.lit(m).cast("long")), estimates(cube_bitmaps(partials, ["kind"], keys), ["kind", *keys], m)
