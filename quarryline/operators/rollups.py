"""Daily activity rollups: built from events, merged with increments, and read back in place of raw events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIFECYCLE = ("session_start", "turn_end", "session_end", "session_crash")
ENDED = ("session_end", "session_crash")
RELEASE = ("release", "ci_release")


def flag(c: Column) -> Column:
    """1 where true, else 0 (also for null)."""
    return F.when(c, 1).otherwise(0)


#: What shows that a session that ended, or a turn, was used (fixed values).
USED = {
    "ended": "turns had_user_prompt had_assistant_response assistant_responses tool_calls executed_tool_calls duration_secs error_provider_timeout error_auth_failed error_tool_error error_mcp_error error_rate_limited provider_switches model_switches".split(),
    "turn_end": "assistant_responses tool_calls executed_tool_calls file_write_calls tests_run turn_success".split(),
}


def meaningful_of(columns: list[str]) -> Column:
    """Whether an event shows real activity, by all of the measures that the table has; null measures show none."""
    any_ = lambda names: reduce(lambda a, n: a | (F.coalesce(F.col(n), F.lit(0)) > 0), [n for n in names if n in columns], F.lit(False))
    return (F.col("event").isin(*ENDED) & any_(USED["ended"])) | ((F.col("event") == "turn_end") & any_(USED["turn_end"]))


def meaningful(turns: str = "turns", tools: str = "tool_calls", secs: str = "duration_secs") -> Column:
    """Whether an event shows real activity; a null measure is none."""
    ended = F.col("event").isin(*ENDED) & ((F.col(turns) > 0) | (F.col(tools) > 0) | (F.col(secs) > 0))
    return ended | ((F.col("event") == "turn_end") & (F.col(tools) > 0))


def daily_rollup(events: DataFrame) -> DataFrame:
    """One row per (day, id): flags by max, counters by sum, first and last by min and max."""
    real, release = meaningful(), F.col("build_channel").isin(*RELEASE)
    count = lambda e: F.sum(flag(F.col("event") == e)).alias(f"{e}_count")
    return (
        events.where(F.col("event").isin(*LIFECYCLE))
        .groupBy(F.to_date("created_at").alias("activity_date"), "telemetry_id")
        .agg(
            F.min("created_at").alias("first_seen_at"),
            F.max("created_at").alias("last_seen_at"),
            F.max(flag(real)).alias("meaningful_active"),
            F.max(flag(release)).alias("release_active"),
            F.max(flag(release & real)).alias("meaningful_release_active"),
            *(count(e) for e in LIFECYCLE),
            F.max("is_ci").alias("last_is_ci"),
            F.max("build_channel").alias("last_build_channel"),
        )
    )


def merge_rollups(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of an increment: earliest first, latest last, flags and labels by max, counters added.

    Every merge is associative, so increments may come in any order and rebuild the rollup of all events.
    """
    both = old.unionByName(new)
    summed = [F.sum(f"{e}_count").alias(f"{e}_count") for e in LIFECYCLE]
    highest = [F.max(c).alias(c) for c in ("last_seen_at", "meaningful_active", "release_active", "meaningful_release_active", "last_is_ci", "last_build_channel")]
    return both.groupBy("activity_date", "telemetry_id").agg(F.min("first_seen_at").alias("first_seen_at"), *highest, *summed)
