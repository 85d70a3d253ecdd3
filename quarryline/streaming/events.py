"""Structured Streaming variants of the event operators: dedup, daily rollup, session state, retention, validation."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarryline.common import cut
from quarryline.operators.rollups import daily_rollup, merge_rollups

#: Days an event is kept by kind; None: for good (fixed values).
RETENTION_DAYS = {"turn_end": 30, "session_start": 90, "session_end": 90, "session_crash": 180, "web_pageview": 90, "web_vital": 30, "web_error": 90, "install": None, "feedback": 365}


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder or file pattern as a stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)


def deduplicated(events: DataFrame, delay: str | None = "2 days") -> DataFrame:
    """First delivery of each event id; state is dropped when the watermark passes, without a delay never.

    With a delay, what is found depends on the order of arrival: rows behind the watermark are dropped.
    """
    if delay is None:
        return events.dropDuplicates(["event_id"])
    own = events.withColumn("arrived", F.col("received_at").cast("timestamp")).withWatermark("arrived", delay)
    return own.dropDuplicatesWithinWatermark(["event_id"]).drop("arrived")


def windowed_counts(events: DataFrame, delay: str = "2 days", width: str = "1 day") -> DataFrame:
    """Events per type and day with late rows up to the delay."""
    own = events.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", delay)
    return own.groupBy(F.window("at", width), "event").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "event", "n")


def rollup_sink(target: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: each micro-batch leaves its own increment of the rollup, under its number.

    A batch writes what it touched and nothing else; delivered twice after a failure it replaces its own increment.
    Increments merge in any order (`read_rollup`), and `compact_rollup` folds those up to a number into one.
    """

    def write(batch: DataFrame, number: int) -> None:
        daily_rollup(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write


def read_rollup(spark: SparkSession, target: str) -> DataFrame | None:
    """The rollup of all increments; None where there are none."""
    if not spark._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(target)):
        return None
    every = spark.read.option("basePath", target).parquet(f"{target}/batch=*").drop("batch")
    return merge_rollups(every, every.limit(0))


def compact_rollup(spark: SparkSession, target: str, upto: int) -> None:
    """Folds increments up to a number into that one: no batch up to it may come again (its offsets are committed)."""
    every = spark.read.option("basePath", target).parquet(f"{target}/batch=*").where(F.col("batch") <= upto).drop("batch")
    cut(merge_rollups(every, every.limit(0))).write.mode("overwrite").parquet(f"{target}/batch={upto}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(path(target)):
        number = status.getPath().getName().removeprefix("batch=")
        if number.isdigit() and int(number) < upto:
            fs.delete(status.getPath(), True)


def dual_sink(firehose: str, store: Callable[[DataFrame, int], None], failed: Callable[[int, Exception], None]) -> Callable[[DataFrame, int], None]:
    """foreachBatch: every batch to the firehose first, then to the store; a store that fails is reported and the stream
    goes on, as the firehose has the rows. A batch delivered twice replaces its own part of the firehose."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{firehose}/batch={number}")
        try:
            store(batch.sparkSession.read.parquet(f"{firehose}/batch={number}"), number)
        except Exception as error:  # whatever the store raises: the rows are safe
            failed(number, error)

    return write


ENDS = ["session_end", "session_crash"]
SESSION = ["session_id", "events", "turns", "tools", "closed_by"]


def fold_sessions(key: str, rows: pd.DataFrame, held: tuple[int, int, int]) -> tuple[pd.DataFrame, tuple[int, int, int]]:
    """Closed sessions of one id and what stays open, from its new rows and what was held open before.

    Rows in order of time form stretches: a start begins one, an end or crash closes it. All counts are grouped sums.
    """
    rows = rows.sort_values(["created_at", "id"], kind="stable")
    ends = rows["event"].isin(ENDS)
    begins = rows["event"].eq("session_start") | ends.shift(fill_value=False)
    own = pd.DataFrame({"stretch": begins.cumsum(), "turns": rows["event"].eq("turn_end"), "tools": pd.to_numeric(rows["tool_calls"]).fillna(0), "end": rows["event"].where(ends)})
    per = own.groupby("stretch").agg(events=("turns", "size"), turns=("turns", "sum"), tools=("tools", "sum"), end=("end", "last")).astype({"turns": "int64", "tools": "int64"})
    if held[0]:
        first = per.loc[0] if 0 in per.index else pd.Series({"events": 0, "turns": 0, "tools": 0, "end": None})
        per.loc[0] = [first["events"] + held[0], first["turns"] + held[1], first["tools"] + held[2], first["end"]]
        per = per.sort_index()
    closed = per["end"].notna() | (per.index < per.index.max())
    done = per[closed].assign(session_id=key)
    done["closed_by"] = done["end"].fillna("superseded")
    left = per[~closed]
    return done[SESSION], tuple(int(x) for x in left.iloc[0][["events", "turns", "tools"]]) if len(left) else (0, 0, 0)


def sessions(events: DataFrame, timeout_ms: int = 3_600_000, delay: str = "2 days") -> DataFrame:
    """Per-session accumulators, flushed when the session ends, a later start supersedes it, or event time passes
    the session's silence."""
    out = "session_id string, events long, turns long, tools long, closed_by string"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield pd.DataFrame([(key[0], *state.get, "silence")], columns=SESSION)
            state.remove()
            return
        rows = pd.concat(list(batches))
        done, held = fold_sessions(key[0], rows, state.get if state.exists else (0, 0, 0))
        if held[0]:
            state.update(held)
            silent = int(rows["at"].max().timestamp() * 1000) + timeout_ms
            state.setTimeoutTimestamp(max(silent, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield done

    own = events.select("session_id", "id", "event", "created_at", "tool_calls", F.col("created_at").cast("timestamp").alias("at")).withWatermark("at", delay)
    return own.groupBy("session_id").applyInPandasWithState(fold, out, "n long, turns long, tools long", "append", GroupStateTimeout.EventTimeTimeout)


def whole_sessions(events: DataFrame, timeout_ms: int = 3_600_000, delay_ms: int = 172_800_000) -> DataFrame:
    """What sessions() yields when all events come in one batch, whatever files they are in.

    A session start begins another stretch, an end or crash closes one; an open stretch is closed by silence once the
    latest event of all is `delay_ms` and the timeout past its last, else not given.
    """
    is_ = lambda *kinds: F.coalesce(F.col("event").isin(*kinds), F.lit(False))
    w = Window.partitionBy("session_id").orderBy(F.asc_nulls_last("created_at"), F.asc_nulls_last("id"))
    ends = is_("session_end", "session_crash")
    own = events.select("session_id", "id", "event", "created_at", "tool_calls", F.col("created_at").cast("timestamp").alias("at"))
    own = own.withColumn("ends", ends).withColumn("begins", is_("session_start") | F.coalesce(F.lag("ends").over(w), F.lit(False)))
    own = own.withColumn("stretch", F.sum(F.col("begins").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = own.groupBy("session_id", "stretch").agg(
        F.count("*").alias("events"), F.count_if(is_("turn_end")).alias("turns"), F.sum(F.coalesce(F.col("tool_calls").cast("long"), F.lit(0))).alias("tools"),
        F.max(F.when(F.col("ends"), F.col("event"))).alias("end"), F.max("at").alias("last"),
    )
    more = F.lead("stretch").over(Window.partitionBy("session_id").orderBy("stretch")).isNotNull()
    latest = events.agg((F.unix_millis(F.max(F.col("created_at").cast("timestamp"))) - delay_ms).alias("mark"))
    silent = F.coalesce(F.unix_millis("last"), F.lit(0)) + timeout_ms < F.col("mark")
    both = per.withColumn("more", more).join(F.broadcast(latest)).withColumn("closed_by", F.coalesce("end", F.when(F.col("more"), "superseded").when(silent, "silence")))
    return both.where("closed_by IS NOT NULL").select("session_id", "events", "turns", "tools", "closed_by")


def turn_totals(events: DataFrame) -> DataFrame:
    """session_id, turn, events, tools, last_at: accumulators per turn; a turn_end closes a turn, from 0 on."""
    w = Window.partitionBy("session_id").orderBy(F.asc_nulls_last("created_at"), "id").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.coalesce(F.sum(F.when(F.col("event") == "turn_end", 1).otherwise(0)).over(w), F.lit(0))
    own = events.where("session_id IS NOT NULL").withColumn("turn", turn)
    return own.groupBy("session_id", "turn").agg(F.count("*").alias("events"), F.sum(F.coalesce("tool_calls", F.lit(0))).alias("tools"), F.max("created_at").alias("last_at"))


def bounded_traces(events: DataFrame, key: str, most: int = 64) -> DataFrame:
    """Steps of each key in order, the first `most` of them, and whether there were more.

    Only the first rows of a key are gathered, so a key on a third of all rows costs no more than any other.
    """
    w = Window.partitionBy(key).orderBy("created_at", "id")
    kept = events.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most + 1)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= most, F.struct("nth", "event")))), lambda x: x["event"]).alias("steps"), (F.count("*") > most).alias("truncated"))


def emergency_days(days: dict[str, int | None], stored: int, limit: int) -> dict[str, int | None]:
    """Retention halved where the store is beyond its soft limit."""
    return {k: v if v is None or stored <= limit else v // 2 for k, v in days.items()}


def expired(events: DataFrame, now, days: dict[str, int | None] = RETENTION_DAYS, otherwise: int = 60) -> DataFrame:
    """Rows past the retention of their kind."""
    limit = F.when(F.col("event").isin([k for k, v in days.items() if v is None]), F.lit(None).cast("int"))
    for kind, n in days.items():
        if n is not None:
            limit = limit.when(F.col("event") == kind, n)
    limit = limit.otherwise(otherwise)
    return events.where(limit.isNotNull() & (F.datediff(now, F.col("created_at")) > limit))


def validated(events: DataFrame, known: list[str], cap: int = 200) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and rejected rows with the reason: unknown kind, missing id, or an over-long one."""
    reason = (
        F.when(~F.coalesce(F.col("event").isin(known), F.lit(False)), "unknown event")
        .when(F.coalesce(F.trim("telemetry_id"), F.lit("")) == "", "no id")
        .when(F.char_length("telemetry_id") > cap, "id too long")
    )
    own = events.withColumn("reason", reason)
    return own.where("reason IS NULL").drop("reason"), own.where("reason IS NOT NULL")


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What a stream yields for the files there are, as a table in the shared folder."""
    name = f"{folder}/{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{name}/out").option("checkpointLocation", f"{name}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{name}/out")


def run_sessions(stream: DataFrame, folder: str) -> DataFrame:
    """Sessions of all files there are: batches are kept as they come, then folded in order of time."""
    own = stream.select("session_id", "id", "event", "created_at", "tool_calls")
    return whole_sessions(run_once(own, folder))


def run_rollup(stream: DataFrame, folder: str) -> DataFrame:
    name = f"{folder}/{uuid.uuid4().hex}"
    query = stream.writeStream.foreachBatch(rollup_sink(f"{name}/rollup")).option("checkpointLocation", f"{name}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = read_rollup(stream.sparkSession, f"{name}/rollup")
    return daily_rollup(stream.sparkSession.createDataFrame([], stream.schema)) if found is None else found
