"""Analysis of memory logs: samples by process lifetime, deltas, spikes, summaries, attribution, peaks, assessment.

A sample's target is the server or a client (by its log's name), its instance the process lifetime it states (`legacy` where
none). Deltas are taken within one instance only. Unreadable lines and lines delivered twice (same path and line) are left
out. All series are ordered by (time, path, line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Figures of a sample and where they stand.
FIGURES = {
    "pss": "$.process.os.pss_bytes",
    "pss_file": "$.process.os.pss_file_bytes",
    "stack": "$.process.main_stack_bytes",
    "allocated": "$.process.allocator.stats.allocated_bytes",
    "retained": "$.process.allocator.stats.retained_bytes",
    "connected": "$.clients.connected_count",
    "live": "$.sessions.live_count",
    "json_bytes": "$.sessions.total_json_bytes",
    "payload_bytes": "$.sessions.total_payload_text_bytes",
    "result_bytes": "$.sessions.total_tool_result_bytes",
    "blob_bytes": "$.sessions.total_large_blob_bytes",
    "attributed": "$.totals.total_attributed_bytes",
}
MB = 1 << 20


def parsed(samples: DataFrame, path: str = "path", line: str = "line_no", raw: str = "raw") -> DataFrame:
    """path, line_no, at, target, instance, kind, category and the FIGURES of each readable line, once each."""
    field = lambda p: F.get_json_object(F.col("raw"), p)
    own = samples.groupBy(F.col(path).alias("path"), F.col(line).alias("line_no")).agg(F.min(F.when(F.try_parse_json(raw).isNotNull() & F.col(raw).startswith("{"), F.col(raw))).alias("raw")).where("raw IS NOT NULL")
    target = F.when(F.col("path").contains("server-"), "server").otherwise("client")
    instance = F.when(target == "server", field("$.server.id")).otherwise(field("$.client.client_instance_id"))
    number = lambda p: F.round(field(p).try_cast("double")).cast("long")
    return own.select(
        "path", "line_no", F.coalesce(number("$.timestamp_ms"), F.lit(0)).alias("at_ms"), target.alias("target"), F.coalesce(F.nullif(instance, F.lit("")), F.lit("legacy")).alias("instance"),
        F.coalesce(field("$.kind"), F.lit("process")).alias("kind"), field("$.trigger.category").alias("category"), *(number(p).alias(n) for n, p in FIGURES.items()),
    )


def _when() -> Column:
    return F.struct("at_ms", "path", "line_no")


def latest_instances(samples: DataFrame) -> DataFrame:
    """The samples of the latest instance of each target; of equal last times the greater name."""
    per = samples.groupBy("target", "instance").agg(F.max("at_ms").alias("last"))
    best = per.groupBy("target").agg(F.max(F.struct("last", "instance")).alias("b")).select("target", "b.instance")
    return samples.join(F.broadcast(best), ["target", "instance"])  # one row per target


def inventory(samples: DataFrame) -> DataFrame:
    """target, instance, samples, first and last time, duration and number of kinds."""
    return samples.groupBy("target", "instance").agg(F.count("*").alias("samples"), F.min("at_ms").alias("first_at"), F.max("at_ms").alias("last_at"), (F.max("at_ms") - F.min("at_ms")).alias("duration_ms"), F.countDistinct("kind").alias("kinds"))


def deltas(samples: DataFrame, columns: list[str]) -> DataFrame:
    """Change of several figures from the instance's sample before, missing ones counted as 0; the first has none."""
    w = Window.partitionBy("target", "instance").orderBy("at_ms", "path", "line_no")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    own = samples.withColumn("before", F.lag("at_ms").over(w))
    return own.select("target", "instance", "path", "line_no", "at_ms", "before", *((zero(c) - F.lag(zero(c)).over(w)).alias(f"d_{c}") for c in columns)).where("before IS NOT NULL")


def spikes(samples: DataFrame, least: int) -> DataFrame:
    """Neighbours of an instance whose PSS differs by at least so many bytes."""
    w = Window.partitionBy("target", "instance").orderBy("at_ms", "path", "line_no")
    own = samples.where("pss IS NOT NULL").withColumn("delta", F.col("pss") - F.lag("pss").over(w))
    return own.where(F.abs("delta") >= least).select("target", "instance", "path", "line_no", "at_ms", "delta")


def process_summary(samples: DataFrame) -> DataFrame:
    """First, last, peak and net growth of PSS per instance."""
    own = samples.where("pss IS NOT NULL")
    peak = F.max_by(F.struct("at_ms", "category"), F.struct("pss", -F.col("at_ms")))
    return own.groupBy("target", "instance").agg(
        F.count("*").alias("samples"), F.min_by("pss", _when()).alias("first_pss"), F.max_by("pss", _when()).alias("final_pss"), F.max("pss").alias("peak_pss"), peak.alias("peak"),
        F.max_by("allocated", _when()).alias("final_allocated"),
    ).withColumns({"net_growth": F.col("final_pss") - F.col("first_pss"), "peak_growth": F.col("peak_pss") - F.col("first_pss"), "peak_at": F.col("peak.at_ms"), "peak_category": F.col("peak.category")}).drop("peak")


def population(samples: DataFrame) -> DataFrame:
    """Live sessions of an instance at first, last and most, and the allocator's growth per added session (floored)."""
    own = samples.where("live IS NOT NULL")
    first, last = F.min_by(F.struct("live", "allocated", "connected"), _when()), F.max_by(F.struct("live", "allocated", "connected"), _when())
    per = own.groupBy("target", "instance").agg(first.alias("a"), last.alias("b"), F.max("live").alias("peak_live"))
    added, grown = F.col("b.live") - F.col("a.live"), F.col("b.allocated") - F.col("a.allocated")
    each = F.when(added > 0, F.floor(F.greatest(F.lit(0), grown) / added)).cast("long")
    return per.select(
        "target", "instance", F.col("a.live").alias("first_live"), F.col("b.live").alias("final_live"), "peak_live", added.alias("added"), F.col("b.connected").alias("connected"),
        F.when(F.col("b.connected").isNotNull(), F.greatest(F.lit(0), F.col("b.live") - F.col("b.connected"))).alias("detached"),
        grown.alias("allocator_growth"), F.when(grown.isNotNull(), each).alias("growth_per_session"),
    )


def coverage(samples: DataFrame) -> DataFrame:
    """How much of the memory of an instance's last attributed sample is explained."""
    own = samples.where("live IS NOT NULL OR attributed IS NOT NULL").groupBy("target", "instance").agg(F.max_by(F.struct("pss", "pss_file", "stack", "allocated", "retained", "attributed"), _when()).alias("s")).select("target", "instance", "s.*")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    explained = zero("attributed") + zero("retained") + zero("pss_file") + zero("stack")
    ratio = lambda a, b: F.when(a.isNotNull() & F.col(b).isNotNull(), F.coalesce(F.round(a / F.nullif(F.col(b), F.lit(0)), 4), F.lit(0.0)))
    both = F.col("attributed").isNotNull() & F.col("allocated").isNotNull()
    return own.select(
        "target", "instance", "pss", "allocated", "attributed", "retained", F.when(both, F.greatest(F.lit(0), F.col("allocated") - F.col("attributed"))).alias("unattributed"),
        ratio(F.col("attributed"), "pss").alias("share_of_pss"), ratio(F.col("attributed"), "allocated").alias("share_of_heap"), F.when(F.col("pss").isNotNull(), explained).alias("explained"),
        F.when(F.col("pss").isNotNull(), F.greatest(F.lit(0), F.col("pss") - explained)).alias("unexplained"), ratio(explained, "pss").alias("explained_share"),
    )


def assessment(samples: DataFrame) -> DataFrame:
    """target, instance, cause, severity: the first cause that applies, and how grave it is."""
    own = process_summary(samples).join(population(samples), ["target", "instance"], "left").join(coverage(samples).select("target", "instance", "allocated", "attributed", "retained"), ["target", "instance"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    live, added, pss, heap, known, kept = (zero(c) for c in ("final_live", "added", "final_pss", "allocated", "attributed", "retained"))
    crowd = (live >= 128) & ((added >= 64) | (zero("detached") >= 128) | F.coalesce(live >= F.greatest(F.lit(128), F.col("connected") * 16), F.lit(False)))
    cause = (
        F.when(crowd, "runaway_live_session_population")
        .when((kept >= 256 * MB) & (pss > 0) & (kept * 4 >= pss), "allocator_retention")
        .when((heap > 0) & (known >= 512 * MB) & (known * 2 >= heap), "session_payload_growth")
        .when(heap >= 1024 * MB, "unattributed_live_heap")
        .when(pss >= 1024 * MB, "non_heap_or_mapping_growth")
        .otherwise("within_normal_operating_range")
    )
    growth = zero("net_growth")
    severity = F.when((pss >= 2048 * MB) | (growth >= 1024 * MB) | (live >= 512), "critical").when((pss >= 1024 * MB) | (growth >= 256 * MB) | (live >= 128), "warning").otherwise("healthy")
    return own.select("target", "instance", cause.alias("cause"), severity.alias("severity"))
