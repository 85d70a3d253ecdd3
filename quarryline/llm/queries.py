"""Queries of problems 4, 5, 7, 8, 9 and 10, with production parameters on whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.common import table
from quarryline.llm import distinct, mixing, mojibake, packing, percentiles, pii, tokens

METRICS = ["first_assistant_response_ms", "first_tool_call_ms", "duration_secs"]
PERCENTILES = [0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.version_percentiles(table(spark, sf_dir, "telemetry_events"), METRICS, PERCENTILES)


def p4_daily_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "telemetry_events")
    parts = percentiles.daily_partials(events, F.to_date("created_at"), percentiles.version_name(F.col("version")), METRICS)
    return parts.withColumnRenamed("grp", "version")


_VERSION = """coalesce(nullif(regexp_replace(lower(trim(version)), '^v([0-9])', '\\1'), ''), '(unknown)')"""
_CELLS = f"""
WITH vals AS (
  SELECT created_at::DATE AS day, {_VERSION} AS version, unnest(['first_assistant_response_ms', 'first_tool_call_ms', 'duration_secs']) AS metric,
         unnest([first_assistant_response_ms, first_tool_call_ms, duration_secs])::BIGINT AS value
  FROM telemetry_events
), shifted AS (
  SELECT *, greatest(length(bin(abs(value))) - 8, 0)::INT AS s FROM vals WHERE value IS NOT NULL
), cells AS (SELECT day, version, metric, value - value % (1::BIGINT << s) AS cell FROM shifted)
"""
P4_DAILY = _CELLS + "SELECT day, version, metric, cell, count(*) AS n FROM cells GROUP BY ALL"
P4 = (
    _CELLS
    + """, periods AS (
  SELECT coalesce(day::VARCHAR, '(unknown)') AS period, version, metric, cell FROM cells UNION ALL SELECT '(all)', version, metric, cell FROM cells
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY period, version, metric ORDER BY cell) AS k, count(*) OVER (PARTITION BY period, version, metric) AS n
  FROM periods
), picked AS (
  SELECT period, version, metric, p AS percentile, n AS "values", cell, (1::BIGINT << greatest(length(bin(abs(cell))) - 8, 0)::INT) - 1 AS far
  FROM ranked, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])::DOUBLE AS p)
  WHERE k = greatest(1, ceil(p * n - 1e-9)::BIGINT)
)
SELECT period, version, metric, percentile, "values", least(cell, cell + sign(cell) * far)::BIGINT AS lower,
       greatest(cell, cell + sign(cell) * far)::BIGINT AS upper, cell + sign(cell) * far / 2 AS estimate, far / 2 AS max_error
FROM picked
"""
)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "display_messages")).drop("end_char")


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(table(spark, sf_dir, "display_messages"))


def p7_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.distinct_members(table(spark, sf_dir, "telemetry_events"), table(spark, sf_dir, "web_details"))[1]


def p7_daily_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.distinct_members(table(spark, sf_dir, "telemetry_events"), table(spark, sf_dir, "web_details"))[0]


def _uuid(c: str) -> str:
    bare = f"regexp_replace(translate(lower({c}), '{{}}- ' || chr(9) || chr(10) || chr(13) || chr(160), ''), '^urn:uuid:', '')"
    return f"CASE WHEN regexp_matches({bare}, '^[0-9a-f]{{32}}$') THEN {bare} ELSE nullif(trim({c}, ' ' || chr(9) || chr(10) || chr(13)), '') END"


_OS = "coalesce(nullif(CASE WHEN lower(trim(os)) IN ('darwin', 'mac', 'mac os', 'os x') THEN 'macos' ELSE lower(trim(os)) END, ''), '(unknown)')"
_BITS = f"""
WITH size AS (
  SELECT (SELECT count(*) FROM telemetry_events) + (SELECT count(*) FROM web_details) AS most
), bitmap AS (
  SELECT min(m) AS m FROM (SELECT 1::BIGINT << k::INT AS m FROM range(12, 45) r(k)), size
  WHERE most / m <= 60 AND sqrt(m * (exp(most / m) - most / m - 1)) / most <= 0.01
), sources AS (
  SELECT {_uuid("event_id")} AS key, min({_VERSION}) AS version, min({_OS}) AS os FROM telemetry_events GROUP BY 1
), members AS (
  SELECT 'telemetry_id' AS kind, created_at::DATE AS day, {_VERSION} AS version, {_OS} AS os, {_uuid("telemetry_id")} AS member FROM telemetry_events
  UNION ALL
  SELECT 'visitor_id', w.received_at::DATE, coalesce(s.version, '(unknown)'), coalesce(s.os, '(unknown)'), w.member
  FROM (SELECT received_at, {_uuid("event_id")} AS key, {_uuid("visitor_id")} AS member FROM web_details) w LEFT JOIN sources s ON s.key = w.key
), bits AS (
  SELECT DISTINCT kind, coalesce(day::VARCHAR, '(unknown)') AS day, version, os, ('0x' || substr(md5(member), 1, 15))::BIGINT % m AS bit
  FROM members, bitmap WHERE member IS NOT NULL
)
"""
#: A word's bits as a signed number: the sum of its distinct powers of two, less 2^64 where the sign bit is set.
P7_DAILY = _BITS + """
SELECT kind, day, version, os, bit // 64 AS word, (CASE WHEN u >= 1::HUGEINT << 63 THEN u - (1::HUGEINT << 64) ELSE u END)::BIGINT AS bits, m AS bitmap_bits
FROM (SELECT kind, day, version, os, bit // 64 AS bit_word, min(bit) AS bit, sum(DISTINCT 1::HUGEINT << (bit % 64)::INT)::HUGEINT AS u FROM bits GROUP BY ALL), bitmap
"""
P7 = _BITS + """, ones AS (
  SELECT kind, coalesce(day, '(all)') AS day, coalesce(version, '(all)') AS version, coalesce(os, '(all)') AS os, count(DISTINCT bit) AS bits_set
  FROM bits GROUP BY kind, CUBE (day, version, os)
), estimated AS (
  SELECT *, m AS bitmap_bits, -m::DOUBLE * ln((m - least(bits_set, m - 1)) / m::DOUBLE) AS n FROM ones, bitmap
)
SELECT kind, day, version, os, bits_set, bitmap_bits, bits_set >= m AS saturated, round(n, 3) AS estimate,
       round(sqrt(greatest(0, m * (exp(n / m) - n / m - 1))) / n, 6) AS standard_error
FROM estimated
"""


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tokens.token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_sizes"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(p8_containers(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


_SOURCE = "nullif(regexp_replace(lower(trim({})), '[-\\s]+', '_', 'g'), '')"
P8_CHECKS = f"""
SELECT pack_id, count(*) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS cut_short, 0::BIGINT AS lost, 0::BIGINT AS misnumbered
FROM (SELECT DISTINCT pack_id, capacity_tokens, {_SOURCE.format("source")} AS own FROM pack_sizes WHERE capacity_tokens > 0) p
JOIN (SELECT doc_id, {_SOURCE.format("source")} AS source FROM documents) d ON p.own IS NULL OR d.source = p.own GROUP BY 1
"""


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every packing, counted: its documents, and containers over their capacity, documents cut though
    they fit, documents whose tokens aren't all placed, and containers missing in the numbering."""
    sizes, packs = tokens.token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_sizes")
    placed = p8_containers(spark, sf_dir).join(F.broadcast(packs.select("pack_id", "capacity_tokens").distinct()), "pack_id")  # a row a packing
    docs = placed.groupBy("pack_id", "doc_id", "capacity_tokens").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n")).join(sizes.select("doc_id", "n_tokens"), "doc_id")
    of_docs = docs.groupBy("pack_id").agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity_tokens"))).alias("cut_short"), F.count_if(F.col("n") != F.col("n_tokens")).alias("lost"))
    bins = placed.where("container_id IS NOT NULL").groupBy("pack_id", "container_id", "capacity_tokens").agg(F.sum("n_tokens").alias("n"))
    of_bins = bins.groupBy("pack_id").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("overfull"), (F.max("container_id") + 1 - F.count("*")).alias("misnumbered"))
    return of_docs.join(of_bins, "pack_id").select("pack_id", "documents", "overfull", "cut_short", "lost", "misnumbered")


P9_CHECKS = f"""
WITH t AS (SELECT mix_id, {_SOURCE.format("source")} AS source, sum(target_share) AS target_share FROM mix_targets GROUP BY ALL)
SELECT mix_id, count(*) AS targets, round(sum(target_share), 9) AS target_share, 0::BIGINT AS over_cap, 0::BIGINT AS foreign_records, true AS shares_add_up FROM t WHERE source IS NOT NULL GROUP BY 1
"""


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every mix, counted: its targets, documents used more often than their cap, records of a source
    that isn't the document's, and whether the actual shares add up to one."""
    rows, report = _mix(spark, sf_dir)
    docs = tokens.token_counts(table(spark, sf_dir, "documents")).select("doc_id", F.col("source").alias("own"))
    used = rows.groupBy("mix_id", "source", "doc_id").agg(F.count("*").alias("copies")).join(docs, "doc_id")
    judged = used.join(F.broadcast(report.select("mix_id", "source", "max_repeats")), ["mix_id", "source"])  # a row a target
    faults = judged.groupBy("mix_id").agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("over_cap"), F.count_if(F.col("source") != F.col("own")).alias("foreign_records"))
    mixes = report.groupBy("mix_id").agg(F.count("*").alias("targets"), F.round(F.sum("target_share"), 9).alias("target_share"), (F.abs(F.sum("actual_share") - 1) < 1e-4).alias("shares_add_up"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return mixes.join(faults, "mix_id", "left").select("mix_id", "targets", "target_share", zero("over_cap"), zero("foreign_records"), "shares_add_up")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(tokens.token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.damaged(table(spark, sf_dir, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.damaged(table(spark, sf_dir, "documents"))


QUERIES = {
    "p4_percentiles": p4_percentiles,
    "p4_daily_partials": p4_daily_partials,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p7_distinct": p7_distinct,
    "p7_daily_partials": p7_daily_partials,
    "p8_containers": p8_containers,
    "p8_report": p8_report,
    "p8_checks": p8_checks,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_checks": p9_checks,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
}
SQL = {"p4_percentiles": P4, "p4_daily_partials": P4_DAILY, "p7_distinct": P7, "p7_daily_partials": P7_DAILY, "p8_checks": P8_CHECKS, "p9_checks": P9_CHECKS}
