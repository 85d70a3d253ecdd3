"""File sources and sinks: listings, JSON lines, logs, pages, incremental summaries, upserts, snapshots, tables as text."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def listing(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """path, bytes, modified of the files under a folder with an extension, whatever its case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.where(F.lower("path").endswith("." + extension.lower())).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def newest(files: DataFrame, n: int) -> DataFrame:
    """The n files modified last, ties by path, last first."""
    return files.orderBy(F.desc("modified"), F.desc("path")).limit(n)


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """Records, and the lines that can't be read."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), "value")
    parsed = lines.withColumn("record", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    readable = F.try_parse_json("value").isNotNull()
    return parsed.where(readable).select("path", "record.*"), parsed.where(~readable).select("path", "value")


#: How a plain form of messages names its parts: session, role, text, time (JSON paths). Other assistants' own formats are
#: read by `transcripts`.
PLAIN = ("$.session_id", "$.role", "$.content", "$.timestamp")


def messages(lines: DataFrame, paths: tuple[str, str, str, str] = PLAIN, value: str = "value") -> DataFrame:
    """JSON lines as session_id, role, text, sent_at by the paths given; only user and assistant messages with text."""
    parts = [F.get_json_object(value, p).alias(n) for p, n in zip(paths, ("session_id", "role", "text", "sent"), strict=True)]
    own = lines.select(*parts).where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    return own.select("session_id", "role", "text", F.coalesce(F.try_to_timestamp("sent"), F.try_to_timestamp("sent", F.lit("yyyy-MM-dd"))).alias("sent_at"))


def all_messages(sources: dict[str, DataFrame]) -> DataFrame:
    """Messages of several plain sources, each under its name."""
    out = None
    for name, lines in sources.items():
        own = messages(lines).withColumn("form", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def log_lines(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """Fields of text log lines by regular expression (first group), null where a line has none."""
    fields = [F.nullif(F.regexp_extract("value", p, 1), F.lit("")).alias(n) for n, p in patterns.items()]
    return spark.read.text(path).select(F.input_file_name().alias("path"), *fields)


def refresh(files: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cached summaries still valid (same size and time), and the files to summarise anew."""
    key = ["path", "bytes", "modified"]
    return cached.join(files.select(key), key, "left_semi"), files.join(cached.select(key), key, "left_anti")


def insert_new(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of `fresh` to append: each key once, none already stored."""
    return fresh.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def latest(df: DataFrame, key: str, at: Column) -> DataFrame:
    """The last write of each key."""
    own = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), at).alias("__row"))
    return own.select("__row.*")


def replay(log: DataFrame, key: str, at: str, deleted: str) -> DataFrame:
    """State after a mutation log: the last write of each key, unless it is a removal."""
    return latest(log, key, F.col(at)).where(~F.coalesce(F.col(deleted), F.lit(False)))


def summarised(files: DataFrame, cached: DataFrame, summarise: Callable[[DataFrame], DataFrame], store: str | None = None) -> DataFrame:
    """Summaries of all files: those kept for files unchanged since, and fresh ones for the others only.

    summarise: (path, bytes, modified) of files to read -> the cache's columns. With `store` the result is written there
    as the next cache.
    """
    kept, stale = refresh(files, cached)
    out = kept.unionByName(summarise(stale))
    if store:
        replace_snapshot(out, store)
        return out.sparkSession.read.parquet(snapshot(out.sparkSession, store))
    return out


def dated_files(spark: SparkSession, root: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Lines (path, line) of the JSONL files whose name ends with a date in the range, both ends included.

    The names are listed first, so files outside the range aren't opened.
    """
    date = F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})\.jsonl$", 1)
    inside = (date != "") & (F.lit(True) if since is None else date >= since) & (F.lit(True) if until is None else date <= until)
    paths = [r[0] for r in listing(spark, root, "jsonl").where(inside).select("path").collect()]  # names of files, not their rows
    if not paths:
        return spark.createDataFrame([], "path string, line string")
    return spark.read.text(paths).select(F.input_file_name().alias("path"), F.col("value").alias("line")).where(F.trim("line") != "")


def _pdf_pages(content: bytes) -> str:
    """Text that the content streams of a PDF show, as far as it is written in plain strings."""
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        try:
            data = zlib.decompress(m.group(1))
        except zlib.error:
            data = m.group(1)
        if b"BT" not in data:
            continue
        for block in re.findall(rb"BT(.*?)ET", data, re.S):
            for line in re.findall(rb"\[((?:\\.|[^\]])*)\]\s*TJ|(\((?:\\.|[^)\\])*\))\s*(?:Tj|'|\")", block, re.S):
                parts = re.findall(rb"\(((?:\\.|[^)\\])*)\)", line[0] or line[1], re.S)
                text = b"".join(parts).decode("latin-1")
                out.append(re.sub(r"\\([nrt()\\])", lambda k: {"n": "\n", "r": "\r", "t": "\t"}.get(k.group(1), k.group(1)), text))
    return "\n".join(out)


def pdf_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of PDF files: strings shown by their (plain or deflated) content streams; null where there are none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [_pdf_pages(c) or None for c in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(texts, pa.string())], names=["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "path string, text string")


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def replace_snapshot(df: DataFrame, path: str) -> None:
    """Writes a snapshot beside the present one and then points to it by one rename: readers see the old or the new whole.

    A failed write leaves the present snapshot as it is. The one before the present is kept for readers still on it.
    """
    spark = df.sparkSession
    name = uuid.uuid4().hex
    df.write.parquet(f"{path}/data-{name}")
    fs, new_path = _fs(spark, path)
    draft = new_path(f"{path}/draft-{name}")
    out = fs.create(draft)
    out.write(bytearray(f"data-{name}".encode()))
    out.close()
    before = snapshot(spark, path)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(draft), fs.makeQualified(new_path(f"{path}/current")), overwrite)
    for status in fs.listStatus(new_path(path)):
        kept = status.getPath().getName()
        if kept.startswith("data-") and kept != f"data-{name}" and (before is None or not before.endswith(kept)):
            fs.delete(status.getPath(), True)


def snapshot(spark: SparkSession, path: str) -> str | None:
    """Folder of the present snapshot, None if there is none."""
    fs, new_path = _fs(spark, path)
    pointer = new_path(f"{path}/current")
    if not fs.exists(pointer):
        return None
    return f"{path}/" + spark.read.text(f"{path}/current").first()[0]


def json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON lines, null fields written out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def text_table(df: DataFrame, rows: int = 100) -> str:
    """The first rows as an aligned table, numbers to the right; the rest is counted, not shown."""
    found = df.limit(rows + 1).collect()
    numeric = [isinstance(f.dataType, T.NumericType) for f in df.schema]
    cells = [df.columns, *([("" if v is None else str(v)) for v in r] for r in found[:rows])]
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    lines = ["  ".join(v.rjust(w) if n else v.ljust(w) for v, w, n in zip(r, widths, numeric, strict=True)).rstrip() for r in cells]
    lines.insert(1, "  ".join("-" * w for w in widths))
    return "\n".join([*lines, *(["..."] if len(found) > rows else [])])
