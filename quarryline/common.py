"""Small helpers shared by operators and plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables of `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder of the session."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir names. Only a local session (tests) may do without: it gets a folder of its own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return folder or tempfile.mkdtemp(prefix="quarryline-shared-")


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def uuid_key(c: Column) -> Column:
    """The one key of all spellings of a UUID (case, braces, urn:uuid:, dashes, blanks).

    Other strings are trimmed of white space; null and blank give null.
    """
    bare = F.regexp_replace(F.translate(F.lower(c), "{}- \t\r\n ", ""), "^urn:uuid:", "")
    trimmed = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), bare).otherwise(F.when(trimmed != "", trimmed))


def digest16(c: Column) -> Column:
    """128-bit digest, uniform over its range whatever the keys look like."""
    return F.unhex(F.md5(c.cast("binary")))
