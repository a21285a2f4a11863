"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The same class in DuckDB's regular expressions.
WORD_SQL = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Where the session names none, a local master gets a temporary folder; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-datascout-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and return the written table.

    This cuts the lineage: a lost executor costs a re-read of the table, not a recomputation, and both the
    passes that follow read a narrow columnar file.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/datascout-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of exactly this name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_key(c: Column) -> Column:
    """Text of an id for hashing; null gets a text that no integer id has."""
    return F.coalesce(c.cast("string"), F.lit("null"))


def hash52(*parts: Column) -> Column:
    """Hash of the parts (joined by '|') in [0, 2**52): the first 13 hex digits of the MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long")


def hash52_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13) AS BIGINT)"


def word_count(c: Column) -> Column:
    """Number of words; null: 0."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("long")


def bucket_count(rows: int, groups: int = 1) -> int:
    """Range buckets for a two-level prefix sum: about the square root of the rows of a group, so that neither
    the table of bucket totals nor the rows of one bucket grow in proportion to the input."""
    return max(1, round((max(rows, 1) / max(groups, 1)) ** 0.5))


def range_bucket(h: Column, buckets: int) -> Column:
    """Bucket of a 52-bit hash; larger hashes never get a smaller bucket."""
    return F.floor(h.cast("double") * F.lit(buckets / 2.0**52)).cast("long")


#: Most entries (rows, and the elements of their arrays) of a table that is broadcast: each is a few numbers, so about 50 MB at most.
BROADCAST_ENTRIES = 500_000


def small_side(df: DataFrame, elements: str | None = None) -> DataFrame:
    """df with a broadcast hint if it has few entries; larger ones are left to a shuffle.  elements: a column of arrays, which count too."""
    size = F.sum(F.greatest(F.size(elements), F.lit(1))) if elements else F.count(F.lit(1))
    return F.broadcast(df) if (df.agg(size).first()[0] or 0) <= BROADCAST_ENTRIES else df
