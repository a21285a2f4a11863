"""A catalog and query tables derived from the given tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.text import Index, build_index, open_index
from ..sources.workdir import table, work_dir

#: Text fields of the catalog that searches use.
FIELDS = ["title", "description", "ufd", "sfd"]


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a document.  The title is the text's first line; the other two descriptions are its odd lines, and the title with its even lines."""
    d = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    title = F.get(lines, F.lit(0))
    odd = F.array_join(F.filter(lines, lambda x, i: i % 2 == 0), "\n")
    even = F.array_join(F.filter(lines, lambda x, i: i % 2 == 1), "\n")
    start = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int"))
    lon, lat = ((F.col("doc_id") * 37) % 358 - 180).cast("double"), ((F.col("doc_id") * 17) % 178 - 90).cast("double")
    types = F.array_compact(F.array("lang", F.when(F.col("n_chars") > 1000, F.lit("long")), F.when(F.col("doc_id") % 3 == 0, F.lit("spatial"))))
    return d.select(
        F.col("doc_id").alias("id"), title.alias("title"), F.col("text").alias("description"), odd.alias("ufd"),
        F.concat(title, F.lit("\n"), even).alias("sfd"), F.col("source").alias("domain"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("socrata")).otherwise(F.lit("ckan")).alias("provider"), types.alias("types"),
        start.alias("t_start"), F.date_add(start, (F.col("n_chars") % 365).cast("int")).alias("t_end"),
        lon.alias("min_lon"), lat.alias("min_lat"), (lon + 1).alias("max_lon"), (lat + 1).alias("max_lat"),
    )


_indexes: dict[tuple, str] = {}


def text_index(spark: SparkSession, sf_dir: str) -> Index:
    """The catalog's stored text index: built by the first search in a session, read by the others while the table's files are the same."""
    files = table(spark, sf_dir, "documents").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    mark = files.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("*"), F.lit(1 << 40)))).first()
    key = (spark.sparkContext.applicationId, sf_dir, *mark)
    if key not in _indexes:
        path = work_dir(spark, "index")
        build_index(catalog(spark, sf_dir), FIELDS, path)
        _indexes[key] = path
    return open_index(spark, _indexes[key])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, keywords): the benchmark texts."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("keywords"))


def query_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, q_start, q_end, q_min_lon, ...): an interval and a box for each benchmark item; some cross the dateline."""
    b = table(spark, sf_dir, "benchmark")
    start = F.date_add(F.lit("2020-06-01").cast("date"), (F.col("item_id") * 13 % 900).cast("int"))
    lon, lat = (F.col("item_id") * 29 % 350 - 175).cast("double"), (F.col("item_id") * 7 % 160 - 85).cast("double")
    return b.select(F.col("item_id").alias("qid"), start.alias("q_start"), F.date_add(start, 30).alias("q_end"), lon.alias("q_min_lon"), lat.alias("q_min_lat"), F.when(lon + 12 > 180, lon + 12 - 360).otherwise(lon + 12).alias("q_max_lon"), (lat + 5).alias("q_max_lat"))


_TITLE = "split_part(text, chr(10), 1)"
_LINES = "array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: i % 2 = {}), chr(10))"
_START = "(DATE '2020-01-01' + CAST(doc_id % 1000 AS INTEGER))"
CATALOG = f"""catalog AS (
  SELECT doc_id AS id, {_TITLE} AS title, text AS description, {_LINES.format(1)} AS ufd, {_TITLE} || chr(10) || {_LINES.format(0)} AS sfd,
    source AS domain, CASE WHEN doc_id % 2 = 0 THEN 'socrata' ELSE 'ckan' END AS provider,
    list_filter([lang, CASE WHEN n_chars > 1000 THEN 'long' END, CASE WHEN doc_id % 3 = 0 THEN 'spatial' END], lambda t: t IS NOT NULL) AS types,
    {_START} AS t_start, ({_START} + CAST(n_chars % 365 AS INTEGER)) AS t_end,
    CAST((doc_id * 37) % 358 - 180 AS DOUBLE) AS min_lon, CAST((doc_id * 17) % 178 - 90 AS DOUBLE) AS min_lat,
    CAST((doc_id * 37) % 358 - 179 AS DOUBLE) AS max_lon, CAST((doc_id * 17) % 178 - 89 AS DOUBLE) AS max_lat
  FROM documents)"""
RANGES = """ranges AS (
  SELECT item_id AS qid, (DATE '2020-06-01' + CAST(item_id * 13 % 900 AS INTEGER)) AS q_start, (DATE '2020-06-01' + CAST(item_id * 13 % 900 AS INTEGER) + 30) AS q_end,
    CAST(item_id * 29 % 350 - 175 AS DOUBLE) AS q_min_lon, CAST(item_id * 7 % 160 - 85 AS DOUBLE) AS q_min_lat,
    CAST(CASE WHEN item_id * 29 % 350 - 163 > 180 THEN item_id * 29 % 350 - 523 ELSE item_id * 29 % 350 - 163 END AS DOUBLE) AS q_max_lon, CAST(item_id * 7 % 160 - 80 AS DOUBLE) AS q_max_lat
  FROM benchmark)"""
