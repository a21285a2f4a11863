"""Writers: versions of tables, and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_registry(rows: DataFrame, path: str) -> None:
    """(url, dataset_count) as a JSON array, largest first; a registry is small, one row a portal."""
    every = F.array_sort(F.collect_list(F.struct((-F.col("dataset_count")).alias("order"), "url", "dataset_count")))
    rows.agg(F.to_json(F.transform(every, lambda x: x.dropFields("order"))).alias("value")).write.mode("overwrite").text(path)


def write_catalog(records: DataFrame, path: str, per_file: int = 1000) -> None:
    """Records as JSON arrays of about per_file each, one a file, as read_catalog() takes them."""
    files = max(1, records.count() // per_file)
    of = F.pmod(F.xxhash64("id"), F.lit(files))
    arrays = records.groupBy(of.alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*records.columns))), ","), F.lit("]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)


def create_table(spark: SparkSession, name: str, ddl: str, replace: bool = False) -> None:
    """An empty Parquet table if there is none; replace: drops one that is there."""
    if replace:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], ddl).write.format("parquet").saveAsTable(name)
