"""Readers of catalogs, registries, provider settings, listings and view payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators.catalog import first_per_key
from ..schema import CATALOG_DDL, REGISTRY_DDL

#: Asset types that are tables; fewest datasets of a portal worth listing.
TABULAR, MIN_DATASETS = ("dataset", "tabular"), 10


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of catalog records."""
    return spark.read.schema(CATALOG_DDL).option("multiLine", True).json(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(pos, url, dataset_count) of a JSON array of portals."""
    return spark.read.schema(REGISTRY_DDL).option("multiLine", True).json(path).withColumn("pos", F.monotonically_increasing_id())


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table with a header, quotes doubled inside quotes; bad cells become null, typed by the schema or by its values."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def registry_domains(registry: DataFrame) -> DataFrame:
    """Trimmed non-blank urls, the first of each kept, in input order (pos)."""
    rows = registry.withColumn("url", F.trim("url")).where("url IS NOT NULL AND url <> ''")
    return first_per_key(rows, "url", "pos")


def provider_domains(settings: DataFrame, registry: DataFrame) -> DataFrame:
    """(provider, domain) of settings (provider, strategy, domains): DYNAMIC takes the registry (provider, url), EXPLICIT its own list."""
    explicit = settings.where("strategy = 'EXPLICIT'").select("provider", F.explode("domains").alias("domain")).withColumn("domain", F.trim("domain")).where("domain <> ''")
    dynamic = settings.where("strategy = 'DYNAMIC'").select("provider").join(registry.select(F.col("provider"), F.col("url").alias("domain")), "provider")
    return explicit.unionByName(dynamic)


def large_registry(rows: DataFrame, least: int = MIN_DATASETS) -> DataFrame:
    """(url, dataset_count): counts that are whole numbers and large enough, largest first."""
    n = F.when(F.trim("dataset_count").rlike("^-?[0-9]+$"), F.col("dataset_count").try_cast("long"))
    return rows.select("url", n.alias("dataset_count")).where(F.col("dataset_count") >= least).orderBy(F.desc("dataset_count"), "url")


def registry_from_listing(assets: DataFrame, least: int = MIN_DATASETS) -> DataFrame:
    """The same from a listing of assets (domain)."""
    return assets.where("domain IS NOT NULL").groupBy(F.col("domain").alias("url")).agg(F.count(F.lit(1)).alias("dataset_count")).where(F.col("dataset_count") >= least).orderBy(F.desc("dataset_count"), "url")


def viable(type_: Column, resource_type: Column, downloads: Column) -> Column:
    """A table by its own or its resource's type, with a download count that is null or a number."""
    kind = F.lower(X.non_empty(type_, resource_type))
    return F.coalesce(kind.isin(*TABULAR), F.lit(False)) & (downloads.isNull() | X.safe_float(downloads).isNotNull())


def assets_of(payload: Column) -> Column:
    """The fields of a listing payload that are looked at, parsed once."""
    return F.from_json(payload, "type string, id string, nbe_id string, nbeId string, uid string, resource struct<id:string,uid:string,type:string,download_count:string>")


def is_viable(asset: Column) -> Column:
    return viable(asset["type"], asset["resource"]["type"], asset["resource"]["download_count"])


def listing_ids(assets: DataFrame) -> DataFrame:
    """(id, pos) of viable assets (pos, payload JSON): the first candidate field that is a 4x4 id; the first of each id."""
    a = F.col("a")
    key = X.dataset_id(a["resource"]["id"], a["id"], a["nbe_id"], a["nbeId"], a["uid"], a["resource"]["uid"])
    kept = assets.select("pos", assets_of(F.col("payload")).alias("a")).where(is_viable(a)).select("pos", key.alias("id"))
    return first_per_key(kept, "id", "pos")


def view_metadata(views: DataFrame, unit: str | None = None) -> DataFrame:
    """(id, title, description, publisher, source, last_update_date, download_url) of views (id, base_url, payload JSON), parsed once.

    unit: 's' or 'ms' where the portal's epochs are known to be in it; without one, numbers above 1e10 are taken as milliseconds, so seconds
    after November 2286 would be misread.
    """
    names = ("name", "title", "displayName", "description", "notes", "blurb", "ownerDisplayName", "attribution", "ownerName", "rowsUpdatedAt", "viewLastModified", "downloadUrl", "csvDownloadUrl")
    x = views.withColumn("v", F.from_json("payload", ", ".join(f"{n} string" for n in names)))
    get = lambda *wanted: X.non_empty(*[F.col("v")[n] for n in wanted])
    return x.select(
        "id", F.coalesce(get("name", "title", "displayName"), F.col("id").cast("string")).alias("title"), F.coalesce(get("description", "notes", "blurb"), F.lit("")).alias("description"),
        F.coalesce(get("ownerDisplayName", "attribution", "ownerName"), F.lit("")).alias("publisher"), F.lit("Socrata").alias("source"), F.to_date(X.parse_time(get("rowsUpdatedAt", "viewLastModified"), unit)).alias("last_update_date"),
        F.coalesce(get("downloadUrl", "csvDownloadUrl"), X.csv_url(F.col("base_url"), F.col("id").cast("string"))).alias("download_url"),
    )
