"""Catalog records, work lists and table maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as X
from ..sources import keyed
from ..sources.workdir import work_dir

#: Columns that must be there for a search document to load.
REQUIRED = ("id",)


def _tie(rows: DataFrame) -> Column:
    """A hash of the row, to order rows of equal keys and order values alike in every run; maps have none."""
    return F.xxhash64(*[f"`{c}`" for c, kind in rows.dtypes if "map<" not in kind and kind != "variant"])


def last_per_key(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of each key with the largest seq: last write wins; of equal ones that with the largest hash of the row."""
    order = Window.partitionBy(key).orderBy(F.desc(seq), F.desc(_tie(rows)))
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def first_per_key(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """The first row of each key by input position (of equal positions by a hash of the row); null keys are left out."""
    order = Window.partitionBy(key).orderBy(pos, _tie(rows))
    return rows.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def first_n(rows: DataFrame, group: str, order: list[str], n: int, default: int = 10) -> DataFrame:
    """The first n rows of each group; n of 0 or less means `default`."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= (n if n > 0 else default)).drop("__n")


def upsert(current: DataFrame, arrivals: DataFrame, key: str, seq: str) -> DataFrame:
    """current (one row a key) with arrivals put over it by key; of several arrivals of a key the last counts.  Columns are those of current.

    Rows that stay are an anti-join away: Spark broadcasts the arrivals' keys if they are small, and current isn't sorted.
    """
    new = last_per_key(arrivals, key, seq).select(*current.columns)
    gone = new.select(F.col(key).alias("__k"))
    return current.join(gone, F.col(key).eqNullSafe(F.col("__k")), "left_anti").unionByName(new)


def load_counts(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """One row with loaded and failed counts, and the failed rows."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.agg(F.count(F.when(ok, 1)).alias("loaded"), F.count(F.when(~ok, 1)).alias("failed")), rows.where(~ok)


def staleness(incoming: DataFrame, indexed: DataFrame) -> DataFrame:
    """incoming (id, provider, source_ts) with `state` against indexed (id, indexed_ts): new, stale, current or unknown.

    Only the 'socrata' provider is compared; rows of others, and rows whose times are not both known, are unknown.
    """
    x = incoming.join(indexed.select(F.col("id").alias("of"), "indexed_ts"), F.col("id") == F.col("of"), "left")
    known = F.col("source_ts").isNotNull() & F.col("indexed_ts").isNotNull()
    state = F.when(F.lower("provider") != "socrata", "unknown").when(F.col("of").isNull(), "new").when(~known, "unknown").when(F.col("source_ts") == F.col("indexed_ts"), "current").otherwise("stale")
    return x.withColumn("state", state).drop("of")


def to_process(states: DataFrame) -> DataFrame:
    return states.where("state <> 'current'")


def search_payload(records: DataFrame) -> DataFrame:
    """Search documents: without sample text and telemetry, and with names and types only of each column."""
    slim = F.transform("profiler_metadata.columns", lambda c: F.struct(c["name"].alias("name"), c["structural_type"].alias("structural_type"), c["semantic_types"].alias("semantic_types")))
    kept = F.col("profiler_metadata").dropFields("sample", "topic", "semantic_profile", "sample_telemetry")
    return records.withColumn("profiler_metadata", kept.withField("columns", slim))


def strip_plots(records: DataFrame) -> DataFrame:
    return records.withColumn("profiler_metadata", F.col("profiler_metadata").withField("columns", F.transform("profiler_metadata.columns", lambda c: c.dropFields("plot"))))


def apply_timestamp(records: DataFrame, ts: Column) -> DataFrame:
    """Stamps both *_updated_at columns and the date part; a null leaves the row as it is."""
    own = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    return records.withColumns({"socrata_updated_at": F.coalesce(ts, own("socrata_updated_at")), "source_updated_at": F.coalesce(ts, own("source_updated_at")), "last_update_date": F.coalesce(F.substring_index(ts, "T", 1), own("last_update_date"))})


def portal_rows(catalog: DataFrame, portals: DataFrame) -> DataFrame:
    """portals (domain, provider) with display label and the number of records of the domain."""
    counts = catalog.where("domain IS NOT NULL").groupBy(F.col("domain").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    x = portals.join(counts, F.col("domain") == F.col("of"), "left")
    return x.select("domain", "provider", X.domain_label(F.col("domain")).alias("display_label"), F.coalesce("n", F.lit(0)).alias("dataset_count"))


def top_portals(portals: DataFrame, limit: int = 100) -> DataFrame:
    """Largest portals, blank domains left out; a blank label is the domain, a missing count 0."""
    shown = portals.where(F.trim("domain") != "").select("domain", F.coalesce(F.nullif("display_label", F.lit("")), "domain").alias("display_label"), F.coalesce("dataset_count", F.lit(0)).alias("dataset_count"))
    return shown.orderBy(F.desc("dataset_count"), "domain").limit(limit)


def portal_upsert(portals: DataFrame, arrivals: DataFrame, catalog: DataFrame, indexed_at: Column) -> DataFrame:
    """portals (domain, provider, display_label, dataset_count, last_indexed_at) after the domains of arrivals (domain, provider) were indexed.

    They get their label, the catalog's present count and the time; other portals stay as they are.  Arrivals without a domain are left
    out; of several of a domain that with the last provider name counts.
    """
    rows = portal_rows(catalog, arrivals.where("domain IS NOT NULL AND domain <> ''")).withColumn("last_indexed_at", indexed_at)
    return upsert(portals, rows, "domain", "provider")


def store_profiles(records: DataFrame, path: str) -> None:
    """Whole records as JSON by id, put over those at `path`: an id that is there already is replaced, all others stay."""
    spark = records.sparkSession
    rows = records.select("id", F.to_json(F.struct("*")).alias("profile"))
    schema = T.StructType([rows.schema["id"], T.StructField("profile", T.StringType())])
    keyed.put(spark, path, rows, "id", "profile", schema, keyed.newest(spark, path) + 1)


def read_profiles(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(id, profile) as store_profiles() left them."""
    return keyed.read(spark, path, "id", T.StructType.fromDDL(f"id {id_type}, profile string"))


def find_profiles(wanted: DataFrame, profiles: DataFrame, key: str = "name") -> DataFrame:
    """(want, name, rank) for wanted (want): the profile of that very name, else the first whose name starts with it; rank is 1.

    In sorted order that is the next name from `want` on, if it starts with it.  Names and wants are dealt to ranges and sorted once; a
    want after the last name of its range takes the first name of the next range that has one.  Nulls are found nowhere, equal wants once.
    """
    spark, path = wanted.sparkSession, work_dir(wanted.sparkSession, "names")
    names = profiles.where(F.col(key).isNotNull()).select(F.col(key).alias("at"), F.col(key).alias("name"))
    both = names.unionByName(wanted.where("want IS NOT NULL").select(F.col("want").alias("at"), F.lit(None).cast("string").alias("name")).distinct())
    both.repartitionByRange("at").withColumn("part", F.spark_partition_id()).write.parquet(path)
    held = spark.read.parquet(path)
    firsts = held.groupBy(F.col("part").alias("of")).agg(F.min("name").alias("first"))  # a row a range
    # both windows run from the last name back: frames that grow take a step a row, those that shrink are summed anew for every row
    after = F.min("first").over(Window.orderBy(F.desc("of")).rowsBetween(Window.unboundedPreceding, -1))
    firsts = F.broadcast(firsts.select("of", after.alias("later")))
    onward = Window.partitionBy("part").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = held.withColumn("next", F.last("name", ignorenulls=True).over(onward)).where("name IS NULL").join(firsts, F.col("part") == F.col("of"))
    found = found.select(F.col("at").alias("want"), F.coalesce("next", "later").alias("name"))
    return found.where(F.startswith("name", "want")).select("want", "name", F.lit(1).alias("rank"))


def work_items(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Work items with defaults from rows (dataset_id, id, domain, provider, base_url), and the rows without an id."""
    key = X.non_empty(F.col("dataset_id"), F.col("id"))
    base = F.coalesce(F.col("base_url"), F.concat(F.lit("https://"), F.col("domain")))
    items = rows.withColumn("dataset_id", key).where("dataset_id IS NOT NULL").select("dataset_id", F.coalesce("provider", F.lit("socrata")).alias("provider"), F.coalesce(F.col("domain"), X.host_of(base)).alias("domain"), base.alias("base_url"), X.csv_url(base, F.col("dataset_id")).alias("csv_url"))
    return items, rows.where(key.isNull())


def assemble(metadata: DataFrame, coverage: DataFrame, profiles: DataFrame, fallback_box: Column | None = None) -> DataFrame:
    """Catalog records: metadata joined by id with coverage and profiles, with defaults where one of these is missing, and `errors`.

    metadata: id, title, description, source, domain, provider, download_url, headers (names of the columns), error.
    coverage: id, label, box (four numbers), start, end, error.  profiles: id, nb_rows, types, columns, box, sample, error.
    Each error is null where a step went well.  A record without a profile, or with a failed one, gets the minimal profile: type
    'categorical', no columns, and the headers as keywords.  A title that is missing is the id.  Ids repeat in none of the three.
    """
    c = coverage.select(F.col("id").alias("c_id"), "label", F.col("box").alias("c_box"), "start", "end", F.col("error").alias("c_error"))
    p = profiles.select(F.col("id").alias("p_id"), "nb_rows", "types", "columns", F.col("box").alias("p_box"), "sample", F.col("error").alias("p_error"))
    x = metadata.join(c, F.col("id") == F.col("c_id"), "left").join(p, F.col("id") == F.col("p_id"), "left")
    fine = F.col("p_id").isNotNull() & F.col("p_error").isNull()
    names = F.when(fine, F.transform("columns", lambda e: e["name"])).otherwise(F.col("headers"))
    types = F.when(fine, F.coalesce("types", F.array().cast("array<string>"))).otherwise(F.array(F.lit("categorical")))
    box = X.choose_bbox(F.when(fine, F.col("p_box")), F.col("c_box"), fallback_box if fallback_box is not None else F.lit(None).cast("array<double>"))
    count = lambda test: F.size(F.filter(F.when(fine, F.col("columns")).otherwise(F.slice("columns", 1, 0)), test))
    failed = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c)))
    errors = F.array_compact(F.array(failed("metadata", "error"), failed("coverage", "c_error"), F.when(F.col("p_id").isNull(), F.lit("profile missing")).otherwise(failed("profile", "p_error"))))
    profile = F.struct(
        F.coalesce("nb_rows", F.lit(0).cast("long")).alias("nb_rows"), F.greatest(F.coalesce(F.size(names), F.lit(0)), F.lit(0)).alias("nb_columns"),
        F.greatest(count(lambda e: e["structural_type"].contains("GeoCoordinates")), F.lit(0)).alias("nb_spatial_columns"), F.greatest(count(lambda e: e["structural_type"].contains("Date")), F.lit(0)).alias("nb_temporal_columns"),
        types.alias("types"), names.alias("attribute_keywords"), F.when(fine, F.col("columns")).alias("columns"),
    )
    return x.select(
        "id", X.non_empty(F.col("title"), F.col("id")).alias("title"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("source", F.lit("")).alias("source"), "domain", "provider", "download_url",
        F.coalesce("sample", F.lit("")).alias("sample"), types.alias("types"), F.struct("start", "end").alias("temporal_coverage"),
        F.struct(F.coalesce("label", F.lit("")).alias("label"), F.struct(F.lit("envelope").alias("type"), X.envelope(box).alias("coordinates")).alias("bbox")).alias("spatial_coverage"),
        profile.alias("profiler_metadata"), errors.alias("errors"),
    )
