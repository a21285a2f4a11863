"""Sample rows inside stored profiles, and defaults for missing portal tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workdir import work_dir

#: Keys of a profile that hold sample rows, first match first; then the key of CSV text, and those whose values are searched first.
ROW_KEYS, TEXT_KEY, FIRST_PLACES = ("sample_data", "sampleData", "rows", "data"), "sample", ("profiler_metadata", "columns")
#: First sign of a JSON value's text, which tells its kind.
OBJECT, ARRAY, STRING = "{", "[", '"'


def _kind(value: Column) -> Column:
    return F.substring(F.to_json(value), 1, 1)


def _is_csv(text: Column) -> Column:
    """A header and at least one row: two lines that aren't blank."""
    return F.size(F.filter(F.split(text, "\r\n|\r|\n"), lambda x: x.rlike(r"\S"))) > 1


def _children(text: Column, kind: Column) -> Column:
    """(first, at, text, kind, key) of the values in an object or array, in their order; strings without quotes.  first: the rank of the key in FIRST_PLACES."""
    first = lambda key: F.coalesce(*[F.when(key == k, i) for i, k in enumerate(FIRST_PLACES)], F.lit(len(FIRST_PLACES)))
    entry = lambda x, i, key: F.struct(first(key).alias("first"), i.alias("at"), x["text"].alias("text"), x["kind"].alias("kind"), key.alias("key"))
    # the same text is parsed for its texts, which keep their order, and for its kinds
    values, items = F.from_json(text, "map<string,string>"), F.from_json(text, "array<string>")
    fields = F.arrays_zip(F.map_entries(values).alias("own"), F.transform(F.map_values(F.from_json(text, "map<string,variant>")), _kind).alias("kind"))
    fields = F.transform(fields, lambda x: F.struct(x["own"]["key"].alias("key"), x["own"]["value"].alias("text"), x["kind"].alias("kind")))
    elements = F.arrays_zip(items.alias("text"), F.transform(F.from_json(text, "array<variant>"), _kind).alias("kind"))
    return F.when(kind == OBJECT, F.transform(fields, lambda x, i: entry(x, i, x["key"]))).when(kind == ARRAY, F.transform(elements, lambda x, i: entry(x, i, F.lit(""))))


def _rows(text: Column) -> Column:
    """Maps of text for the rows of a JSON array; scalar rows get the field 'value'."""
    one = lambda x: F.when(x["kind"] == OBJECT, F.from_json(x["text"], "map<string,string>")).otherwise(F.create_map(F.lit("value"), x["text"]))
    return F.transform(_children(text, F.lit(ARRAY)), one)


def located(profiles: DataFrame) -> DataFrame:
    """(id, rows, text) of profiles (id, profile: JSON) that have a sample at any depth: rows as maps of text, or CSV text.

    An object's own rows come before its CSV text, both before what is nested in it; nested values are searched in their order,
    'profiler_metadata' and 'columns' first.  The search goes level by level, a job each, over the containers that hold no sample themselves; of
    several samples the first in that order counts.  Null, a text that is no JSON and one that repeats a key have none; rows that repeat both id
    and profile give one.
    """
    spark = profiles.sparkSession
    top = F.try_parse_json("profile")
    level = profiles.where("profile IS NOT NULL").select("id", F.xxhash64("id", "profile").alias("rid"), F.array().cast("array<int>").alias("place"), _kind(top).alias("kind"), F.when(_kind(top) == STRING, F.try_variant_get(top, "$", "string")).otherwise(F.col("profile")).alias("text"))
    level = level.select("id", "rid", "place", F.when(F.col("kind").isin(OBJECT, ARRAY) | ((F.col("kind") == STRING) & _is_csv(F.col("text"))), F.col("kind")).alias("kind"), "text", (F.col("kind") == STRING).alias("found")).where("kind IS NOT NULL")
    levels, path = [], work_dir(spark, "samples")
    while True:
        level.write.parquet(f"{path}/{len(levels)}")
        held = spark.read.schema(level.schema).parquet(f"{path}/{len(levels)}")
        levels.append(held.where("found"))
        open_ = held.where("NOT found")
        if open_.isEmpty():
            break
        level = _deeper(open_)
    every = levels[0]
    for found in levels[1:]:
        every = every.unionByName(found)
    best = every.groupBy("rid", "id").agg(F.min_by(F.struct("kind", "text"), "place").alias("s"))
    return best.select("id", F.when(F.col("s.kind") == ARRAY, _rows(F.col("s.text"))).alias("rows"), F.when(F.col("s.kind") == STRING, F.col("s.text")).alias("text"))


def _deeper(nodes: DataFrame) -> DataFrame:
    """The samples of containers (id, rid, place, kind, text), and the containers and CSV texts in those that have none of their own."""
    own = lambda key, test: F.get(F.filter("inside", lambda x: (x["key"] == key) & test(x)), F.lit(0))
    rows = F.coalesce(*[own(k, lambda x: x["kind"] == ARRAY) for k in ROW_KEYS])
    text = own(TEXT_KEY, lambda x: (x["kind"] == STRING) & _is_csv(x["text"]))
    nodes = nodes.withColumn("inside", _children(F.col("text"), F.col("kind")))
    nodes = nodes.withColumn("sample", F.when(F.col("kind") == OBJECT, F.coalesce(rows, text)))
    nested = F.filter("inside", lambda x: x["kind"].isin(OBJECT, ARRAY) | ((x["kind"] == STRING) & _is_csv(x["text"])))
    each = nodes.withColumn("next", F.explode(F.when(F.col("sample").isNotNull(), F.array("sample")).otherwise(nested)))
    place = F.when(F.col("sample").isNotNull(), F.col("place")).otherwise(F.concat("place", F.array("next.first", "next.at")))
    return each.select("id", "rid", place.alias("place"), "next.kind", "next.text", (F.col("sample").isNotNull() | (F.col("next.kind") == STRING)).alias("found"))


def headers(rows: DataFrame) -> DataFrame:
    """(id, name) of rows (id, row: map): all keys that some row of the id has."""
    return rows.select("id", F.explode(F.map_keys("row")).alias("name")).distinct()


def or_default(portals: DataFrame, defaults: DataFrame) -> DataFrame:
    """portals, or the default rows where that table has none."""
    any_row = portals.limit(1).select(F.lit(1).alias("__some"))
    return portals.unionByName(defaults.join(F.broadcast(any_row), F.lit(True), "left_anti"))  # one row at most
