"""Facets of many queries at once from bitmaps of ids, instead of joining every match with its record.

Ids are cut into spans of 32,768, the size of Spark's bitmaps.  A value that is frequent in a span has a bitmap of the ids there; of the others the
ids are kept as they are, so rare values cost a row each and no bitmap.  Matches become bitmaps too: 4 KB for each query and span,
however many they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids of a value in a span from which they are a bitmap: its 4 KB are the size of so many ids.
DENSE = 512


@dataclass(frozen=True)
class Facets:
    """Values of records: bitmaps (key, span, bits) and single ids (key, id)."""

    dense: DataFrame
    sparse: DataFrame


def _span(id_: Column) -> Column:
    return F.bitmap_bucket_number(id_)


def top_values(counts: DataFrame, size: int) -> DataFrame:
    """(qid, key, n, other) of counts (qid, key, n): the `size` most frequent values of each query, and how many have another."""
    order, whole = Window.partitionBy("qid").orderBy(F.desc("n"), "key"), Window.partitionBy("qid")
    counts = counts.withColumns({"rank": F.row_number().over(order), "total": F.sum("n").over(whole)}).where(F.col("rank") <= size)
    return counts.withColumn("other", F.col("total") - F.sum("n").over(whole)).select("qid", "key", "n", "other")


def single_values(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, key): the values of each row; an array's different ones, nulls nowhere."""
    is_array = dict(rows.select(value.alias("v")).dtypes)["v"].startswith("array")
    return rows.select(*keys, F.explode(F.array_distinct(value)).alias("key") if is_array else value.alias("key")).where("key IS NOT NULL")


def index_values(records: DataFrame, value: Column, dense: int = DENSE) -> Facets:
    """The facets of records (id: an integer, each once); an array counts a record once for each different value."""
    each = single_values(records, ["id"], value).withColumn("span", _span(F.col("id")))
    many = each.groupBy(F.col("key").alias("k"), F.col("span").alias("s")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= dense)
    own = (F.col("key") == F.col("k")) & (F.col("span") == F.col("s"))
    bitmaps = each.join(many, own, "left_semi").groupBy("key", "span").agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    return Facets(bitmaps, each.join(many, own, "left_anti").select("key", "id"))


def facet_counts(matches: DataFrame, facets: Facets) -> DataFrame:
    """(qid, key, n) for matches (qid, id), each pair once: a bitmap's part is the count of the bits that it shares with the query's."""
    asked = matches.groupBy("qid", _span(F.col("id")).alias("span")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("asked"))
    both = asked.join(facets.dense, "span").select("qid", "key", "span", F.explode(F.array("asked", "bits")).alias("part"))
    shared = both.groupBy("qid", "key", "span").agg(F.bitmap_count(F.bitmap_and_agg("part")).alias("n"))
    single = matches.select("qid", F.col("id").alias("of")).join(facets.sparse, F.col("of") == F.col("id")).groupBy("qid", "key").agg(F.count(F.lit(1)).alias("n"))
    return shared.select("qid", "key", "n").unionByName(single).groupBy("qid", "key").agg(F.sum("n").alias("n")).where("n > 0")


def facet(matches: DataFrame, facets: Facets, size: int = 10) -> DataFrame:
    """(qid, key, n, other): the `size` most frequent values of each query's matches, and how many rows have another."""
    return top_values(facet_counts(matches, facets), size)
