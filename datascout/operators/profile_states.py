"""Profiles as states that add up: the profile of old and new rows together, from the stored state of the old and the new rows alone.

A state has a row for each column of each dataset: counts, moments, ends, a sketch of the distinct values, and the most frequent values
with a bound on what any other value can have.  Its size doesn't depend on the rows behind it, and merging needs no data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X

#: Binary logarithm of a sketch's registers: distinct counts err by 1.04 / sqrt(2**14), 0.8 %, as a standard deviation.
REGISTERS = 14
#: Frequent values that a state keeps of a column.
KEPT = 100


def _frequent(counts: DataFrame, kept: int) -> DataFrame:
    """(of_dataset, of_name, frequent, cut) of counts (dataset, name, value, count): the most frequent values, and the count of the first left out."""
    order = Window.partitionBy("dataset", "name").orderBy(F.desc("count"), "value")
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept + 1)
    values = F.collect_list(F.when(F.col("rank") <= kept, F.struct("value", "count")))
    return ranked.groupBy(F.col("dataset").alias("of_dataset"), F.col("name").alias("of_name")).agg(values.alias("frequent"), F.max(F.when(F.col("rank") > kept, F.col("count"))).alias("cut"))


def _with_frequent(columns: DataFrame, frequent: DataFrame, bound: Column) -> DataFrame:
    own = (F.col("dataset") == F.col("of_dataset")) & (F.col("name") == F.col("of_name"))
    none = F.array().cast("array<struct<value:string,count:bigint>>")
    x = columns.join(frequent, own, "left").withColumns({"frequent": F.coalesce("frequent", none), "bound": bound + F.coalesce("cut", F.lit(0))})
    return x.drop("of_dataset", "of_name", "cut")


def states(cells: DataFrame, kept: int = KEPT) -> DataFrame:
    """(dataset, name, n, nulls, numbers, mean, m2, low, high, distinct, frequent, bound) of cells (dataset, name, value).

    m2: sum of squared differences from the mean.  bound: no value outside `frequent` occurs more often.  Both passes pre-aggregate.
    """
    x = X.safe_float(F.col("value"))
    columns = cells.groupBy("dataset", "name").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value").isNull(), 1)).alias("nulls"), F.count(x).alias("numbers"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"),
        F.min(x).alias("low"), F.max(x).alias("high"), F.hll_sketch_agg("value", REGISTERS).alias("distinct"),
    )
    counts = cells.where("value IS NOT NULL").groupBy("dataset", "name", "value").agg(F.count(F.lit(1)).alias("count"))
    return _with_frequent(columns, _frequent(counts, kept), F.lit(0).cast("long"))


def merged(*parts: DataFrame, kept: int = KEPT) -> DataFrame:
    """The state of all rows behind the parts: what states() gives for them together, sketches within their error.

    A value that a part doesn't list counts nothing there, and the parts' bounds add up.  A column may have rows in any number of parts.
    """
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    moments = F.collect_list(F.when(F.col("numbers") > 0, F.struct(F.col("numbers").cast("double").alias("n"), "mean", "m2")))
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(a: Column, b: Column) -> Column:
        n, off = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + off * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + off * off * a["n"] * b["n"] / n).alias("m2"))

    columns = every.groupBy("dataset", "name").agg(
        *[F.sum(c).alias(c) for c in ("n", "nulls", "numbers", "bound")], moments.alias("moments"), F.min("low").alias("low"), F.max("high").alias("high"), F.hll_union_agg("distinct").alias("distinct"),
    )
    columns = columns.withColumn("all", F.aggregate("moments", zero, add))
    columns = columns.withColumns({c: F.when(F.col("numbers") > 0, F.col(f"all.{c}")) for c in ("mean", "m2")}).drop("moments", "all")
    counts = every.select("dataset", "name", F.explode("frequent").alias("f")).groupBy("dataset", "name", F.col("f.value").alias("value")).agg(F.sum("f.count").alias("count"))
    return _with_frequent(columns, _frequent(counts, kept), F.col("bound")).select(*parts[0].columns)


def profiles(state: DataFrame) -> DataFrame:
    """(dataset, name, n, nulls, mean, stddev, min, max, num_distinct_values) of a state; the last is an estimate."""
    numbers = {"mean": F.col("mean"), "stddev": F.sqrt(F.col("m2") / F.col("numbers")), "min": F.col("low"), "max": F.col("high")}
    return state.select("dataset", "name", "n", "nulls", *[F.round(F.when(F.col("numbers") > 0, c), 4).alias(k) for k, c in numbers.items()], F.hll_sketch_estimate("distinct").alias("num_distinct_values"))


def frequent_values(state: DataFrame, top: int = 5) -> DataFrame:
    """(dataset, name, bin, least, most, rank): the most frequent values by a state alone, and bounds of their counts."""
    each = state.select("dataset", "name", "bound", F.posexplode("frequent").alias("at", "f")).where(F.col("at") < top)
    return each.select("dataset", "name", F.col("f.value").alias("bin"), F.col("f.count").alias("least"), (F.col("f.count") + F.col("bound")).alias("most"), (F.col("at") + 1).alias("rank"))


def recounted(state: DataFrame, cells: DataFrame, top: int = 5) -> DataFrame:
    """(dataset, name, bin, count, rank, certain): the values a state lists, counted in all cells.

    certain: more frequent than any value that isn't listed can be, so that rank and count are those of a full histogram.
    Only listed values are counted, a bounded number a column.
    """
    listed = state.select(F.col("dataset").alias("d"), F.col("name").alias("c"), "bound", F.explode("frequent.value").alias("bin"))
    held = cells.join(listed, (F.col("dataset") == F.col("d")) & (F.col("name") == F.col("c")) & (F.col("value") == F.col("bin")))
    counts = held.groupBy("dataset", "name", "bin").agg(F.count(F.lit(1)).alias("count"), F.first("bound").alias("bound"))
    order = Window.partitionBy("dataset", "name").orderBy(F.desc("count"), "bin")
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("dataset", "name", "bin", "count", "rank", (F.col("count") > F.col("bound")).alias("certain"))
