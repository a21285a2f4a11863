"""Profiles of many tables at once: each is unpivoted to (dataset, pos, column, value) text rows, and grouped by dataset and column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..sources.workdir import work_dir

#: Least share of values that must pass for a structural type or a geographic class.
TYPE_SHARE, GEO_SHARE = 0.9, 0.5
#: Columns from which on a profile text keeps core fields only; most columns in it.
WIDE, MOST_COLUMNS = 40, 80
#: Ranges that the values of a column are parted into at most; least share of the whole range that a gap between them has.
RANGES, GAP = 3, 0.1
#: Classes of columns, by pattern of the name and of the values, in order of priority.
GEO_RULES = (
    ("latitude", X.LAT_NAME, r"^-?[0-9]{1,2}(\.[0-9]+)?$"),
    ("longitude", X.LON_NAME, r"^-?[0-9]{1,3}(\.[0-9]+)?$"),
    ("point", r"(?i)(point|geom|location|geo)", r"(?i)POINT\s*\("),
    ("zip9", r"(?i)zip|postal", r"^[0-9]{5}-[0-9]{4}$"),
    ("zip5", r"(?i)zip|postal", r"^[0-9]{5}$"),
    ("borough_code", r"(?i)boro.*(code|id|nbr)|^boro$", r"^[1-5]$"),
    ("borough", r"(?i)boro", r"(?i)^[a-z .]+$"),
    ("bin", r"(?i)(^|[^a-z])bin([^a-z]|$)", r"^[0-9]{7}$"),
    ("state_code", r"(?i)state", r"^[A-Z]{2}$"),
    ("x_coord", r"(?i)(^|[^a-z])x([^a-z]|$)", r"^[0-9.]+$"),
    ("y_coord", r"(?i)(^|[^a-z])y([^a-z]|$)", r"^[0-9.]+$"),
    ("address", r"(?i)addr|street", r"[0-9]"),
    ("city", r"(?i)city|town|nation", r"^[A-Za-z_ .0-9-]+$"),
)


def unpivot(table: DataFrame, dataset: str) -> DataFrame:
    """(dataset, pos, name, value): every cell as text."""
    cells = F.posexplode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in table.columns])).alias("pos", "cell")
    return table.select(F.lit(dataset).alias("dataset"), cells).select("dataset", "pos", "cell.name", "cell.value")


def numeric_stats(cells: DataFrame) -> DataFrame:
    """mean, stddev (population), min and max of the values that are numbers, for columns that have any."""
    n = X.safe_float(F.col("value"))
    stats = cells.withColumn("n", n).where("n IS NOT NULL").groupBy("dataset", "name")
    return stats.agg(*[F.round(f("n"), 4).alias(k) for k, f in (("mean", F.avg), ("stddev", F.stddev_pop), ("min", F.min), ("max", F.max))])


def distinct_counts(cells: DataFrame, exact: bool = True) -> DataFrame:
    count = F.count_distinct("value") if exact else F.approx_count_distinct("value")
    return cells.groupBy("dataset", "name").agg(count.alias("num_distinct_values"))


def _share(condition: Column) -> Column:
    return F.coalesce(F.avg(F.when(F.col("value").isNotNull(), condition.cast("double"))), F.lit(0.0))


def structural_types(cells: DataFrame) -> DataFrame:
    """(dataset, pos, name, structural_type, kind, unclean_values_ratio, nulls, n) of each column.

    A type holds if TYPE_SHARE of the non-null values pass; of several the first of GeoCoordinates, Number, DateTime.  The
    unclean ratio is the share of non-null values that don't pass the type.
    """
    v = F.col("value")
    date = v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9:.]+(Z|[+-][0-9:]+)?)?$") & X.parse_time(v).isNotNull()
    shares = cells.groupBy("dataset", "pos", "name").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(v.isNull(), 1)).alias("nulls"), _share(v.rlike(X.WKT_POINT)).alias("geo"),
        _share(X.safe_float(v).isNotNull()).alias("number"), _share(F.coalesce(date, F.lit(False))).alias("date"),
    )
    kind = F.when(F.col("geo") >= TYPE_SHARE, "spatial").when(F.col("name").rlike(X.LAT_NAME) | F.col("name").rlike(X.LON_NAME), "spatial")
    kind = kind.when(F.col("number") >= TYPE_SHARE, "numerical").when(F.col("date") >= TYPE_SHARE, "temporal").otherwise("categorical")
    structural = F.when(F.col("geo") >= TYPE_SHARE, "GeoCoordinates").when(F.col("number") >= TYPE_SHARE, "Number").when(F.col("date") >= TYPE_SHARE, "DateTime").otherwise("Text")
    clean = F.when(F.col("geo") >= TYPE_SHARE, F.col("geo")).when(F.col("number") >= TYPE_SHARE, F.col("number")).when(F.col("date") >= TYPE_SHARE, F.col("date")).otherwise(F.lit(1.0))
    return shares.select("dataset", "pos", "name", structural.alias("structural_type"), kind.alias("kind"), F.round(1 - clean, 4).alias("unclean_values_ratio"), "nulls", "n")


def unclean_ratio(cells: DataFrame) -> DataFrame:
    """(dataset, name, ratio): share of non-null values that are no number."""
    return cells.where("value IS NOT NULL").groupBy("dataset", "name").agg(F.round(F.avg(X.safe_float(F.col("value")).isNull().cast("double")), 4).alias("ratio"))


def numeric_histogram(cells: DataFrame, bins: int = 10) -> DataFrame:
    """(dataset, name, bin, bin_start, bin_end, count): equal bins between the least and the largest number; the last one is closed."""
    n = cells.select("dataset", "name", X.safe_float(F.col("value")).alias("x")).where("x IS NOT NULL")
    ends = n.groupBy("dataset", "name").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), width)), F.lit(bins - 1))).cast("int")
    counted = n.join(ends, ["dataset", "name"]).groupBy("dataset", "name", place.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("count"))
    return counted.select("dataset", "name", "bin", F.round(F.col("lo") + F.col("bin") * width, 4).alias("bin_start"), F.round(F.col("lo") + (F.col("bin") + 1) * width, 4).alias("bin_end"), "count")


def categorical_histogram(cells: DataFrame, top: int = 5) -> DataFrame:
    """(dataset, name, bin, count): the most frequent values, then by value."""
    counts = cells.where("value IS NOT NULL").groupBy("dataset", "name", F.col("value").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    order = Window.partitionBy("dataset", "name").orderBy(F.desc("count"), "bin")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def coverage_ranges(cells: DataFrame, most: int = RANGES, gap: float = GAP) -> DataFrame:
    """(dataset, name, range, gte, lte, n): the numbers of each column as up to `most` ranges, parted at the widest gaps between them.

    A gap parts ranges if it is `gap` of the whole range or more; of equal gaps the lower ones count first.  Bins narrower than such
    a gap keep their exact ends and add up across tasks, so that only a bounded number of rows a column is sorted, and no gap is missed.
    """
    x = cells.select("dataset", "name", X.safe_float(F.col("value")).alias("x")).where("x IS NOT NULL")
    ends = x.groupBy("dataset", "name").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    bins = math.ceil(4 / gap)
    place = F.coalesce(F.floor(F.try_divide(F.col("x") - F.col("lo"), (F.col("hi") - F.col("lo")) / bins)), F.lit(0))
    held = x.join(ends, ["dataset", "name"]).groupBy("dataset", "name", "lo", "hi", place.alias("bin")).agg(F.min("x").alias("gte"), F.max("x").alias("lte"), F.count(F.lit(1)).alias("n"))
    column = Window.partitionBy("dataset", "name")
    held = held.withColumn("gap", F.col("gte") - F.lag("lte").over(column.orderBy("bin")))
    held = held.withColumn("wide", F.coalesce((F.col("gap") > 0) & (F.col("gap") >= gap * (F.col("hi") - F.col("lo"))), F.lit(False)))
    held = held.withColumn("rank", F.row_number().over(column.orderBy(F.desc("wide"), F.desc_nulls_last("gap"), "gte")))
    held = held.withColumn("range", F.sum((F.col("wide") & (F.col("rank") < most)).cast("int")).over(column.orderBy("bin")).cast("int"))
    return held.groupBy("dataset", "name", "range").agg(F.min("gte").alias("gte"), F.max("lte").alias("lte"), F.sum("n").alias("n"))


def summary(cells: DataFrame) -> DataFrame:
    """One row a dataset: rows, columns, columns of each kind, types and attribute keywords in column order."""
    types = structural_types(cells)
    kinds = [F.count(F.when(F.col("kind") == k, 1)).alias(f"nb_{k}_columns") for k in ("spatial", "temporal", "numerical", "categorical")]
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"])
    return types.groupBy("dataset").agg(F.max("n").alias("nb_rows"), F.max("n").alias("nb_profiled_rows"), F.count(F.lit(1)).alias("nb_columns"), *kinds, F.sort_array(F.collect_set("kind")).alias("types"), names.alias("attribute_keywords"))


def spatial_coverage(cells: DataFrame) -> DataFrame:
    """(dataset, min_lon, min_lat, max_lon, max_lat) from columns named like latitudes or longitudes, and WKT points in any column.

    Values out of range are left out one by one; a point counts only if both its numbers are in range.
    """
    v, name = F.col("value"), F.col("name")
    x, in_lat, in_lon = X.safe_float(v), lambda c: c.between(-90, 90), lambda c: c.between(-180, 180)
    point = in_lat(X.wkt_lat(v)) & in_lon(X.wkt_lon(v))
    lat = F.array(F.when(name.rlike(X.LAT_NAME) & in_lat(x), x), F.when(point, X.wkt_lat(v)))
    lon = F.array(F.when(name.rlike(X.LON_NAME) & in_lon(x), x), F.when(point, X.wkt_lon(v)))
    each = cells.select("dataset", F.array_min(lat).alias("lat1"), F.array_max(lat).alias("lat2"), F.array_min(lon).alias("lon1"), F.array_max(lon).alias("lon2"))
    got = each.groupBy("dataset").agg(F.min("lon1").alias("min_lon"), F.min("lat1").alias("min_lat"), F.max("lon2").alias("max_lon"), F.max("lat2").alias("max_lat"))
    return got.where("min_lon IS NOT NULL AND min_lat IS NOT NULL")


def temporal_coverage(cells: DataFrame) -> DataFrame:
    """(dataset, start, end): first and last date in columns named like dates."""
    t = X.parse_date_like(F.col("value"))
    dates = cells.where(F.col("name").rlike(X.DATE_NAME)).select("dataset", t.alias("t")).where("t IS NOT NULL")
    return dates.groupBy("dataset").agg(F.to_date(F.min("t")).alias("start"), F.to_date(F.max("t")).alias("end"))


def geo_columns(cells: DataFrame, samples: int = 3) -> DataFrame:
    """(dataset, name, label, share, sample): the first class whose name pattern fits and whose value pattern GEO_SHARE of the values pass.

    sample: the first values in text order, joined by '|'.
    """
    v = F.col("value")
    agg = cells.groupBy("dataset", "name").agg(*[F.avg(F.when(v.isNotNull(), v.rlike(value).cast("double"))).alias(label) for label, _, value in GEO_RULES])
    fits = [F.when(F.col("name").rlike(name) & (F.col(label) >= GEO_SHARE), F.struct(F.lit(label).alias("label"), F.round(F.col(label), 4).alias("share"))) for label, name, _ in GEO_RULES]
    picked = agg.select("dataset", "name", F.coalesce(*fits).alias("fit")).where("fit IS NOT NULL")
    order = Window.partitionBy("dataset", "name").orderBy("value")
    firsts = cells.where("value IS NOT NULL").select("dataset", "name", "value").distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= samples)
    shown = firsts.groupBy("dataset", "name").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("sample"))
    return picked.join(shown, ["dataset", "name"]).select("dataset", "name", "fit.label", "fit.share", "sample")


def csv_line(columns: list[str]) -> Column:
    """A row as CSV text: values with a comma, quote or line break in quotes."""

    def quoted(c: str) -> Column:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(v.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return F.concat_ws(",", *map(quoted, columns))


def csv_sample(table: DataFrame, order: list[str], rows: int = 20) -> DataFrame:
    """One row with `sample`: header and first rows as CSV text."""
    first = table.orderBy(*order).limit(rows).select(F.struct(*order).alias("o"), csv_line(table.columns).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"])
    return first.agg(F.concat_ws("\n", F.array(F.lit(",".join(table.columns))), lines).alias("sample"))


def sample_bytes(lines: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """Lines (source, pos, line) of each source while rows and bytes last, with `row` and `upto`, the bytes so far; whole lines only.

    Sums in two levels: lines are dealt to ranges of (source, pos), totals of the ranges give where each starts, and only ranges that begin
    within the bounds are summed line by line.  So neither a source of any size nor any bound makes one task hold a source; only
    sizes are sorted, and texts join what is kept.  pos is unique in its source.
    """
    spark, path = lines.sparkSession, work_dir(lines.sparkSession, "sizes")
    sizes = lines.select("source", "pos", (F.octet_length("line") + 1).cast("long").alias("size"))
    sizes.repartitionByRange("source", "pos").withColumn("part", F.spark_partition_id()).write.parquet(path)
    held = spark.read.parquet(path)
    totals = held.groupBy(F.col("source").alias("of"), F.col("part").alias("in")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    before = Window.partitionBy("of").orderBy("in").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select("of", "in", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "size")])
    begins = begins.where((F.col("n_before") < max_rows) & (F.col("size_before") < max_bytes))
    run = Window.partitionBy("source", "part").orderBy("pos")
    each = held.join(begins, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    each = each.select(F.col("source").alias("of"), F.col("pos").alias("place"), (F.col("n_before") + F.row_number().over(run)).alias("row"), (F.col("size_before") + F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("upto"))
    kept = each.where((F.col("row") <= max_rows) & (F.col("upto") <= max_bytes))
    return lines.join(kept, F.col("source").eqNullSafe(F.col("of")) & (F.col("pos") == F.col("place"))).drop("of", "place")


def telemetry(all_lines: DataFrame, kept: DataFrame, max_rows: int) -> DataFrame:
    """(source, bytes, readable, newline_count, truncated_by_rows, truncated_by_bytes)."""
    whole = all_lines.groupBy("source").agg(F.count(F.lit(1)).alias("all_rows"))
    got = kept.groupBy("source").agg(F.max("upto").cast("long").alias("bytes"), F.count(F.lit(1)).alias("newline_count"))
    x = whole.join(got, "source", "left").na.fill(0, ["bytes", "newline_count"])
    short = F.col("newline_count") < F.col("all_rows")
    by_rows = short & (F.col("newline_count") >= max_rows)
    return x.select("source", "bytes", X.readable_bytes(F.col("bytes")).alias("readable"), "newline_count", by_rows.alias("truncated_by_rows"), (short & ~by_rows).alias("truncated_by_bytes"))


def profile_text(profiles: DataFrame) -> DataFrame:
    """(dataset, profile): JSON of profiles (dataset, nb_rows, nb_columns, types, columns, attribute_keywords, spatial_coverage).

    columns: array of structs name, structural_type, semantic_types, num_distinct_values, mean, std, min, max.  Wide tables keep core fields,
    at most MOST_COLUMNS columns are listed, and nulls and empty values are left out.
    """
    some = lambda c: F.when(F.size(c) > 0, c)
    wide = F.coalesce(F.col("nb_columns"), F.size("columns")) >= WIDE
    stats = ("num_distinct_values", "mean", "std", "min", "max")

    def entry(c: Column) -> Column:
        return F.struct(F.nullif(c["name"], F.lit("")).alias("name"), F.nullif(c["structural_type"], F.lit("")).alias("structural_type"), some(c["semantic_types"]).alias("semantic_types"), *[F.when(~wide, c[s]).alias(s) for s in stats])

    columns = some(F.transform(F.slice("columns", 1, MOST_COLUMNS), entry))
    cut = F.when(F.size("columns") > MOST_COLUMNS, F.struct(F.lit(MOST_COLUMNS).alias("shown"), F.size("columns").alias("total")))
    names = F.when(columns.isNull(), some(F.col("attribute_keywords")))
    spatial = F.when(F.col("spatial_coverage.label").isNotNull() | F.col("spatial_coverage.bbox").isNotNull(), F.col("spatial_coverage"))
    body = F.struct("nb_rows", "nb_columns", some(F.col("types")).alias("types"), columns.alias("columns"), cut.alias("columns_truncated"), names.alias("column_names"), spatial.alias("spatial_coverage"))
    return profiles.select("dataset", F.to_json(body).alias("profile"))


def preview(samples: DataFrame) -> DataFrame:
    """(id, row, names, cells) of samples (id, sample): header and rows of stored CSV text.

    Blank lines are skipped, quotes are honoured, short rows are padded with nulls.
    """
    lines = F.filter(F.split("sample", "\r?\n"), lambda x: F.trim(x) != "")
    cells = lambda line: F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1)), lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    x = samples.withColumn("lines", lines).where("size(lines) > 0").withColumn("names", cells(F.get("lines", F.lit(0))))
    x = x.select("id", "names", F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("row", "line"))
    own = cells(F.col("line"))
    return x.withColumn("own", own).select("id", "row", "names", F.transform(F.sequence(F.lit(0), F.size("names") - 1), lambda i: F.get("own", i)).alias("cells"))
