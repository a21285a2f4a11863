"""Profiling queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import profile_states as N
from ..operators import profiling as P
from ..sources.workdir import table, work_dir

#: Tables and columns profiled; doubles are cast to decimals so that both engines print them alike.
TABLES = {
    "orders": {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_orderstatus": "o_orderstatus", "o_totalprice": "CAST(o_totalprice AS DECIMAL(14,2))", "order_date": "CAST(o_orderdate AS DATE)", "o_orderpriority": "o_orderpriority"},
    "part": {"p_partkey": "p_partkey", "p_name": "p_name", "p_brand": "p_brand", "p_type": "p_type", "p_size": "CASE WHEN p_size % 7 = 0 THEN 'n/a' ELSE CAST(p_size AS STRING) END", "p_retailprice": "CAST(p_retailprice AS DECIMAL(14,2))"},
    "supplier": {"s_suppkey": "s_suppkey", "s_name": "s_name", "latitude": "CAST(s_suppkey % 180 - 85 AS STRING)", "pickup_lon": "CAST(s_suppkey * 7 % 380 - 185 AS STRING)", "geo_point": "concat('POINT (', CAST(s_suppkey % 170 AS STRING), ' ', CAST(s_suppkey % 80 AS STRING), '.5)')", "zip": "CAST(10000 + s_suppkey % 89999 AS STRING)", "state": "CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE 'NY' END", "start_date": "CASE WHEN s_suppkey % 9 = 0 THEN 'soon' WHEN s_suppkey % 2 = 0 THEN concat('2021-0', CAST(s_suppkey % 9 + 1 AS STRING), '-1', CAST(s_suppkey % 10 AS STRING)) ELSE concat('0', CAST(s_suppkey % 9 + 1 AS STRING), '/2', CAST(s_suppkey % 9 AS STRING), '/2023') END"},
}


def cells(spark, sf, half=None):
    """The cells of all tables; half: of the rows with even or odd keys, the first column."""
    every = None
    for name, columns in TABLES.items():
        rows = table(spark, sf, name)
        rows = rows if half is None else rows.where(F.col(next(iter(columns))) % 2 == half)
        own = P.unpivot(rows.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()]), name)
        every = own if every is None else every.unionByName(own)
    return every


def _cells_sql():
    parts = [f"SELECT '{t}' AS dataset, {i} AS pos, '{c}' AS name, CAST({e} AS VARCHAR) AS value, {next(iter(cs))} % 2 AS half FROM {t}" for t, cs in TABLES.items() for i, (c, e) in enumerate(cs.items())]
    number = f"CASE WHEN regexp_matches(trim(value), '{X.NUMBER}') THEN TRY_CAST(trim(value) AS DOUBLE) END"
    return "cells AS (SELECT *, " + number + " AS x FROM (" + " UNION ALL ".join(parts).replace("AS STRING", "AS VARCHAR") + "))"


CELLS = "WITH " + _cells_sql()
_LAT, _LON = X.LAT_NAME, X.LON_NAME
TYPES = f"""shares AS (SELECT dataset, pos, name, count(*) AS n, count(*) FILTER (value IS NULL) AS nulls,
    coalesce(avg(CASE WHEN regexp_matches(value, '{X.WKT_POINT}') THEN 1.0 ELSE 0.0 END) FILTER (value IS NOT NULL), 0) AS geo,
    coalesce(avg(CASE WHEN x IS NOT NULL THEN 1.0 ELSE 0.0 END) FILTER (value IS NOT NULL), 0) AS number,
    coalesce(avg(CASE WHEN regexp_matches(value, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T][0-9:.]+(Z|[+-][0-9:]+)?)?$') THEN 1.0 ELSE 0.0 END) FILTER (value IS NOT NULL), 0) AS date FROM cells GROUP BY ALL),
  types AS (SELECT dataset, pos, name, CASE WHEN geo >= 0.9 THEN 'GeoCoordinates' WHEN number >= 0.9 THEN 'Number' WHEN date >= 0.9 THEN 'DateTime' ELSE 'Text' END AS structural_type,
    CASE WHEN geo >= 0.9 OR regexp_matches(name, '{_LAT}') OR regexp_matches(name, '{_LON}') THEN 'spatial' WHEN number >= 0.9 THEN 'numerical' WHEN date >= 0.9 THEN 'temporal' ELSE 'categorical' END AS kind,
    round(1 - CASE WHEN geo >= 0.9 THEN geo WHEN number >= 0.9 THEN number WHEN date >= 0.9 THEN date ELSE 1.0 END, 4)::DOUBLE AS unclean_values_ratio, nulls, n FROM shares)"""
_DATES = "COALESCE(TRY_CAST(value AS TIMESTAMP), TRY_STRPTIME(value, '%m/%d/%Y'))"


def q_summary(spark, sf):
    s = P.summary(cells(spark, sf))
    return s.withColumns({c: F.array_join(c, ",") for c in ("types", "attribute_keywords")})


def q_types(spark, sf):
    return P.structural_types(cells(spark, sf))


def q_dataset_types(spark, sf):
    return P.summary(cells(spark, sf)).select("dataset", F.explode("types").alias("type"))


def lines(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("source"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def q_sample_bytes(spark, sf):
    every = lines(spark, sf)
    return P.telemetry(every, P.sample_bytes(every, 8, 2000), 8)


def q_sample_rows(spark, sf):
    kept = P.sample_bytes(lines(spark, sf), 3, 1 << 40)
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("line") + 1).cast("long").alias("bytes"))


def q_csv_sample(spark, sf):
    parts = table(spark, sf, "part").selectExpr("p_partkey", "p_name", "concat(p_brand, ', \"', p_type, '\"') AS label")
    return P.csv_sample(parts, ["p_partkey"])


def q_preview(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey AS id", "concat('name,note,extra\\n', c_name, ',\"', c_mktsegment, ', \"\"x\"\"\"\\r\\n\\nb,', c_nationkey) AS sample")
    got = P.preview(c)
    return got.select("id", "row", F.array_join("names", "|").alias("names"), F.array_join("cells", "|", "NULL").alias("cells"))


def q_profile_text(spark, sf):
    c = cells(spark, sf)
    s, t = P.summary(c), P.structural_types(c).join(P.distinct_counts(c), ["dataset", "name"])
    column = F.struct("pos", "name", "structural_type", F.array().cast("array<string>").alias("semantic_types"), "num_distinct_values", *[F.lit(None).cast("double").alias(x) for x in ("mean", "std", "min", "max")])
    columns = t.groupBy("dataset").agg(F.transform(F.array_sort(F.collect_list(column)), lambda x: x.dropFields("pos")).alias("columns"))
    both = s.join(columns, "dataset").withColumn("spatial_coverage", F.lit(None).cast("struct<label:string,bbox:array<double>>"))
    return P.profile_text(both)


def q_coverage_text(spark, sf):
    return P.temporal_coverage(cells(spark, sf))


def merged_state(spark, sf):
    """The state of the even rows, stored, and that of the odd ones, merged."""
    path = work_dir(spark, "state")
    N.states(cells(spark, sf, 0)).write.parquet(path)
    return N.merged(spark.read.parquet(path), N.states(cells(spark, sf, 1)))


def q_profile_merged(spark, sf):
    """Distinct counts are estimates, so the query tells whether they are within 3 % of the exact ones."""
    exact = P.distinct_counts(cells(spark, sf)).withColumnRenamed("num_distinct_values", "exact")
    got = N.profiles(merged_state(spark, sf)).join(exact, ["dataset", "name"])
    near = F.abs(F.col("num_distinct_values") - F.col("exact")) <= 0.03 * F.col("exact")
    return got.select("dataset", "name", "n", "nulls", "mean", "stddev", "min", "max", near.alias("near"))


def q_hist_merged(spark, sf):
    return N.recounted(merged_state(spark, sf), cells(spark, sf))


#: Columns with gaps of different, equal and no width.
GAPPED = {"balance": "CAST(c_acctbal AS DECIMAL(14,2))", "tiers": "CAST(c_acctbal AS DECIMAL(14,2)) + c_custkey % 4 * 40000", "steps": "c_custkey % 7 * 1000", "two": "CASE WHEN c_custkey % 50 = 0 THEN 900000 + c_custkey ELSE c_custkey END", "one": "5", "key": "c_custkey"}


def q_ranges(spark, sf):
    gapped = P.unpivot(table(spark, sf, "customer").selectExpr(*[f"{e} AS {c}" for c, e in GAPPED.items()]), "customer")
    return P.coverage_ranges(cells(spark, sf).unionByName(gapped))


QUERIES = {
    "sample_rows": q_sample_rows,
    "sample_bytes": q_sample_bytes,
    "csv_sample": q_csv_sample,
    "sample_preview": q_preview,
    "profile_summary": q_summary,
    "profile_numeric": lambda spark, sf: P.numeric_stats(cells(spark, sf)),
    "profile_distinct": lambda spark, sf: P.distinct_counts(cells(spark, sf)),
    "profile_unclean": lambda spark, sf: P.unclean_ratio(cells(spark, sf)),
    "hist_numeric": lambda spark, sf: P.numeric_histogram(cells(spark, sf)),
    "hist_categorical": lambda spark, sf: P.categorical_histogram(cells(spark, sf)),
    "profile_merged": q_profile_merged,
    "hist_merged": q_hist_merged,
    "coverage_ranges": q_ranges,
    "column_types": q_types,
    "dataset_types": q_dataset_types,
    "spatial_coverage": lambda spark, sf: P.spatial_coverage(cells(spark, sf)),
    "temporal_coverage": q_coverage_text,
    "geo_columns": lambda spark, sf: P.geo_columns(cells(spark, sf)),
    "profile_text": q_profile_text,
}
_LINES = """WITH lines AS (SELECT doc_id AS source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
run AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY source ORDER BY pos) AS upto FROM lines)"""
_POINT = X.WKT_POINT
SQL = {
    "sample_rows": _LINES + " SELECT source, count(*) AS rows, sum(strlen(line) + 1)::BIGINT AS bytes FROM run WHERE pos <= 3 GROUP BY source",
    "sample_bytes": _LINES + """, kept AS (SELECT source, max(upto)::BIGINT AS bytes, count(*) AS n FROM run WHERE pos <= 8 AND upto <= 2000 GROUP BY source), w AS (SELECT source, count(*) AS all_rows FROM lines GROUP BY source),
j AS (SELECT w.source, coalesce(bytes, 0) AS bytes, coalesce(n, 0) AS newline_count, all_rows FROM w LEFT JOIN kept ON w.source = kept.source)
SELECT source, bytes, CASE WHEN bytes < 1024 THEN printf('%.2f B', bytes::DOUBLE) ELSE printf('%.2f KiB', bytes / 1024.0::DOUBLE) END AS readable, newline_count, newline_count < all_rows AND newline_count >= 8 AS truncated_by_rows, newline_count < all_rows AND newline_count < 8 AS truncated_by_bytes FROM j""",
    "csv_sample": '''SELECT 'p_partkey,p_name,label' || chr(10) || string_agg(p_partkey || ',' || p_name || ',"' || p_brand || ', ""' || p_type || '"""', chr(10) ORDER BY p_partkey) AS sample FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 20)''',
    "sample_preview": "SELECT c_custkey AS id, 0 AS row, 'name|note|extra' AS names, c_name || '|' || c_mktsegment || ', \"x\"|NULL' AS cells FROM customer UNION ALL SELECT c_custkey, 1, 'name|note|extra', 'b|' || c_nationkey || '|NULL' FROM customer",
    "profile_summary": CELLS + ", " + TYPES + " SELECT dataset, max(n) AS nb_rows, max(n) AS nb_profiled_rows, count(*) AS nb_columns, count(*) FILTER (kind = 'spatial') AS nb_spatial_columns, count(*) FILTER (kind = 'temporal') AS nb_temporal_columns, count(*) FILTER (kind = 'numerical') AS nb_numerical_columns, count(*) FILTER (kind = 'categorical') AS nb_categorical_columns, array_to_string(list_sort(list(DISTINCT kind)), ',') AS types, string_agg(name, ',' ORDER BY pos) AS attribute_keywords FROM types GROUP BY dataset",
    "profile_numeric": CELLS + " SELECT dataset, name, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS stddev, round(min(x), 4) AS min, round(max(x), 4) AS max FROM cells WHERE x IS NOT NULL GROUP BY ALL",
    "profile_distinct": CELLS + " SELECT dataset, name, count(DISTINCT value) AS num_distinct_values FROM cells GROUP BY ALL",
    "profile_unclean": CELLS + " SELECT dataset, name, round(avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS ratio FROM cells WHERE value IS NOT NULL GROUP BY ALL",
    "hist_numeric": CELLS + ", e AS (SELECT dataset, name, min(x) AS lo, max(x) AS hi FROM cells WHERE x IS NOT NULL GROUP BY ALL), b AS (SELECT dataset, name, lo, hi, CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / ((hi - lo) / 10)), 9) END::INTEGER AS bin FROM cells JOIN e USING (dataset, name) WHERE x IS NOT NULL) SELECT dataset, name, bin, round(lo + bin * ((hi - lo) / 10), 4) AS bin_start, round(lo + (bin + 1) * ((hi - lo) / 10), 4) AS bin_end, count(*) AS count FROM b GROUP BY dataset, name, bin, lo, hi",
    "hist_categorical": CELLS + ", c AS (SELECT dataset, name, value AS bin, count(*) AS count FROM cells WHERE value IS NOT NULL GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, name ORDER BY count DESC, bin) AS rank FROM c) WHERE rank <= 5",
    "profile_merged": CELLS + " SELECT dataset, name, count(*) AS n, count(*) FILTER (value IS NULL) AS nulls, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS stddev, round(min(x), 4) AS min, round(max(x), 4) AS max, true AS near FROM cells GROUP BY dataset, name",
    "hist_merged": CELLS + f""", c AS (SELECT dataset, name, half, value, count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, name, half ORDER BY n DESC, value) AS rank FROM c),
b AS (SELECT dataset, name, coalesce(sum(n) FILTER (rank = {N.KEPT + 1}), 0) AS bound FROM r GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY dataset, name ORDER BY n DESC, value) AS rank FROM (SELECT dataset, name, value, sum(n) AS n FROM r WHERE rank <= {N.KEPT} GROUP BY ALL)),
e AS (SELECT dataset, name, coalesce(max(n) FILTER (rank = {N.KEPT + 1}), 0) AS cut FROM m GROUP BY ALL),
x AS (SELECT dataset, name, value AS bin, count(*) AS count FROM cells WHERE (dataset, name, value) IN (SELECT (dataset, name, value) FROM m WHERE rank <= {N.KEPT}) GROUP BY ALL)
SELECT dataset, name, bin, count, rank, count > bound + cut AS certain FROM (SELECT *, row_number() OVER (PARTITION BY dataset, name ORDER BY count DESC, bin) AS rank FROM x) JOIN b USING (dataset, name) JOIN e USING (dataset, name) WHERE rank <= 5""",
    "coverage_ranges": CELLS + ", every AS (SELECT dataset, name, x FROM cells UNION ALL " + " UNION ALL ".join(f"SELECT 'customer', '{c}', CAST({e} AS DOUBLE) FROM customer" for c, e in GAPPED.items()) + f"""),
e AS (SELECT dataset, name, min(x) AS lo, max(x) AS hi FROM every GROUP BY ALL),
g AS (SELECT dataset, name, x, n, gap, gap > 0 AND gap >= {P.GAP} * (hi - lo) AS wide FROM (SELECT dataset, name, x, count(*) AS n, x - lag(x) OVER (PARTITION BY dataset, name ORDER BY x) AS gap FROM every WHERE x IS NOT NULL GROUP BY dataset, name, x) JOIN e USING (dataset, name)),
k AS (SELECT *, row_number() OVER (PARTITION BY dataset, name ORDER BY coalesce(wide, false) DESC, gap DESC NULLS LAST, x) AS rank FROM g),
r AS (SELECT *, sum(CASE WHEN wide AND rank < {P.RANGES} THEN 1 ELSE 0 END) OVER (PARTITION BY dataset, name ORDER BY x) AS range FROM k)
SELECT dataset, name, range::INTEGER AS range, min(x) AS gte, max(x) AS lte, sum(n)::BIGINT AS n FROM r GROUP BY dataset, name, range""",
    "column_types": CELLS + ", " + TYPES + " SELECT * FROM types",
    "dataset_types": CELLS + ", " + TYPES + " SELECT DISTINCT dataset, kind AS type FROM types",
    "spatial_coverage": CELLS + f""", p AS (SELECT *, TRY_CAST(regexp_extract(value, '{_POINT}', 1) AS DOUBLE) AS plon, TRY_CAST(regexp_extract(value, '{_POINT}', 2) AS DOUBLE) AS plat FROM cells),
u AS (SELECT dataset, x AS lat, NULL::DOUBLE AS lon FROM p WHERE regexp_matches(name, '{_LAT}') AND x BETWEEN -90 AND 90 UNION ALL SELECT dataset, NULL, x FROM p WHERE regexp_matches(name, '{_LON}') AND x BETWEEN -180 AND 180
  UNION ALL SELECT dataset, plat, plon FROM p WHERE plat BETWEEN -90 AND 90 AND plon BETWEEN -180 AND 180)
SELECT dataset, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM u GROUP BY dataset HAVING min(lon) IS NOT NULL AND min(lat) IS NOT NULL""",
    "temporal_coverage": CELLS + f' SELECT dataset, min({_DATES})::DATE AS start, max({_DATES})::DATE AS "end" FROM cells WHERE regexp_matches(name, \'{X.DATE_NAME}\') AND {_DATES} IS NOT NULL GROUP BY dataset',
    "geo_columns": CELLS + ", r(prio, label, np, vp) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}', '{c}')" for i, (a, b, c) in enumerate(P.GEO_RULES)) + """), f AS (SELECT dataset, name, label, prio, avg(CASE WHEN regexp_matches(value, vp) THEN 1.0 ELSE 0.0 END) AS share FROM cells JOIN r ON regexp_matches(name, np) WHERE value IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY dataset, name ORDER BY prio) AS n FROM f WHERE share >= 0.5), s AS (SELECT dataset, name, list_sort(list(DISTINCT value)) AS v FROM cells WHERE value IS NOT NULL GROUP BY ALL)
SELECT dataset, name, label, round(share, 4)::DOUBLE AS share, array_to_string(v[1:3], '|') AS sample FROM k JOIN s USING (dataset, name) WHERE n = 1""",
    "profile_text": CELLS + ", " + TYPES + """, d AS (SELECT dataset, name, count(DISTINCT value) AS nd FROM cells GROUP BY ALL)
SELECT dataset, '{"nb_rows":' || max(n) || ',"nb_columns":' || count(*) || ',"types":["' || array_to_string(list_sort(list(DISTINCT kind)), '","') || '"],"columns":[' || string_agg('{"name":"' || name || '","structural_type":"' || structural_type || '","num_distinct_values":' || nd || '}', ',' ORDER BY pos) || ']}' AS profile
FROM types JOIN d USING (dataset, name) GROUP BY dataset""",
}
