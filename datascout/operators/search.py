"""Hard filters, facets, totals, paging, joins of query tables with catalogs, and hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import boxes_touch
from .facets import single_values, top_values
from .overlaps import join_boxes, join_time  # noqa: F401
from .text import Index, lexical
from .vectors import knn


def in_domains(domains: list[str]) -> Column:
    """Domain is one of the list, blanks removed; an empty list filters nothing."""
    wanted = [d for d in domains if d]
    return F.col("domain").isin(wanted) if wanted else F.lit(True)


def any_type(types: list[str]) -> Column:
    wanted = [t for t in types if t]
    return F.arrays_overlap("types", F.array(*map(F.lit, wanted))) if wanted else F.lit(True)


def overlaps_time(start: str | None, end: str | None) -> Column:
    """Coverage overlaps [start, end]; either may be open; records without the date compared never match."""
    made = F.lit(True)
    if start:
        made = made & (F.col("t_end") >= F.lit(start).cast("date"))
    if end:
        made = made & (F.col("t_start") <= F.lit(end).cast("date"))
    return made


def touches_box(box: list[float]) -> Column:
    if len(box) != 4:
        raise ValueError("a box has four numbers: min lon, min lat, max lon, max lat")
    return boxes_touch(_box(), tuple(F.lit(float(x)) for x in box))


def _box(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(prefix + c) for c in ("min_lon", "min_lat", "max_lon", "max_lat"))


def browse(records: DataFrame, domains=(), types=(), start=None, end=None, box=None) -> DataFrame:
    """Records that pass all filters, unranked."""
    kept = records.where(in_domains(list(domains))).where(any_type(list(types))).where(overlaps_time(start, end))
    return kept.where(touches_box(box)) if box is not None else kept


def facet(matches: DataFrame, value: Column, size: int = 10) -> DataFrame:
    """(qid, key, n, other): the `size` most frequent values of each query's matches, and how many rows have another.

    An array counts a record once for each different value; null values count nowhere.
    """
    counts = single_values(matches, ["qid"], value).groupBy("qid", "key").agg(F.count(F.lit(1)).alias("n"))
    return top_values(counts, size)


def with_total(matches: DataFrame) -> DataFrame:
    """matches plus `total`, the number of matches of the query."""
    return matches.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("qid")))


def hybrid(queries: DataFrame, query_vectors: DataFrame, records: DataFrame, vectors: DataFrame, keep: Column, k: int = 10, knn_filter: str = "post", index: Index | None = None, **text) -> DataFrame:
    """(qid, id, score): records that pass `keep` and match the text or are among the k nearest; scores add up.

    knn_filter 'post' (default) finds neighbours in all records and filters then; 'pre' finds them among those that pass.
    index: the stored text index of records, if there is one.
    """
    if knn_filter not in ("post", "pre"):
        raise ValueError("knn_filter is 'post' or 'pre'")
    passing = records.where(keep)
    ids = passing.select("id")
    pool = vectors.join(ids, "id", "left_semi") if knn_filter == "pre" else vectors
    near = knn(query_vectors, pool, k).select("qid", "id", F.col("score").alias("vector_score"))
    words = lexical(queries, index or records, **text).select("qid", "id", F.col("score").alias("text_score"))
    # near has k rows a query and words those of most records, which then needn't be sorted
    both = words.join(near.hint("shuffle_hash"), ["qid", "id"], "full_outer").join(ids, "id", "left_semi")
    return both.select("qid", "id", F.round(F.coalesce("text_score", F.lit(0.0)) + F.coalesce("vector_score", F.lit(0.0)), 6).alias("score"))
