"""Search queries over the derived catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facets as B
from ..operators import search as S
from ..operators import text as T
from ..operators import vectors as V
from ..sources.workdir import work_dir
from .facade import CATALOG, RANGES, catalog, queries, query_ranges, text_index, vectors

def tokens_sql(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
    pattern = T.TOKEN.replace("'", "''")
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '{pattern}', 1), lambda t: t NOT IN ({stop}))"


FULL = "q AS (SELECT item_id AS qid, text AS keywords FROM benchmark)"
#: A stated query set for vectors: ids divisible by 20.
NEAR = """near AS (SELECT qid, id, score AS vscore, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
  SELECT a.vec_id AS qid, b.vec_id AS id, round(1.0::DOUBLE / (1.0::DOUBLE + list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)))), 6) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE rank <= 10)"""


def bm25_sql(name: str, field: str) -> str:
    return f"""{name}_t AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({tokens_sql('keywords')}) AS term FROM q) GROUP BY ALL),
{name}_d AS (SELECT id, {tokens_sql(field)} AS toks FROM catalog),
{name}_s AS (SELECT count(*) AS n, sum(len(toks))::DOUBLE / count(*) AS avgdl FROM {name}_d WHERE len(toks) > 0),
{name}_p AS (SELECT term, id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(toks) AS dl, unnest(toks) AS term FROM {name}_d) GROUP BY term, id),
{name}_f AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name} AS (
  SELECT qid, id, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl)))) AS score, count(*) AS matched,
    any_value(n_terms) AS n_terms
  FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS n_terms FROM {name}_t) JOIN {name}_f USING (term) JOIN {name}_p USING (term), {name}_s GROUP BY qid, id)"""


def lexical_sql(field: str, boost: float, op: str, source: str = FULL) -> str:
    keep = "WHERE matched = n_terms" if op == "and" else ""
    title = f"SELECT qid, id, score * {boost}::DOUBLE AS score FROM bt {keep} UNION ALL " if boost > 0 else ""
    both = f"{bm25_sql('bt', 'title')}, " if boost > 0 else ""
    return f"WITH {source}, {CATALOG}, {both}{bm25_sql('bd', field)}, hits AS (SELECT qid, id, round(max(score), 6) AS score FROM ({title}SELECT qid, id, score FROM bd {keep}) GROUP BY qid, id)"


def top_sql(n: int, offset: int = 0) -> str:
    return f" SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM hits) WHERE rank > {offset} AND rank <= {offset + n}"


def joined(c):
    return F.array_join(c, ",")


def q_tokens(spark, sf):
    each = catalog(spark, sf).select(F.explode(T.tokens(F.col("description"))).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def q_postings(spark, sf):
    p = text_index(spark, sf).postings.where("field = 'description'")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


def q_bm25(spark, sf):
    hits = T.indexed_bm25(queries(spark, sf), text_index(spark, sf), "description").select("qid", "id", F.round("score", 6).alias("score"))
    return T.ranked(hits, 10)


def _lexical(arm, boost, op, limit=10, offset=0):
    return lambda spark, sf: T.ranked(T.lexical(queries(spark, sf), text_index(spark, sf), arm, boost, op), limit, offset)


def q_arms(spark, sf):
    every, index = None, text_index(spark, sf)
    for arm in T.ARMS:
        own = T.ranked(T.lexical(queries(spark, sf), index, arm, 0.0, "or"), 5).withColumn("arm", F.lit(arm))
        every = own if every is None else every.unionByName(own)
    return every


def _filtered(keep):
    return lambda spark, sf: catalog(spark, sf).where(keep()).select("id", "domain", joined("types").alias("types"), "t_start", "t_end", "min_lon", "min_lat")


def _filtered_sql(where):
    return f"WITH {CATALOG} SELECT id, domain, array_to_string(types, ',') AS types, t_start, t_end, min_lon, min_lat FROM catalog WHERE {where}"


def _matches(spark, sf):
    return T.lexical(queries(spark, sf), text_index(spark, sf), "original", 0.0, "or")


def q_total(spark, sf):
    return S.with_total(_matches(spark, sf)).select("qid", "total").distinct()


def _facet(col):
    def run(spark, sf):
        return B.facet(_matches(spark, sf), B.index_values(catalog(spark, sf), F.col(col)))

    return run


def _facet_sql(expr):
    return lexical_sql("description", 0, "or") + f""", e AS (SELECT qid, {expr} AS key FROM hits JOIN catalog USING (id)),
c AS (SELECT qid, key, count(*) AS n, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, key) AS rank, sum(count(*)) OVER (PARTITION BY qid) AS total FROM e WHERE key IS NOT NULL GROUP BY qid, key)
SELECT qid, key, n, (total - sum(n) OVER (PARTITION BY qid))::BIGINT AS other FROM c WHERE rank <= 10"""


def q_knn(spark, sf):
    v = vectors(spark, sf)
    return V.knn(v.where("id % 20 = 0").withColumnRenamed("id", "qid"), v)


def q_approximate(spark, sf):
    v = vectors(spark, sf)
    return V.knn_lists(v.where("id % 20 = 0").withColumnRenamed("id", "qid"), v)


def q_codes(spark, sf):
    """The codes are stored once and searched from there."""
    v, path = vectors(spark, sf), work_dir(spark, "codes")
    books, codes = V.compress(v)
    codes.write.parquet(path)
    return V.knn_codes(v.where("id % 20 = 0").withColumnRenamed("id", "qid"), v, spark.read.parquet(path), books)


def q_hybrid(spark, sf):
    v = vectors(spark, sf)
    hits = S.hybrid(queries(spark, sf), v.where("id % 20 = 0").withColumnRenamed("id", "qid"), catalog(spark, sf), v, F.col("provider") == "socrata", index=text_index(spark, sf), title_boost=0.0, operator="or")
    return T.ranked(hits, 10)


def q_join_time(spark, sf):
    return S.join_time(query_ranges(spark, sf), catalog(spark, sf)).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.sum("id").alias("ids"))


def q_join_boxes(spark, sf):
    return S.join_boxes(query_ranges(spark, sf), catalog(spark, sf))


def q_browse(spark, sf):
    kept = S.browse(catalog(spark, sf), ["src1", "src2", ""], ["en", "long"], "2021-01-01", "2022-06-30", [-120.0, -60.0, 120.0, 60.0])
    return kept.select("id", "title", "domain")


def q_embed(spark, sf):
    return V.embed(catalog(spark, sf).select("id", "description"), "description").select("id", F.size("vector").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 3).alias("norm"))


_BOX_A = "(CASE WHEN q_min_lon <= q_max_lon THEN min_lon <= q_max_lon AND q_min_lon <= max_lon ELSE (min_lon <= 180 AND q_min_lon <= max_lon) OR (min_lon <= q_max_lon AND -180 <= max_lon) END)"
QUERIES = {
    "tokens": q_tokens,
    "postings": q_postings,
    "bm25": q_bm25,
    "search_lexical": _lexical("original", 2.0, "or"),
    "search_and": _lexical("original", 2.0, "and"),
    "search_or": _lexical("original", 1.0, "or"),
    "search_boost": _lexical("ufd", 5.0, "or"),
    "search_arms": q_arms,
    "search_page": _lexical("original", 2.0, "or", limit=10, offset=20),
    "search_total": q_total,
    "facet_domain": _facet("domain"),
    "facet_types": _facet("types"),
    "filter_domain": _filtered(lambda: S.in_domains(["src1", "", "src7"])),
    "filter_types": _filtered(lambda: S.any_type(["de", "spatial"])),
    "filter_temporal": _filtered(lambda: S.overlaps_time("2021-03-01", "2021-09-30")),
    "filter_bbox": _filtered(lambda: S.touches_box([170.0, -40.0, -150.0, 40.0])),
    "join_temporal": q_join_time,
    "join_bbox": q_join_boxes,
    "browse": q_browse,
    "knn": q_knn,
    "knn_lsh": q_approximate,
    "knn_codes": q_codes,
    "search_hybrid": q_hybrid,
    "embed_hash": q_embed,
}
SQL = {
    "tokens": f"WITH {CATALOG} SELECT term, count(*) AS n FROM (SELECT unnest({tokens_sql('description')}) AS term FROM catalog) GROUP BY term",
    "postings": f"WITH {CATALOG} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS max_tf FROM (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest({tokens_sql('description')}) AS term FROM catalog) GROUP BY ALL) GROUP BY term",
    "bm25": lexical_sql("description", 0, "or") + top_sql(10),
    "search_lexical": lexical_sql("description", 2.0, "or") + top_sql(10),
    "search_and": lexical_sql("description", 2.0, "and") + top_sql(10),
    "search_or": lexical_sql("description", 1.0, "or") + top_sql(10),
    "search_boost": lexical_sql("ufd", 5.0, "or") + top_sql(10),
    "search_arms": f"WITH {FULL}, {CATALOG}, " + ", ".join(bm25_sql(f"b{a}", f) for a, f in T.ARMS.items()) + " SELECT qid, id, score, rank, arm FROM (SELECT *, row_number() OVER (PARTITION BY arm, qid ORDER BY score DESC, id) AS rank FROM (" + " UNION ALL ".join(f"SELECT qid, id, round(score, 6) AS score, '{a}' AS arm FROM b{a}" for a in T.ARMS) + ")) WHERE rank <= 5",
    "search_page": lexical_sql("description", 2.0, "or") + top_sql(10, 20),
    "search_total": lexical_sql("description", 0, "or") + " SELECT qid, count(*) AS total FROM hits GROUP BY qid",
    "facet_domain": _facet_sql("domain"),
    "facet_types": _facet_sql("unnest(list_distinct(types))"),
    "filter_domain": _filtered_sql("domain IN ('src1', 'src7')"),
    "filter_types": _filtered_sql("list_has_any(types, ['de', 'spatial'])"),
    "filter_temporal": _filtered_sql("t_end >= DATE '2021-03-01' AND t_start <= DATE '2021-09-30'"),
    "filter_bbox": _filtered_sql("min_lat <= 40 AND max_lat >= -40 AND (max_lon >= 170 OR min_lon <= -150)"),
    "join_temporal": f"WITH {CATALOG}, {RANGES} SELECT qid, count(*) AS n, min(id) AS first_id, sum(id)::BIGINT AS ids FROM ranges JOIN catalog ON t_end >= q_start AND t_start <= q_end GROUP BY qid",
    "join_bbox": f"WITH {CATALOG}, {RANGES} SELECT qid, id FROM ranges JOIN catalog ON min_lat <= q_max_lat AND q_min_lat <= max_lat AND {_BOX_A}",
    "browse": f"WITH {CATALOG} SELECT id, title, domain FROM catalog WHERE domain IN ('src1', 'src2') AND list_has_any(types, ['en', 'long']) AND t_end >= DATE '2021-01-01' AND t_start <= DATE '2022-06-30' AND min_lon <= 120 AND max_lon >= -120 AND min_lat <= 60 AND max_lat >= -60",
    "knn": f"WITH {NEAR} SELECT qid, id, vscore AS score, rank FROM near",
    "search_hybrid": lexical_sql("description", 0, "or").replace("hits AS (", "words AS (") + f", {NEAR}, hits AS (SELECT qid, id, round(coalesce(score, 0) + coalesce(vscore, 0), 6) AS score FROM words FULL JOIN near USING (qid, id) WHERE id IN (SELECT id FROM catalog WHERE provider = 'socrata'))" + top_sql(10),
}
