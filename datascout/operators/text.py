"""Text index and BM25 ranking of many queries against many records at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Token pattern, English stop words, and the ranking constants.
TOKEN = r"([\p{L}\p{N}_]+(?:['’.][\p{L}\p{N}_]+)*)"
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
K1, B = 1.2, 0.75
#: Most query terms, all queries together, that are broadcast to the postings.
MOST_TERMS = 200_000
#: Query terms up to which the scan of postings is narrowed to them (Parquet looks for up to ten values by name).
FEW_TERMS = 10
#: Description column of each arm.
ARMS = {"original": "description", "ufd": "ufd", "sfd": "sfd"}


def tokens(text: Column) -> Column:
    """Lower-cased tokens without stop words, in order; null text has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS))


def postings(records: DataFrame, field: str) -> DataFrame:
    """(term, id, tf) of a text field."""
    return records.select("id", F.explode(tokens(F.col(field))).alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, qtf, n_terms) of queries (qid, keywords): repeated terms count as often as they occur."""
    each = queries.select("qid", F.explode(tokens(F.col("keywords"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    return each.withColumn("n_terms", F.count(F.lit(1)).over(Window.partitionBy("qid")))


def bm25(queries: DataFrame, records: DataFrame, field: str) -> DataFrame:
    """(qid, id, score, matched, n_terms): BM25 of one field.

    Lengths and collection sizes come from token counts of each record without exploding it; only tokens that
    some query asks for are exploded into postings and shuffled.
    """
    terms = query_terms(queries)
    wanted = terms.select("term").distinct()
    docs = records.select("id", tokens(F.col(field)).alias("toks")).withColumn("dl", F.size("toks"))
    stats = docs.where("dl > 0").agg(F.count(F.lit(1)).alias("n"), (F.sum("dl") / F.count(F.lit(1))).alias("avgdl"))
    hits = docs.select("id", "dl", F.explode("toks").alias("term")).join(wanted, "term", "left_semi")
    tf = hits.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    x = terms.join(df, "term").join(tf, "term").crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return x.groupBy("qid", "id").agg(F.sum(F.col("qtf") * idf * norm).alias("score"), F.count(F.lit(1)).alias("matched"), F.first("n_terms").alias("n_terms"))


@dataclass(frozen=True)
class Index:
    """A stored text index: postings (field, term, id, tf, dl), terms (field, term, df) and stats (field, n, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def _field_postings(records: DataFrame, fields: list[str]) -> DataFrame:
    """(field, term, id, dl, tf, head) of each record; head marks one posting of each field of a record.

    A field's tokens are all in one row, so sorting them puts repeats side by side: they are counted where they are, without a shuffle.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.array_sort(tokens(F.col(f))).alias("toks")) for f in fields]))
    rows = records.select("id", each.alias("x")).select("id", "x.field", "x.toks").withColumn("dl", F.size("toks")).where("dl > 0")
    starts = F.filter(F.sequence(F.lit(0), F.col("dl") - 1), lambda i: (i == 0) | (F.get("toks", i) != F.get("toks", i - 1)))
    runs = rows.withColumn("starts", starts).withColumn("run", F.explode(F.arrays_zip(F.col("starts").alias("a"), F.slice("starts", 2, 1 << 30).alias("b"))))
    tf = (F.coalesce("run.b", "dl") - F.col("run.a")).cast("long")
    return runs.select("field", F.get("toks", F.col("run.a")).alias("term"), "id", F.col("dl").cast("long").alias("dl"), tf.alias("tf"), (F.col("run.a") == 0).alias("head"))


def build_index(records: DataFrame, fields: list[str], path: str) -> Index:
    """Tokenises the fields of records (id, ...) once and writes their index; searches then read postings, never texts.

    Each task writes the postings of its own records, sorted by term: nothing is shuffled, a frequent term is in all files, and a search for
    few terms skips the pages of others.  Document frequencies and field totals are counted from the written postings.
    A record without tokens in a field counts in none of its numbers.  Ids repeat nowhere.
    """
    _field_postings(records, fields).sortWithinPartitions("field", "term").write.partitionBy("field").parquet(f"{path}/postings")
    held = open_index(records.sparkSession, path, dict(records.dtypes)["id"], ("postings",))
    held.postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")).write.partitionBy("field").parquet(f"{path}/terms")
    n = F.count(F.when(F.col("head"), 1))
    held.postings.groupBy("field").agg(n.alias("n"), (F.sum("tf") / n).alias("avgdl")).write.parquet(f"{path}/stats")
    return open_index(records.sparkSession, path, dict(records.dtypes)["id"])


def open_index(spark: SparkSession, path: str, id_type: str = "bigint", parts: tuple[str, ...] = ("postings", "terms", "stats")) -> Index:
    """The index at path, as build_index() wrote it."""
    ddl = {"postings": f"term string, id {id_type}, dl bigint, tf bigint, head boolean, field string", "terms": "term string, df bigint, field string", "stats": "field string, n bigint, avgdl double"}
    return Index(*[spark.read.schema(ddl[p]).parquet(f"{path}/{p}") if p in parts else None for p in ddl])


def _pages_of(postings: DataFrame, terms: DataFrame, few: int) -> DataFrame:
    """postings, or those of the terms (t) if the queries have few: the scan then skips pages without them."""
    if few > FEW_TERMS:
        return postings
    wanted = [r.t for r in terms.select("t").distinct().collect()]
    return postings.where(F.col("term").isin(wanted)) if wanted else postings.limit(0)


def indexed_bm25(queries: DataFrame, index: Index, field: str) -> DataFrame:
    """As bm25(), from a stored index: the queries' terms meet the term table, then the postings.

    The terms of all queries are broadcast if they are few, so that postings aren't shuffled for the join and a frequent term is
    no hot key; larger query tables join by term, where Spark splits skewed terms.
    """
    terms = query_terms(queries).join(index.terms.where(F.col("field") == field).select(F.col("term").alias("t"), "df"), F.col("term") == F.col("t")).drop("t")
    terms = terms.crossJoin(F.broadcast(index.stats.where(F.col("field") == field).select("n", "avgdl")))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = terms.select(F.col("term").alias("t"), "qid", "n_terms", "avgdl", (F.col("qtf") * idf).alias("weight"))
    few = queries.agg(F.sum(F.size(tokens(F.col("keywords"))))).first()[0] or 0
    x = _pages_of(index.postings.where(F.col("field") == field), terms, few).join(F.broadcast(terms) if few <= MOST_TERMS else terms, F.col("term") == F.col("t"))
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return x.groupBy("qid", "id").agg(F.sum(F.col("weight") * norm).alias("score"), F.count(F.lit(1)).alias("matched"), F.first("n_terms").alias("n_terms"))


def search_fields(arm: str, title_boost: float) -> dict[str, float]:
    """Weights of the fields searched: the title (unless its boost isn't positive) and the arm's description."""
    if arm not in ARMS:
        raise ValueError(f"unknown description arm {arm!r}: one of {', '.join(ARMS)}")
    return ({"title": title_boost} if title_boost > 0 else {}) | {ARMS[arm]: 1.0}


def lexical(queries: DataFrame, records: DataFrame | Index, arm: str = "original", title_boost: float = 2.0, operator: str = "and") -> DataFrame:
    """(qid, id, score): best field of each match; 'and' asks for all terms in one field.  records: a table, or its index."""
    if operator not in ("and", "or"):
        raise ValueError(f"operator must be 'and' or 'or', not {operator!r}")
    every = None
    for field, boost in search_fields(arm, title_boost).items():
        own = indexed_bm25(queries, records, field) if isinstance(records, Index) else bm25(queries, records, field)
        own = (own.where("matched = n_terms") if operator == "and" else own).select("qid", "id", (F.col("score") * boost).alias("score"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy("qid", "id").agg(F.round(F.max("score"), 6).alias("score"))


def ranked(matches: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Rows offset+1 to offset+limit of each query by score, then id, with their `rank`."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    top = matches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= offset + limit)
    return top.where(F.col("rank") > offset)
