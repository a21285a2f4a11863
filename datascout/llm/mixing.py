"""Mixing sources to target weights (operator 1, native).

Every row gets a hash-random key; rows are range-sorted by it within their source; a distributed prefix sum of word
counts tells where the source's exact budget ends.  A budget above the source's size takes whole epochs first.

The prefix sum has two levels: word totals of (source, key range) are summed up within the source, and
rows are summed up within their key range.  So no task gets a whole source, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, WORD_SQL, bucket_count, column, hash52, hash52_sql, range_bucket, read_table, stash, text_key, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words; most epochs of a source.
SHARE, EPOCHS = 1.5, 2.0


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """sources (source, source_size) plus `target`.

    Targets share `share` of all words by weight; one that exceeds `epochs` times its source stops there, and the
    excess goes to the others by weight until none exceeds.  That fixed point is min(cap, weight * level) for the one
    level at which the targets add up, found from running sums in the order of cap / weight.  One row per
    source, so a single window over them is small.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    caps = sources.withColumns({"w": w, "cap": F.col("source_size") * F.lit(float(epochs))})
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total, all_w = F.sum("source_size").over(every) * F.lit(float(share)), F.sum("w").over(every)
    level = (F.col("total") - F.col("caps_before")) / (F.col("all_w") - F.col("w_before"))
    found = (
        caps.withColumns({"total": total, "all_w": all_w, "caps_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "w_before": F.coalesce(F.sum("w").over(before), F.lit(0.0))})
        .withColumn("level", level)
        # the first source, in this order, that the level leaves below its cap has the level of all that follow
        .withColumn("level", F.coalesce(F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(every), F.lit(0.0)))
    )
    return found.select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("w")).alias("target"))


def _narrow(docs: DataFrame, keep: list[Column], buckets: int) -> DataFrame:
    h = hash52(F.lit("mix"), text_key(F.col("doc_id")))
    return docs.select(*keep, "doc_id", "source", word_count(F.col("text")).alias("size"), h.alias("h")).withColumn("bucket", range_bucket(F.col("h"), buckets))


def take(narrow: DataFrame, *ties: Column) -> DataFrame:
    """narrow (source, size, h, bucket, ...) plus source_size, target and taken."""
    per_bucket = narrow.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sources = targets(per_bucket.groupBy("source").agg(F.sum("words").alias("source_size")))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        per_bucket.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .select(F.col("source").alias("of"), F.col("bucket").alias("at"), "start", "source_size", "target")
    )
    own = Window.partitionBy("source", "bucket").orderBy("h", *ties).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("size").over(own), F.lit(0))
    budget, whole = F.floor("target"), F.floor(F.col("budget") / F.greatest(F.col("source_size"), F.lit(1)))
    return (
        narrow.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")))
        .withColumn("inside", inside)
        .withColumn("budget", budget)
        .withColumn("whole", whole)
        .withColumn("left", F.col("budget") - F.col("whole") * F.col("source_size") - F.col("start") - F.col("inside"))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left"))).cast("long"))
        .withColumn("taken", (F.col("whole") * F.col("size") + F.col("part")).cast("long"))
        .drop("of", "at", "start", "inside", "budget", "left")
    )


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents.

    Null text has no words and is never taken; a null source is one source, the last; rows that repeat a doc_id are
    rows of their own (ties go by size; rows of one id and size are alike here).  An empty table gives an empty mix.
    """
    docs = read_table(spark, sf_dir, "documents")
    narrow = stash(_narrow(docs, [], bucket_count(docs.count())), "mix_rows")
    return take(narrow, F.col("size")).select("doc_id", "size", "source_size", "target", "taken", "source")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus: the rows of docs, one for each epoch that takes words of it.

    Rows that share id and word count come in the order of a hash of their text, so the mix is the same in any order of input.  A row that the budget ends in keeps its first words, as many as the budget has left, joined by one space; all others
    keep their text as it is.  n_chars follows a cut text if there is such a column.  Columns are those of docs, whatever their names.
    """
    row = F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    at = {c: F.col(f"row.c{i}") for i, c in enumerate(docs.columns)}
    needed = docs.select(row, *[F.col(c) for c in ("doc_id", "source", "text")])
    got = take(_narrow(needed, [F.col("row"), F.xxhash64("text").alias("tie")], bucket_count(docs.count())), F.col("size"), F.col("tie")).where("taken > 0")
    epochs = F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)
    epoch = F.explode(F.sequence(F.lit(1).cast("long"), epochs))
    text = at["text"]
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, F.greatest(F.col("part"), F.lit(1)).cast("int")), " ")
    cut = (F.col("epoch") > F.col("whole")) & (F.col("part") < F.col("size"))
    made = got.withColumn("epoch", epoch).withColumn("cut", F.when(cut, first))
    new = {"text": F.coalesce("cut", text), "n_chars": F.when(F.col("cut").isNotNull(), F.length("cut")).otherwise(at["n_chars"]) if "n_chars" in docs.columns else None}
    return made.select(*[new.get(c, at[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD_SQL}')), 0)::BIGINT AS size,
    {hash52_sql("'mix'", "coalesce(CAST(doc_id AS VARCHAR), 'null')")} AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w
  FROM d GROUP BY source),
c AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total, sum(w) OVER () AS all_w,
    coalesce(sum(source_size * 2.0::DOUBLE) OVER p, 0.0::DOUBLE) AS caps_before, coalesce(sum(w) OVER p, 0.0::DOUBLE) AS w_before
  FROM s WINDOW p AS (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - caps_before) / (all_w - w_before) AS own_level FROM c),
t AS (SELECT *, least(cap, w * coalesce(max(CASE WHEN own_level * w <= cap THEN own_level END) OVER (), 0.0)) AS target FROM l),
r AS (
  SELECT d.*, source_size, target, floor(target)::BIGINT AS budget, floor(target)::BIGINT // greatest(source_size, 1) AS whole,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, budget - whole * source_size - before)))::BIGINT AS taken, source FROM r"""
