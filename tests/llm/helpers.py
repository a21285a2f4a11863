"""Small tables for the operators' tests."""

import random
import tempfile

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def documents(spark, rows, extra=()):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    for name in extra:
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def saved(spark, **tables):
    """A folder with the tables as NAME.parquet."""
    path = tempfile.mkdtemp(prefix="spark-")
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return path


def words(seed, n, vocabulary=5000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]
