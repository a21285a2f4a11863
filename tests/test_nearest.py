"""Exact neighbours by matrix products: the same rows as scoring every pair in Spark."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from datascout.functions.scalars import squared_l2
from datascout.operators import nearest as N
from datascout.operators import search as S
from datascout.operators import vectors as V


def every_pair(queries, records, k):
    """Scores all pairs by Spark's expressions."""
    score = F.round(1.0 / (1.0 + squared_l2(F.col("qv"), F.col("vector"))), 6)
    own = queries.where("vector IS NOT NULL").select("qid", F.col("vector").alias("qv"))
    pairs = records.where("vector IS NOT NULL").join(own, F.size("qv") == F.size("vector")).select("qid", "id", score.alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def same(got, want):
    """Rows alike; NaN equals itself."""
    return sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))


ODD = [None, [], [1.0], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [1e30, -1e30], [1.5, 2.5], [1.5, 2.5], [1.5, 2.5], [float("-inf"), 0.0], [3000.0, 0.0], [1e-4, 0.0]]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_vectors(spark, kind):
    """Nulls, other lengths, missing numbers, NaN, infinity and copies; text ids order as Spark orders them."""
    rows = [(f"{chr(97 + i % 5)}é{i}", v) for i, v in enumerate(ODD * 3)] + [(None, [1.0, 2.0])]
    records = spark.createDataFrame(rows, f"id string, vector array<{kind}>").repartition(3)
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(ODD)] + [(3, [9.0, 9.0]), (None, [1.0, 2.0])], f"qid int, vector array<{kind}>")
    for k in (1, 4, 100):
        assert same(V.knn(queries, records, k), every_pair(queries, records, k))


@pytest.mark.parametrize("spread", [1.0, 0.003])
def test_close_scores_and_copies(spark, monkeypatch, spread):
    """Groups of copies whose scores tie, and scores that tie once they are rounded; queries in several blocks, records in several batches."""
    monkeypatch.setattr(V, "QUERY_BLOCK", 40)
    r = np.random.default_rng(5)
    points = np.vstack([r.normal(0, spread, (700, 8)), np.repeat(r.normal(0, spread, (4, 8)), 75, axis=0)]).astype(np.float32)
    r.shuffle(points)
    records = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<float>").repartition(4)
    queries = records.where("id % 10 = 0").withColumnRenamed("id", "qid")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "60")
    try:
        assert same(V.knn(queries, records), every_pair(queries, records, 10))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_few_pairs_are_scored_one_by_one(spark, monkeypatch):
    """The plan joins no pairs, and a task scores only those that the products don't rule out; ids that no query holds aren't kept."""
    records = spark.range(50).selectExpr("id", "array(1.0D * id, 2.0D) AS vector")
    plan = V.knn(records.withColumnRenamed("id", "qid"), records)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
    r, scored = np.random.default_rng(6), []
    plain = N.Best._scored
    monkeypatch.setattr(N.Best, "_scored", lambda self, *a: scored.append(len(a[-1])) or plain(self, *a))
    vectors = lambda n: pa.array(list(r.normal(size=(n, 16))), pa.list_(pa.float64()))
    best = N.Best(pa.table({"qid": pa.array(range(100)), "vector": vectors(100)}), 5)
    for b in range(20):
        at = np.arange(b * 10_000, b * 10_000 + 10_000)
        best.take(pa.record_batch({"id": pa.array(at), "place": pa.array(at), "vector": vectors(10_000)}))
    assert sum(scored) < 0.02 * 100 * 200_000 and best.n_ids < 120_000
    assert sum(len(b) for b in best.rows()) == 500


def test_no_queries_and_no_records(spark):
    records = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vector array<double>")
    queries = records.withColumnRenamed("id", "qid")
    assert V.knn(queries.limit(0), records).collect() == [] == V.knn(queries, records.limit(0)).collect() == V.knn(queries, records, 0).collect()
    assert V.knn(queries.limit(0), records).columns == ["qid", "id", "score", "rank"]


def test_rounding_at_halves():
    assert N.keys_of(np.array([1.0, 0.0, 0.5, 0.1234565, 0.1234564999, 0.0000005, float("nan")])).tolist() == [1_000_000, 0, 500_000, 123_457, 123_456, 1, N.NAN]


def test_hybrid_sorts_no_matches(spark):
    """Text matches, which most records are, meet the few neighbours by hashes of these; matches by one of the two alone are kept."""
    records = spark.createDataFrame([(1, "apple pie", True), (2, "pear", True), (3, "apple", False), (4, "plum", True)], "id long, description string, ok boolean")
    vectors = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [0.0]), (4, [3.0])], "id long, vector array<float>")
    queries = spark.createDataFrame([(7, "apple"), (8, "plum")], "qid long, keywords string")
    asked = spark.createDataFrame([(7, [0.0]), (9, [3.0])], "qid long, vector array<float>")
    hits = S.hybrid(queries, asked, records, vectors, F.col("ok"), k=3, title_boost=0.0, operator="or")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [qid" in plan and "SortMergeJoin [qid" not in plan and "MapInArrow" in plan
    got = {(r.qid, r.id): r.score for r in hits.collect()}
    assert set(got) == {(7, 1), (7, 2), (8, 4), (9, 4), (9, 2), (9, 1)}  # of 1 and 3, as near to 9, the smaller id
    assert got[7, 1] > 1.0 and got[7, 2] == 0.5 and got[9, 4] == 1.0 and got[9, 2] == 0.2 and got[8, 4] > 0


def test_lists_broadcast_a_query_once(spark, monkeypatch):
    """No query is copied for each list it looks into; where the lists hold all neighbours, the rows are those of the exact search, ties by text ids too."""
    r = np.random.default_rng(8)
    points = np.vstack([r.normal(0, 1, (400, 4)), np.repeat(r.normal(0, 1, (3, 4)), 60, axis=0)]).astype(np.float32)
    r.shuffle(points)
    records = spark.createDataFrame([(f"{(i * 7919) % 1000}é", p.tolist()) for i, p in enumerate(points)], "id string, vector array<float>").repartition(4)
    records = records.unionByName(spark.createDataFrame([("none", None)], records.schema))
    queries = records.limit(90).withColumnRenamed("id", "qid").localCheckpoint()
    monkeypatch.setattr(V, "QUERY_BLOCK", 30)
    got = V.knn_lists(queries, records, 7, lists=12, recall=1.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "explode" not in plan and "MapInArrow" in plan
    assert same(got, V.knn(queries, records, 7))


def test_lists_bound_the_pairs(spark):
    """Only queries that look into a row's list meet it."""
    asked = pa.table({"qid": pa.array([1, 2]), "vector": pa.array([[0.0], [0.0]]), "lists": pa.array([b"\x80", b"\x60"], pa.binary())})
    best = N.Best(asked, 2)
    best.take(pa.record_batch({"id": pa.array([10, 11, 12, 13]), "vector": pa.array([[1.0], [2.0], [3.0], [0.0]]), "list": pa.array([0, 1, 2, 7]), "place": pa.array([4, 3, 2, 1])}))
    assert sorted((b["qid"], b["id"]) for x in best.rows() for b in x.to_pylist()) == [(1, 10), (2, 11), (2, 12)]
