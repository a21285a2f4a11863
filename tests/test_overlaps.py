import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from datascout.functions import scalars as X
from datascout.operators import overlaps as O
from datascout.operators import profiling as P

BOX = ("min_lon", "min_lat", "max_lon", "max_lat")


def pairs(df):
    return sorted(map(tuple, df.collect()))


def intervals(spark, first, days, length, n=300, seed=1):
    r = random.Random(seed)
    rows = [(i, r.randrange(days), r.randrange(length)) for i in range(n)]
    rows += [(n, None, 3), (n + 1, 5, None), (n + 2, 5, -2), (n + 3, 0, 0), (n + 3, 0, 0), (n + 4, days // 2, length * 3)]
    df = spark.createDataFrame(rows, "id long, a int, b int")
    return df.selectExpr("id", f"date_add(date'{first}', a) AS t_start", f"date_add(date'{first}', a + b) AS t_end")


@pytest.mark.parametrize("first, days, length", [("2021-01-01", 365, 20), ("1500-01-01", 150_000, 120_000), ("2021-01-01", 1, 2)])
def test_interval_joins(spark, monkeypatch, first, days, length):
    monkeypatch.setattr(O, "LOAD", 25)
    r, q = intervals(spark, first, days, length), intervals(spark, first, days, length, 60, 2).toDF("qid", "q_start", "q_end")
    assert pairs(O.join_time(q, r)) == pairs(q.crossJoin(r).where("q_start <= q_end AND t_start <= t_end AND t_end >= q_start AND t_start <= q_end").select("qid", "id"))


def test_interval_cells_follow_the_data(spark, monkeypatch):
    monkeypatch.setattr(O, "LOAD", 100)
    starts = spark.range(5000).selectExpr("id", "cast(id % 365 AS double) AS x")  # all in one year
    spans = spark.range(50).selectExpr("id AS qid", "cast(-36500 AS double) AS lo", "cast(id AS double) AS hi").unionAll(spark.range(50).selectExpr("id + 50", "cast(id * 7 AS double)", "cast(id * 7 + 3 AS double)"))
    dealt, held = O.dealt(starts, spans)
    most = max(r["count"] for r in dealt.groupBy("cell").count().collect())
    assert most <= 250  # a day holds 14 starts; cells are drawn from a sample
    matches = dealt.join(held, "cell").where("lo <= x AND x <= hi").count()
    assert held.count() <= 2 * 100 + matches / 30


def boxes(spark, rows, prefix=""):
    key = "qid" if prefix else "id"
    return spark.createDataFrame([(i, *map(lambda v: None if v is None else float(v), b)) for i, b in enumerate(rows)], f"{key} long, " + ", ".join(f"{prefix}{c} double" for c in BOX))


def plain(q, r):
    at = tuple(F.col("q_" + c) for c in BOX), tuple(map(F.col, BOX))
    return pairs(q.crossJoin(r).where("q_min_lat <= q_max_lat AND min_lat <= max_lat AND q_min_lon <> 999 AND min_lon <> 999").where(X.boxes_touch(*at)).select("qid", "id"))


def mixed(seed, n):
    r, out = random.Random(seed), []
    for _ in range(n):
        lon, lat = r.choice([(r.uniform(-180, 180), r.uniform(-90, 90)), (r.uniform(2.2, 2.4), r.uniform(48.8, 48.9)), (r.randrange(-18, 19) * 10, r.randrange(-9, 10) * 10)])
        w, h = r.choice([(0, 0), (0.01, 0.01), (1, 1), (10, 10), (359, 100), (90, 0)])
        hi = lon + w
        out.append((lon, lat, hi - 360 if hi > 180 else hi, min(lat + h, 90)))
    world = [(-180, -90, 180, 90), (179, -1, -179, 1), (180, 90, 180, 90), (-180, -90, -180, -90), (0, 0, 0, 0), (-200, -95, 200, 95), (170, 10, 190, 20)]
    return out + world + [(None, 0, 1, 1), (0, None, 1, 1), (5, 10, 6, 9)]


@pytest.mark.parametrize("load", [5, 40, 100_000])
def test_box_joins(spark, monkeypatch, load):
    monkeypatch.setattr(O, "LOAD", load)
    q, r = boxes(spark, mixed(3, 60), "q_"), boxes(spark, mixed(4, 250))
    assert pairs(O.join_boxes(q, r)) == plain(q, r)


def test_all_boxes_in_one_city_and_world_sized_boxes(spark, monkeypatch):
    monkeypatch.setattr(O, "LOAD", 50)
    rnd = random.Random(9)
    city = [(x := rnd.uniform(2.25, 2.42), y := rnd.uniform(48.81, 48.9), x + 0.0002, y + 0.0002) for _ in range(3000)]
    q, r = boxes(spark, [*city[:40], (-180, -90, 180, 90)], "q_"), boxes(spark, [*city, *[(-180, -90, 180, 90)] * 20])
    assert pairs(O.join_boxes(q, r)) == plain(q, r)
    sides = [r.toDF("id", "lo", "lat1", "hi", "lat2")]
    tree = O.quadtree(sides)
    leaves = [n for n, c in zip(tree.held, tree.first) if c < 0]
    assert max(leaves) <= 50 and sum(leaves) == 3020 or max(leaves[1:]) <= 50
    entries = O._entries(sides[0], "id", tree)
    assert entries.where("id >= 3000").groupBy("id").count().agg(F.max("count")).first()[0] == 1  # the whole world is one node
    assert entries.where("id < 3000").count() < 4 * 3000
    assert entries.where("id < 3000 AND NOT inner").groupBy("node").count().agg(F.max("count")).first()[0] <= 200


def test_empty_sides(spark):
    q, r = boxes(spark, mixed(3, 4), "q_"), boxes(spark, mixed(4, 4))
    assert O.join_boxes(q.limit(0), r).collect() == [] == O.join_boxes(q, r.limit(0)).collect()
    t = intervals(spark, "2021-01-01", 30, 4, 5)
    assert O.join_time(t.limit(0).toDF("qid", "q_start", "q_end"), t).collect() == []


def ranges(values, most=3, gap=0.1):
    x = sorted(v for v in values if v is not None)
    gaps = sorted(((x[i] - x[i - 1], -i) for i in range(1, len(x)) if x[i] > x[i - 1] and x[i] - x[i - 1] >= gap * (x[-1] - x[0])), reverse=True)
    cuts = sorted(-i for _, i in gaps[: most - 1])
    parts = [x[a:b] for a, b in zip([0, *cuts], [*cuts, len(x)])]
    return [(k, p[0], p[-1], len(p)) for k, p in enumerate(parts) if p]


@pytest.mark.parametrize("most, gap", [(3, 0.1), (5, 0.02), (2, 0.5)])
def test_coverage_ranges(spark, most, gap):
    r = random.Random(5)
    columns = {"even": list(range(100)), "ties": [0, 10, 20, 30, 30, None], "one": [4, 4], "none": [None, None], "two": [1, 1, 2], "far": [-1e308, 1e308, 0]}
    for k in range(6):
        columns[f"c{k}"] = [r.choice([0, 50, 80, 400]) + round(r.gauss(0, 1 + 5 * k), 2) for _ in range(200)]
    cells = spark.createDataFrame([("d", i, n, None if v is None else repr(v)) for i, (n, vs) in enumerate(columns.items()) for v in [*vs, "text"]], "dataset string, pos int, name string, value string")
    got = {}
    for x in P.coverage_ranges(cells, most, gap).orderBy("range").collect():
        got.setdefault(x.name, []).append((x.range, x.gte, x.lte, x.n))
    assert got == {n: want for n, vs in columns.items() if (want := ranges(vs, most, gap))}


def test_quadtree_covers_each_place_once():
    r = np.random.default_rng(1)
    tree = O.Quadtree(r.uniform(-180, 180, 500), r.uniform(-90, 90, 500), 10)
    boxes = np.sort(r.uniform(-90, 90, (40, 2, 2)), axis=1).reshape(40, 4)
    rows, nodes = tree.cover(boxes)
    for i, (x0, y0, x1, y1) in enumerate(boxes):
        own = tree.edges[nodes[rows == i]]
        for px, py in zip(r.uniform(x0, x1, 20), r.uniform(y0, y1, 20)):
            assert ((own[:, 0] <= px) & (px < own[:, 2]) & (own[:, 1] <= py) & (py < own[:, 3])).sum() == 1
