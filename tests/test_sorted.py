"""Work that is sorted over ranges: byte-capped samples and prefix lookups."""

import random

from pyspark.sql import functions as F

from datascout.operators import catalog as C
from datascout.operators import profiling as P


def capped(lines, max_rows, max_bytes):
    out, upto, n = [], {}, {}
    for source, pos, line in sorted(lines, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        upto[source] = upto.get(source, 0) + len((line or "").encode()) + 1
        n[source] = n.get(source, 0) + 1
        if upto[source] <= max_bytes and n[source] <= max_rows:
            out.append((source, pos, n[source], upto[source]))
    return out


def test_samples_of_one_large_source_and_many_small_ones(spark):
    r = random.Random(2)
    lines = [(r.choice([1, 1, 1, 2, 3, None]), i, "é" * r.randrange(30)) for i in range(4000)]
    df = spark.createDataFrame(lines, "source long, pos long, line string").repartition(5)
    for max_rows, max_bytes in ((10**6, 1 << 40), (10**6, 20_000), (700, 1 << 40), (3, 5), (0, 9), (9, 0)):
        got = [(x.source, x.pos, x.row, x.upto) for x in P.sample_bytes(df, max_rows, max_bytes).collect()]
        assert sorted(got, key=str) == sorted(capped(lines, max_rows, max_bytes), key=str)
    assert P.sample_bytes(df.limit(0), 5, 5).collect() == []


def test_no_task_holds_a_source(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(50_000).selectExpr("7 AS source", "id AS pos", "'line' AS line")
        kept = P.sample_bytes(df, 10**6, 1 << 40)
        assert kept.agg(F.count("*"), F.max("upto"), F.max("row")).first()[:] == (50_000, 250_000, 50_000)
        parts = [x for x in kept.inputFiles() if "sizes" in x]
        assert len(parts) == 8  # the sizes lie in as many ranges, each summed on its own
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_prefix_lookup(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abé_") for _ in range(r.randrange(0, 6)))
    names, wants = [word() for _ in range(400)] + [None, "zz.json"], [word() for _ in range(200)] + [None, "zz", "zzz", ""]
    got = C.find_profiles(spark.createDataFrame([(x,) for x in wants], "want string").repartition(3), spark.createDataFrame([(x, 1) for x in names], "name string, want int"))
    order = lambda x: x.encode()
    want = {}
    for w in {x for x in wants if x is not None}:
        hits = sorted((n for n in names if n is not None and n.startswith(w)), key=order)
        if hits:
            want[w] = hits[0]
    assert {x.want: x.name for x in got.collect()} == want and got.count() == len(want)
    none = spark.createDataFrame([], "name string")
    assert C.find_profiles(spark.createDataFrame([("a",)], "want string"), none).collect() == []


def test_prefix_lookup_takes_a_step_a_name(spark):
    """One range of 60,000 names: the windows' frames only grow, so that no name is looked at again for each one before it."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        names = spark.range(60_000).selectExpr("concat(id * 2, '_x') AS name")
        wants = spark.createDataFrame([("119998",), ("119998_x",), ("119999",), ("0",), ("7777",), ("9",), ("a",)], "want string")
        got = C.find_profiles(wants, names)
        assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()
        assert {r.want: r.name for r in got.collect()} == {"119998": "119998_x", "119998_x": "119998_x", "0": "0_x", "7777": "77770_x", "9": "90000_x"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
