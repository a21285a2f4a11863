import random
from collections import Counter

import pytest

from datascout.operators import profile_states as N
from datascout.operators import profiling as P

KIND = "dataset string, pos int, name string, value string"


def cells(spark, rows):
    return spark.createDataFrame([("d", 0, n, v) for n, v in rows], KIND)


def made(seed, n):
    r = random.Random(seed)
    return [(c, r.choice(vs)()) for _ in range(n) for c, vs in {
        "skewed": [lambda: str(int(r.paretovariate(1)))], "big": [lambda: str(10**12 + r.randrange(1000))], "unique": [lambda: str(r.getrandbits(50))],
        "text": [lambda: r.choice("abc"), lambda: None], "none": [lambda: None], f"only{seed}": [lambda: "x"],
    }.items()]


def test_parts_merge_to_the_whole(spark):
    parts = [made(k, 700) for k in range(4)]
    states = [N.states(cells(spark, p)) for p in parts]
    whole = cells(spark, sum(parts, []))
    one, pairs = N.merged(*states), N.merged(N.merged(*states[:2]), N.merged(*states[2:]), N.states(cells(spark, [])))
    full = {r.name: r for r in N.profiles(N.states(whole)).collect()}
    exact = {r.name: r.num_distinct_values for r in P.distinct_counts(whole).collect()}
    for got in (one, pairs):
        got = {r.name: r for r in N.profiles(got).collect()}
        assert got.keys() == full.keys()
        for name, r in got.items():
            for field in ("n", "nulls", "min", "max"):
                assert r[field] == full[name][field]
            assert (r.mean, r.stddev) == (full[name].mean, full[name].stddev) or r.mean == pytest.approx(full[name].mean) and r.stddev == pytest.approx(full[name].stddev, rel=1e-6)
            assert abs(r.num_distinct_values - exact[name]) <= 0.03 * exact[name]
    stats = {r.name: r for r in P.numeric_stats(whole).collect()}
    assert all(full[n].mean == s["mean"] and full[n].stddev == pytest.approx(s["stddev"], rel=1e-6) for n, s in stats.items())


def test_bounds_of_frequent_values_hold_and_the_recount_is_exact(spark):
    parts = [made(k, 600) for k in range(3)]
    state = N.merged(*[N.states(cells(spark, p), kept=8) for p in parts], kept=8)
    exact = {}
    for n, v in sum(parts, []):
        if v is not None:
            exact.setdefault(n, Counter())[v] += 1
    listed = {}
    for r in N.frequent_values(state, 8).collect():
        assert r.least <= exact[r.name][r.bin] <= r.most
        listed.setdefault(r.name, set()).add(r.bin)
    bound = {r["name"]: r["bound"] for r in state.select("name", "bound").collect()}
    assert all(n <= bound[name] for name, c in exact.items() for v, n in c.items() if v not in listed[name])
    full = {}
    for r in P.categorical_histogram(cells(spark, sum(parts, []))).collect():
        full.setdefault(r["name"], {})[r["rank"]] = (r["bin"], r["count"])
    rows = N.recounted(state, cells(spark, sum(parts, []))).collect()
    sure = [r for r in rows if r.certain]
    assert {r.name for r in sure} >= {"skewed", "text", "only1"} and "unique" not in {r.name for r in sure}
    assert all(exact[r["name"]][r["bin"]] == r["count"] for r in rows) and all(full[r["name"]][r["rank"]] == (r["bin"], r["count"]) for r in sure)
