import itertools
import random

import numpy as np
import xxhash

from datascout.llm import simhash
from tests.llm.helpers import documents, saved, words


def brute_fingerprint(text):
    w = [x for x in (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()]
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(fps, radius):
    comp = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(fps, 2):
            if (fps[a] ^ fps[b]).bit_count() <= radius and comp[a] != comp[b]:
                comp[a] = comp[b] = min(comp[a], comp[b])
                changed = True
    return comp


def test_op5_against_brute_force(spark):
    rows, r = [], random.Random(1)
    for i in range(60):
        w = words(i // 6, 120)
        for _ in range(i % 6 // 2):
            w[r.randrange(120)] = "Changed"
        rows.append((i * 7 % 61, " ".join(w)))
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "One"), (104, "one two"), (105, "É Ünder x"), (0, rows[0][1])]
    path = saved(spark, documents=documents(spark, rows, extra=["fp", "component_id"]))
    got = {(x.doc_id, x.fingerprint, x.component_id) for x in simhash.op5_simhash_components(spark, path).collect()}
    fps = {}
    for i, t in rows:
        fps.setdefault(i, brute_fingerprint(t))
    comp = brute_components(fps, 2)
    assert got == {(i, f"{fps[i]:016x}", comp[i]) for i in fps}
    assert comp[101] == 100 and len(set(comp.values())) < len(comp)


def test_forest_finds_all_pairs_and_groups():
    r = random.Random(3)
    values = list({0, 3, 5} | {r.getrandbits(64) for _ in range(50)} | {(1 << r.randrange(12)) | (1 << r.randrange(12)) for _ in range(60)})
    shards = np.sort(np.array([r.randrange(3) for _ in values]))
    v = np.array(values, dtype=np.uint64)
    forest = simhash.BKForest(shards, v)
    a, b = forest.within(np.arange(len(v)), 2)
    want = {(i, j) for i in range(len(v)) for j in range(len(v)) if shards[i] == shards[j] and (values[i] ^ values[j]).bit_count() <= 2}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)
    ids = np.array(r.sample(range(1000), len(v)))
    least = simhash.link_groups(forest, ids, 2, block=7)
    comp = {i: i for i in range(len(v))}
    for _ in range(len(v)):
        for i, j in want:
            comp[i] = comp[j] = min(comp[i], comp[j], key=lambda k: ids[k])
    assert [int(x) for x in least] == [int(ids[comp[i]]) for i in range(len(v))]


def test_chain_of_fingerprints_and_empty_table(spark):
    chain = [(i, (1 << i) - 1) for i in range(0, 60, 2)] + [(500, (1 << 63) - (1 << 40)), (None, 3)]
    fps = spark.createDataFrame([(i, f if f < 1 << 63 else f - (1 << 64)) for i, f in chain], "doc_id long, fp long")
    got = {x.fp: x.component for x in simhash.fingerprint_components(fps).collect()}
    assert {got[(1 << i) - 1] for i in range(0, 60, 2)} == {0} and got[(1 << 63) - (1 << 40)] == 500
    path = saved(spark, documents=documents(spark, []))
    assert simhash.op5_simhash_components(spark, path).collect() == []
