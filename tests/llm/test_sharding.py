import zlib
from collections import Counter

from datascout.llm import sharding
from tests.llm.helpers import documents, saved


def test_slots_sizes_and_growth(spark):
    rows = [(i, f"text {i} é") for i in range(3000)] + [(5, "again"), (5, "again"), (None, "x"), (None, None), (-1, "")]
    got = sharding.op6_hash_tree_shards(spark, saved(spark, documents=documents(spark, rows, extra=["shard", "slot", "h"]))).collect()
    assert len(got) == len(rows)
    assert sorted((g.size, g.text_crc32) for g in got) == sorted((16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for _, t in rows)
    for s in range(40):
        slots = sorted(g.slot for g in got if g.shard == s)
        assert slots == list(range(len(slots))) and slots
    assert all(g.grown_shard in (g.shard, 40) for g in got) and 30 < sum(g.grown_shard == 40 for g in got) < 130
    assert len({g.shard for g in got if g.doc_id == 5}) == 1 and len({g.shard for g in got if g.doc_id is None}) == 1
    assert {g.law for g in got} == {"key"} and max(Counter(g.shard for g in got).values()) < 130


def test_weights_move_only_into_what_gained(spark):
    keys = documents(spark, [(i, "") for i in range(4000)])
    plain = {r.doc_id: r.shard for r in sharding.place(keys).collect()}
    heavy = {r.doc_id: r.shard for r in sharding.place(keys, weights={7: 3.0}).collect()}
    region = {s for s in range(10)}
    assert all(heavy[i] in region for i in plain if heavy[i] != plain[i])
    assert sum(s == 7 for s in heavy.values()) > 2 * sum(s == 7 for s in plain.values())
    out = {r.doc_id: r.shard for r in sharding.place(keys, weights={3: 0.0}).collect()}
    assert 3 not in out.values() and any(plain[i] == 3 for i in out)


def test_trees():
    def leaves(n):
        return [n.shard] if n.shard is not None else [s for c in n.children for s in leaves(c)]

    for n in (1, 7, 40, 41, 55):
        assert leaves(sharding.hash_tree(n)) == list(range(n)) and sharding.hash_tree(n).weight == n


def test_empty_table(spark):
    assert sharding.op6_hash_tree_shards(spark, saved(spark, documents=documents(spark, []))).collect() == []
