import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from datascout.llm import prefix_trie
from tests.llm.helpers import saved

SCHEMA = "conv_id long, turn long, role string, text string, path string, depth long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)


def brute(rows):
    """The trie by prefixes as tuples."""
    md5 = lambda b: hashlib.md5(b).hexdigest().encode()
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, md5(md5(role.encode()) + text.encode()), role, text))
    convs = {c: [x[3:] for x in sorted(t)] for c, t in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        lender = c - (abs(c) % 5) * (1 if c > 0 else -1)
        whole[c] = tuple(convs.get(lender, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saves = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saves[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saves[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def cases():
    r, rows = random.Random(11), []
    for c in [*range(-12, 130), 10**12]:
        for turn in range(r.choice([0, 1, 2, 5, 12])):
            rows.append((c, turn, r.choice(["user", "assistant"]) if turn > 2 else "user", r.choice(["Hi", "é", "long " * 9]) if turn > 1 else "Hello"))
    rows += [(200, None, "user", "late"), (200, 3, None, None), (200, None, None, "é"), (200, 3, None, None), (201, 1, "", ""), (None, 1, "user", "no one"), (205, 0, "a", "b\nc"), (206, 0, "ab", "\nc")]
    rows += [(300 + i % 3, i, "user", f"t{i // 3}") for i in range(900)]
    r.shuffle(rows)
    return rows


def got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(x[n] for n in names) for x in df.collect()), key=str)


@pytest.mark.parametrize("sizes", [(4096, 200_000, 256), (7, 30, 3)])
def test_against_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(prefix_trie, "SHARD", sizes[0])
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", sizes[1])
    monkeypatch.setattr(prefix_trie, "ENDS", sizes[2])
    rows = cases()
    df = prefix_trie.op13_conversation_trie(spark, saved(spark, conversations=table(spark, rows)))
    assert got(df) == brute(rows)
    assert {t for _, t in df.dtypes} == {"bigint", "string"}


def test_equal_conversations_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD", 16)
    rows = [(c, t, "user", "same") for c in range(0, 500) for t in range(3)]
    df = prefix_trie.op13_conversation_trie(spark, saved(spark, conversations=table(spark, rows)))
    assert got(df) == brute(rows)
    assert prefix_trie.op13_conversation_trie(spark, saved(spark, conversations=table(spark, []))).collect() == []


def test_shards_hold_whole_conversations(spark):
    import pyarrow as pa

    ids = [1] * 5 + [2] * 40 + [3, 4, 5, 5, 5]
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 4], pa.int64())], names=["conv_id"]) for i in range(0, len(ids), 4)]
    old = prefix_trie.SHARD, prefix_trie.SHARD_TURNS
    prefix_trie.SHARD, prefix_trie.SHARD_TURNS = 2, 8
    try:
        shards = [t["conv_id"].to_pylist() for t in prefix_trie._cut(iter(batches))]
    finally:
        prefix_trie.SHARD, prefix_trie.SHARD_TURNS = old
    assert sum(shards, []) == ids and all(len(set(s)) <= 2 for s in shards)
    assert len({c for s in shards for c in set(s)}) == sum(len(set(s)) for s in shards)
