import hashlib
import math
import random

from datascout.llm import mixing
from tests.llm.helpers import documents, saved, words


def rows():
    r = random.Random(3)
    out = [(i, " ".join(words(i, r.randrange(60))), "en", r.choice(["a", "b", "b", "b", "Z", "é", "tiny"]) if i != 7 else "tiny") for i in range(150)]
    return out + [(200, None, "en", "a"), (201, "", "en", None), (202, "x y\x0bz", "en", None), (None, "no id here", "en", "b"), out[3], (203, None, "en", "empty")]


def key(i):
    return int(hashlib.md5(f"mix|{'null' if i is None else i}".encode()).hexdigest()[:13], 16)


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        above = {s for s in open_ if w[s] * level > 2 * sizes[s]}
        if not above:
            target |= {s: w[s] * level for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in above}
        left -= sum(2 * sizes[s] for s in above)
        open_ -= above
    return target


def test_against_brute_force(spark):
    all_rows = rows()
    got = mixing.op1_mix_sources(spark, saved(spark, documents=documents(spark, all_rows, extra=["size", "bucket", "target"]))).collect()
    size = lambda t: len((t or "").encode().split())
    sizes = {}
    for _, t, _, s in all_rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = brute_targets(sizes)
    assert len(got) == len(all_rows) and {g.source: g.source_size for g in got} == sizes
    for g in got:
        assert math.isclose(g.target, target[g.source], rel_tol=1e-12) and g.taken <= 2 * g.size
    for s in sizes:
        own = sorted((r for r in all_rows if r[3] == s), key=lambda r: (key(r[0]), size(r[1])))
        budget, want = math.floor(target[s]), []
        whole, left = divmod(budget, max(sizes[s], 1))
        for r in own:
            part = min(size(r[1]), left)
            left -= part
            want.append((str(r[0]), whole * size(r[1]) + part))
        assert sorted(want) == sorted((str(g.doc_id), g.taken) for g in got if g.source == s)
        assert sum(g.taken for g in got if g.source == s) == (budget if sizes[s] else 0)


def test_mixed_texts(spark):
    docs = documents(spark, rows(), extra=["row", "epoch"])
    taken = {}
    for g in mixing.take(mixing._narrow(docs, [], 4)).collect():
        taken[g.doc_id] = taken.get(g.doc_id, 0) + g.taken
    mixed = mixing.mix_documents(docs)
    assert mixed.schema == docs.schema
    out = mixed.collect()
    words_of = {}
    for r in out:
        words_of[r.doc_id] = words_of.get(r.doc_id, 0) + len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert words_of == {i: n for i, n in taken.items() if n}


def test_empty_tables(spark):
    assert mixing.op1_mix_sources(spark, saved(spark, documents=documents(spark, []))).collect() == []
    assert mixing.mix_documents(documents(spark, [])).collect() == []
    assert [g.taken for g in mixing.op1_mix_sources(spark, saved(spark, documents=documents(spark, [(1, None), (2, "")]))).collect()] == [0, 0]


def test_mix_is_the_same_in_any_order_of_rows(spark):
    rows = [(1, f"word{k} " * 5, "en", f"s{k % 2}") for k in range(20)] + [(2, "a b c", "en", "s0")]
    made = set()
    for k in (0, 7, 13):
        docs = documents(spark, rows[k:] + rows[:k], extra=["`x.y`", "row", "tie"]).repartition(3)
        got = mixing.mix_documents(docs)
        assert got.columns == docs.columns
        made.add(str(sorted(map(str, got.collect()))))
    assert len(made) == 1
