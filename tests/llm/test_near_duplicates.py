import itertools
import random

from datascout.llm import near_duplicates as nd
from tests.llm.helpers import documents, words


def brute(rows):
    key = lambda t: tuple((t or "").encode().lower().split())
    first = {}
    for i, t in rows:
        k = key(t)
        order = (i is None, i or 0)
        first[k] = min(first.get(k, order), order)
    ks = list(first)
    sets = {k: {k[i : i + 5] for i in range(max(1, len(k) - 4))} if k else set() for k in ks}
    comp = {k: k for k in ks}
    links = [(a, b) for a, b in itertools.combinations(ks, 2) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in range(len(ks)):
        was = dict(comp)
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b], key=first.get)
        if was == comp:
            break
    return {(None if first[k][0] else first[k][1], k) for k in ks if comp[k] == k}, len(links)


def test_against_brute_force(spark):
    r, rows = random.Random(9), []
    for i in range(140):
        w = words(i // 7, 150)
        for _ in range(i % 7 // 2):
            w[r.randrange(150)] = "edited"
        rows.append((i * 11 % 139, " ".join(w) if i % 3 else "\n".join(w).upper()))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "One  two"), (None, rows[3][1]), (None, "only here"), rows[8], (505, "a b c d e f g")]
    docs = documents(spark, rows, extra=["h", "fp", "of"])
    kept = nd.keep_one(docs)
    want, links = brute(rows)
    got = [(x.doc_id, tuple((x.text or "").encode().lower().split())) for x in kept.collect()]
    assert links > 50 and kept.columns == docs.columns
    assert len(got) == len(set(got)) and set(got) == want


def test_empty_table(spark):
    assert nd.keep_one(documents(spark, [])).collect() == []


def test_two_or_three_common_blocks_find_the_same(spark, monkeypatch):
    rows = [(i, " ".join(words(i // 5, 120)[: 119 - i % 5])) for i in range(60)]
    docs = documents(spark, rows)
    want = {r.doc_id for r in nd.keep_one(docs).collect()}
    monkeypatch.setattr(nd, "blocks_in_common", lambda rows, radius: 3)
    assert {r.doc_id for r in nd.keep_one(docs).collect()} == want == {i for i, _ in brute(rows)[0]}
    from datascout.llm.simhash import blocks_in_common

    assert [blocks_in_common(n, 6) for n in (1000, 10**9)] == [2, 3]


def test_hot_groups_in_blocks_find_the_same(spark, monkeypatch):
    """A family of versions of one text, a chain whose ends are unlike, and strangers, with blocks so small that all groups are split."""
    from datascout.llm import groups

    r, rows = random.Random(3), []
    base = words(1, 120)
    for i in range(60):
        w = list(base)
        w[r.randrange(120)] = f"new{i}"
        rows.append((i, " ".join(w)))
    chain = words(2, 120)
    for i in range(25):
        rows.append((100 + i, " ".join(chain[2 * i :] + words(3, 2 * i))))
    rows += [(200 + i, " ".join(words(50 + i, 80))) for i in range(15)]
    want, links = brute(rows)
    docs = documents(spark, rows)
    for size in (6, 1 << 10):
        monkeypatch.setattr(groups, "BLOCK", size)
        got = {(x.doc_id, tuple(x.text.encode().lower().split())) for x in nd.keep_one(docs).collect()}
        assert got == want
