import hashlib
import random

from datascout.llm import substrings
from tests.llm.helpers import documents, words


def brute(rows, n=13):
    key = lambda i: (1, 0) if i is None else (0, i)
    first, out = {}, []
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - n + 1):
            k = tuple(w[p : p + n])
            first[k] = min(first.get(k, key(i)), key(i))
    for i, w in split:
        gone = set()
        for p in range(len(w) - n + 1):
            if first[tuple(w[p : p + n])] < key(i):
                gone |= set(range(p, p + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def cases():
    r, rows = random.Random(5), []
    shared = words(99, 60)
    for i in range(80):
        w = words(i // 3, 80) if i % 4 else words(1000 + i, r.randrange(0, 40))
        k = r.randrange(len(w) + 1)
        w[k:k] = shared[r.randrange(40) :][: r.randrange(5, 30)]
        if i % 7 == 0:
            w += w[:30]
        rows.append((r.randrange(200), "\n".join(w[:5]) + "  " + " ".join(w[5:])))
    rows += [(None, rows[3][1]), (300, None), (301, ""), (302, " \t "), (303, " ".join(words(7, 13))), (5, " ".join(words(7, 13)) + " É x"), (304, " ".join(words(7, 12)))]
    return rows + [rows[0], (305, " ".join(words(50, 9000, 40)))]


def test_against_brute_force(spark):
    rows = cases()
    docs = documents(spark, rows, extra=["g", "h"])
    for size in (300, 1 << 20):
        got = substrings.remove_repeats(docs, group_bytes=size).drop("text").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))
    assert sum(x[2] for x in brute(rows)) > 500


def test_only_nulls_and_empty_table(spark):
    assert substrings.remove_repeats(documents(spark, [])).collect() == []
    got = substrings.remove_repeats(documents(spark, [(None, None), (1, "a b")])).collect()
    assert sorted((x.n_words, x.n_removed) for x in got) == [(0, 0), (2, 0)]


def test_levels_and_other_windows(spark):
    assert [substrings.level_lengths(n) for n in (3, 4, 5, 13, 50)] == [[3], [4], [4, 5], [4, 8, 13], [4, 8, 16, 32, 50]]
    rows = cases()[:40]
    for n in (3, 20):
        got = substrings.remove_repeats(documents(spark, rows), window=n, group_bytes=500).drop("text").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, n)))


def test_repeated_ids_are_spread(spark):
    rows = [(7, " ".join(words(i, 60))) for i in range(50)]
    spread, groups = substrings.grouped(documents(spark, rows), 500)
    assert spread.select("g").distinct().count() > groups / 3
    assert {r.n_removed for r in substrings.remove_repeats(documents(spark, rows)).collect()} == {0}
