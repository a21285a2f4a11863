import hashlib
import itertools
import random

import numpy as np

from datascout.llm import fuzzy_lines as fl
from tests.llm.helpers import documents, saved, words


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abc é") for _ in range(r.randrange(90))) for _ in range(2))
        b = a[: r.randrange(len(a) + 1)] + b[:9] + a[r.randrange(len(a) + 1) :] if r.random() < 0.5 else b
        assert fl.edit_distance(a, b) == levenshtein(a, b)


def is_similar(a, b):
    return 5 * fl.edit_distance(a, b) <= max(len(a), len(b)) if 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) else False


def brute(rows):
    """Groups by edit similarity and a common block; also the number of links and of those without a common block."""
    order = lambda r: (r[0] is None, r[0] or 0)
    lines = {}
    for r in sorted(rows, key=order):
        for k, x in enumerate([] if r[1] is None else r[1].encode().split(b"\n")):
            n = fl.normalised(x)
            if n:
                lines.setdefault(n, (r[0], r[1], k))
    comp = {n: n for n in lines}
    pos = {n: i for i, n in enumerate(lines)}
    links = [(a, b) for a, b in itertools.combinations(lines, 2) if min(a.count(b" "), b.count(b" ")) >= 4 and fl.similar(a.decode(), b.decode())]
    blocks = dict(zip(lines, (set(np.frombuffer(x, dtype=np.uint64).tolist()) for x in fl.fingerprints(list(lines)))))
    found = [(a, b) for a, b in links if blocks[a] & blocks[b]]
    lost, links = len(links) - len(found), found
    for _ in range(len(links) + 1):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b], key=pos.get)
    out = []
    for r in rows:
        split = [] if r[1] is None else r[1].encode().split(b"\n")
        gone = {k for k, x in enumerate(split) if (n := fl.normalised(x)) in comp and lines[comp[n]] != (r[0], r[1], k)}
        out.append((r[0], len(split), len(gone), hashlib.sha256(b"\n".join(x for k, x in enumerate(split) if k not in gone)).hexdigest()))
    return out, len(links), lost


def test_against_brute_force(spark):
    r, rows = random.Random(6), []
    spelt = lambda w: [x.translate(str.maketrans("0123456789", "abcdefghij")) for x in w]  # noqa: E731  (digits are all alike)
    base = [spelt(words(i, 12 + i % 40)) for i in range(25)]
    for i in range(120):
        lines = []
        for _ in range(4):
            w = list(r.choice(base)) if r.random() < 0.6 else spelt(words(r.random(), r.randrange(9), 400))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                if w:
                    w[r.randrange(len(w))] = r.choice(["x7", "X8,", "changed"])
            lines.append(" ".join(w))
        rows.append((i * 3 % 121 if i % 10 else i + 1000, "\n".join(lines)))
    rows += [(2000, None), (2001, ""), (None, rows[5][1]), rows[7], (2002, "\n\n a b\n" + " ".join(spelt(words(1, 6000)))), (2003, "é alpha beta gamma Delta\nÉ Alpha beta gamma delta"), (2004, "é! a b 7 c d\n é a b 3 c d")]
    want, links, lost = brute(rows)
    got = fl.remove_repeats(documents(spark, rows, extra=["h", "fp", "line", "lines"])).collect()
    assert links > 300 and lost < 0.02 * links
    assert sorted(map(str, ((g.doc_id, g.n_lines, g.n_removed, g.kept_sha256) for g in got))) == sorted(map(str, want))


def test_similar_against_the_edit_distance():
    """An alignment never costs less than the edit distance, and seldom more by enough to matter."""
    r, both, exact = random.Random(2), 0, 0
    for _ in range(1500):
        a = " ".join("".join(r.choice("abcdefgé") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(5, 25)))
        w = a.split()
        for _ in range(r.randrange(5)):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([["abe"], ["bd", w[k]], [w[k] + "c"], ["g"]])
        b = " ".join(w)
        assert fl.similar(a, b) <= is_similar(a, b)
        both, exact = both + fl.similar(a, b), exact + is_similar(a, b)
    assert exact > 500 and both >= 0.98 * exact


def recall(kind, n, r):
    """Share of pairs of edit similarity of at least 0.8 that agree on a block."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(r.choice(letters) for _ in range(r.choice([2, 2, 3, 3, 4, 5, 6, 7, 8, 9, 11])))
    pairs = []
    while len(pairs) < n:
        a = [word() for _ in range(r.randrange(5, 40))]
        b = list(a)
        for k in r.sample(range(len(a)), {"one": 1, "fifth": max(1, len(a) // 5)}[kind]):
            b[k] = r.choice([word(), word(), "", b[k][:-1] + "q", f"{b[k]} {word()}"])
        a, b = " ".join(a), " ".join(" ".join(b).split())
        if a != b and b.count(" ") > 3 and is_similar(a, b):
            pairs.append((a.encode(), b.encode()))
    blocks = [[set(np.frombuffer(x, dtype=np.uint64).tolist()) for x in fl.fingerprints(list(side))] for side in zip(*pairs)]
    return sum(bool(x & y) and fl.similar(a.decode(), b.decode()) for x, y, (a, b) in zip(*blocks, pairs)) / n


def test_recall_against_edit_similarity_alone():
    r = random.Random(4)
    assert recall("one", 2000, r) >= 0.98
    assert recall("fifth", 2000, r) >= 0.92
    assert fl.fingerprints([]) == []


def test_empty_table(spark):
    assert fl.op10_fuzzy_line_dedup(spark, saved(spark, documents=documents(spark, []))).collect() == []


def test_query_against_edit_similarity_alone(spark):
    """Lines of 5 to 45 words with words replaced, dropped or added, and repeats of short lines: nearly all of these pairs are found (digits are all alike, hence letters)."""
    r, rows = random.Random(3), []
    for i in range(60):
        base = [w.translate(str.maketrans("0123456789", "abcdefghij")) for w in words(i, 5 + i % 40)]
        other = list(base)
        for _ in range(1 + len(base) // 9):
            k = r.randrange(len(other))
            other[k : k + 1] = r.choice([["wxy"], ["wz", other[k]], [other[k] + "s"]])
        rows += [(i, " ".join(base) + "\nok\n"), (100 + i, " ".join(other) + f"\nonly here {chr(97 + i % 26)}{chr(97 + i // 26)}\nOK!\n")]
    lines = sorted({(fl.normalised(x), d) for d, t in rows for x in t.encode().split(b"\n")}, key=lambda x: x[1])
    pairs = [(a, b) for (a, d), (b, e) in itertools.combinations(lines, 2) if a != b and a.count(b" ") > 3 < b.count(b" ") and fl.similar(a.decode(), b.decode())]
    assert len(pairs) > 40
    got = {x.doc_id: x.n_removed for x in fl.op10_fuzzy_line_dedup(spark, saved(spark, documents=documents(spark, rows))).collect()}
    later = {b for _, b in pairs}
    want = {d: sum(x in later for x in map(fl.normalised, t.encode().split(b"\n"))) + (d != 0) for d, t in rows}
    assert all(got[d] <= n for d, n in want.items()) and sum(want[d] - got[d] for d in want) <= 0.05 * len(pairs)


def test_edit_distance_stops_above_room():
    r = random.Random(5)
    for _ in range(400):
        a = "".join(r.choice("abc d") for _ in range(r.randrange(40)))
        b = "".join(r.choice("abc d") for _ in range(r.randrange(40))) if r.random() < 0.5 else a[: r.randrange(40)] + a[r.randrange(40) :]
        d, room = fl.edit_distance(a, b), r.randrange(12) + 0.5
        got = fl.edit_distance(a, b, room)
        assert got == d if d <= room else got > room

    class Counted(str):
        seen = 0

        def __getitem__(self, k):
            return Counted(str.__getitem__(self, k))

        def __iter__(self):
            for c in str.__iter__(self):
                Counted.seen += 1
                yield c

    assert fl.edit_distance("x" * 500, Counted("y" * 500), 20) > 20 and Counted.seen < 40


def test_distances_of_many_lines_at_once():
    r = random.Random(7)
    for _ in range(150):
        a, *others = ("".join(r.choice("abc é\n") for _ in range(r.choice([0, 5, 40, 130]))) for _ in range(r.randrange(2, 20)))
        others.append(a[: len(a) // 2] + "b" + a[len(a) // 2 + 1 :])
        assert fl.edit_distances(a, others).tolist() == [levenshtein(a, b) for b in others]


def passages(r, n):
    """Lines that share a passage at different places, some of them alike; and where words are put in before it and taken off after it."""
    shared = [f"p{i}" for i in range(60)]
    lines = [" ".join(["a" * r.randrange(1, 4), *words(r.random(), r.randrange(25)), *shared, *words(r.random(), r.randrange(25)), "z" * r.randrange(1, 4)]) for _ in range(n)]
    for x in lines[::4]:
        w = x.split()
        w[3:5] = ["other"]
        lines.append(" ".join(w))
    return lines


def test_filters_of_large_groups_keep_all_similar_lines(monkeypatch):
    """Lines that share a passage only are told apart many at once: hardly any pair is aligned word by word (before, all were)."""
    r = random.Random(8)
    lines = passages(r, 120)
    want = {(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if fl.similar(lines[i], lines[j])}
    calls, aligned = [], fl.aligned
    monkeypatch.setattr(fl, "aligned", lambda *x: calls.append(x) or aligned(*x))
    near = fl.near_lines(lines)
    got = {(i, j) for i in range(len(lines) - 1) for js in [np.arange(i + 1, len(lines))] for j in js[near(i, js)].tolist()}
    assert got == want and 30 <= len(want) < 0.5 * len(lines) ** 2 / 2
    assert len(calls) < 1.5 * len(want) + 8 * len(lines)


def test_words_elsewhere_never_part_similar_lines():
    r, parted = random.Random(9), 0
    for _ in range(6):
        lines = passages(r, 40)
        lines += [x[r.randrange(3) :] + "z" * r.randrange(3) for x in lines[:20]] + ["p1 p2 " * 9 + x for x in lines[:5]]
        elsewhere = fl._elsewhere(lines)
        for i in range(len(lines) - 1):
            js = np.arange(i + 1, len(lines))
            size = np.array([max(len(lines[i]), len(lines[j])) for j in js])
            apart = js[elsewhere(i, js, np.floor(0.2 * size + 1e-9).astype(np.int64))]
            parted += len(apart)
            assert not any(fl.similar(lines[i], lines[j]) for j in apart)
    assert parted > 500


def test_lines_of_many_texts():
    r = random.Random(10)
    for _ in range(500):
        texts = [bytes(r.choice(b"aB\n\n  \t\r,7\xc3\xa9\x00\x0b") for _ in range(r.randrange(30))) for _ in range(r.randrange(5))]
        want = [(i, k, n) for i, t in enumerate(texts) for k, x in enumerate(t.split(b"\n")) if (n := fl.normalised(x))]
        assert [(int(i), int(k), x) for i, k, x in zip(*fl.split_lines(texts))] == want
