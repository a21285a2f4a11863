import math
import re
from collections import Counter

import numpy as np

from datascout.llm import quality_rules as qr
from datascout.llm.language_model import discounts
from tests.llm.helpers import documents, saved, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(t):
    t = t or ""
    w = WORD.findall(t)
    win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {i + j for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)


def brute_model(c):
    orders = {5: c}
    for k in (4, 3, 2, 1):
        orders[k] = Counter(g[1:] for g in orders[k + 1])
    d = {k: discounts([sum(x == n for x in o.values()) for n in (1, 2, 3, 4)]) for k, o in orders.items()}
    follow = {k: {} for k in orders}
    for k, o in orders.items():
        for g, n in o.items():
            follow[k].setdefault(g[:-1], []).append(n)

    def p(g):
        if not g:
            return 1 / 256
        n, k = orders[len(g)][g], len(g)
        f = follow[k][g[:-1]]
        return max(n - d[k][min(n, 3) - 1], 0) / sum(f) + sum(d[k][min(x, 3) - 1] for x in f) / sum(f) * p(g[1:])

    return p


def brute_perplexity(rows):
    tables = {}
    for _, t, lang, _ in rows:
        for w in WORD.findall(t or ""):
            b = b"    " + w.encode() + b" "
            for i in range(4, len(b)):
                tables.setdefault(lang or "", Counter())[b[i - 4 : i + 1]] += 1
    models = {lang: brute_model(c) for lang, c in tables.items()}
    out = []
    for _, t, lang, _ in rows:
        x = [math.log10(models[lang or ""](b[i - 4 : i + 1])) for w in WORD.findall(t or "") for b in [b"    " + w.encode() + b" "] for i in range(4, len(b))]
        out.append(-sum(x) / len(x) if x else 0.0)
    return out


def test_against_brute_force(spark):
    rows = [(i, " ".join(words(i % 25, 30 + i, 60)), "ab"[i % 2], "s") for i in range(60)]
    rows += [(90, "one # two\n\n|a b\none # two\n \n|a b é<>", None, "s"), (91, None, "a", "s"), (92, "", "b", "s"), (93, "x " * 400, "a", "s"), (94, "\x0bÉté\x0c ñ ü z", "", "s"), (5, rows[5][1], "b", "s"), (None, "##$$%%&& " * 3 + " ".join(f"Q{i}#Z" for i in range(40)), "a", "s")]
    path = saved(spark, documents=documents(spark, rows, extra=["kept", "n_words"]))
    got = qr.op7_quality_rules(spark, path).collect()
    want = {}
    for r, x in zip(rows, brute_perplexity(rows)):
        b = brute_base(r[1])
        want.setdefault((r[0], *b, b[0] < 10 or 100 * b[4] > 20 * b[0]), []).append(x)
    assert len(got) == len(rows)
    for g in got:
        assert min(abs(g.log_perplexity - x) for x in want[tuple(g)[:7]]) < 1e-9
        assert not (g.kept and g.base_failed)
    assert any(not g.kept and not g.base_failed for g in got) and sum(g.kept for g in got) > 40


def test_base_counts_do_not_cross_texts():
    got = qr.base_counts([b"a b c d e", b"a b c d e f", b"", b"a b c d e a b c d e"])
    assert got["n_repeat_words"].tolist() == [0, 0, 0, 10] and got["n_words"].tolist() == [5, 6, 0, 10]
    assert np.array_equal(got["n_dup_lines"], [0, 0, 0, 0])


def test_empty_table(spark):
    assert qr.op7_quality_rules(spark, saved(spark, documents=documents(spark, []))).collect() == []
