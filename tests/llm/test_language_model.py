import math
import random
import zlib
from collections import Counter

import numpy as np

from datascout.llm import language_model as lm
from tests.llm.helpers import documents, saved


def toks(t):
    return [w for w in (t or "").encode().lower().split()] + ["</s>"]


def brute(rows):
    train = [toks(t) for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 10]
    uni, big = Counter(), Counter()
    for t in train:
        uni.update(t)
        big.update(zip(["<s>", *t], t))
    ctx, follow, ends = Counter(), {}, Counter()
    for (u, w), c in big.items():
        ctx[u] += c
        follow.setdefault(u, []).append(c)
        ends[w] += 1
    disc = lambda cs: lm.discounts([sum(c == k for c in cs) for k in (1, 2, 3, 4)])
    d2, d1 = disc(big.values()), disc(ends.values())
    D = lambda c, d: d[min(c, 3) - 1] if c else 0
    n, v, pairs = sum(uni.values()), len(uni), len(big)
    g1 = sum(D(a, d1) for a in ends.values()) / pairs
    p1 = lambda w: max(ends[w] - D(ends[w], d1), 0) / pairs + g1 / (v + 1)

    def p2(u, w):
        if not ctx[u]:
            return p1(w)
        c = big[u, w]
        return max(c - D(c, d2), 0) / ctx[u] + sum(D(x, d2) for x in follow[u]) / ctx[u] * p1(w)

    out = []
    for i, t in rows:
        w = toks(t)
        out.append((i, len(w), sum(uni[x] > 0 for x in w), n, math.fsum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), math.fsum(math.log10(p2(a, b)) for a, b in zip(["<s>", *w], w))))
    total = sum(p2("<s>", w) for w in uni) + p2("<s>", "never")
    return out, total


def test_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, " ".join(f"W{min(r.randrange(1, 400), r.randrange(1, 400))}" for _ in range(r.randrange(60)))) for i in range(150)]
    rows += [(None, "w1 w2"), (151, None), (152, ""), (153, " \t"), (154, "É w1 é"), (7, rows[7][1]), (155, "w3 " * 3000)]
    got = lm.op4_kneser_ney_scores(spark, saved(spark, documents=documents(spark, rows, extra=["score"]))).collect()
    want, total = brute(rows)
    assert abs(total - 1) < 1e-9
    key = lambda x: str((x[0], x[1], round(x[5], 6)))
    got = sorted(((x.doc_id, x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score) for x in got), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and np.allclose(g[4:], w[4:], rtol=1e-9)


def test_pair_keys_are_a_bijection():
    a, b = np.array([0, 1, 5, 2**32 - 1]), np.array([7, 0, 2**32 - 1, 3])
    x, y = lm.pair_of(lm.pair_key(a, b))
    assert (x == a).all() and (y == b).all()


def test_no_rows_and_no_training_rows(spark):
    assert lm.op4_kneser_ney_scores(spark, saved(spark, documents=documents(spark, []))).collect() == []
    got = lm.op4_kneser_ney_scores(spark, saved(spark, documents=documents(spark, [(None, "a b")]))).collect()
    assert [(x.n_tokens, x.n_known, x.train_tokens, x.score) for x in got] == [(3, 0, 0, 0.0)]
