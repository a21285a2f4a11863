import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from datascout.llm import ranked_search
from tests.llm.helpers import documents, saved, words

ITEMS = "item_id long, text string, doc_id long, score string"


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(rows, items):
    docs = [(i, Counter(split(t)), len(split(t))) for i, t, *_ in rows]
    n_docs, n_terms = sum(n > 0 for _, _, n in docs), sum(n for _, _, n in docs)
    texts = {}
    for i, t in items:
        texts.setdefault(i, []).extend(split(t))
    out = []
    for item, terms in texts.items():
        scored = []
        for doc_id, tf, n in docs:
            score = 0
            for t in terms:
                if tf[t]:
                    df = sum(t in d for _, d, _ in docs)
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * (25 + 75 * n * n_docs // n_terms)))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item, k + 1, None if no else i, -s) for k, (s, no, i) in enumerate(sorted(scored)[:10])]
    return sorted(out, key=str)


def cases():
    r = random.Random(4)
    rows = [(i, " ".join(words(i, r.choice([3, 20, 60, 300]), 80))) for i in range(120)]
    rows += [(200 + i, "Alpha, beta: ALPHA gamma") for i in range(14)] + [(250, "alpha " * 400), (251, "Ünder ünder straße 東京 a_b a-b 3,5")]
    rows += [(300, None), (301, ""), (302, " .,;"), (None, "alpha beta gamma delta"), (5, "zeta zeta eta"), (5, "zeta theta"), (400, " ".join(words(77, 30_000, 9000)))]
    items = [(1, "alpha gamma?"), (2, " ".join(words(3, 40, 80))), (3, "ÜNDER under 東京"), (4, None), (5, "!!"), (6, "nowhere to be found xyzzy"), (7, "zeta"), (8, "w1 w1 w2"), (8, "w2 w3"), (None, "alpha w1"), (9, " ".join(words(77, 200, 9000)))]
    return rows, items


def result(df):
    return sorted(((x.item_id, x["rank"], x.doc_id, x.score) for x in df.collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # several blocks of documents and of queries, crowded signatures, terms by a shuffle
        for name, value in (("BLOCK", 8), ("QUERY_TERMS", 10), ("BITS", 1), ("MOST_BITS", 64), ("BROADCAST_TERMS", 3), ("SEEDS", 10)):
            monkeypatch.setattr(ranked_search, name, value)
    rows, items = cases()
    path = saved(spark, documents=documents(spark, rows, extra=["items", "score"]), benchmark=spark.createDataFrame([(*x, 1, "s") for x in items], ITEMS))
    df = ranked_search.op11_ranked_search(spark, path)
    assert result(df) == brute(rows, items)
    assert df.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_bounds_are_never_below_the_score(spark):
    rows, items = cases()
    docs = documents(spark, rows)
    index = ranked_search.build_index(docs)
    terms = [split(t) for _, t, *_ in rows]
    n_docs, n_terms = sum(map(bool, terms)), sum(map(len, terms))
    held = index.collect()
    assert sum(len(b.doc_ids) for b in held) == n_docs and sum(sum(b.lengths) for b in held) == n_terms
    own = ranked_search.item_terms(spark.createDataFrame([(*x, 1, "s") for x in items], ITEMS))
    own = own.join(ranked_search.document_frequencies(docs, own.select("term")), "term", "left").collect()
    q = ranked_search.Queries(own, n_docs, n_terms)
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(split(t))
    close = []
    for b in held:
        for item, bound in q.bounds(np.array(b.lengths), b.bits, bytes(b.slices)):
            for d, doc_id in enumerate(b.doc_ids):
                exact = max(q.score(item, Counter(x.encode() for x in t), len(t)) for t in by_id[doc_id] if len(t) == b.lengths[d])
                assert bound[d] >= exact
                close.append(exact / bound[d] if bound[d] else 1)
    assert sum(close) / len(close) > 0.7  # the bounds are of use


def test_empty_tables(spark):
    none, items = documents(spark, []), spark.createDataFrame([(1, "a", 1, "s")], ITEMS)
    assert ranked_search.search(none, items).collect() == []
    assert ranked_search.search(documents(spark, [(1, None), (2, " ")]), items).collect() == []
    assert ranked_search.search(documents(spark, [(1, "a b")]), items.limit(0)).collect() == []
