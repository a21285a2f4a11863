import math
import random

import numpy as np

from datascout.llm import importance as im
from tests.llm.helpers import documents, saved, words


def corpus(n=400):
    r, rows, labels = random.Random(4), [], []
    for i in range(n):
        w, bad = words(i, r.randrange(20, 200), 300), i % 5 == 0
        if bad:
            for _ in range(1 + len(w) // 20):
                w.insert(r.randrange(len(w)), r.choice(["Nasty,", "nasty", "vileness", "vilest"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_special_rows(spark):
    rows, labels = corpus()
    special = [(1000, None), (1001, ""), (None, rows[1][1]), (3, rows[3][1]), (1002, " ".join(words(1, 9000, 300)))]
    lab = spark.createDataFrame([x for x in labels if x[0] % 2 or x[0] % 3 == 0] + [(5, None, None), (None, 1, 0), (7777, 1, 0)], "doc_id long, quality int, toxic int")
    path = saved(spark, documents=documents(spark, rows + special, extra=["key", "id", "good"]), labels=lab)
    got = im.op3_importance_resampling(spark, path).collect()
    assert len(got) == len(rows) + len(special)
    held = [g for g in got if g.doc_id is not None and g.doc_id < 400 and not (g.doc_id % 2 or g.doc_id % 3 == 0)]
    assert sum(g.kept != (g.doc_id % 5 == 0) for g in held) > 0.95 * len(held)
    assert {g.log_weight for g in got if g.doc_id in (1000, 1001)} == {0.0} and all(g.kept for g in got if g.doc_id in (1000, 1001, 1002))
    again = {(g.doc_id, g.kept) for g in im.op3_importance_resampling(spark, path).collect()}
    assert again == {(g.doc_id, g.kept) for g in got}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = im.resample(docs, spark.read.parquet(f"{path}/labels.parquet"))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(g.doc_id) for g in got if g.kept)


def test_weights_against_brute_force(spark):
    rows, labels = corpus(120)
    good = {i for i, q, t in labels if not t}
    df = documents(spark, rows).selectExpr("text", f"doc_id IN ({','.join(map(str, good))}) AS target")
    raw, target = im._counted(df)
    want_raw, want_target = np.zeros(im.FEATURES), np.zeros(im.FEATURES)
    for i, t in rows:
        f, _ = im.features([t.encode()])
        np.add.at(want_raw, f, 1)
        if i in good:
            np.add.at(want_target, f, 1)
    assert (raw == want_raw).all() and (target == want_target).all()
    ratios = im.log_ratios(raw, target)
    n = slice(0, 1 << im.BITS)
    due = raw[n] * target[n].sum() / raw[n].sum()
    i = int(np.argmax(due - target[n]))
    shift = ratios[n][raw[n] == 0][0]
    assert math.isclose(ratios[i] - shift, math.log((target[i] + 2) / (due[i] + 2)), rel_tol=1e-4)


def test_kth_largest_and_empty_tables(spark):
    keys = [5, -3, 5, 1 << 40, -(1 << 46), 0, 7, (1 << 33) + 1, 1 << 33]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    assert [im.kth_largest(df, "key", k) for k in range(1, 10)] == sorted(keys, reverse=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert im.op3_importance_resampling(spark, saved(spark, documents=documents(spark, []), labels=none)).collect() == []
    assert [r.kept for r in im.op3_importance_resampling(spark, saved(spark, documents=documents(spark, [(1, "a b")]), labels=none)).collect()] == [True]


def brute(rows, labels):
    """Kept ids in plain Python: counts, smoothed ratios, the level, and Gumbel top-k."""
    import hashlib
    from collections import Counter

    good = {i: q == 1 and not t for i, q, t in labels}
    raw, target, own = Counter(), Counter(), {}
    for i, t in rows:
        own[i] = Counter(im.features([(t or "").encode()])[0].tolist())
        raw.update(own[i])
        if good.get(i):
            target.update(own[i])
    kinds = [lambda f: f < 1 << im.BITS, lambda f: f >= 1 << im.BITS]
    ratio = {}
    for kind in kinds:
        r, t = sum(c for f, c in raw.items() if kind(f)), sum(c for f, c in target.items() if kind(f))
        mine = {}
        for f in raw:
            if kind(f):
                due = raw[f] * t / r
                x = math.log((target[f] + im.SMOOTH) / (due + im.SMOOTH))
                mine[f] = x if abs(due - target[f]) > im.CHANCE * math.sqrt(due + im.SMOOTH) and abs(x) > math.log(im.FACTOR) else 0.0
        mean = sum(target[f] * x for f, x in mine.items()) / t
        ratio |= {f: x - mean for f, x in mine.items()}
    weight = {i: sum(c * ratio[f] for f, c in own[i].items()) for i, _ in rows}
    levels = sorted({round(weight[i], 1) for i in good if i in weight})
    n = {g: sum(good[i] == g for i in good if i in weight) for g in (True, False)}
    gain = lambda x: sum((round(weight[i], 1) <= x) * (-1 if good[i] else 1) / n[good[i]] for i in good if i in weight)
    best, level = 0.0, -math.inf
    for x in levels:
        if gain(x) > best + 1e-12:
            best, level = gain(x), x + 0.05
    k = sum(w >= level for w in weight.values())
    uniform = lambda i: (int(hashlib.md5(f"gumbel|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52
    key = {i: w - math.log(-math.log(uniform(i))) for i, w in weight.items()}
    return weight, set(sorted(key, key=key.get)[len(key) - k :])


def test_kept_rows_against_brute_force(spark):
    rows, labels = corpus(300)
    labels = [x for x in labels if x[0] % 2 or x[0] % 3 == 0]
    path = saved(spark, documents=documents(spark, rows), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = im.op3_importance_resampling(spark, path).collect()
    weight, kept = brute(rows, labels)
    assert all(math.isclose(g.log_weight, weight[g.doc_id], rel_tol=1e-3, abs_tol=1e-2) for g in got)
    assert len({g.doc_id for g in got if g.kept} ^ kept) <= 2 and 150 < len(kept) < 300  # weights are 32-bit numbers here
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    _, kept = brute(rows, [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()])
    assert len({g.doc_id for g in im.op3_importance_resampling(spark, sf).collect() if g.kept} ^ kept) <= 2


def test_held_out_accuracy_on_given_labels(spark):
    """Fitted on half of the labels; the other half tells what stays."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows, _, least = im.judge(docs, labels.where("doc_id % 2 = 0"))
    held = labels.where("doc_id % 2 = 1").join(rows, "doc_id").selectExpr("quality = 1 AND coalesce(toxic, 0) = 0 AS good", "toxic = 1 AS toxic", "quality = 0 AS low", f"key >= {least} AS kept").collect()
    share = lambda c: sum(r.kept for r in held if r[c]) / sum(bool(r[c]) for r in held)
    assert share("good") > 0.95 and share("toxic") < 0.05 and share("low") < 0.05


def test_columns_of_any_name(spark):
    rows, labels = corpus(60)
    docs = documents(spark, rows, extra=["log_weight", "__text", "key", "id", "`a.b`", "c0"])
    kept = im.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns and 0 < kept.count() < 60
