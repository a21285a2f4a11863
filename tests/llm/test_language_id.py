import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from datascout.llm import language_id
from datascout.llm.common import read_table
from tests.llm.helpers import documents, saved

SYLLABLES = {"xa": ["ka", "to", "mi", "ra"], "xb": ["schu", "en", "ber", "ich"], "xc": ["éa", "oñ", "que", "ci"], "xd": ["ться", "про", "на", "ов"]}


def text(lang, seed, n):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1


def test_held_out_accuracy_of_the_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = language_id.op12_language_codes(spark, sf).join(read_table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    right = got.where("held_out AND lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    assert got.where("score < 0 OR score > 1 OR lang_pred IS NULL OR held_out IS NULL").count() == 0
    assert got.count() == read_table(spark, sf, "documents").count()


def brute(rows):
    """The whole operator again, one n-gram at a time (no language has FEW texts or more, so all fit and check)."""
    fit = [(t, lang) for i, t, lang in rows if not held(i) and lang is not None and t and any(c.isalpha() for c in t)]
    langs = sorted({x for _, x in fit})

    def grams(t):
        x = b" " + bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in t.encode()) + b" "
        while b"  " in x:
            x = x.replace(b"  ", b" ")
        out = []
        for size in (2, 3, 4):
            for i in range(len(x) - size + 1):
                code = int.from_bytes(x[i : i + size], "little")
                out.append((size, code if size == 2 else code * 0x9E3779B1 % 2**32 >> 16))
        return out

    counts = {lang: Counter() for lang in langs}
    for t, lang in fit:
        counts[lang].update(grams(t))
    totals = {(lang, s): sum(n for (size, _), n in counts[lang].items() if size == s) for lang in langs for s in (2, 3, 4)}
    p = lambda lang, g: (counts[lang][g] + 0.5) / (totals[lang, g[0]] + 0.5 * 65536)
    code = {lang: [1 - 2 * (c >> (i - 1) & 1) if i else 1 for c in range(1, 2 ** (len(langs) - 1))] for i, lang in enumerate(langs)}
    bits = range(2 ** (len(langs) - 1) - 1)

    def means(t):
        g = grams(t)
        mean = lambda sign, b, x: sum(p(y, x) for y in langs if code[y][b] == sign) / sum(code[y][b] == sign for y in langs)
        weights = {x: [math.log(mean(1, b, x)) - math.log(mean(-1, b, x)) for b in bits] for x in set(g)}
        return [sum(weights[x][b] for x in g) / len(g) for b in bits]

    checked = [(means(t), lang) for t, lang in fit]
    scale = [float(np.median([abs(m[b]) for m, _ in checked])) for b in bits]
    trust = {}
    for lang in langs:
        own = [m for m, x in checked if x == lang]
        share = [max(0.01, sum((m[b] > 0) == (code[lang][b] > 0) for m in own) / len(own)) for b in bits]
        trust[lang] = [s / sum(share) for s in share]
    out = {}
    for i, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            out[i] = ("und", 0.0)
            continue
        m = means(t)
        loss = {y: sum(trust[y][b] * (1 - code[y][b] * math.tanh(m[b] / scale[b])) / 2 for b in bits) for y in langs}
        best = min(langs, key=loss.get)
        out[i] = (best, 1 - loss[best])
    return out


def test_against_brute_force(spark):
    r, rows = random.Random(2), []
    for i in range(60):
        lang = r.choice(list(SYLLABLES))
        rows.append((i, text(lang, i, r.choice([1, 3, 30])) + r.choice(["", " 12, OK!", "\n\n--"]), lang if i % 9 else None))
    rows += [(100, None, "xa"), (101, "", "xb"), (102, "12 !? ", "xc"), (None, text("xd", 7, 9), "xd"), (103, text("xa", 3, 4) + " " + text("xb", 3, 4), None)]
    docs = documents(spark, [(i, t, lang, "s") for i, t, lang in rows], extra=["score", "number"])
    got = {x.doc_id: x for x in language_id.op12_language_codes(spark, saved(spark, documents=docs)).collect()}
    want = brute(rows)
    assert {i: x.held_out for i, x in got.items()} == {i: held(i) for i, *_ in rows}
    assert {i: x.lang_pred for i, x in got.items()} == {i: x for i, (x, _) in want.items()}
    assert max(abs(got[i].score - s) for i, (_, s) in want.items()) < 1e-4
    assert got[100].score == 0 and not got[101].ambiguous


def test_many_languages_one_and_none(spark):
    names = [f"l{i:02d}" for i in range(12)]
    r = random.Random(1)
    parts = {x: ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéñßø") for _ in range(r.randrange(2, 5))) for _ in range(12)] for x in names}
    rows = [(i, " ".join("".join(random.Random(i * 99 + k).choices(parts[names[i % 12]], k=2)) for k in range(40)), names[i % 12], "s") for i in range(600)]
    got = language_id.op12_language_codes(spark, saved(spark, documents=documents(spark, rows))).collect()
    out = [x.lang_pred == names[x.doc_id % 12] for x in got if x.held_out]
    assert len(out) > 100 and sum(out) / len(out) > 0.97
    one = documents(spark, [(i, t, "l00", "s") for i, t, _, _ in rows[:20]] + [(50, "7", "l00", "s")])
    assert {(x.lang_pred, x.score) for x in language_id.op12_language_codes(spark, saved(spark, documents=one)).collect()} == {("l00", 1.0), ("und", 0.0)}
    none = documents(spark, [(1, "word", None, "s"), (2, None, "l00", "s")])
    assert {x.lang_pred for x in language_id.op12_language_codes(spark, saved(spark, documents=none)).collect()} == {"und"}
    assert language_id.op12_language_codes(spark, saved(spark, documents=documents(spark, []))).collect() == []


def test_codewords_and_chunks(monkeypatch):
    for n in (2, 3, 4, 5, 6, 30):
        code = language_id.codewords(n)
        apart = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
        assert set(np.unique(code)) == {-1, 1} and (np.abs(code.sum(axis=0)) < n).all() and apart >= 2 ** (n - 2) if n <= 5 else apart >= 8
    t = ("Straße, ÉCOLE 東京 x1 " * 50).encode()
    whole = np.sort(np.concatenate(list(language_id.ngrams(t))))
    monkeypatch.setattr(language_id, "CHUNK", 7)
    assert (np.sort(np.concatenate(list(language_id.ngrams(t)))) == whole).all()
