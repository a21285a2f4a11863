"""Quality classifier by importance resampling (operator 3).

Two generative models of hashed n-grams are counted: of target texts (labelled good and not toxic) and of raw texts (all).  A text's
log importance is the sum of the log ratios of its features.  As many texts are kept as score above the level that
best parts the labelled ones, sampled by Gumbel top-k: keys are log importance plus Gumbel noise, and the k largest stay.

Features of each word: the word without case and punctuation, its first bytes (stems), the pair with the word before,
and the pair of its shape (case, digits, symbols, repeats) with the shape before.  The target model is smoothed towards the raw one: a
feature has its own target probability only where the counts tell it from the raw one, by CHANCE standard deviations and a factor
of FACTOR, for or against a text alike; else it has the raw probability and weighs nothing.  So a long text isn't decided by many differences
that the choice of labelled texts makes.  Ratios are centred on their mean over target texts, so that length alone has no weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import from_planes, planes
from .common import column, hash52, read_table, stash, text_key
from .language_model import slices
from .tokens import as_bytes, hash_words, mix64, word_spans

#: Labelled rows that the target model is fitted on and the level is set by, at most: those with the smallest hash of their id.
MAX_LABELLED = 20_000
#: Hash buckets (a power of two) and shape pairs; lengths of stems in bytes.
BITS, SHAPES, STEMS = 20, 64, (4, 6)
FEATURES = (1 << BITS) + SHAPES * SHAPES
#: Smoothing: pseudo-count of both models; standard deviations, and factor, up to which the target model takes the raw probability.
SMOOTH, CHANCE, FACTOR = 2.0, 4.0, 2.0
#: Ranges of features that are summed up as one row; tasks whose sums meet in one group.
RANGE, FAN = 1 << 15, 64
_U = np.uint64
_PLAIN = bytes(32 if x < 128 and not chr(x).isalnum() else ord(chr(x).lower()) if x < 128 else x for x in range(256))
_UPPER, _DIGIT, _SYMBOL = (np.zeros(256, dtype=np.int64) for _ in range(3))
_UPPER[65:91] = _DIGIT[48:58] = _SYMBOL[list(b"#*$%&|<>!=@^~_{}[]\\")] = 1


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix64(h + _U(0x9E3779B97F4A7C15 * (kind + 1) & (2**64 - 1))) >> _U(64 - BITS)).astype(np.int64)


def _pairs(h: np.ndarray, counts: np.ndarray, none) -> np.ndarray:
    """The value before each, `none` at the start of a text."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    first = (np.cumsum(counts) - counts)[counts > 0]
    before[first] = none
    return before


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all texts and the text of each."""
    plain = [t.translate(_PLAIN) for t in texts]
    out, docs, which = [], [], np.arange(len(texts))
    h, counts = hash_words(plain)
    for kind, x in enumerate([h, *(hash_words(plain, prefix=n)[0] for n in STEMS), h * _U(3) + _pairs(h, counts, _U(1))]):
        out.append(_bucket(x, kind))
        docs.append(np.repeat(which, counts))
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    starts, _ = word_spans(buf)
    raw, counts = hash_words(texts)
    if len(starts):
        some = lambda flags: np.add.reduceat(flags[buf], starts)
        capitals = some(_UPPER)
        last = _pairs(raw, counts, _U(0))
        shape = (capitals == 1) + 2 * (capitals > 1) + 4 * (some(_DIGIT) > 0) + 8 * (some(_SYMBOL) > 0) + 16 * ((raw == last) | (raw == _pairs(last, counts, _U(0)))) + 32 * (capitals * 2 > np.diff(np.r_[starts, len(buf)]))
        out.append((1 << BITS) + shape * SHAPES + _pairs(shape, counts, 0))
        docs.append(np.repeat(which, counts))
    return np.concatenate(out), np.concatenate(docs)


def _counted(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts of all rows of docs (text, target) and of those with target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, FEATURES), dtype=np.int64)
        for batch in batches:
            texts, target = as_bytes(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in slices(texts):
                f, doc = features(texts[i:j])
                counts[0] += np.bincount(f, minlength=FEATURES)
                if target[i:j].any():
                    counts[1] += np.bincount(f[target[i:j][doc]], minlength=FEATURES)
        cuts = range(0, FEATURES, RANGE)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(cuts), pa.int64()), pa.array(list(cuts), pa.int64()), *[pa.array([planes(c[s : s + RANGE]) for s in cuts], pa.binary()) for c in counts]], names=["part", "at", "every", "target"])

    def add(table: pa.Table) -> pa.Table:
        sums = [np.sum([from_planes(b, np.int64) for b in table[c].to_pylist()], axis=0) for c in ("every", "target")]
        return pa.table({"part": pa.array([table["part"][0].as_py() // FAN], pa.int64()), "at": table["at"].slice(0, 1), "every": [planes(sums[0])], "target": [planes(sums[1])]})

    kind = "part long, at long, every binary, target binary"
    out = np.zeros((2, FEATURES), dtype=np.int64)
    sums = docs.mapInArrow(run, kind)
    for _ in range(2):  # FAN tasks' sums meet in a group, then FAN of these
        sums = sums.groupBy(F.floor(F.col("part") / FAN).alias("to"), "at").applyInArrow(add, kind)
    for r in sums.groupBy("at").applyInArrow(add, kind).collect():  # FEATURES numbers, whatever the input
        for x, b in zip(out, (r.every, r.target)):
            x[r.at : r.at + RANGE] = from_planes(bytes(b), np.int64)
    return out[0], out[1]


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target / p_raw of each feature, the target model smoothed towards the raw one; less the mean over target texts.

    Hashed words and shape pairs are models of their own.
    """
    out = np.zeros(FEATURES, dtype=np.float32)
    for at in (slice(0, 1 << BITS), slice(1 << BITS, FEATURES)):
        r, t = raw[at].astype(float), target[at].astype(float)
        if t.sum():
            due = r * (t.sum() / r.sum())
            ratio = np.log((t + SMOOTH) / (due + SMOOTH))
            ratio = np.where((np.abs(due - t) > CHANCE * np.sqrt(due + SMOOTH)) & (np.abs(ratio) > np.log(FACTOR)), ratio, 0)
            out[at] = ratio - (t * ratio).sum() / t.sum()
    return out


def with_scores(docs: DataFrame, weights: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep of docs and `log_weight` of its text (null: as an empty text, 0)."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # FEATURES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = as_bytes(batch.column("__text")), []
            for i, j in slices(texts):
                f, doc = features(texts[i:j])
                out.append(np.bincount(doc, sent.value[f], minlength=j - i))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.concatenate([np.zeros(0), *out]))], names=[*keep, "log_weight"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, docs.select(*keep).schema.add("log_weight", "double"))


def gumbel_key(log_weight: Column, doc_id: Column) -> Column:
    """Log weight plus Gumbel noise from a hash of the id, in units of 2**-20, clipped to 47 bits: rows that repeat an id share their noise."""
    u = (hash52(F.lit("gumbel"), text_key(doc_id)).cast("double") + 0.5) / 2.0**52
    return F.round(F.greatest(F.lit(-1e7), log_weight - F.log(-F.log(u))) * 2.0**20).cast("long")


def kth_largest(rows: DataFrame, key: str, k: int) -> int:
    """The k-th largest value of a 48-bit key, found from its first, middle and last 16 bits: each time at most 65,536 counts."""
    low, width = -(1 << 47), 1 << 32
    for _ in range(3):
        part = F.floor((F.col(key) - F.lit(low)) / F.lit(width))
        counts = rows.where(F.col(key).between(low, low + (width << 16) - 1)).groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(counts, reverse=True):
            if k <= r.n:
                low += r.p * width
                break
            k -= r.n
        width >>= 16
    return low


def best_level(labelled: DataFrame) -> float:
    """The level of log_weight that parts good from other rows best: the share of good rows above it plus that of other rows below.

    Ties go to the lower level, which keeps more.  Without rows of either kind: minus infinity.
    """
    got = labelled.groupBy("good", F.round("log_weight", 1).alias("x")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most MAX_LABELLED rows
    total = {g: sum(r.n for r in got if r.good == g) for g in (True, False)}
    if not all(total.values()):
        return float("-inf")
    gain, best, level = 0.0, 0.0, float("-inf")
    for r in sorted(got, key=lambda r: r.x):
        gain += (-1 if r.good else 1) * r.n / total[r.good]
        if gain > best + 1e-12:
            best, level = gain, r.x + 0.05
    return level


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """Log ratios, and the labelled rows (id, good) that they come from: good means quality 1 and not toxic."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.min(good).alias("good"))
    known = stash(known.orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED), "labelled")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("id"), "left").select("text", F.coalesce("good", F.lit(False)).alias("target"))
    return log_ratios(*_counted(rows)), known


def _least_key(rows: DataFrame, known: DataFrame, doc_id: str = "doc_id") -> int:
    """The least key that is kept, of scored rows (doc_id, log_weight, key)."""
    level = best_level(rows.join(F.broadcast(known), F.col(doc_id) == F.col("id")).select("good", "log_weight"))
    k = rows.where(F.col("log_weight") >= F.lit(level)).count()
    return kth_largest(rows, "key", k) if k else 1 << 62


def judge(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """Scored rows (doc_id, log_weight, key), the log ratios, and the least key that is kept."""
    weights, known = fit(docs, labels)
    rows = with_scores(docs, weights, ["doc_id"]).withColumn("key", gumbel_key(F.col("log_weight"), F.col("doc_id")))
    rows = stash(rows, "importance")
    return rows, weights, _least_key(rows, known)


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns, whatever their names; see op3 for special rows.

    The scored table is written once, so texts are scored once.
    """
    weights, known = fit(docs, labels)
    at = {n: f"c{i}" for i, n in enumerate(docs.columns)}
    packed = docs.select(*[column(n).alias(c) for n, c in at.items()])
    rows = with_scores(packed, weights, list(at.values()), at["text"]).withColumn("key", gumbel_key(F.col("log_weight"), F.col(at["doc_id"])))
    rows = stash(rows, "importance")
    return rows.where(F.col("key") >= F.lit(_least_key(rows, known, at["doc_id"]))).select(*[F.col(c).alias(n) for n, c in at.items()])


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log importance of every document and whether it is kept.

    Null and empty texts have log importance 0.  Rows that repeat an id share its noise; rows of the same key are kept or
    rejected together.  Labels of ids without a document, and null labels, have no effect; without labels all rows stay.  Empty
    table: no rows.
    """
    rows, _, least = judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "log_weight", (F.col("key") >= F.lit(least)).alias("kept"))
