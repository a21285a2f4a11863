"""Quality rules with n-gram perplexity bands (operator 7).

Base rules look at length and at windows of five words that a text repeats.  The method's verdict is a band: a modified
Kneser-Ney model of byte n-grams inside words (a word's bytes after four spaces, then one space) is counted in Spark for
each language over all documents, stored in sorted hash arrays in the shared folder, and memory-mapped by the
tasks that score.  A document is rejected if its perplexity per byte is outside its language's band, on either side.

Tasks count each distinct word of a slice of text once, with its frequency, so that counting and scoring cost little more
than finding the words.  The model holds as many n-grams as the languages have, which hardly grows with the corpus.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays
from .common import read_table, shared_dir, stash
from .language_model import slices
from .tokens import as_bytes, covered, hash_words, inside, mix64, windows, word_spans

#: Bytes of an n-gram; fewest words; most words in repeated windows, in percent; words of such a window.
ORDER, MIN_WORDS, MAX_REPEATED, REPEAT_WINDOW = 5, 10, 20, 5
#: Half-width of a band in robust standard deviations; these are at least so much (in log10 of the perplexity);
#: and what is added for short texts: their mean of n bytes varies by about SHORT / sqrt(n).
WIDTH, LEAST_SD, SHORT = 4.0, 0.01, 0.5
SYMBOLS = b"#*$%&|<>"
BIN = 1000
#: Most languages whose discounts (three numbers an order) and bands (two numbers) are broadcast.
BROADCAST_LANGUAGES = 100_000
_U = np.uint64
_SYMBOL, _IN_WORD = np.zeros(256, dtype=bool), np.ones(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_IN_WORD[0x80:0xC0] = False  # bytes after the first of a code point


def lang_code(lang: bytes) -> int:
    """23 bits for a language; null and empty share one."""
    return zlib.crc32(lang) & 0x7FFFFF


def word_grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (language, five bytes) of the n-grams of the words at starts:ends, in order, and how many each word has."""
    size = ends - starts
    padded, n = size + ORDER, size + 1
    out = np.full(int(padded.sum()), 32, dtype=np.uint8)
    to = np.cumsum(padded) - padded + ORDER - 1
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + step] = buf[np.repeat(starts, size) + step]
    last = np.repeat(to - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    key = np.full(len(last), lang, dtype=_U)
    for j in range(ORDER):
        key = (key << _U(8)) | out[last - (ORDER - 1) + j]
    return key, n


def _by_lang(langs: list[bytes]) -> dict[bytes, list[int]]:
    out: dict[bytes, list[int]] = {}
    for i, x in enumerate(langs):
        out.setdefault(x, []).append(i)
    return out


def _kinds(texts: list[bytes]):
    """Buffer of the texts; hash, start and end of each distinct word; which one each word is; words per text."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    starts, ends = word_spans(buf)
    h, counts = hash_words(texts)
    _, first, of = np.unique(h, return_index=True, return_inverse=True)
    return buf, starts[first], ends[first], of, counts


def count_grams(docs: DataFrame, buckets: int) -> DataFrame:
    """(key, n) of all byte n-grams of docs (lang, text): counted within tasks, then by range of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = arrays.Tally(buckets)
        made = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.binary()), pa.array(x[2], pa.binary())], names=["bucket", "key", "n"])
        for batch in batches:
            all_langs, all_texts = as_bytes(batch.column(0)), as_bytes(batch.column(1))
            for i, j in slices(all_texts):
                for lang, rows in _by_lang(all_langs[i:j]).items():
                    buf, s, e, of, _ = _kinds([all_texts[i + r] for r in rows])
                    key, n = word_grams(buf, s, e, lang_code(lang))
                    for x in tally.add(mix64(key), np.repeat(np.bincount(of, minlength=len(s)), n)):
                        yield made(x)
        for x in tally.close():
            yield made(x)

    def merge(table: pa.Table) -> pa.Table:
        key, n = arrays.merge_counts(table["key"].to_pylist(), table["n"].to_pylist())
        return pa.table({"key": pa.array(_unmix(key).view(np.int64)), "n": pa.array(n)})

    return docs.select("lang", "text").mapInArrow(run, "bucket long, key binary, n binary").groupBy("bucket").applyInArrow(merge, "key long, n long")


def _unmix(h: np.ndarray) -> np.ndarray:
    from .language_model import pair_of

    a, b = pair_of(h)
    return (a.astype(_U) << _U(32)) | b.astype(_U)


def _discounted() -> list[Column]:
    """Modified Kneser-Ney discounts d1 to d3 from the columns f1 to f4 (how many counts are 1 to 4), 0.5, 1 and 1.5 if these leave them open."""
    y = F.try_divide(F.col("f1"), F.col("f1") + 2 * F.col("f2"))
    d = [k - (k + 1) * y * F.try_divide(F.col(f"f{k + 1}"), F.col(f"f{k}")) for k in (1, 2, 3)]
    fine = F.coalesce((F.least("f1", "f2", "f3", "f4") > 0) & (F.least(*d) >= 0) & (d[0] <= 1) & (d[1] <= 2) & (d[2] <= 3), F.lit(False))
    return [F.when(fine, x).otherwise(F.lit(0.5 * k)).alias(f"d{k}") for k, x in enumerate(d, 1)]


def gram_probabilities(grams: DataFrame) -> DataFrame:
    """(key, logp): log10 of the interpolated modified Kneser-Ney probability of each n-gram's last byte after the others.

    Lower orders count the different n-grams of the next higher order that end in them.  Contexts have at most 256 followers,
    so windows over contexts are small; discounts are per language and order, and broadcast if there are few languages.
    """
    few = grams.select(F.shiftright("key", 8 * ORDER)).distinct().count() <= BROADCAST_LANGUAGES
    orders = {ORDER: grams.select(F.shiftright("key", 8 * ORDER).alias("lang"), F.col("key").bitwiseAND(F.lit((1 << 8 * ORDER) - 1)).alias("g"), "n")}
    for k in range(ORDER - 1, 0, -1):
        orders[k] = orders[k + 1].groupBy("lang", F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    below = None
    for k in range(1, ORDER + 1):
        freq = orders[k].groupBy("lang").agg(*[F.count(F.when(F.col("n") == c, 1)).cast("double").alias(f"f{c}") for c in (1, 2, 3, 4)])
        freq = freq.select(F.col("lang").alias("of"), *_discounted())
        freq = F.broadcast(freq) if few else freq
        own = Window.partitionBy("lang", F.shiftright("g", 8))
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = orders[k].join(freq, F.col("lang") == F.col("of")).withColumn("d", d).drop("of", "d1", "d2", "d3")
        t = t.withColumns({"total": F.sum("n").over(own).cast("double"), "gamma": F.sum("d").over(own)})
        if below is None:
            lower = F.lit(1.0 / 256)
        else:
            b = below.select(F.col("lang").alias("bl"), F.col("g").alias("bg"), F.col("p").alias("bp"))
            t = t.join(b, (F.col("lang") == F.col("bl")) & (F.col("g").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)) == F.col("bg")))
            lower = F.col("bp")
        below = t.select("lang", "g", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("gamma") / F.col("total") * lower).alias("p"))
    return below.select((F.shiftleft("lang", 8 * ORDER).bitwiseOR(F.col("g"))).alias("key"), F.log10("p").alias("logp"))


def write_model(probabilities: DataFrame, buckets: int) -> str:
    """Sorted hash arrays of (key, logp) in the shared folder; returns their path."""
    path = f"{arrays.mapped_path(shared_dir(probabilities.sparkSession))}/datascout-{uuid.uuid4().hex}/grams"

    def write(table: pa.Table) -> pa.Table:
        key = mix64(table["key"].to_numpy().view(_U))
        order = np.argsort(key)
        arrays.write(path, table["bucket"][0].as_py(), key=key[order], logp=table["logp"].to_numpy()[order])
        return pa.table({"n": [len(key)]})

    @F.pandas_udf("long")
    def bucket(key):
        import pandas as pd

        return pd.Series(arrays.bucket_of(mix64(key.to_numpy().view(_U)), buckets))

    probabilities.withColumn("bucket", bucket("key")).groupBy("bucket").applyInArrow(write, "n long").agg(F.sum("n")).first()
    return path


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    per_text = lambda flags: np.diff(np.cumsum(flags, dtype=np.int64)[ends - 1], prepend=0)
    h, counts = hash_words(texts)
    at = np.flatnonzero(inside(counts, REPEAT_WINDOW))
    doc = np.repeat(np.arange(len(texts), dtype=_U), counts)
    _, of, n = np.unique(mix64(windows(h, REPEAT_WINDOW)[at] + doc[at] * _U(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    again = covered(at[n[of] > 1], REPEAT_WINDOW, len(h))
    return {"n_words": counts, "word_chars": per_text(_IN_WORD[buf]), "n_symbols": per_text(_SYMBOL[buf]), "n_dup_lines": np.array([_dup_lines(t) for t in texts], dtype=np.int64), "n_repeat_words": np.bincount(doc[again].astype(np.int64), minlength=len(texts))}


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines))


def perplexities(texts: list[bytes], langs: list[bytes], path: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the perplexity per byte of each text (no words: 0), and the bytes that it is the mean over."""
    out, size = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
    for lang, rows in _by_lang(langs).items():
        buf, s, e, of, counts = _kinds([texts[r] for r in rows])
        if not len(of):
            continue
        key, n = word_grams(buf, s, e, lang_code(lang))
        kinds, back = np.unique(mix64(key), return_inverse=True)
        logp = arrays.gather(path, buckets, kinds, logp=np.float64(-10.0))["logp"][back]
        word = np.add.reduceat(logp, np.cumsum(n) - n)
        doc = np.repeat(np.arange(len(rows)), counts)
        bytes_of = np.bincount(doc, n[of], minlength=len(rows)).astype(np.int64)
        size[rows] = bytes_of
        out[rows] = -np.bincount(doc, word[of], minlength=len(rows)) / np.maximum(bytes_of, 1)
    return out, size


def scored(docs: DataFrame, path: str, buckets: int, keep: list[str]) -> DataFrame:
    """The columns keep of docs, the base counts, log_perplexity and its n_bytes."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity", "n_bytes"]
    schema = docs.select(*keep).schema
    for n in names:
        schema = schema.add(n, "double" if n == "log_perplexity" else "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = as_bytes(batch.column("__lang")), as_bytes(batch.column("__text"))
            parts = [{**base_counts(texts[i:j]), **dict(zip(names[5:], perplexities(texts[i:j], langs[i:j], path, buckets)))} for i, j in slices(texts)]
            if parts:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(np.concatenate([p[n] for p in parts])) for n in names)], names=[*keep, *names])

    return docs.select(*keep, F.col("lang").alias("__lang"), F.col("text").alias("__text")).mapInArrow(run, schema)


def bands(rows: DataFrame) -> DataFrame:
    """(band_of, middle, sd) for each language: median of log_perplexity and robust deviation, from counts of 1/1000 bins of
    the rows that pass the base rules."""
    x = F.round(F.col("log_perplexity") * BIN).cast("long")
    bins = rows.where("NOT base_failed").groupBy(F.coalesce("lang", F.lit("")).alias("band_of"), x.alias("x")).agg(F.count(F.lit(1)).alias("n"))

    def median(t: DataFrame, by: str, name: str) -> DataFrame:
        run, all_n = Window.partitionBy("band_of").orderBy(by), Window.partitionBy("band_of")
        t = t.withColumns({"upto": F.sum("n").over(run), "all_n": F.sum("n").over(all_n)})
        return t.where("2 * upto >= all_n").groupBy("band_of").agg(F.min(by).alias(name))

    middle = median(bins, "x", "middle")
    off = bins.join(middle, "band_of").withColumn("off", F.abs(F.col("x") - F.col("middle")))
    spread = median(off, "off", "mad")
    return middle.join(spread, "band_of").select("band_of", (F.col("middle") / BIN).alias("middle"), F.greatest(F.lit(LEAST_SD), F.col("mad") * 1.4826 / BIN).alias("sd"))


def judge(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of docs with base counts, base_failed, log_perplexity and kept."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    grams = stash(count_grams(docs, max(8, total >> 23)), "grams")
    buckets = max(1, grams.count() >> 20)
    path = write_model(gram_probabilities(grams), buckets)
    names = list(dict.fromkeys([*keep, "lang"]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = stash(scored(docs, path, buckets, names).withColumn("base_failed", failed), "quality_rows")
    half = WIDTH * (F.col("sd") + F.lit(SHORT) / F.sqrt(F.greatest(F.col("n_bytes"), F.lit(1))) / WIDTH)
    inside_band = F.abs(F.col("log_perplexity") - F.col("middle")) <= half
    band = stash(bands(rows), "bands")  # a row a language
    band = F.broadcast(band) if band.count() <= BROADCAST_LANGUAGES else band
    got = rows.join(band, F.coalesce("lang", F.lit("")) == F.col("band_of"), "left")
    return got.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(inside_band, F.lit(True))).alias("kept"), "log_perplexity")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document.

    Null and empty texts have no words and fail the base rules; null and empty languages share a model; repeated rows are judged each.
    Empty table: no rows.
    """
    return judge(read_table(spark, sf_dir, "documents"), ["doc_id"])
