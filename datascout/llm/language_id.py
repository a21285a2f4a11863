"""Language identification by error-correcting output codes (operator 12).

Every language has a codeword of bits.  For each bit a binary classifier of byte n-grams tells the languages that have it from those
that don't: its weights are log ratios of the n-grams' probabilities under both groups, each language counting alike.  A text's
margins, squeezed to -1..1, are compared with all codewords; a bit's loss weighs as much as its classifier was right about the language on texts
kept aside.  The codeword of the least loss wins, and a prediction is flagged if another codeword is nearly as close.

N-grams of two, three and four bytes of the whole text are taken, A-Z lower-cased and runs of other ASCII signs as one space.  They are counted
in Spark over a bounded sample of labelled texts; the model is an array of a fixed number of rows, so the pass over all documents
is one map without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash52, read_table, stash, text_key
from .tokens import as_bytes

#: Texts of a language that the classifiers are fitted on, about: those with the smallest hashes of their ids.  Languages, the most frequent first.
MAX_TEXTS, MAX_LANGUAGES = 4000, 256
#: Every KEPT_ASIDE-th of them sets scales and weights instead, where a language has FEW or more.
KEPT_ASIDE, FEW = 8, 32
#: Hashed n-grams of each length; lengths are 2, 3 and 4 bytes.  Pseudo-count of an n-gram.
WIDTH, ORDERS, SMOOTH = 1 << 16, 3, 0.5
FEATURES = ORDERS * WIDTH
#: N-grams that are weighed by one group; bytes of a text that are looked up at once.
SLICE, CHUNK = 1 << 13, 1 << 16
#: A prediction is ambiguous if the second language's loss is within this of the first's.
AMBIGUOUS = 0.1
NONE = "und"
_LETTERS = bytes(ord(chr(x).lower()) if x < 128 and chr(x).isalpha() else x if x > 127 else 32 for x in range(256))


def codewords(n: int) -> np.ndarray:
    """A row of 1 and -1 for each of n languages: all ways to part them for up to five, else the random code of the best of many draws.

    One language has no bits; two have one.
    """
    if n < 2:
        return np.zeros((n, 0))
    if n <= 5:
        columns = np.arange(1, 1 << (n - 1))
        bits = columns[None, :] >> np.arange(n - 1)[:, None] & 1
        return np.vstack([np.zeros((1, len(columns))), bits]) * -2 + 1
    best, wide, length = None, -1, 10 * (n - 1).bit_length()
    for seed in range(100):
        code = np.random.default_rng(seed).integers(0, 2, (n, length)) * 2 - 1
        apart = (length - code @ code.T) // 2 + length * np.eye(n, dtype=np.int64)
        parts = (np.abs(code.sum(axis=0)) < n).all()
        if parts and apart.min() > wide:
            best, wide = code, int(apart.min())
    return best.astype(float)


def ngrams(text: bytes) -> Iterator[np.ndarray]:
    """The n-grams of a text as features, in runs of bounded length."""
    x = np.frombuffer(b" " + text.translate(_LETTERS) + b" ", dtype=np.uint8)
    keep = x != 32
    keep[1:] |= keep[:-1]
    keep[0] = True
    x = x[keep]
    for i in range(0, len(x) - 1, CHUNK):
        part = x[i : i + CHUNK + ORDERS].astype(np.uint32)
        code, out = part, []
        for order in range(ORDERS):
            code = code[:-1] | part[order + 1 :] << np.uint32(8 * (order + 1))
            hashed = (code * np.uint32(0x9E3779B1)) >> np.uint32(16) if order else code
            out.append(hashed[:CHUNK] + np.uint32(order * WIDTH))
        yield np.concatenate(out)


def labelled(docs: DataFrame, usable: Column) -> tuple[list[str], DataFrame | None]:
    """The languages, and their sample (lang number, text, fits, checks); None without any."""
    rows = docs.where(usable & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    langs = sorted((r.lang, r.n) for r in counts)
    if not langs:
        return [], None
    known = docs.sparkSession.createDataFrame([(x, i, MAX_TEXTS / n, n) for i, (x, n) in enumerate(langs)], "name string, number int, share double, n long")
    h = hash52(F.lit("language"), text_key(F.col("doc_id")))
    sample = rows.select("lang", "text", h.alias("h")).join(F.broadcast(known), F.col("lang") == F.col("name")).where(F.col("h") < F.col("share") * 2.0**52)
    few, aside = F.col("n") < FEW, F.col("h") % KEPT_ASIDE == 0
    sample = sample.select("number", "text", (few | ~aside).alias("fits"), (few | aside).alias("checks"))
    parts = max(1, sum(min(n, MAX_TEXTS) for _, n in langs) // 1000)
    return [x for x, _ in langs], stash(sample.repartition(parts), "labelled")


def _counts(sample: DataFrame) -> DataFrame:
    """(number, feature, n) over the sample's texts that fit."""

    def rows(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for number, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number), pa.int32()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["number", "feature", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                if number not in held:
                    if len(held) >= 64:
                        yield from rows(held)
                        held.clear()
                    held[number] = np.zeros(FEATURES, dtype=np.int64)
                for f in ngrams(text):
                    held[number] += np.bincount(f, minlength=FEATURES)
        yield from rows(held)

    return sample.where("fits").select("number", "text").mapInArrow(run, "number int, feature int, n long").groupBy("number", "feature").agg(F.sum("n").alias("n"))


def _weights(counts: DataFrame, code: np.ndarray) -> np.ndarray:
    """The classifiers: a row for each feature, a column for each bit."""
    totals = np.zeros((len(code), ORDERS))
    for r in counts.groupBy("number", F.floor(F.col("feature") / WIDTH).cast("int").alias("order")).agg(F.sum("n").alias("n")).collect():
        totals[r["number"], r["order"]] = r["n"]

    def weigh(table: pa.Table) -> pa.Table:
        feature = table["feature"].to_numpy()
        start = int(feature[0]) // SLICE * SLICE
        n = np.zeros((len(code), SLICE))
        n[table["number"].to_numpy(), feature - start] = table["n"].to_numpy()
        p = (n + SMOOTH) / (totals[:, start // WIDTH] + SMOOTH * WIDTH)[:, None]
        on = code > 0
        bits = [np.log(p[on[:, b]].mean(axis=0)) - np.log(p[~on[:, b]].mean(axis=0)) for b in range(code.shape[1])]
        return pa.table({"start": pa.array([start], pa.int32()), "weights": pa.array([np.stack(bits, axis=1).astype("<f4").tobytes()], pa.binary())})

    # n-grams that the sample lacks weigh as much as the smoothing gives them: a slice without any is left at 0
    out = np.zeros((FEATURES, code.shape[1]), dtype=np.float32)
    made = counts.withColumn("slice", F.floor(F.col("feature") / SLICE)).groupBy("slice").applyInArrow(weigh, "start int, weights binary")
    for r in made.collect():  # FEATURES rows of the model, whatever the input
        out[r.start : r.start + SLICE] = np.frombuffer(r.weights, dtype="<f4").reshape(SLICE, -1)
    return out


class Model:
    """Languages, codewords, classifiers, and the scale and weight of each bit."""

    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray):
        self.langs, self.code, self.weights = langs, code, weights
        self.scale = np.ones(code.shape[1])
        self.trust = np.full(code.shape, 1 / max(1, code.shape[1]))

    def means(self, text: bytes) -> np.ndarray:
        """Mean weight of the text's n-grams, for each bit."""
        total, n = np.zeros(self.code.shape[1]), 0
        for f in ngrams(text):
            total += self.weights[f].sum(axis=0, dtype=np.float64)
            n += len(f)
        return total / max(1, n)

    def calibrate(self, numbers: np.ndarray, means: np.ndarray) -> None:
        """Sets scales and weights by means() of texts whose languages are known."""
        if not len(numbers) or not self.code.shape[1]:
            return
        self.scale = np.maximum(np.median(np.abs(means), axis=0), 1e-6)
        right = (means > 0) == (self.code[numbers] > 0)
        for i in np.unique(numbers):
            share = np.maximum(right[numbers == i].mean(axis=0), 0.01)
            self.trust[i] = share / share.sum()

    def losses(self, means: np.ndarray) -> np.ndarray:
        """Loss of every codeword, 0 to 1."""
        if not self.code.shape[1]:
            return np.zeros(len(self.langs))
        return (self.trust * (1 - self.code * np.tanh(means / self.scale))).sum(axis=1) / 2

    def predict(self, text: bytes) -> tuple[str, float, bool]:
        losses = self.losses(self.means(text))
        best = int(losses.argmin())
        second = np.delete(losses, best).min(initial=np.inf)
        return self.langs[best], min(1.0, max(0.0, 1 - float(losses[best]))), bool(second - losses[best] < AMBIGUOUS)


def fit(docs: DataFrame, usable: Column) -> Model | None:
    """The model of the usable rows of docs (doc_id, text, lang); None if none has a language."""
    langs, sample = labelled(docs, usable)
    if sample is None:
        return None
    code = codewords(len(langs))
    if len(langs) < 2:
        return Model(langs, code, np.zeros((FEATURES, 0), dtype=np.float32))
    model = Model(langs, code, _weights(stash(_counts(sample), "ngram_counts"), code))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means = [held.value.means(t).tolist() for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(means, pa.list_(pa.float64()))], names=["number", "means"])

    # one in KEPT_ASIDE of a bounded sample, a number for each bit
    checked = sample.where("checks").select("number", "text").mapInArrow(run, "number int, means array<double>").collect()
    model.calibrate(np.array([r["number"] for r in checked], dtype=np.int64), np.array([r["means"] for r in checked]).reshape(len(checked), -1))
    return model


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model | None, keep: list[str | Column]) -> DataFrame:
    """The columns `keep` of docs, lang_pred, score (1 less the loss) and ambiguous of each row by its whole text.

    A null text or one without a letter, and any text without a model, is "und" with score 0 and not ambiguous.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.when(has_letter(F.col("text")), F.col("text")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            texts = batch.column(n).cast("large_binary").to_pylist()
            found = [(NONE, 0.0, False) if t is None or held.value is None else held.value.predict(t) for t in texts]
            more = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *more], names=[*batch.schema.names[:n], "lang_pred", "score", "ambiguous"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id: Column) -> Column:
    """One document in three, by the CRC32 of its id; a null id counts as an empty text, whose remainder is 0."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def op12_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify() of all documents by the model of those that aren't held out and have a text with a letter and a language.

    Rows that repeat are documents each.  No such document: all are "und".  One language only: every text with a letter is of it, with score 1.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, ~held_out(F.col("doc_id")) & has_letter(F.col("text")))
    return identify(docs, model, ["doc_id", held_out(F.col("doc_id")).alias("held_out")])
