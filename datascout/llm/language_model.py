"""Interpolated modified Kneser-Ney bigram model (operator 4).

Spark counts it in two passes over the texts, and tasks write it to the shared folder as sorted hash arrays, which workers
map into memory to score texts in a third pass.

* Words: hash ranges of words get sorted arrays of word hashes and counts; a word's number is its range's first number plus its place.
* Pairs: tasks count (word number, word number) pairs; a pair's key is a bijection of the two numbers, so keys never
  collide.  Each key range gets a sorted array of keys and counts.
* Continuations: from the pairs, each word gets how many pairs start with it once, twice and more often, and how many end in it.

Nothing but a few sums goes through the driver.  Ranges are of bounded size, so there are more of them for a larger corpus; tasks only touch
those that hold a word or pair of theirs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays
from .common import read_table, shared_dir
from .tokens import as_bytes, hash_words, mix64

#: Bytes of text for each range of words or pairs; bytes of text that a task works on at a time.
RANGE_BYTES, SLICE_BYTES = 16 << 20, 2 << 20
#: Hashes that stand for the end and the start of a text; no word has their first bit pattern but by chance of 2**-64.
END, START = np.uint64(0x5D1F_0E9A_77C3_2B41), np.uint64(0xA2C4_9B17_03DE_6F85)
_U = np.uint64
_INVERSE = [np.uint64(pow(m, -1, 1 << 64)) for m in (0x94D049BB133111EB, 0xBF58476D1CE4E5B9)]


def _unshift(x: np.ndarray, n: int) -> np.ndarray:
    y = x
    for _ in range(64 // n):
        y = x ^ (y >> _U(n))
    return y


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64((a.astype(_U) << _U(32)) | b.astype(_U))


def pair_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two word numbers of a key: mix64 undone."""
    x = _unshift(key, 31) * _INVERSE[0]
    x = _unshift(x, 27) * _INVERSE[1]
    x = _unshift(x, 30)
    return (x >> _U(32)).astype(np.int64), (x & _U(0xFFFFFFFF)).astype(np.int64)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many counts are 1, 2, 3 and 4; where these leave them open, 0.5, 1 and 1.5."""
    n1, n2, n3, n4 = n
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return d if all(0 <= x <= k for k, x in enumerate(d, 1)) else (0.5, 1.0, 1.5)


def discount_of(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.select([c == 1, c == 2, c > 2], d, 0.0)


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the numbers that hold for all of them."""

    path: str
    buckets: int
    stride: int  # numbers that each word range has
    tokens: int
    distinct: int
    pair_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    word_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    pairs: int = 0
    word_gamma: float = 0.0

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of sorted hashes; -1: unknown."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        for b, at, hit, place in arrays.find(f"{self.path}/words", self.buckets, hashes):
            out[at][hit] = self.stride * b + place
        return out


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many bytes."""
    i = size = 0
    for j, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def token_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts (words of the lower-cased text, then END), and how many each text has."""
    h, counts = hash_words([t.lower() for t in texts])
    return np.insert(h, np.cumsum(counts), END), counts + 1


def _before(tokens: np.ndarray, counts: np.ndarray, start) -> np.ndarray:
    """The token before each token; `start` before the first of a text."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.cumsum(counts) - counts] = start
    return out


def _counted(texts: DataFrame, buckets: int, keys_of) -> DataFrame:
    """(bucket, key, n): what keys_of(texts) yields, counted within tasks.  texts: one column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = arrays.Tally(buckets)
        made = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.binary()), pa.array(x[2], pa.binary())], names=["bucket", "key", "n"])
        for batch in batches:
            all_texts = as_bytes(batch.column(0))
            for i, j in slices(all_texts):
                for x in tally.add(keys_of(all_texts[i:j])):
                    yield made(x)
        for x in tally.close():
            yield made(x)

    none = texts.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(b"").alias("key"), F.lit(b"").alias("n"))
    return texts.mapInArrow(run, "bucket long, key binary, n binary").unionByName(none)  # so that each bucket gets its arrays


def _freqs(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def train(texts: DataFrame, buckets: int) -> Model:
    """Model of the texts (one column of strings)."""
    path = f"{arrays.mapped_path(shared_dir(texts.sparkSession))}/datascout-{uuid.uuid4().hex}/model"

    def words_of(t: list[bytes]) -> np.ndarray:
        tokens, counts = token_runs(t)
        return np.concatenate([tokens, np.repeat(START, len(counts))])

    def write_words(table: pa.Table) -> pa.Table:
        b = table["bucket"][0].as_py()
        key, n = arrays.merge_counts(table["key"].to_pylist(), table["n"].to_pylist())
        arrays.write(f"{path}/words", b, key=key, n=n)
        return pa.table({"bucket": [b], "size": [len(key)], "total": [int(n.sum())], "starts": [int(n[key == START].sum())]})

    made = _counted(texts, buckets, words_of).groupBy("bucket").applyInArrow(write_words, "bucket long, size long, total long, starts long")
    sums = made.agg(F.sum("size"), F.sum("total"), F.sum("starts"), F.max("size")).first()
    distinct, total, starts, stride = (x or 0 for x in sums)
    if stride * buckets >= 1 << 32:
        raise ValueError("the model numbers words with 32 bits")
    first = Model(path, buckets, stride, total - starts, distinct - (starts > 0))
    if not starts:
        return first

    def pairs_of(t: list[bytes]) -> np.ndarray:
        tokens, counts = token_runs(t)
        kinds, of = np.unique(np.append(tokens, START), return_inverse=True)
        number = first.numbers(kinds)[of]
        return pair_key(_before(number[:-1], counts, number[-1]), number[:-1])

    def write_pairs(table: pa.Table) -> pa.Table:
        b = table["bucket"][0].as_py()
        key, n = arrays.merge_counts(table["key"].to_pylist(), table["n"].to_pylist())
        arrays.write(f"{path}/pairs", b, key=key, n=n.astype(np.uint32) if n.max(initial=0) < 1 << 32 else n)
        a, w = pair_of(key)
        a, n1, n2, n3 = arrays.add_up(a.astype(_U), (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64))
        w, ends = arrays.add_up(w.astype(_U), np.ones(len(w), dtype=np.int64))
        out = {"bucket": [], "kind": [], "id": [], **{f"v{k}": [] for k in range(3)}}
        for kind, ids, values in ((0, a, (n1, n2, n3)), (1, w, (ends,))):
            for r, at in arrays.runs(ids // _U(stride)):
                row = (r, kind, arrays.pack_sorted(ids[at]), *[arrays.planes(v[at].astype(np.uint32)) for v in values], b"", b"")
                for x, v in zip(out.values(), row):
                    x.append(v)
        f = _freqs(n)
        for k, x in enumerate(out.values()):  # one row more: how many counts are 1, 2, 3 and 4
            x.append([-1, 2, np.array([*f, len(key)], dtype=np.int64).tobytes(), b"", b"", b""][k])
        return pa.table({"bucket": pa.array(out["bucket"], pa.int64()), "kind": pa.array(out["kind"], pa.int64()), **{c: pa.array(out[c], pa.binary()) for c in ("id", "v0", "v1", "v2")}})

    def write_rest(table: pa.Table) -> pa.Table:
        b, kinds = table["bucket"][0].as_py(), table["kind"].to_pylist()
        if b < 0:
            sums = np.sum([np.frombuffer(x, dtype=np.int64) for x in table["id"].to_pylist()], axis=0)
            return pa.table({"pairs": [True], "n": [sums.tolist()]})
        cols = [table[c].to_pylist() for c in ("id", "v0", "v1", "v2")]
        values = np.zeros((4, len(arrays.load(f"{path}/words", b, "key"))), dtype=np.int64)
        for kind, i, *v in zip(kinds, *cols):
            at = (arrays.unpack_sorted(i) - _U(stride * b)).astype(np.int64)  # places are distinct within a row
            for k, x in enumerate(v[: 1 if kind else 3]):
                values[3 if kind else k][at] += arrays.from_planes(x, np.uint32)
        arrays.write(f"{path}/words", b, n1=values[0], n2=values[1], n3=values[2], ends=values[3])
        return pa.table({"pairs": [False], "n": [[*_freqs(values[3]), int((values[3] > 2).sum())]]})

    kinds = "bucket long, kind long, id binary, v0 binary, v1 binary, v2 binary"
    pairs = _counted(texts, buckets, pairs_of).groupBy("bucket").applyInArrow(write_pairs, kinds)
    made = pairs.groupBy("bucket").applyInArrow(write_rest, "pairs boolean, n array<long>")
    sums = made.groupBy("pairs").agg(*[F.sum(F.get("n", F.lit(k))).alias(f"n{k}") for k in range(5)]).collect()  # two rows
    of_pairs, of_words = ([next((r[f"n{k}"] for r in sums if r.pairs == p), 0) for k in range(5)] for p in (True, False))
    d2, d1, total = discounts(of_pairs[:4]), discounts(of_words[:4]), of_pairs[4]
    gamma = (d1[0] * of_words[0] + d1[1] * of_words[1] + d1[2] * of_words[4]) / total
    return Model(path, buckets, stride, first.tokens, first.distinct, d2, d1, total, gamma)


def score_texts(model: Model, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Per text: tokens, known tokens, base score and log10 probability."""
    tokens, counts = token_runs(texts)
    kinds, of = np.unique(np.append(tokens, START), return_inverse=True)
    word = arrays.gather(f"{model.path}/words", model.buckets, kinds, n=np.int64(0), n1=np.int64(0), n2=np.int64(0), n3=np.int64(0), ends=np.int64(0)) if model.pairs else {k: np.zeros(len(kinds), np.int64) for k in ("n", "n1", "n2", "n3", "ends")}
    number = model.numbers(kinds) if model.pairs else np.full(len(kinds), -1)
    base = np.log10((word["n"] + 0.1) / (model.tokens + 0.1 * (model.distinct + 1)))
    ends = word["ends"]
    p1 = (np.maximum(ends - discount_of(ends, model.word_discounts), 0) / model.pairs + model.word_gamma / (model.distinct + 1)) if model.pairs else np.full(len(kinds), 1.0 / (model.distinct + 1))
    w, u = of[:-1], _before(of[:-1], counts, of[-1])
    c = np.zeros(len(w), dtype=np.int64)
    known = (number[w] >= 0) & (number[u] >= 0)
    if known.any():
        key, back = np.unique(pair_key(number[u[known]], number[w[known]]), return_inverse=True)
        c[known] = arrays.gather(f"{model.path}/pairs", model.buckets, key, n=np.int64(0))["n"][back]
    d, seen = model.pair_discounts, word["n"][u]
    gamma = (d[0] * word["n1"] + d[1] * word["n2"] + d[2] * word["n3"])[u]
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(seen > 0, np.maximum(c - discount_of(c, d), 0) / seen + gamma / seen * p1[w], p1[w])
    at = np.cumsum(counts) - counts
    return counts, np.add.reduceat((word["n"][w] > 0).astype(np.int64), at), np.add.reduceat(base[w], at), np.add.reduceat(np.log10(p), at)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns keep of docs and n_tokens, n_known, base_score and score of `text` (null: as an empty text)."""
    names = ["n_tokens", "n_known", "base_score", "score"]
    schema = docs.select(*keep).schema
    for n, kind in zip(names, ("long", "long", "double", "double")):
        schema = schema.add(n, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("__text"))
            parts = [score_texts(model, texts[i:j]) for i, j in slices(texts)]
            made = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, t) for t in (np.int64, np.int64, float, float)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, made)], names=[*keep, *names])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def range_count(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> int:
    return max(8, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // range_bytes))


def held_out(doc_id: Column) -> Column:
    """One document in ten, by the CRC32 of its id; a null id counts as an empty text, whose remainder is 0."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 10 == 0


def op4_kneser_ney_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under the model of those that aren't held out.

    A null text is scored as an empty one (one token, the end).  Rows that repeat an id count and are scored
    each.  With no training rows every token has probability 1 (one unknown word).  Empty table: no rows.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    model = train(docs.where(~F.col("held_out")).select("text"), range_count(docs))
    return score(docs, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
