"""Ranked lexical search over bit-sliced Bloom signatures (operator 11).

Index: every document's terms are set in a Bloom signature, once for each number of occurrences in LEVELS that they reach.  Documents of
similar size stand together in blocks, stored by slices: a row of bits for each signature position, a bit for each document of the block.

Search: the slices of a term, intersected, are the documents that may hold it, all that do among them.  The weights of an item's terms,
summed over these rows of bits, times what a term can add at the number of occurrences that may be there, give every document an upper
bound of its score.  The documents of the highest bounds are scored by their texts; the tenth of these scores is a level that
the result can't fall below.  All documents whose bounds reach it are then scored by their texts, so the ranking is exact.

A block is a bounded row, queries go in blocks of bounded size, and only ids of documents that the bounds don't exclude meet their texts.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, small_side, stash
from .language_model import slices
from .tokens import as_bytes, hash_words, mix64

#: Numbers of occurrences that a signature tells apart; positions of a key; positions of a signature for a key of its largest document, and at most.
LEVELS, HASHES, BITS, MOST_BITS = (1, 2, 3, 5, 9, 17), 3, 12, 1 << 22
#: Most documents, and about the most bytes, of a block.
BLOCK, BLOCK_BYTES = 1024, 1 << 20
#: (item, term) pairs in a block of queries, about; terms that are looked for by a broadcast set at most.
QUERY_TERMS, BROADCAST_TERMS = 20_000, 200_000
#: Results of an item; documents of the highest bounds that set its level.
TOP, SEEDS = 10, 20
#: Fixed values of the score: scale of weights and occurrences, and the share of a document's length in its damping, in hundredths.
WEIGHT_SCALE, TF_SCALE, LENGTH_SHARE = 1000, 1_000_000_000, 75
_U = np.uint64
#: A-Z to a-z; ASCII signs other than letters and digits to spaces.
_TERMS = bytes(ord(chr(x).lower()) if x < 128 and chr(x).isalnum() else x if x > 127 else 32 for x in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text, in order, with repeats."""
    return text.translate(_TERMS).split()


def _positions(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The positions of terms at a level, HASHES each, in signatures of `bits`."""
    key = mix64(hashes + _U(level * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    low, step = key & _U(0xFFFFFFFF), (key >> _U(32)) | _U(1)
    return ((low[:, None] + step[:, None] * np.arange(HASHES, dtype=_U)) % _U(bits)).astype(np.int64)


def _width(size: int) -> int:
    """Class of a document with `size` keys: signatures of a class are BITS << class wide."""
    return max(4, (size - 1).bit_length())


def _block(width: int, held: list[tuple[int | None, int, list[np.ndarray]]]) -> dict:
    bits = min(BITS << width, MOST_BITS)
    on = np.zeros((bits, -(-len(held) // 8) * 8), dtype=np.uint8)
    for d, (_, _, levels) in enumerate(held):
        for j, hashes in enumerate(levels):
            on[_positions(hashes, j, bits), d] = 1
    return {"doc_ids": [x[0] for x in held], "lengths": [x[1] for x in held], "bits": bits, "slices": np.packbits(on, axis=1).tobytes()}


_BLOCKS = pa.schema([("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("bits", pa.int32()), ("slices", pa.binary())])


def build_index(docs: DataFrame) -> DataFrame:
    """Blocks (doc_ids, lengths, bits, slices) of all documents that have a term, written to the shared folder.

    lengths: terms with repeats.  Each task builds blocks of its own documents; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for i, j in slices(texts):
                hashes, counts = hash_words([t.translate(_TERMS) for t in texts[i:j]])
                for doc_id, end, n in zip(ids[i:j], np.cumsum(counts).tolist(), counts.tolist()):
                    if not n:
                        continue
                    terms, tf = np.unique(hashes[end - n : end], return_counts=True)
                    levels = [terms[tf >= least] for least in LEVELS]
                    width = _width(sum(map(len, levels)))
                    rows = held.setdefault(width, [])
                    rows.append((doc_id, n, levels))
                    if len(rows) >= max(8, min(BLOCK, 8 * BLOCK_BYTES // (BITS << width) // 8 * 8)):
                        yield pa.RecordBatch.from_pylist([_block(width, held.pop(width))], _BLOCKS)
        for width, rows in held.items():
            yield pa.RecordBatch.from_pylist([_block(width, rows)], _BLOCKS)

    return stash(docs.select("doc_id", "text").mapInArrow(run, "doc_ids array<long>, lengths array<long>, bits int, slices binary"), "signatures")


def document_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df) of terms (term) that occur: the documents that hold each, over all documents."""
    few = terms.count() <= BROADCAST_TERMS
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(r.term.encode() for r in terms.collect())) if few else None

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([t.decode() for t in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                found = set(terms_of(text))
                counts.update(found & wanted.value if wanted else found)
                if len(counts) > BROADCAST_TERMS:
                    yield rows(counts)
                    counts.clear()
        yield rows(counts)

    every = docs.select("text").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return every if few else every.join(terms.distinct(), "term", "left_semi")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of items (item_id, text); rows that repeat an item_id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                own = Counter(terms_of(text))
                yield pa.RecordBatch.from_arrays([pa.array([item_id] * len(own), pa.int64()), pa.array([t.decode() for t in own], pa.string()), pa.array(list(own.values()), pa.int64())], names=["item_id", "term", "times"])

    rows = items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, term string, times long")
    return rows.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


class Queries:
    """A block of items: their terms that occur in documents, and weights times repeats; with what the score needs of the corpus."""

    def __init__(self, rows: list, n_docs: int, n_terms: int):
        """rows: (item_id, term, times, df), df null where no document holds the term."""
        self.n_docs, self.n_terms = n_docs, n_terms
        self.item_ids = sorted({r.item_id for r in rows}, key=lambda x: (x is None, x))
        number = {x: i for i, x in enumerate(self.item_ids)}
        self.terms = sorted({r.term.encode() for r in rows if r.df})
        place = {t: i for i, t in enumerate(self.terms)}
        self.own: list[list[tuple[int, int]]] = [[] for _ in self.item_ids]
        for r in rows:
            if r.df:
                weight = math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
                self.own[number[r.item_id]].append((place[r.term.encode()], weight * r.times))
        self.hashes = hash_words([b" ".join(self.terms)])[0]
        self.level = [1] * len(self.item_ids)

    def damping(self, length: int) -> int:
        return 100 - LENGTH_SHARE + (LENGTH_SHARE * length * self.n_docs) // self.n_terms

    def bounds(self, lengths: np.ndarray, bits: int, block: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """(item, upper bounds of the scores of a block's documents), for the items that have a document with a bound above 0."""
        rows = np.frombuffer(block, dtype=np.uint8).reshape(bits, -1)
        distinct, which = np.unique(lengths, return_inverse=True)
        damp = np.array([8 * self.damping(n) for n in distinct.tolist()], dtype=np.int64)[which]
        most = np.zeros(len(lengths), dtype=np.int64)
        active, may = np.arange(len(self.terms)), np.full((len(self.terms), rows.shape[1]), 255, dtype=np.uint8)
        found = []
        for j in range(len(LEVELS)):
            at = _positions(self.hashes[active], j, bits)
            for k in range(HASHES):
                may = may & rows[at[:, k]]
            some = may.any(axis=1)
            active, may = active[some], may[some]
            if not len(active):
                break
            place = np.full(len(self.terms), -1)
            place[active] = np.arange(len(active))
            tf = np.minimum(lengths, LEVELS[j + 1] - 1) if j + 1 < len(LEVELS) else lengths
            reached = (TF_SCALE * tf) // (1000 * tf + damp)
            found.append((place, np.unpackbits(may, axis=1, count=len(lengths)), reached - most))
            most = reached
        for item, own in enumerate(self.arrays()):
            total = None
            for place, on, more in found:
                at = place[own[0]]
                if not (at >= 0).any():
                    break
                summed = (own[1][at >= 0] @ on[at[at >= 0]]).astype(np.int64) * more
                total = summed if total is None else total + summed
            if total is not None:
                yield item, total

    def arrays(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each item, the places of its terms and their weights."""
        if not hasattr(self, "_arrays"):
            self._arrays = [(np.array([t for t, _ in own], dtype=np.int64), np.array([w for _, w in own], dtype=float)) for own in self.own]
        return self._arrays

    def score(self, item: int, counts: Counter, length: int) -> int:
        damp, total = 8 * self.damping(length), 0
        for term, weight in self.own[item]:
            tf = counts.get(self.terms[term])
            if tf:
                total += weight * ((TF_SCALE * tf) // (1000 * tf + damp))
        return total


def _largest(best: dict[int, list], item: int, key: tuple, most: int) -> None:
    held = best.setdefault(item, [])
    if len(held) < most:
        heapq.heappush(held, key)
    elif key > held[0]:
        heapq.heapreplace(held, key)


def _key(score: int, doc_id: int | None) -> tuple:
    """Orders by score, then the smaller id; no id comes last."""
    return score, doc_id is not None, -(doc_id or 0)


def _rows(items: list[int], ids: list[int | None], scores: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])


def _held(best: dict[int, list]) -> pa.RecordBatch:
    found = [(item, -neg if known else None, score) for item, held in best.items() for score, known, neg in held]
    return _rows([x[0] for x in found], [x[1] for x in found], [x[2] for x in found])


_SCORED = "item int, doc_id long, score long"


def _first(rows: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= most)


def _seeds(index: DataFrame, queries) -> DataFrame:
    """(item, doc_id): the SEEDS documents of the highest bounds of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for ids, lengths, bits, block in _blocks(batches):
            for item, bound in queries.value.bounds(lengths, bits, block):
                for d in np.argsort(-bound, kind="stable")[:SEEDS].tolist():
                    if bound[d] <= 0:
                        break
                    _largest(best, item, _key(int(bound[d]), ids[d]), SEEDS)
        yield _held(best)

    return _first(index.mapInArrow(run, _SCORED), SEEDS).select("item", "doc_id")


def _candidates(index: DataFrame, queries) -> DataFrame:
    """(item, doc_id): all documents whose bounds reach their item's level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        for ids, lengths, bits, block in _blocks(batches):
            items, docs = [], []
            for item, bound in q.bounds(lengths, bits, block):
                at = np.flatnonzero(bound >= q.level[item]).tolist()
                items.extend([item] * len(at))
                docs.extend([ids[d] for d in at])
            yield _rows(items, docs, [0] * len(items))

    return index.mapInArrow(run, _SCORED).select("item", "doc_id")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, int, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, lengths, bits, block = (batch.column(c)[i].as_py() for c in range(4))
            yield ids, np.array(lengths, dtype=np.int64), bits, block


def _scored(docs: DataFrame, pairs: DataFrame, queries, name: str) -> DataFrame:
    """(item, doc_id, score): the TOP exact scores above 0 of each item in each task, over the documents of pairs (item, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        q = queries.value
        for batch in batches:
            for doc_id, text, items in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                terms = terms_of(text)
                counts = Counter(terms)
                for item in items:
                    score = q.score(item, counts, len(terms))
                    if score > 0:
                        _largest(best, item, _key(score, doc_id), TOP)
        yield _held(best)

    # an id has as many items at most as the block of queries
    sought = stash(pairs.groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("item").alias("items")), name)
    texts = docs.select("doc_id", "text").join(small_side(sought, "items"), F.col("doc_id").eqNullSafe(F.col("of")))
    return texts.select("doc_id", "text", "items").mapInArrow(run, _SCORED)


def search(docs: DataFrame, items: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the TOP documents of the highest scores above 0; equal scores by ascending doc_id.

    docs: (doc_id, text), items: (item_id, text), other columns don't matter; index: of build_index(docs).  A null or empty text has no terms: such
    documents are in no result and such items have none.  Rows that repeat a doc_id are documents each, those without come last among
    equal scores; rows that repeat an item_id are one item.  No document has a term: no rows.
    """
    spark = docs.sparkSession
    index = build_index(docs) if index is None else index
    n_docs, n_terms = index.agg(F.sum(F.size("lengths")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    result = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not n_docs:
        return result
    own = stash(item_terms(items), "item_terms")
    blocks = max(1, -(-own.count() // QUERY_TERMS))
    own = own.join(document_frequencies(docs, own.select("term").distinct()), "term", "left")
    own = stash(own.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), "weighted_terms")
    for block in range(blocks):
        rows = own.where(F.col("block") == block).collect()  # QUERY_TERMS rows, about
        if not rows:
            continue
        q = Queries(rows, n_docs, n_terms)
        first = _scored(docs, _seeds(index, spark.sparkContext.broadcast(q)), spark.sparkContext.broadcast(q), "seeds")
        for r in _first(first, TOP).where(F.col("rank") == TOP).collect():  # a row an item of the block
            q.level[r["item"]] = r["score"]
        held = spark.sparkContext.broadcast(q)
        best = _first(_scored(docs, _candidates(index, held), held, "candidates"), TOP)
        names = spark.createDataFrame(list(enumerate(q.item_ids)), "number int, item_id long")
        best = best.join(F.broadcast(names), F.col("item") == F.col("number"))
        result = result.unionByName(best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return result


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search() of all documents for all benchmark items."""
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS_SQL = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS_SQL} AS terms FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS terms FROM d WHERE len(terms) > 0),
p AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor({WEIGHT_SCALE} * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, docs),
r AS (
  SELECT item_id, rid, doc_id, sum(times * w * (({TF_SCALE} * tf) // (1000 * tf + 8 * ({100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * docs) // s.terms))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, rid, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= {TOP}"""
