"""One document of each group of near-duplicates, by SimHash (operator 5) with an exact check.

Candidates come from two kinds of SimHash.  That of all distinct words: texts within RADIUS bits, found by BK-tree shards.  It
misses about half of the texts that have a tenth of new words, so there are also block fingerprints of the five-word shingles (see
blocks.py): texts of a Jaccard similarity of 0.8 agree on one of BLOCKS blocks in 99.7 % of cases.  A pair is linked if the Jaccard
similarity of its sets of shingles is at least SIMILARITY; groups are connected components.  Texts go to a candidate group only if
they have a partner there, hot groups are split (see groups.py), and a group yields one link a text, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import block_prints
from .common import column, stash
from .components import connected_components
from .groups import by_shard, group_links
from .language_model import slices
from .simhash import BKForest, blocks_in_common, link_groups, shard_keys
from .tokens import as_bytes, hash_words, inside, mix64, windows

RADIUS, SHINGLE, SIMILARITY, BLOCKS = 6, 5, 0.8, 8


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return hash_words([t.lower() for t in texts])


def _bags(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out, ends = np.zeros(len(counts), dtype=np.uint64), np.cumsum(counts).tolist()
    for i, (s, e) in enumerate(zip([0, *ends], ends)):
        own = np.unique(h[s:e])
        if len(own):
            ones = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > len(own), bitorder="little").view(np.uint64)[0]
    return out


def bag_fingerprints(texts: list[bytes]) -> np.ndarray:
    """SimHash of the distinct words of each text (A-Z lower-cased); without words: 0."""
    return _bags(*_hashed(texts))


def _keys(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    place = np.arange(len(h), dtype=np.uint64) - np.repeat((np.cumsum(counts) - counts).astype(np.uint64), counts)
    np.cumsum(mix64(h + place * np.uint64(0x9E3779B97F4A7C15)), out=sums[1:])
    ends = np.cumsum(counts)
    return mix64(sums[ends] - sums[ends - counts] + counts.astype(np.uint64))


def text_keys(texts: list[bytes]) -> np.ndarray:
    """64-bit hash of the word sequence of each text (A-Z lower-cased): texts of the same words are copies."""
    return _keys(*_hashed(texts))


def _prints(h: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """Blocks of each text of SHINGLE words and more; shorter ones are like none but their copies."""
    out: list[bytes | None] = [None] * len(counts)
    n = np.maximum(counts - SHINGLE + 1, 0)
    some = np.flatnonzero(n)
    if len(some):
        own = windows(h, SHINGLE)[inside(counts, SHINGLE)]
        for i, x in zip(some.tolist(), block_prints(own, (np.cumsum(n) - n)[some], BLOCKS)):
            out[i] = x.tobytes()
    return out


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; of a shorter text the whole sequence."""
    h, _ = _hashed([text])
    return np.unique(windows(h, SHINGLE) if len(h) >= SHINGLE else windows(h, len(h)) if len(h) else h)


def similar_to(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the other sets have a Jaccard similarity of at least SIMILARITY to one; all are sorted and not empty."""
    ends = np.cumsum([len(x) for x in others])
    every = np.concatenate(others)
    place = np.minimum(np.searchsorted(one, every), len(one) - 1)
    both = np.add.reduceat((one[place] == every).astype(np.int64), np.r_[0, ends[:-1]])
    return both / (len(one) + np.diff(ends, prepend=0) - both) >= SIMILARITY


def near_texts(texts: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
    sets: dict[int, np.ndarray] = {}

    def of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingles(texts[i])
        return sets[i]

    def near(i: int, js: np.ndarray) -> np.ndarray:
        n = len(of(i))
        hit = np.array([0 < SIMILARITY * max(len(of(j)), n) <= min(len(of(j)), n) for j in js.tolist()], dtype=bool)
        if hit.any():
            hit[hit] = similar_to(of(i), [of(j) for j in js[hit].tolist()])
        return hit

    return near


def _scan(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp, prints) of docs; prints only where a part of the table holds a text first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            texts = as_bytes(b.column("text"))
            h, fp, prints = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], []
            for i, j in slices(texts):
                words, counts = _hashed(texts[i:j])
                h.append(_keys(words, counts))
                fp.append(_bags(words, counts))
                prints += _prints(words, counts)
            h, fp = (np.concatenate(x).view(np.int64) for x in (h, fp))
            for k, x in enumerate(h.tolist()):
                if x in seen:
                    prints[k] = None
                seen.add(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(h), pa.array(fp), pa.array(prints, pa.binary())], names=["doc_id", "h", "fp", "prints"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, h long, fp long, prints binary")


def bag_groups(reps: DataFrame, agree: int) -> DataFrame:
    """(key, h): texts (h, fp) that a BK-tree shard connects by distances within RADIUS; key: the hash of the set."""

    def work(t: pa.Table):
        shard, fp, h = t["shard"].to_numpy(), t["fp"].to_numpy().view(np.uint64), t["h"].to_numpy()
        new = np.r_[True, (shard[1:] != shard[:-1]) | (fp[1:] != fp[:-1])]  # equal fingerprints share one place in the tree
        first = np.flatnonzero(new)
        group = link_groups(BKForest(shard[first], fp[first]), np.arange(len(first)), RADIUS)[np.cumsum(new) - 1]
        order = np.lexsort((h, group))
        group, h = group[order], h[order]
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        n = np.diff(np.r_[start, len(h)])
        key = mix64(np.add.reduceat(mix64(h.view(np.uint64)), start) + n.astype(np.uint64)).view(np.int64)
        several = np.repeat(n > 1, n)
        return np.repeat(key, n)[several], h[several]

    keyed = reps.select(F.explode(shard_keys(F.col("fp"), RADIUS, agree)).alias("shard"), "fp", "h")
    run = by_shard(("shard", "fp", "h"), work, ("key", "h"))
    return keyed.repartition("shard").sortWithinPartitions("shard", "fp", "h").mapInArrow(run, "key long, h long").dropDuplicates(["key", "h"])


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that come first (smallest doc_id) in their group; texts of the same words are in one group.

    Null and empty texts have no shingle; they are one group.  A null doc_id comes last.  Of rows that repeat an id and the words
    of its text one stays.  Columns are those of docs, whatever their names.
    """
    rows = stash(_scan(docs), "near_rows")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id").alias("first")
    reps = stash(rows.groupBy("h").agg(F.min(order).alias("first"), F.first("fp").alias("fp")), "near_reps")
    agree = blocks_in_common(reps.count(), RADIUS)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = as_bytes(b.column("text"))
            keys = np.concatenate([text_keys(own[i:j]) for i, j in slices(own)]).view(np.int64).tolist() if own else []
            out = [(key, text) for text, key, want in zip(own, keys, b.column("want").to_pylist()) if key in want]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([t for _, t in out], pa.large_binary())], names=["h", "payload"])

    def attach(members: DataFrame) -> DataFrame:
        own = members.join(reps.select(F.col("h").alias("k"), "first"), F.col("h") == F.col("k"))
        want = own.groupBy(F.col("first.doc_id").alias("of")).agg(F.collect_list("h").alias("want"))
        near = docs.select("doc_id", "text").join(want, F.col("doc_id").eqNullSafe(F.col("of")))
        return near.select("text", "want").mapInArrow(texts, "h long, payload binary").dropDuplicates(["h"])

    prints = rows.where("prints IS NOT NULL").select("h", "prints")
    bags = stash(bag_groups(reps.select("h", "fp"), agree), "near_bags")
    links = group_links(prints, attach, near_texts, "near", bags)
    comp = connected_components(links, "near_links").withColumnRenamed("node", "k")
    groups = reps.join(comp, F.col("h") == F.col("k"), "left").select("h", "first", F.coalesce("component", "h").alias("c"))
    least = groups.groupBy("c").agg(F.min(F.struct("first", "h")).alias("keep"))
    keep = stash(least.select(F.col("keep.first.doc_id").alias("of"), F.col("keep.h").alias("kept_h")), "near_keep")
    return _only(docs, keep)


def _only(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows of docs whose id and word sequence are in keep (of, kept_h), one for each."""
    at = {n: f"c{i}" for i, n in enumerate(docs.columns)}
    packed = docs.select(*[column(n).alias(c) for n, c in at.items()])
    text = at["text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = as_bytes(b.column(text))
            keys = np.concatenate([text_keys(own[i:j]) for i, j in slices(own)]).view(np.int64) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys)], names=[*b.schema.names, "own_h"])

    keyed = packed.mapInArrow(run, T.StructType([*packed.schema, T.StructField("own_h", T.LongType())]))
    both = keyed.join(keep, F.col(at["doc_id"]).eqNullSafe(F.col("of")) & (F.col("own_h") == F.col("kept_h")), "left_semi")
    return both.dropDuplicates([at["doc_id"], "own_h"]).select(*[F.col(c).alias(n) for n, c in at.items()])
