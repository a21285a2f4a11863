"""SimHash near-duplicates by BK-trees (operator 5).

Texts get 64-bit fingerprints of their word shingles.  Fingerprints within `radius` differing bits are linked, and a
group is a connected component.

The search splits the bits into radius + 2 blocks: two fingerprints within the radius agree on at least two blocks.  So each
distinct fingerprint goes to one shard for every pair of blocks (the pair's bits name the shard), and each shard holds a
BK-tree: children are keyed by their integer Hamming distance to the parent, and a search follows only edges within the
radius of its own distance.  Shard trees are dealt to tasks by a shuffle: their total has no bound, so nothing is broadcast.
A shard yields one link for each member of a group (to its smallest id), never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stash
from .components import connected_components
from .tokens import as_bytes

SHINGLE, RADIUS = 3, 2


def text_fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text: bit b is set if bit b is set in over half of the shingles' XXH64 (seed 42)."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, 42)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lens + 1) - 1
    starts, ends = (ends - lens)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    h = np.fromiter((xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends)), dtype=np.uint64, count=len(starts))
    n, ones = len(h), np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """The columns keep of docs and `fp`, the fingerprint of `text` (null: as an empty text, 0) as a signed long."""
    schema = docs.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([text_fingerprint(t, shingle) for t in as_bytes(b.column("__text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


class BKForest:
    """BK-trees over the members of many shards, built and searched level by level.

    shards: the shard of each value, in runs; values: distinct within a shard.  The first of a run is the root.
    """

    def __init__(self, shards: np.ndarray, values: np.ndarray):
        self.values = values
        first = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(shards) else np.zeros(0, dtype=np.int64)
        self.root = np.repeat(first, np.diff(np.r_[first, len(shards)]))
        item = np.flatnonzero(self.root != np.arange(len(values)))
        at, edges, kids = self.root[item], [], []
        while len(item):
            key = at * 65 + np.bitwise_count(values[item] ^ values[at])
            edge, who, of = np.unique(key, return_index=True, return_inverse=True)
            edges.append(edge)
            kids.append(item[who])  # the first that comes to an edge becomes its child, the others go on below it
            stay = np.ones(len(item), dtype=bool)
            stay[who] = False
            at, item = item[who][of][stay], item[stay]
        edges, kids = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (edges, kids))
        order = np.argsort(edges)
        self.edges, self.kids = edges[order], kids[order]

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, member) of places in the forest at most radius apart, of one shard."""
        q, node, found = queries, self.root[queries], []
        while len(q):
            d = np.bitwise_count(self.values[q] ^ self.values[node]).astype(np.int64)
            hit = d <= radius
            found.append((q[hit], node[hit]))
            low = np.searchsorted(self.edges, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.edges, node * 65 + np.minimum(d + radius, 64), side="right") - low
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q, node = np.repeat(q, n), self.kids[np.repeat(low, n) + step]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (queries[:0], queries[:0])


def link_groups(forest: BKForest, ids: np.ndarray, radius: int, block: int = 1 << 14) -> np.ndarray:
    """For each member the smallest id of its group: queries go through the forest in blocks, and groups merge as pairs come."""
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    place = np.argsort(rank)
    label = rank.copy()
    for i in range(0, len(ids), block):
        a, b = forest.within(np.arange(i, min(i + block, len(ids))), radius)
        while len(a) and (label[a] != label[b]).any():
            low, roots = np.minimum(label[a], label[b]), (place[label[a]], place[label[b]])
            for side in (a, b, *roots):
                np.minimum.at(label, side, low)
            label = label[place[label]]
    while True:
        up = label[place[label]]
        if (up == label).all():
            return ids[place[label]]
        label = up


def _shard_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * 3

        def done(shard, fp, rep):
            new = np.r_[True, shard[1:] != shard[:-1]]
            size = np.diff(np.r_[np.flatnonzero(new), len(shard)])
            keep = np.repeat(size > 1, size)
            shard, fp, rep = shard[keep], fp[keep], rep[keep]
            least = link_groups(BKForest(shard, fp.view(np.uint64)), rep, radius)
            off = least != rep
            return pa.RecordBatch.from_arrays([pa.array(rep[off]), pa.array(least[off])], names=["a", "b"])

        for batch in batches:
            got = [np.concatenate([r, batch.column(c).to_numpy(zero_copy_only=False)]) for r, c in zip(rest, ("shard", "fp", "rep"))]
            cut = int(np.searchsorted(got[0], got[0][-1])) if len(got[0]) else 0
            if cut:  # the last shard may go on in the next batch
                yield done(*(x[:cut] for x in got))
            rest = [x[cut:] for x in got]
        if len(rest[0]) > 1:
            yield done(*rest)

    return run


def block_cuts(radius: int, agree: int = 2) -> list[int]:
    """Bounds of radius + agree blocks of bits: two fingerprints within the radius have at least `agree` blocks in common."""
    blocks = radius + agree
    return [round(64 * i / blocks) for i in range(blocks + 1)]


def blocks_in_common(rows: int, radius: int) -> int:
    """2 or 3, whichever costs less: more common blocks mean more shards a fingerprint, but fewer strangers in a shard.

    Either finds all partners; large tables need the longer shard names.
    """
    cost = lambda agree: comb(radius + agree, agree) * (8 + rows / 2 ** (64 * agree / (radius + agree)))
    return min((2, 3), key=cost)


def shard_keys(fp: Column, radius: int, agree: int = 2) -> Column:
    """The shards of a fingerprint: one for each choice of `agree` of its blocks; the top byte numbers the choice."""
    cuts = block_cuts(radius, agree)
    keys = []
    for n, chosen in enumerate(combinations(range(radius + agree), agree)):
        key = F.lit(0).cast("long")
        for i in chosen:
            lo, hi = cuts[i], cuts[i + 1]
            key = F.shiftleft(key, hi - lo).bitwiseOR(F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)))
        keys.append(F.lit(n << 56).bitwiseOR(key))
    return F.array(*keys)


def fingerprint_components(fps: DataFrame, radius: int = RADIUS, name: str = "simhash") -> DataFrame:
    """(fp, rep, component): for each distinct fingerprint of fps (doc_id, fp) its smallest doc_id and that of its component."""
    reps = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), f"{name}_reps")
    keyed = reps.where("rep IS NOT NULL").select(F.explode(shard_keys(F.col("fp"), radius)).alias("shard"), "fp", "rep")
    links = keyed.repartition("shard").sortWithinPartitions("shard", "rep").mapInArrow(_shard_links(radius), "a long, b long")
    comp = connected_components(links, f"{name}_links")
    return reps.join(comp, F.col("rep") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "rep").alias("component"))


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document.

    Null and empty texts have fingerprint zero and are linked like others; a null doc_id never names a component (its own is
    that of its fingerprint, null if no row of that fingerprint has an id); repeated rows stay.  Empty table: no rows.
    """
    docs = read_table(spark, sf_dir, "documents")
    fps = stash(with_fingerprints(docs, ["doc_id"]), "simhash_fps")
    comp = fingerprint_components(fps).select(F.col("fp").alias("of"), "component")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return fps.join(comp, F.col("fp") == F.col("of")).select("doc_id", hexed.alias("fingerprint"), F.col("component").alias("component_id"))
