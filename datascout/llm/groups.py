"""Links within candidate groups: from (key, h) rows, where members of one key may be similar, to verified links (a, b).

* Keys become groups: sets of members.  Keys that hold the same members are one group, so that texts go to it once.
* A quarter of the groups is compared first; of the others only those follow whose members are not all connected by then.
* A group is compared in one task, pair by pair, but never a pair that its links connect already: a group of very many
  versions of one text costs one comparison a member.
* Keys of more than BLOCK members are split: each block of about so many is a group, and the key's smallest member goes to all
  blocks, which connects them where they hold versions of one text.  Then, for those keys whose members still lie in several
  components, all members outside the largest component go to all blocks.  So every pair of a key is compared or
  connected, as in an unsplit group, and no task holds a whole hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import bucket_of, runs
from .common import BROADCAST_ENTRIES, stash
from .components import connected_components
from .tokens import mix64

BLOCK = 1024
#: One group in so many is compared first.
FIRST_PART = 4
#: Keys of a range that is looked at in one group.
PACKED_ROWS = 1 << 20
#: Rows of keys that are looked at together; members of a group of BLOCK that are counted, to tell hot keys.
SPREAD_ROWS, COUNTED = 1_500_000, 64


def by_shard(columns: tuple[str, ...], work, out: tuple[str, ...]):
    """Runs work(columns of whole shards) over batches that are sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch.select(columns)])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            shard = t["shard"].to_numpy()
            cut = int(np.searchsorted(shard, shard[-1])) if len(shard) else 0
            if cut:
                yield from made(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and len(rest) > 1:
            yield from made(rest)

    def made(t: pa.Table) -> Iterator[pa.RecordBatch]:
        shard = t["shard"].to_numpy()
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        size = np.diff(np.r_[first, len(shard)])
        t = t.filter(pa.array(np.repeat(size > 1, size)))
        if len(t):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in work(t)], names=list(out))

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, h of each) of rows (h, prints), many rows at a time."""
    keys, ids, held = [], [], 0
    for batch in batches:
        column = batch.column("prints")
        own = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64)
        keys.append(own)
        ids.append(np.repeat(batch.column("h").to_numpy(), pc.binary_length(column).to_numpy() // 8))
        held += len(own)
        if held >= SPREAD_ROWS:
            yield np.concatenate(keys), np.concatenate(ids)
            keys, ids, held = [], [], 0
    if held:
        yield np.concatenate(keys), np.concatenate(ids)


def _among(key: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys are among some, which are sorted."""
    at = np.minimum(np.searchsorted(some, key), len(some) - 1)
    return some[at] == key


def spread(prints: DataFrame, only=None) -> DataFrame:
    """(key, h) for each 64-bit key in the binary `prints` of rows (h, prints); only: a broadcast array of the keys that are wanted, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, h in _chunks(batches):
            if only is not None:
                some = _among(key, only.value)
                key, h = key[some], h[some]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(h)], names=["key", "h"])

    return prints.select("h", "prints").mapInArrow(run, "key long, h long")


def crowded(prints: DataFrame) -> DataFrame:
    """(key, n, pivot): about how many of the rows (h, prints) have each key, over all parts of the table, and one of these h.

    Counted on a sample of the members, by their hash, that has COUNTED of a group of BLOCK on average: a key of BLOCK members or more is missed
    by none of its parts being small, and one of twice as many by no more than a chance of 10**-9.
    """
    rate = max(1, BLOCK // COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, h in _chunks(batches):
            order = np.argsort(key)
            key, h = key[order], h[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
            n = np.diff(np.r_[first, len(key)]) * rate
            least = np.minimum.reduceat(h, first) if len(key) else h
            yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(n), pa.array(least)], names=["key", "n", "pivot"])

    some = prints.where(F.pmod(F.xxhash64("h", F.lit("counted")), F.lit(rate)) == 0)
    return some.select("h", "prints").mapInArrow(run, "key long, n long, pivot long")


def _named(key: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shard, h) of the keys that several members have, each named by the hash of its set of members; keys are in runs."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    n = np.diff(np.r_[first, len(key)])
    key, h = (x[np.repeat(n > 1, n)] for x in (key, h))
    order = np.lexsort((h, key))
    key, h = key[order], h[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (h[1:] != h[:-1])] if len(key) else np.zeros(0, dtype=bool)
    key, h = key[new], h[new]  # parts of the rows may hold the same member
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    n = np.diff(np.r_[first, len(key)])
    of = mix64(np.add.reduceat(mix64(h.view(np.uint64)), first) + n.astype(np.uint64)).view(np.int64) if len(first) else first
    several = np.repeat(n > 1, n)
    return np.repeat(of, n)[several], h[several]


def _sets(keyed: DataFrame) -> DataFrame:
    """(shard, h): the members of each key of keyed (key, h) that has several, named by the hash of their set."""

    def work(t: pa.Table):
        return _named(t["shard"].to_numpy(), t["h"].to_numpy())

    rows = keyed.select(F.col("key").alias("shard"), "h").repartition("shard").sortWithinPartitions("shard", "h")
    return rows.mapInArrow(by_shard(("shard", "h"), work, ("shard", "h")), "shard long, h long")


def _packed_sets(prints: DataFrame, without=None) -> DataFrame:
    """The same for all keys of prints (h, prints): keys go to ranges of their hash as packed arrays, which cost far less than rows.

    Only for keys that aren't hot: a range of about PACKED_ROWS keys is one group.  without: a broadcast array of the hot ones, sorted.
    """
    ranges = max(1, (prints.agg(F.sum(F.octet_length("prints"))).first()[0] or 0) // 8 // PACKED_ROWS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, h in _chunks(batches):
            if without is not None:
                some = ~_among(key, without.value)
                key, h = key[some], h[some]
            key = mix64(key)  # even over all ranges
            order = np.argsort(key)
            key, h = key[order], h[order]
            at = list(runs(bucket_of(key, ranges)))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in at], pa.int64()), pa.array([key[x].tobytes() for _, x in at], pa.binary()), pa.array([h[x].tobytes() for _, x in at], pa.binary())], names=["bucket", "key", "h"])

    def gather(table: pa.Table) -> pa.Table:
        key, h = (np.frombuffer(b"".join(table[c].to_pylist()), dtype=kind) for c, kind in (("key", np.uint64), ("h", np.int64)))
        order = np.argsort(key)
        shard, h = _named(key[order], h[order])
        return pa.table({"shard": shard, "h": h})

    dealt = prints.select("h", "prints").mapInArrow(deal, "bucket long, key binary, h binary")
    return dealt.groupBy("bucket").applyInArrow(gather, "shard long, h long")


def join_pairs(h: np.ndarray, label: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray], guest: np.ndarray | None = None) -> tuple[list, list]:
    """Links of one group: near(i, others) tells which others are similar to member i; members of one label are connected already.

    guest: where there are guests, members are compared with these only.
    """
    if len(h) == 2 and (guest is None or not guest.any()):
        return ([h[0]], [h[1]]) if label[0] != label[1] and near(0, np.array([1]))[0] else ([], [])
    group, a, b = label.copy(), [], []
    guests = np.flatnonzero(guest) if guest is not None and guest.any() else None
    for i in range(len(h) - 1) if guests is None else np.flatnonzero(~guest).tolist():
        js = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1 if guests is None else guests[group[guests] != group[i]]
        if len(js):
            js = js[near(i, js)]
            for g in np.unique(group[js]).tolist():
                group[group == g] = group[i]
            a += [h[i]] * len(js)
            b += h[js].tolist()
    return a, b


def verified(members: DataFrame, texts: DataFrame, near_of: Callable[[list], Callable[[int, np.ndarray], np.ndarray]]) -> DataFrame:
    """(a, b): links of members (shard, h, c, guest) by texts (h, payload).  near_of(payloads of a group), guest: see join_pairs(); c: component known, or null."""

    def work(t: pa.Table):
        shard, h = t["shard"].to_numpy(), t["h"].to_numpy()
        label = np.where(t["c"].is_null().to_numpy(), h, t["c"].fill_null(0).to_numpy())
        guest, payload = t["guest"].to_numpy(), t["payload"].to_pylist()
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]).tolist()
        a, b = [], []
        for s, e in zip(first, [*first[1:], len(h)]):
            x, y = join_pairs(h[s:e], label[s:e], near_of(payload[s:e]), guest[s:e])
            a += x
            b += y
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)

    run = by_shard(("shard", "h", "c", "guest", "payload"), work, ("a", "b"))
    rows = members.join(texts.withColumnRenamed("h", "of"), F.col("h") == F.col("of")).drop("of")
    return rows.repartition("shard").sortWithinPartitions("shard", "h").mapInArrow(run, "a long, b long")


def group_links(prints: DataFrame, attach: Callable[[DataFrame], DataFrame], near_of, name: str, more: DataFrame | None = None) -> DataFrame:
    """(a, b): links that connect all similar members of a key.

    prints (h, prints): binary rows of 64-bit keys; more (key, h): other keys, if there are any.
    attach: (h, payload), a row each, for rows (h) of which each occurs once; called once, for all that have a partner.
    """
    counts = crowded(prints)
    if more is not None:
        counts = counts.unionByName(more.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("pivot")))
    many = counts.groupBy("key").agg(F.sum("n").alias("n"), F.min("pivot").alias("pivot")).where(F.col("n") > BLOCK)
    hot = stash(many.select(F.col("key").alias("hot"), F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"), "pivot"), f"{name}_hot")
    plain = (F.lit(None).cast("long").alias("c"), F.lit(False).alias("guest"))
    if not hot.count():
        sets = _packed_sets(prints) if more is None else _packed_sets(prints).unionByName(_sets(more))
        members, texts = _with_texts(sets.dropDuplicates(["shard", "h"]).select("shard", "h", *plain), attach, name)
        return _in_two_steps(members, texts, near_of, name)
    block = F.pmod(F.xxhash64("h"), F.col("blocks"))
    if hot.count() <= BROADCAST_ENTRIES:
        keys = np.sort(np.array([r.hot for r in hot.select("hot").collect()], dtype=np.int64).view(np.uint64))
        keys = prints.sparkSession.sparkContext.broadcast(keys)
        sets, keyed = _packed_sets(prints, keys), spread(prints, keys)
        if more is not None:
            more = more.join(F.broadcast(hot.select("hot", F.lit(True).alias("is_hot"))), F.col("key") == F.col("hot"), "left").select("key", "h", "is_hot")
            sets, keyed = sets.unionByName(_sets(more.where("is_hot IS NULL").select("key", "h"))), keyed.unionByName(more.where("is_hot").select("key", "h"))
        split = keyed.join(F.broadcast(hot), F.col("key") == F.col("hot"))
    else:
        keyed = spread(prints) if more is None else spread(prints).unionByName(more)
        split = keyed.join(hot, F.col("key") == F.col("hot"), "left")
        sets = _sets(split.where("blocks IS NULL"))
    own = split.where("blocks IS NOT NULL").select("key", block.alias("block"), "h", "blocks").distinct()
    own = stash(own, f"{name}_blocks")
    pivots = hot.select(F.col("hot").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("pivot").alias("h"))
    shard = F.xxhash64("key", "block").alias("shard")
    split_up = own.select(shard, "h").unionByName(pivots.select(shard, "h")).distinct()
    members, texts = _with_texts(sets.unionByName(split_up).dropDuplicates(["shard", "h"]).select("shard", "h", *plain), attach, name)
    links = stash(_in_two_steps(members, texts, near_of, name), f"{name}_links")
    return links.unionByName(_across(own, links, texts, near_of, name))


def _with_texts(members: DataFrame, attach, name: str) -> tuple[DataFrame, DataFrame]:
    """members, written, and the payloads (h, payload) of all of them."""
    members = stash(members, f"{name}_members")
    return members, stash(attach(members.select("h").distinct()), f"{name}_texts")


def _in_two_steps(members: DataFrame, texts: DataFrame, near_of, name: str) -> DataFrame:
    """Links of members (shard, h, c): first of a part of the groups, then of those that these links don't connect already.

    Texts that are alike share many groups, so most groups of the second step need no comparison, and no text.
    """
    early = F.pmod("shard", F.lit(FIRST_PART)) == 0
    links = stash(verified(members.where(early), texts, near_of), f"{name}_early")
    comp = connected_components(links, f"{name}_early_links").withColumnRenamed("node", "of")
    rest = members.where(~early).join(comp, F.col("h") == F.col("of"), "left").select("shard", "h", F.coalesce("component", "h").alias("c"), "guest")
    apart = rest.groupBy(F.col("shard").alias("s")).agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("s")
    late = stash(rest.join(apart, F.col("shard") == F.col("s"), "left_semi"), f"{name}_late")
    return links.unionByName(verified(late, texts, near_of))


def _across(own: DataFrame, links: DataFrame, texts: DataFrame, near_of, name: str) -> DataFrame:
    """Links between the components that the blocks of a hot key are left in; own (key, block, h, blocks).

    Members outside the largest one are guests in all blocks; there, a block's own members meet the guests only.
    """
    comp = connected_components(links, f"{name}_first").withColumnRenamed("node", "of")
    own = stash(own.join(comp, F.col("h") == F.col("of"), "left").select("key", "block", "h", "blocks", F.coalesce("component", "h").alias("c")), f"{name}_labelled")
    sizes = own.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("most"), F.count(F.lit(1)).alias("parts"))
    most = most.where("parts > 1").select(F.col("key").alias("k"), "most")
    left = own.join(most, F.col("key") == F.col("k")).drop("k")
    rest = left.where("c <> most").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "h", "c", F.lit(True).alias("guest"))
    every = left.select("key", "block", "h", "c", F.lit(False).alias("guest")).unionByName(rest)
    members = stash(every.select(F.xxhash64("key", "block", F.lit("across")).alias("shard"), "h", "c", "guest").distinct(), f"{name}_across")
    return verified(members, texts, near_of)
