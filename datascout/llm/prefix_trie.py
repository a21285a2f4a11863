"""Conversation prefix trie by vertical bitmaps (operator 13).

Conversations are dealt by ranges of their ids and cut into shards of bounded size.  In a shard every (position, turn) has a bitset of the
conversations that hold it there.  A depth-first walk intersects a node's bitset with the postings of the next position: the
intersections are its children, their popcounts the members, and what no child takes is the list of conversations that end there.  A bitset
of one conversation needs no more intersections: its branch is the rest of that conversation.  A node is known by a hash of its path,
so the shards' nodes add up to the trie's, and a first turn that most conversations share is a row a shard, not a group of rows.

What a subtree holds adds up by conversations: each node is owned by its smallest member, which leaves an unbroken run of depths to
each conversation.  A subtree has as many leaves as members that own one, and saves what its members say before the depth where they
begin to own.  A second walk, told the owned depth of each conversation, counts both with bitsets; so no job goes level by level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stash
from .tokens import mix64

#: Most conversations of a shard, and turns (unless one conversation has more); ids in one row of an end list.
SHARD, SHARD_TURNS, ENDS = 4096, 200_000, 256
#: Conversations lend their first turns to the LENT - 1 after them; a prefix has PREFIX - 1 turns at most.
LENT, PREFIX = 5, 9
NO_IDS = hashlib.sha256(b"").hexdigest()
_U = np.uint64
_NODES = "path binary, parent binary, depth int, conv_id long, n long, ends array<long>"
_SUMS = "path binary, leaves long, saved long"


def turn_key(role: Column, text: Column) -> Column:
    """16 bytes that name a turn; a null role or text counts as empty."""
    none = F.lit("")
    return F.unhex(F.md5(F.concat(F.md5(F.coalesce(role, none)), F.coalesce(text, none))))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, turn_key, bytes): turns numbered from 1 by turn, null first; ties by role and text.

    Rows without a conv_id belong to no conversation.  Texts stay where they were read.
    """
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", turn_key(F.col("role"), F.col("text")).alias("turn_key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "turn_key")
    return rows.select("conv_id", F.row_number().over(order).alias("at"), "turn_key", "bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Turns of ordered_turns() with each conversation's first turns taken from conversation c - c % 5, and a row at 0 for each conversation."""
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    lender = F.col("conv_id") - F.col("conv_id") % LENT
    h = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % PREFIX
    lent = convs.where(F.col("conv_id") % LENT == 0).select(F.col("conv_id").alias("of"), F.col("n").alias("lent"))
    plan = convs.select(F.col("conv_id").alias("c"), lender.alias("lender"), h.alias("h")).join(lent, F.col("lender") == F.col("of"), "left")
    plan = stash(plan.select("c", "lender", "h", F.least("h", F.coalesce("lent", F.lit(0))).alias("taken")), "plan")
    from_lender = turns.where((F.col("conv_id") % LENT == 0) & (F.col("at") < PREFIX)).join(plan, (F.col("conv_id") == F.col("lender")) & (F.col("at") <= F.col("h")))
    own = turns.join(plan, (F.col("conv_id") == F.col("c")) & (F.col("at") > F.col("h")))
    top = plan.select(F.col("c").alias("conv_id"), F.lit(0).alias("at"), F.lit(None).cast("binary").alias("turn_key"), F.lit(0).cast("long").alias("bytes"))
    from_lender = from_lender.select(F.col("c").alias("conv_id"), "at", "turn_key", "bytes")
    own = own.select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).cast("int").alias("at"), "turn_key", "bytes")
    return top.unionByName(from_lender).unionByName(own)


def _places(bits: int) -> np.ndarray:
    """The places of the bits that are set."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), dtype=np.uint8), bitorder="little"))


def _bitset(places: np.ndarray) -> int:
    on = np.zeros(int(places.max(initial=-1)) + 1, dtype=np.uint8)
    on[places] = 1
    return int.from_bytes(np.packbits(on, bitorder="little").tobytes(), "little")


class Shard:
    """The trie of some conversations: rows (conv_id, at, turn_key, bytes, owned, leaf) of them, by conv_id and at."""

    def __init__(self, table: pa.Table):
        ids, at = table["conv_id"].to_numpy(), table["at"].to_numpy()
        marks, tops, turns = at < 0, at == 0, at > 0
        self.ids = ids[tops]
        self.at = at[turns]
        conv = np.searchsorted(self.ids, ids[turns])
        self.conv, self.bytes = conv, table["bytes"].to_numpy()[turns]
        self.length = np.bincount(conv, minlength=len(self.ids))
        self.end = np.cumsum(self.length)
        self.start = self.end - self.length
        keys = np.frombuffer(b"".join(x for x in table["turn_key"].to_pylist() if x is not None), dtype="<u8").reshape(-1, 2).astype(_U)
        self.paths = np.empty_like(keys)
        for half in (0, 1):
            mixed = mix64(keys[:, half] ^ mix64(self.at.astype(_U) + _U(half << 32)))
            runs = np.r_[_U(0), np.bitwise_xor.accumulate(mixed)] if len(mixed) else np.zeros(1, dtype=_U)
            self.paths[:, half] = runs[1:] ^ runs[self.start[conv]]
        self._post(keys)
        self.owned, self.leaf = self.length + 1, np.zeros(len(self.ids), dtype=bool)  # by default a conversation owns nothing
        if marks.any():
            k = np.searchsorted(self.ids, ids[marks])
            self.owned[k] = table["owned"].filter(pa.array(marks)).to_numpy()
            self.leaf[k] = table["leaf"].filter(pa.array(marks)).to_numpy(zero_copy_only=False)

    def _post(self, keys: np.ndarray) -> None:
        """posting: of each turn, the number of its (position, turn); bits: the bitsets of those that more than one conversation holds."""
        order = np.lexsort((keys[:, 1], keys[:, 0], self.at))
        k, at = keys[order], self.at[order]
        new = np.r_[True, (at[1:] != at[:-1]) | (k[1:] != k[:-1]).any(axis=1)] if len(at) else np.zeros(0, dtype=bool)
        number = np.cumsum(new) - 1
        self.posting = np.empty(len(at), dtype=np.int64)
        self.posting[order] = number
        first = np.flatnonzero(new)
        sizes = np.diff(np.r_[first, len(at)])
        convs = self.conv[order]
        self.bits = {int(i): _bitset(convs[first[i] : first[i] + sizes[i]]) for i in np.flatnonzero(sizes > 1)}

    def walk(self) -> None:
        """Lists of the nodes, parents first: row (turn of the smallest member; -1: root), depth, parent, member, n, leaves, unowned; and ends."""
        n = len(self.ids)
        start, end, posting, bits = self.start.tolist(), self.end.tolist(), self.posting.tolist(), self.bits
        leaf = _bitset(np.flatnonzero(self.leaf))
        ending = {int(d): _bitset(np.flatnonzero(self.length == d)) for d in np.unique(self.length)}
        unowned: dict[int, int] = {}
        self.row, self.depth, self.parent, self.member, self.n, self.leaves, self.unowned = [], [], [], [], [], [], []
        self.ends: list[tuple[int, np.ndarray]] = []
        stack = [((1 << n) - 1, 0, -1)] if n else []
        while stack:
            members, depth, parent = stack.pop()
            least = (members & -members).bit_length() - 1
            node = len(self.row)
            if members & (members - 1) == 0:  # one conversation: the rest of it
                first, last = start[least] + depth - 1, end[least]
                chain = range(first, last) if depth else [-1, *range(start[least], last)]
                m = len(chain)
                self.row.extend(chain)
                self.depth.extend(range(depth, depth + m))
                self.parent.extend([parent, *range(node, node + m - 1)])
                self.member.extend([least] * m)
                self.n.extend([1] * m)
                self.leaves.extend([int(self.leaf[least])] * m)
                owned = int(self.owned[least])
                self.unowned.extend([int(d < owned) for d in range(depth, depth + m)])
                self.ends.append((node + m - 1, np.array([least])))
                continue
            if depth not in unowned:
                unowned[depth] = _bitset(np.flatnonzero(self.owned > depth))
            self.row.append(start[least] + depth - 1 if depth else -1)
            self.depth.append(depth)
            self.parent.append(parent)
            self.member.append(least)
            self.n.append(members.bit_count())
            self.leaves.append((members & leaf).bit_count())
            self.unowned.append((members & unowned[depth]).bit_count())
            here = members & ending.get(depth, 0)
            if here:
                self.ends.append((node, _places(here)))
            rest = members & ~here
            while rest:
                k = (rest & -rest).bit_length() - 1
                child = rest & bits.get(posting[start[k] + depth], 1 << k)
                stack.append((child, depth + 1, node))
                rest ^= child

    def _path(self, nodes: np.ndarray) -> pa.Array:
        rows = np.array(self.row, dtype=np.int64)[nodes]
        paths = np.where((rows < 0)[:, None], _U(0), self.paths[rows] if len(self.paths) else _U(0)).astype("<u8")
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(np.ascontiguousarray(paths).tobytes())]).cast(pa.binary())

    def nodes(self) -> pa.Table:
        """Rows of _NODES: every node, and more rows (of no members) for what its list of ends has over ENDS ids."""
        parts: dict[int, list[np.ndarray]] = {i: [x[j : j + ENDS] for j in range(0, len(x), ENDS)] for i, x in self.ends}
        more = [(i, x) for i, xs in parts.items() for x in xs[1:]]
        at = np.r_[np.arange(len(self.row)), np.array([i for i, _ in more], dtype=np.int64)]
        whole = np.arange(len(at)) < len(self.row)
        parent = np.array(self.parent)[at]
        member, depth = np.array(self.member)[at], np.array(self.depth, dtype=np.int32)[at]
        ends = [self.ids[parts[i][0]] if i in parts else None for i in range(len(self.row))] + [self.ids[x] for _, x in more]
        n = np.where(whole, np.array(self.n)[at], 0)
        return pa.table({"path": self._path(at), "parent": self._path(np.maximum(parent, 0)), "depth": depth, "conv_id": self.ids[member], "n": n, "ends": pa.array(ends, pa.list_(pa.int64()))})

    def sums(self) -> pa.Table:
        """Rows of _SUMS: leaves below each node that members here own, and what members here save."""
        saved = np.array(self.unowned) * np.where(np.array(self.row) < 0, 0, self.bytes[self.row] if len(self.bytes) else 0)
        saved, parent = saved.tolist(), self.parent
        for i in range(len(saved) - 1, 0, -1):
            saved[parent[i]] += saved[i]
        return pa.table({"path": self._path(np.arange(len(saved))), "leaves": pa.array(self.leaves, pa.int64()), "saved": pa.array(saved, pa.int64())})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole conversations, SHARD at most and about SHARD_TURNS rows, from batches sorted by conv_id."""

    def shards(table: pa.Table) -> Iterator[pa.Table]:
        ids = table["conv_id"].to_numpy()
        first = np.r_[np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]), len(ids)]
        for i in range(0, len(first) - 1, SHARD):
            end = first[min(i + SHARD, len(first) - 1)]
            yield table.slice(first[i], end - first[i]).combine_chunks()

    held, rows, most = [], 0, SHARD_TURNS
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table["conv_id"].to_numpy()
            whole = int(np.searchsorted(ids, ids[-1]))  # the last conversation may go on
            if whole:
                yield from shards(table.slice(0, whole))
            held, rows = table.slice(whole).to_batches(), len(ids) - whole
            most = max(SHARD_TURNS, 2 * rows)
    if rows:
        yield from shards(pa.Table.from_batches(held).combine_chunks())


def _walked(rows: DataFrame, what: str) -> DataFrame:
    """nodes() or sums() of all shards of rows (conv_id, at, turn_key, bytes, owned, leaf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _cut(batches):
            shard = Shard(table)
            shard.walk()
            yield from (shard.nodes() if what == "nodes" else shard.sums()).combine_chunks().to_batches(max_chunksize=20_000)

    return rows.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(run, _NODES if what == "nodes" else _SUMS)


def _digests(ends: DataFrame) -> DataFrame:
    """(path, ends_sha256) of rows (path, ends): lists of ascending ids, of which one list is wholly before another.

    Rows stream through the hash in the order of their ids, so that the ends of one node may be more than memory holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, sha = None, None
        for batch in batches:
            done = []
            for p, ids in zip(batch.column("path").to_pylist(), batch.column("ends").to_pylist()):
                if p != path:
                    if sha:
                        done.append((path, sha.hexdigest()))
                    path, sha = p, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(",".join(map(str, ids)).encode())
            yield _named(done)
        if sha:
            yield _named([(path, sha.hexdigest())])

    rows = ends.select("path", "ends", F.get("ends", F.lit(0)).alias("first")).repartition("path").sortWithinPartitions("path", "first")
    return rows.mapInArrow(run, "path binary, ends_sha256 string")


def _named(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["path", "ends_sha256"])


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of turns (conv_id, at, turn_key, bytes): at counts from 1 without gaps, and each conversation has a row at 0.

    Columns: conv_id (the smallest member), depth, parent_conv_id (null: root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    No conversations: no rows, not even a root.  A shard holds the keys of its turns (40 bytes each), so one conversation of
    ten million turns takes 400 MB in its task.
    """
    turns = stash(turns.select("conv_id", "at", "turn_key", "bytes", F.lit(None).cast("int").alias("owned"), F.lit(None).cast("boolean").alias("leaf")), "turns")
    local = stash(_walked(turns, "nodes"), "local_nodes")
    nodes = local.groupBy("path").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"))
    nodes = stash(nodes, "nodes")
    kids = nodes.where("depth > 0").groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stash(nodes.join(kids, "path", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes_children")
    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("owned"), F.max(F.col("n_children") == 0).alias("leaf"))
    marks = owners.select("conv_id", F.lit(-1).alias("at"), F.lit(None).cast("binary").alias("turn_key"), F.lit(0).cast("long").alias("bytes"), "owned", "leaf")
    sums = _walked(turns.unionByName(marks), "sums").groupBy("path").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = _digests(local.where("ends IS NOT NULL"))
    above = nodes.where("n_children > 0").select(F.col("path").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    # the children of one node may be many: a plain join on the parent's side of unique keys, whose skew Spark splits
    with_parent = nodes.withColumn("parent", F.when(F.col("depth") > 0, F.col("parent"))).join(above, F.col("parent") == F.col("above"), "left")
    out = with_parent.join(sums, "path").join(ends, "path", "left")
    names = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return out.select(*names, F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trie() of all rebuilt conversations.

    A null role or text counts as empty; rows without a conv_id are left out; turns of equal number are ordered by role and text; rows that
    repeat count as turns each.  Conversations without turns after rebuilding end at the root.
    """
    turns = stash(ordered_turns(read_table(spark, sf_dir, "conversations")), "ordered_turns")
    return trie(rebuilt(turns))


#: The trie by prefixes as lists: grouped by prefix, and each node's ancestors by slices of its own.
OP13_SQL = f"""WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v FROM range(256) r(i))),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(md5(coalesce(role, '')) || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, n, conv_id - conv_id % {LENT} AS lender,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) % {PREFIX} AS h
  FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id), crc_table),
r AS (
  SELECT c.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = c.lender AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(d.n, 0)), role, text
  FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN c d ON d.conv_id = c.lender),
whole AS (
  SELECT c.conv_id, coalesce(list(md5(role) || md5(text) ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS path,
    coalesce(list(octet_length(encode(text)) ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS bytes
  FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
steps AS (SELECT conv_id, path, bytes, unnest(range(len(path) + 1)) AS depth FROM whole),
nodes AS (
  SELECT path[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(bytes[depth]), 0) AS b,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(path) = depth), '')) AS ends_sha256
  FROM steps GROUP BY 1, 2),
kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
above AS (SELECT p[1:a] AS p, sum((n_convs - 1) * b) AS saved, sum(leaf) AS leaves
  FROM (SELECT nodes.p, n_convs, b, (kids.n IS NULL)::INTEGER AS leaf, unnest(range(depth + 1)) AS a FROM nodes LEFT JOIN kids ON kids.p = nodes.p) GROUP BY 1)
SELECT nodes.conv_id, nodes.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(kids.n, 0) AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, nodes.ends_sha256
FROM nodes LEFT JOIN kids ON kids.p = nodes.p JOIN above ON above.p = nodes.p LEFT JOIN nodes up ON nodes.depth > 0 AND up.p = nodes.p[1:nodes.depth - 1]"""
