"""Sharding by a hierarchical weighted hash tree (operator 6, native).

A row descends from the root to a region, a rack and a shard.  At each level every child draws
-ln(u) / weight from a hash of the row's key and the child's name, and the smallest draw wins: a child wins with a
probability in proportion to its weight, and a child's draw depends on nothing but its own weight.  So when weights
change, rows move only into subtrees that gained or out of those that lost, and all other rows stay.

A tree that grows gets each new shard as a region of its own (one rack, one shard): only the top level
changes, so that rows move into the new shard and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_count, hash52, hash52_sql, range_bucket, read_table, text_key

SHARDS = 40
#: Shards per rack and racks per region in the tree a dataset starts with.
PER_RACK, PER_REGION = 5, 2


@dataclass(frozen=True)
class Node:
    name: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int | None = None


def _inner(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), tuple(children))


def hash_tree(shards: int, base: int = SHARDS, weights: dict[int, float] | None = None) -> Node:
    """Tree of `shards` shards: the first `base` in full racks and regions, each later one a region of its own.

    weights: a shard's weight (1 if not given); a rack or region weighs the sum of what it holds.
    """
    leaf = lambda s: Node(f"s{s}", float((weights or {}).get(s, 1.0)), shard=s)
    first, regions = list(range(min(shards, base))), []
    for r in range(0, len(first), PER_RACK * PER_REGION):
        region = first[r : r + PER_RACK * PER_REGION]
        racks = [_inner(f"k{region[k]}", [leaf(s) for s in region[k : k + PER_RACK]]) for k in range(0, len(region), PER_RACK)]
        regions.append(_inner(f"r{region[0]}", racks))
    regions += [_inner(f"r{s}", [_inner(f"k{s}", [leaf(s)])]) for s in range(base, shards)]
    return _inner("root", regions)


def _levels(root: Node) -> list[list[list[tuple[str, float, int]]]]:
    """For each level the children of its nodes: name, weight, and the child's place in the next level (at last its shard)."""
    levels, nodes = [], [root]
    while nodes[0].shard is None:
        below = [c for n in nodes for c in n.children if c.weight > 0]
        at = {id(c): i if c.shard is None else c.shard for i, c in enumerate(below)}
        levels.append([[(c.name, c.weight, at[id(c)]) for c in n.children if c.weight > 0] for n in nodes])
        nodes = below
    return levels


def tree_shard(key: Column, root: Node) -> Column:
    """Shard of a key (text): at each level only the children of the node entered draw, and the smallest draw wins."""
    at = F.lit(0)
    for level in _levels(root):
        children = F.array(*[F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), F.lit(to).alias("to")) for n, w, to in node]) for node in level])

        def draw(c: Column) -> Column:
            u = (hash52(c["name"], key).cast("double") + F.lit(0.5)) / F.lit(2.0**52)
            return F.struct((-F.log(u) / c["weight"]).alias("draw"), c["to"].alias("to"))

        at = F.array_min(F.transform(F.element_at(children, at + 1), draw))["to"]
    return at


def place(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", weights: dict[int, float] | None = None) -> DataFrame:
    """docs plus `shard` and `grown_shard` (with one more shard).  Law: key and shard count decide.

    Rows with a null key share one shard; rows that repeat a key go to the same shard.  An empty table gives an
    empty table.  All columns stay; columns named shard or grown_shard are replaced.
    """
    k = text_key(F.col(key))
    return docs.withColumns({"shard": tree_shard(k, hash_tree(shards, weights=weights)), "grown_shard": tree_shard(k, hash_tree(shards + 1, weights=weights))})


def with_slots(placed: DataFrame, rows: int, order: list[Column], h: str = "h", shards: int = SHARDS) -> DataFrame:
    """Adds `slot`: the row's place in its shard, gapless from 0, by h (52 bits) and then `order`.

    No task gets a whole shard: hash ranges of a shard are counted, the counts are summed up, and rows are numbered
    within their range.
    """
    placed = placed.withColumn("bucket", range_bucket(F.col(h), bucket_count(rows, shards)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "bucket").orderBy(h, *order)
    return placed.join(starts, ["shard", "bucket"]).withColumn("slot", F.col("start") + F.row_number().over(own) - 1).drop("start", "bucket")


def op6_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39; see place() for nulls, repeats and empty tables.  Null text: 16 bytes."""
    docs = read_table(spark, sf_dir, "documents")
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    narrow = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), hash52(F.lit("slot"), text_key(F.col("doc_id"))).alias("h"))
    out = with_slots(place(narrow), docs.count(), [F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _leaves(node: Node, path: tuple[Node, ...] = ()):
    if node.shard is not None:
        yield path, node
    for c in node.children:
        yield from _leaves(c, (*path, c) if c.shard is None else path)


def _sql_descent(shards: int) -> str:
    """The winner at each level, found by comparing the draws of all nodes of the level below the winner above."""
    u = f"-ln((CAST({hash52_sql('n.name', 'd.k')} AS DOUBLE) + 0.5) / 4503599627370496.0) / n.weight"
    rows = [(path[0], path[1], leaf) for path, leaf in _leaves(hash_tree(shards))]
    values = lambda xs: ", ".join(xs)
    regions = values(dict.fromkeys(f"('{r.name}', {r.weight})" for r, _, _ in rows))
    racks = values(dict.fromkeys(f"('{r.name}', '{k.name}', {k.weight})" for r, k, _ in rows))
    leaves = values(f"('{k.name}', '{s.name}', {s.weight}, {s.shard})" for _, k, s in rows)
    return f"""
      SELECT c.rid, arg_min(n.shard, {u.replace('d.k', 'c.k')}) AS shard FROM (
        SELECT b.rid, b.k, arg_min(n.name, {u.replace('d.k', 'b.k')}) AS rack FROM (
          SELECT d.rid, d.k, arg_min(n.name, {u}) AS region FROM d, (VALUES {regions}) n(name, weight) GROUP BY ALL) b
        JOIN (VALUES {racks}) n(region, name, weight) ON n.region = b.region GROUP BY ALL) c
      JOIN (VALUES {leaves}) n(rack, name, weight, shard) ON n.rack = c.rack GROUP BY c.rid"""


OP6_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, coalesce(text, '') AS t FROM documents),
now AS ({_sql_descent(SHARDS)}), grown AS ({_sql_descent(SHARDS + 1)}),
crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    WITH RECURSIVE s(i, v, k) AS (
      SELECT i, i::BIGINT, 0 FROM range(256) r(i)
      UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM s WHERE k < 8)
    SELECT i, v FROM s WHERE k = 8)),
crc AS (
  SELECT rid, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(d.t)), '..'), lambda p: CAST('0x' || p AS BIGINT))),
    lambda a, b: xor(a // 256, c.t[xor(a % 256, b) + 1])), 4294967295) AS text_crc32
  FROM d, crc_table c)
SELECT doc_id, octet_length(encode(d.t))::BIGINT + 16 AS size, text_crc32, 'key' AS law, now.shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY now.shard ORDER BY {hash52_sql("'slot'", 'k')}, text_crc32, octet_length(encode(d.t))) - 1 AS slot, grown.shard::INTEGER AS grown_shard
FROM d JOIN now USING (rid) JOIN grown USING (rid) JOIN crc USING (rid)"""
