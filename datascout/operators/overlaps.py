"""Joins of overlapping intervals and of touching boxes.  Cells that give the joins an equal key follow the data, not a fixed grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workdir import work_dir

#: Starts, or boxes, in a cell, about; cells at most; sampled starts, or boxes of a side, from which the cells are drawn, about.
LOAD, MOST_CELLS, SAMPLE = 2_000, 4_096, 40_000
#: Halvings of the world in the smallest cell of boxes (a third of a metre), where it is crowded.
DEPTH = 26
#: The world in degrees.
WORLD = (-180.0, -90.0, 180.0, 90.0)


# --- Intervals -----------------------------------------------------------------------------------------------------------------------


def _sampled(points: DataFrame) -> tuple[int, list]:
    """Number of rows, and a bounded sample; none of so few rows that one cell holds them."""
    n = points.count()
    return n, [] if n <= LOAD else points.sample(min(1.0, SAMPLE / n), seed=1).collect()


def cell_ends(starts: DataFrame) -> list[float]:
    """Ends of cells that hold about LOAD of the starts (one column of numbers) each; equal starts stay together."""
    n, rows = _sampled(starts)
    if not rows:
        return []
    x = np.sort(np.array([r[0] for r in rows]))
    cells = min(MOST_CELLS, -(-n // LOAD))
    return np.unique(x[(np.arange(1, cells) * len(x)) // cells]).tolist()


def _in_cells(df: DataFrame, ends: list[float], **columns: str) -> DataFrame:
    """df with a cell column for each column of numbers."""
    if not ends:
        return df.withColumns({name: F.lit(0) for name in columns})
    splits = [-float("inf"), *ends, float("inf")]
    df = Bucketizer(splitsArray=[splits] * len(columns), inputCols=list(columns.values()), outputCols=list(columns)).transform(df)
    return df.withColumns({name: F.col(name).cast("int") for name in columns})


def dealt(starts: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """starts (key, x) with their cell, and spans (key, lo, hi) once for each cell that they reach.

    A cell that a span reaches but doesn't end in lies in it whole, so each such copy meets about LOAD starts, all of which match.
    """
    ends = cell_ends(starts.select("x"))
    held = _in_cells(spans, ends, c0="lo", c1="hi")
    return _in_cells(starts, ends, cell="x"), held.withColumn("cell", F.explode(F.sequence("c0", "c1"))).drop("c0", "c1")


def join_time(queries: DataFrame, records: DataFrame) -> DataFrame:
    """(qid, id) of queries (qid, q_start, q_end) whose interval overlaps a record's (id, t_start, t_end).

    A pair meets where the later of both starts lies: a record's start inside the query, or else a query's start inside the record.  Starts are
    dealt to cells by a bounded sample, and the other side's intervals to the cells that they reach; so the join has an equal key, finds
    each pair once, and a long interval costs no more rows than its matches.  Intervals with a null end, or that end before they start,
    match nothing; rows that repeat match each.
    """
    at = lambda c: F.col(c).cast("timestamp").cast("double")
    q = queries.where("q_start <= q_end").select("qid", at("q_start").alias("lo"), at("q_end").alias("hi"))
    r = records.where("t_start <= t_end").select("id", at("t_start").alias("lo"), at("t_end").alias("hi"))
    starts, spans = dealt(r.select("id", F.col("lo").alias("x")), q)
    later_record = starts.join(spans, "cell").where("lo <= x AND x <= hi").select("qid", "id")
    starts, spans = dealt(q.select("qid", F.col("lo").alias("x")), r)
    return later_record.unionByName(starts.join(spans, "cell").where("lo < x AND x <= hi").select("qid", "id"))


# --- Boxes ---------------------------------------------------------------------------------------------------------------------------


class Quadtree:
    """Cells that halve both ways wherever they hold more than `capacity` of the points; a cell holds its lower edges, those at the world's end both."""

    def __init__(self, x: np.ndarray, y: np.ndarray, capacity: int):
        self.bounds, self.first, self.parent, self.held = [WORLD], [-1], [-1], [len(x)]
        todo = [(0, 0, np.arange(len(x)))]
        while todo:
            node, depth, own = todo.pop()
            if len(own) <= capacity or depth == DEPTH or len(self.first) > 4 * MOST_CELLS:
                continue
            x0, y0, x1, y1 = self.bounds[node]
            mx, my = (x0 + x1) / 2, (y0 + y1) / 2
            east, north = x[own] >= mx, y[own] >= my
            self.first[node] = len(self.first)
            for part, box in ((~east & ~north, (x0, y0, mx, my)), (east & ~north, (mx, y0, x1, my)), (~east & north, (x0, my, mx, y1)), (east & north, (mx, my, x1, y1))):
                todo.append((len(self.first), depth + 1, own[part]))
                self.bounds.append(box)
                self.first.append(-1)
                self.parent.append(node)
                self.held.append(int(part.sum()))
        self.edges, self.children = np.array(self.bounds), np.array(self.first)

    def above(self, node: int) -> list[int]:
        out = []
        while (node := self.parent[node]) >= 0:
            out.append(node)
        return out

    def cover(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of boxes (x0, y0, x1, y1 in the world) and nodes: the largest that lie in a box, and the leaves that it reaches besides."""
        rows, nodes = np.arange(len(boxes)), np.zeros(len(boxes), dtype=np.int64)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        while len(rows):
            b, e = boxes[rows], self.edges[nodes]
            below = (b[:, :2] < e[:, 2:]) | (e[:, 2:] == np.array(WORLD[2:]))
            reach = (below & (b[:, 2:] >= e[:, :2])).all(axis=1)
            whole = (b[:, :2] <= e[:, :2]).all(axis=1) & (b[:, 2:] >= e[:, 2:]).all(axis=1)
            leaf = self.children[nodes] < 0
            take = reach & (whole | leaf)
            out.append((rows[take], nodes[take]))
            rest = reach & ~take
            rows = np.repeat(rows[rest], 4)
            nodes = (self.children[nodes[rest]][:, None] + np.arange(4)).ravel()
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (rows, nodes)


_ENTRY = "piece int, a0 double, b0 double, a1 double, b1 double, lat1 double, lat2 double, rx double, ry double, node int, inner boolean, above array<int>, x0 double, y0 double, x1 double, y1 double"


def quadtree(sides: list[DataFrame]) -> Quadtree:
    """The tree of bounded samples of the lower corners of all sides' boxes (key, lo, lat1, hi, lat2)."""
    total, points = 0, []
    for side in sides:
        n, rows = _sampled(side.select("lo", "lat1"))
        total += n
        points += [tuple(r) for r in rows]
    xy = np.clip(np.array(points, dtype=float).reshape(-1, 2), WORLD[:2], WORLD[2:])
    capacity = max(1, len(xy) * LOAD // max(1, total), len(xy) // MOST_CELLS * 2)
    return Quadtree(xy[:, 0], xy[:, 1], capacity)


def _entries(boxes: DataFrame, key: str, tree: Quadtree) -> DataFrame:
    """A row for each node that covers a part of a box, written to the shared folder: the parts of a box east and west of the dateline are pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, lat1, hi, lat2 = (batch.column(i).to_numpy() for i in range(1, 5))
            over = lo > hi
            which = np.r_[np.arange(len(lo)), np.flatnonzero(over)]
            piece = np.r_[np.zeros(len(lo), dtype=np.int32), np.ones(int(over.sum()), dtype=np.int32)]
            a0, b0, a1, b1 = lo, np.where(over, WORLD[2], hi), np.where(over, WORLD[0], np.nan), np.where(over, hi, np.nan)
            west = np.where(piece == 0, a0[which], a1[which])
            shown = np.clip(np.stack([west, lat1[which], np.where(piece == 0, b0[which], b1[which]), lat2[which]], axis=1), WORLD[:2] * 2, WORLD[2:] * 2)
            rows, nodes = tree.cover(shown)
            at = which[rows]
            maybe = lambda x: pa.array(x[at], mask=np.isnan(x[at]))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(at)), pa.array(piece[rows]), *map(pa.array, (a0[at], b0[at])), maybe(a1), maybe(b1), pa.array(lat1[at]), pa.array(lat2[at]), pa.array(shown[rows, 0]), pa.array(shown[rows, 1]),
                pa.array(nodes, pa.int32()), pa.array(tree.children[nodes] >= 0), pa.array([tree.above(n) for n in nodes.tolist()], pa.list_(pa.int32())), *[pa.array(tree.edges[nodes, i]) for i in range(4)],
            ], names=[key, *(x.split()[0] for x in _ENTRY.split(", "))])

    kind = f"`{key}` {boxes.schema[key].dataType.simpleString()}, {_ENTRY}"
    path = work_dir(boxes.sparkSession, "boxes")
    boxes.mapInArrow(run, kind).write.parquet(path)
    return boxes.sparkSession.read.schema(kind).parquet(path)


def _met(deep: str, high: str) -> Column:
    """Whether the pieces of the rows `deep` and `high` touch, no earlier pieces of both boxes do, and the lower corner of what they share lies in deep's cell."""
    c = lambda side, name: F.col(f"{side}.{name}")
    over = lambda i, j: F.coalesce((c("q", f"a{i}") <= c("r", f"b{j}")) & (c("r", f"a{j}") <= c("q", f"b{i}")), F.lit(False))
    first = F.when(over(0, 0), 0).when(over(0, 1), 1).when(over(1, 0), 2).when(over(1, 1), 3)
    lat = (c("q", "lat1") <= c("r", "lat2")) & (c("r", "lat1") <= c("q", "lat2"))
    x, y = F.greatest(c("q", "rx"), c("r", "rx")), F.greatest(c("q", "ry"), c("r", "ry"))
    inside = (x >= c(deep, "x0")) & ((x < c(deep, "x1")) | (c(deep, "x1") == WORLD[2])) & (y >= c(deep, "y0")) & ((y < c(deep, "y1")) | (c(deep, "y1") == WORLD[3]))
    return lat & (first == 2 * c("q", "piece") + c("r", "piece")) & inside


def join_boxes(queries: DataFrame, records: DataFrame) -> DataFrame:
    """(qid, id) of queries (qid, q_min_lon, ...) whose box touches a record's (id, min_lon, ...).

    Cells are the leaves of a quad-tree over bounded samples of both sides.  A box is dealt to the largest nodes that lie in it and the
    leaves that it reaches besides, so a small box has a few rows and the whole world one.  Of two boxes that touch, the lower corner of
    what they share lies in one leaf, over which each has one node, one of them the other's or above it: there the pair is met, once.  Only nodes
    above leaves that the other side has are looked up, which are few unless its boxes are large.  A box whose min_lon is
    above its max_lon crosses the dateline.  Boxes with a null, or with min_lat above max_lat, touch nothing; rows that repeat match each.
    """

    def boxes(df: DataFrame, key: str, prefix: str) -> DataFrame:
        cols = [F.col(prefix + c).cast("double").alias(n) for c, n in (("min_lon", "lo"), ("min_lat", "lat1"), ("max_lon", "hi"), ("max_lat", "lat2"))]
        return df.select(key, *cols).where("lo IS NOT NULL AND hi IS NOT NULL AND lat1 <= lat2")

    sides = boxes(queries, "qid", "q_"), boxes(records, "id", "")
    tree = quadtree(list(sides))
    q, r = _entries(sides[0], "qid", tree), _entries(sides[1], "id", tree)
    used = lambda side: F.array(*[F.lit(x["node"]) for x in side.where("inner").select("node").distinct().collect()]).cast("array<int>")  # noqa: E731  the tree's nodes at most
    up = lambda side, other, own: F.explode(F.concat(F.array("node") if own else F.array().cast("array<int>"), F.array_intersect("above", used(other))))
    deep_r = r.withColumn("up", up(r, q, True)).drop("above").alias("r").join(q.drop("above").alias("q"), F.col("up") == F.col("q.node")).where(_met("r", "q"))
    deep_q = q.withColumn("up", up(q, r, False)).drop("above").alias("q").join(r.drop("above").alias("r"), F.col("up") == F.col("r.node")).where(_met("q", "r"))
    return deep_r.select("qid", "id").unionByName(deep_q.select("qid", "id"))
