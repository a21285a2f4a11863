"""The part of neighbour search that runs inside a task: a block of queries against the task's records, by matrix products with bounds and exact scores."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that meet the queries at once; pairs that are scored exactly at once.
ROWS, PAIRS = 512, 50_000
#: Keys of scores: millionths, rounded as Spark rounds; NaN comes before all numbers, null after them, and places without a record last.
NAN, NULL, FREE = 2_000_000, -1, -2
_LATE = np.iinfo(np.int64).max


def by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the rows that have it, their numbers as a matrix (null as NaN), and whether a row has a null in it."""
    lengths, flat = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64), vectors.flatten()
    x, gone = flat.to_numpy(zero_copy_only=False).astype(np.float64), flat.is_null().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        at = starts[rows][:, None] + np.arange(n)
        yield int(n), rows, x[at], gone[at].any(axis=1)


def keys_of(raw: np.ndarray) -> np.ndarray:
    """Scores (0 to 1, or NaN) in millionths: halves go up, as the number's shortest decimal says."""
    x = np.where(np.isnan(raw), 0, raw) * 1e6
    key = np.floor(x + 0.5).astype(np.int64)
    for i in np.flatnonzero(np.abs(x - np.floor(x) - 0.5) < 1e-6):
        key[i] = int(Decimal(repr(float(raw[i]))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return np.where(np.isnan(raw), NAN, key)


class Best:
    """The k best records of each query so far: by key, then by place.  Memory goes with the queries and k, not with the records."""

    def __init__(self, asked: pa.Table, k: int):
        """asked: qid, vector, and perhaps lists: a bit for each list that a query looks into."""
        m = asked.num_rows
        self.k, self.qids = k, asked["qid"].combine_chunks()
        self.key, self.place = np.full((m, k), FREE, np.int64), np.full((m, k), _LATE, np.int64)
        self.raw, self.at = np.zeros((m, k)), np.zeros((m, k), np.int64)
        self.ids, self.n_ids = [], 0
        self.shapes = {}
        for n, rows, x, gone in by_length(asked["vector"].combine_chunks()):
            square = (x * x).sum(axis=1)
            # a product with these gives r.r - 2 r.q, less than the squared distance less q.q by what products may be off
            self.shapes[n] = rows, x, gone, np.hstack([-2 * x, np.full((len(x), 1), 1.0)]), square
        self.lists = None
        if "lists" in asked.column_names:
            bits = np.frombuffer(b"".join(asked["lists"].to_pylist()), np.uint8).reshape(m, -1)
            self.lists = np.ascontiguousarray(np.unpackbits(bits, axis=1).T)

    def take(self, batch: pa.RecordBatch) -> None:
        """Rows (id, place, vector, and list where queries have lists).  Places tell the order of ids; without lists they rise."""
        place, first = batch.column("place").to_numpy(zero_copy_only=False), self.n_ids
        self.ids.append(batch.column("id"))
        self.n_ids += len(batch)
        of = None if self.lists is None else batch.column("list").to_numpy(zero_copy_only=False)
        for n, rows, x, gone in by_length(batch.column("vector")):
            if n not in self.shapes:
                continue
            asked = self.shapes[n]
            for one in [None] if of is None else np.unique(of[rows]):
                some = slice(None) if of is None else np.flatnonzero(of[rows] == one)
                who = np.arange(len(asked[0])) if of is None else np.flatnonzero(self.lists[one][asked[0]])
                if len(who):
                    self._meet(x[some], gone[some], place[rows[some]], first + rows[some], [a[who] for a in asked] if of is not None else asked)
        if self.n_ids > 4 * self.at.size + 100_000:  # ids of records that no query holds are let go
            held = self.key > FREE
            kept, self.at[held] = np.unique(self.at[held], return_inverse=True)
            self.ids = [pa.chunked_array(self.ids).combine_chunks().take(pa.array(kept))]
            self.n_ids = len(kept)

    def _meet(self, x: np.ndarray, gone: np.ndarray, place: np.ndarray, at: np.ndarray, asked: tuple) -> None:
        """Takes in the rows that may be among the k best of a query: those whose distance, less what products may be off, is within that of its k-th."""
        rows, q, q_gone, factors, square = asked
        slack = 32 * (x.shape[1] + 8) * np.finfo(float).eps
        strict = self.lists is None  # later rows have later places, so equal scores change nothing
        i = 0
        while i < len(x):
            last = self.key[rows, -1]
            step = int(np.clip(2 * PAIRS // max(1, (last < 0).sum()), 1, ROWS))
            part, i = slice(i, i + step), i + step
            with np.errstate(all="ignore"):
                least = (last + (0.5 if strict else -0.5)) * 1e-6
                reach = np.where((last >= 0) & (least > 0), 1 / least - 1, np.inf)
                bound = reach + np.abs(reach) * 1e-9 - square * (1 - slack)
                own = x[part]
                near = np.hstack([own, (own * own).sum(axis=1, keepdims=True) * (1 - slack)]) @ factors.T
                r, c = np.nonzero(~(near > bound))  # NaN is looked at
            found = [self._scored(own, gone[part], place[part], at[part], rows, q, q_gone, r[j : j + PAIRS], c[j : j + PAIRS]) for j in range(0, len(r), PAIRS)]
            if found:
                self._merge(*map(np.concatenate, zip(*found)))

    def _scored(self, x, gone, place, at, rows, q, q_gone, r, c) -> tuple[np.ndarray, ...]:
        """Query, key, place, raw score and id of the pairs that are better than their query's k-th; sums go from the first number to the last, as Spark's do."""
        with np.errstate(all="ignore"):
            d = x[r] - q[c]
            raw = 1.0 / (1.0 + (np.cumsum(d * d, axis=1)[:, -1] if d.shape[1] else np.zeros(len(r))))
        key, who = np.where(gone[r] | q_gone[c], NULL, keys_of(raw)), rows[c]
        worst = self.key[who, -1]
        better = (key > worst) | ((key == worst) & (place[r] < self.place[who, -1]))
        return who[better], key[better], place[r][better], raw[better], at[r][better]

    def _merge(self, who, key, place, raw, at) -> None:
        if not len(who):
            return
        those, of = np.unique(who, return_inverse=True)
        joined = [np.concatenate([held[those].ravel(), new]) for held, new in ((self.key, key), (self.place, place), (self.raw, raw), (self.at, at))]
        of = np.concatenate([np.repeat(np.arange(len(those)), self.k), of])
        order = np.lexsort((joined[1], -joined[0], of))
        first = np.searchsorted(of[order], np.arange(len(those)))
        best = order[first[:, None] + np.arange(self.k)]
        self.key[those], self.place[those], self.raw[those], self.at[those] = (x[best] for x in joined)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(qid, id, raw) of all that are held; raw is null where a number is missing."""
        q, n = np.nonzero(self.key > FREE)
        if len(q):
            ids = pa.chunked_array(self.ids).combine_chunks().take(pa.array(self.at[q, n]))
            yield pa.RecordBatch.from_arrays([self.qids.take(pa.array(q)), ids, pa.array(self.raw[q, n], mask=self.key[q, n] == NULL)], ["qid", "id", "raw"])
