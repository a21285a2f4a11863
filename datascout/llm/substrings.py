"""Substring dedup by level-wise doubling (operator 9).

Words covered by a window of `window` words that also starts in a document with a smaller id are removed.

Levels look at windows of 4, 8, ... words and at last of `window` words: those that repeat at one length alone are extended to twice that
length, until the full length is reached or no candidate survives.  At a level below the full length a full-length window is
known by the smallest hash of the level's windows inside it: equal full windows have the same one, and neighbours mostly share
it, so a fraction of the level's windows speaks for all.  A full window stays a candidate while its smallest one occurs in another document.
The full windows themselves are compared by 95 bits of two independent hashes: of 10**13 different windows, 1 in 1,000 runs has two that agree.
Longer windows are made of windows of the full length, so further doubling removes no further word.

Documents are dealt once into groups of bounded size by a hash of their id and text, and that shuffle serves all levels.  Windows are
dealt by their hash; a group sends a window once, however many of its documents hold it, so a passage that very many documents
share is no hot key: it costs one entry a group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SQL, read_table
from .tokens import as_bytes, covered, hash_words, inside, mix64, sliding_min, windows

#: Words of a window that may occur once only, and of the first level's windows.
WINDOW, FIRST_LEVEL = 13, 4
#: Bytes of text in a group; windows of so many groups share a task.
GROUP_BYTES, GROUPS_A_BUCKET = 2 << 20, 4
_LAST = np.iinfo(np.int64).max
_ONE = np.uint64(1)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    """Ids; null counts as the largest."""
    return column.fill_null(_LAST).to_numpy()


def _pack(x: np.ndarray) -> bytes:
    """Bytes of the values, all first bytes first: small ids then hold long runs of zeros, which shuffles compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unpack(b: bytes, kind=np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _all(column: pa.ChunkedArray, kind=np.uint64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(_unpack(b, kind) for b in column.to_pylist())])


def level_lengths(window: int, first: int = FIRST_LEVEL) -> list[int]:
    """Words of the windows at each level: each length is twice the one before, the last is the full one."""
    out = []
    while first < window:
        out.append(first)
        first *= 2
    return [*out, window]


def _deal(names: list[str], label: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """One row for each label with the values it gets."""
    order = np.argsort(label, kind="stable")
    label, columns = label[order], [c[order] for c in columns]
    first = np.flatnonzero(np.r_[True, label[1:] != label[:-1]]) if len(label) else np.zeros(0, dtype=np.int64)
    ends = np.r_[first[1:], len(label)]
    blobs = [[_pack(c[s:e]) for s, e in zip(first, ends)] for c in columns]
    return pa.table({names[0]: pa.array(label[first], pa.int64()), **{n: pa.array(b, pa.binary()) for n, b in zip(names[1:], blobs)}})


def _first_of(key: np.ndarray, ids: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct keys (with `more`, pairs of both), the smallest id of each, whether it has several ids, and its part of more."""
    order = np.lexsort((ids, key) if more is None else (ids, more, key))
    key, ids, more = key[order], ids[order], more[order] if more is not None else None
    new = key[1:] != key[:-1] if more is None else (key[1:] != key[:-1]) | (more[1:] != more[:-1])
    first = np.flatnonzero(np.r_[True, new]) if len(key) else np.zeros(0, dtype=np.int64)
    last = np.r_[first[1:], len(key)] - 1
    return key[first], ids[first], ids[first] != ids[last[: len(first)]], more[first] if more is not None else None


def _group(table: pa.Table, n: int):
    """Of a group of documents: ids, texts, word hashes, words per text, and the starts of the windows of n words."""
    ids, texts = _ids(table["id"]), as_bytes(table["text"])
    h, counts = hash_words(texts)
    return ids, texts, h, counts, np.flatnonzero(inside(counts, n))


def _seeds(h: np.ndarray, at: np.ndarray, n: int, window: int) -> np.ndarray:
    """For the windows at `at` the smallest hash of the windows of n words inside each."""
    return sliding_min(windows(h, n), window - n + 1)[at] & ~_ONE


def _full(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """63 bits of one hash and 32 of another, of the windows of n words at `at`."""
    return windows(h, n)[at] & ~_ONE, (windows(mix64(h + np.uint64(0x9E3779B97F4A7C15)), n)[at] >> np.uint64(32)).astype(np.uint32)


def _buckets(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> _ONE) % np.uint64(buckets)).astype(np.int64)


def repeated_windows(docs: DataFrame, groups: int, window: int = WINDOW) -> DataFrame:
    """(g, h, x, least) for the groups g of docs (g, id, text): hashes of windows that also start in another document, and the smallest id."""
    buckets = max(1, groups // GROUPS_A_BUCKET)
    *levels, _ = level_lengths(window)

    def candidates(length: int, before: int | None):
        """Seeds of a level, for the windows whose seed of the level before repeats."""

        def run(docs_of: pa.Table, found: pa.Table | None) -> pa.Table:
            known = _all(found["h"]) if found is not None else None
            if not len(docs_of) or known is not None and not len(known):
                return _deal(["bucket", "h"], np.zeros(0, np.int64), np.zeros(0, np.uint64)).append_column("g", pa.array([], pa.int64()))
            ids, _, h, counts, at = _group(docs_of, window)
            if known is not None:
                at = at[np.isin(_seeds(h, at, before, window), known)]
            key, _, several, _ = _first_of(_seeds(h, at, length, window), np.repeat(ids, counts)[at])
            out = _deal(["bucket", "h"], _buckets(key, buckets), key | several.astype(np.uint64))
            return out.append_column("g", pa.array([docs_of["g"][0].as_py()] * len(out), pa.int64()))

        return run

    def apply(run, found: DataFrame | None, schema: str) -> DataFrame:
        """run(documents of a group, what was found for it)."""
        if found is None:
            return docs.groupBy("g").applyInArrow(lambda docs_of: run(docs_of, None), schema)
        return docs.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(lambda docs_of, of: run(docs_of, of), schema)

    def repeat(table: pa.Table) -> pa.Table:
        parts = [_unpack(b) for b in table["h"].to_pylist()]
        h, g = np.concatenate(parts), np.repeat(table["g"].to_numpy(), [len(p) for p in parts])
        _, place, n = np.unique(h >> _ONE, return_inverse=True, return_counts=True)
        several = np.zeros(len(n), dtype=bool)
        several[place[(h & _ONE) == _ONE]] = True
        keep = (n > 1)[place] | several[place]
        return _deal(["g", "h"], g[keep], h[keep] & ~_ONE)

    def extend(docs_of: pa.Table, found: pa.Table | None) -> pa.Table:
        """Full windows whose seed of the last level repeats."""
        known = _all(found["h"]) if found is not None else None
        if not len(docs_of) or known is not None and not len(known):
            return _deal(["bucket", "h", "x", "id"], *[np.zeros(0, k) for k in (np.int64, np.uint64, np.uint32, np.uint64)]).append_column("g", pa.array([], pa.int64()))
        ids, _, h, counts, at = _group(docs_of, window)
        if known is not None:
            at = at[np.isin(_seeds(h, at, levels[-1], window), known)]
        full, x = _full(h, at, window)
        key, least, several, x = _first_of(full, np.repeat(ids, counts)[at], x)
        out = _deal(["bucket", "h", "x", "id"], _buckets(key, buckets), key | several.astype(np.uint64), x, least.view(np.uint64))
        return out.append_column("g", pa.array([docs_of["g"][0].as_py()] * len(out), pa.int64()))

    def settle(table: pa.Table) -> pa.Table:
        parts = [_unpack(b) for b in table["h"].to_pylist()]
        h, x, own = np.concatenate(parts), _all(table["x"], np.uint32), _all(table["id"], np.int64)
        g = np.repeat(table["g"].to_numpy(), [len(p) for p in parts])
        order = np.lexsort((own, x, h >> _ONE))
        h, x, own, g = h[order], x[order], own[order], g[order]
        new = np.r_[True, (h[1:] >> _ONE != h[:-1] >> _ONE) | (x[1:] != x[:-1])] if len(h) else np.zeros(0, dtype=bool)
        least = own[np.flatnonzero(new)][np.cumsum(new) - 1]
        keep = (least < own) | ((h & _ONE) == _ONE)  # else it is nobody's repeat in this group
        return _deal(["g", "h", "x", "least"], g[keep], h[keep] & ~_ONE, x[keep], least[keep].view(np.uint64))

    found = None
    for length, before in zip(levels, [None, *levels]):
        made = apply(candidates(length, before), found, "bucket long, h binary, g long")
        found = made.groupBy("bucket").applyInArrow(repeat, "g long, h binary")
    full = apply(extend, found, "bucket long, h binary, x binary, id binary, g long")
    return full.groupBy("bucket").applyInArrow(settle, "g long, h binary, x binary, least binary")


def grouped(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, int]:
    """docs as (g, id, text), and how many groups g there are: as many as the total size asks for."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    g = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(groups))  # rows that share an id, or have none, are spread by their texts
    return docs.select(g.alias("g"), F.col("doc_id").cast("long").alias("id"), F.col("text")), groups


def remove_repeats(docs: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per row of docs: doc_id, text (the kept words, joined by one space), n_words, n_removed and kept_sha256.

    Null and empty texts have no words.  A null doc_id counts as larger than any other: such rows lose what others hold and take
    nothing from them.  Rows that repeat a doc_id take nothing from each other.  No size or row is capped.
    """
    rows, groups = grouped(docs, group_bytes)

    def finish(docs_of: pa.Table, found: pa.Table) -> pa.Table:
        ids, texts, h, counts, at = _group(docs_of, window)
        full, x = _full(h, at, window)
        known, known_x, least = _all(found["h"]), _all(found["x"], np.uint32), _all(found["least"], np.int64)
        gone = np.zeros(int(counts.sum()), dtype=bool)
        if len(known) and len(full):
            order = np.lexsort((known_x, known))
            known, known_x, least = known[order], known_x[order], least[order]
            place = np.minimum(np.searchsorted(known, full), len(known) - 1)
            step = np.minimum(place + 1, len(known) - 1)  # should two windows agree in the first hash
            place = np.where((known_x[place] != x) & (known[step] == full), step, place)
            own = np.repeat(ids, counts)[at]
            gone = covered(at[(known[place] == full) & (known_x[place] == x) & (least[place] < own)], window, len(gone))
        kept, removed = [], []
        for text, s, e in zip(texts, np.cumsum(counts) - counts, np.cumsum(counts)):
            mine, words = gone[s:e], text.split()
            removed.append(int(mine.sum()))
            kept.append(b" ".join([w for w, x in zip(words, mine.tolist()) if not x] if removed[-1] else words))
        return pa.table({
            "doc_id": docs_of["id"], "text": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        })

    found = repeated_windows(rows, groups, window)
    return rows.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(finish, "doc_id long, text string, n_words long, n_removed long, kept_sha256 string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeats() over all documents, without the texts."""
    return remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, {_LAST}) AS k, regexp_extract_all(coalesce(text, ''), '{WORD_SQL}') AS w FROM documents),
p AS (SELECT rid, k, w, unnest(range(1, len(w) - {WINDOW - 2})) AS pos FROM d),
v AS (SELECT rid, k, pos, md5(array_to_string(w[pos : pos + {WINDOW - 1}], ' ')) AS h FROM p),
f AS (SELECT h, min(k) AS least FROM v GROUP BY h),
g AS (SELECT DISTINCT rid, unnest(range(pos, pos + {WINDOW})) AS i FROM v JOIN f USING (h) WHERE least < k),
x AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
s AS (SELECT x.rid, count(*) AS n_words, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (g.i IS NULL) AS kept FROM x LEFT JOIN g ON x.rid = g.rid AND x.i = g.i GROUP BY x.rid)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (rid)"""
