"""Sorted hash arrays in the shared folder: written by tasks, memory-mapped by workers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np

_U = np.uint64


def mapped_path(uri: str) -> str:
    """Path under which workers can map files of a shared folder."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped arrays need a shared folder that is mounted on every worker, not {uri}")
    return unquote(parts.path)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Range bucket of uniform 64-bit keys: larger keys never get a smaller bucket."""
    return (((keys >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)


def write(path: str, bucket: int, **arrays: np.ndarray) -> None:
    """Each array as a file of the bucket.  A task that runs again writes the same bytes and replaces the file in one step."""
    os.makedirs(path, exist_ok=True)
    for name, x in arrays.items():
        made = f"{path}/.{uuid.uuid4().hex}"
        with open(made, "wb") as f:
            np.save(f, x)
        os.replace(made, f"{path}/{bucket}.{name}.npy")


def runs(sorted_values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each value that occurs, and where: the work grows with the values that occur, not with those that could."""
    first = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, dtype=np.int64)
    for s, e in zip(first.tolist(), np.r_[first[1:], len(sorted_values)].tolist()):
        yield int(sorted_values[s]), slice(s, e)


_open: dict[tuple[str, int, str], np.ndarray] = {}


def load(path: str, bucket: int, name: str) -> np.ndarray:
    """An array of a bucket, mapped once for each worker.  Every bucket has its files, so one that is missing was written elsewhere: that raises."""
    key = (path, bucket, name)
    if key not in _open:
        if len(_open) > 50_000:
            _open.clear()
        file = f"{path}/{bucket}.{name}.npy"
        if not os.path.exists(file):
            raise FileNotFoundError(f"{file} isn't here: spark.checkpoint.dir must name a folder that all workers share and mount")
        _open[key] = np.load(file, mmap_mode="r")
    return _open[key]


def find(path: str, buckets: int, keys: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """For sorted keys: (bucket, their slice, which of them are in its array `key`, their places there)."""
    for b, at in runs(bucket_of(keys, buckets)):
        own, held = keys[at], load(path, b, "key")
        place = np.searchsorted(held, own)
        hit = place < len(held)
        hit[hit] = held[place[hit]] == own[hit]
        yield b, at, hit, place[hit]


def gather(path: str, buckets: int, keys: np.ndarray, **fill: object) -> dict[str, np.ndarray]:
    """Values of sorted keys from the arrays named; a key that isn't there gets the value of fill."""
    out = {n: np.full(len(keys), v) for n, v in fill.items()}
    for b, at, hit, place in find(path, buckets, keys):
        for n, x in out.items() if hit.any() else ():
            x[at][hit] = load(path, b, n)[place]
    return out


def planes(x: np.ndarray) -> bytes:
    """Bytes of the values, all first bytes first, which shuffles compress well for small values."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as the planes of their differences."""
    return planes(np.diff(keys, prepend=_U(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(from_planes(b, _U), dtype=_U)


def add_up(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, with the sums of each of the values."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return (keys[first], *(np.add.reduceat(v[order], first) for v in values))


class Tally:
    """Counts of keys within a task, handed over in parts of bounded size, dealt to range buckets."""

    def __init__(self, buckets: int, most: int = 3_000_000):
        self.buckets, self.most, self.parts, self.held = buckets, most, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> Iterator[tuple[list, list, list]]:
        self.parts.append(add_up(keys, np.ones(len(keys), dtype=np.int64) if counts is None else counts))
        self.held += len(self.parts[-1][0])
        if self.held > self.most:
            merged = add_up(*(np.concatenate(x) for x in zip(*self.parts)))
            self.parts, self.held = [merged], len(merged[0])
            if self.held > self.most // 2:
                yield from self.close()

    def close(self) -> Iterator[tuple[list, list, list]]:
        if self.parts:
            keys, counts = add_up(*(np.concatenate(x) for x in zip(*self.parts)))
            self.parts, self.held = [], 0
            full = list(runs(bucket_of(keys, self.buckets)))
            yield [b for b, _ in full], [pack_sorted(keys[at]) for _, at in full], [planes(counts[at]) for _, at in full]


def merge_counts(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the parts that tasks handed over for one bucket."""
    return add_up(np.concatenate([unpack_sorted(k) for k in keys]), np.concatenate([from_planes(c, np.int64) for c in counts]))
