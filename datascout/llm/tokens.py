"""Word and window hashes in numpy, for use inside tasks.  Words are runs of bytes other than ASCII white space."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_U = np.uint64
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=_U))
        _powers[:] = made
    return _powers[0], _powers[1]


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer that ends with white space."""
    space = np.empty(len(buf) + 1, dtype=np.int8)
    space[0] = 1
    space[1:] = _SPACE[buf]
    step = np.diff(space)
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


def words_of(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and length of every word of the lines, in order, and the number of words of each line."""
    buf = np.frombuffer(b"\n".join(lines) + b"\n", dtype=np.uint8)
    spans = word_spans(buf)
    starts, h = _spans_hashed(buf, spans=spans)
    at = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in lines]))
    return h, spans[1] - starts, np.diff(at, prepend=0)


def _spans_hashed(buf: np.ndarray, prefix: int = 0, spans: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = spans or word_spans(buf)
    if prefix:
        ends = np.minimum(ends, starts + prefix)
    up, down = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=_U)
    np.cumsum((buf.astype(_U) + _U(1)) * up[: len(buf)], out=sums[1:])
    return starts, mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def hash_words(texts: list[bytes], chunk: int = 1 << 20, prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (or of its first `prefix` bytes) of the texts, in order, and the number of words of each text.

    Whole texts go into a buffer of about `chunk` bytes at a time, so that memory is bounded by the largest text.
    """
    hashes, counts = [], np.zeros(len(texts), dtype=np.int64)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < chunk):
            size += len(texts[j]) + 1
            j += 1
        buf = np.frombuffer(b"\n".join(texts[i:j]) + b"\n", dtype=np.uint8)
        starts, h = _spans_hashed(buf, prefix)
        bounds = np.cumsum([len(t) + 1 for t in texts[i:j]])
        at = np.searchsorted(starts, bounds)
        counts[i:j] = np.diff(at, prepend=0)
        hashes.append(h)
        i = j
    return (np.concatenate(hashes) if hashes else np.zeros(0, dtype=_U)), counts


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values of h (also across texts; see inside())."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=_U)
    acc = h[:m].copy()
    for j in range(1, n):
        acc *= _U(0xD6E8FEB86659FD93)
        acc += h[j : j + m]
    return mix64(acc)


def inside(counts: np.ndarray, n: int) -> np.ndarray:
    """Which of the windows of n words lie in a single text."""
    total = int(counts.sum())
    m = total - n + 1
    if m <= 0:
        return np.zeros(0, dtype=bool)
    doc = np.repeat(np.arange(len(counts)), counts)
    return doc[:m] == doc[n - 1 :]


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values."""
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[:-width], x[width:]) if len(x) > width else x[:0]
        width *= 2
    rest = n - width
    return (np.minimum(x[:-rest], x[rest:]) if len(x) > rest else x[:0]) if rest else x


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of `total` places lie in a window of n places from one of the starts."""
    step = np.zeros(total + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + n, total), -1)
    return np.cumsum(step[:-1]) > 0


def as_bytes(column) -> list[bytes]:
    """A string column of Arrow as UTF-8 bytes; null: empty."""
    return [x or b"" for x in column.cast("large_binary").to_pylist()]
