"""Block fingerprints: a 64-bit SimHash for each of several samples of a text's items, to find texts that share most items.

A SimHash of all items moves by many bits when a tenth of a short text's items change, so no radius that can be searched finds
most of these pairs.  So a fingerprint has many blocks, each the SimHash of SAMPLE items only: those with the least draw
under hash functions of that block.  Texts that share a share j of their items agree on a whole block with a chance of
about j ** SAMPLE, and on one of b blocks with 1 - (1 - j ** SAMPLE) ** b; strangers agree on none but by chance.
"""

from __future__ import annotations

import numpy as np

from .tokens import mix64

SAMPLE = 3  # items of a block, unless a caller names another number
_U = np.uint64
_ONE = np.float32(2.0**24).view(np.int32)
_FACTORS = mix64(np.arange(1, 129, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def block_prints(h: np.ndarray, first: np.ndarray, blocks: int, size: int = SAMPLE, ease: np.ndarray | None = None) -> np.ndarray:
    """(texts, blocks): SimHashes of samples of `size` items.  h: item hashes, text by text; first: where each text starts.

    ease: for each item the inverse of its weight, in 32 bits (items are drawn in proportion to their weight); None: all weigh the same.
    """
    out = np.empty((len(first), blocks), dtype=np.uint64)
    x, u, draws = np.empty_like(h), np.empty(len(h), dtype=np.float32), np.empty(len(h))  # used again for each draw
    weights = None if ease is None else ease.astype(np.float64)
    for k in range(blocks):
        drawn = []
        for j in range(size):
            np.multiply(h, _FACTORS[(k * size + j) % len(_FACTORS)], out=x)
            if weights is None:
                least = np.minimum.reduceat(x, first)
            else:  # -log2 of a uniform number over its weight; the bits of a float are its logarithm, nearly
                np.right_shift(x, _U(40), out=x)
                u[:] = x.view(np.int64)  # signed numbers become floats several times as fast
                u += 1
                np.multiply(np.subtract(_ONE, u.view(np.int32)), weights, out=draws)
                least = np.minimum.reduceat(draws, first).astype(np.float32).view(np.uint32).astype(np.uint64)
            drawn.append(mix64(least + _U(j)))
        out[:, k] = _majority(drawn)
    return out


def _majority(x: list[np.ndarray]) -> np.ndarray:
    """SimHash of as many hashes: each bit is set if it is in over half of them."""
    if len(x) == 3:
        a, b, c = x
        return (a & b) | (b & c) | (a & c)
    if len(x) == 4:
        a, b, c, d = x
        return (a & b & (c | d)) | (c & d & (a | b))
    raise ValueError("a block samples three or four items")
