"""Hilbert positions of points on an integer grid, for whole arrays at once."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of ``cells``.

    ``cells`` holds non-negative integers below ``2**bits``, one column per
    axis; ``bits * axes`` must be at most 63.  The axes are turned into the
    transposed Hilbert index by undoing the rotations from the highest bit
    down and Gray-coding the outcome; its bits are then interleaved.
    """
    x = np.array(cells, dtype=np.int64).T.copy()
    axes = len(x)
    if axes * bits > 63:
        raise ValueError("at most 63 bits fit a key")
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for axis in range(axes):
            turned = (x[axis] & level) != 0
            swap = np.where(turned, 0, (x[0] ^ x[axis]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if axis:
                x[axis] ^= swap
        level >>= 1
    for axis in range(1, axes):
        x[axis] ^= x[axis - 1]
    flip = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip ^= np.where((x[-1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in range(axes):
            key = (key << 1) | ((x[axis] >> bit) & 1)
    return key
