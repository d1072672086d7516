"""Position of grid cells along a Hilbert curve."""

from __future__ import annotations

import numpy as np


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the curve of each row of ``cells`` (n x dims, below 2^bits each).

    The coordinates are turned into the curve's transposed form one bit plane at a time
    (Skilling, 2004), then their bits are dealt out, the highest plane first.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    if dims * bits > 62:
        raise ValueError("the position must fit into 62 bits")
    for plane in range(bits - 1, 0, -1):
        bit, low = 1 << plane, (1 << plane) - 1
        for i in range(dims):
            set_, swap = (x[i] & bit) != 0, (x[0] ^ x[i]) & low
            x[0] ^= np.where(set_, low, swap)
            if i:
                x[i] ^= np.where(set_, 0, swap)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for plane in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << plane), (1 << plane) - 1, 0)
    x ^= turn
    out = np.zeros(x.shape[1], np.int64)
    for plane in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> plane & 1)
    return out
