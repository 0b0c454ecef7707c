"""CRC-32C of many byte strings at once, with numpy.

A CRC register is linear in the message: strings are cut into segments that are worked on side by
side, byte column by byte column, and the segments' registers are combined by the matrix that
moves a register over one segment of zeros.
"""

from __future__ import annotations

import numpy as np

_POLY = 0x82F63B78  # reflected Castagnoli polynomial
_SEG = 64


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLY), t >> 1).astype(np.uint32)
    return t


_T8 = _byte_table()


def _pair_table() -> np.ndarray:
    v = np.arange(1 << 16, dtype=np.uint32)
    v = _T8[v & 255] ^ (v >> 8)
    return _T8[v & 255] ^ (v >> 8)


_T16 = _pair_table()


def _shift_tables(n: int) -> np.ndarray:
    """Four tables by byte of a register, for moving it over n zero bytes."""
    out = np.empty((4, 256), np.uint32)
    for k in range(4):
        r = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(n):
            r = _T8[r & 255] ^ (r >> 8)
        out[k] = r
    return out


_MOVE = _shift_tables(_SEG)


def _move(r: np.ndarray) -> np.ndarray:
    return _MOVE[0][r & 255] ^ _MOVE[1][(r >> 8) & 255] ^ _MOVE[2][(r >> 16) & 255] ^ _MOVE[3][r >> 24]


def crc32c(items: list[bytes]) -> np.ndarray:
    """The CRC-32C of each string of four or more bytes."""
    n = np.fromiter(map(len, items), np.int64, len(items))
    if not len(n):
        return np.empty(0, np.uint32)
    segs = -(-n // _SEG)
    ends = np.cumsum(segs)
    flat = bytearray(int(ends[-1]) * _SEG)
    for x, e in zip(items, (ends * _SEG).tolist(), strict=True):
        flat[e - len(x) : e] = x
    grid = np.frombuffer(flat, np.uint8)
    first = ends * _SEG - n
    grid = grid.copy() if not grid.flags.writeable else grid
    for k in range(4):  # the register starts with ones: the same as flipping the first four bytes
        grid[first + k] ^= 255
    cols = np.ascontiguousarray(grid.view("<u2").reshape(-1, _SEG // 2).T)
    r = np.zeros(cols.shape[1], np.uint32)
    for c in cols:
        x = r ^ c
        r = _T16[x & 0xFFFF] ^ (x >> 16)
    starts = ends - segs
    state = r[starts].copy()
    at, k = np.nonzero(segs > 1)[0], 1
    while len(at):
        state[at] = _move(state[at]) ^ r[starts[at] + k]
        k += 1
        at = at[segs[at] > k]
    return state ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Checksums rotated and offset, so that checksums of data holding checksums stay sound."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)
