"""Small binary codecs: probabilities in 8 or 16 bits, little-endian numbers, sparse matrices by diagonal."""

from __future__ import annotations

import struct

import numpy as np


def to_8_bit(x) -> np.ndarray:
    """Values from 0 to 1 as bytes: the sixteenth powers of two that are nearest, 0 as 0."""
    x = np.asarray(x, dtype=np.float64)
    with np.errstate(divide="ignore"):
        return np.where(x < 2.0**-15.9, 0, np.clip(np.rint(255 + 16 * np.log2(np.maximum(x, 1e-30))), 1, 255)).astype(np.uint8)


def from_8_bit(b) -> np.ndarray:
    b = np.asarray(b, dtype=np.float64)
    return np.where(b == 0, 0.0, 2.0 ** ((b - 255) / 16))


def to_16_bit(x) -> bytes:
    """Values as IEEE half floats, little-endian."""
    return np.asarray(x, dtype="<f2").tobytes()


def from_16_bit(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype="<f2").astype(np.float64)


def write_u16(v: int) -> bytes:
    return struct.pack("<H", v)


def write_s16(v: int) -> bytes:
    return struct.pack("<h", v)


def write_u32(v: int) -> bytes:
    return struct.pack("<I", v)


def pack_blocks(entry: int, start: int, blocks: list[tuple[int, int]]) -> bytes:
    """A compressed member as entry (u32), start (u16), number of blocks (u16) and a signed byte pair for each block."""
    return write_u32(entry) + write_u16(start) + write_u16(len(blocks)) + b"".join(struct.pack("<bb", m, g) for m, g in blocks)


def unpack_blocks(b: bytes) -> tuple[int, int, list[tuple[int, int]]]:
    entry, start, n = struct.unpack_from("<IHH", b)
    return entry, start, [struct.unpack_from("<bb", b, 8 + 2 * k) for k in range(n)]


def pack_matrix(cells: list[tuple[int, int, float]]) -> bytes:
    """A sparse matrix of probabilities: runs along diagonals as (i u16, j u16, length u16, bytes)."""
    out, run = [], []

    def close() -> None:
        if run:
            out.append(struct.pack("<HHH", run[0][0], run[0][1], len(run)) + to_8_bit([p for _, _, p in run]).tobytes())

    for c in sorted(cells, key=lambda c: (c[1] - c[0], c[0])):
        if run and (c[1] - c[0] != run[-1][1] - run[-1][0] or c[0] != run[-1][0] + 1):
            close()
            run = []
        run.append(c)
    close()
    return b"".join(out)


def unpack_matrix(b: bytes) -> list[tuple[int, int, float]]:
    out, at = [], 0
    while at < len(b):
        i, j, n = struct.unpack_from("<HHH", b, at)
        values = from_8_bit(np.frombuffer(b, dtype=np.uint8, count=n, offset=at + 6))
        out += [(i + k, j + k, float(v)) for k, v in enumerate(values)]
        at += 6 + n
    return out
