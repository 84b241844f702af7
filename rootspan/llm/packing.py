"""Arrays packed into bytes, shared by the operators that move ids between stages."""

from __future__ import annotations

import numpy as np
import zstandard


#: Level of zstd.
LEVEL = 9


def pack_ints(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers as zstd over their four byte planes."""
    raw = np.ascontiguousarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=LEVEL).compress(np.ascontiguousarray(raw.T).tobytes())


def unpack_ints(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


#: Limits of the values that pack_ranks stores in one byte, and in two.
_ONE, _TWO = 192, 192 + (60 << 8)


def pack_ranks(values: np.ndarray) -> list[bytes]:
    """Small-first integers (below 2**26) as five zstd streams: first bytes, second ones of two, the other three of four."""
    y = values.astype(np.uint32)
    two, four = np.flatnonzero((y >= _ONE) & (y < _TWO)), np.flatnonzero(y >= _TWO)
    first = y.astype(np.uint8)
    t, u = y[two] - np.uint32(_ONE), y[four] - np.uint32(_TWO)
    first[two], first[four] = _ONE + (t >> 8), 252 + (u >> 24)
    press = zstandard.ZstdCompressor(level=LEVEL).compress
    streams = first, t & 255, (u >> 16) & 255, (u >> 8) & 255, u & 255
    return [press(x.astype(np.uint8).tobytes()) for x in streams]


def unpack_ranks(packed: list[bytes]) -> np.ndarray:
    first, second, *rest = (np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).astype(np.int32) for x in packed)
    out = first.copy()
    two, four = np.flatnonzero((first >= _ONE) & (first < 252)), np.flatnonzero(first >= 252)
    out[two] = ((first[two] - _ONE) << 8) + second + _ONE
    out[four] = ((first[four] - 252) << 24) + (rest[0] << 16) + (rest[1] << 8) + rest[2] + _TWO
    return out


def pack_blobs(blobs: list[bytes]) -> tuple[bytes, bytes]:
    """Byte strings as packed lengths and their zstd-compressed concatenation."""
    sizes = np.fromiter(map(len, blobs), dtype=np.uint32, count=len(blobs))
    return pack_ints(sizes), zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(blobs))


def unpack_blobs(sizes: bytes, joined: bytes) -> list[bytes]:
    ends = np.cumsum(unpack_ints(sizes), dtype=np.int64).tolist()
    data = zstandard.ZstdDecompressor().decompress(joined)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def ragged(take: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the elements of rows ``take`` in a flat array whose rows begin at ``starts``."""
    n = sizes[take].astype(np.int64)
    total = int(n.sum())
    first = np.repeat(starts[take].astype(np.int64) - (np.cumsum(n) - n), n)
    return first + np.arange(total, dtype=np.int64)
