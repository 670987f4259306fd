"""RICE_1 tiles: the entropy code of tile-compressed FITS images.

A tile starts with its first value, big-endian.  Differences of neighbours are folded to
non-negative integers and coded in blocks; a block starts with its split width plus one
(``FS_BITS`` bits): 0 for a block of zeros, the greatest width + 1 for raw values, else each value
is a run of zeros ended by a one, and the low bits.

A code's place depends on all codes before it, so one tile cannot be read in parallel, but the
tiles of an image are independent: ``decode_tiles`` takes one value of every tile in each step.
"""

from __future__ import annotations

import numpy as np

#: Fixed by the format, by bytes in a value: bits that code the split width, the width that marks raw values, bits of a raw value.
FS_BITS = {1: 3, 2: 4, 4: 5}
FS_MAX = {1: 6, 2: 14, 4: 25}
RAW_BITS = {1: 8, 2: 16, 4: 32}
TILES = 1024  # tiles decoded together


class RiceError(ValueError):
    """A tile that ends before its values do."""


class _Streams:
    """Bit positions in the bytes of several tiles, read as 64-bit windows."""

    def __init__(self, tiles: list[bytes]):
        buf = np.frombuffer(b"".join(tiles) + bytes(16), np.uint8)
        self.windows = np.lib.stride_tricks.as_strided(buf.view(np.uint8)[:8].view(">u8"), (len(buf) - 7,), (1,), writeable=False)
        self.buf = buf
        size = np.array([len(t) for t in tiles], np.int64)
        self.end = np.cumsum(size) * 8
        self.at = self.end - size * 8

    def window(self, at: np.ndarray) -> np.ndarray:
        """57 or more bits from each position, left-aligned; positions behind the end read its last bytes."""
        w = self.windows[np.minimum(at >> 3, len(self.windows) - 1)].astype(np.uint64)
        return w << (at & 7).astype(np.uint64)

    def take(self, some: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        """The next ``n`` bits (0 to 56) of some tiles."""
        n = np.asarray(n)
        w = self.window(self.at[some])
        self.at[some] += n
        return ((w >> np.uint64(1)) >> (63 - n).astype(np.uint64)).astype(np.int64)

    def zeros(self, some: np.ndarray) -> np.ndarray:
        """Length of the run of zeros that a one ends."""
        total, open_ = np.zeros(len(some), np.int64), np.arange(len(some))
        while len(open_):
            who = some[open_]
            top = (self.window(self.at[who]) >> np.uint64(16)).astype(np.float64)  # 48 bits are exact
            run = 48 - np.frexp(top)[1].astype(np.int64)
            ended = top > 0
            total[open_] += run
            self.at[who] += run + ended
            open_ = open_[~ended]
            if len(open_) and (self.at[some[open_]] > self.end[some[open_]]).any():
                raise RiceError("a tile ends inside a code")
        return total


def decode_tiles(tiles: list[bytes], count: int, block: int = 32, width: int = 4) -> np.ndarray:
    """``count`` integers of ``width`` bytes from each tile, a row a tile."""
    out = np.empty((len(tiles), count), np.int32)
    for i in range(0, len(tiles) if count else 0, TILES):
        out[i : i + TILES] = _decode(tiles[i : i + TILES], count, block, width)
    return out


def _decode(tiles: list[bytes], count: int, block: int, width: int) -> np.ndarray:
    fs_bits, fs_max, raw = FS_BITS[width], FS_MAX[width], RAW_BITS[width]
    s, every = _Streams(tiles), np.arange(len(tiles))
    first, folded = s.take(every, raw), np.zeros((count, len(tiles)), np.int64)
    for i in range(0, count, block):
        fs = s.take(every, fs_bits) - 1
        plain, whole = np.flatnonzero((fs >= 0) & (fs < fs_max)), np.flatnonzero(fs >= fs_max)
        if (fs > fs_max).any():
            raise RiceError("a split width beyond the greatest")
        low = fs[plain]
        for j in range(i, min(i + block, count)):
            if len(plain):
                high = s.zeros(plain)
                folded[j, plain] = high << low | s.take(plain, low)
            if len(whole):
                folded[j, whole] = s.take(whole, raw)
    if (s.at > s.end).any():
        raise RiceError("a tile ends before its values")
    diff = (folded >> 1) ^ -(folded & 1)
    diff[0] += first
    x = np.cumsum(diff, axis=0).T & ((1 << raw) - 1)
    return np.where(x >= 1 << (raw - 1), x - (1 << raw), x) if width > 1 else x  # values of one byte are unsigned


def decode(data: bytes, count: int, block: int = 32, width: int = 4) -> np.ndarray:
    """``count`` integers of ``width`` bytes from one tile."""
    return decode_tiles([data], count, block, width)[0].astype(np.int64)


def encode(values: np.ndarray, block: int = 32, width: int = 4) -> bytes:
    """One tile; the split width of each block is the cheapest."""
    fs_bits, fs_max, raw = FS_BITS[width], FS_MAX[width], RAW_BITS[width]
    v = values.astype(np.int64)
    if not len(v):
        return b""
    lim = 1 << (raw - 1)
    diff = (np.diff(np.r_[v[:1], v]) + lim) % (2 * lim) - lim
    f = np.where(diff < 0, -2 * diff - 1, 2 * diff)
    starts = np.arange(0, len(f), block)
    n = np.diff(np.r_[starts, len(f)])
    cost = np.stack([np.add.reduceat(f >> k, starts) + n * (k + 1) for k in range(fs_max)])
    fs = cost.argmin(0)
    fs = np.where(cost.min(0) >= raw * n, fs_max, fs)
    fs = np.where(np.maximum.reduceat(f, starts) == 0, -1, fs)
    k = np.repeat(fs, n)
    high = np.where((k >= 0) & (k < fs_max), f >> np.maximum(k, 0), 0)
    low_bits = np.where(k < 0, 0, np.where(k == fs_max, raw, k))
    size = low_bits + np.where((k >= 0) & (k < fs_max), high + 1, 0)
    head = np.zeros(len(f), np.int64)
    head[starts] = fs_bits
    end = raw + np.cumsum(size + head)
    bits = np.zeros(int(end[-1]), np.uint8)

    def put(at: np.ndarray, x: np.ndarray, bits_: np.ndarray) -> None:
        for b in range(int(bits_.max(initial=0))):  # the b-th bit from the right
            some = bits_ > b
            bits[at[some] + bits_[some] - 1 - b] = x[some] >> b & 1

    put(np.zeros(1, np.int64), v[:1] & ((1 << raw) - 1), np.array([raw]))
    put((end - size)[starts] - fs_bits, fs + 1, np.full(len(starts), fs_bits))
    coded = (k >= 0) & (k < fs_max)
    bits[(end - low_bits - 1)[coded]] = 1
    put(end - low_bits, f, low_bits)
    return np.packbits(bits).tobytes()
