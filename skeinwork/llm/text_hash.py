"""Words of Arrow string columns as 64-bit hashes, whole batches at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from skeinwork.llm.common import kept_until_released

#: Bytes hashed at once; texts in one chunk; the temporaries take some ten times as much.
PIECE, CHUNK = 1 << 20, 1 << 21

_U = np.uint64
_R, _B = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown when asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.clear()
        kept_until_released(self.clear)

    def clear(self) -> None:
        self.up, self.down = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = powers(self.base, size), powers(self.inverse, size)
        return self.up, self.down


_bytes, _words = _Powers(_R), _Powers(_B)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def blanks_table(lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes part words (the ASCII blanks), and what each byte counts as."""
    part = np.zeros(256, bool)
    part[[0x20, *range(0x09, 0x0E)]] = True
    same = np.arange(256)
    if lower:
        same[ord("A") : ord("Z") + 1] += 32
    return part, _TABLE[same]


def letters_table() -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters, lower-cased: ASCII letters and all bytes of other characters."""
    part = np.ones(256, bool)
    for c in (*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)):
        part[c] = False
    return part, blanks_table(lower=True)[1]


def words(data: np.ndarray, starts: np.ndarray, tables: tuple[np.ndarray, np.ndarray], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Start, end and hash of the words of texts that lie one after another in data.

    starts: where each text starts. prefixes: byte lengths at which a word's beginning is
    hashed too. Works piece by piece, so its memory doesn't grow with a text.
    """
    part, value = tables
    inside = ~part[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    at = starts[(starts > 0) & (starts < len(data))]
    opens[at] = inside[at]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | opens[1:]
    s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    out = np.empty(len(s), np.uint64)
    more = [np.empty(len(s), np.uint64) for _ in prefixes]
    up, down = _bytes.get(PIECE)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + PIECE, side="right")))
        a, b = int(s[i]), int(e[j - 1])
        if b - a > PIECE:  # one word longer than a piece
            up, down = _bytes.get(b - a)
        c = np.zeros(b - a + 1, np.uint64)
        np.cumsum(value[data[a:b]] * up[: b - a], out=c[1:])
        at, end = s[i:j] - a, e[i:j] - a
        out[i:j] = mix((c[end] - c[at]) * down[at] + (end - at).astype(np.uint64))
        for k, h in zip(prefixes, more):
            h[i:j] = mix((c[np.minimum(end, at + k)] - c[at]) * down[at] + _U(0xA5A5A5A5 * (k + 1)))
        i = j
    return s, e, out, more


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k neighbouring words, by their first word."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _words.get(n + 1)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=c[1:])
    return mix((c[k:] - c[:-k]) * down[: n - k + 1])


def sequence(hashes: np.ndarray) -> int:
    """Hash of a whole sequence of any length."""
    n = len(hashes)
    up, _ = _words.get(max(n, 1))
    return int(mix(np.array([np.sum(hashes * up[:n], dtype=np.uint64) + _U(0xC0FFEE * (n + 1))], np.uint64))[0])


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its texts; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, bytes and offsets of runs of texts of some size together."""
    data, offsets = texts(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
