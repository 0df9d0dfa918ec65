"""Word hashes of whole Arrow batches, in numpy passes over their bytes.

A word's 64-bit hash is a polynomial over its bytes, taken from one running sum over the text and
then mixed; no Python object is made for a word. Memory is bounded by GROUP bytes of text (or one
text, where that is longer) times a small factor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUP = 4 << 20
BLOCK = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: \x20 and \x09-\x0D
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: The same and all other ASCII that is neither letter nor digit
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, BLOCK + 1)
            inverse = np.uint64(pow(int(_P), -1, 1 << 64))
            for name, p in (("up", _P), ("down", inverse)):
                a = np.full(n, p, dtype=np.uint64)
                a[0] = 1
                setattr(cls, name, np.cumprod(a, dtype=np.uint64))
        return cls.up, cls.down


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of ``buf``; spans ascend and don't overlap."""
    return prefix_hashes(buf, starts, ends, ())[0]


def prefix_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the spans, then for each length those of the spans' first bytes (of a span that is
    no longer than that: 0)."""
    out = [np.zeros(len(starts), dtype=np.uint64) for _ in range(len(lengths) + 1)]
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK, side="right")))
        hi = int(ends[j - 1])
        up, down = _Powers.of(hi - lo + 1)
        run = np.empty(hi - lo + 1, dtype=np.uint64)
        run[0] = 0
        np.cumsum((buf[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=run[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        base, scale = run[s], down[s]
        out[0][i:j] = mix((run[e] - base) * scale)
        for n, k in enumerate(lengths, 1):
            long = np.flatnonzero(e - s > k)
            out[n][i + long] = mix((run[s[long] + k] - base[long]) * scale[long]) ^ np.uint64(k)
        i = j
    return out


def member_of(table: np.ndarray) -> np.ndarray:
    """For a sorted table of hashes: which values of their first 20 bits occur."""
    there = np.zeros(1 << 20, dtype=bool)
    there[(table >> np.uint64(44)).astype(np.int64)] = True
    return there


def look_up(h: np.ndarray, table: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``h`` of the hashes that are in the sorted table, and their places there."""
    if not len(table):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(there[(h >> np.uint64(44)).astype(np.int64)])
    place = np.minimum(np.searchsorted(table, h[at]), len(table) - 1)
    same = table[place] == h[at]
    return at[same], place[same]


def fold_letters(buf: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the Latin-1 letters, in UTF-8 bytes."""
    low = LOWER[buf]
    if len(buf) > 1:
        upper = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
        low[upper] += 32
    return low


class Group:
    """Some whole texts of a batch. ``offsets``: where each begins in ``raw``, and the end."""

    def __init__(self, first: int, raw: np.ndarray, offsets: np.ndarray):
        self.first, self.raw, self.offsets = first, raw, offsets
        self.n = len(offsets) - 1

    def cut(self, separators: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the words: longest runs without separators in a text."""
        word = ~separators[buf]
        n = len(buf)
        begin, last = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        o = self.offsets
        at = o[:-1][o[:-1] < n]
        begin[at] = word[at]
        at = o[1:][o[1:] > 0] - 1
        last[at] = word[at]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(o, starts, side="right") - 1


def groups(texts: pa.Array) -> Iterator[Group]:
    """The texts of an Arrow string array, null as empty, in groups of about GROUP bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    n = len(texts)
    if n == 0:
        return
    offs = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + GROUP, side="right")) - 1)
        j = min(j, n)
        yield Group(i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j
