"""Words of Arrow text columns as 64-bit hashes, computed on whole buffers with numpy.

Text is taken in slices of about ``SLICE`` bytes, so a task's memory depends on one slice (and the hashes of one document), not
on the batch. Upper-case A-Z count as lower case; words are runs of bytes other than blank and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
#: For words without punctuation: everything in ASCII but letters and digits separates.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_VALUE = np.random.RandomState(20240229).randint(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLES: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if not _TABLES or len(_TABLES[0]) < n:
        size = max(SLICE + 64, 1 << (n - 1).bit_length())
        _TABLES.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _TABLES.append(np.cumprod(table, dtype=np.uint64, out=table))
    return _TABLES[0], _TABLES[1]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts (one more entry than rows); null is empty."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "").cast(pa.large_binary())
    _, at, data = column.buffers()
    starts = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), starts


def _hashed(data: np.ndarray, bounds: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``data`` and the start of each word; ``bounds`` (starts of rows) also separate words."""
    n = len(data)
    inside = ~blank[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUE[_LOWER[data]] * up[:n], out=total[1:])
    return mixed((total[end] - total[start]) * down[start]), start


def word_hashes(column: pa.Array, blank: np.ndarray = _BLANK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of rows: first row, row after the last, the words' hashes, and how many words each row has."""
    data, starts = bytes_of(column)
    row, rows = 0, len(column)
    while row < rows:
        end = int(np.searchsorted(starts, starts[row] + SLICE, "right")) - 1
        if end > row:
            lo, hi = starts[row], starts[end]
            h, at = _hashed(data[lo:hi], starts[row:end] - lo, blank)
            # an empty row and its successor start at the same byte: the word belongs to the last row that starts there
            owner = np.searchsorted(starts[row : end + 1] - lo, at, "right") - 1
            yield row, end, h, np.bincount(owner, minlength=end - row)[: end - row]
            row = end
        else:  # one long text, cut at blanks
            lo, hi, parts = int(starts[row]), int(starts[row + 1]), []
            while lo < hi:
                cut = min(hi, lo + SLICE)
                while cut < hi and not blank[data[cut]]:
                    more = np.flatnonzero(blank[data[cut : min(hi, cut + SLICE)]])
                    cut = cut + int(more[0]) if len(more) else min(hi, cut + SLICE)
                parts.append(_hashed(data[lo:cut], np.zeros(1, np.int64), blank)[0])
                lo = cut
            h = np.concatenate(parts)
            yield row, row + 1, h, np.array([len(h)])
            row += 1


def joined(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words (fewer entries by n - 1)."""
    out = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    for i in range(n):
        out = mixed(out + words[i : len(words) - n + 1 + i] * np.uint64(2 * i + 1) + np.uint64(i + 1))
    return out


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and its sorted distinct n-word shingles as int64; a shorter text is one shingle, one without words none."""
    for row, end, words, counts in word_hashes(column):
        runs, at = joined(words, n), 0
        for i in range(end - row):
            k = int(counts[i])
            if k >= n:
                own = np.sort(runs[at : at + k - n + 1].view(np.int64))
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif k:
                own = mixed(joined(words[at : at + k], k) + np.uint64(0x5EED + k)).view(np.int64)
            else:
                own = np.zeros(0, np.int64)
            at += k
            yield row + i, own


def set_mark(own: np.ndarray) -> int:
    """One 64-bit number for a sorted set of shingles (expected clashes among d sets: d*d / 2**65)."""
    if not len(own):
        return 0
    x = mixed(own.view(np.uint64))
    turned = mixed(x + np.uint64(len(own)))
    return int((mixed(np.array([x.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(turned)])))[0].view(np.int64))
