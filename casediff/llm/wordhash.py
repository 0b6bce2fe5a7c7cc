"""Word and word-run hashes of a text's bytes, with NumPy."""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multipliers modulo 2**64: for bytes, and two for words.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes hashed at a time.
PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (SplitMix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n of a multiplier and of its inverse."""
    found = _TABLES.get(which)
    if found is None or len(found[0]) <= n:
        size = max(n + 1, 1 << 16)
        made = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        found = _TABLES[which] = (made[0], made[1])
    return found


def _sums(x: np.ndarray, which: int) -> np.ndarray:
    out = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x * _powers(which, len(x))[0][:len(x)], out=out[1:])
    return out


def _word_hashes(data: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(_BLANK[data], prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    total = _sums(data.astype(np.uint64) + np.uint64(1), 0)
    return mix((total[end] - total[start]) * _powers(0, len(data))[1][start] + (end - start).astype(np.uint64))


def word_hashes(text: bytes, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the blank-separated words of a UTF-8 text; with ``lower``, A-Z count as a-z.

    A long text is hashed in pieces that end at blanks."""
    data = np.frombuffer(text, dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    if len(data) <= PIECE:
        return _word_hashes(data)
    out, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data):
            blank = np.flatnonzero(_BLANK[data[end:end + PIECE]])
            if len(blank):
                end += int(blank[0])
                break
            end = min(end + PIECE, len(data))
        out.append(_word_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def run_hashes(words: np.ndarray, width: int, which: int = 1) -> np.ndarray:
    """Hashes of all runs of ``width`` words; another ``which`` gives independent ones."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = _sums(words, which)
    return mix((total[width:] - total[:n]) * _powers(which, n)[1][:n])


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges ``start``..``end`` of ``data``, from prefix polynomials."""
    total = _sums(data.astype(np.uint64) + np.uint64(1), 0)
    return mix((total[end] - total[start]) * _powers(0, len(data))[1][start] + (end - start).astype(np.uint64))
