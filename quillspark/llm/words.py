"""Words of UTF-8 text as 64-bit hashes, for whole Arrow batches at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_RNG = np.random.default_rng(20240517)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_R = _U(0x9E3779B97F4A7C15)
_RINV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

#: Bytes that are words once A-Z is lowered: digits, a-z and all of non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: All bytes but the blank and 0x09 to 0x0D.
NONSPACE = np.ones(256, bool)
NONSPACE[0x20] = NONSPACE[0x09:0x0E] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 20), base, np.uint64)
        x[0] = 1
        have = _POWERS[name] = np.multiply.accumulate(x)
    return have


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def pieces(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about limit bytes."""
    data, offs = utf8(column)
    lo = 0
    while lo < len(offs) - 1:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def spans(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    is_in = inside[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    begin = is_in.copy()
    begin[1:] &= ~is_in[:-1] | cut[1:n]
    end = is_in.copy()
    end[:-1] &= ~is_in[1:] | cut[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hashes(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word with A-Z lowered, and for each row the index of its first word."""
    starts, ends, first = spans(data, offs, inside)
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[LOWER][data] * _powers("r", _R, n)[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * _powers("i", _RINV, n + 1)[starts]), first


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row, sorted, one after another, and where each row's begin.

    A row of fewer words but not none has its whole sequence as one shingle.
    """
    n = len(words)
    grams = words.copy()
    for j in range(1, k):
        grams[: n - j] = mix(grams[: n - j] * _U(3) + words[j:] * _U(0x2545F4914F6CDD1D)) if n > j else grams[: n - j]
    out, begins = [], np.zeros(len(first), np.int64)
    for d in range(len(first) - 1):
        lo, hi = int(first[d]), int(first[d + 1])
        if hi - lo >= k:
            x = np.unique(grams[lo : hi - k + 1])
        elif hi > lo:
            x = words[lo : lo + 1].copy()
            for j in range(1, hi - lo):
                x = mix(x * _U(3) + words[lo + j : lo + j + 1] * _U(0x2545F4914F6CDD1D))
            x = mix(x + _U(hi - lo))
        else:
            x = words[:0]
        out.append(x)
        begins[d + 1] = begins[d] + len(x)
    return (np.concatenate(out) if out else words[:0]), begins
