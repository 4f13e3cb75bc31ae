"""Words of many texts at once, as numbers: hashes of words and of runs of words by array operations.

Words are runs of anything but ASCII white space, A-Z in lower case. A word's hash is a polynomial of
its bytes modulo 2^64, read off running sums, then mixed; a run's is one of its words' hashes. So no
word becomes a Python object, and memory stays within a few times the texts' own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that are summed together; a word may be longer.
BLOCK = 1 << 16
#: An odd number, so that its powers can be divided out again modulo 2^64.
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(BASE, BLOCK + 1), _powers(pow(BASE, -1, 1 << 64), BLOCK + 1)


def mixed(values: np.ndarray) -> np.ndarray:
    """Every bit of a value spread over all."""
    with np.errstate(over="ignore"):
        out = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        out = (out ^ (out >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return out ^ (out >> np.uint64(33))


def word_values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end in ``data``, and how many words each has."""
    space = SPACE[data]
    first, last = ~space, ~space
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    first[edges] = ~space[edges]
    last[edges - 1] = ~space[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        size = int(ends[to - 1] - lo)
        up, down = (_UP, _DOWN) if size <= BLOCK else (_powers(BASE, size + 1), _powers(pow(BASE, -1, 1 << 64), size + 1))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((LOWER[data[lo : lo + size]].astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
        out[at:to] = (sums[ends[at:to] - lo] - sums[starts[at:to] - lo]) * down[starts[at:to] - lo]
        at = to
    bounds = np.searchsorted(starts, offsets)
    return mixed(out), np.diff(bounds)


def of_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``word_values`` of an Arrow column of bytes without nulls."""
    _, ends, data = column.buffers()
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(ends, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) > 1 else np.zeros(0, np.uint8)
    return word_values(body, offsets - offsets[0])


def run_values(values: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words; runs over the end of a text are the caller's to leave out."""
    n = len(values) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(length):
            out = out * np.uint64(BASE) + values[i : i + n]
    return mixed(out)
