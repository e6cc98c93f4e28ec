"""64-bit names of byte strings, so that equal strings get equal names wherever they stand.

A name is a polynomial over random values of the bytes, modulo 2**64, taken from prefix sums; so the
names of all substrings of a text cost one pass, and the name of a word doesn't depend on its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 16), base, np.uint64)
        table[0] = 1
        _powers[base] = table = np.multiply.accumulate(table)
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the differences of a name over all its bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combined(names: np.ndarray, n: int) -> np.ndarray:
    """Names of all runs of ``n`` consecutive names."""
    out = names[: max(len(names) - n + 1, 0)].copy()
    for i in range(1, n):
        out = mixed(out * np.uint64(_BASE) + names[i : i + len(out)])
    return out


class Named:
    """The substrings of a byte array by name."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[data] * _power_table(_BASE, n)[:n], out=self.sums[1:])
        self._inverse = _power_table(pow(_BASE, -1, 1 << 64), n + 1)

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self._inverse[starts])

    def grams(self, n: int) -> np.ndarray:
        """Names of all substrings of ``n`` bytes."""
        count = max(len(self.sums) - n, 0)
        return mixed((self.sums[n:] - self.sums[:count]) * self._inverse[:count])


def bounds(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], is_word.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words between ASCII white space."""
    return bounds(~_SPACE[data])


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of a column, one text at a time; null counts as empty."""
    for value in batch.column(column).cast(pa.large_binary()):
        yield value.as_py() or b""


def signed(names: np.ndarray) -> pa.Array:
    return pa.array(names.view(np.int64))


_PIECE = 1 << 20


def span_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of spans in ascending order; long arrays are named in pieces."""
    if len(data) <= _PIECE:
        return Named(data).between(starts, ends)
    names, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PIECE)))
        named = Named(data[starts[i] : ends[j - 1]])
        names[i:j] = named.between(starts[i:j] - starts[i], ends[i:j] - starts[i])
        i = j
    return names


def word_names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and name of every word between ASCII white space."""
    starts, ends = word_bounds(data)
    return starts, ends, span_names(data, starts, ends)


def blocks(values: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in blocks of about a megabyte: number of the first text, the bytes with a line feed after each text, their ends."""
    first, held, size = 0, [], 0
    for i, text in enumerate(values):
        if held and size + len(text) > _PIECE:
            yield first, np.frombuffer(b"\n".join([*held, b""]), np.uint8), np.cumsum([len(t) + 1 for t in held])
            first, held, size = i, [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield first, np.frombuffer(b"\n".join([*held, b""]), np.uint8), np.cumsum([len(t) + 1 for t in held])


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
