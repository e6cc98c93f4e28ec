"""Terms of texts as byte spans: found, named and told apart without a Python object per occurrence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from fleetlens.llm.names import blocks, bounds, span_names

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of a term once A-Z are lower-cased: letters and all beyond ASCII, and those with digits.
LETTERS = np.zeros(256, bool)
LETTERS[ord("a") : ord("z") + 1] = LETTERS[0x80:] = True
LETTERS_DIGITS = LETTERS.copy()
LETTERS_DIGITS[ord("0") : ord("9") + 1] = True

_COMPARED, _LONG = 1 << 20, 1 << 12


def spans(values: list[bytes], of_term: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of texts: number of the first text, texts, lower-cased bytes, starts and ends of terms, text of each term from 0."""
    for first, raw, text_ends in blocks(values):
        data = _LOWER[raw]
        starts, ends = bounds(of_term[data])
        yield first, len(text_ends), data, starts, ends, np.searchsorted(text_ends, starts, side="right")


def flat(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all bytes of the spans, one span after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def _unequal(data: np.ndarray, starts: np.ndarray, others: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which spans of equal lengths differ in a byte."""
    out = np.zeros(len(starts), bool)
    for i in np.flatnonzero(lengths > _LONG).tolist():
        n = int(lengths[i])
        out[i] = not np.array_equal(data[starts[i] : starts[i] + n], data[others[i] : others[i] + n])
    short = np.flatnonzero(lengths <= _LONG)
    upto = np.cumsum(lengths[short])
    a = 0
    while a < len(short):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + _COMPARED, side="right")))
        some = short[a:b]
        differ = np.flatnonzero(data[flat(starts[some], lengths[some])] != data[flat(others[some], lengths[some])])
        out[some[np.searchsorted(upto[a:b] - (upto[a - 1] if a else 0), differ, side="right")]] = True
        a = b
    return out


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each span's string, and for each number a span that holds it. Names find equal strings, bytes decide."""
    if not len(names):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(names, kind="stable")
    new = np.append(True, names[order[1:]] != names[order[:-1]])
    number = np.empty(len(names), np.int64)
    number[order] = np.cumsum(new) - 1
    holder = order[new]
    again = np.flatnonzero(holder[number] != np.arange(len(names)))
    held, lengths = holder[number[again]], (ends - starts)[again]
    same_length = lengths == (ends - starts)[held]
    differ = ~same_length
    at = np.flatnonzero(same_length)
    differ[at] = _unequal(data, starts[again[at]], starts[held[at]], lengths[at])
    more: dict[tuple[int, bytes], int] = {}
    holders = [holder]
    for i in again[differ].tolist():
        key = (int(names[i]), data[starts[i] : ends[i]].tobytes())
        if key not in more:
            more[key] = len(holder) + len(more)
            holders.append(np.array([i]))
        number[i] = more[key]
    return number, np.concatenate(holders)


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an Arrow column of strings."""
    lengths = ends - starts
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    held = data[flat(starts, lengths)].tobytes()
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(held)])


def named(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int = 64) -> np.ndarray:
    """Names of spans, cut to their lowest ``bits``."""
    return span_names(data, starts, ends) & np.uint64((1 << bits) - 1)
