"""Benchmark decontamination by templates: the same question is found again with other numbers, names or units.

Words are canonicalised: a number becomes <number>, a unit after a number <unit>, capitalised words inside a sentence
<name>; neighbouring numbers or names are one slot. Windows of ``window`` template words are joined by hash with those of the
benchmark. A matched window pairs its slots with the item's. The slots of a document and an item are consistent when
each value of the item was replaced by one value throughout, so copies with new parameters are told from texts that
share a common phrase.

Beside them go literal windows: of words as they stand but for their case, numbers and names included, and of single characters in
scripts without spaces. An item shorter than a window is one window, so every item with a letter, digit or symbol has one. Folded windows have slots for numbers and units but none for names:
whether a word is a name hangs on its case and on what stands before it, and copies may differ there. An item may match by any of the three.

A filter of fixed size, one bit per bucket of the benchmark's window hashes, lets most windows of clean documents go before the join.
It drops nothing that could match, whatever the size of the benchmark.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.names import _VALUES, Named, blocks, bounds, combined, mixed, small, texts

WINDOW, LEAST_WINDOW = 8, 4
LEAST_LITERALS = 4
LEAST_COVER, LEAST_WINDOWS = 0.5, 5
MOST_CONFLICTS = 0.2
FILTER_BUCKETS = 1 << 22

#: Units that count as a slot after a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres mg g kg t lb lbs oz gram grams pound pounds "
    "ml l liter liters litre litres gallon gallons ms s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month "
    "months year years c f k degrees percent usd eur dollar dollars euro euros cent cents mph kmh w kw v hz kb mb gb tb"
).split()

_NUMBER, _UNIT, _NAME = 1, 2, 3

#: Kinds of windows. Where an item matches by several, the first says how.
TEMPLATE, FOLDED, LITERAL = 0, 1, 2

#: First and last characters of scripts that don't part words by spaces.
_UNSPACED = (
    (0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x30FF),
    (0x3105, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9DF), (0xAA00, 0xAADF), (0xF900, 0xFAFF),
    (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
)
_APART, _INSIDE, _ALONE = 0, 1, 2
_PLACEHOLDER = mixed(_VALUES[:4])

_PART = np.zeros(256, bool)
_PART[0x30:0x3A] = _PART[0x41:0x5B] = _PART[0x61:0x7B] = True
_PART[0x80:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:\n\"")] = True


def _unit_names() -> np.ndarray:
    joined = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    return np.sort(Named(joined).between(*bounds(joined != 0x20)))


_UNIT_NAMES = _unit_names()


def _lower(text: bytes) -> bytes:
    """Lower case with the same number of bytes."""
    lower = text.decode().lower().encode()
    return lower if len(lower) == len(text) else text.lower()


def _folded(text: bytes) -> bytes:
    return text.lower() if text.isascii() else text.decode().casefold().encode()


@cache
def _character_kinds() -> np.ndarray:
    """Of every character, whether it parts words, stands inside one or is one alone."""
    category = [unicodedata.category(chr(c)) for c in range(0x110000)]
    kinds = np.array([_INSIDE if c[0] in "LMN" else _ALONE if c in ("Sm", "Sc", "So") else _APART for c in category], np.int8)
    for a, b in _UNSPACED:
        kinds[a : b + 1][kinds[a : b + 1] == _INSIDE] = _ALONE
    return kinds


def literals(folded: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Literal words of a block of case-folded texts: text and name of each."""
    at = np.append(np.flatnonzero((folded & 0xC0) != 0x80), len(folded))
    kinds = _character_kinds()[np.frombuffer(folded.tobytes().decode().encode("utf-32-le"), np.uint32)]
    first, last = bounds(kinds == _INSIDE)
    alone = np.flatnonzero(kinds == _ALONE)
    starts, stops = np.append(at[first], at[alone]), np.append(at[last], at[alone + 1])
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], stops[order]
    return np.searchsorted(ends, starts, side="right"), Named(folded).between(starts, stops)


def templates(raw: np.ndarray, lower: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Template words of a block: text, name, kind (0 literal) and name of the value of each."""
    starts, stops = bounds(_PART[raw])
    named = Named(lower)
    names = named.between(starts, stops)
    of = np.searchsorted(ends, starts, side="right")
    second = np.minimum(starts + 1, len(raw) - 1)
    capital = (raw[starts] != lower[starts]) | ((raw[starts] >= 0xC0) & (raw[second] != lower[second]))
    number = _DIGIT[raw[starts]]
    fresh = np.append(True, of[1:] != of[:-1])[: len(of)]
    previous = np.append(0, stops[:-1])[: len(starts)]
    stop_before = np.append(0, np.cumsum(_STOP[raw]))
    begins = fresh | (stop_before[starts] > stop_before[previous])
    after_number = np.append(False, number[:-1])[: len(number)] & ~fresh
    unit = after_number & ~number & (np.searchsorted(_UNIT_NAMES, names, "right") > np.searchsorted(_UNIT_NAMES, names))
    kind = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(capital & ~begins, _NAME, 0)))
    joins = (kind == np.append(0, kind[:-1])[: len(kind)]) & ((kind == _NUMBER) | (kind == _NAME)) & ~fresh
    first = np.flatnonzero(~joins)
    last = np.append(first[1:], len(kind)) - 1
    kind, of = kind[first], of[first]
    value = named.between(starts[first], stops[last[: len(first)]]) if len(first) else names
    return of, np.where(kind > 0, _PLACEHOLDER[kind], value), kind, value


def windows_of(names: np.ndarray, kind: np.ndarray, of: np.ndarray, size: int, least: int = LEAST_LITERALS) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of ``size`` words with enough literals begin, and their names."""
    if len(names) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    literal = np.append(0, np.cumsum(kind == 0))
    at = np.flatnonzero((of[: len(of) - size + 1] == of[size - 1 :]) & (literal[size:] - literal[:-size] >= min(least, size)))
    return at, mixed(combined(names, size)[at] + np.uint64(size))


def _streams(values: list[bytes], ends: np.ndarray, wanted: Iterable[int]) -> Iterator[tuple]:
    """Kind of window, and text, name, kind and name of the value of each word, for a block of texts."""
    if TEMPLATE in wanted:
        raw, lower = (np.frombuffer(b"\n".join([*x, b""]), np.uint8) for x in (values, map(_lower, values)))
        yield TEMPLATE, *templates(raw, lower, ends)
    folded_texts = [_folded(t) for t in values]
    folded, folded_ends = np.frombuffer(b"\n".join([*folded_texts, b""]), np.uint8), np.cumsum([len(t) + 1 for t in folded_texts])
    if FOLDED in wanted:
        yield FOLDED, *templates(folded, folded, folded_ends)  # without capitals there are no names
    if LITERAL in wanted:
        of, names = literals(folded, folded_ends)
        yield LITERAL, of, names, np.zeros(len(names), np.int64), names


def _windows(
    batches: Iterator[pa.RecordBatch], sizes: dict[int, list[int]] | None, keep: np.ndarray | None, window: int
) -> Iterator[pa.RecordBatch]:
    """Windows with their slots. Without ``sizes`` the texts are items: each has windows of one size, its own if it is shorter."""
    templated = list(range(LEAST_WINDOW, window + 1))
    every = {TEMPLATE: templated, FOLDED: templated, LITERAL: list(range(1, window + 1))}
    for batch in small(batches):
        values = list(texts(batch))
        rows: list[tuple] = []
        for first, _, ends in blocks(values):
            for stream, of, names, kind, value in _streams(values[first : first + len(ends)], ends, every if sizes is None else sizes):
                counts = np.bincount(of, minlength=len(ends))
                begin = np.cumsum(counts) - counts
                signed = value.view(np.int64)
                for size in (every if sizes is None else sizes)[stream]:
                    at, w = windows_of(names, kind, of, size, 0 if stream == LITERAL else LEAST_LITERALS)
                    w = mixed(w + np.uint64(stream))
                    if sizes is None:
                        own = np.minimum(counts[of[at]], window) == size
                        at, w = at[own], w[own]
                    elif stream == LITERAL:  # one of equal windows of a text says as much as all
                        hit = np.flatnonzero(keep[(w % np.uint64(len(keep))).astype(np.int64)])
                        hit = hit[np.lexsort((w[hit], of[at[hit]]))]
                        one = np.append(True, (w[hit][1:] != w[hit][:-1]) | (of[at[hit]][1:] != of[at[hit]][:-1]))[: len(hit)]
                        at, w = at[hit[one]], w[hit[one]]
                    else:
                        hit = keep[(w % np.uint64(len(keep))).astype(np.int64)]
                        at, w = at[hit], w[hit]
                    total = np.bincount(of[at], minlength=len(ends))
                    for i, name in zip(at.tolist(), w.view(np.int64).tolist()):
                        slots = (i + np.flatnonzero(kind[i : i + size])).tolist()
                        text = int(of[i])
                        rows.append((first + text, stream, size, name, i - int(begin[text]), [int(signed[s]) for s in slots], int(total[text])))
        columns = list(zip(*rows)) or [()] * 7
        chosen = batch.select(["d", "t"]).take(pa.array(columns[0], pa.int64()))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())
        made = (pa.array(c, k) for c, k in zip(columns[1:], kinds))
        yield pa.RecordBatch.from_arrays([*chosen.columns, *made], ["d", "t", "stream", "size", "w", "at", "slots", "total"])


_WINDOW = "d bigint, t bigint, stream int, size int, w bigint, at bigint, slots array<bigint>, total bigint"


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
    cover: float = LEAST_COVER,
    windows: int = LEAST_WINDOWS,
) -> DataFrame:
    """One row per document and benchmark item that stands in it, verbatim or with other parameters.

    Columns: id, t (name of the text), item id, n_windows (different windows of the item that match), item_windows, window_words (words of a window, so
    those of the item if it is shorter than one), cover, n_verbatim (those whose
    slots are equal too), n_slots (slot values of the item that matched), n_conflicts (those replaced by several values), reparameterised. An item
    stands in a document if ``windows`` of its windows match, or a share of ``cover``, and either so many match verbatim or at most a
    fifth of its slot values conflict. The counts are those of template windows if the item stands there by them, else of folded or then literal ones,
    which have no slots. Items without a letter, digit or symbol and null texts match nothing; items shorter than the window are one
    window, which an ordinary sentence may hold by chance: ``window_words`` tells. Items that repeat an id are one item, rows that repeat an id and a text one document. An empty benchmark gives no rows.
    """
    item_id, item_text = F.col(item_column).cast("long"), F.coalesce(F.col(item_text_column), F.lit(""))
    items = benchmark.select(item_id.alias("d"), F.xxhash64(item_text).alias("t"), item_text.alias("text"))
    asked = items.mapInArrow(lambda b: _windows(b, None, None, window), _WINDOW).withColumnsRenamed(
        {"d": "item", "t": "it", "slots": "item_slots", "at": "item_at", "total": "item_windows"}
    )
    asked = asked.distinct()
    buckets = asked.select(_bucket("w"), "stream", "size").distinct().toArrow()
    keep = np.zeros(FILTER_BUCKETS, bool)
    keep[buckets.column("bucket").to_numpy()] = True
    sizes: dict[int, list[int]] = {}
    for stream, size in sorted(set(zip(buckets.column("stream").to_pylist(), buckets.column("size").to_pylist()))):
        sizes.setdefault(stream, []).append(size)
    asked = asked.withColumnRenamed("size", "item_size").drop("stream")
    text = F.coalesce(F.col(text_column), F.lit(""))
    read = docs.select(F.col(id_column).cast("long").alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
    seen = read.mapInArrow(lambda b: _windows(b, sizes, keep, window), _WINDOW).drop("total", "at", "size")
    matched = seen.join(asked, "w").withColumn("same", F.col("slots") == F.col("item_slots"))
    key = ["d", "t", "item", "stream"]
    window_row = F.struct("item_at", "it", "item_windows", "item_size", F.col("same").cast("long").alias("same"), *(F.lit(None).cast("long").alias(c) for c in ("was", "now")))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("item_at", "long"), ("it", "long"), ("item_windows", "long"), ("item_size", "int"), ("same", "long"))]
    slot_rows = F.transform(F.arrays_zip("item_slots", "slots"), lambda p: F.struct(*none, p.item_slots.alias("was"), p.slots.alias("now")))
    rows = matched.select(*key, F.explode(F.concat(F.array(window_row), slot_rows)).alias("r")).select(*key, "r.*")  # windows and slots in one pass
    once = rows.groupBy(*key, "item_at", "it", "was").agg(
        F.max("item_windows").alias("item_windows"), F.max("item_size").alias("item_size"), F.max("same").alias("same"), (F.min("now") != F.max("now")).cast("long").alias("conflict")
    )
    found = once.groupBy(*key).agg(
        F.count("item_at").alias("n_windows"),
        F.max("item_windows").alias("item_windows"),
        F.max("item_size").alias("window_words"),
        F.sum("same").alias("n_verbatim"),
        F.count("was").alias("n_slots"),
        F.coalesce(F.sum("conflict"), F.lit(0)).alias("n_conflicts"),
    )
    enough = "({n} >= %d OR {n} >= %s * item_windows)" % (windows, cover)
    standing = found.where(f"{enough.format(n='n_windows')} AND ({enough.format(n='n_verbatim')} OR n_conflicts <= {MOST_CONFLICTS} * n_slots)")
    counted = F.struct("n_windows", "item_windows", "window_words", "n_verbatim", "n_slots", "n_conflicts")
    return (
        standing.groupBy("d", "t", "item")
        .agg(F.min_by(counted, "stream").alias("by"))
        .select("d", "t", "item", "by.*")
        .select(
            F.col("d").alias(id_column),
            "t",
            F.col("item").alias(item_column),
            "n_windows",
            "item_windows",
            "window_words",
            F.least(F.col("n_windows") / F.col("item_windows"), F.lit(1.0)).alias("cover"),
            "n_verbatim",
            "n_slots",
            "n_conflicts",
            (F.col("n_verbatim") < F.col("n_windows")).alias("reparameterised"),
        )
    )


def _bucket(column: str) -> Column:
    """The filter bucket of a signed window name, as numpy has it for the unsigned one."""
    return F.expr(f"{column} & {FILTER_BUCKETS - 1}").alias("bucket")
