"""Removal of long byte strings that stand in more than one place, by suffix sorting.

Sorting the suffixes of a whole corpus would move every byte many times. Here only what can repeat
is sorted. Every window of ``WINDOW`` bytes has an anchor: its GRAM-byte substring with the
smallest name, leftmost on ties. Equal windows have equal anchors at equal places, so a window can only repeat
inside the group of its anchor's name. The windows that share one anchor form a segment of the text.

1. Spark counts segments by anchor, with the least and largest name of a whole segment, combined map-side. Only segments whose anchor repeats go on; a
   segment found twice repeats in full.
2. Segments that differ though their anchor repeats go to the task of their anchor's bucket. There
   bucket-pointer refinement sorts their suffixes to the depth of a window: buckets of 8-byte q-grams, refined by
   sorting on the bucket pointers of later offsets. Each pass reads the pointers the last one has
   refined, so the sorted depth doubles; suffixes alone in their bucket leave.
3. A bucket with more than ``bucket_rows`` different segments is dealt out to several tasks by salt. What is
   single within a salt meets the other salts as the name of its window, in a second grouped sum.

Anchors and windows are compared by two 64-bit names or byte by byte. Texts of any length are
read in blocks. A segment never grows beyond 2 * WINDOW - GRAM bytes. A document goes by one name of its id and text. Texts are shuffled once: the join that gets
the bytes of segments and the one that gets the ranges of documents read the same exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from fleetlens.llm.names import Named, signed, small, texts
from fleetlens.plans.shared import stored

WINDOW, GRAM = 200, 64
BUCKET_ROWS = 4096

_BLOCK = 1 << 20
_CHUNK = 1 << 20
_PLACE_BITS = np.uint64(22)


def anchors(data: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor name, segment name, first and last window start of each segment of one block."""
    named = Named(data)
    grams = named.grams(gram)
    places = np.arange(len(grams), dtype=np.uint64)
    low = (grams >> _PLACE_BITS << _PLACE_BITS) | places
    width, span = window - gram + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    place = (low & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], len(place)) - 1
    return grams[place[first]], named.between(first, last + window), first, last


def _segments(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Anchor, name, document and place (first start times ``window``, plus what the last start is beyond it) of every segment."""
    for batch in small(batches):
        found = []
        for at, text in enumerate(texts(batch)):
            data = np.frombuffer(text, np.uint8)
            for begin in range(0, len(data) - window + 1, _BLOCK):
                h, f, lo, hi = anchors(data[begin : begin + _BLOCK + window - 1], window, gram)
                found.append((np.full(len(h), at), h, f, (lo + begin) * window + (hi - lo)))
        if found:
            at, h, f, place = (np.concatenate(column) for column in zip(*found))
            yield pa.RecordBatch.from_arrays([signed(h), signed(f), batch.column("r").take(pa.array(at)), pa.array(place)], ["h", "f", "r", "place"])


def repeated_starts(segments: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each segment, which of its windows equal another one, by bucket-pointer refinement."""
    sizes = np.array([len(s) for s in segments])
    data = np.frombuffer(b"".join(segments), np.uint8)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(data))
    q = min(8, window)
    keys = np.zeros(len(data), np.uint64)
    for i in range(q):
        keys[: len(data) - i] |= data[i:].astype(np.uint64) << np.uint64(8 * (q - 1 - i))
    at = np.flatnonzero(left >= q)
    pointer = np.full(len(data) + window, -1, np.int64)
    at = _refine(pointer, at, keys[at])
    depth = q
    while depth < window:
        step = min(depth, window - depth)
        later = pointer[at + step]
        met = (later >= 0) & (left[at] >= depth + step)
        pointer[at[~met]] = -1
        at, later = at[met], later[met]
        at = _refine(pointer, at, pointer[at] << 32 | later)
        depth += step
    return [pointer[e - s : e - window + 1] >= 0 for s, e in zip(sizes, ends)]


def _refine(pointer: np.ndarray, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Sort suffixes by key and point each to the end of its bucket; those alone in theirs leave."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.diff(keys) != 0)
    ends = np.append(new, len(keys) - 1) if len(keys) else new
    sizes = np.diff(ends, prepend=-1)
    single = np.repeat(sizes == 1, sizes)
    pointer[at[order]] = np.where(single, -1, np.repeat(ends, sizes))
    return at[order[~single]]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges[::2], edges[1::2] - 1


_FOUND = "r bigint, lo bigint, hi bigint, h bigint, w bigint"


def _asked_segments(batches: Iterator[pa.RecordBatch], window: int, text_column: str) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments asked of each document."""
    for batch in small(batches):
        out: list[tuple] = []
        rows = batch.column("doc").field(text_column).cast(pa.large_binary())
        for text, r, asked in zip(rows, batch.column("r").to_pylist(), batch.column("asked").to_pylist()):
            whole = text.as_py() or b""
            for a in asked:
                lo, more = divmod(a["place"], window)
                out.append((a["h"], a["salt"], r, lo, a["single"], a["salts"], whole[lo : lo + more + window]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
        columns = [pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 7, kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["h", "salt", "r", "lo", "single", "salts", "segment"])


_SEGMENTS = "h bigint, salt bigint, r bigint, lo bigint, single boolean, salts bigint, segment binary"


def _sorted_buckets(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Sort chunks of whole buckets; rows come in order of (h, salt, r, lo), and one of equal rows counts."""
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("h", "salt", "r", "lo", "single", "salts", "segment"))):
            if rows and row[:4] == rows[-1][:4]:
                continue
            if held >= _CHUNK and row[:2] != rows[-1][:2]:
                yield _found(rows, window)
                rows, held = [], 0
            rows.append(row)
            held += len(row[-1])
    if rows:
        yield _found(rows, window)


def _found(rows: list[tuple], window: int) -> pa.RecordBatch:
    """Ranges that repeat, and by name the windows that may repeat in another salt: once each if they repeat in this one."""
    out: list[tuple] = []
    seen: set[tuple] = set()
    for (h, salt, r, lo, single, salts, segment), again in zip(rows, repeated_starts([row[-1] for row in rows], window)):
        if single:
            out += [(r, lo + int(a), lo + int(b), h, None) for a, b in zip(*_runs(again))]
        if salts > 1:
            names = Named(np.frombuffer(segment, np.uint8)).grams(window).view(np.int64)
            for i, (a, w) in enumerate(zip(again.tolist(), names.tolist())):
                if single and not a:
                    out.append((r, lo + i, lo + i, h, w))
                elif (h, salt, w) not in seen:
                    seen.add((h, salt, w))
                    out.append((None, None, None, h, w))
    columns = list(zip(*out)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["r", "lo", "hi", "h", "w"])


def _row_name(id_column: str, text_column: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63))), F.col(id_column).isNull(), F.coalesce(F.col(text_column), F.lit(""))).alias("r")


def _ranges(rows: DataFrame, text: Column, text_column: str, window: int, gram: int, bucket_rows: int) -> DataFrame:
    """Ranges of windows that also stand elsewhere: r, lo and hi (first and last start). ``rows`` are (r, doc), whose ``text_column`` is ``text``."""
    read = rows.select("r", F.coalesce(text, F.lit("")).alias("text"))
    segments = read.mapInArrow(lambda b: _segments(b, window, gram), "h bigint, f bigint, r bigint, place bigint")
    repeating = segments.groupBy("h").agg(F.count(F.lit(1)).alias("nh"), (F.min("f") != F.max("f")).alias("differ")).where("nh > 1").drop("nh")
    hits = stored(segments.join(stored(repeating, "anchors"), "h"), "repeats")  # a plain join, so a hot anchor is split
    place = {"lo": F.expr(f"place div {window}"), "hi": F.expr(f"place div {window} + place % {window}")}
    classes = hits.where("differ").groupBy("h", "f").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("r", "place")).alias("first"))
    classes = stored(classes, "classes")
    whole = hits.where("NOT differ").select("r", "place")
    whole = whole.unionByName(hits.where("differ").join(classes.where("n > 1").select("h", "f"), ["h", "f"]).select("r", "place"))
    salts = classes.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / bucket_rows).alias("salts"))
    differing = classes.join(salts, "h").select("h", "salts", "first.*", (F.col("n") == 1).alias("single"))
    asked = differing.withColumn("salt", F.expr("pmod(xxhash64(r, place), salts)")).groupBy("r")
    asked = asked.agg(F.collect_list(F.struct("h", "salt", "place", "single", "salts")).alias("asked"))
    with_bytes = rows.join(asked, "r").select("r", "doc", "asked").mapInArrow(lambda b: _asked_segments(b, window, text_column), _SEGMENTS)
    in_order = with_bytes.repartition("h", "salt").sortWithinPartitions("h", "salt", "r", "lo")
    found = in_order.mapInArrow(lambda b: _sorted_buckets(b, window), _FOUND)
    same_window = Window.partitionBy("h", F.coalesce("w", F.xxhash64("r", "lo")))
    late = F.expr("w IS NULL OR (lo IS NOT NULL AND n > 1)")
    found = found.withColumn("n", F.count(F.lit(1)).over(same_window)).where(late)
    return whole.withColumns(place).select("r", "lo", "hi").unionByName(found.select("r", "lo", "hi"))


def _with_ranges(rows: DataFrame, text: Column, text_column: str, window: int, gram: int, bucket_rows: int) -> DataFrame:
    """``rows`` (r, doc) with the lists ``lows`` and ``highs`` of their ranges."""
    ranges = _ranges(rows, text, text_column, window, gram, bucket_rows)
    of_document = ranges.groupBy("r").agg(F.collect_list("lo").alias("lows"), F.collect_list("hi").alias("highs"))
    return rows.join(of_document, "r", "left").select("doc", "lows", "highs")


def _cut(text: bytes, lows: list[int] | None, highs: list[int] | None, window: int) -> tuple[bytes, int, int]:
    """What stays of a text, how many bytes go, and in how many runs."""
    if not lows:
        return text, 0, 0
    gone = np.zeros(len(text) + 1, np.int32)
    np.add.at(gone, np.array(lows, np.int64), 1)
    np.add.at(gone, np.array(highs, np.int64) + window, -1)
    gone = np.cumsum(gone[:-1]) > 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), len(_runs(gone)[0])


def _digests(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in small(batches):
        out = []
        rows = batch.column("doc")
        for text, lows, highs in zip(rows.field("text").cast(pa.large_binary()), batch.column("lows").to_pylist(), batch.column("highs").to_pylist()):
            whole = text.as_py() or b""
            kept, removed, spans = _cut(whole, lows, highs, window)
            out.append((len(whole), removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
        columns = [pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * len(kinds), kinds)]
        yield pa.RecordBatch.from_arrays([rows.field("d"), *columns], ["d", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, gram: int = GRAM, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text.

    The digest is of the bytes that stay; in kept_text, parts of a character whose other bytes went are dropped. Every byte covered by a
    ``window``-byte string that starts anywhere else too goes; strings are judged on the input. A null text is empty; a null id is an id like any
    other. Rows that repeat an id and a text are documents of their own, so a text of at least ``window`` bytes
    repeated in full loses all. Texts shorter than a window lose nothing. Other columns are ignored.
    """
    doc = F.struct(F.col(id_column).cast("long").alias("d"), F.col(text_column).alias("text")).alias("doc")
    rows = docs.select(_row_name(id_column, text_column), doc)
    joined = _with_ranges(rows, F.col("doc.text"), "text", window, gram, bucket_rows)
    done = joined.mapInArrow(lambda b: _digests(b, window), "d bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string")
    return done.withColumnRenamed("d", id_column)


def _rewritten(batches: Iterator[pa.RecordBatch], window: int, text_column: str, chars_column: str) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        rows = batch.column("doc")
        columns = {field.name: rows.field(i) for i, field in enumerate(rows.type)}
        before = columns[text_column].to_pylist()
        after = list(before)
        for i, (lows, highs) in enumerate(zip(batch.column("lows").to_pylist(), batch.column("highs").to_pylist())):
            if lows:
                after[i] = _cut(before[i].encode(), lows, highs, window)[0].decode(errors="ignore")
        if chars_column in columns:
            chars = columns[chars_column]
            counted = [c if a is b else len(a) for a, b, c in zip(after, before, chars.to_pylist())]
            columns[chars_column] = pa.array(counted, chars.type)
        columns[text_column] = pa.array(after, rows.type.field(text_column).type)
        yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(list(columns.values()), fields=list(rows.type))], ["doc"])


def cut_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", chars_column: str = "n_chars", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """``docs`` with what ``remove_repeats`` removes cut from the texts; the length follows where a text has changed. All rows and columns stay."""
    rows = docs.select(_row_name(id_column, text_column), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    joined = _with_ranges(rows, F.col("doc").getField(text_column), text_column, window, gram, BUCKET_ROWS)
    schema = StructType([StructField("doc", docs.schema)])
    return joined.mapInArrow(lambda b: _rewritten(b, window, text_column, chars_column), schema).select("doc.*")
