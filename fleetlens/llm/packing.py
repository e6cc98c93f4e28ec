"""Best-fit packing that knows how far from the best it can be, and repacks only where there is something to gain.

Documents become ids and an end id; only those longer than a sequence are cut. Their pieces are dealt by hash into parts of
bounded size and packed best fit first, longest first. Dual feasible functions then give a lower bound on
the sequences of each part. A part that meets its bound is certified. In the next round the others exchange: the pieces of
their sequences that aren't full are dealt anew, together with the emptiest sequence of each certified part, and
packed again. A repacked round is kept only with the rounds before it, so the number of sequences never grows beyond
the first round's by more than one for each new part.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.names import small, texts
from fleetlens.llm.tokens import text_ids
from fleetlens.plans.shared import stored

SEQUENCE_TOKENS = 2048
PART_PIECES = 100_000
ROUNDS = 4


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the largest of several dual feasible functions, rounded up.

    f_k(x) = x for integer (k+1)x/C, else floor((k+1)x/C) C/k; and for e <= C/2: u_e(x) = C above C - e, 0 below e, else x.
    """
    if not len(sizes):
        return 0
    values, counts = np.unique(np.asarray(sizes, np.int64), return_counts=True)
    best = -(-int((values * counts).sum()) // capacity)
    for k in range(1, 20):
        scaled = values * (k + 1)
        times_k = np.where(scaled % capacity == 0, values * k, scaled // capacity * capacity)
        best = max(best, -(-int((times_k * counts).sum()) // (capacity * k)))
    for e in np.unique(np.append(values[values <= capacity // 2], 1)):
        used = np.where(values > capacity - e, capacity, np.where(values < e, 0, values))
        best = max(best, -(-int((used * counts).sum()) // capacity))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size, largest first, each into the fullest bin that still holds it."""
    bins, n = np.zeros(len(sizes), np.int64), 0
    free, open_bins = 0, [[] for _ in range(capacity + 1)]  # bit r of free: some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                free ^= 1 << room
        else:
            room, at = capacity, n
            n += 1
        bins[i] = at
        if room > size:
            open_bins[room - size].append(at)
            free |= 1 << room - size
    return bins


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, tokens: int) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        out = []
        for i, ids in enumerate(text_ids(path, list(texts(batch)))):
            ids = np.append(ids, end_id).astype("<u4")
            for a in range(0, len(ids), tokens):
                cut = ids[a : a + tokens]
                out.append((i, a // tokens, a, len(cut), zlib.crc32(cut.tobytes())))
        columns = list(zip(*out)) or [()] * 5
        d = batch.column("d").take(pa.array(columns[0], pa.int64()))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([d, *(pa.array(c, k) for c, k in zip(columns[1:], kinds))], ["d", "piece", "start", "length", "crc"])


_PLACED = "u bigint, length bigint, sequence_id bigint, offset bigint, again boolean, bound bigint, bins bigint"


def _packed(part: pa.Table, tokens: int, round_number: int, last: bool) -> pa.Table:
    part = part.sort_by("u")
    sizes = part.column("length").to_numpy()
    bins = best_fit(sizes, tokens)
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    bound = lower_bound(sizes, tokens)
    again = np.zeros(len(fill), bool)
    if not last:
        again[fill.argmin()] = fill.min() < tokens
        if len(fill) > bound:
            again |= fill < tokens
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(sizes[order]) - sizes[order]
    offset = np.zeros(len(sizes), np.int64)
    first = np.flatnonzero(np.diff(bins[order], prepend=-1))
    offset[order] = before - np.repeat(before[first], np.diff(np.append(first, len(order))))
    number = (part.column("part")[0].as_py() * ROUNDS_LIMIT + round_number) << 24
    same = np.full(len(sizes), 0)
    return pa.Table.from_arrays(
        [part.column("u"), part.column("length"), pa.array(number + bins), pa.array(offset), pa.array(again[bins]), pa.array(same + bound), pa.array(same + len(fill))],
        ["u", "length", "sequence_id", "offset", "again", "bound", "bins"],
    )


def _packer(tokens: int, round_number: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    return lambda part: _packed(part, tokens, round_number, last)


#: Sequence numbers have room for so many rounds.
ROUNDS_LIMIT = 64


def pack_sequences(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokens: int = SEQUENCE_TOKENS,
    part_pieces: int = PART_PIECES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, round, part_bound and part_bins.

    Pieces of a full sequence are sequences of their own. ``part_bound`` is the certified lower bound of the part that packed the piece,
    ``part_bins`` the sequences it made. A null or empty text has the end id alone. Null and repeated ids are documents of their own; other columns are
    ignored. No documents give no rows.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    read = docs.select(F.col(id_column).cast("long").alias("d"), text.alias("text"))
    made = read.mapInArrow(lambda b: _pieces(b, tokenizer_path, end_id, tokens), "d bigint, piece int, start bigint, length bigint, crc bigint")
    pieces = stored(made.withColumn("u", F.monotonically_increasing_id()), "pieces")
    open_pieces = pieces.where(F.col("length") < tokens).select("u", "length")
    count, placed = open_pieces.count(), None
    for number in range(1, rounds + 1):
        if not count:
            break
        parts = -(-count // part_pieces)
        last = number == rounds or (number > 1 and parts == 1)
        dealt = open_pieces.withColumn("part", F.expr(f"pmod(xxhash64(u, {number}), {parts}L)"))
        packed = stored(dealt.groupBy("part").applyInArrow(_packer(tokens, number, last), _PLACED), "packed")
        done = packed.where("NOT again").drop("again", "length").withColumn("round", F.lit(number))
        placed = done if placed is None else placed.unionByName(done)
        open_pieces = packed.where("again").select("u", "length")
        count = open_pieces.count()
    whole = pieces.where(F.col("length") == tokens).select(
        "u",
        F.expr("-1 - u").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.lit(1).cast("long").alias("bound"),
        F.lit(1).cast("long").alias("bins"),
        F.lit(0).alias("round"),
    )
    placed = whole if placed is None else placed.unionByName(whole)
    return pieces.join(placed, "u").select(
        F.col("d").alias(id_column),
        "piece",
        "start",
        "length",
        F.col("crc").alias("ids_crc32"),
        "sequence_id",
        "offset",
        "round",
        F.col("bound").alias("part_bound"),
        F.col("bins").alias("part_bins"),
    )
