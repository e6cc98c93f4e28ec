"""Token ids in packed binary rows: best-fit decreasing with a segment tree over free capacity.

Documents become ids of a byte-level vocabulary and an end id. Only those longer than a row are cut, into pieces that
join again to the same ids. Pieces are dealt by hash into parts of bounded size; within a part each piece,
longest first, goes to the row with the least room that still holds it. Every row of the result is one line of an id matrix: ids padded to
the row length, cumulative segment lengths, and positions that restart with each segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.names import small, texts
from fleetlens.llm.tokens import vocabulary

ROW_TOKENS = 2048
PART_BYTES = 32 << 20


class FreeRoom:
    """How many open rows have each free capacity, in a segment tree; finds the least room that suffices."""

    def __init__(self, capacity: int):
        self._leaves = 1 << max(capacity, 1).bit_length()
        self._count = [0] * (2 * self._leaves)
        self._rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        self._rows.setdefault(room, []).append(row)
        self._change(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (room, row) of a row with the least room of at least ``size``."""
        node = self._first_from(size)
        if node is None:
            return None
        self._change(node, -1)
        return node, self._rows[node].pop()

    def _change(self, room: int, by: int) -> None:
        node = room + self._leaves
        while node:
            self._count[node] += by
            node >>= 1

    def _first_from(self, size: int) -> int | None:
        node = size + self._leaves
        if not self._count[node]:
            while node > 1 and (node & 1 or not self._count[node + 1]):  # up, until something stands to the right
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self._leaves:
                node = 2 * node if self._count[2 * node] else 2 * node + 1
        return node - self._leaves


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The row of each piece; equal sizes are taken in their order."""
    rows, n = np.zeros(len(sizes), np.int64), 0
    room = FreeRoom(capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = room.take(size)
        free, row = found if found else (capacity, n)
        n += not found
        rows[i] = row
        if free > size:
            room.add(free - size, row)
    return rows


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, row_tokens: int) -> Iterator[pa.RecordBatch]:
    coder, kind = vocabulary(path), "<u2" if end_id < 1 << 16 else "<u4"
    for batch in small(batches):
        out = []
        for i, text in enumerate(texts(batch)):
            ids = np.append(np.array(coder.encode([text.decode()])[0], np.int64), end_id).astype(kind)
            out += [(i, a // row_tokens, ids[a : a + row_tokens].tobytes()) for a in range(0, len(ids), row_tokens)]
        at, piece, ids = zip(*out) if out else ((), (), ())
        rows = batch.select(["d", "u"]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(piece, pa.int32()), pa.array(ids, pa.binary())], ["d", "u", "piece", "ids"])


_ROW = (
    "sequence_id bigint, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<bigint>, pieces array<int>"
)


def _packed(part: pa.Table, width: int, row_tokens: int, pad_id: int) -> pa.Table:
    kind = "<u2" if width == 2 else "<u4"
    ids = part.column("ids").to_pylist()
    sizes = np.array([len(x) // width for x in ids])
    order = np.lexsort((part.column("piece").to_numpy(), part.column("u").to_numpy()))
    rows = np.zeros(len(ids), np.int64)
    rows[order] = best_fit_decreasing(sizes[order], row_tokens)
    members: dict[int, list[int]] = {}
    for i in order.tolist():
        members.setdefault(int(rows[i]), []).append(i)
    d, piece, number = part.column("d").to_pylist(), part.column("piece").to_pylist(), part.column("part")[0].as_py()
    out = []
    for row, held in members.items():
        ends = np.cumsum([0, *sizes[held]])
        line = np.full(row_tokens, pad_id, kind)
        line[: ends[-1]] = np.frombuffer(b"".join(ids[i] for i in held), kind)
        positions = np.zeros(row_tokens, kind)
        positions[: ends[-1]] = np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
        out.append((number << 32 | row, int(ends[-1]), line.tobytes(), positions.tobytes(), ends.tolist(), [d[i] for i in held], [piece[i] for i in held]))
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
    names = ["sequence_id", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "pieces"]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def packed_rows(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    row_tokens: int = ROW_TOKENS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Packed rows of all documents: one line of the id matrix each.

    ``input_ids`` and ``position_ids`` are little-endian, two bytes an id below 65,536 and four above, padded with ``end_id`` and 0 to
    ``row_tokens``; ``cu_seqlens`` has the bounds of the segments, ``doc_ids`` and ``pieces`` whose they are. A null or empty text is its end id
    alone; null and repeated ids are documents of their own. No documents give no rows. Other columns are ignored. Write the result with
    ``.write.parquet`` for files of fixed-width lines.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    read = docs.select(F.col(id_column).cast("long").alias("d"), text.alias("text"))
    total = read.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = total // part_bytes + 1
    pieces = read.withColumn("u", F.monotonically_increasing_id()).mapInArrow(
        lambda b: _pieces(b, tokenizer_path, end_id, row_tokens), "d bigint, u bigint, piece int, ids binary"
    )
    width = 2 if end_id < 1 << 16 else 4
    dealt = pieces.withColumn("part", F.expr(f"pmod(xxhash64(u, piece), {parts}L)"))
    return dealt.groupBy("part").applyInArrow(lambda t: _packed(t, width, row_tokens, end_id), _ROW)



def unpacked(row: dict, width: int) -> list[tuple[int | None, int, np.ndarray]]:
    """The segments of one row: document, piece, ids."""
    ids = np.frombuffer(row["input_ids"], "<u2" if width == 2 else "<u4")
    return [(d, p, ids[a:b]) for d, p, a, b in zip(row["doc_ids"], row["pieces"], row["cu_seqlens"], row["cu_seqlens"][1:])]
