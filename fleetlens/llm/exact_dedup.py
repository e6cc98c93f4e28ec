"""Exact copies by Grace hashing: spill by hash until a bucket's different contents fit one open-addressing table.

1. Every task runs its records through an open-addressing table that compares whole contents and starts anew when it is full. What it writes,
   in the shared folder, are the spill records: a row per document that names its first equal, and each different content once, with its count.
   A text that a third of all documents share leaves a task once, not once per copy.
2. Spill records are dealt to buckets by a hash of their content, as many as keep a bucket at half of ``table_bytes`` on average. A bucket that
   fits goes through one table, and its classes are final.
3. A bucket that doesn't fit is spilled again: salted parts of it go through tables of their own, which leaves one record of each content a part,
   and these are dealt by another hash. Contents that differ part by the hash, equal ones are merged by the salted tables, so either kind
   of large bucket shrinks, until all fit.
4. The classes go back along the rows that name their first equal, a join by number for each round.

No key has more rows in these joins than one table took. Contents travel only while they are open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.names import small
from fleetlens.plans.shared import stored

#: What the different contents of one table may take, and what a record counts beside its content.
TABLE_BYTES, RECORD_BYTES = 16 << 20, 64
#: Records of one table in the first pass.
TABLE_RECORDS = 1 << 16
#: A bucket is salted into parts of so many records at least, else merging the parts would gain nothing.
LEAST_PART = 16


class ContentTable:
    """Open addressing with linear probing. A digest leads to a slot; contents decide."""

    def __init__(self, slots: int = 1024):
        self.slots = [-1] * slots
        self.digests: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def entry(self, digest: int, content: bytes) -> int:
        """Number of a content, counted from 0 in order of arrival."""
        mask = len(self.slots) - 1
        at = digest & mask
        while (entry := self.slots[at]) >= 0:
            if self.digests[entry] == digest and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        entry = self.slots[at] = len(self.contents)
        self.digests.append(digest)
        self.contents.append(content)
        self.bytes += len(content) + RECORD_BYTES
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, digest in enumerate(self.digests):
            at = digest & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


class _Merger:
    """Records of one table: for each its first equal, for each content its count and the record that stays."""

    def __init__(self) -> None:
        self.table = ContentTable()
        self.members: list[int] = []
        self.ids: list[int | None] = []
        self.entries: list[int] = []
        self.first: list[int] = []
        self.count: list[int] = []
        self.best: list[tuple[bool, int, int]] = []

    def add(self, member: int, digest: int, content: bytes, n: int, best_id: int | None, best_row: int) -> None:
        entry = self.table.entry(digest, content)
        best = (best_id is not None, best_id or 0, best_row)
        if entry == len(self.first):
            self.first.append(member)
            self.count.append(n)
            self.best.append(best)
        else:
            self.count[entry] += n
            self.best[entry] = max(self.best[entry], best)
        self.members.append(member)
        self.ids.append(best_id)
        self.entries.append(entry)

    def rows(self, path: int | None = None, parts: int | None = None, final: bool = False) -> Iterator[pa.RecordBatch]:
        """A row per record. A final class has its digest on each, an open one its content on its first record."""
        contents = self.table.contents
        digests = [hashlib.sha256(c).hexdigest() for c in contents] if final else []
        for a in range(0, len(self.members), 512):
            entries, members = self.entries[a : a + 512], self.members[a : a + 512]
            best = [self.best[e] for e in entries]
            opens = [contents[e] if not final and self.first[e] == m else None for e, m in zip(entries, members)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(members, pa.int64()),
                    pa.array(self.ids[a : a + 512], pa.int64()),
                    pa.array([self.first[e] for e in entries], pa.int64()),
                    pa.array([self.count[e] for e in entries], pa.int64()),
                    pa.array([b[1] if b[0] else None for b in best], pa.int64()),
                    pa.array([b[2] for b in best], pa.int64()),
                    pa.array([digests[e] if final else None for e in entries], pa.string()),
                    pa.array(opens, pa.binary()),
                    pa.array([None if c is None else len(c) + RECORD_BYTES for c in opens], pa.int64()),
                    pa.array([path] * len(members), pa.int64()),
                    pa.array([parts] * len(members), pa.int64()),
                ],
                names=["row", "id", "first", "n", "best_id", "best_row", "sha256", "content", "size", "path", "parts"],
            )


_RECORDS = """row bigint, id bigint, first bigint, n bigint, best_id bigint, best_row bigint, sha256 string, content binary, size bigint,
    path bigint, parts bigint"""


def _first_pass(batches: Iterator[pa.RecordBatch], table_bytes: int, table_records: int) -> Iterator[pa.RecordBatch]:
    merger = _Merger()
    for batch in small(batches):
        for row, ident, digest, content in zip(*(column.to_pylist() for column in batch.columns)):
            merger.add(row, digest, content, 1, ident, row)
            if merger.table.bytes >= table_bytes or len(merger.members) >= table_records:
                yield from merger.rows()
                merger = _Merger()
    yield from merger.rows()


def _bucket_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket, or a salted part of one, which has the number of parts on all its records."""
    merger, path, parts = _Merger(), None, None
    for batch in batches:
        for piece in small([batch]):
            columns = [column.to_pylist() for column in piece.columns]
            path, parts = columns[0][0], columns[1][0]
            for record in zip(*columns[2:8]):
                merger.add(*record)
    yield from merger.rows(path, parts, final=parts is None)


def exact_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    table_bytes: int = TABLE_BYTES,
    table_records: int = TABLE_RECORDS,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their bytes are; null counts as empty. Of equal texts the row with the largest id is kept, a null id being the smallest, and
    of rows that repeat an id and a text one. Rows with null or repeated ids are documents of their own. Other columns are ignored, an empty table
    gives no rows. A bucket of fewer than 16 records isn't spilled again, however long they are.
    """
    read = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).cast("long").alias("id"),
        F.xxhash64(F.lit(0), F.coalesce(F.col(text_column).cast("binary"), F.lit(b""))).alias("digest"),
        F.coalesce(F.col(text_column).cast("binary"), F.lit(b"")).alias("content"),
    )
    made = stored(read.mapInArrow(lambda b: _first_pass(b, table_bytes, table_records), _RECORDS), "spill-0")
    total = made.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-2 * total // table_bytes))
    path = F.pmod(F.xxhash64(F.lit(1), "content"), F.lit(buckets))
    rounds, open_records = [made], made.where("content IS NOT NULL")
    while True:
        dealt = open_records.withColumn("path", path).withColumn("digest", F.xxhash64(F.lit(len(rounds)), "content")).drop("parts")
        sizes = dealt.groupBy("path").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))
        parts = F.expr(f"least(ceil(2 * bytes / {table_bytes}), records div {LEAST_PART})")
        large = stored(sizes.where(F.col("bytes") > table_bytes).select("path", parts.alias("parts")).where("parts > 1"), "large-buckets")
        salted = dealt.join(large, "path", "left").withColumn("part", F.expr("coalesce(pmod(xxhash64(row), parts), 0)"))
        by_table = salted.select("path", "parts", "row", "digest", "content", "n", "best_id", "best_row", "part").groupBy("path", "part")
        merged = by_table.applyInArrow(_bucket_pass, _RECORDS)
        if large.isEmpty():
            rounds.append(merged)
            break
        rounds.append(stored(merged, f"spill-{len(rounds)}"))
        open_records = rounds[-1].where("content IS NOT NULL")
        path = F.xxhash64("path", F.pmod(F.xxhash64(F.lit(len(rounds)), "content"), 2 * F.col("parts")))
    fields = ["n", "best_id", "best_row", "sha256"]
    classes = None
    for merged in reversed(rounds[1:]):
        final = merged.where("sha256 IS NOT NULL").select("row", *fields)
        if classes is not None:
            named = merged.where("sha256 IS NULL").select("row", F.col("first").alias("_first"))
            final = final.unionByName(named.join(classes.withColumnRenamed("row", "_first"), "_first").select("row", *fields))
        classes = final
    members = made.select(F.col("row").alias("_row"), "id", F.col("first").alias("row"))
    return members.join(classes, "row").select(
        F.col("id").alias(id_column),
        F.col("best_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("_row") == F.col("best_row")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )
