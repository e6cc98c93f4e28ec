"""A table in hash buckets, with a manifest in place of indexes.

Rows lie in folders by the hash of one column, sorted, with Parquet Bloom filters. A manifest says which folder holds each bucket in a version of the
table. A lookup reads the buckets of its keys; an update writes new folders for the buckets it touches and then the manifest, so readers see the old
version or the new one, whatever fails in between. There is one writer at a time. A manifest has one row per bucket, and the number of buckets is a
parameter, so it may reach the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.plans.shared import exists, names_in, remove, stored

BUCKET = "_bucket"
_MANIFEST = "bucket int, folder string"
#: Rows of a bucket are written by up to so many tasks, since one key may have a large part of the table.
WRITERS = 64


class BucketTable:
    """``key`` is the column that buckets are dealt by, ``sort`` and ``bloom`` the columns files are sorted by and have Bloom filters for."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        key: str,
        buckets: int = 64,
        sort: Sequence[str] = (),
        bloom: Sequence[str] = (),
    ):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self.sort, self.bloom = list(sort) or [key], list(bloom) or [key]

    def versions(self) -> list[int]:
        """Committed versions in order."""
        folder = f"{self.path}/manifest"
        return sorted(int(name) for name in names_in(self.spark, folder) if exists(self.spark, f"{folder}/{name}/_SUCCESS"))

    def latest(self) -> int:
        """The newest version, 0 for a table without one."""
        return max(self.versions(), default=0)

    def _folders(self, version: int) -> dict[int, str]:
        if not version:
            return {}
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/{version}").collect()
        return {row.bucket: row.folder for row in rows}

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def buckets_of(self, keys: Iterable) -> list[int]:
        """Buckets of a few keys."""
        wanted = sorted({key for key in keys if key is not None})
        frame = self.spark.createDataFrame([(key,) for key in wanted], T.StructType([T.StructField("key", self.schema[self.key].dataType)]))
        return sorted({row[0] for row in frame.select(self.bucket_of(F.col("key"))).collect()})

    def read(self, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """All rows, or those of some buckets: other files aren't opened."""
        folders = self._folders(self.latest() if version is None else version)
        wanted = sorted(folders) if buckets is None else sorted(set(buckets) & set(folders))
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{folders[b]}/{BUCKET}={b}" for b in wanted))

    def lookup(self, keys: Sequence) -> DataFrame:
        """The rows of a few keys."""
        return self.read(self.buckets_of(keys)).where(F.col(self.key).isin(list(keys)))

    def _write(self, rows: DataFrame, version: int, kept: dict[int, str]) -> None:
        """Write ``rows``, which have their bucket, and commit them beside the buckets ``kept``."""
        folder = f"{version}-{uuid.uuid4().hex}"
        spread = F.pmod(F.xxhash64(*(c for c, kind in rows.dtypes if c != BUCKET and not kind.startswith("map"))), F.lit(WRITERS))
        writer = rows.repartition(BUCKET, spread).sortWithinPartitions(BUCKET, *self.sort).write.partitionBy(BUCKET)
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")  # as large as a file's values need
        for column in self.bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(f"{self.path}/data/{folder}")
        written = [name.split("=")[1] for name in names_in(self.spark, f"{self.path}/data/{folder}") if name.startswith(f"{BUCKET}=")]
        now = kept | {int(b): folder for b in written}
        manifest = self.spark.createDataFrame(sorted(now.items()), _MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifest/{version}")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.schema.fieldNames()).withColumn(BUCKET, self.bucket_of(F.col(self.key)))

    def replace(self, rows: DataFrame) -> int:
        """A new version of exactly these rows; returns its number."""
        version = self.latest() + 1
        self._write(self._dealt(rows), version, {})
        return version

    def update(self, rows: DataFrame, ident: Sequence[str], gone: DataFrame | None = None, version: int | None = None) -> int:
        """A new version with ``rows`` in place of those with the same ``ident``, and without the rows that ``gone(key, ident)`` names.

        Only the buckets of ``rows`` and ``gone`` are read and rewritten. ``ident`` contains the key column or decides it,
        and isn't null. With a ``version`` the update
        goes on from the newest one before it: a stream's batch that is tried again counts once.
        """
        version = self.latest() + 1 if version is None else version
        base = self._folders(max((v for v in self.versions() if v < version), default=0))
        if not base:
            self._write(self._dealt(rows), version, {})
            return version
        new = stored(self._dealt(rows), "update")
        out = new.select(BUCKET, *ident)
        if gone is not None:
            removed = gone.withColumn(BUCKET, self.bucket_of(F.col(self.key))).select(BUCKET, *ident)
            out = stored(out.unionByName(removed).distinct(), "update-keys")
        touched = {row[0] for row in out.select(BUCKET).distinct().collect()}
        folders = {b: f for b, f in base.items() if b in touched}
        if folders:
            paths = [f"{self.path}/data/{f}/{BUCKET}={b}" for b, f in folders.items()]
            old = self._dealt(self.spark.read.schema(self.schema).parquet(*paths))
            new = old.join(out.drop(BUCKET).distinct(), list(ident), "left_anti").select(*new.columns).unionByName(new)
        self._write(new, version, {b: f for b, f in base.items() if b not in touched})
        return version

    def delete(self, condition: Column, ident: Sequence[str], version: int | None = None) -> int:
        """A new version without the rows that meet ``condition``; buckets without such rows stay as they are."""
        found = stored(self.read().where(condition).select(self.key, *(c for c in ident if c != self.key)), "delete")
        empty = self.spark.createDataFrame([], self.schema)
        return self.update(empty, ident, gone=found, version=version)

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the newest ``keep`` versions, and what failed writes have left."""
        versions = self.versions()
        kept = versions[-keep:]
        used = {folder for version in kept for folder in self._folders(version).values()}
        for name in names_in(self.spark, f"{self.path}/manifest"):
            if int(name) not in kept:
                remove(self.spark, f"{self.path}/manifest/{name}")
        for name in names_in(self.spark, f"{self.path}/data"):
            if name not in used:
                remove(self.spark, f"{self.path}/data/{name}")
