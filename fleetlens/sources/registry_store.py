"""The session registry in buckets: looked up by owner or by token, updated in place of a full rewrite."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens import schemas as S
from fleetlens.operators.transitions import is_prunable, prune_cutoff
from fleetlens.sources.bucket_table import BucketTable

_TOKENS = T.StructType([f for f in S.REGISTRY_SCHEMA if f.name in ("id", "username", "token")])


class RegistryStore:
    """Sessions by owner, and a narrow table from token to owner.

    Owner and token of a session never change, so most updates touch the first table only. New tokens are committed before their sessions and
    pruned ones after theirs; a token whose session isn't there names nothing.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.sessions = BucketTable(spark, f"{path}/sessions", S.REGISTRY_SCHEMA, "username", buckets, sort=["username", "id"], bloom=["username", "token"])
        self.tokens = BucketTable(spark, f"{path}/tokens", _TOKENS, "token", buckets)

    def replace(self, registry: DataFrame) -> None:
        self.tokens.replace(registry.select(*_TOKENS.fieldNames()))
        self.sessions.replace(registry.select(*S.REGISTRY_COLUMNS))

    def read(self) -> DataFrame:
        return self.sessions.read()

    def of_owner(self, owner: str) -> DataFrame:
        """The sessions of an owner, from the owner's bucket."""
        return self.sessions.lookup([owner])

    def of_tokens(self, tokens: Sequence[str]) -> DataFrame:
        """The sessions of a few tokens, from the tokens' buckets and those of their owners."""
        owners = [row.username for row in self.tokens.lookup(tokens).select("username").distinct().collect()]
        return self.sessions.lookup(owners).where(F.col("token").isin(list(tokens)))

    def add(self, sessions: DataFrame) -> None:
        """New sessions."""
        self.tokens.update(sessions.select(*_TOKENS.fieldNames()), ["token", "id"])
        self.sessions.update(sessions, ["username", "id"])

    def update(self, touched: DataFrame) -> None:
        """Sessions that were set, such as ``touched`` of an update."""
        self.sessions.update(touched, ["username", "id"])

    def prune(self, now: datetime, age_s: int) -> None:
        """Remove old terminal sessions."""
        old = is_prunable(self.sessions.read(), prune_cutoff(now, age_s))
        before = self.sessions.latest()
        self.sessions.delete(old, ["username", "id"])
        gone = self.sessions.read(version=before).where(old).select(*_TOKENS.fieldNames())
        self.tokens.update(gone.where("false"), ["token", "id"], gone=gone)

    def vacuum(self, keep: int = 2) -> None:
        self.sessions.vacuum(keep)
        self.tokens.vacuum(keep)
