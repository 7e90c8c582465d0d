"""A result cache: versions of small Parquet tables by key, with an expiry and invalidation by tenant.

A result is written whole under a name of its own and then moved to its place, so a reader finds it whole or not at all, and one that
reads an older version keeps it: nothing is overwritten. Invalidation deletes nothing either: it notes for a tenant the time from which
on older results no longer hold. A result holds if it hasn't expired and was begun after the last note of each tenant of its scope; one over all
tenants (scope None) falls with any note. `sweep` removes what no reader can ask for any more.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Iterable, Sequence
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scope import cache_key
from ..sources.kept import deleted, hadoop, moved

log = logging.getLogger(__name__)


def _millis(at: datetime) -> int:
    return int(at.replace(tzinfo=at.tzinfo or UTC).timestamp() * 1000)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, target = hadoop(spark, path)
    return [e.getPath().getName() for e in fs.listStatus(target)] if fs.exists(target) else []


class ResultCache:
    """Results under `folder`: entries/<kind>/<key>/<begun>-<expires>-<id> and notes/<tenant>/<time>, times in milliseconds."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def invalidated(self, scope: Sequence[int] | None) -> int:
        """The last note that touches a scope."""
        tenants = _names(self.spark, f"{self.folder}/notes") if scope is None else [str(t) for t in scope]
        return max((int(n) for t in tenants for n in _names(self.spark, f"{self.folder}/notes/{t}")), default=-1)

    def found(self, kind: str, key: str, scope: Sequence[int] | None, now: datetime) -> DataFrame | None:
        """The newest version that holds."""
        since, at = self.invalidated(scope), _millis(now)
        path = f"{self.folder}/entries/{kind}/{key}"
        versions = [(int(b), int(e), f"{b}-{e}-{x}") for b, e, x in (n.split("-", 2) for n in _names(self.spark, path) if not n.startswith((".", "_")))]
        good = [v for v in versions if v[0] > since and v[0] <= at < v[1]]
        return self.spark.read.parquet(f"{path}/{max(good)[2]}") if good else None

    def get(self, kind: str, version: int, scope: Sequence[int] | None, parameters: dict, make: Callable[[], DataFrame], ttl: timedelta, now: datetime | None = None) -> DataFrame:
        """The stored result of the same kind, version, scope and parameters, else a new one. What can't be stored is given all the same."""
        now = now or datetime.now(UTC)  # before the result is begun: what changes meanwhile makes it old
        key = cache_key(kind, version, scope, parameters)
        held = self.found(kind, key, scope, now)
        if held is not None:
            return held
        made = make()
        path = f"{self.folder}/entries/{kind}/{key}"
        name = f"{_millis(now)}-{_millis(now + ttl)}-{uuid.uuid4().hex[:12]}"
        try:
            made.write.parquet(f"{path}/.{name}")
            moved(self.spark, f"{path}/.{name}", f"{path}/{name}")
        except Exception as error:
            log.error("a result of %s was not stored: %s", kind, type(error).__name__)
            return made
        return self.spark.read.parquet(f"{path}/{name}")

    def invalidate(self, tenants: Iterable[int], now: datetime | None = None) -> None:
        """Results begun up to now that touch one of the tenants, and those over all tenants, hold no more. Never fails its caller."""
        at = _millis(now or datetime.now(UTC))
        for tenant in tenants:
            try:
                fs, target = hadoop(self.spark, f"{self.folder}/notes/{tenant}/{at}")
                fs.create(target, True).close()
            except Exception as error:
                log.error("results of tenant %s were not invalidated: %s", tenant, type(error).__name__)

    def sweep(self, now: datetime | None = None, grace: timedelta = timedelta(hours=1)) -> int:
        """Remove versions that expired before the grace (readers may still hold later ones), and all but the last note of each tenant; how many."""
        before, gone = _millis((now or datetime.now(UTC)) - grace), 0
        for kind in _names(self.spark, f"{self.folder}/entries"):
            for key in _names(self.spark, f"{self.folder}/entries/{kind}"):
                for name in _names(self.spark, f"{self.folder}/entries/{kind}/{key}"):
                    if int(name.removeprefix(".").split("-")[1]) <= before:
                        gone += deleted(self.spark, f"{self.folder}/entries/{kind}/{key}/{name}")
        for tenant in _names(self.spark, f"{self.folder}/notes"):
            for name in sorted(_names(self.spark, f"{self.folder}/notes/{tenant}"), key=int)[:-1]:
                gone += deleted(self.spark, f"{self.folder}/notes/{tenant}/{name}")
        return gone


def cached(spark: SparkSession, folder: str, kind: str, version: int, scope: Sequence[int] | None, parameters: dict, make: Callable[[], DataFrame], ttl: timedelta, now: datetime) -> DataFrame:
    return ResultCache(spark, folder).get(kind, version, scope, parameters, make, ttl, now)


def surviving(entries: DataFrame, tenants: Sequence[int], now: Column) -> DataFrame:
    """Entries (scope: an array, empty over all tenants; expires_at) that hold at `now` after these tenants were invalidated."""
    touched = F.arrays_overlap("scope", F.array(*[F.lit(t) for t in tenants]).cast("array<bigint>")) if tenants else F.lit(False)
    return entries.filter((F.col("expires_at") > now) & ~(touched | ((F.size("scope") == 0) if tenants else F.lit(False))))
