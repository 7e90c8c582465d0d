"""Tenant scope. None sees all tenants, an empty list none; the two are never the same."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolve(grants: Sequence[int] | None, requested: int | None = None) -> list[int] | None:
    """Sorted tenants that a reader with these grants may see; a tenant not held is not found."""
    if requested is None:
        return None if grants is None else sorted(grants)
    if grants is not None and requested not in grants:
        raise LookupError("no such tenant")
    return [requested]


def tenant_in(column: Column, scope: Sequence[int] | None) -> Column:
    return F.lit(True) if scope is None else column.isin(*scope) if scope else F.lit(False)


def contained(column: Column, scope: Sequence[int] | None) -> Column:
    """Of an array: it meets the scope and holds nothing outside it."""
    if scope is None:
        return F.lit(True)
    if not scope:
        return F.lit(False)
    held = F.array(*[F.lit(s) for s in scope]).cast("array<bigint>")
    return F.arrays_overlap(column, held) & (F.size(F.array_except(column, held)) == 0)


def cache_key(kind: str, version: int, scope: Sequence[int] | None, parameters: dict) -> str:
    """The scope is a part of the key, so a cached result never leaves it."""
    parts = [kind, str(version), "*" if scope is None else ",".join(map(str, sorted(scope))), json.dumps(parameters, sort_keys=True, default=str)]
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()
