"""What leaves the library of a stored row: named columns with their defaults, and nothing else.

Storage keys, the rules that an injection scan found, and the chunks that a search retrieved are state of the library's own: no shape names them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scope import tenant_in

#: Shapes: a column's name, its type, and what stands for null (None: null itself).
DOCUMENT = (
    ("id", "long", None), ("tenant", "long", None), ("uploaded_by", "long", None), ("original_filename", "string", None), ("mime_type", "string", None), ("size_bytes", "long", None), ("type", "string", None), ("status", "string", None),
    ("ocr_confidence", "double", None), ("requires_review", "boolean", None), ("injection_suspected", "boolean", False), ("tags", "array<string>", ()), ("processing_error", "string", None), ("attempts", "int", None), ("created_at", "timestamp_ntz", None),
)
QUERY = (
    ("id", "long", None), ("asked_by", "long", None), ("text", "string", None), ("is_parliamentary", "boolean", None), ("scope", "array<long>", ()), ("document_ids", "array<long>", ()), ("status", "string", None), ("review_status", "string", None),
    ("response_text", "string", None), ("answer_status", "string", None), ("candidates", "long", 0), ("passages_used", "long", 0), ("passages_withheld", "long", 0), ("discarded", "long", 0), ("injection_suspected", "boolean", False),
    ("attempts", "int", 0), ("failure_reason", "string", None), ("reviewed_by", "long", None), ("created_at", "timestamp_ntz", None),
)
REPORT = (
    ("id", "long", None), ("title", "string", None), ("tenant", "long", None), ("created_by", "long", None), ("status", "string", None), ("version", "long", None), ("document_ids", "array<long>", ()), ("has_unreviewed_figures", "boolean", False),
    ("published_at", "timestamp_ntz", None), ("archived_at", "timestamp_ntz", None), ("created_at", "timestamp_ntz", None),
)


def shaped(rows: DataFrame, shape: Sequence[tuple]) -> DataFrame:
    """rows with the shape's columns, in its order; a column that rows lack is its default everywhere."""
    there = set(rows.columns)

    def column(name: str, kind: str, default):
        value = F.col(name).cast(kind) if name in there else F.lit(None).cast(kind)
        if default is None:
            return value.alias(name)
        empty = F.array().cast(kind) if default == () else F.lit(default).cast(kind)
        return F.coalesce(value, empty).alias(name)

    return rows.select(*[column(*c) for c in shape])


def query_details(rows: DataFrame, scope: Sequence[int] | None) -> DataFrame:
    """Queries with their citations (an array of structs with a tenant) as this reader may see them today, and the tenant where the scope is one."""
    seen = F.filter("citations", lambda x: tenant_in(x["tenant"], scope))
    return shaped(rows.withColumn("_seen", seen), (*QUERY, ("_seen", rows.schema["citations"].dataType.simpleString(), ()))).withColumnRenamed("_seen", "citations").withColumn("tenant", F.when(F.size("scope") == 1, F.get("scope", F.lit(0))))


def query_summaries(rows: DataFrame, scope: Sequence[int] | None, preview: int = 200) -> DataFrame:
    """The log's rows: a preview of the answer and the number of visible citations instead of both in full."""
    full = query_details(rows, scope)
    return full.select(
        "id", "asked_by", "text", "is_parliamentary", "status", "review_status", "answer_status", F.left("response_text", F.lit(preview)).alias("answer_preview"), F.size("citations").cast("long").alias("citation_count"), "discarded",
        "injection_suspected", "reviewed_by", "tenant", "created_at",
    )
