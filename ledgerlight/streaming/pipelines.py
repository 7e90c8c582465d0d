"""Ingestion and term indexing as streams: files in, derived tables out, micro-batch by micro-batch.

The stream's checkpoint takes the place of a claim on each row. A batch that runs again replaces what it
wrote before, since every derived row is keyed by its source, and counts no second attempt, since a document's row holds
the number of the batch that last took it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.calendar import month_key
from ..functions.text import folded, visible
from ..operators import index, ingest, topics
from ..operators.changes import MOST_ATTEMPTS
from ..sources.kept import deleted
from .tables import append_once, audit_rows, replace_in, stored

DOCUMENTS = "document_id long, tenant long, created_at timestamp_ntz, attempts int, text string"
STATE = (
    "document_id long, tenant long, created_at timestamp_ntz, attempts int, status string, ocr_confidence double, requires_review boolean, injection_suspected boolean, rules string, processing_error string, batch long, bucket int"
)
# What a failed document says of itself. What went wrong in full stands in the log alone.
RETRY, EXHAUSTED = "Processing failed; retry available", "Processing failed repeatedly; manual review required"


def as_text(docs: DataFrame) -> DataFrame:
    """The default extractor: the text as it came; a file without one (null) can't be read."""
    return docs.withColumn("error", F.when(F.col("text").isNull(), F.lit("NoText")))


def by_python(extract: Callable[[str], str]) -> Callable[[DataFrame], DataFrame]:
    """An extractor of a Python function, called once for each document. What it raises is that document's error: its kind, not its words."""

    def extractor(docs: DataFrame) -> DataFrame:
        schema = StructType([*docs.schema.fields, StructField("error", StringType())])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                texts, errors = [], []
                for t in b["text"]:
                    try:
                        texts.append(extract(t))
                        errors.append(None)
                    except Exception as error:
                        texts.append(None)
                        errors.append(type(error).__name__)
                yield b.assign(text=texts, error=errors)

        return docs.mapInPandas(run, schema)

    return extractor


def processed(docs: DataFrame) -> dict[str, DataFrame]:
    """Of newly queued documents with a text: chunks, fields, documents (confidence, review, injection) and terms."""
    docs = docs.withColumn("text", visible(folded(F.col("text"))))
    chunks = docs.select("document_id", "tenant", F.posexplode(ingest.chunked(F.col("text"))).alias("chunk_index", "text"))
    fields = ingest.harvested(docs.select("document_id", "text"))
    scored = ingest.confidence(docs, fields).join(ingest.suspected_documents(chunks), "document_id", "left")
    flagged = F.coalesce("suspected", F.lit(False))
    state = docs.select("document_id", "tenant", "created_at", (F.col("attempts") + 1).alias("attempts")).join(scored, "document_id").select(
        "document_id", "tenant", "created_at", "attempts", F.lit("validated").alias("status"), "ocr_confidence", (F.col("requires_review") | flagged).alias("requires_review"), flagged.alias("injection_suspected"), "rules",
    )
    sources = docs.select(F.lit("document").alias("source_type"), F.col("document_id").alias("source_id"), "tenant", F.col("created_at").alias("source_created_at"), "text")
    return {"chunks": chunks, "fields": fields, "documents": state, "terms": topics.word_frequencies(sources)}


def failed(docs: DataFrame) -> DataFrame:
    """Rows of documents whose extraction failed: derived rows of earlier uploads stay as they are."""
    tries = F.col("attempts") + 1
    return docs.select(
        "document_id", "tenant", "created_at", tries.cast("int").alias("attempts"), F.lit("failed").alias("status"), F.lit(None).cast("double").alias("ocr_confidence"), F.lit(True).alias("requires_review"),
        F.lit(None).cast("boolean").alias("injection_suspected"), F.lit(None).cast("string").alias("rules"), F.when(tries >= MOST_ATTEMPTS, EXHAUSTED).otherwise(RETRY).alias("processing_error"),
    )


def claimed(docs: DataFrame, held: DataFrame, number: int) -> DataFrame:
    """Documents of a batch that are to be taken, with the attempts before this one from their stored rows.

    One that failed MOST_ATTEMPTS times is not taken again. One that is validated has been uploaded anew and begins at 0. A batch that runs
    again takes what it took, and counts no attempt more.
    """
    held = held.select("document_id", F.col("status").alias("_status"), F.col("attempts").alias("_attempts"), F.col("batch").alias("_batch"))
    again = F.col("_batch") == number
    before = F.when(again, F.col("_attempts") - 1).when(F.col("_status") == "failed", F.col("_attempts")).otherwise(F.lit(0))
    rows = docs.join(held, "document_id", "left").filter(F.coalesce(again | (F.col("_status") != "failed") | (F.col("_attempts") < MOST_ATTEMPTS), F.lit(True)))
    return rows.withColumn("attempts", F.coalesce(before, F.lit(0)).cast("int")).drop("_status", "_attempts", "_batch")


def ingest_stream(
    spark: SparkSession, landing: str, out: str, checkpoint: str, process: Callable[[DataFrame], dict[str, DataFrame]] = processed, extractor: Callable[[DataFrame], DataFrame] = as_text,
    after: Callable[[DataFrame], None] | None = None, name: str = "ingestion",
) -> StreamingQuery:
    """Documents (JSON lines) that land in a folder, each batch through extractor and `process` into tables under `out`.

    A document whose extractor gives an error is stored as failed, with a reason that says nothing of its content, and doesn't stop the others of its
    batch; landing again it is tried again, MOST_ATTEMPTS times in all. Audit entries are appended once for each batch, and chunks are
    indexed as the batch's segment under `out`/index. after: gets the tenants of the batch's validated documents (to drop cached results, say).
    """
    rows = spark.readStream.schema(DOCUMENTS).json(landing)

    def batch(docs: DataFrame, number: int) -> None:
        docs = docs.filter("document_id is not null").dropDuplicates(["document_id"])
        held = stored(docs.sparkSession, f"{out}/documents", STATE)
        taken = extractor(claimed(docs, held, number))
        work = f"{checkpoint}/work/{name}-{number}"  # what was extracted once is read by all that follows
        taken.write.mode("overwrite").parquet(work)
        taken = docs.sparkSession.read.schema(taken.schema).parquet(work)
        good, bad = taken.filter("error is null").drop("error"), taken.filter("error is not null")
        tables = process(good)
        state = tables.pop("documents").unionByName(failed(bad), allowMissingColumns=True).withColumn("batch", F.lit(number).cast("long"))
        sources = good.select("document_id", "created_at")
        for table, found in tables.items():
            if table == "terms":  # by the month of the source itself, however late it comes
                times = sources.unionByName(held.join(sources.select("document_id"), "document_id", "left_semi").select("document_id", "created_at"))  # rows under an earlier time go too
                of_source = times.select(F.lit("document").alias("source_type"), F.col("document_id").alias("source_id"), "created_at")
                replace_in(f"{out}/{table}", found, ["source_type", "source_id"], of_source, "period_month", month_key(F.col("created_at")))
            else:
                replace_in(f"{out}/{table}", found, "document_id", sources)
        chunks = tables["chunks"].select((F.col("document_id") * 100000 + F.col("chunk_index")).alias("chunk_id"), "document_id", "tenant", "text")
        index.write_segment(f"{out}/index", chunks, number)
        replace_in(f"{out}/documents", state, "document_id", state.select("document_id"))
        at = F.lit(number).cast("timestamp").cast("timestamp_ntz")  # a batch's number, not the clock: the same again when it runs again
        done = docs.sparkSession.read.schema(STATE).parquet(f"{out}/documents").filter(F.col("batch") == number)
        action = F.when(F.col("status") == "failed", "document.processing_failed").otherwise("document.processed")
        counts = {"attempts": F.col("attempts"), "requires_review": F.col("requires_review"), "injection_suspected": F.col("injection_suspected"), "rules": F.coalesce("rules", F.lit(""))}
        entries = lambda of, what: audit_rows(of, what, "Document", F.col("document_id"), F.lit(None), F.col("tenant"), counts, at)
        trail = entries(done, action).unionByName(entries(done.filter("injection_suspected"), F.lit("document.injection_suspected")))
        append_once(f"{out}/audit", trail, name, number)
        if after is not None:
            after(done.filter("status = 'validated'").select("tenant").distinct())
        deleted(docs.sparkSession, work)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
