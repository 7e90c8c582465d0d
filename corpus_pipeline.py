"""From raw documents to packed training sequences, in five stages.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and reread as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import fresh, shielded, spread_table, text_key, written
from ledgerlight.llm.language import UNKNOWN, identify, is_held_out, train
from ledgerlight.llm.lines import drop_recurring
from ledgerlight.llm.mixing import copied, mix
from ledgerlight.llm.neardup import near_duplicates
from ledgerlight.llm.packing import pack, public_encoder

#: Share of a text's letters that its language has to have.
LEAST_SCORE = 0.5
#: No document is spared line removal for what it would lose: lines that come from several others make no near copy.
SPARE = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; texts without letters or of no main language go.

    Null and empty texts go; texts are read whole however long. Equal shares of two languages go to the first by name. Repeated rows
    and rows of one id are judged each by its own text. Without a labelled document nothing can be told, so all go; an empty table stays empty.
    All columns come back as they were, those named like the operator's own (lang_pred, score, spans) too.
    """
    model = train(docs.filter(~is_held_out(F.col("doc_id"))))
    docs, names = shielded(docs, "lang_pred", "score", "spans")
    return identify(docs, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*names)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those of which nothing is left go.

    Null, empty and blank texts that lose nothing stay if they hold a word, else go only where a line was dropped. Of equal lines the
    first by (doc_id, line, text) stays; repeated rows count as one text and are treated alike, rows of one id with different
    texts as texts of their own. n_chars follows a changed text; all other columns come back as they were, those named
    like the operator's own (n_lines, n_dropped) too. An empty table stays empty.
    """
    docs, names = shielded(docs, "n_lines", "n_dropped")
    out = drop_recurring(docs, spare=SPARE)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.filter((F.col("n_dropped") == 0) | F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))).select(*names)


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number for each pair of id and text, in the order of ids."""
    spark = docs.sparkSession
    key, number, text = fresh(docs, "_key", "_number", "_text_key")
    keyed = docs.withColumns({key: F.col("doc_id"), text: text_key(F.col("text"))})
    pairs = keyed.select(key, text).distinct()
    ordered = pairs.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key, text).sortWithinPartitions(key, text)
    numbers = written(ordered.withColumn(name, F.monotonically_increasing_id()), "pipeline-numbers").withColumnsRenamed({key: number, text: f"{text}_"})
    same = F.col(key).eqNullSafe(F.col(number)) & (F.col(text) == F.col(f"{text}_"))
    return keyed.join(numbers, same).select(*docs.columns, name)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8).

    The document with the least id stays (of one id: with the least hash of its text). Texts with an empty set (null, empty, blank)
    are near to nothing, so all of them stay but for repeats of a row. Rows with equal id and text are one document; different texts
    of one id are documents of their own. A row with a null id stays only if no other of its group has an id. All columns come back as
    they were whatever their names; an empty table stays empty.
    """
    (number,) = fresh(docs, "_document")
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(text_key(F.col("text"))).alias("least"), F.max(text_key(F.col("text"))).alias("most"))
    if repeated.filter("n > 1 and (least <> most or doc_id is null)").limit(1).count():
        docs = written(_numbered(docs, number), "pipeline-numbered")
    else:
        docs = docs.withColumn(number, F.col("doc_id"))
    names = [c for c in docs.columns if c != number]
    found = near_duplicates(docs, k=5, similarity=0.8, id_col=number)
    gone = found.filter(~F.col("kept") & F.col("component_id").isNotNull()).select(F.col("doc_id").alias("gone")).distinct()
    return docs.alias("d").join(gone.alias("g"), F.col(f"d.{number}").eqNullSafe(F.col("g.gone")), "left_anti").dropDuplicates([number, "text"]).select(*names)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (operator's defaults: at most 3 times).

    Texts without a word, null ones too, are taken never; a null source is one of its own. Repeated rows are documents of their own; equal sizes
    are told apart by a hash of the id. A document's copies are equal rows. All columns come back as they were, those named like the
    operator's own (size, source_size, target, copies) too; an empty table stays empty.
    """
    docs, names = shielded(docs, "size", "source_size", "target", "copies")
    return copied(mix(docs)).select(*names)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A null text is its end id alone; long texts are cut over sequences. Repeated rows are packed as often as they occur; equal lengths go in
    the order of ids. Only the id and the text are read, whatever other columns there are; an empty table gives no pieces.
    """
    return pack(docs, public_encoder())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The language model, the copies' groups and the tokenizer are beyond SQL; each stage is tested against a
#: brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
