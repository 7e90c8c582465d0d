"""Reports: templates filled from extracted fields, and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import LOW_CONFIDENCE

# The shape of a placeholder, and the mark of one that no field fills.
UNRESOLVED = "[[unresolved: "
PLACEHOLDER = r"\{\{\s*([A-Za-z0-9 _/()-]{1,60}?)\s*\}\}"


def latest_fields(fields: DataFrame, group: list[str]) -> DataFrame:
    """One field for each name in lower case: the newest, by id."""
    order = Window.partitionBy(*group, F.lower("field_name")).orderBy(F.desc("field_id"))
    return fields.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n").withColumn("key", F.lower("field_name"))


def drafted(templates: DataFrame, fields: DataFrame) -> DataFrame:
    """templates (report_id, section, body) and fields (report_id, field_id, field_name, value, confidence).

    Returns report_id, section, text, unresolved, unreviewed: placeholders become values, or a mark where there's
    no such field; unreviewed tells whether a figure of low confidence went in.
    """
    pieces = templates.select("report_id", "section", F.split("body", PLACEHOLDER, -1).alias("gaps"), F.regexp_extract_all("body", F.lit(PLACEHOLDER), F.lit(1)).alias("names"))
    each = pieces.select("report_id", "section", F.posexplode("gaps").alias("at", "gap"), F.col("names")).withColumn("name", F.get("names", F.col("at")))
    known = latest_fields(fields, ["report_id"]).select("report_id", "key", "value", "confidence")
    rows = each.withColumn("key", F.lower("name")).join(known, ["report_id", "key"], "left")
    filled = F.when(F.col("name").isNull(), "").otherwise(F.coalesce("value", F.concat(F.lit(UNRESOLVED), F.col("name"), F.lit("]]"))))
    unresolved = (F.col("name").isNotNull() & F.col("value").isNull()).cast("int")
    return rows.groupBy("report_id", "section").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat("gap", filled).alias("t")))), lambda x: x["t"]), "").alias("text"),
        F.sum(unresolved).alias("unresolved"), F.coalesce(F.max(F.col("confidence") <= LOW_CONFIDENCE), F.lit(False)).alias("unreviewed"),
    )


def citations(templates: DataFrame, fields: DataFrame) -> DataFrame:
    """report_id, section, at, key, field_id: one row for each placeholder that a field fills, repeats kept."""
    names = templates.select("report_id", "section", F.posexplode(F.regexp_extract_all("body", F.lit(PLACEHOLDER), F.lit(1))).alias("at", "name"))
    known = latest_fields(fields, ["report_id"]).select("report_id", "key", "field_id")
    return names.withColumn("key", F.lower("name")).join(known, ["report_id", "key"]).select("report_id", "section", "at", "key", "field_id")


def has_unresolved(body: Column) -> Column:
    return F.contains(body, F.lit(UNRESOLVED))


def history(versions: DataFrame) -> DataFrame:
    """report_id and versions, the newest first."""
    return versions.groupBy("report_id").agg(F.sort_array(F.collect_list("version"), asc=False).alias("versions"))


def latest_version(versions: DataFrame) -> DataFrame:
    order = Window.partitionBy("report_id").orderBy(F.desc("version"))
    return versions.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def next_version(report: DataFrame, sections: DataFrame) -> DataFrame:
    """A changed draft's new version; published and archived reports don't change."""
    return report.filter(F.col("status") == "draft").join(sections, "report_id").withColumn("version", F.col("version") + 1)


def appended_versions(versions: DataFrame, edits: DataFrame, by: Column, at: Column) -> DataFrame:
    """versions (report_id, version, sections, created_by, created_at) and the rows that edits (report_id, sections) of drafts add: the latest number and one.

    Earlier versions stay as they are. An edit with no section, or with the very sections that the latest version has, adds none; edits of reports without a
    version add none either.
    """
    changed = latest_version(versions).select("report_id", "version", F.col("sections").alias("_old")).join(edits, "report_id").filter((F.size("sections") > 0) & ~F.col("sections").eqNullSafe(F.col("_old")))
    new = changed.select("report_id", (F.col("version") + 1).alias("version"), "sections", by.alias("created_by"), at.alias("created_at"))
    return versions.unionByName(new)


TRANSITIONS = {("draft", "published"), ("published", "archived"), ("draft", "archived")}


def moved(reports: DataFrame, to: str) -> DataFrame:
    """Reports that may take the state `to` take it; the others stay."""
    may = [a for a, b in TRANSITIONS if b == to]
    return reports.withColumn("status", F.when(F.col("status").isin(*may), to).otherwise(F.col("status")))
