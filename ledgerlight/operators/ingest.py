"""Ingestion: the upload gate, chunks, harvested fields, confidence and injection scanning."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import LOW_CONFIDENCE
from ..functions.text import visible

CHUNK, MOST_FIELDS = 1200, 100
# Accepted extensions with their type and MIME type, and the first bytes (hex) of binary ones.
ACCEPTED = {
    "pdf": ("pdf", "application/pdf", "25504446"),
    "png": ("image", "image/png", "89504E470D0A1A0A"),
    "jpg": ("image", "image/jpeg", "FFD8FF"),
    "jpeg": ("image", "image/jpeg", "FFD8FF"),
    "tif": ("scan", "image/tiff", "49492A00|4D4D002A"),
    "tiff": ("scan", "image/tiff", "49492A00|4D4D002A"),
    "xlsx": ("spreadsheet", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "504B0304"),
    "csv": ("spreadsheet", "text/csv", None),
    "txt": ("spreadsheet", "text/plain", None),
}
# The rules that show an embedded instruction; word limits are ASCII ones.
_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
RULES = [
    ("instruction-override", "high", rf"(?i){_L}(ignore|disregard|forget){_R}[^.\n]{{0,40}}{_L}(previous|prior|above|earlier|all){_R}[^.\n]{{0,40}}{_L}(instruction|prompt|rule|direction)"),
    ("role-reassignment", "high", rf"(?im){_L}you are (now|an?|the){_R}|{_L}act as{_R}|{_L}system prompt{_R}|{_L}new instructions?{_R}|^\s*(system|assistant)\s*:"),
    ("exfiltration", "high", rf"(?i){_L}(reveal|print|output|repeat|disclose){_R}[^.\n]{{0,40}}{_L}(system prompt|your instructions|api[\s_-]?key|secret|password|credential)"),
    ("fence-forgery", "high", r"(?i)<<<|>>>|\[/?INST\]|<\|[a-z_]{1,24}\|>|-{5}\s*(BEGIN|END)"),
    ("cross-tenant", "low", rf"(?i){_L}(include|show|add|fetch|list){_R}[^.\n]{{0,60}}{_L}(all|other|another)\s+subsidiar(y|ies){_R}|{_L}regardless of (access|permission|authoris|authoriz)"),
    ("privileged-action", "low", rf"(?i){_L}(publish|archive|approve|grant\s+access|override|revoke){_R}[^.\n]{{0,40}}{_L}(report|user|field|access){_R}"),
    ("tool-invocation", "low", rf"(?i){_L}(call|invoke|execute){_R}[^.\n]{{0,30}}{_L}(function|tool|endpoint|api){_R}|\"tool_call\"|\"action\"\s*:"),
    ("data-exfil-link", "low", r"(?i)!\[[^\]]*\]\(\s*https?:"),
]
# For each rule, lists of words in lower case: a text that breaks it holds one of every list. Most texts hold none, and a search for a word takes a small part
# of a pattern's time.
_SIGNS = {
    "instruction-override": [("ignore", "disregard", "forget"), ("instruction", "prompt", "rule", "direction")],
    "role-reassignment": [("you are ", "act as", "system prompt", "new instruction", "system", "assistant")],
    "exfiltration": [("reveal", "print", "output", "repeat", "disclose"), ("system prompt", "your instructions", "api", "secret", "password", "credential")],
    "fence-forgery": [("<<<", ">>>", "inst]", "<|", "-----")],
    "cross-tenant": [("subsidiar", "regardless of ")],
    "privileged-action": [("publish", "archive", "approve", "grant", "override", "revoke"), ("report", "user", "field", "access")],
    "tool-invocation": [("call", "invoke", "execute", '"action"'), ("function", "tool", "endpoint", "api", '"action"')],
    "data-exfil-link": [("![",)],
}
HIDDEN_PER_MILLE = 10
# The shapes of a labelled line and of a number.
FIELD_LINE = r"^\s*([A-Za-z][A-Za-z0-9 _/()%-]{1,48}?)\s*[:=]\s*(.{1,200}?)\s*$"
NUMBER = r"^-?[\d,.]+\s*[A-Za-z%]{0,12}$"


def looks_like_text(content: Column) -> Column:
    """No NUL and less than 5% control bytes in the first 8 KiB."""
    head = F.hex(F.substring(content, 1, 8192))
    pairs = F.regexp_extract_all(head, F.lit("[0-9A-F]{2}"), F.lit(0))
    bad = F.size(F.filter(pairs, lambda b: (b < "20") & ~b.isin("09", "0A", "0D")))
    return ~F.exists(pairs, lambda b: b == "00") & (bad < F.size(pairs) * 0.05)


def gated(files: DataFrame) -> DataFrame:
    """files (path, mime, content) with type and accepted: extension, declared type and first bytes have to agree."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kinds = files.sparkSession.createDataFrame([(e, *v) for e, v in ACCEPTED.items()], "ext string, type string, _mime string, _magic string")
    rows = files.withColumn("ext", ext).join(F.broadcast(kinds), "ext", "left")  # a fixed table
    magic = F.exists(F.split("_magic", r"\|"), lambda m: F.startswith(F.hex(F.substring("content", 1, 8)), m))
    good = F.col("type").isNotNull() & (F.col("mime") == F.col("_mime")) & F.when(F.col("_magic").isNull(), looks_like_text(F.col("content"))).otherwise(magic)
    return rows.withColumn("accepted", F.coalesce(good, F.lit(False))).drop("_mime", "_magic")


def manifest(files: DataFrame, month: str) -> DataFrame:
    """Accepted files (path, mime, content, tenant) with storage_key, checksum, size_bytes, type and status queued."""
    rows = gated(files).filter("accepted")
    return rows.withColumns({
        "storage_key": F.concat_ws("/", F.col("tenant").cast("string"), F.lit(month), "path"), "checksum": F.sha2("content", 256),
        "size_bytes": F.octet_length("content").cast("long"), "status": F.lit("queued"),
    })


def paged(rows: DataFrame, pages: DataFrame, line: str = "line") -> DataFrame:
    """rows (document_id and a line number from 0) with the page on which the line stands.

    pages: document_id, page, first_line, of any lengths. A page without a line (the next begins at the same) has no row; a line before the first page, and
    all lines of a document without pages, have page null. Both are put in order of their lines, and the last page that began
    goes on: an interval join that shuffles each side once, whatever the number of pages. Columns named like its own survive.
    """
    whole = F.struct(*rows.columns)
    starts = pages.select("document_id", F.col("first_line").cast("long").alias("at"), F.lit(0).alias("kind"), F.col("page").cast("long").alias("page"), F.lit(None).cast(rows.select(whole.alias("row")).schema["row"].dataType).alias("row"))
    lines = rows.select("document_id", F.col(line).cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("page"), whole.alias("row"))
    order = Window.partitionBy("document_id").orderBy("at", "kind", "page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = starts.unionByName(lines).withColumn("page", F.last("page", ignorenulls=True).over(order))
    return joined.filter("kind = 1").select("row.*", "page")


def first_lines(chunks: DataFrame) -> DataFrame:
    """chunks (document_id, chunk_index, text) with the line on which each begins: the lines of the chunks before it."""
    before = Window.partitionBy("document_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("line", F.coalesce(F.sum(F.size(F.split("text", "\r?\n"))).over(before), F.lit(0)).cast("long"))


def extractor(name: str, extract, spark) -> None:
    """Register a Python function of a text to its pieces (section, text) as a table function `name`: one row in, any number out.

    `SELECT d.id, e.* FROM docs d, LATERAL name(d.text) e` runs it where the rows are. What it raises is a row with its kind in `error`; a null text gives none.
    """
    from pyspark.sql.functions import udtf

    class Pieces:
        def eval(self, text: str):
            if text is None:
                return
            try:
                found = list(extract(text))
            except Exception as error:
                yield None, None, None, type(error).__name__
                return
            for i, (section, piece) in enumerate(found):
                yield i, section, piece, None

    spark.udtf.register(name, udtf(Pieces, returnType="piece_index long, section string, piece string, error string"))


def chunked(text: Column, most: int = CHUNK) -> Column:
    """Paragraphs joined while a chunk has at most `most` characters; a longer paragraph is a chunk of its own."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        fits = (acc["open"] == "") | (F.length(acc["open"]) + 2 + F.length(p) <= most)
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        return F.struct(F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"), F.when(fits, joined).otherwise(p).alias("open"))

    return F.aggregate(paragraphs, zero, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def harvested(docs: DataFrame, most: int = MOST_FIELDS) -> DataFrame:
    """docs (document_id, text) to field_name, value, confidence: `Label: value` lines, the first of a name."""
    lines = docs.select("document_id", F.posexplode(F.split("text", r"\r?\n")).alias("line", "_t")).filter(F.rlike("_t", F.lit(FIELD_LINE)))
    rows = lines.select("document_id", "line", F.regexp_extract("_t", FIELD_LINE, 1).alias("field_name"), F.regexp_extract("_t", FIELD_LINE, 2).alias("value"))
    first = Window.partitionBy("document_id", F.lower("field_name")).orderBy("line")
    rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    order = Window.partitionBy("document_id").orderBy("line")
    rows = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
    return rows.select("document_id", F.col("line").cast("long").alias("line"), "field_name", "value", F.when(F.rlike("value", F.lit(NUMBER)), 0.82).otherwise(0.6).alias("confidence"))


def confidence(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Mean confidence of a document's fields; 0.5 without fields, 0 without text; and whether it needs review."""
    mean = fields.groupBy("document_id").agg(F.avg("confidence").alias("_mean"))
    value = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", 0.0).otherwise(F.coalesce("_mean", F.lit(0.5)))
    rows = docs.join(mean, "document_id", "left").select("document_id", value.alias("ocr_confidence"), F.col("_mean").isNull().alias("_none"))
    return rows.select("document_id", "ocr_confidence", (F.col("_none") | (F.col("ocr_confidence") <= LOW_CONFIDENCE)).alias("requires_review"))


def injection_flags(raw: Column) -> Column:
    """Ids of the rules that a text breaks (text in NFKC)."""

    def of(x: Column) -> Column:
        signed = lambda rule: reduce(and_, [reduce(or_, [F.contains(x["low"], F.lit(word)) for word in words]) for words in _SIGNS[rule]])
        marks = [F.when(signed(rule) & F.rlike(x["seen"], F.lit(p)), F.lit(rule)) for rule, _, p in RULES]
        dense = F.when((F.length(x["seen"]) > 0) & (x["hidden"] * 1000 / F.greatest(F.length(x["seen"]), F.lit(1)) >= HIDDEN_PER_MILLE), F.lit("obfuscation"))
        return F.array_compact(F.array(*marks, dense))

    seen = visible(raw)
    return F.element_at(F.transform(F.array(F.struct(seen.alias("seen"), F.lower(seen).alias("low"), (F.length(raw) - F.length(seen)).alias("hidden"))), of), 1)  # so that they are made once


def suspected(flags: Column) -> Column:
    """One high rule, or two low ones."""
    low = F.array(*[F.lit(r) for r, s, _ in RULES if s == "low"])
    n_low = F.size(F.filter(flags, lambda f: F.array_contains(low, f)))
    return (F.size(flags) > n_low) | (n_low >= 2)


def suspected_documents(chunks: DataFrame) -> DataFrame:
    """Over the flags of all chunks of a document."""
    flags = chunks.select("document_id", F.explode(injection_flags(F.col("text"))).alias("rule"))
    low = F.col("rule").isin(*[r for r, s, _ in RULES if s == "low"])
    found = flags.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sum(low.cast("int")).alias("low"), F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))
    return found.select("document_id", "rules", ((F.col("n") > F.col("low")) | (F.col("low") >= 2)).alias("suspected"))
