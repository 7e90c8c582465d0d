"""Personal data, and the terms that reveal it, with DataFrame functions only.

Base spans come from patterns. The words of the whole document that no base span touches are its context;
an entity is a kind with its normalised value, or a class that such values belong to: an e-mail domain, or
a kind. A value seen in few texts is so assessed by its classes. Over all documents the point-wise mutual
information of entity c and term t is PMI = log2(n_ct * N / (n_c * n_t)): N documents, n_c with the entity,
n_t with the term anywhere, n_ct with both. It's at most the
entity's own information IC = -log2(n_c / N), reached by a term that occurs with nothing else: such
a term discloses the entity whole. Terms with PMI >= REVEAL * IC are generalised and those
with PMI >= REMOVE * IC removed, wherever they stand in that entity's documents, if SUPPORT or more
different texts show the pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, text_key, written

REVEAL, REMOVE, SUPPORT = 0.8, 0.98, 3
#: The least letters of a term.
LETTERS = 3
KINDS = ["email", "ip", "card", "phone"]
#: Stands in a marked text for a dot or separator that no match can hold there.
MARK = "\x01"
#: As the kinds are defined, over marked texts: Java's matcher recurses into every repetition of a group, so a text with
#: thousands of labels or digits in a row would overflow its stack. In a marked text plain character classes say the same.
#: A run of characters that can't start a match is tried once, not from each of its characters; and shorter digit
#: runs than a card's are not tried at all.
PATTERNS = {
    "email": rf"(?:(?<![A-Za-z0-9._%+{MARK}-])|\G)[A-Za-z0-9._%+{MARK}-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]+(?:\.[0-9]+){3}",
    "card": r"[0-9][0-9\x20-]{12,}",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a match has for certain, cheap to look for.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WORD = rf"\p{{L}}{{{LETTERS},}}"
#: Matches whose places are added up at once; the sums of the blocks follow, so a text with n matches costs n * BLOCK, not n * n.
BLOCK = 256
SPANS = "array<struct<start: int, end: int, value: string>>"


def marked(text: Column, kind: str) -> Column:
    """The text, as long as before, with every dot of no domain (every separator of no card) marked."""
    plain = F.replace(text, F.lit(MARK), F.lit("\x02"))  # neither is part of any match
    if kind == "email":
        return F.regexp_replace(plain, r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])", MARK)
    if kind == "card":
        return F.regexp_replace(plain, r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", MARK)
    return text


def located(text: Column, pattern: str | Column) -> Column:
    """The leftmost non-overlapping matches: array of (start, end, value), in code points, end exclusive.

    The gaps between matches and the matches have their lengths; a start is the sum of those before.
    """
    none = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    def placed(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def moved(acc: Column, x: Column) -> Column:
        here = F.transform(x["out"], lambda m: F.struct((m["start"] + acc["at"]).alias("start"), (m["end"] + acc["at"]).alias("end"), m["value"].alias("value")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(here)).alias("out"))

    def every(pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda i: placed(F.slice(pairs, i * BLOCK + 1, F.lit(BLOCK))))
        whole = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out")), moved, lambda acc: F.flatten(acc["out"]))
        return F.when(F.size(pairs) > 0, whole).otherwise(none)

    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, F.lit(pattern), -1)
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), values.alias("value")), lambda x: x["value"].isNotNull())  # one more gap than values
    return F.element_at(F.transform(F.array(pairs), every), 1)  # so that the pairs are made once


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: F.when(F.length(part(p)) > 3, False).otherwise(F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(value))
    return F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(False) if kind == "card" else n.between(9, 15)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value) by kind, then start."""

    def of(kind: str) -> Column:
        found = F.filter(located(marked(text, kind), PATTERNS[kind]), lambda m: _holds(kind, m["value"]))
        value = lambda m: F.replace(m["value"], F.lit(MARK), F.lit(".")) if kind == "email" else m["value"]
        full = F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), value(m).alias("value")))
        hint = F.contains(text, F.lit(HINTS[kind])) if HINTS[kind] else F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}"))
        return F.when(hint, full).otherwise(F.array().cast("array<struct<kind: string, start: int, end: int, value: string>>"))

    return F.concat(*[of(k) for k in KINDS])


def _entity(span: Column) -> Column:
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(_digits(span["value"])))


def entities_of(spans: Column) -> Column:
    """The distinct entities of the spans: each value, its e-mail domain and its kind."""
    domain = lambda s: F.when(s["kind"] == "email", F.concat(F.lit("@"), F.lower(F.substring_index(s["value"], "@", -1))))
    every = F.flatten(F.transform(spans, lambda s: F.array(_entity(s), s["kind"], domain(s))))
    return F.array_distinct(F.filter(every, lambda e: e.isNotNull()))


def terms_of(text: Column) -> Column:
    """The distinct words of a text that no base span touches, in lower case. Of the kinds, only e-mails hold letters."""
    left = F.when(F.contains(text, F.lit("@")), F.regexp_replace(marked(text, "email"), PATTERNS["email"], "\n")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(left), F.lit(WORD), F.lit(0)))


def term_spans(text: Column, terms: Column) -> Column:
    """Array of (kind, start, end, action) where the terms (a map to their actions) stand and no base span touches them.

    E-mails are matched along with the terms, so that none is found within one; a word whose last letters begin an e-mail is none.
    """
    before_mail = rf"(?!(?<=[A-Za-z])[A-Za-z0-9._%+{MARK}-]*+@[A-Za-z0-9-]+\.)"
    pattern = F.concat(F.lit(PATTERNS["email"] + r"|(?iu:(?<!\p{L})(?:"), F.array_join(F.map_keys(terms), "|"), F.lit(r")(?!\p{L}))" + before_mail))
    made = F.transform(located(marked(text, "email"), pattern), lambda w: F.struct(F.lit("term").alias("kind"), w["start"].alias("start"), w["end"].alias("end"), F.element_at(terms, F.lower(w["value"])).alias("action")))
    return F.filter(made, lambda w: w["action"].isNotNull())


def disclosures(found: DataFrame, docs: DataFrame, text_col: str, reveal: float, remove: float, support: int) -> DataFrame:
    """entity, term, action (generalise or remove) of the terms over the threshold.

    found: key, entities, terms of the documents with base spans; docs: all of them.
    """
    entities = (
        found.select("key", F.explode("entities").alias("entity")).groupBy("entity", "key").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("entity").agg(F.sum("n").alias("n_c"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= support).drop("texts")
    )
    pairs = found.select("key", "terms", F.explode("entities").alias("entity")).join(entities, "entity").select("entity", "n_c", "key", F.explode("terms").alias("term"))
    joint = (
        pairs.groupBy("entity", "term", "key").agg(F.count(F.lit(1)).alias("n"), F.max("n_c").alias("n_c"))
        .groupBy("entity", "term").agg(F.sum("n").alias("n_ct"), F.count(F.lit(1)).alias("texts"), F.max("n_c").alias("n_c"))
        .filter(F.col("texts") >= support)
    )
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD), F.lit(0)))).alias("term"))
    terms = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    rated = joint.join(terms, "term").withColumn("n", F.lit(docs.count()))
    pmi = F.log2(F.col("n_ct") * F.col("n") / (F.col("n_c") * F.col("n_t")))
    share = pmi / F.nullif(-F.log2(F.col("n_c") / F.col("n")), F.lit(0.0))
    return rated.withColumn("share", share).filter(F.col("share") >= reveal).select("entity", "term", F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("action"))


def sanitise(docs: DataFrame, reveal: float = REVEAL, remove: float = REMOVE, support: int = SUPPORT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `spans` added: array of (kind, start, end, action), base spans by kind, then `term` spans, each by start.

    Null and empty texts have no spans. Repeated rows get the same spans and count as documents of their
    own, but as one text for the support. A term of several entities is one span, removed if any asks for it. Texts may
    be of any length, with runs of any number of digits or labels.
    An empty table gives no rows. A column `spans` of docs is replaced.
    """
    docs = docs.drop("spans")
    own_key, mark_id, mark_key, own_base, own_added = fresh(docs, "_key", "_id", "_k", "_base", "_added")
    rows = docs.withColumn(own_key, text_key(F.col(text_col)))
    spans = base_spans(F.coalesce(F.col(text_col), F.lit("")))
    slim = written(rows.select(F.col(id_col).alias("id"), F.col(own_key).alias("key"), spans.alias("spans")), "pii-base")
    base = slim.filter(F.size("spans") > 0)
    found = rows.alias("r").join(base.dropDuplicates(["id", "key"]).alias("b"), (F.col(f"r.{own_key}") == F.col("b.key")) & F.col(f"r.{id_col}").eqNullSafe(F.col("b.id"))).select(
        "b.id", "b.key", entities_of(F.col("b.spans")).alias("entities"), terms_of(F.col(f"r.{text_col}")).alias("terms")
    )
    found = written(found, "pii-terms")
    over = written(disclosures(found, docs, text_col, reveal, remove, support), "pii-over")
    asked = found.select("id", "key", "terms", F.explode("entities").alias("entity")).join(over.select("entity").distinct(), "entity")
    added = (
        asked.select("id", "key", "entity", F.explode("terms").alias("term")).join(over, ["entity", "term"])
        .groupBy("id", "key", "term").agg(F.max("action").alias("action"))
        .groupBy("id", "key").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("added"))
    )
    base = base.groupBy("id", "key").agg(F.first("spans").alias("spans"))
    marks = base.alias("b").join(added.alias("a"), (F.col("b.key") == F.col("a.key")) & F.col("b.id").eqNullSafe(F.col("a.id")), "left").select(
        F.col("b.id").alias(mark_id), F.col("b.key").alias(mark_key), F.col("b.spans").alias(own_base), F.col("a.added").alias(own_added)
    )
    none = F.array().cast("array<struct<kind: string, start: int, end: int, action: string>>")
    plain = F.transform(own_base, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit("generalise").alias("action")))
    new = F.when(F.col(own_added).isNotNull(), term_spans(F.col(text_col), F.col(own_added))).otherwise(none)
    return rows.join(marks, (F.col(own_key) == F.col(mark_key)) & F.col(id_col).eqNullSafe(F.col(mark_id)), "left").select(
        *docs.columns, F.when(F.col(own_base).isNull(), none).otherwise(F.concat(plain, new)).alias("spans")
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets, or by nothing where it's removed.

    Spans may overlap (an address within an e-mail's host): an overlapped span is replaced with the first.
    """
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"), s["action"].alias("action"))))

    def step(acc: Column, s: Column) -> Column:
        end = -s["less"]
        label = F.when(s["action"] == "remove", F.lit("")).otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), label)
        return F.struct(F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], end).alias("at"))

    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(order, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(of(*KINDS)).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
