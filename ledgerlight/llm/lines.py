"""Line dedup by a log-template tree.

A line's tokens are its runs of non-space characters; a token with a digit is a variable field. The
tree has a fixed depth: the number of tokens, then the LEAD first tokens, fields as wildcards. A leaf
generalises further: at each position the token that MAJORITY of its documents have stays and
all else is a wildcard, and the lines that agree with that template at every kept position, if
those are at least LIKENESS of all, belong to it. All other lines have their own tokens, fields as
wildcards, as their template.

A template recurs if it stands in min_docs or more different texts, a long one (LONG or more
characters outside of its fields) if it does in LONG_DOCS or more. A line is held against its own template
as well as its leaf's. Of a recurring template's lines only the first (least document id, then line) stays. Copies of a whole document count once, so a document
doesn't lose its lines for having copies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, give_back, removed, table, text_key, written

LEAD, MAJORITY, LIKENESS, MIN_DOCS = 3, 0.5, 0.6, 5
#: Characters outside of fields from which a template is long, and the texts that make such a one recur.
LONG, LONG_DOCS = 120, 2
_DIGIT = re.compile(r"\d").search
FIELD = "<*>"


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def tokens_of(line: str) -> list[str]:
    tokens = line.split()
    return [FIELD if _DIGIT(t) else t for t in tokens] if _DIGIT(line) else tokens


def n_fixed(tokens: list[str]) -> int:
    """Characters of the tokens that aren't fields."""
    return sum(len(t) for t in tokens if t != FIELD)


#: Lines, or tokens of lines, that a task holds before it passes them on.
ROWS = 50_000


def leaf_of(tokens: list[str]) -> str:
    return f"{len(tokens)} " + " ".join(tokens[:LEAD])


def parsed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, key, text) to one row for each line that isn't blank: its leaf, template and characters outside of fields."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            made = lambda rows, kind=b["doc_id"].dtype: pd.DataFrame(rows, columns=["doc_id", "key", "line", "leaf", "template", "fixed"]).astype({"doc_id": kind})
            for doc, key, text in zip(b["doc_id"], b["key"], b["text"], strict=True):
                for number, line in enumerate(text.split("\n")) if text else ():
                    if tokens := tokens_of(line):
                        rows.append((doc, key, number, _hash(leaf_of(tokens)), _hash(" ".join(tokens)), n_fixed(tokens)))
                if len(rows) >= ROWS:
                    yield made(rows)
                    rows = []
            yield made(rows)
        give_back()

    return docs.mapInPandas(parse, "doc_id long, key long, line int, leaf long, template long, fixed int")


def _same(a: str, b: str):
    return (F.col(f"{a}.key") == F.col(f"{b}.key")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))


def _needed(fixed: str, min_docs: int):
    """Different texts that make a template recur, by its characters outside of fields."""
    return F.when(F.col(fixed) >= LONG, min(LONG_DOCS, min_docs)).otherwise(min_docs)


def generalised(lines: DataFrame, docs: DataFrame, min_docs: int) -> DataFrame:
    """leaf and template of the lines that belong to their leaf's own template, and its characters outside of fields."""
    texts = lines.groupBy("leaf", "template", "key").agg(F.min(F.struct("doc_id", "line")).alias("at"), F.max("fixed").alias("fixed"))
    templates = written(texts.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "at")).alias("first"), F.max("fixed").alias("fixed")), "lines-templates")
    leaves = templates.groupBy("leaf").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("docs"), F.max("fixed").alias("fixed"))
    leaves = leaves.filter((F.col("kinds") > 1) & (F.col("docs") >= _needed("fixed", min_docs))).drop("fixed")
    shown = templates.join(leaves, "leaf").select("leaf", "template", "n", "docs", F.col("first.key").alias("key"), F.col("first.at.doc_id").alias("doc_id"), F.col("first.at.line").alias("line"))
    asked = shown.groupBy("doc_id", "key").agg(F.collect_list(F.struct("leaf", "template", "n", "docs", "line")).alias("found"))

    def spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = lambda rows: pd.DataFrame(rows, columns=["leaf", "template", "n", "docs", "tokens", "sizes"])
        rows, size = [], 0
        for b in batches:
            for text, found in zip(b["text"], b["found"], strict=True):
                all_lines = text.split("\n")
                for x in found:
                    tokens = tokens_of(all_lines[x["line"]])
                    rows.append((x["leaf"], x["template"], x["n"], x["docs"], [_hash(t) for t in tokens], [n_fixed([t]) for t in tokens]))
                    size += len(tokens)
                if size >= ROWS:
                    yield made(rows)
                    rows, size = [], 0
        yield made(rows)

    words = docs.alias("d").join(asked.alias("a"), _same("d", "a")).select("d.text", "a.found").mapInPandas(spelled, "leaf long, template long, n long, docs long, tokens array<long>, sizes array<int>")
    words = written(words.dropDuplicates(["leaf", "template"]), "lines-words")
    each = words.select("leaf", "template", "n", "docs", F.size("tokens").alias("length"), F.posexplode(F.arrays_zip("tokens", "sizes")).alias("pos", "at"))
    each = each.select("leaf", "template", "n", "docs", "length", "pos", F.col("at.tokens").alias("token"), F.col("at.sizes").alias("chars"))
    votes = each.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("n"), F.max("docs").alias("docs"))
    kept = votes.filter(F.col("n") > MAJORITY * F.col("docs")).select("leaf", "pos", F.col("token").alias("kept"))  # one token of a position at most
    fits = each.join(kept, ["leaf", "pos"]).groupBy("leaf", "template").agg(
        F.min((F.col("token") == F.col("kept")).cast("int")).alias("all"), F.count(F.lit(1)).alias("kept"), F.max("length").alias("length"), F.sum("chars").cast("int").alias("fixed")
    )
    # written, so that the join with all lines has a plain table on each side, and a hot template can be split
    own = written(fits.filter((F.col("all") == 1) & (F.col("kept") >= LIKENESS * F.col("length"))).select("leaf", "template", F.col("fixed").alias("leaf_fixed")), "lines-own")
    removed(templates, words)
    return own


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, spare: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their texts without recurring lines, and `n_lines`, `n_dropped` added.

    spare: a document that would lose at least this share of the characters of its lines is taken for
    a copy of another one and left whole, for document dedup to decide on (None: no such rule). Null
    texts stay null and empty ones empty, with no lines; blank lines stay and aren't counted.
    Repeated rows are copies: each line's first place is in all of them. An empty table gives no
    rows. Columns of docs with the names of the added ones are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    parsed_lines = written(parsed(slim), "lines-parsed")
    own = generalised(parsed_lines, slim, min_docs)
    leaf = F.struct(F.xxhash64("leaf", F.lit("leaf")).alias("template"), F.col("leaf_fixed").alias("fixed"))
    each = F.struct("template", "fixed")
    of = F.explode(F.when(F.col("leaf_fixed").isNull(), F.array(each)).otherwise(F.array(each, leaf))).alias("of")
    lines = parsed_lines.join(own, ["leaf", "template"], "left").select("doc_id", "key", "line", of)
    lines = written(lines.select("doc_id", "key", "line", "of.template", "of.fixed"), "lines-templated")
    removed(parsed_lines, own)
    texts = lines.groupBy("template", "key").agg(F.min(F.struct("doc_id", "line")).alias("at"), F.max("fixed").alias("fixed"))
    recurring = texts.groupBy("template").agg(F.count(F.lit(1)).alias("texts"), F.min(F.struct("at", "key")).alias("first"), F.max("fixed").alias("fixed")).filter(F.col("texts") >= _needed("fixed", min_docs))
    hits = lines.join(written(recurring.select("template", "first"), "lines-recurring"), "template")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.at.doc_id")) & (F.col("line") == F.col("first.at.line")) & (F.col("key") == F.col("first.key"))
    gone = hits.filter(~is_first).groupBy("doc_id", "key").agg(F.collect_set("line").alias("gone"))

    @F.pandas_udf("struct<text: string, n_lines: long, n_dropped: long>")
    def without(texts: pd.Series, gone_of: pd.Series) -> pd.DataFrame:
        out, counts, dropped = [], [], []
        for text, away in zip(texts, gone_of, strict=True):
            every = text.split("\n") if text else []
            away = set() if away is None else set(away)
            if spare is not None and away and sum(len(every[i]) for i in away) >= spare * sum(len(x) for x in every if x.split()):
                away = set()
            out.append("\n".join(x for i, x in enumerate(every) if i not in away) if away else text)
            counts.append(sum(1 for x in every if x.split()))
            dropped.append(len(away))
        return pd.DataFrame({"text": out, "n_lines": counts, "n_dropped": dropped})

    without = without.asNondeterministic()  # a filter on its result doesn't make it run twice
    key, number, made = fresh(docs, "_key", "_id", "_new")
    rows = docs.withColumns({key: text_key(F.col(text_col)), number: F.col(id_col).cast("long")}).alias("r")
    joined = rows.join(gone.alias("g"), (F.col(f"r.{key}") == F.col("g.key")) & F.col(f"r.{number}").eqNullSafe(F.col("g.doc_id")), "left")
    new = joined.select("r.*", without(F.col(f"r.{text_col}"), F.col("g.gone")).alias(made))
    return new.select(*[F.col(f"{made}.text").alias(c) if c == text_col else F.col(c) for c in docs.columns], f"{made}.n_lines", f"{made}.n_dropped")


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
