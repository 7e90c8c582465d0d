"""Text functions. Everything is a built-in expression but Unicode's NFKC, the search for invisible characters and the cutting of texts into terms, which
go over all characters of all texts: Python's C does that many times faster than a chain of Java patterns over a whole text."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

# The shape of a term, and the words that are none.
TERM = r"[a-z][a-z0-9-]{2,23}"
STOPWORDS = (
    "the and for are but not you all any can had her was one our out "
    "has him his how its may new now old see two who did get let put "
    "say she too use that this with from they been have were their said "
    "each which them than then some into only other more also such shall "
    "must when what will would could should there these those where while "
    "about after before under over between because during through being above "
    "along already although always among another around both cannot either else "
    "ever every except further hence here herself himself however indeed instead "
    "itself just least less many much myself neither never none nor nothing "
    "once onto ours perhaps quite rather same since still thus unless until "
    "upon very whether within without yours themselves whom whose "
    "page annexure appendix table figure signed dated sub ref encl sir madam "
    "respectfully whereas hereby herein thereof pursuant document report attached "
    "para paragraph section subsection enclosure dear faithfully sincerely kindly "
    "please regards undersigned forwarded vide hereinafter hereunder thereto therein "
    "thereby whereby wherein aforesaid"
).split()
# Characters that are seen by nobody.
INVISIBLE = "[\\u200B-\\u200D\\u2060\\uFEFF\\u202A-\\u202E\\u2066-\\u2069\\u0000-\\u0008\\u000B\\u000C\\u000E-\\u001F\\u007F-\\u009F]"
MOST_SEARCH_TERMS = 24


_TERM, _HIDDEN, _NO_TERMS = re.compile(TERM), re.compile(INVISIBLE), frozenset(STOPWORDS)
#: Texts that are taken apart before their terms go on.
AT_ONCE = 256
COUNTS = ArrayType(StructType().add("term", StringType()).add("n", LongType()))


def _shown(text: str) -> str:
    """Without invisible characters. None of them is printable, which is quicker to see."""
    return text if text.replace("\n", "").isprintable() else _HIDDEN.sub("", text)


def tokens_of(text: str) -> list[str]:
    """Terms in order, without stopwords, of the text as normalised."""
    return [t for t in _TERM.findall(_shown(text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()) if t not in _NO_TERMS]


def _sliced(texts: pa.Array, make: Callable[[list], pa.Array]) -> pa.Array:
    return pa.concat_arrays([make(texts.slice(i, AT_ONCE).to_pylist()) for i in range(0, max(len(texts), 1), AT_ONCE)])


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _visible(texts: pd.Series) -> pd.Series:
    def other(text: str) -> str | None:
        shown = _shown(text)
        return None if len(shown) == len(text) else shown

    return texts.map(other, na_action="ignore")


@F.arrow_udf(ArrayType(StringType()))
def _tokens(texts: pa.Array) -> pa.Array:
    return _sliced(texts, lambda some: pa.array([None if t is None else tokens_of(t) for t in some], pa.list_(pa.string())))


def folded(text: Column) -> Column:
    """NFKC. Python gets the texts beyond ASCII, and gives back those that it changes."""
    return F.coalesce(_nfkc(F.when(F.octet_length(text) > F.length(text), text)), text)


def visible(text: Column) -> Column:
    return F.coalesce(_visible(text), text)


def n_invisible(text: Column) -> Column:
    return F.length(text) - F.length(visible(text))


def normalised(text: Column) -> Column:
    return visible(folded(text))


def tokens(text: Column) -> Column:
    """Terms in order, without stopwords, of the text as normalised."""
    return _tokens(text)


def term_counts(text: Column, most: int | None = None) -> Column:
    """The terms of a text as an array of term and n, each once; the `most` first by count, then term, if that's given."""

    @F.arrow_udf(COUNTS)
    def counted(texts: pa.Array) -> pa.Array:
        def make(some: list) -> pa.Array:
            ends, terms, numbers = [0], [], []
            for t in some:
                found = Counter(tokens_of(t)) if t is not None else {}
                held = found.items() if most is None or len(found) <= most else sorted(found.items(), key=lambda x: (-x[1], x[0]))[:most]
                terms += [x[0] for x in held]
                numbers += [x[1] for x in held]
                ends.append(len(terms))
            each = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(numbers, pa.int64())], ["term", "n"])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)

        return _sliced(texts, make)

    return counted(text)


def bigrams(terms: Column) -> Column:
    def pairs(t: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(t, i - 1), F.get(t, i)))
        return F.when(F.size(t) < 2, F.array().cast("array<string>")).otherwise(each)

    return F.element_at(F.transform(F.array(terms), pairs), 1)  # so that the terms are made once


def sentences(text: Column) -> Column:
    """Sentences of 20 to 400 characters, in order."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: F.length(s).between(20, 400))


def stripped(text: Column) -> Column:
    """Without control characters, and without white space at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "[\\u0000-\\u0008\\u000B\\u000C\\u000E-\\u001F\\u007F]", ""), r"^\s+|\s+$", "")


def safe(text: Column, least: int, most: int) -> Column:
    """The text as normalised and trimmed, null if its length is out of bounds."""
    clean = F.regexp_replace(normalised(text), r"^\s+|\s+$", "")
    return F.when(F.length(clean).between(least, most), clean)


def search_terms(text: Column) -> Column:
    return F.array_join(F.slice(F.array_distinct(tokens(text)), 1, MOST_SEARCH_TERMS), " ")


def dedup_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(normalised(text)), r"\s+", " "))


def title_case(word: Column) -> Column:
    return F.concat(F.upper(F.left(word, F.lit(1))), F.substring(word, 2, 1 << 30))


def escaped(text: Column, nonce: str, most: int, fence: str = "GROUNDED_UNTRUSTED_SOURCE") -> Column:
    """A passage that can't be taken for instructions, cut at a word's end with a note if it's long."""
    # What is rewritten, and to what.
    rules = [
        ("<<<", "< < <"), (">>>", "> > >"), (f"(?i){fence}", "G_U_S"), (nonce, "NONCE"), (r"(?i)\{\{\s*ref\s*:", "{ { ref :"),
        (r"(?i)\[/?INST\]", "[ INST ]"), (r"(?i)<\|[a-z_]{1,24}\|>", "< | token | >"), (r"(?im)^#{1,6}\s*system(?![A-Za-z0-9_])", "# section"), (r"\n{4,}", "\n\n\n"),
    ]
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    head = F.regexp_extract(text, rf"(?s)^(.{{1,{most}}}) ", 1)
    cut = F.when(head != "", head).otherwise(F.left(text, F.lit(most)))
    return F.when(F.length(text) > most, F.concat(cut, F.lit(" …[truncated]"))).otherwise(text)


def answer_text(raw: Column, ordinals: Column, most: int) -> Column:
    """Claimed references as [n] where ordinals (a map) has them, else nothing; long hex keys and controls go."""
    parts = F.split(raw, r"\{\{ref:(?=S\d{1,3}\}\})")
    rest = lambda p: F.regexp_replace(p, r"^S\d{1,3}\}\}", "")
    ref = lambda p: F.regexp_extract(p, r"^(S\d{1,3})\}\}", 1)
    marked = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.concat(F.coalesce(F.concat(F.lit("["), F.element_at(ordinals, ref(p)).cast("string"), F.lit("]")), F.lit("")), rest(p)))
    text = F.concat(F.get(parts, F.lit(0)), F.array_join(marked, ""))
    text = F.regexp_replace(text, r"\b[0-9a-fA-F]{24}\b", "")
    text = F.regexp_replace(text, "[\\u0000-\\u0008\\u000B\\u000C\\u000E-\\u001F\\u007F]", "")
    return F.left(F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"^\s+|\s+$", ""), F.lit(most))
