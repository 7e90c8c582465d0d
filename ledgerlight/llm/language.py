"""Language identification of mixed-language texts.

The script ranges of a text's letters narrow the candidate languages: only languages whose
training words use a script to a share of at least SCRIPT_SHARE can label words in it. A word is a run of
letters of one script; runs of over LONGEST letters are cut, and all parts count. Each word
gets a log-probability under every candidate from the language's character n-grams (naive Bayes, add-one
smoothing). Viterbi's algorithm then labels the words in turn, with a penalty for every switch of
language, and equal neighbours form spans. A text's language is the one that its spans give
the most letters to.

The n-gram counts come from a bounded sample of labelled documents (about SAMPLE_DOCS of each language, those with a
low hash of their id), so the model is of bounded size; all n-grams of the sample are kept.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, give_back, spread_table, written

#: Labelled documents of each language that the model is fitted on, about; n-grams that a task counts before it passes them on.
SAMPLE_DOCS, FLUSH = 2000, 200_000
#: Letters of a word, at most.
LONGEST = 64
SWITCH = 6.0
SCRIPT_SHARE = 0.001
#: Texts that a task labels at once.
STEP = 2500
CACHE = 200_000
UNKNOWN = "und"
#: Code point ranges of scripts; other letters are of the script "other".
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "thai": [(0xE00, 0xE7F)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
_NAMES = [*SCRIPTS, "other"]

_WORD = re.compile(r"[^\W\d_]+")
#: What the pattern above takes for letters though it's none: fractions, circled numbers and so on. Each goes to a blank.
_NUMERALS = {ord(c): " " for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal()}
_NUMERAL_SET = frozenset(map(chr, _NUMERALS))
#: What a text has if a word of it may be more than one, or a numeral: characters beyond Latin letters, and the numerals among those.
_BEYOND = re.compile(r"[^\x00-\xb1\xb4\xb6-\xb8\xba\xbb\xbf-\u024f\u1e00-\u1eff]").search


@lru_cache(4096)
def script_of(letter: str) -> int:
    code = ord(letter)
    for i, ranges in enumerate(SCRIPTS.values()):
        if any(a <= code <= b for a, b in ranges):
            return i
    return len(SCRIPTS)


@lru_cache(50_000)
def parts_of(run: str) -> tuple[str, ...]:
    """A run of letters, cut where the script changes and after LONGEST letters."""
    out, at = [], 0
    for i in range(1, len(run) + 1):
        if i == len(run) or i - at == LONGEST or script_of(run[i]) != script_of(run[at]):
            out.append(run[at:i])
            at = i
    return tuple(out)


def words_of(text: str) -> list[str]:
    text = text.lower()
    beyond = not text.isascii() and _BEYOND(text) is not None
    if beyond and not _NUMERAL_SET.isdisjoint(text):
        text = text.translate(_NUMERALS)
    runs = _WORD.findall(text)
    return [p for r in runs for p in parts_of(r)] if beyond or max(map(len, runs), default=0) > LONGEST else runs


def ngrams(word: str) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for n in (1, 2, 3, 4) for i in range(len(padded) - n + 1) if n > 1 or padded[i] not in "<>"]


@dataclass
class Model:
    languages: list[str]
    grams: dict[str, int]  # n-gram to its row of scores
    scores: np.ndarray  # log-probability by n-gram and language; the last row is that of unseen n-grams
    allowed: np.ndarray  # script by language

    def __post_init__(self) -> None:
        self.words: dict[str, int] = {}
        self.table = np.zeros((1 << 16, len(self.languages)), np.float32)
        self.lengths = np.zeros(1 << 16, np.int32)

    def _add(self, words: list[str]) -> None:
        first, last = len(self.words), len(self.words) + len(words)
        while last > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        parts = [ngrams(w) for w in words]
        counts = np.array([len(p) for p in parts])
        get, unseen = self.grams.get, len(self.scores) - 1
        rows = np.array([get(g, unseen) for p in parts for g in p])
        score = np.add.reduceat(self.scores[rows], np.cumsum(counts) - counts, axis=0)
        # a long word weighs as eight n-grams at most, so that no single word outweighs many
        score = (score - score.max(axis=1)[:, None]) * np.minimum(1.0, 8 / counts)[:, None]
        allowed = self.allowed[[script_of(w[0]) for w in words]]
        score = np.where(allowed, score, -50.0)
        score[~allowed.any(axis=1)] = 0.0
        self.table[first:last] = score
        self.lengths[first:last] = [len(w) for w in words]
        self.words.update(zip(words, range(first, last), strict=True))

    def numbers(self, words: list[str]) -> list[int]:
        known = self.words
        if new := {w for w in words if w not in known}:
            self._add(sorted(new))
        return [known[w] for w in words]

    def forget(self, above: int = 0) -> None:
        """Drop the words of earlier texts if there are more than `above`."""
        if len(self.words) > above:
            self.__post_init__()


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best labels of many word sequences at once: scores (text, word, language), lengths of the texts."""
    n, steps, _ = scores.shape
    best, back = scores[:, 0].copy(), np.empty(scores.shape[:2], np.int32)
    stays = np.zeros(scores.shape, bool)
    for t in range(1, steps):
        live = int(np.searchsorted(-lengths, -t))  # texts come longest first
        top = best[:live].argmax(axis=1)
        jump = best[np.arange(live), top] - switch
        back[:live, t] = top
        stays[:live, t] = best[:live] >= jump[:, None]
        best[:live] = np.where(stays[:live, t], best[:live], jump[:, None]) + scores[:live, t]
    labels = np.full((n, steps), -1, np.int32)
    state = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        live = int(np.searchsorted(-lengths, -t))
        rows = np.arange(live)
        labels[rows, t] = state[:live]
        if t:
            state[:live] = np.where(stays[rows, t, state[:live]], state[:live], back[:live, t])
    return labels


def label_words(model: Model, texts: list[str | None], switch: float = SWITCH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, the language number and the length of each of its words."""
    numbers = []
    for t in texts:
        numbers.append(np.array(model.numbers(words_of(t)), np.int64) if t else np.zeros(0, np.int64))
    out: list = [(np.zeros(0, np.int32), np.zeros(0, np.int32))] * len(texts)
    order = sorted((i for i in range(len(texts)) if len(numbers[i])), key=lambda i: -len(numbers[i]))
    at = 0
    while at < len(order):
        longest = len(numbers[order[at]])
        some = order[at : at + max(1, 300_000 // longest)]
        lengths = np.array([len(numbers[i]) for i in some])
        padded = np.zeros((len(some), longest), np.int64)
        for row, i in enumerate(some):
            padded[row, : lengths[row]] = numbers[i]
        labels = viterbi(model.table[padded], lengths, switch)
        for row, i in enumerate(some):
            out[i] = (labels[row, : lengths[row]], model.lengths[numbers[i]])
        at += len(some)
    model.forget(CACHE)
    return out


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from labelled documents; None if there are none with a letter.

    About SAMPLE_DOCS documents of each language are counted, chosen by a hash of their id, so in every run the same.
    Their n-gram counts are summed by Spark; the driver gets one row for each n-gram of the sample.
    """
    labelled = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    shares = labelled.groupBy("lang").agg((SAMPLE_DOCS / F.greatest(F.count(F.lit(1)), F.lit(SAMPLE_DOCS)) * (1 << 30)).cast("long").alias("upto"))
    sample = labelled.join(written(shares, "language-shares"), "lang").filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("upto")).select("text", "lang")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: Counter = Counter()
        for b in batches:
            for text, lang in zip(b["text"], b["lang"], strict=True):
                for word, n in Counter(words_of(text)).items():
                    grams[lang, f"\t{_NAMES[script_of(word[0])]}"] += n
                    for g in ngrams(word):
                        grams[lang, g] += n
                if len(grams) > FLUSH:
                    yield flushed(grams)
        if grams:
            yield flushed(grams)

    def flushed(grams: Counter) -> pd.DataFrame:
        out = pd.DataFrame([(*k, n) for k, n in grams.items()], columns=["lang", "gram", "n"])
        grams.clear()
        return out

    counts = sample.mapInPandas(counted, "lang string, gram string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    top = counts.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).toPandas().sort_values("gram", ignore_index=True)
    languages = sorted({lang for by in top["by"] for lang in by})
    if not languages:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    table_ = np.zeros((len(top), len(languages)))
    for i, by in enumerate(top["by"]):
        for lang, n in by.items():
            table_[i, number[lang]] = n
    grams = top["gram"].tolist()
    scripts, plain = [i for i, g in enumerate(grams) if g[0] == "\t"], [i for i, g in enumerate(grams) if g[0] != "\t"]
    allowed = np.zeros((len(_NAMES), len(languages)), bool)
    total = table_[scripts].sum(axis=0)
    for i in scripts:
        allowed[_NAMES.index(grams[i][1:])] = table_[i] >= SCRIPT_SHARE * np.maximum(total, 1)
    whole = table_[plain].sum(axis=0) + 0.5 * (len(plain) + 1)
    logs = np.log(np.concatenate([table_[plain] + 0.5, np.full((1, len(languages)), 0.5)]) / whole).astype(np.float32)
    return Model(languages, {grams[i]: row for row, i in enumerate(plain)}, logs, allowed)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """docs with `lang_pred`, `score` and `spans` (lang, words, letters of each run) added.

    score: the share of the text's letters whose words are labelled lang_pred. Null texts and texts
    without a letter (numerals are none), and all texts where there is no model, are `und` with score 0 and no spans. Equal
    shares: the first language by name. Columns of docs with the names of the added ones are replaced.
    """
    docs = docs.drop("lang_pred", "score", "spans")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    one = "struct<lang_pred: string, score: double, spans: array<struct<lang: string, words: int, letters: int>>>"

    @F.pandas_udf(one)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            found: list = []
            for at in range(0, len(texts), STEP):
                some = texts.iloc[at : at + STEP].tolist()
                found += label_words(m, some, switch) if m else [((), ())] * len(some)
            langs, scores, spans = [], [], []
            for labels, letters in found:
                if not len(labels):
                    langs.append(UNKNOWN), scores.append(0.0), spans.append([])
                    continue
                share = np.bincount(labels, weights=letters, minlength=len(m.languages))
                best = int(share.argmax())
                langs.append(m.languages[best]), scores.append(float(share[best] / share.sum()))
                edges = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)]
                sums = np.concatenate([[0], np.cumsum(letters)])
                spans.append([{"lang": m.languages[labels[a]], "words": b - a, "letters": int(sums[b] - sums[a])} for a, b in zip(edges, edges[1:], strict=False)])
            yield pd.DataFrame({"lang_pred": langs, "score": scores, "spans": spans})
        if m:
            m.forget()  # an idle worker holds no words
        give_back()

    (made,) = fresh(docs, "_label")
    return docs.withColumn(made, label(F.col(text_col))).select(*docs.columns, f"{made}.lang_pred", f"{made}.score", f"{made}.spans")


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~is_held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
