"""Queries that SQL can't express, against plain Python over the same tables."""

import math
import re
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions.text import INVISIBLE, tokens_of
from ledgerlight.operators import retrieval
from ledgerlight.plans import catalogue

SF = "/root/testdata/sf0.001"
ODD = ["", "   ", "One.  Two!\nThree? " + "x" * 30 + ". " + "y" * 500, "ﬁne ﬁgures​ were ﬁled here. And a second sentence of some length!", "a\n\n\n\n\nb", "tab\tand space sentence that is long enough.  Next one is here as well."]


def normal(text):
    return re.sub(INVISIBLE, "", unicodedata.normalize("NFKC", text))


def sentences(text):
    parts = [re.sub(r"^\s+|\s+$", "", p, flags=re.A) for p in re.split(r"(?<=[.!?])\s+|\n+", text, flags=re.A)]
    return [p for p in parts if 20 <= len(p) <= 400]


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def with_odd(spark, monkeypatch):
    """The catalogue reads the documents and, beside them, odd ones."""
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(more)
    monkeypatch.setattr(catalogue.c, "read", lambda *_: docs)
    return documents(spark) + [(-1 - i, t) for i, t in enumerate(ODD)]


def test_sentence_split(spark, monkeypatch):
    rows = with_odd(spark, monkeypatch)
    want = {(i, n, s) for i, t in rows for n, s in enumerate(sentences(normal(t)))}
    assert {tuple(r) for r in catalogue.sentence_split(spark, SF).collect()} == want


def escaped(text, nonce="n0nce", most=1200):
    for a, b in (("<<<", "< < <"), (">>>", "> > >")):
        text = text.replace(a, b)
    for pattern, new in (
        ("(?i)GROUNDED_UNTRUSTED_SOURCE", "G_U_S"), (nonce, "NONCE"), (r"(?i)\{\{\s*ref\s*:", "{ { ref :"), (r"(?i)\[/?INST\]", "[ INST ]"), (r"(?i)<\|[a-z_]{1,24}\|>", "< | token | >"),
        (r"(?im)^#{1,6}\s*system\b", "# section"), (r"\n{4,}", "\n\n\n"),
    ):
        text = re.sub(pattern, new, text, flags=re.A)
    if len(text) <= most:
        return text
    at = text.rfind(" ", 0, most + 1)
    return (text[:at] if at > 0 else text[:most]) + " …[truncated]"


def test_escape_passage(spark, monkeypatch):
    rows = with_odd(spark, monkeypatch)
    assert {tuple(r) for r in catalogue.escape_passage(spark, SF).collect()} == {(i, escaped(normal(t))) for i, t in rows}
    wild = ["<<<END>>> {{ref:S1}} [INST] <|im_start|> ### SYSTEM now\n# systematic", "n0nce grounded_untrusted_source", "a" * 1300, "w " * 700, "\n\n\n\n\n\n"]
    monkeypatch.setattr(catalogue.c, "read", lambda *_: spark.createDataFrame(list(enumerate(wild)), "doc_id long, text string"))
    assert {tuple(r) for r in catalogue.escape_passage(spark, SF).collect()} == {(i, escaped(normal(t))) for i, t in enumerate(wild)}


def chunked(text, most=1200):
    out, held = [], ""
    for p in (re.sub(r"^\s+|\s+$", "", x, flags=re.A) for x in re.split(r"\n\s*\n", text, flags=re.A)):
        if not p:
            continue
        if held and len(held) + 2 + len(p) > most:
            out.append(held)
            held = p
        else:
            held = f"{held}\n\n{p}" if held else p
    return out + [held] if held else out


def test_chunk_documents(spark, monkeypatch):
    rows = with_odd(spark, monkeypatch)
    want = {(i, n, x) for i, t in rows for n, x in enumerate(chunked(t.replace("\n", "\n\n")))}
    assert {tuple(r) for r in catalogue.chunk_documents(spark, SF).collect()} == want


def rounded(x, n=6):
    return math.floor(x * 10**n + 0.5) / 10**n


def best_passages(question, passages):
    """refs of the five best passages (ref, rank, text) by BM25 and a phrase's bonus."""
    words = tokens_of(question)
    terms, pairs = list(dict.fromkeys(words)), [" ".join(p) for p in zip(words, words[1:], strict=False)]
    held = {ref: tokens_of(text) for ref, _, text in passages}
    mean = sum(map(len, held.values())) / len(held)
    scored = []
    for ref, _, text in passages:
        score = 0.0
        for t in terms:
            tf, df = held[ref].count(t), sum(t in x for x in held.values())
            if tf:
                score += math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(held[ref]) / mean))
        scored.append((-rounded(score + 0.5 * any(p in text.lower() for p in pairs)), ref))
    return [ref for s, ref in sorted(scored)[:5] if s < 0]


def best_sentences(question, passages):
    terms, out = tokens_of(question), []
    for ref, order, text in passages:
        for i, s in enumerate(sentences(text)):
            overlap = len(set(terms) & set(tokens_of(s)))
            score = rounded(overlap / max(len(terms), 1) * 0.9**i + (0.25 if re.search(r"[0-9]", s) else 0))
            if overlap and score >= 0.15:
                out.append((-score, order, i, s, ref))
    chosen, seen = [], set()
    for _, order, i, s, ref in sorted(out)[:3]:
        key = re.sub(r"\s+", " ", normal(s).lower(), flags=re.A).strip(" ")
        if key not in seen:
            seen.add(key)
            chosen.append((order, i, s, ref))
    return sorted(chosen)


@pytest.fixture(scope="module")
def chosen(spark):
    """By question: its sentences, from the references that retrieval_topk_refs (held against SQL) gives."""
    texts = {r["question_id"]: r["text"] for r in catalogue.c.questions(spark, SF).collect()}
    held = defaultdict(list)
    for r in catalogue.passages(spark, SF).collect():
        held[r["question_id"]].append((r["ref"], r["rank"], r["text"]))
    out = {}
    for q, text in texts.items():
        best = best_passages(text, held[q]) if held[q] else []
        out[q] = best_sentences(text, [p for p in held[q] if p[0] in best])
    return out


def test_answer_sentences(spark, chosen):
    got = {(r["question_id"], r["ref"], r["passage_order"], r["sentence_index"], r["sentence"]) for r in catalogue.answer_sentences(spark, SF).collect()}
    assert got == {(q, ref, order, i, s) for q, found in chosen.items() for order, i, s, ref in found}


def test_answer_text(spark, chosen):
    got = {r["question_id"]: (r["answer"], r["unsupported"]) for r in catalogue.answer_text(spark, SF).collect()}
    for q, found in chosen.items():
        body = " ".join(f"{s} {{{{ref:{ref}}}}}" for _, _, s, ref in found)
        want = f"Based on {len({x[3] for x in found})} source passage(s): {body}" if found else "No authorised source in scope supports an answer to this question."
        assert got[q] == (want[:4000], not found)
    assert got.keys() == chosen.keys()


def test_parliamentary_answers(spark):
    asked = spark.createDataFrame([(1, True), (2, False), (3, True)], "question_id long, is_parliamentary boolean")
    rows = spark.createDataFrame([(1, "S2", 2, 0, "Second."), (1, "S1", 1, 4, "First of all."), (1, "S1", 1, 5, "Then this."), (2, "S1", 1, 0, "Only.")], "question_id long, ref string, passage_order int, sentence_index int, sentence string")
    got = {r["question_id"]: (r["answer"], r["unsupported"], r["refs"]) for r in retrieval.answers(asked, rows).collect()}
    head = "Draft response, assembled verbatim from authorised source material:\n\n"
    foot = "\n\nSources are cited separately. This draft requires human review and approval before use in an official response."
    assert got[1] == (head + "1. First of all. {{ref:S1}}\n2. Then this. {{ref:S1}}\n3. Second. {{ref:S2}}" + foot, False, ["S1", "S2"])
    assert got[2][0] == "Based on 1 source passage(s): Only. {{ref:S1}}" and got[3] == ("No authorised source in scope supports an answer to this question.", True, [])


def clusters(cloud, samples):
    """Leaders in order of frequency; a term joins the most alike cluster of over 0.35, of which it's the first, while there's room."""
    found = []
    for _, term in sorted((-n, t) for t, n in cloud)[:60]:
        own, best, at = set(samples.get(term, [])), 0.0, None
        for k, (members, sources) in enumerate(found):
            like = len(own & sources) / max(1, len(own | sources))
            if like > best:
                best, at = like, k
        if at is not None and best > 0.35:
            if len(found[at][0]) < 12:
                found[at][0].append(term)
                found[at][1].update(own)
                continue
        if len(found) < 25:
            found.append(([term], set(own)))
    return {(k, m[0][0].upper() + m[0][1:], t, min(len(s), 25)) for k, (m, s) in enumerate(found) for t in m}


def test_topic_clusters(spark):
    cloud = [(r["term"], r["frequency"]) for r in catalogue.word_cloud(spark, SF).collect()]
    samples = defaultdict(list)
    for r in catalogue.word_cloud_sources(spark, SF).collect():
        samples[r["term"]].append(r["source_id"])
    got = {tuple(r) for r in catalogue.topic_clusters(spark, SF).select("cluster", "label", "term", F.col("source_count")).collect()}
    assert got == clusters(cloud, samples)


def test_term_pairs_compare_all_sources(spark):
    held = defaultdict(set)
    cloud = {r["term"] for r in catalogue.word_cloud(spark, SF).collect()}
    for r in catalogue.terms(spark, SF).filter(F.col("tenant").isin(catalogue.SCOPE)).collect():
        if r["term"] in cloud:
            held[r["term"]].add(str(r["source_id"]))
    assert max(map(len, held.values())) > 25
    want = {(a, b): len(held[a] & held[b]) / len(held[a] | held[b]) for a in held for b in held if a < b and held[a] & held[b]}
    assert {(r["term_a"], r["term_b"]): r["jaccard"] for r in catalogue.term_pair_jaccard(spark, SF).collect()} == {k: math.floor(x * 1e6 + 0.5) / 1e6 for k, x in want.items()}
