"""Cases in which an operator once did less than the whole job."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlight.llm.lines import LIKENESS, LONG, LONG_DOCS, MAJORITY, MIN_DOCS, drop_recurring, leaf_of, n_fixed, op4_lines, tokens_of
from ledgerlight.llm.pii import LETTERS, REVEAL, SUPPORT, op10_pii, redacted, sanitise

from .test_pii import base

SF = "/root/testdata/sf0.01"

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_a_document_of_lines_from_several_others_loses_them(spark):
    names = ["alma", "boris", "chen", "dara", "emil", "fadi"]
    lines = [f"{' '.join(names[i:] + names[:i])} recur in many texts" for i in range(5)]
    rows = [(10 * i + j, f"{x}\n{names[j]} has written the line {names[i]}", "en", "a", 0) for i, x in enumerate(lines) for j in range(5)]
    rows.append((99, "\n".join([*lines, "own end"]), "en", "a", 0))
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, spark.createDataFrame(rows, DOCUMENTS), "").collect()}
    assert got[99] == "own end" and all(x in got[10 * i] for i, x in enumerate(lines))


def brute_lines(rows):
    """rows (id, text) to (id, lines, dropped, text): a line goes if its own or its leaf's template recurs elsewhere first."""
    need = lambda fixed: LONG_DOCS if fixed >= LONG else MIN_DOCS
    lines = [(i, t, n, tuple(tokens_of(x))) for i, t in rows for n, x in enumerate((t or "").split("\n")) if x.split()]
    seen, leaves = defaultdict(set), defaultdict(set)
    for _, t, _, tokens in lines:
        seen[tokens].add(t)
        leaves[leaf_of(list(tokens))].add(tokens)
    final = {k: [(k, n_fixed(k))] for k in seen}
    for leaf, kinds in leaves.items():
        docs = sum(len(seen[k]) for k in kinds)
        if len(kinds) == 1 or docs < need(max(map(n_fixed, kinds))):
            continue
        kept = {}
        for pos in range(len(next(iter(kinds)))):
            votes = Counter()
            for k in kinds:
                votes[k[pos]] += len(seen[k])
            token, n = votes.most_common(1)[0]
            if n > MAJORITY * docs:
                kept[pos] = token
        for k in kinds:
            if kept and all(k[p] == t for p, t in kept.items()) and len(kept) >= LIKENESS * len(k):
                final[k].append((("leaf", leaf), n_fixed(list(kept.values()))))
    texts, first = defaultdict(set), {}
    for i, t, n, tokens in lines:
        for f, _ in final[tokens]:
            texts[f].add(t)
            at = ((i is not None, i), n)
            first[f] = min(first.get(f, at), at)
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        gone = {n for n, x in enumerate(every) if x.split() for f, c in final[tuple(tokens_of(x))] if len(texts[f]) >= need(c) and first[f] != ((i is not None, i), n)}
        out.append((i, sum(1 for x in every if x.split()), len(gone), "\n".join(x for n, x in enumerate(every) if n not in gone) if gone else t))
    return sorted(out, key=str)


def test_lines_with_long_passages_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, a, b, hashlib.sha256(t.encode()).hexdigest()) for i, a, b, t in brute_lines(rows)]
    assert sorted((tuple(r) for r in op4_lines(spark, SF).collect()), key=str) == sorted(want, key=str)


def test_a_long_passage_of_two_texts_stays_once(spark):
    passage = " ".join(f"word{'abcdefghijklmnopqrstuvwxyz'[i]}" for i in range(26))
    other = " ".join(f"{'abcdefghijklmnopqrstuvwxyz'[i]}term" for i in range(26))
    rows = [(1, f"one begins\n{passage} of 7 days\nshort and clean"), (2, f"two begins\n{passage} of 12 days\nshort and clean"), (3, "short and clean\nend")]
    rows += [(4, f"four\n{other} red"), (5, f"five\n{other} blue"), (6, " ".join(str(i) for i in range(90)) + "\nsix"), (7, " ".join(str(3 * i) for i in range(90)) + "\nseven")]
    rows += [(8, f"eight\n{passage[::-1]}"), (9, f"eight\n{passage[::-1]}")]
    got = drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"))
    out = sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=str)
    assert out == brute_lines(rows)
    assert {r[0]: r[2] for r in out} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1, 6: 0, 7: 0, 8: 0, 9: 0}


def marked(spark, rows):
    out = sanitise(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r[0]: r[1] for r in out.select("doc_id", redacted(F.col("text"), F.col("spans"))).collect()}


def test_values_of_one_text_each_are_assessed_by_their_domain(spark):
    rows = [(i, f"common words here from person{i}@zorb.example again. {'common words here again ' * 5}Then Zorblatt writes") for i in range(5)]
    rows += [(10 + i, f"common words here from person{i}@other.example again then writes") for i in range(20)]
    rows += [(100 + i, f"common words here from again then writes {i}") for i in range(60)]
    got = marked(spark, rows)
    assert all("Zorblatt" not in got[i] and "<EMAIL>" in got[i] and "common words here from" in got[i] and "Then" in got[i] for i in range(5))
    assert all(got[10 + i] == "common words here from <EMAIL> again then writes" for i in range(20)) and got[100] == rows[25][1]


def test_a_term_in_the_next_sentence_is_marked(spark):
    rows = [(i, f"write to qux@y.example please. {'common words here again ' * 20} Quxley asks {i}") for i in range(4)]
    rows += [(10 + i, f"write to person{i}@y.example please common words here again asks") for i in range(30)]
    rows += [(100 + i, f"write please common words here again asks {i}") for i in range(60)]
    got = marked(spark, rows)
    assert all("Quxley" not in got[i] and "common words here again" in got[i] and "asks" in got[i] for i in range(4))


def brute_terms(rows):
    """rows (id, text) to id, base and term spans: values, e-mail domains and kinds against all words of their documents."""
    word = re.compile(rf"[^\W\d_]{{{LETTERS},}}")
    n_t, n_c, n_ct, texts, all_spans, whole = Counter(), Counter(), Counter(), defaultdict(set), [], []
    for _, t in rows:
        n_t.update(set(word.findall((t or "").lower())))
        spans = base(t or "")
        words = [(m.start(), m.end(), m[0].lower()) for m in word.finditer(t or "") if not any(a < m.end() and m.start() < b for _, a, b, _ in spans)]
        values = {k + ":" + (v.lower() if k == "email" else v if k == "ip" else re.sub("[^0-9]", "", v)) for k, _, _, v in spans}
        who = values | {k for k, *_ in spans} | {"@" + v.split("@")[1].lower() for k, _, _, v in spans if k == "email"}
        n_c.update(who)
        for pair in {(e, w) for e in who for _, _, w in words}:
            n_ct[pair] += 1
            texts[pair].add(t)
        all_spans.append(spans), whole.append((who, words))
    n, over = len(rows), set()
    for (e, w), c in n_ct.items():
        ic = -math.log2(n_c[e] / n)
        if len(texts[e, w]) >= SUPPORT and ic > 0 and math.log2(c * n / (n_c[e] * n_t[w])) / ic >= REVEAL - 1e-12:
            over.add((e, w))
    out = []
    for (i, _), spans, (who, words) in zip(rows, all_spans, whole, strict=True):
        terms = [f"term:{a}:{b}" for a, b, w in words if any((e, w) in over for e in who)]
        out.append((i, ",".join([f"{k}:{a}:{b}" for k, a, b, _ in spans] + terms)))
    return sorted(out, key=str)


def test_terms_of_whole_documents_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got, want = sorted((tuple(r) for r in op10_pii(spark, SF).select("doc_id", "spans").collect()), key=str), brute_terms(rows)
    assert got == want
