import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlight.llm.pii import LETTERS, REVEAL, SUPPORT, redacted, sanitise

SF = "/root/testdata/sf0.01"
#: Characters around a base span that are its context: all of them.
WINDOW = 1 << 31
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end(), m[0]))
    return out


def brute(rows):
    """By exact values alone: enough where no kind or e-mail domain reveals more than its values (test_whole_job has the query's)."""
    n, found = len(rows), [base(t or "") for _, t in rows]
    word = re.compile(rf"[^\W\d_]{{{LETTERS},}}")
    df = defaultdict(int)
    for _, t in rows:
        for w in set(word.findall((t or "").lower())):
            df[w] += 1
    contexts, pair, texts, ent = [], defaultdict(int), defaultdict(set), defaultdict(int)
    for (_, t), spans in zip(rows, found, strict=True):
        mine = []
        for kind, a, b, v in spans:
            e = kind + ":" + (v.lower() if kind == "email" else v if kind == "ip" else re.sub("[^0-9]", "", v))
            at = max(a - WINDOW, 0)
            hits = [(at + m.start(), at + m.end(), m[0]) for m in word.finditer(t[at:a]) if m.start() > 0 or at == 0]
            hits += [(b + m.start(), b + m.end(), m[0]) for m in word.finditer(t[b : b + WINDOW]) if m.end() < WINDOW]
            mine += [(e, w.lower(), s, x) for s, x, w in hits if not any(p < x and s < q for _, p, q, _ in spans)]
            ent[e] += 0
        for e in {k + ":" + (v.lower() if k == "email" else v if k == "ip" else re.sub("[^0-9]", "", v)) for k, _, _, v in spans}:
            ent[e] += 1
        for e, w in {(e, w) for e, w, _, _ in mine}:
            pair[e, w] += 1
            texts[e, w].add(t)
        contexts.append(mine)
    over = set()
    for (e, w), c in pair.items():
        ic = -math.log2(ent[e] / n)
        if len(texts[e, w]) >= SUPPORT and ic > 0 and math.log2(c * n / (ent[e] * df[w])) / ic >= REVEAL - 1e-12:
            over.add((e, w))
    out = []
    for (i, _), spans, mine in zip(rows, found, contexts, strict=True):
        every = [f"{k}:{a}:{b}" for k, a, b, _ in spans]
        terms = sorted({(a, b) for e, w, a, b in mine if (e, w) in over})
        out.append((i, *(sum(s[0] == k for s in spans) for k in KINDS), hashlib.sha256(",".join(every).encode()).hexdigest(), ",".join(every + [f"term:{a}:{b}" for a, b in terms])))
    return sorted(out, key=str)


def have(df):
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda *k: F.filter("spans", lambda s: s["kind"].isin(*k))
    return sorted((tuple(r) for r in df.select("doc_id", *[F.size(of(k)) for k in KINDS], F.sha2(joined(of(*KINDS)).cast("binary"), 256), joined(F.col("spans"))).collect()), key=str)


TRICKY = ["", None, "a@b.c%d@e.f..g@h.i", "x@y", "@a.b", "a@b.c.", "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.255 00255.01.1.1 1.1.1.99999999999", "4111 1111 1111 1111", "4111-1111-1111-1112 5500005555555559",
          "+1 (415) 555-0100", "+12", "+123456789012345678", "++44 20 7946 0958, é+33 1 23 45 67 89", "é" * 30 + "mail: josé@x.org ü", "0" * 40, "1" * 19 + " 2", "12 34 56", "a@b.co" * 50, "%" * 5000 + "@x", "1." * 3000, "+1" * 2000]


def test_odd_texts(spark):
    rows = list(enumerate(TRICKY)) + [(None, "me@x.yz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("key", F.lit(1))
    assert have(sanitise(df)) == brute(rows)
    assert have(sanitise(df.unionByName(df))) == brute(rows + rows)
    assert sanitise(df.limit(0)).count() == 0


def revealing():
    rows = [(i, f"note {i} common words here and the agent Zorblatt writes from z.blatt@corp.example again about common words {i * 7}") for i in range(6)]
    rows += [(10 + i, f"the common words here and again about others writes from other{i}@corp.example note") for i in range(20)]
    return rows + [(100 + i, f"common words here and again the agent writes note from others about nothing number {i}") for i in range(60)]


def test_revealing_terms(spark):
    rows = revealing()
    out = sanitise(spark.createDataFrame(rows, "doc_id long, text string"))
    assert have(out) == brute(rows)
    marked = {r["doc_id"]: r["t"] for r in out.select("doc_id", redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert "Zorblatt" not in marked[0] and "<EMAIL>" in marked[0] and "common words here" in marked[0]
    assert marked[100] == rows[26][1]


@pytest.mark.parametrize("n", [1, 4])
def test_copies_are_one_text_for_the_support(spark, n):
    rows = [(i, "call Quxley now at qux@y.example please") for i in range(10 * n)] + [(1000 + i, f"call now at the desk please {i}") for i in range(30)]
    assert have(sanitise(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert not any("term" in r[-1] for r in brute(rows))


def long_texts(n):
    return ["7" * n, "1 " * n, "1  " * n + "4111 1111 1111 1111", "a@" + "b." * n + "c", "x@y" + ".z" * n + "..q@r.s", "." * n + "@a.b", "a.b" * n + "@c.d..e@f.g", "+1" + "()" * n + "234567890", "1.2.3.4 " * n, "me@x.yz, " * n,
            "1." * n + "2", "4111-1111-1111-1111--4111 1111 1111 1111 -- 5500 0055 5555 5559 ", "a\x01b@c.d\x01.e@f.g \x02.h@i.j", ".a@b.c -4111111111111111-"]


def spans_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    return {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in sanitise(df).collect()}


def test_long_runs_equal_brute_force(spark):
    texts = long_texts(5000)
    out = spans_of(spark, texts)
    for i, t in enumerate(texts):
        assert out[i] == [(k, a, b) for k, a, b, _ in base(t)], i


def test_very_long_runs(spark):
    """Here brute force is too slow; the matches are known."""
    n = 100_000
    out = spans_of(spark, ["7" * 1_000_000, *long_texts(n)[1:11]])
    mail = lambda a, b: [("email", a, b)]
    want = [[], [], [("card", 3 * n, 3 * n + 19)], mail(0, 2 * n + 3), mail(0, 3 + 2 * n) + mail(3 + 2 * n, 2 * n + 10), mail(0, n + 4), mail(0, 3 * n + 4) + mail(3 * n + 4, 3 * n + 11), [("phone", 0, 2 * n + 11)],
            [("ip", 8 * i, 8 * i + 7) for i in range(n)], [("email", 9 * i, 9 * i + 7) for i in range(n)], [("ip", 8 * i, 8 * i + 7) for i in range(n // 4)]]
    assert [out[i] for i in range(len(want))] == want


def test_terms_beside_mails(spark):
    """Words that touch an e-mail are none of the terms; others are, however near."""
    from ledgerlight.llm.pii import term_spans

    texts = ["Zorb zorb@x.yz zorb", "ézorb@x.yz zorb", "zorb_é zorb.a@x.yz zorb@", "ééé_zorb@x.yz ééé", "zorb@x zorb.@x.y-zorb zorb"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("terms", F.create_map(*[F.lit(x) for x in ("zorb", "remove", "ézorb", "remove", "ééé", "remove")]))
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["t"]] for r in df.select("doc_id", term_spans(F.col("text"), F.col("terms")).alias("t")).collect()}
    for i, t in enumerate(texts):
        spans = base(t)
        assert got[i] == [m.span() for m in re.finditer(r"[^\W\d_]+", t) if m[0].lower() in ("zorb", "ézorb", "ééé") and not any(a < m.end() and m.start() < b for _, a, b, _ in spans)], t
