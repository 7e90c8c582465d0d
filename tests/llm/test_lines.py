import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ledgerlight.llm.lines import LIKENESS, MAJORITY, MIN_DOCS, drop_recurring, leaf_of, tokens_of

SF = "/root/testdata/sf0.01"


def brute(rows, min_docs=MIN_DOCS, spare=None):
    """For lines that are all shorter than a long one (test_whole_job has the query's)."""
    """rows (id, text) to (id, lines, dropped, text), by the tree's definition."""
    lines = [(i, t, n, tuple(tokens_of(x))) for i, t in rows for n, x in enumerate((t or "").split("\n")) if x.split()]
    seen, leaves = defaultdict(set), defaultdict(set)
    for _, t, _, tokens in lines:
        seen[tokens].add(t)
        leaves[leaf_of(list(tokens))].add(tokens)
    final = {}
    for leaf, kinds in leaves.items():
        docs = sum(len(seen[k]) for k in kinds)
        kept = {}
        if len(kinds) > 1 and docs >= min_docs:
            for pos in range(len(next(iter(kinds)))):
                votes = Counter()
                for k in kinds:
                    votes[k[pos]] += len(seen[k])
                token, n = votes.most_common(1)[0]
                if n > MAJORITY * docs:
                    kept[pos] = token
        for k in kinds:
            fits = kept and all(k[p] == t for p, t in kept.items()) and len(kept) >= LIKENESS * len(k)
            final[k] = ("leaf", leaf) if fits else k
    texts, first = defaultdict(set), {}
    for i, t, n, tokens in lines:
        f = final[tokens]
        texts[f].add(t)
        at = ((i is not None, i), n)
        first[f] = min(first.get(f, at), at)
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        gone = {n for n, x in enumerate(every) if x.split() and len(texts[f := final[tuple(tokens_of(x))]]) >= min_docs and first[f] != ((i is not None, i), n)}
        if spare is not None and gone and sum(len(every[n]) for n in gone) >= spare * sum(len(x) for x in every if x.split()):
            gone = set()
        out.append((i, sum(1 for x in every if x.split()), len(gone), "\n".join(x for n, x in enumerate(every) if n not in gone) if gone else t))
    return sorted(out, key=str)


def have(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=str)


def test_variable_fields_are_generalised(spark):
    rng = random.Random(2)
    names = ["alma", "boris", "chen", "dara", "emil", "fadi", "gita", "hugo"]
    rows = [(i, f"Page {i} of {i * 3}\nThis page was last edited by {n} and others today\nown text {n} " + " ".join(rng.choice(names) for _ in range(5))) for i, n in enumerate(names)]
    rows += [(20 + i, f"an unrelated line number words {n}") for i, n in enumerate(names[:3])]
    got = have(drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)
    by = {r[0]: r for r in got}
    assert by[0][2] == 0 and "edited by alma" in by[0][3] and all("edited" not in by[i][3] and "Page" not in by[i][3] for i in range(1, 8))
    assert all(by[i][2] == 0 for i in (20, 21, 22))


def test_odd_rows(spark):
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "a b c\n\na b c"), (None, "a b c"), (5, "x\na b c"), (6, "a  b c\ny"), (7, "a b c\nz"), (8, "a b c " * 40_000), (9, "1\n2\n3"), (10, "4\nq"), (11, "5\nr"), (12, "6 \ns"), (13, "7\nt")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_dropped", F.lit("?")).withColumn("key", F.lit(1)).withColumn("gone", F.lit(1))
    assert have(drop_recurring(df)) == brute(rows)
    assert have(drop_recurring(df.unionByName(df))) == brute(rows + rows)
    assert drop_recurring(df.limit(0)).count() == 0


def test_copies_of_documents_keep_their_lines(spark):
    rows = [(i, "the same long line of text\nand another one of them") for i in range(30)]
    assert all(r[2] == 0 for r in have(drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"))))
