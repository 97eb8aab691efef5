import hashlib
import re

from quarry.llm.substring_dedup import COVER, PERIOD, remove_repeats


def brute(docs, length):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - length + 1):
            first.setdefault(tuple(words[d][i : i + length]), d)
    out = []
    for d, _ in docs:
        w, gone = words[d], set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone |= set(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def rows(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_against_brute_force(spark):
    import random

    r = random.Random(3)
    passage = [f"p{i}" for i in range(400)]
    docs = [(0, " ".join(passage))]
    for d in range(1, 60):
        w = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(150))]
        for _ in range(r.randrange(4)):
            n, at = r.choice([48, 49, 50, 51, 63, 80, 120]), r.randrange(280)
            k = r.randrange(len(w) + 1)
            w[k:k] = passage[at : at + n]
        docs.append((d, r.choice([" ", "\n", "\t "]).join(w)))
    docs += [(100, docs[7][1]), (101, docs[7][1]), (102, None), (103, ""), (104, "é " * 70), (105, "é " * 60), (106, " ".join(passage * 3))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows(remove_repeats(df)) == brute(docs, 50)


def test_edges(spark):
    text = " ".join(f"x{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (None, text, "c"), (2, text, "d")], "doc_id long, text string, starts string")
    got = {(r.doc_id, r.n_removed) for r in remove_repeats(df).collect()}
    assert got == {(1, 0), (None, 0), (2, 60)}
    assert remove_repeats(df.limit(0)).count() == 0


def test_rows_of_one_id_are_cut_by_their_own_text(spark):
    text = " ".join(f"x{i}" for i in range(60))
    other = " ".join(f"y{i}" for i in range(80))
    df = spark.createDataFrame([(1, text), (5, text), (5, other), (5, "short"), (None, text), (None, text), (7, other), (8, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_words, r.n_removed) for r in remove_repeats(df).collect())
    assert got == [(0, 60, 0), (0, 60, 0), (1, 60, 0), (5, 1, 0), (5, 60, 60), (5, 80, 0), (7, 80, 80), (8, 0, 0)]


def test_very_long_text_and_whole_table(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10**6, long), (10**6 + 1, "a b " + long), (10**6 + 2, "z " * 50_000)]
    assert rows(remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))) == brute(docs, 50)
