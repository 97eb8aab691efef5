import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate as D

SF = "/root/testdata/sf0.01"


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, size=10):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - size + 1, 1)) if w else ():
            windows[tuple(w[k : k + size])].add(str(i))
    out = {}
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= found
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def rows(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_whole_table(spark, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    docs, items = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    want = brute([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    try:
        got = rows(D.check(docs, items))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want
    print("contaminated", sum(x[4] for x in got.values()))


def test_small_alphabet(spark):
    r = random.Random(9)
    text = lambda n: " ".join(r.choice("ab") for _ in range(n))
    docs = [(i, text(r.randrange(80))) for i in range(150)] + [(500, None), (501, ""), (502, "É ab" * 3000), (503, "A  a, a\x00B")]
    items = [(i, text(r.randrange(1, 16))) for i in range(10)] + [(20, None), (21, "-"), (22, "éab É"), (22, "éab É")]
    df, test = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(D.check(df, test)) == brute(docs, items)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c", 1), (1, "a b c", 2), (None, "a b c", 3), (None, "x", 4), (1, "other text", 5)], "doc_id long, text string, items int")
    test = spark.createDataFrame([(7, "b c", 0)], "item_id long, text string, row int")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.items) for r in D.check(df, test).collect())
    assert got == [(0, 1, 0, []), (0, 3, 2, ["7"]), (1, 2, 0, []), (1, 3, 2, ["7"]), (1, 3, 2, ["7"])]
    assert sorted((r.input["items"], r.n_hit) for r in D.check(df, test, keep=("items",)).collect()) == [(1, 2), (2, 2), (3, 2), (4, 0), (5, 0)]
    assert D.check(df.limit(0), test).count() == 0
    assert {r.n_hit for r in D.check(df, test.limit(0)).collect()} == {0}


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    docs, items = [(1, long + " one two three"), (2, "the " * 100_000)], [(1, "w7 w8"), (2, "two three"), (3, "the the the")]
    df, test = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(D.check(df, test)) == brute(docs, items)


def test_near_matches(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "c a b"), (3, "a x x x x b c"), (None, "x x x a b c"), (3, "b")], "doc_id long, text string")
    items = spark.createDataFrame([("q", "A b c b"), ("e", None)], "item_id string, text string")
    assert sorted((r.doc_id or 0, r.item_id, r.start, r.end) for r in D.proximity(docs, items, 2).collect()) == [(0, "q", 3, 5), (1, "q", 0, 4), (2, "q", 0, 2)]


def test_near_matches_against_brute_force(spark):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice("abcdef") for _ in range(r.randrange(40)))) for i in range(40)]
    items, slop, want = [("x", "a b c"), ("y", "d"), ("z", "f e")], 2, set()
    for d, t in docs:
        w = words(t)
        for item, q in items:
            need = set(words(q))
            for i, x in enumerate(w):
                seen = {}
                for j in range(i, min(i + len(need) + slop, len(w))):
                    seen.setdefault(w[j], j)
                if x in need and need <= set(seen):
                    want.add((d, item, i, max(seen[y] for y in need)))
    got = D.proximity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), slop)
    assert {tuple(r) for r in got.collect()} == want


def shuffled(spark):
    """Bytes that all stages so far have written for a shuffle."""
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_only_rows_to_compare_are_shuffled(spark, tmp_path):
    leaked = " ".join(f"x{i}" for i in range(60))
    clean = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda i: F.hash(i, "id").cast("string")), " ")
    docs = spark.range(0, 2000, 1, 8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 0, F.lit(leaked)).otherwise(clean).alias("text"))
    docs.write.parquet(str(tmp_path / "docs"))
    items = spark.createDataFrame([(1, leaked)], "item_id long, text string")
    before = set(shuffled(spark))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")  # places are larger, a bit a row isn't
    try:
        got = D.check(spark.read.parquet(str(tmp_path / "docs")), items, keep=("text",)).groupBy("n_words", "n_hit", "items").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {tuple(map(str, r)) for r in got} == {("60", "60", "['1']", "400"), ("2000", "0", "[]", "1600")}
    assert sum(n for k, n in shuffled(spark).items() if k not in before and n > 5e6) == 0  # the clean texts have 35 MB
