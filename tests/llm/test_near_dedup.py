import random
import re

from quarry.llm.near_dedup import CHUNKS, DISTANCE, SYMBOLS, _keys, link


def brute(docs, k):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    low = {d: d for d in sets}

    def root(d):
        while low[d] != d:
            d = low[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d in ids)


def fixture():
    r = random.Random(5)
    word = lambda: f"W{r.randrange(10**5)}"
    docs = []
    for _ in range(12):
        base = [word() for _ in range(r.choice([30, 90, 200]))]
        for _ in range(r.randrange(1, 9)):
            w = list(base)
            for _ in range(r.randrange(6)):
                w[r.randrange(len(w))] = word()
            docs.append(" ".join(w))
    chain = [word() for _ in range(120)]  # neighbours are linked, the ends are not
    for i in range(10):
        chain[i * 10] = word()
        docs.append(" ".join(chain))
    docs += ["a b", "A  B", "a b c", "a b c d", "A\nb\tc d", "", None, docs[0].lower(), "É b c d"]
    order = list(range(len(docs)))
    r.shuffle(order)
    return list(zip(order, docs, strict=True))


def test_against_brute_force(spark):
    docs = fixture()
    got = link(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shingle=4)
    assert sorted(tuple(r)[:4] for r in got.collect()) == brute(docs, 4)


def test_edges(spark):
    text, other = "a b c d e f", "one two three four five six seven"
    docs = [(1, text, 1), (1, text, 2), (None, text, 3), (4, other, 4), (1, other, 5), (None, "q r s t u", 6), (None, "q r s t u", 7), (8, None, 8), (None, "", 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, rep int")
    rows = link(df, keep=("rep", "text")).collect()
    assert {r.input.rep: (r.component_id, r.kept) for r in rows} == {1: (1, True), 2: (1, True), 3: (1, False), 4: (1, False), 5: (1, True), 6: (None, [r.first for r in rows if r.input.rep == 6][0]), 7: (None, [r.first for r in rows if r.input.rep == 7][0]), 8: (8, True), 9: (None, True)}
    assert {r.input.text for r in rows if r.first} == {text, other, "q r s t u", None, ""} and sum(r.first for r in rows) == 5
    assert link(df.limit(0)).count() == 0


def test_whole_table_and_a_very_long_text(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    long = " ".join(f"w{i}" for i in range(150_000))
    docs += [(10**6, long), (10**6 + 1, long + " more words"), (10**6 + 2, "z " * 50_000)]
    got = link(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), shingle=4)
    assert sorted(tuple(r)[:4] for r in got.collect()) == brute(docs, 4)


def test_pigeonhole():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(1)
    a = r.integers(0, 65536, SYMBOLS).astype(np.uint16)
    for _ in range(300):
        b = a.copy()
        b[r.choice(SYMBOLS, DISTANCE, replace=False)] ^= 1
        batch = pa.RecordBatch.from_pydict({"signature": pa.array([a.tobytes(), b.tobytes()], pa.binary()), "rep": pa.array([1, 2])})
        keys = [x.column("key").to_pylist() for x in _keys(iter([batch]))]
        assert len(keys) == SYMBOLS and any(x == y for x, y in keys)
    assert CHUNKS * 2 - 1 == DISTANCE
