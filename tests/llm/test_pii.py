import hashlib
import random
import re

from pyspark.sql import functions as F

from quarry.llm.pii import BASE, LABELERS, classifier, find, redacted, reliabilities

SF = "/root/testdata/sf0.01"


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    )
    out = [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for rank, (kind, pattern, ok) in enumerate(rules) for m in re.finditer(pattern, text or "") if ok(m)]
    return [x for _, _, x in sorted(out)]


def compare(rows, texts):
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (r, want)
        assert [r[f"n_{k}"] for k in BASE] == [sum(x.startswith(k + ":") for x in want) for k in BASE]
        assert not want or set(want) <= set(r.spans.split(","))


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = find(df).collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    assert len(rows) == len(texts)
    compare(rows, texts)
    more = [x for r in rows for x in r.spans.split(",") if x and x.split(":")[0] not in BASE]
    print("added", more)
    assert len(more) < 0.01 * len(rows)


def test_fuzz(spark):
    r = random.Random(1)
    parts = ["a.b", "@", "x_y", "ex-ample", ".", "com", "+", "1", "23", "4539 1488 0343 6467", "4012888888881881", "-", " ", "(", ")", "255", "256", "00", "192.168.1.1", "1.2.3.4.5.6.7.8.9", "é", "😀", "\n", "+49 (30) 123-4567", "_", "%"]
    docs = {i: "".join(r.choice(parts) for _ in range(r.randrange(40))) for i in range(800)}
    docs |= {800: None, 801: "", 802: "1" * 30000, 803: "1 " * 20000, 804: "a" * 50000 + "@", 805: "a@b" + ".c" * 20000, 806: "+1" * 5000}
    df = spark.createDataFrame([(d, t, 1) for d, t in docs.items()], "doc_id long, text string, found int")
    rows = find(df).collect()
    assert len(rows) == len(docs)
    compare(rows, docs)
    assert find(df.limit(0)).count() == 0


def test_loose_spans_need_support(spark):
    docs = [(i, f"mail a{i}@b.com or +1 (603) 555-{i:04}") for i in range(60)]
    docs += [(100, "please call 603-555-0123 now"), (101, "part 603-555-0123 now"), (102, "number 4539148803436468 here"), (103, "write to joe [at] mail [dot] com")]
    got = {x.doc_id: x.spans for x in find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[100] == "local_phone:12:24" and got[101] == got[102] == "" and got[103].startswith("spelled_email:9:")


def test_em_finds_the_bad_labeler():
    r = random.Random(3)
    rates = (0.95, 0.9, 0.85, 0.9, 0.5)
    counts = {}
    for _ in range(5000):
        true = r.random() < 0.4
        v = tuple((1 if true else -1) * (1 if r.random() < p else -1) for p in rates)
        counts[v] = counts.get(v, 0) + 1
    tables = reliabilities(list(counts.items()))
    assert abs(tables[0][1][0] - 0.95) < 0.05 and abs(tables[4][1][0] - tables[4][1][1]) < 0.1
    weights = classifier([("email", v, n) for v, n in counts.items()])
    assert weights["shape=1"] > 0 > weights["shape=-1"] and len(LABELERS) == 5


def test_redacted(spark):
    df = spark.createDataFrame([(1, "é a@b.co, 1.2.3.4!"), (2, None), (3, "clean")], "doc_id long, text string")
    out = find(df, keep=("text",)).select("doc_id", redacted(F.col("input.text"), F.col("found")).alias("t"))
    assert {r.doc_id: r.t for r in out.collect()} == {1: "é [EMAIL], [IP]!", 2: None, 3: "clean"}


def test_many_matches_in_one_text(spark):
    import time

    text = " ".join(f"call 603-555-{i % 10000:04} or a{i}@b.com" for i in range(100_000))
    began = time.perf_counter()
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    rows = find(df, keep=("text",)).select("*", redacted(F.col("input.text"), F.col("found")).alias("t")).collect()
    assert [r.n_email for r in rows] == [100_000] * 2 and rows[0].base_sha256 == hashlib.sha256(",".join(brute(text)).encode()).hexdigest()
    assert rows[0].t == " ".join(["call [LOCAL_PHONE] or [EMAIL]"] * 100_000) and rows[0] == rows[1]
    assert time.perf_counter() - began < 180


def test_precision_and_recall_of_loose_spans(spark):
    r = random.Random(11)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    true = (
        lambda: ("please call ", f"{r.randint(200, 999)}-{r.randint(200, 999)}-{n(4)}"), lambda: ("reach me by phone ", f"({r.randint(200, 999)}) {r.randint(200, 999)}-{n(4)}"), lambda: ("social security ", f"{n(3)}-{n(2)}-{n(4)}"),
        lambda: ("write to ", f"jo{n(2)} [at] mail{n(1)} [dot] {r.choice(['com', 'org', 'de'])}"), lambda: ("account ", f"DE{n(20)}"), lambda: ("contact ", f"al.{n(2)}(at)site.net"),
    )
    false = (
        lambda: ("part no. ", f"{r.randint(200, 999)}-{r.randint(200, 999)}-{n(4)}"), lambda: ("version ", f"{n(3)}-{n(2)}-{n(4)}"), lambda: ("order ", "4" + n(15)), lambda: ("serial ", f"{r.randint(200, 999)}.{r.randint(200, 999)}.{n(4)}"), lambda: ("model ", f"XK{n(16)}"), lambda: ("ticket ", f"{n(3)}-{n(2)}-{n(4)}"),
    )
    docs = [(i, "mail someone@site.org or ", *r.choice(true if i % 2 else false)()) for i in range(600)]
    rows = {x.doc_id: x.spans.split(",") for x in find(spark.createDataFrame([(i, a + b + c + " today") for i, a, b, c in docs], "doc_id long, text string")).collect()}
    found = {i: [x for x in rows[i] if x.split(":")[0] not in BASE] for i, *_ in docs}
    right = sum(any(x.endswith(f":{len(a + b)}:{len(a + b + c)}") for x in found[i]) for i, a, b, c in docs if i % 2)
    added = sum(map(len, found.values()))
    print("recall", right / 300, "precision", right / max(added, 1))
    assert right >= 0.9 * 300 and right >= 0.9 * added
