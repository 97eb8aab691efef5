import hashlib
import random
import re
import string

from quarry.llm.secrets import find

SF = "/root/testdata/sf0.01"
N = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
ASSIGN = rf"({N}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


def brute(text):
    out = []
    for rank, (kind, pattern, ok) in enumerate((("assign", ASSIGN, lambda m: len(m[2]) >= 8), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32))):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if ok(m)]
    return [x for _, _, x in sorted(out)]


def compare(rows, texts):
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (r, want)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(r.spans.split(",")) or not want
        starts = [(int(x.split(":")[1]), ("assign", "access", "hex", "random").index(x.split(":")[0])) for x in r.spans.split(",") if x]
        assert starts == sorted(starts)


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = find(df).collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    assert len(rows) == len(texts)
    compare(rows, texts)
    added = [x for r in rows for x in r.spans.split(",") if x.startswith("random")]
    print("added", len(added), added[:5])
    assert len(added) < 0.01 * len(texts)


def test_fuzz(spark):
    r = random.Random(1)
    parts = ["password", "Token", "API_KEY", "apikey", "api__key", "secret", "=", ": ", " ", "'", '"', "abcdefgh", "x.y", "AKIA", "ABCDEFGH12345678", "AKIAAKIA", "0123456789abcdef" * 2, "é", "😀", "\n", "deadbeef", "ſecret", "tokeN=", "/+_.="]
    docs = {i: "".join(r.choice(parts) for _ in range(r.randrange(60))) for i in range(600)}
    docs[600], docs[601], docs[602] = None, "", "token=" * 3000 + "0" * 50000
    df = spark.createDataFrame([(d, t, "k") for d, t in docs.items()], "doc_id long, text string, found string")
    rows = find(df).collect()
    assert len(rows) == len(docs)
    compare(rows, docs)
    assert find(df.limit(0)).count() == 0


def test_random_tokens_are_added(spark):
    r = random.Random(2)
    token = lambda: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(32))
    words = "internationalization configuration responsibilities implementation characteristics"
    docs = [(i, f"{words} token = {token()}") for i in range(200)] + [(500, f"see {token()} there"), (501, "internationalization_configuration2 responsibilities_implementation")]
    got = {x.doc_id: x.spans for x in find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[500] == "random:4:36" and got[501] == ""


def planted(spark, texts, seed):
    """Texts with one token each put into the middle: (id, text, token, whether it is a secret)."""
    import base64
    import uuid

    r = random.Random(seed)
    plain = string.ascii_letters + string.digits
    secret = (
        lambda: "".join(r.choice(plain) for _ in range(r.randint(14, 40))), lambda: base64.b64encode(r.randbytes(r.randint(12, 40))).decode(), lambda: base64.urlsafe_b64encode(r.randbytes(24)).decode(),
        lambda: "rk_live_" + "".join(r.choice(plain) for _ in range(24)), lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(20)), lambda: r.randbytes(12).hex(),
    )
    noun = "garden window bridge castle river mountain engine wagon harvest lantern compass orchard".split()
    ordinary = (
        lambda: "-".join(r.sample(noun, 3)), lambda: "_".join(r.sample(noun, 3)), lambda: "".join(x.title() for x in r.sample(noun, 3)), lambda: str(uuid.UUID(int=r.getrandbits(128))), lambda: f"20{r.randint(10, 30)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}-{r.choice(noun)}-{r.choice(noun)}_v{r.randint(1, 9)}",
        lambda: f"docs/{r.choice(noun)}/{r.choice(noun)}_{r.randint(1, 99)}.md", lambda: f"{r.choice(noun)}.{r.choice(noun)}.{r.choice(noun)}", lambda: f"{r.choice(noun).upper()}_{r.choice(noun).upper()}_{r.randint(1, 9)}", lambda: str(r.randint(10**12, 10**15)), lambda: f"version-{r.randint(1, 20)}.{r.randint(0, 9)}.{r.randint(0, 99)}-beta",
    )
    out = []
    for i, t in enumerate(texts):
        words, token = t.split(" "), r.choice(secret if i % 2 else ordinary)()
        words.insert(len(words) // 2, token)
        out.append((i, " ".join(words), token, bool(i % 2)))
    return out


def test_precision_and_recall_on_planted_tokens(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").orderBy("doc_id").collect()]
    rows = planted(spark, texts, 5)
    got = {x.doc_id: x for x in find(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")).collect()}
    hit = {i: any(t[int(a) : int(b)] == token for kind, a, b in (x.split(":") for x in got[i].spans.split(",") if x) if kind == "random") for i, t, token, _ in rows}
    right = sum(hit[i] for i, _, _, yes in rows if yes)
    added = [t[int(a) : int(b)] for i, t, _, _ in rows for kind, a, b in (x.split(":") for x in got[i].spans.split(",") if x) if kind == "random"]
    print("recall", right / sum(x[3] for x in rows), "precision", right / len(added), set(added) - {x[2] for x in rows if x[3]})
    assert right >= 0.95 * sum(x[3] for x in rows) and right >= 0.95 * len(added)


def test_known_tokens(spark):
    docs = [(1, "a 2024-01-15-release-notes-final_version2 b"), (2, "id 123e4567-e89b-12d3-a456-426614174000."), (3, "key wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY end"), (4, "an internationalization. Incomprehensibilities-of-words"), (5, "x xkqzvjwpbhmtqz.")]
    got = {x.doc_id: x.spans for x in find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "", 3: "random:4:44", 4: "", 5: "random:2:16"}


def test_many_matches_in_one_text(spark):
    import time

    text = " ".join(f"token={i:08} deadbeef{i:024}" for i in range(100_000))
    began = time.perf_counter()
    row = find(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).first()
    assert (row.n_assign, row.n_hex) == (100_000, 100_000) and row.base_sha256 == hashlib.sha256(",".join(brute(text)).encode()).hexdigest()
    assert time.perf_counter() - began < 120
