import math
import random
import re
from collections import Counter

from quarry.llm.quality_rules import BASE, judge

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, covered = Counter(triples), set()
    for i, t in enumerate(triples):
        if n[t] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def compare(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert tuple(r[c] for c in BASE) == want, r
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = judge(df).collect()
    compare(rows, {r.doc_id: r.text for r in df.collect()})
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    print(Counter((quality.get(r.doc_id), r.base_failed, r.kept) for r in rows))
    good = [r for r in rows if quality.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r for r in rows if quality.get(r.doc_id) == 0 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(not r.kept for r in bad) > 0.3 * len(bad)


def distances(rows, groups):
    """The same estimates in numpy, with quantiles at the same bin edges. rows: BASE counts; groups: (lang, source)."""
    import numpy as np

    from quarry.llm import quality_rules as Q

    base = np.array(rows, float)
    words = base[:, 0] > 0
    n, chars, symbols, dups, repeats = base.T
    n = np.maximum(n, 1)
    bins = np.array([math.floor(math.log2(a * (a - r + 1) / r) * 16) if r else 960 for a, r in zip(base[words, 0], repeats[words], strict=True)])
    order = np.argsort(bins, kind="stable")
    half = 2.0 ** ((bins[order][np.searchsorted(np.cumsum(base[words, 0][order]), base[words, 0].sum() / 2)] + 1) / 16)
    x = np.column_stack([np.log(chars / n + 0.1), np.sqrt(symbols / np.maximum(chars, 1)), np.sqrt(np.minimum(dups / (n / 10 + 1), 1)), np.sqrt(np.maximum(repeats / n - n / (n + half), 0))])
    floors = np.diag(np.square(Q.FLOORS))
    edge = lambda v, share, unit: (np.sort(np.floor(v * unit))[math.ceil(share * len(v)) - 1] + 1) / unit
    far = lambda v, m, c: np.einsum("ij,jk,ik->i", v - m, np.linalg.inv(c + floors), v - m)

    def mcd(v):
        m = np.array([edge(v[:, i], 0.5, 512) for i in Q.DIMS])
        mad = np.array([edge(abs(v[:, i] - m[i]), 0.5, 512) for i in Q.DIMS])
        ends = []
        for m, c in ((m, 8 * floors), (m, np.diag((1.4826 * mad) ** 2)), (v.mean(0), np.cov(v.T, bias=True))):
            for _ in range(Q.STEPS):
                log = np.log2(far(v, m, c) + 1e-6)
                some = v[log <= edge(log, Q.HALF, 64)]
                m, c = some.mean(0), np.cov(some.T, bias=True) * Q.OF_HALF
            ends.append((round(np.log2(np.sqrt(np.linalg.det(c + floors))), 9), len(ends), m, c))
        _, _, m, c = min(ends, key=lambda e: e[:2])
        some = v[far(v, m, c) <= Q.NEAR]
        return some.mean(0), np.cov(some.T, bias=True) * Q.OF_NEAR

    top, out = mcd(x[words]), np.zeros(len(x))
    for lang in {g[0] for g in groups}:
        of_lang = np.array([g[0] == lang for g in groups])
        above = top
        if (of_lang & words).any():
            w, own = (k := (of_lang & words).sum()) / (k + Q.PRIOR), mcd(x[of_lang & words])
            above = tuple(w * a + (1 - w) * b for a, b in zip(own, top, strict=True))
        for g in {g for g in groups if g[0] == lang}:
            at = np.array([h == g for h in groups])
            m, c = above
            if (at & words).any():
                w, own = (k := (at & words).sum()) / (k + Q.PRIOR), mcd(x[at & words])
                m, c = (w * a + (1 - w) * b for a, b in zip(own, above, strict=True))
            out[at] = far(x[at], m, c)
    return out


def test_distances_equal_numpy(spark):
    import numpy as np

    df = spark.read.parquet(f"{SF}/documents.parquet")
    groups = {r.doc_id: (r.lang, r.source) for r in df.collect()}
    rows = judge(df).collect()
    want = distances([[r[c] for c in BASE] for r in rows], [groups[r.doc_id] for r in rows])
    assert np.allclose([r.distance for r in rows], want, rtol=1e-6, atol=1e-8)


def test_fuzz(spark):
    r = random.Random(6)
    docs = {i: "".join(r.choice(["a", "b", "c ", " ", "\n", "\t", "a b c", "#", "<|>", "é", "\x0b", " "]) for _ in range(r.randrange(90))) for i in range(400)}
    docs |= {400: None, 401: "", 402: "a b " * 60000, 403: " ".join(map(str, range(60000))) * 2}
    df = spark.createDataFrame([(d, t, r.choice(["en", None]), r.choice(["x", None]), "s") for d, t in docs.items()], "doc_id long, text string, lang string, source string, g string")
    compare(judge(df).collect(), docs)
    assert judge(df.limit(0)).count() == 0


def test_outliers_of_a_group_go(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 9)))
    docs = [(i, " ".join(word() for _ in range(100)), "en", "s") for i in range(300)]
    docs += [(1000, " ".join(word() + "***" for _ in range(100)), "en", "s"), (1001, " ".join(word() * 9 for _ in range(100)), "en", "s"), (1002, "\n".join(["one two three four five"] + [word() for _ in range(60)] + ["x y"] * 60), "en", "s")]
    kept = {x.doc_id: x.kept for x in judge(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[i] for i in (1000, 1001, 1002))


def test_each_statistic_alone_rejects(spark):
    r = random.Random(9)
    word = lambda a=3, b=9: "".join(r.choice("abcdefgh") for _ in range(r.randrange(a, b)))
    docs = {i: " ".join(word() for _ in range(100)) for i in range(300)}
    passage = " ".join(word() for _ in range(22))
    docs[1000] = " ".join(word(6, 17) for _ in range(100))
    docs[1001] = " ".join(word()[1:] + "#" * (k % 2) for k in range(100))
    docs[1002] = "\n".join(f"hgfed\n{word()}" for _ in range(50))
    docs[1003] = " ".join([passage, *(word() for _ in range(56)), passage])
    rows = judge(spark.createDataFrame([(i, t, "en", "s") for i, t in docs.items()], "doc_id long, text string, lang string, source string")).collect()
    kept = {x.doc_id: x.kept for x in rows}
    assert not any(x.base_failed for x in rows)
    assert sum(kept[i] for i in range(300)) >= 297 and not any(kept[i] for i in (1000, 1001, 1002, 1003))


def test_rare_sources_are_held_against_their_whole_language(spark):
    r = random.Random(10)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 9)))
    plain, junk = (lambda: " ".join(word() for _ in range(100))), (lambda: " ".join(word() + "***" for _ in range(100)))
    docs = [(i, plain(), "en", "big") for i in range(300)] + [(1000, junk(), "en", "rare"), (1001, plain(), "en", "rare"), (1002, junk(), "en", None)]
    docs += [(2000, junk(), "xx", "a"), (2001, plain(), "xx", "a"), (2002, junk(), None, "b")]
    docs += [(3000 + i, "", "en", "empty") for i in range(250)] + [(3999, junk(), "en", "empty")]
    rows = judge(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()
    kept = {x.doc_id: x.kept for x in rows}
    assert len(rows) == len(docs) and sum(kept[i] for i in range(300)) >= 297 and kept[1001] and kept[2001]
    assert not any(kept[i] for i in (1000, 1002, 2000, 2002, 3999))
