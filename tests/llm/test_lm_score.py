import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import lm_score as M
from quarry.llm.lm_score import ALPHA, Classes, Slopes, _features, log_choices, newton, score
from quarry.llm.shared import written

SF = "/root/testdata/sf0.01"


def base(docs):
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in tokens}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for d, ws in tokens.items()}


@pytest.mark.parametrize("frequent", [1 << 19, 3000])
def test_against_brute_force(spark, frequent):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = base([tuple(r) for r in df.collect()])
    rows = score(df, frequent=frequent).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9)
    held = [r for r in rows if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    print("held-out gain a token", gain)
    assert gain > 0.3


def some_classes(depth=5):
    r = np.random.default_rng(0)
    keys = np.sort(r.integers(1, 2**63, 200, dtype=np.uint64))
    times = np.floor(1000 / np.arange(1, 201)) + 1
    total = times.sum() + 30 * (3 + ALPHA) + ALPHA * 231
    classes = Classes.fill(keys, times, total, depth)
    rest = classes.rest + np.arange(30) % (len(classes.mass) - classes.rest)
    np.add.at(classes.mass, rest, 3 + ALPHA)
    return classes


def test_softmax_over_classes_sums_to_one():
    classes, r = some_classes(), np.random.default_rng(1)
    w = r.normal(size=1 << 14).astype(np.float32)
    features = r.integers(0, 2**32, (3, 1), dtype=np.uint32).repeat(32, 1)
    assert np.exp(log_choices(w, classes.odds(), features, np.arange(32))).sum() == pytest.approx(1, abs=1e-4)


def test_without_weights_the_model_is_the_base():
    classes = some_classes()
    z = np.exp(log_choices(np.zeros(1 << 14, np.float32), classes.odds(), np.zeros((3, 32), np.uint32), np.arange(32)))
    assert np.allclose(z, classes.mass / classes.mass.sum(), atol=1e-4)
    own, hit, times = classes.known(classes.keys)
    assert hit.all() and (own < classes.rest).all() and times.max() == classes.times.max()
    own, hit, _ = classes.known(classes.keys + np.uint64(1))
    assert not hit.any() and (own >= classes.rest).all()
    assert np.bincount(own, minlength=len(classes.mass))[classes.rest :].min() > 0


def test_context_predicts_words():
    """Weights tell words of alike frequency by the word before; without it nothing does."""
    r = np.random.default_rng(2)
    keys = np.sort(r.integers(1, 2**63, 16, dtype=np.uint64))
    classes = Classes.fill(keys, np.full(16, 1000.0), 16000 + ALPHA * 17, 6)
    stream = np.tile(keys, 500)
    features, own, odds = _features(stream, np.array([0])), classes.known(stream)[0], classes.odds()
    w = np.zeros(1 << 16, np.float32)
    for _ in range(3):
        sums = Slopes(w, odds)
        sums.add(features, own)
        w = newton(w, sums.slope, sums.curve)
    assert np.exp(log_choices(w, odds, features, own))[10:].mean() > 0.8


def test_scores_do_not_depend_on_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one, eight = ({r.doc_id: r for r in score(df.repartition(n, "doc_id")).collect()} for n in (1, 8))
    assert all(one[d].score == pytest.approx(eight[d].score, rel=1e-5) and one[d].base_score == pytest.approx(eight[d].base_score, rel=1e-9) for d in one)


def test_very_long_text(spark):
    text = " ".join(f"w{i % 5000}" for i in range(300_000))
    rows = {r.doc_id: r for r in score(spark.createDataFrame([(1, text), (2, text), (3, "w1 w2 w3")], "doc_id long, text string")).collect()}
    assert rows[1].n_tokens == 300_001 and rows[1].score == pytest.approx(rows[2].score) and rows[1].score > rows[1].base_score


def test_least_count(spark):
    from quarry.llm.lm_score import least_count

    n = [1] * 50 + [2] * 20 + [900] * 7 + [5000] * 3 + [10**6, 10**12]
    counts = spark.createDataFrame([(i, x) for i, x in enumerate(n)], "h long, n long").coalesce(1)
    for frequent in (0, 1, 2, 4, 5, 11, 12, 31, 32, 81, 82, 500):
        least = least_count(counts, frequent)
        assert sum(x >= least for x in n) <= frequent and (least == 1 or sum(x >= least - 1 for x in n) > frequent)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "A a é", 3), (3, "A a é", 3), (None, "a b", 4)], "doc_id long, text string, row int")
    rows = score(df).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 3, 4, 4]
    assert all(r.train_tokens == 10 for r in rows)
    assert score(df.limit(0)).count() == 0


def test_sums_of_both_kinds_are_those_of_one_at_a_time():
    r = np.random.default_rng(5)
    features, classes = r.integers(0, 2**32, (3, 500), dtype=np.uint32), r.integers(0, 16, 500)
    weights, odds = r.normal(size=1 << 8).astype(np.float32), r.normal(size=16).astype(np.float32)
    sums = M.Slopes(weights, odds)
    sums.add(features, classes)
    nodes, second = M._choices(classes, 4)
    slots = M._slots(features, nodes, len(weights))
    p = 1 / (1 + np.exp(-(odds[nodes] + weights[slots].sum(0)), dtype=np.float32))
    for got, each in ((sums.slope, second - p), (sums.curve, p * (1 - p))):
        want = np.zeros(len(weights), np.float32)
        for s in slots:
            np.add.at(want, s.ravel(), each.astype(np.float32).ravel())
        assert np.array_equal(got, want) and want.any()


def test_shuffle_files_go_once_a_table_is_written(spark, tmp_path):
    kept = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()
    before, rows = kept(), spark.range(200_000, numPartitions=4).selectExpr("id % 9973 as k").groupBy("k").count()
    table = written(rows, str(tmp_path), "counts")
    for _ in range(50):
        if kept() <= before:
            assert table.count() == 9973
            return
        time.sleep(0.1)
    raise AssertionError(kept() - before)
