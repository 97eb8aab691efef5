import zlib

import numpy as np

from quarry.llm.quality import FEATURES, fit, score

SF = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    one = label == 1
    return (rank[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = score(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    s, y = np.array([r.score for r in held]), np.array([r.quality for r in held])
    print("AUC", auc(s, y), "accuracy", ((s >= 0.7) == y).mean(), len(y))
    assert auc(s, y) > 0.9


def test_interaction_is_learned():
    r = np.random.default_rng(2)
    x = r.random((4000, len(FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.9


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 3.0), (2, "", 3.0), (2, "", 3.0), (None, "x" * 3000, 3.0), (4, "é & <p> " * 4000, 3.0)], "doc_id long, text string, x double")
    labels = spark.createDataFrame([(1, 1, "t"), (4, None, "t"), (None, 0, "t")], "doc_id long, quality int, text string")
    got = score(df, labels).collect()
    assert len(got) == 5 and len({r.score for r in got}) == 1
    assert score(df.limit(0), labels.limit(0)).count() == 0
