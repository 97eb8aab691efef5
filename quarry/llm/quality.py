"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is binned at quantiles of the training rows. Cyclic boosting visits the features in turn and adds
a small step of a shallow tree (up to four leaves) on that feature alone to its lookup table; then the pairs
with the largest gain get tables of their own, boosted by trees of one cut in each direction. A score is the
logistic function of the sum of the looked-up values.

Null and empty texts have all features zero and get the score of that. Repeated rows get the same score each;
a doc_id with several labels counts with its largest. Without labels, or with one label only, all scores are
the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.hashing import windows, word_chunks
from quarry.llm.shared import remainder, scratch, written

FEATURES = ("log_words", "mean_word", "long_word", "short_words", "symbols", "digits", "stops", "commas", "upper", "beyond_ascii", "links", "lines", "distinct_words", "repeated_triples", "top_word", "joined_symbols", "lone_symbols", "upper_words")
BINS, PAIR_BINS, PAIRS, TRAIN_ROWS = 32, 8, 8, 20_000
"""TRAIN_ROWS bounds the labelled rows that the model is fitted on: those of smallest hash."""


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars.encode())] = 1
    return out


_CLASSES = {"symbols": _class("#*$%&|<>"), "digits": _class("0123456789"), "stops": _class(".!?"), "commas": _class(",;"), "upper": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "links": _class("@/\\_={}[]"), "lines": _class("\n"), "beyond_ascii": np.arange(256) >= 192}


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
    return total[first[1:]] - total[first[:-1]]


def _repeats(owner: np.ndarray, hashes: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: distinct hashes, positions whose hash comes more than once, and the most of one hash."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(o)))
    most = np.zeros(texts)
    np.maximum.at(most, o[at], size)
    return np.bincount(o[at], minlength=texts), np.bincount(o[at], np.where(size > 1, size, 0), minlength=texts), most


def text_features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = []
    for w in word_chunks(texts):
        n = w.counts()
        bounds = np.zeros(len(n) + 1, np.int64)
        bounds[1:] = np.cumsum(pa.compute.binary_length(texts.slice(w.rows.start, len(n)).cast(pa.large_string())).fill_null(0).to_numpy(zero_copy_only=False))
        size, few = np.maximum(np.diff(bounds), 1), np.maximum(n, 1)
        f = dict.fromkeys(FEATURES, np.zeros(len(n)))
        if len(w.start):
            length, owner, hashes = w.end - w.start, np.repeat(np.arange(len(n)), n), w.hashes(lower=True)
            f["log_words"], f["mean_word"] = np.log1p(n), _per_text(length, w.first) / few
            longest = np.zeros(len(n))
            np.maximum.at(longest, owner, length)
            f["long_word"], f["short_words"] = np.log1p(longest), _per_text(length <= 3, w.first) / few
            for name, table in _CLASSES.items():
                f[name] = _per_text(table[w.data], bounds) / (few if name == "lines" else size)
            symbol, last, head = _CLASSES["symbols"] > 0, w.data[w.end - 1], w.data[w.start]
            f["joined_symbols"] = _per_text(symbol[last] & (length > 1), w.first) / few
            f["lone_symbols"] = _per_text(symbol[head] & (length == 1), w.first) / few
            f["upper_words"] = _per_text(_CLASSES["upper"][head], w.first) / few
            distinct, _, most = _repeats(owner, hashes, len(n))
            f["distinct_words"], f["top_word"] = distinct / few, most / few
            found, begin = windows(w, hashes, 3)
            f["repeated_triples"] = _repeats(owner[begin], found, len(n))[1] / few
        out.append(np.column_stack([f[name] for name in FEATURES]))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _emit_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = text_features(batch.column("text")).astype(np.float32)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "input": batch.column("input"), "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))})


class AdditiveModel:
    """bias, a table for each feature and a table for each chosen pair."""

    def __init__(self, edges: list[np.ndarray]) -> None:
        self.edges, self.bias = edges, 0.0
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def _coarse(self, j: int, b: np.ndarray) -> np.ndarray:
        return b * PAIR_BINS // len(self.tables[j])

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = self.bias + sum(t[i] for t, i in zip(self.tables, b, strict=True))
        for (j, k), t in self.pairs.items():
            out = out + t[self._coarse(j, b[j]), self._coarse(k, b[k])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _steps(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Newton steps of a tree with that many leaves over the bins of one feature."""
    parts = [(0, len(g))]
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + ridge)
    while len(parts) < leaves:
        best = max(((gain(a, c) + gain(c, b) - gain(a, b), a, c, b) for a, b in parts for c in range(a + 1, b)), default=(0,))
        if best[0] <= 1e-9:
            break
        _, a, c, b = best
        parts = [p for p in parts if p != (a, b)] + [(a, c), (c, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best single cut in each direction, its gain and steps."""
    G, H = np.zeros((PAIR_BINS + 1,) * 2), np.zeros((PAIR_BINS + 1,) * 2)
    G[1:, 1:], H[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, step = 0.0, np.zeros_like(g)
    for i in range(1, PAIR_BINS):
        for k in range(1, PAIR_BINS):
            parts = [(slice(0, i), slice(0, k)), (slice(0, i), slice(k, None)), (slice(i, None), slice(0, k)), (slice(i, None), slice(k, None))]
            sums = [(S[i, k], S[i, -1] - S[i, k], S[-1, k] - S[i, k], S[-1, -1] - S[i, -1] - S[-1, k] + S[i, k]) for S in (G, H)]
            gain = sum(a * a / (b + ridge) for a, b in zip(*sums, strict=True))
            if gain > best:
                best, step = gain, np.zeros_like(g)
                for part, a, b in zip(parts, *sums, strict=True):
                    step[part] = a / (b + ridge)
    return best, step


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, pair_rounds: int = 20, rate: float = 0.15, ridge: float = 2.0) -> AdditiveModel:
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    model = AdditiveModel([np.unique(np.quantile(x[:, j], quantiles)) if len(x) else np.empty(0) for j in range(len(FEATURES))])
    share = (y.sum() + 1) / (len(y) + 2)
    model.bias = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return model
    bins, margin = model.bins(x), np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for b, t in zip(bins, model.tables, strict=True):
            g, h = slopes()
            step = rate * _steps(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)), 4, ridge)
            t += step
            margin += step[b]
    coarse = [model._coarse(j, b) for j, b in enumerate(bins)]
    cell = {p: coarse[p[0]] * PAIR_BINS + coarse[p[1]] for p in combinations(range(len(FEATURES)), 2)}

    def pair(p: tuple[int, int]) -> tuple[float, np.ndarray]:
        g, h = (np.bincount(cell[p], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in slopes())
        return _quarters(g, h, ridge)

    gains = sorted(((pair(p)[0], p) for p in cell), reverse=True)[:PAIRS]
    model.pairs = {p: np.zeros((PAIR_BINS, PAIR_BINS)) for _, p in gains}
    for _ in range(pair_rounds):
        for p, t in model.pairs.items():
            step = rate * pair(p)[1]
            t += step
            margin += step.ravel()[cell[p]]
    return model


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2, train_rows: int = TRAIN_ROWS, threshold: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, held_out, score (higher: label 1 likelier), predicted (score >= threshold) and, with keep, those columns as the struct `input`.

    Rows of fold `held` (crc32 of the id as text modulo folds) take no part in the fit. The rows to fit on are chosen by
    id first, so that features of all rows are made once, as the result is read, and docs are stored nowhere.
    """
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    kept = F.struct(*keep) if keep else F.lit(None).cast("int")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), kept.alias("input"))

    def featured(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(_emit_features, T.StructType([rows.schema["doc_id"], rows.schema["input"], T.StructField("x", T.ArrayType(T.FloatType()))]))

    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y")).filter("y is not null and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.filter(remainder(F.col("doc_id"), folds) != held).join(docs.select("doc_id"), "doc_id").orderBy(*order).limit(train_rows)
    chosen = written(chosen.distinct(), folder, "chosen")
    # train_rows bounds what is sent to all tasks
    learned = featured(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("y").alias("input")))
    rows = learned.select("x", F.col("input").alias("y")).orderBy(*order).limit(train_rows).collect()
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES))
    model = spark.sparkContext.broadcast(fit(x, np.array([r.y for r in rows], float)))

    def scored(text: pa.Array) -> pa.Array:
        return pa.array(model.value.score(text_features(text).astype(np.float32).astype(float)))

    # only the text goes to Python; nondeterministic, else a filter on the score makes it twice
    out = docs.select("doc_id", "input", F.arrow_udf(scored, "double").asNondeterministic()("text").alias("score"))
    held_out = F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *([F.col("input")] if keep else []))
