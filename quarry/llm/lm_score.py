"""Language-model scores: a unigram base and a hashed maximum-entropy model over n-gram and skip features.

The softmax over words is factored into classes. Words by falling count fill 2^DEPTH classes of alike mass, and a
word's class is reached by DEPTH choices between two halves; each choice is a two-way softmax whose weights are
looked up by hashed pairs of a feature and the choices before. The features are the word before (bigram), the two
before (trigram) and the one before the last alone (skip). Frequent words are alone in their class, so that context
predicts the word itself; within a class, words keep their share of its smoothed counts. Without weights the model
is the unigram base.

Weights are trained by UPDATES gradient updates, each over the training texts of one part by hash, so that all are
learned from once. In an update, every task adds up slopes and curvatures over its share at the same weights; the sums
over all tasks make one damped Newton step per weight, with the curvatures of all updates so far. So scores don't depend
on how rows are dealt to tasks, but for the rounding of the sums (about 1e-6 of a score). The table has 16 to 32 weights
for each training token, from 2^MIN_BITS up to 2^MAX_BITS, as each task holds it.

Words are known by a 64-bit hash. The FREQUENT commonest go to each task as a table; the others are joined, so
the counts that apply are exact whatever the size of the vocabulary; rarer words share the last classes by hash. Null
texts are empty and hold the end token only. Repeated rows are scored each. Rows without doc_id are scored, not held
out and not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.hashing import U, Words, mixed, word_chunks
from quarry.llm.shared import keep_only, remainder, scratch, written

DEPTH, MIN_BITS, MAX_BITS, FREQUENT, UPDATES, RATE, RIDGE, PART, TASK_TOKENS = 12, 14, 22, 1 << 19, 2, 0.8, 3.0, 1 << 14, 1 << 22
ALPHA, BLOCK, MOST = 0.1, 1 << 16, 12.0
END, BEGIN = 0x5851F42D4C957F2D, 0x14057B7EF767814F
_SALTS = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_NODE, _SPREAD = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def _stream(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text, and where each text begins."""
    n = words.counts()
    owner = np.repeat(np.arange(len(n)), n)
    at, ends = np.arange(len(owner)) + owner, words.first[1:] + np.arange(len(n))
    hashes = np.empty(len(owner) + len(n), U)
    hashes[at], hashes[ends] = words.hashes(lower=True), U(END)
    return hashes, np.concatenate([[0], ends[:-1] + 1])[: len(n)]


def _features(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The hashed n-gram and skip features of each token: (3, tokens) of 32 bits."""
    one, two = np.empty_like(hashes), np.empty_like(hashes)
    one[1:], two[2:] = hashes[:-1], hashes[:-2]
    one[begin] = two[begin] = U(BEGIN)
    two[(begin + 1)[begin + 1 < len(hashes)]] = U(BEGIN)
    raw = (one, one * U(3) + mixed(two), two)
    return np.stack([(mixed(x * salt + salt) >> U(32)).astype(np.uint32) for x, salt in zip(raw, _SALTS, strict=True)])


@dataclass
class Classes:
    """The classes of words: the commonest by table, the others by hash in the last ones."""

    keys: np.ndarray  # hashes of the commonest words, sorted
    times: np.ndarray  # their counts
    own: np.ndarray  # their classes
    rest: int  # first class of the others
    mass: np.ndarray  # smoothed counts of each class

    @classmethod
    def fill(cls, keys: np.ndarray, times: np.ndarray, total: float, depth: int = DEPTH) -> Classes:
        """From the commonest words; `add_rest` brings in the others."""
        order = np.lexsort((keys, -times))
        smoothed = times[order] + ALPHA
        rest = min(int(smoothed.sum() / total * 2**depth), 2**depth - 1)
        before = np.concatenate([[0.0], np.cumsum(smoothed)[:-1]]) if len(order) else np.zeros(0)
        own = np.minimum((before / max(smoothed.sum(), 1e-9) * rest).astype(np.int64), max(rest - 1, 0))
        mass = np.bincount(own, smoothed, 2**depth).astype(float)
        mass[rest:] += ALPHA
        back = np.argsort(keys[order])
        return cls(keys[order][back], times[order][back], own[back], rest, mass)

    def add_rest(self, classes: np.ndarray, mass: np.ndarray) -> None:
        self.mass[classes] += mass

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, whether the table has it, its count) of each word."""
        other = self.rest + np.mod(hashes.view(np.int64), len(self.mass) - self.rest)
        if not len(self.keys):
            return other, np.zeros(len(hashes), bool), np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[at] == hashes
        return np.where(hit, self.own[at], other), hit, self.times[at]

    def odds(self) -> np.ndarray:
        """Log-odds of the second half at each node, by mass; nodes are numbered from 1 as in a heap."""
        out, level = np.zeros(len(self.mass), np.float32), self.mass
        while len(level) > 1:
            first, second = level[::2], level[1::2]
            out[len(first) : 2 * len(first)] = np.clip(np.log((second + 1e-12) / (first + 1e-12)), -MOST, MOST)
            level = first + second
        return out


def _choices(classes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes on the way to each class and which half is taken at each: (depth, tokens)."""
    level, own = np.arange(depth, dtype=np.uint32)[:, None], classes.astype(np.uint32)[None, :]
    nodes = (np.uint32(1) << level) | (own >> (np.uint32(depth) - level))
    return nodes, (own >> (np.uint32(depth - 1) - level)) & np.uint32(1)


def _slots(features: np.ndarray, nodes: np.ndarray, size: int) -> np.ndarray:
    """Where the weights of each feature at the nodes stand: (features, depth, tokens)."""
    at = features[:, None, :] ^ (nodes * _NODE)[None]
    at *= _SPREAD
    at >>= np.uint32(33 - size.bit_length())
    return at.astype(np.intp)


def log_choices(weights: np.ndarray, odds: np.ndarray, features: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The natural log of each class's probability."""
    nodes, second = _choices(classes, len(odds).bit_length() - 1)
    z = odds[nodes] + weights[_slots(features, nodes, len(weights))].sum(0)
    z *= 1 - 2 * second.astype(np.float32)
    return -(np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))).sum(0, dtype=np.float64)


class Slopes:
    """Sums of slopes and curvatures of the log-likelihood at fixed weights: a weight's two lie side by side, as the parts of a complex number, so that both are reached at once."""

    def __init__(self, weights: np.ndarray, odds: np.ndarray) -> None:
        self.weights, self.odds = weights, odds
        self.sums = np.zeros(len(weights), np.complex64)
        self.slope, self.curve = self.sums.real, self.sums.imag

    def add(self, features: np.ndarray, classes: np.ndarray) -> None:
        nodes, second = _choices(classes, len(self.odds).bit_length() - 1)
        slots = _slots(features, nodes, len(self.weights))
        z = self.odds[nodes] + self.weights[slots].sum(0)
        p = 1 / (1 + np.exp(-z, dtype=np.float32))
        both = np.empty(p.size, np.complex64)
        both.real, both.imag = (second - p).ravel(), (p * (1 - p)).ravel()
        for s in slots.reshape(len(slots), -1):
            np.add.at(self.sums, s, both)


def newton(weights: np.ndarray, slope: np.ndarray, curve: np.ndarray, share: float = 1.0) -> np.ndarray:
    """One damped step: several features of a token move at once. curve: of all updates so far; share: this update's part of the rows."""
    return (weights + RATE * np.where(curve > 0, slope - share * RIDGE * weights, 0) / (curve + RIDGE)).astype(np.float32)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and features of PART tokens at a time, so that a text of any length takes bounded memory."""
    for batch in batches:
        for words in word_chunks(batch.column("text")):
            hashes, begin = _stream(words)
            features = _features(hashes, begin)
            for a in range(0, len(hashes), PART):
                yield hashes[a : a + PART], features[:, a : a + PART]


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of all tasks' blocks of one number."""
    total: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for block, g, h in zip(batch.column("block").to_pylist(), batch.column("slope"), batch.column("curve"), strict=True):
            own = [np.frombuffer(x.as_buffer(), np.float32).astype(float) for x in (g, h)]
            total[block] = [a + b for a, b in zip(total[block], own, strict=True)] if block in total else own
    for block, (g, h) in total.items():
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "slope": pa.array([g.tobytes()], pa.binary()), "curve": pa.array([h.tobytes()], pa.binary())})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of tokens, added up over a million at a time."""
    held: list[np.ndarray] = []
    size = 0

    def flushed() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_pydict({"h": pa.array(keys.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    for batch in batches:
        for words in word_chunks(batch.column("text")):
            held.append(_stream(words)[0])
            size += len(held[-1])
            if size >= 1 << 20:
                yield flushed()
                held, size = [], 0
    if held:
        yield flushed()


def least_count(counts: DataFrame, frequent: int) -> int:
    """The least count that at most `frequent` words reach, found digit by digit: each step counts words by 1024 values of the next ten bits."""
    base, shift, above = 0, 50, 0
    while True:
        digit = F.shiftright(F.col("n"), shift).bitwiseAND(1023)
        at = counts.filter(F.shiftright(F.col("n"), shift + 10) == (base >> (shift + 10))) if shift < 50 else counts
        words = {r["d"]: r["count"] for r in at.groupBy(digit.alias("d")).count().collect()}
        d = 1023
        while d >= 0 and above + words.get(d, 0) <= frequent:
            above += words.get(d, 0)
            d -= 1
        base += (d + 1 if shift == 0 or d < 0 else d) << shift
        if shift == 0 or d < 0:
            return max(base, 1)
        shift -= 10


def score(docs: DataFrame, folds: int = 10, held: int = 0, frequent: int = FREQUENT, updates: int = UPDATES) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text)."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    fold = remainder(F.col("doc_id"), folds)
    train = docs.filter(fold != held).select("text")
    counts = written(train.mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), folder, "counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    all_n, all_v = sums["n"], sums["v"]
    total = all_n + ALPHA * (all_v + 1)
    least = least_count(counts, frequent)
    common = counts.filter(F.col("n") >= least).toArrow()
    classes = Classes.fill(common.column("h").to_numpy().view(U), common.column("n").to_numpy().astype(float), total)
    rest = F.lit(classes.rest) + F.pmod("h", F.lit(len(classes.mass) - classes.rest))
    masses = counts.filter(F.col("n") < least).groupBy(rest.alias("class")).agg(F.sum(F.col("n") + ALPHA).alias("mass")).toArrow()
    classes.add_rest(masses.column("class").to_numpy(), masses.column("mass").to_numpy())
    odds, table = classes.odds(), spark.sparkContext.broadcast(classes)
    weights = np.zeros(1 << min(max(int(all_n).bit_length() + 4, MIN_BITS), MAX_BITS), np.float32)
    # a task gives its table back, so it takes enough texts for that to be little
    tasks = max(spark.sparkContext.defaultParallelism, -(-int(all_n) // TASK_TOKENS))
    curve = np.zeros(len(weights))
    for step in range(updates):
        start = spark.sparkContext.broadcast((weights, odds))
        rows = train.filter(F.pmod(F.xxhash64("text"), F.lit(updates)) == step)

        def learned(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            sums = Slopes(*start.value)
            for hashes, features in _gathered(batches):
                sums.add(features, table.value.known(hashes)[0])
            for block in range(0, len(sums.slope), BLOCK):
                g, h = (x[block : block + BLOCK].astype(np.float32) for x in (sums.slope, sums.curve))
                if h.any():
                    yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "slope": pa.array([g.tobytes()], pa.binary()), "curve": pa.array([h.tobytes()], pa.binary())})

        kinds = "block int, slope binary, curve binary"
        blocks = rows.coalesce(tasks).mapInArrow(learned, kinds).repartition("block").sortWithinPartitions("block", "slope").mapInArrow(_added, kinds)
        slope = np.zeros(len(weights))
        for r in written(blocks, folder, f"slopes{step}").toArrow().to_pylist():  # as many as the table has weights
            at = slice(r["block"], r["block"] + BLOCK)
            slope[at] = np.frombuffer(r["slope"])
            curve[at] += np.frombuffer(r["curve"])
        weights = newton(weights, slope, curve, 1 / updates)
    final = spark.sparkContext.broadcast((weights, odds))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, logs = table.value, np.log10(np.maximum(table.value.mass, 1e-12))
        for batch in batches:
            for words in word_chunks(batch.column("text")):
                hashes, begin = _stream(words)
                features = _features(hashes, begin)
                own, hit, times = held.known(hashes)
                z = np.concatenate([np.zeros(0), *(log_choices(*final.value, features[:, a : a + PART], own[a : a + PART]) for a in range(0, len(own), PART))]) / np.log(10)
                value = np.where(hit, np.log10(times + ALPHA), 0.0)
                rare = hashes[~hit].view(np.int64)
                cuts = np.concatenate([[0], np.cumsum(np.add.reduceat(~hit, begin, dtype=np.int64))])
                sums = lambda x: pa.array(np.add.reduceat(x, begin))
                rows = {c: batch.column(c).slice(words.rows.start, len(begin)) for c in ("row", "doc_id")}
                yield pa.RecordBatch.from_pydict(rows | {
                    "n_tokens": pa.array(np.diff(np.append(begin, len(hashes)))), "common": sums(hit.astype(np.int64)), "logs": sums(value), "model": sums(z - logs[own]),
                    "rare": pa.LargeListArray.from_arrays(pa.array(cuts), pa.array(rare)).cast(pa.list_(pa.int64())),
                })

    kinds = "row long, doc_id long, n_tokens long, common long, logs double, model double, rare array<long>"
    scores = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(scored, kinds), folder, "scores")
    keep_only(spark, folder, "counts", "scores")
    rare = scores.select("row", F.explode("rare").alias("h")).join(counts.filter(F.col("n") < least).select("h", "n"), "h", "left")
    added = rare.groupBy("row").agg(F.count("n").alias("rare_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + ALPHA)).alias("rare_logs"))
    out = scores.drop("rare").join(added, "row", "left")
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    return out.select(
        "doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "n_tokens", (F.col("common") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(all_n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(total))).alias("base_score"), (logs + F.col("model")).alias("score"),
    )
