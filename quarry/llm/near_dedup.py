"""Near-duplicates: a multi-index Hamming join over b-bit MinHash signatures, confirmed on full shingle sets.

A signature is CHUNKS chunks of WIDTH symbols of 16 bits. Two signatures that differ in at most
2 * CHUNKS - 1 symbols have, by pigeonhole, a chunk with at most one error; each chunk is indexed once for
every place that error can take. So all pairs within that distance meet under a key. A pair that meets is
linked if its exact Jaccard similarity reaches the threshold.

Keys with many texts are not expanded into pairs. Texts with too many shingles of their own to be linked with
any other leave first, by an exact bound. Each round compares the texts under a key with one hub,
the text that shares most keys with others, and joins what is linked; a key all of whose texts are connected
is finished. What stays unconnected after ROUNDS hubs is compared one by one, but for texts whose rare shingles
rule that out.

Texts with equal sets are one text. Rows are told apart by a number that they get when they are written, so rows
without doc_id and repeated ids with different texts are linked each by its own text. A component without any
doc_id has none to name it. Null and empty texts have no set and link with nothing. Repeated rows get the same
result each, but only one row of a component is `first`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.hashing import U, mixed, windows, word_chunks
from quarry.llm.shared import dropped, keep_only, marked, numbered, scratch, written

CHUNKS, WIDTH, ROUNDS, RARE = 10, 5, 1, 8
SYMBOLS = CHUNKS * WIDTH
DISTANCE = 2 * CHUNKS - 1
LOOSE_DISTANCE = 25
"""At a similarity of 0.8 signatures are farther apart than this with a probability under 1e-6."""

_SEEDS = np.random.default_rng(11).integers(1, 2**63, (2, SYMBOLS), dtype=np.uint64) | U(1)


def _sets(words, hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    found, begin = windows(words, hashes, size, short=True)
    bounds = np.searchsorted(begin, words.first)
    return [np.unique(found[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _signatures(size: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_chunks(batch.column("text")):
                sets = _sets(words, words.hashes(lower=True), size)
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                sums, folds, signs = np.zeros(len(sets), U), np.zeros(len(sets), U), [None] * len(sets)
                if len(full):
                    x = np.concatenate([sets[i] for i in full])
                    at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    sums[full], folds[full] = np.add.reduceat(x, at), np.bitwise_xor.reduceat(mixed(x), at)
                    least = np.empty((len(full), SYMBOLS), U)
                    for k in range(SYMBOLS):
                        v = x * _SEEDS[0, k] + _SEEDS[1, k]
                        v ^= v >> U(29)
                        least[:, k] = np.minimum.reduceat(v, at)
                    for i, row in zip(full, (mixed(least) & U(0xFFFF)).astype(np.uint16), strict=True):
                        signs[i] = row.tobytes()
                yield pa.RecordBatch.from_pydict({
                    "row": batch.column("row").slice(words.rows.start, len(sets)), "doc_id": batch.column("doc_id").slice(words.rows.start, len(sets)), "n_shingles": pa.array(n, pa.int64()),
                    "total": pa.array(sums.view(np.int64)), "fold": pa.array(folds.view(np.int64)), "signature": pa.array(signs, pa.binary()),
                })

    return emit


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WIDTH keys for each chunk: all its symbols but one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        signs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, CHUNKS, WIDTH).astype(U)
        ids = batch.column("rep").to_numpy()
        for chunk in range(CHUNKS):
            for wild in range(WIDTH):
                packed = np.zeros(len(ids), U)
                for k in range(WIDTH):
                    if k != wild:
                        packed = (packed << U(16)) | signs[:, chunk, k]
                place = U(chunk * WIDTH + wild)
                key = (mixed(mixed(packed) + place + U(1)) & ~U(63)) | place
                yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "rep": pa.array(ids)})


def _shingle_sets(size: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_chunks(batch.column("text")):
                sets = [s.tobytes() for s in _sets(words, words.hashes(lower=True), size)]
                yield pa.RecordBatch.from_pydict({"rep": batch.column("rep").slice(words.rows.start, len(sets)), "shingles": pa.array(sets, pa.binary())})

    return emit


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("shingles")]
        if sets:
            yield pa.RecordBatch.from_pydict({"rep": pa.array(np.repeat(batch.column("rep").to_numpy(), [len(x) for x in sets])), "h": pa.array(np.concatenate(sets))})


def _own_shingles(shingles: DataFrame) -> DataFrame:
    """(rep, own): how many shingles of a text are in none of the others."""
    once = shingles.mapInArrow(_exploded, "rep long, h long").groupBy("h").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).filter("n = 1")
    return shingles.select("rep").join(once.groupBy("rep").agg(F.count("*").alias("own")), "rep", "left").select("rep", F.coalesce("own", F.lit(0)).alias("own"))


def _able(met: DataFrame, percent: int) -> DataFrame:
    """The (key, rep) rows of texts that can reach the similarity with another text under their key.

    A text has at most size - own shingles in common with any other; with one of at least `least` shingles that
    bounds the similarity by (size - own) / max(size, least + own).
    """
    least = met.groupBy("key").agg(F.min("size").alias("least"))
    able = met.join(least, "key").filter(f"100 * (size - own) >= {percent} * greatest(size, least + own)")
    able = able.select("key", "rep")
    return able.join(able.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "key")


def _rest(left: DataFrame, shingles: DataFrame, size: DataFrame, folder: str, percent: int) -> DataFrame:
    """(a, b): the pairs under a key and of two components that may still be linked.

    Texts that share a shingle of at most RARE of these texts are pairs. Any others have no rare shingle in common,
    so a text's rare shingles count as its own in the bound of _able.
    """
    held = written(shingles.join(left.select("rep").distinct(), "rep").mapInArrow(_exploded, "rep long, h long"), folder, "held")
    rare = written(held.join(held.groupBy("h").agg(F.count("*").alias("n")).filter(f"n <= {RARE}").select("h"), "h"), folder, "rare")
    own = size.join(rare.groupBy("rep").agg(F.count("*").alias("own")), "rep", "left").select("rep", "size", F.coalesce("own", F.lit(0)).alias("own"))
    component = left.select("rep", "component").distinct()
    able = _able(left.select("key", "rep").join(own, "rep"), percent).join(component, "rep")
    open_keys = able.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key")
    able = written(able.join(open_keys, "key"), folder, "able")
    # a key's last six bits are its place, so a pair has a first key in common; the join gives it there only
    keys = F.transform(F.sort_array(F.collect_set(F.struct((F.col("key").bitwiseAND(63)).alias("place"), "key"))), lambda k: k["key"])
    able = able.select("key", "rep", "component").join(able.groupBy("rep").agg(keys.alias("keys")), "rep")
    one, two = able.toDF("a", "key", "ca", "x"), able.toDF("b", "key2", "cb", "y")
    under_key = one.join(two, F.expr("key = key2 and a < b and ca <> cb and array_intersect(x, y)[0] = key")).select("a", "b")
    met = F.array_sort(F.collect_list("rep"))
    few = rare.groupBy("h").agg(met.alias("m")).filter("size(m) > 1").select("m").distinct()
    some = few.select(F.explode("m").alias("a"), "m").select("a", F.explode("m").alias("b")).filter("a < b").distinct()
    some = some.join(component.toDF("a", "ca"), "a").join(component.toDF("b", "cb"), "b").filter("ca <> cb").select("a", "b")
    return under_key.union(some).distinct()


def _confirm(percent: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= percent * (len(a) + len(b) - same))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return emit


def _near(distance: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array((x != y).sum(1) <= distance))

    return emit


def _order(doc_id: str, row: str):
    """Which row stands for its component: that of the smallest doc_id, rows with one before rows without."""
    return F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.col(row))


def contracted(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """Edges (a, b) from every id a of the undirected edges (a, b) to the smallest id reachable.

    Alternates large-star and small-star steps, each one aggregation and one join, until no edge changes.
    """
    spark = edges.sparkSession
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), folder, f"{name}-0")
    before, step = None, 0
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        step += 1
        edges = written(small.select("e.a", "e.b").filter("a <> b").distinct(), folder, f"{name}-{step}")
        dropped(spark, f"{folder}/{name}-{step - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges
        before = now


def labels(edges: DataFrame) -> DataFrame:
    """(id, component) of contracted edges."""
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())


def link(docs: DataFrame, shingle: int = 5, percent: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id is that), first (the row that stands for its component), and, with keep, those columns as the struct `input`."""
    rows, out = _linked(docs, shingle, percent, keep)
    if keep:
        out = rows.join(out, "row")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("first")).alias("kept"), "first", *([F.struct(*(F.col(f"input.{c}").alias(c) for c in keep)).alias("input")] if keep else []))


def firsts(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stand for their component. Rows stay where they are: a bit each tells which."""
    rows, out = _linked(docs, shingle, percent, tuple(docs.columns))
    rows = marked(rows, out.filter("first")).filter("marked")
    return rows.select(*(F.col("input")[c].alias(c) for c in docs.columns))


def _linked(docs: DataFrame, shingle: int, percent: int, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(row, input) and (row, doc_id, n_shingles, component_id, first); with keep nothing else is left, and input has those columns."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    rows = numbered(docs.select(F.struct(*dict.fromkeys(("doc_id", "text", *keep))).alias("input")), folder)
    docs = rows.select("row", F.col("input.doc_id").cast("long").alias("doc_id"), F.col("input.text").cast("string").alias("text"))
    signed = docs.mapInArrow(_signatures(shingle), "row long, doc_id long, n_shingles long, total long, fold long, signature binary")
    signed = written(signed, folder, "signed")
    sets = signed.filter("n_shingles > 0").groupBy("n_shingles", "total", "fold").agg(F.min_by("signature", "row").alias("signature"), F.min("row").alias("rep"), F.min("doc_id").alias("low"), F.min_by("row", _order("doc_id", "row")).alias("first"))
    reps = written(sets, folder, "reps")
    keys = reps.select("rep", "signature").mapInArrow(_keys, "key long, rep long")
    often = written(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), folder, "often")
    met = written(keys.join(often, "key"), folder, "met")
    spread = marked(docs.select("row", "text"), met.select(F.col("rep").alias("row"))).filter("marked").withColumnRenamed("row", "rep")
    shingles = written(spread.select("rep", "text").mapInArrow(_shingle_sets(shingle), "rep long, shingles binary"), folder, "shingles")
    size = written(_own_shingles(shingles).join(reps, "rep").select("rep", F.col("n_shingles").alias("size"), "own", "signature"), folder, "sizes")
    shared = written(_able(met.join(size.select("rep", "size", "own"), "rep"), percent), folder, "shared")
    ids = size.select("rep", "signature")
    size = size.select("rep", "size")
    weights = shared.join(shared.groupBy("key").agg(F.count("*").alias("n")), "key").groupBy("rep").agg(F.sum("n").alias("weight"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        x = shingles.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
        y = shingles.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long")

    stars = None
    groups = size.select("rep", F.col("rep").alias("component"))
    open_keys = shared.join(weights, "rep").select("key", "rep", "weight")
    for turn in range(ROUNDS + 1):
        placed = open_keys.join(groups, "rep")
        unfinished = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("hub"), F.max_by("component", F.struct("weight", -F.col("rep"))).alias("hub_component")).filter("x < y")
        left = written(placed.join(unfinished.select("key", "hub", "hub_component"), "key"), folder, f"left{turn}")
        if turn < ROUNDS:
            pairs = left.filter("component <> hub_component").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
            pairs = pairs.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b")
            pairs = pairs.join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b").mapInArrow(_near(LOOSE_DISTANCE), "a long, b long")
            # a hub is chosen once under a key
            open_keys = left.select("key", "rep", F.when(F.col("rep") == F.col("hub"), 0).otherwise(F.col("weight")).alias("weight"))
        else:
            pairs = _rest(left, shingles, size, folder, percent)
        new = written(confirmed(pairs), folder, f"links{turn}")
        if turn and new.isEmpty():
            continue
        stars = contracted(new if stars is None else stars.union(new), folder, f"cc{turn}")
        merged = written(labels(stars), folder, f"groups{turn}")
        groups = size.join(merged.withColumnRenamed("id", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"))
    keep_only(spark, folder, "rows", "signed", "reps", "sizes", *(f"groups{turn}" for turn in range(ROUNDS + 1)))
    placed = reps.select("n_shingles", "total", "fold", "rep", "low", "first").join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    whole = placed.groupBy("component").agg(F.min("low").alias("component_id"), F.min_by("first", _order("low", "first")).alias("first"))
    found = placed.select("n_shingles", "total", "fold", "component").join(whole, "component").drop("component")
    out = signed.select("row", "doc_id", "n_shingles", "total", "fold").join(found, ["n_shingles", "total", "fold"], "left")
    empty = F.col("n_shingles") == 0
    out = out.select("row", "doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (empty | (F.col("row") == F.col("first"))).alias("first"))
    if keep:
        out = written(out, folder, "judged")
        keep_only(spark, folder, "rows", "judged")
    return rows, out
