"""Repeated passages, found by difference-cover anchors.

Positions that a perfect difference cover modulo 31 holds (6 of 31) get a hash of the next 20 words. Two
positions always have a shift under 31 that brings both into the cover, so passages of 50 equal words share an
aligned anchor that lies inside both. Only windows around anchors that two documents share are then extended
to the full length and compared.

Rows without text have no words. Repeated rows (same doc_id and text) each get the same result; copies under
other ids are removed from all but the smallest id. A doc_id with several texts counts as one document when others
are compared with it, and each of its texts is cut at its own places. Rows without doc_id have no smaller id: they
are returned whole, and nothing is removed for their sake.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.hashing import Words, windows, word_chunks
from quarry.llm.shared import keep_only, scratch, written

PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
"""Every difference modulo 31 is one of two of these."""


def _in_cover() -> np.ndarray:
    held = np.zeros(PERIOD, bool)
    held[list(COVER)] = True
    return held


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


def _within(words: Words, n: int) -> np.ndarray:
    """Position of each word in its text."""
    return np.arange(n) - np.repeat(words.first[:-1], words.counts())


def anchors(length: int):
    """Emits (h, doc_id, pos) for each anchor."""
    size, held = length - PERIOD + 1, _in_cover()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for words in word_chunks(batch.column("text")):
                hashes = words.hashes(lower=False)
                found, begin = windows(words, hashes, size)
                pos = _within(words, len(hashes))[begin]
                keep = held[pos % PERIOD]
                owner = np.repeat(ids[words.rows], words.counts())[begin[keep]]
                yield _batch(h=found[keep].view(np.int64), doc_id=owner, pos=pos[keep].astype(np.int32))

    return emit


def _lists(column: pa.Array) -> list[np.ndarray]:
    """A list column as numpy arrays; null as empty."""
    return [np.empty(0, np.int64) if x is None else np.asarray(x, np.int64) for x in column.to_pylist()]


def candidates(length: int):
    """Emits (h, doc_id, own, pos) for each window of full length that holds a shared anchor. own: the hash of the text."""
    size = length - PERIOD + 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("shared").is_valid())
            if not batch.num_rows:
                continue
            ids, own, shared = batch.column("doc_id").to_numpy(), batch.column("own").to_numpy(), _lists(batch.column("shared"))
            for words in word_chunks(batch.column("text")):
                hashes = words.hashes(lower=False)
                mark = np.zeros(len(hashes) + 1, np.int32)
                for first, last, at in zip(words.first[:-1], words.first[1:], shared[words.rows], strict=True):
                    at = first + at[at < last - first]
                    np.add.at(mark, np.maximum(at - (length - size), first), 1)
                    np.add.at(mark, np.minimum(at + 1, last), -1)
                found, begin = windows(words, hashes, length)
                keep = np.cumsum(mark[:-1])[begin] > 0
                pos = _within(words, len(hashes))[begin[keep]]
                owner = np.repeat(np.arange(words.rows.start, words.rows.stop), words.counts())[begin[keep]]
                yield _batch(h=found[keep].view(np.int64), doc_id=ids[owner], own=own[owner], pos=pos.astype(np.int32))

    return emit


def _cut(length: int, with_text: bool):
    """Emits the documents without the words that windows at `starts` cover."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = _lists(batch.column("starts"))
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
            for words in word_chunks(batch.column("text")):
                raw = words.data.tobytes()
                for k, (first, last) in enumerate(zip(words.first[:-1], words.first[1:], strict=True), words.rows.start):
                    mark = np.zeros(last - first + 1, np.int32)
                    np.add.at(mark, starts[k], 1)
                    np.add.at(mark, np.minimum(starts[k] + length, last - first), -1)
                    keep = np.flatnonzero(np.cumsum(mark[:-1]) == 0) + first
                    kept = b" ".join([raw[a:b] for a, b in zip(words.start[keep].tolist(), words.end[keep].tolist(), strict=True)])
                    out["n_words"].append(int(last - first))
                    out["n_removed"].append(int(last - first - len(keep)))
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    out["kept_text"].append(kept.decode() if with_text else None)
            columns = {"doc_id": batch.column("doc_id"), **{k: pa.array(v, pa.int64() if k[0] == "n" else pa.string()) for k, v in out.items()}}
            yield pa.RecordBatch.from_pydict(columns if with_text else {k: v for k, v in columns.items() if k != "kept_text"})

    return emit


def remove_repeats(docs: DataFrame, length: int = 50, with_text: bool = True) -> DataFrame:
    """Per document its words without those that a window of `length` words covers which also starts in a document of smaller id.

    Returns doc_id, n_words, n_removed, kept_sha256 and, with_text, kept_text (kept words joined by one space).
    """
    if length < PERIOD:
        raise ValueError(f"length must be {PERIOD} words or more")
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known, rows = docs.filter("doc_id is not null"), "h long, doc_id long, pos int"
    found = known.mapInArrow(anchors(length), rows)
    # tables of their own, so that the joins below meet plain exchanges, whose hot keys can be split
    shared = written(found.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("h"), folder, "shared")
    places = written(found.join(shared, "h").groupBy("doc_id").agg(F.collect_set("pos").alias("shared")), folder, "places")
    # left joins keep both reads of the texts alike, so one exchange of texts serves both
    spread = known.withColumn("own", F.xxhash64("text")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    marked = spread.join(places, "doc_id", "left").select("doc_id", "own", "text", "shared")
    longer = written(marked.mapInArrow(candidates(length), "h long, doc_id long, own long, pos int"), folder, "windows")
    first = longer.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("h", "first")
    first = written(first, folder, "first")
    keep_only(spark, folder, "windows", "first", "places")
    starts = longer.join(first, "h").filter("doc_id > first").groupBy("doc_id", "own").agg(F.collect_set("pos").alias("starts"))
    columns = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    cut = spread.join(starts, ["doc_id", "own"], "left").select("doc_id", "text", "starts")
    rest = docs.filter("doc_id is null").withColumn("starts", F.lit(None).cast("array<int>"))
    return cut.mapInArrow(_cut(length, with_text), columns).union(rest.mapInArrow(_cut(length, with_text), columns))
