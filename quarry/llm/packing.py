"""Packing token sequences by patterns.

Pieces of a length are alike, so packing works on the histogram of lengths, which has at most `size` entries
whatever the input. Patterns of a few lengths that fill a sequence (nearly) are enumerated; non-negative least
squares fits how often to repeat each so that the histogram is met; counts are rounded down and what is left is
packed by best fit, longest first. The plan says, for each length, which ranks go to which sequences; each
piece finds its place by its length and its rank within that length.

Ids are those of `tokenizers` for the JSON form of the vocabulary, by its default settings: the marker of its end
token in a text is that token. Null and empty texts hold only the end token. Repeated rows are packed each. Rows without doc_id are packed
too, with a null doc_id.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.shared import scratch, written

VOCABULARY, SIZE, END, ROWS_PER_BUCKET = "byte_bpe_50k.json", 2048, 0, 100_000
LONG = 100_000
"""Runs of blanks from this length go through the JSON form's own library: the other one's stack overflows at a million."""
BLANK_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d}" % LONG)


def _letters() -> dict[str, int]:
    """Byte-level vocabularies print a byte as a visible character: itself, or the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def _plain(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@cache
def _encoding(name: str):
    """The vocabulary and added tokens of a JSON form for the faster encoder: the same ids for any text."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        form = json.load(f)
    byte, added = _letters(), {t["content"]: t["id"] for t in form["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): rank for token, rank in form["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def token_ids(text: str | None, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The ids that `tokenizers` gives a text with add_special_tokens=False, then the end token. Null is empty."""
    text = text or ""
    if len(text) >= LONG and BLANK_RUN.search(text):
        ids = _plain(vocabulary).encode(text, add_special_tokens=False).ids
    else:
        ids = _encoding(vocabulary).encode(text, allowed_special="all")
    return np.array([*ids, END], dtype="<u4")


def _cut(vocabulary: str, size: int, with_ids: bool):
    """Pieces of at most `size` ids; only the first of a document may be shorter. Ids below 2^16 are held in two bytes each until `_wide`."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = token_ids(text.as_py(), vocabulary)
                narrow = ids.astype("<u2") if ids.max() < 1 << 16 else ids
                ends = range(len(ids) % size or size, len(ids) + 1, size)
                for piece, end in enumerate(ends):
                    start = 0 if piece == 0 else end - size
                    raw = ids[start:end].tobytes()
                    for k, v in zip(rows, (doc_id, piece, start, end - start, zlib.crc32(raw), narrow[start:end].tobytes()), strict=True):
                        rows[k].append(v)
            kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "ids": pa.binary()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items() if with_ids or k != "ids"})

    return emit


def _wide(raw: bytes, length: int) -> bytes:
    """`length` ids of two or four bytes each, as 32-bit."""
    return raw if len(raw) == 4 * length else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, ...]]:
    """Multisets of two to four lengths that fill a sequence or leave the least room, from the commonest lengths."""
    lengths = np.array(sorted(histogram), dtype=int)
    common = sorted(histogram, key=lambda n: (-histogram[n] * n, n))[:128]
    found = {(int(n),) * (size // int(n)) for n in lengths}

    def largest(room: int) -> int | None:
        at = int(np.searchsorted(lengths, room, "right")) - 1
        return int(lengths[at]) if at >= 0 else None

    for a in lengths.tolist():
        if (b := largest(size - a)) is not None:
            found.add((a, b))
    for i, a in enumerate(common):
        for b in common[i : i + 24]:
            if a + b < size and (c := largest(size - a - b)) is not None:
                found.add((a, b, c))
                for d in common[:4]:
                    if a + b + d < size and (e := largest(size - a - b - d)) is not None:
                        found.add((a, b, d, e))
    return sorted({tuple(sorted(p, reverse=True)) for p in found if len(p) > 1 and sum(p) <= size and size - sum(p) <= size // 64})


def repeats(histogram: dict[int, int], chosen: list[tuple[int, ...]], sweeps: int = 30) -> np.ndarray:
    """Non-negative least squares by coordinate descent: repeat counts that meet the histogram, rounded down."""
    lengths = sorted(histogram)
    row = {n: i for i, n in enumerate(lengths)}
    scale = np.array(lengths, float)  # a token counts alike in short and long pieces
    left = np.array([histogram[n] for n in lengths], float)
    parts = []
    for p in chosen:
        at, n = np.unique([row[x] for x in p], return_counts=True)
        weight = scale[at] ** 2
        parts.append((at, n.astype(float), weight, float((n * n * weight).sum())))
    x = np.zeros(len(chosen))
    for _ in range(sweeps):
        most = 0.0
        for k, (at, n, weight, norm) in enumerate(parts):
            step = max(-x[k], float((n * weight) @ left[at]) / norm)
            if step:
                x[k] += step
                left[at] -= n * step
                most = max(most, abs(step))
        if most < 0.01:
            break
    return np.floor(x + 1e-9).astype(np.int64)


def best_fit(histogram: dict[int, int], size: int) -> dict[tuple[int, ...], int]:
    """Best fit, longest first, over counts: how many sequences hold each multiset of lengths."""
    rooms: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for n in sorted(histogram, reverse=True):
        count = histogram[n]
        while count:
            room = min((r for r in rooms if r >= n), default=None)
            if room is None:
                per = min(size // n, count)
                rooms[size - per * n][(n,) * per] += count // per
                count %= per
                continue
            held, times = next(iter(rooms[room].items()))
            take = min(times, count)
            rooms[room][held] -= take
            if not rooms[room][held]:
                del rooms[room][held]
            if not rooms[room]:
                del rooms[room]
            rooms[room - n][(*held, n)] += take
            count -= take
    out: dict[tuple[int, ...], int] = defaultdict(int)
    for held in rooms.values():
        for p, times in held.items():
            out[p] += times
    return dict(out)


def plan(histogram: dict[int, int], size: int) -> dict[tuple[int, ...], int]:
    """How many sequences hold each multiset of lengths; every piece is placed."""
    left = dict(histogram)
    full = left.pop(size, 0)
    out: dict[tuple[int, ...], int] = {(size,): full} if full else {}
    if left:
        chosen = patterns(left, size)
        for p, times in sorted(zip(chosen, repeats(left, chosen).tolist(), strict=True), key=lambda x: (sum(x[0]) - size, -x[1], x[0]), reverse=True):
            times = min([times, *(left.get(n, 0) // p.count(n) for n in set(p))])
            if times > 0:
                out[p] = out.get(p, 0) + times
                for n in p:
                    left[n] -= times
        for p, times in best_fit({n: c for n, c in left.items() if c}, size).items():
            out[p] = out.get(p, 0) + times
    return out


def places(packed: dict[tuple[int, ...], int]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first rank, offset) rows of a plan."""
    used: dict[int, int] = defaultdict(int)
    base, rows = 0, []
    for p, times in sorted(packed.items()):
        at = 0
        for n in p:
            rows.append((n, used[n], used[n] + times - 1, base, at))
            used[n] += times
            at += n
        base += times
    return rows


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = SIZE, with_ids: bool = True) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, with_ids, ids (little-endian 32-bit)."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    pieces = written(docs.mapInArrow(_cut(vocabulary, size, with_ids), columns).withColumn("row", F.monotonically_increasing_id()), folder, "pieces")
    lengths = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # ranks within a length: counted by bucket, so that no length meets in one task
    buckets = max(64, sum(lengths.values()) // ROWS_PER_BUCKET)
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"))
    inside = W.partitionBy("length", "bucket").orderBy("row")
    ranked = bucketed.withColumn("rank", F.row_number().over(inside).cast("long") - 1).join(counts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("below"))
    found = sorted(places(plan(lengths, size)))
    held = spark.sparkContext.broadcast(np.array(found, np.int64).reshape(len(found), 5))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = held.value
        first = (rows[:, 0] << 40) + rows[:, 1]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(first, (batch.column("length").to_numpy() << 40) + rank, "right") - 1
            out = {name: batch.column(name) for name in names}
            if with_ids:
                out["ids"] = pa.array(map(_wide, batch.column("ids").to_pylist(), batch.column("length").to_pylist()), pa.binary())
            yield pa.RecordBatch.from_pydict(out | {"sequence_id": pa.array(rows[at, 3] + rank - rows[at, 1]), "offset": pa.array(rows[at, 4])})

    names = [c.split()[0] for c in columns.split(", ")]
    return ranked.select(*names, "rank").mapInArrow(placed, f"{columns}, sequence_id long, offset long")
