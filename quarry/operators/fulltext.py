"""Full-text queries over several columns: words, "phrases", prefix*, ^first, column:filters, NEAR(), AND, OR, NOT, brackets.

A query becomes one boolean and one BM25 score over the positions of its phrases. Positions come from an index
(`build`: postings sorted by term, and the lengths of rows), of which a query reads its own terms, or without one from
the rows themselves, in one pass for the counts and one for the best rows. What isn't in the grammar raises QueryError.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.search import FLOOR, K1, B, like, pool_size, rerank, with_position

COLUMNS = ("name", "kind", "signature", "file_path")
_ACCENTED = {chr(c): base for c in range(0xC0, 0x250) if unicodedata.combining((d := unicodedata.normalize("NFD", chr(c)))[-1]) and len(base := d[0]) == 1}
_TOKEN = re.compile(r'\s*(?:(?P<quoted>"(?:[^"]|"")*")|(?P<word>[\w]+)|(?P<mark>[:*()^,]))')
NEAR = 10


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    column: str | None = None
    first: bool = False
    """Only at the beginning of a column."""


@dataclass(frozen=True)
class Near:
    """Phrases in one column with at most `gap` words between the end of each and the beginning of the last."""

    phrases: tuple[Phrase, ...]
    gap: int = NEAR


@dataclass(frozen=True)
class Node:
    op: str
    left: Phrase | Near | Node
    right: Phrase | Near | Node


def fold(text: str) -> str:
    return "".join(_ACCENTED.get(c, c) for c in text).lower()


def split_words(text: str) -> tuple[str, ...]:
    return tuple(w for w in re.split(r"[\W_]+", fold(text)) if w)


def parse(query: str, columns: tuple[str, ...] = COLUMNS) -> Phrase | Near | Node:
    """NOT binds closest, then AND (also by juxtaposition), then OR."""
    tokens, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = _TOKEN.match(query, at)
        if m is None:
            raise QueryError(f"unexpected character at {at} in {query!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    pos = 0

    def peek(offset: int = 0) -> tuple[str, str]:
        return tokens[pos + offset] if pos + offset < len(tokens) else ("end", "")

    def take() -> tuple[str, str]:
        nonlocal pos
        pos += 1
        return tokens[pos - 1]

    def primary(column: str | None) -> Phrase | Near | Node:
        kind, value = peek()
        if (kind, value) == ("mark", "("):
            take()
            inner = either(column)
            if peek() != ("mark", ")"):
                raise QueryError("missing )")
            take()
            return inner
        if kind == "word" and peek(1) == ("mark", ":"):
            if value.lower() not in columns:
                raise QueryError(f"no such column: {value}")
            take(), take()
            return primary(value.lower())
        if (kind, value) == ("word", "NEAR") and peek(1) == ("mark", "("):
            take(), take()
            inner, gap = [], NEAR
            while peek() not in (("mark", ")"), ("mark", ",")):
                inner.append(phrase(column))
            if peek() == ("mark", ","):
                take()
                kind, value = take() if peek()[0] == "word" else ("", "")
                if not value.isdigit():
                    raise QueryError("NEAR needs a number after the comma")
                gap = int(value)
            if not inner or peek() != ("mark", ")"):
                raise QueryError("NEAR needs phrases and )")
            take()
            return inner[0] if len(inner) == 1 else Near(tuple(inner), gap)
        return phrase(column)

    def phrase(column: str | None) -> Phrase:
        first = peek() == ("mark", "^")
        if first:
            take()
        kind, value = peek()
        if kind not in ("word", "quoted") or value in ("AND", "OR", "NOT"):
            raise QueryError(f"unexpected {value or 'end'!r}")
        take()
        words = split_words(value.strip('"'))
        if not words:
            raise QueryError("empty phrase")
        prefix = peek() == ("mark", "*")
        if prefix:
            take()
        return Phrase(words, prefix, column, first)

    def minus(column: str | None) -> Phrase | Near | Node:
        left = primary(column)
        while peek() == ("word", "NOT"):
            take()
            left = Node("NOT", left, primary(column))
        return left

    def both(column: str | None) -> Phrase | Near | Node:
        left = minus(column)
        while peek()[0] != "end" and peek() not in (("word", "OR"), ("mark", ")")):
            if peek() == ("word", "AND"):
                take()
            left = Node("AND", left, minus(column))
        return left

    def either(column: str | None) -> Phrase | Near | Node:
        left = both(column)
        while peek() == ("word", "OR"):
            take()
            left = Node("OR", left, both(column))
        return left

    tree = either(None)
    if peek()[0] != "end":
        raise QueryError(f"unexpected {peek()[1]!r}")
    return tree


def _leaves(tree: Phrase | Near | Node, scored: bool = True) -> list[tuple[Phrase | Near, bool]]:
    if not isinstance(tree, Node):
        return [(tree, scored)]
    return _leaves(tree.left, scored) + _leaves(tree.right, scored and tree.op != "NOT")


def _phrases(leaf: Phrase | Near) -> tuple[Phrase, ...]:
    return leaf.phrases if isinstance(leaf, Near) else (leaf,)


def _holds(tree: Phrase | Near | Node, count: Callable[[Phrase | Near], Column]) -> Column:
    if not isinstance(tree, Node):
        return count(tree) > 0
    left, right = _holds(tree.left, count), _holds(tree.right, count)
    return left | right if tree.op == "OR" else left & (~right if tree.op == "NOT" else right)


def words(text: Column) -> Column:
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), "".join(_ACCENTED), "".join(_ACCENTED.values()))
    return F.filter(F.split(F.lower(plain), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _fits(word: Column, phrase: Phrase, j: int) -> Column:
    """The word is the phrase's word j, or begins with it."""
    return F.startswith(word, F.lit(phrase.words[j])) if phrase.prefix and j == len(phrase.words) - 1 else word == phrase.words[j]


def _in_words(array: str, phrase: Phrase) -> Column:
    """Where a phrase begins in an array of words, from 0."""

    def begins(word: Column, i: Column) -> Column:
        each = (word if j == 0 else F.coalesce(F.get(array, i + j), F.lit("")) for j in range(len(phrase.words)))
        return F.when(reduce(lambda a, b: a & b, (_fits(w, phrase, j) for j, w in enumerate(each))), i)

    return F.array_compact(F.transform(array, begins))


def _near(places: list[Column], phrases: tuple[Phrase, ...], gap: int) -> list[Column]:
    """Of each phrase's places those that stand with one of every other phrase within the gap."""
    reach = [len(p.words) + gap for p in phrases]

    def some(at: Column, last: Column, n: int) -> Column:
        return F.exists(at, lambda x: (x <= last) & (x >= last - n))

    def kept(at: Column, n: int) -> Column:
        return F.filter(at, lambda x: F.exists(lasts, lambda last: (x <= last) & (x >= last - n)))

    lasts = F.filter(F.array_distinct(F.concat(*places)), lambda last: reduce(lambda a, b: a & b, (some(at, last, n) for at, n in zip(places, reach, strict=True))))
    return [kept(at, n) for at, n in zip(places, reach, strict=True)]


def _ranked(located: DataFrame, keep: list[str], tree: Phrase | Near | Node, columns: tuple[str, ...], stats: Callable[[DataFrame, list[Column]], tuple[int, float, list[int]]], order: tuple[str, ...], limit: int | None) -> DataFrame:
    """Rows that the query fits, best first.

    located: `keep`, _length, and _p{i}_{column}, the places of phrase i of all in a column. stats gives the number of
    rows, their mean length and in how many each phrase is.
    """
    leaves = dict(_leaves(tree))
    every = list(dict.fromkeys(p for leaf in leaves for p in _phrases(leaf)))
    none = F.array().cast("array<int>")

    def at(p: Phrase, c: str) -> Column:
        return F.coalesce(F.col(f"_p{every.index(p)}_{c}"), none) if p.column in (None, c) else none

    plain = [reduce(lambda a, b: a + b, (F.size(at(p, c)) for c in columns)) for p in every]
    docs, mean, holding = stats(located, [n > 0 for n in plain])
    count, score = {}, F.lit(0.0)
    for leaf, scored in leaves.items():
        phrases = _phrases(leaf)
        kept = [_near([at(p, c) for p in phrases], phrases, leaf.gap) if isinstance(leaf, Near) else [at(leaf, c)] for c in columns]
        times = [reduce(lambda a, b: a + b, (F.size(in_column[i]) for in_column in kept)) for i in range(len(phrases))]
        count[leaf] = reduce(F.least, times) if len(times) > 1 else times[0]
        for p, tf in zip(phrases, times if scored else (), strict=bool(scored)):
            n = holding[every.index(p)]
            idf = math.log((docs - n + 0.5) / (n + 0.5))
            score = score + F.lit(idf if idf > 0 else FLOOR) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_length") / F.lit(mean or 1.0)))
    found = located.filter(_holds(tree, count.get)).select(*keep, score.alias("score")).orderBy(F.desc("score"), *order)
    return found if limit is None else found.limit(limit)


def _all_phrases(tree: Phrase | Near | Node) -> list[Phrase]:
    return list(dict.fromkeys(p for leaf, _ in _leaves(tree) for p in _phrases(leaf)))


def match(rows: DataFrame, query: str, order: tuple[str, ...], limit: int | None, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Rows that a query fits with their score (higher is better), ties by the order columns; without an index."""
    tree = parse(query, columns)
    split = rows.select("*", *(words(F.col(c)).alias(f"_w_{c}") for c in columns))
    length = reduce(lambda a, b: a + b, (F.size(f"_w_{c}") for c in columns)).alias("_length")
    first = lambda p, at: F.filter(at, lambda x: x == 0) if p.first else at
    places = [first(p, _in_words(f"_w_{c}", p)).alias(f"_p{i}_{c}") for i, p in enumerate(_all_phrases(tree)) for c in columns if p.column in (None, c)]

    def stats(located: DataFrame, holds: list[Column]) -> tuple[int, float, list[int]]:
        found = located.agg(F.count("*").alias("docs"), F.avg("_length").alias("mean"), *(F.count_if(h).alias(f"n{i}") for i, h in enumerate(holds))).first()
        return found["docs"], found["mean"], [found[f"n{i}"] for i in range(len(holds))]

    return _ranked(split.select(*rows.columns, length, *places), rows.columns, tree, columns, stats, order, limit)


def build(rows: DataFrame, key: str, folder: str, columns: tuple[str, ...] = COLUMNS, split_column: Callable[[Column], Column] = words) -> None:
    """Writes the index of rows (told apart by `key`): postings (term, key, column, places) by term, lengths, and totals."""
    split = rows.select(F.col(key).alias("key"), *(split_column(F.col(c)).alias(c) for c in columns))
    split.select("key", reduce(lambda a, b: a + b, (F.size(c) for c in columns)).alias("length")).write.mode("overwrite").parquet(f"{folder}/lengths")
    each = split.select("key", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("w")) for c in columns))).alias("c")).select("key", "c.column", F.posexplode("c.w").alias("place", "term"))
    # a row's words are in one place, so they are gathered before anything moves
    postings = each.groupBy("term", "key", "column").agg(F.sort_array(F.collect_list("place")).alias("places"))
    postings.repartitionByRange("term", "key").sortWithinPartitions("term", "key").write.mode("overwrite").parquet(f"{folder}/postings")
    lengths = rows.sparkSession.read.parquet(f"{folder}/lengths")
    lengths.agg(F.count("*").alias("docs"), F.avg("length").alias("mean")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/totals")


def match_indexed(spark: SparkSession, folder: str, query: str, limit: int | None, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(key, score) of the rows that a query fits, best first, ties by key. Only its terms' postings are read."""
    tree = parse(query, columns)
    every = _all_phrases(tree)
    slots = list(dict.fromkeys((w, p.prefix and j == len(p.words) - 1) for p in every for j, w in enumerate(p.words)))
    fits = [F.startswith("term", F.lit(w)) if prefix else F.col("term") == w for w, prefix in slots]
    read = spark.read.parquet(f"{folder}/postings").filter(reduce(lambda a, b: a | b, fits))
    places = [F.flatten(F.collect_list(F.when(fit & (F.col("column") == c), F.col("places")))).alias(f"_s{i}_{c}") for i, fit in enumerate(fits) for c in columns]
    gathered = read.groupBy("key").agg(*places)

    def before(at: Column, j: int) -> Column:
        return F.transform(at, lambda x: x - j)

    def begins(p: Phrase, c: str) -> Column:
        at = [F.col(f"_s{slots.index((w, p.prefix and j == len(p.words) - 1))}_{c}") for j, w in enumerate(p.words)]
        found = reduce(F.array_intersect, (before(a, j) for j, a in enumerate(at)))
        return F.filter(found, lambda x: x == 0) if p.first else found

    lengths = spark.read.parquet(f"{folder}/lengths").withColumnRenamed("length", "_length")
    located = gathered.select("key", *(begins(p, c).alias(f"_p{i}_{c}") for i, p in enumerate(every) for c in columns if p.column in (None, c)))
    held = located.join(lengths, "key")

    def stats(_: DataFrame, holds: list[Column]) -> tuple[int, float, list[int]]:
        totals = spark.read.parquet(f"{folder}/totals").first()
        counts = located.agg(*(F.count_if(h).alias(f"n{i}") for i, h in enumerate(holds))).first()
        return totals["docs"], totals["mean"], [counts[f"n{i}"] for i in range(len(holds))]

    return _ranked(held, ["key"], tree, columns, stats, ("key",), limit)


def find(symbols: DataFrame, imports: DataFrame, query: str, limit: int = 20, index: str | None = None) -> DataFrame:
    """Symbols for a query, best first: a full-text pool, or a LIKE pool where it fails or is empty, re-ranked by use.

    index: the folder of an index of the symbols by their `id`, if there is one.
    """
    order = ("file_path", "line_start", "name")
    try:
        if index is None:
            pool = match(symbols, query, order, pool_size(limit))
        else:
            hits = match_indexed(symbols.sparkSession, index, query, None).withColumnRenamed("key", "id")
            pool = symbols.join(hits, "id").orderBy(F.desc("score"), *order).limit(pool_size(limit))
        ranked = with_position(pool, F.desc("score"), *order).drop("score")
        if ranked.isEmpty():
            raise QueryError("no match")
    except QueryError:
        ranked = with_position(like(symbols, query, limit), F.desc("exported"), "name", "file_path", "line_start")
    return rerank(ranked, imports, limit)
