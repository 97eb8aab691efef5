"""Symbol and text search: exact and qualified lookup, BM25, LIKE fallback, re-ranking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.scalars import kind_weight, lower_ascii
from quarry.operators.graph import fan_in

K1, B, FLOOR = 1.2, 0.75, 1e-6


def pool_size(limit: int) -> int:
    return max(20, min(60, 3 * limit))


def sketch(symbols: DataFrame, name: str) -> DataFrame:
    """The name itself, or qualified by a type (case-insensitively for ASCII)."""
    tail = lower_ascii(F.lit(f"::{name}"))
    return symbols.filter((F.col("name") == name) | F.endswith(lower_ascii(F.col("name")), tail)).orderBy(F.desc("exported"), "file_path", "line_start")


def entry(files: DataFrame, path: str) -> DataFrame:
    """The row of one path. Tables of an index are sorted by it, so that other row groups are skipped."""
    return files.filter(F.col("path") == path).limit(1)


def plain_words(text: Column) -> Column:
    """Lower-case words of letters and digits, accents kept."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _times(term: str) -> Column:
    return F.size(F.filter("w", lambda w: w == term))


def bm25(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text", match_all: bool = True, limit: int = 20) -> DataFrame:
    """(id, score): the best documents, by reading them all; fulltext.build makes an index. Score is higher for better. Terms are lower-case alphanumeric words."""
    counted = docs.select(id_col, plain_words(F.col(text_col)).alias("w")).select(id_col, F.size("w").alias("length"), *(_times(t).alias(f"tf{i}") for i, t in enumerate(terms)))
    stats = counted.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in range(len(terms)))).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = max(math.log((stats["docs"] - stats[f"n{i}"] + 0.5) / (stats[f"n{i}"] + 0.5)), FLOOR)
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / (stats["mean"] or 1.0)))
    hit = F.lit(match_all)
    for i in range(len(terms)):
        hit = hit & (F.col(f"tf{i}") > 0) if match_all else hit | (F.col(f"tf{i}") > 0)
    return counted.filter(hit).select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(limit)


def like(symbols: DataFrame, query: str, limit: int) -> DataFrame:
    """Names or signatures that hold the query (% and _ are wildcards), exported ones first."""
    q = lower_ascii(F.lit(f"%{query}%"))
    found = symbols.filter(F.like(lower_ascii(F.col("name")), q) | F.like(lower_ascii(F.col("signature")), q))
    return found.orderBy(F.desc("exported"), "name", "file_path", "line_start").limit(pool_size(limit))


def rerank(candidates: DataFrame, imports: DataFrame, limit: int) -> DataFrame:
    """By importing files, exported, kind and first position. candidates: symbols with position; at most a pool, so it is broadcast."""
    wanted = candidates.select(F.col("name").alias("imported_name"), F.col("file_path").alias("target_path")).distinct()
    used = fan_in(imports.join(F.broadcast(wanted), ["imported_name", "target_path"], "left_semi"))
    files = used.select(F.col("imported_name").alias("name"), F.col("target_path").alias("file_path"), "importer_files")
    ranked = candidates.join(files, ["name", "file_path"], "left").withColumn("importer_files", F.coalesce("importer_files", F.lit(0)))
    return ranked.orderBy(F.desc("importer_files"), F.desc("exported"), F.desc(kind_weight(F.col("kind"))), "position").limit(limit)


def with_position(candidates: DataFrame, *order) -> DataFrame:
    return candidates.withColumn("position", F.row_number().over(W.orderBy(*order)) - 1)
