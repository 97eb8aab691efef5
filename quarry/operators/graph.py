"""Symbols, imports and changes. symbols: name, file_path, kind, line_start, line_end, exported; imports: source_file, imported_name, target_path, line_number."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.scalars import classify_risk, directory, language


def importers(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct (imported_name, target_path, source_file, line_number) of imports that name a known symbol."""
    known = symbols.select(F.col("name").alias("imported_name"), F.col("file_path").alias("target_path"))
    return imports.join(known, ["imported_name", "target_path"], "left_semi").select("imported_name", "target_path", "source_file", "line_number").distinct()


def fan_in(imports: DataFrame) -> DataFrame:
    """Per imported symbol: importing files, and importing sites (file and line).

    Counted per importing file first: one distinct count each time, so rows aren't doubled, and a symbol that
    everything imports is spread over its files.
    """
    each = imports.groupBy("imported_name", "target_path", "source_file").agg(F.countDistinct("line_number").alias("lines"))
    return each.groupBy("imported_name", "target_path").agg(F.count("source_file").alias("importer_files"), F.sum("lines").alias("importer_sites"))


def callers(imports: DataFrame) -> DataFrame:
    """Per imported name and file: its sorted lines."""
    return imports.groupBy("imported_name", "source_file").agg(F.array_join(F.array_sort(F.collect_list("line_number")), ",").alias("lines"))


STRIP, WORD = 256, 64


def _strips(a: str, b: str) -> list[Column]:
    """The strip of STRIP lines that lines a to b are in, a row each."""
    return [F.explode(F.sequence(F.floor(F.col(a) / STRIP), F.floor(F.col(b) / STRIP))).alias("strip")]


def _lines(a: str, b: str) -> list[Column]:
    """Lines a to b within a strip, as bits of STRIP / WORD numbers."""
    bits = []
    for at in range(0, STRIP, WORD):
        low, high = (F.col(x) - F.col("strip") * STRIP - at for x in (a, b))
        ones = F.call_function("shiftleft", F.lit(-1).cast("long"), F.greatest(low, F.lit(0)).cast("int"))
        kept = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (WORD - 1 - F.least(high, F.lit(WORD - 1))).cast("int"))
        bits.append(F.when((low < WORD) & (high >= 0), ones.bitwiseAND(kept)).otherwise(0))
    return bits


def overlapping(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """Symbols that a changed range touches, each once.

    The changed lines of each strip of a file are one row of bits, however many ranges there are, so a symbol meets
    one row in each of its strips and never all ranges of its file.
    """
    names = [f"lines{i}" for i in range(STRIP // WORD)]
    ranges = hunks.filter("start <= end").select("file_path", "start", "end").distinct().select("*", *_strips("start", "end"))
    changed = ranges.groupBy("file_path", "strip").agg(*(F.bit_or(x).alias(n) for n, x in zip(names, _lines("start", "end"), strict=True)))
    placed = symbols.filter("line_start <= line_end").select("*", *_strips("line_start", "line_end"))
    touched = reduce(or_, (F.col(n).bitwiseAND(x) != 0 for n, x in zip(names, _lines("line_start", "line_end"), strict=True)))
    return placed.join(changed, ["file_path", "strip"]).filter(touched).select(symbols.columns).dropDuplicates(["name", "file_path", "line_start"])


def impact(symbols: DataFrame, hunks: DataFrame, imports: DataFrame) -> DataFrame:
    """Touched symbols with importing sites and risk; symbols that aren't exported have none."""
    touched = overlapping(symbols, hunks)
    wanted = touched.filter("exported").select(F.col("name").alias("imported_name"), F.col("file_path").alias("target_path"))
    used = fan_in(imports.join(wanted, ["imported_name", "target_path"], "left_semi"))
    found = touched.join(used.select(F.col("imported_name").alias("name"), F.col("target_path").alias("file_path"), "importer_sites"), ["name", "file_path"], "left")
    count = F.when(F.col("exported"), F.coalesce("importer_sites", F.lit(0))).otherwise(F.lit(0))
    return found.select("name", "file_path", "kind", "line_start", "exported", count.alias("importer_count"), classify_risk(count).alias("risk"))


def most_imported(impacted: DataFrame, limit: int) -> DataFrame:
    """The first rows of an impact, by importing sites and then place."""
    return impacted.orderBy(F.desc("importer_count"), "file_path", "line_start", "name").limit(limit)


def affected_files(symbols: DataFrame, hunks: DataFrame, imports: DataFrame) -> DataFrame:
    touched = overlapping(symbols, hunks).filter("exported").select(F.col("name").alias("imported_name"), F.col("file_path").alias("target_path"))
    return imports.join(touched, ["imported_name", "target_path"], "left_semi").select("source_file").distinct()


def languages(ext: Column, files: DataFrame, top: int = 4, by_extension: bool = False) -> DataFrame:
    name = F.when(ext == "", "other").otherwise(ext) if by_extension else language(ext)
    counted = files.groupBy(name.alias("language")).agg(F.count("*").alias("files"))
    total = F.sum("files").over(W.partitionBy())
    return counted.withColumn("percent", F.round(100.0 * F.col("files") / F.greatest(total, F.lit(1)))).orderBy(F.desc("files"), "language").limit(top)


def hotspots(imports: DataFrame, top: int = 3, include_unresolved: bool = False) -> DataFrame:
    rows = imports if include_unresolved else imports.filter("target_path <> ''")
    return rows.groupBy(directory(F.col("target_path")).alias("directory")).agg(F.count("*").alias("imports_in")).orderBy(F.desc("imports_in"), "directory").limit(top)


def owning_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root): the longest root above each path, null without one."""
    cuts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(cuts)), lambda i: F.array_join(F.slice(cuts, 1, i), "/"))
    each = paths.select("path", F.explode(above).alias("root")).join(roots.select("root").distinct(), "root")
    best = each.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(best, "path", "left")
