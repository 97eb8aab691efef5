"""The index of a tree: files, symbols, imports and the listing as Parquet, published a version at a time.

Every file is read once: JVM columns first, then one Arrow pass for declarations, density, symbols and imports, written
as a table from which the others are cut. A version counts once its name is in CURRENT, so a failed build shows nothing.
"""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.describe import describe, known_label
from quarry.functions.scalars import estimate_tokens, extension
from quarry.operators import extract, fulltext, graph
from quarry.sources import mapfile, projects, tree

POINTER = "CURRENT"
SCHEMAS = {
    "files": "path string, description string, token_estimate bigint, density double, content_hash bigint, mtime_ms bigint",
    "symbols": "id bigint, file_path string, ord int, name string, kind string, signature string, line_start bigint, line_end bigint, exported boolean",
    "imports": "source_file string, imported_name string, target_path string, raw_path string, line_number bigint",
    "listing": "path string, size bigint, mtime_ms bigint",
}
"""What tables are read as: columns that an older index doesn't have come as null."""


def described(files: DataFrame) -> DataFrame:
    """(path, content, mtime_ms, token_estimate, content_hash, by_pattern, known) of readable files that aren't blank."""
    name, ext, text = F.regexp_extract("path", "([^/]*)$", 1), extension(F.col("path")), F.col("content")
    return files.filter(tree.scannable(F.col("path")) & text.rlike(r"\S")).select(
        "path", "content", "mtime_ms", estimate_tokens(text, ext).alias("token_estimate"), F.xxhash64("content").alias("content_hash"),
        describe(name, ext, text).alias("by_pattern"), known_label(name).isNotNull().alias("known"),
    )


def entries(parsed: DataFrame) -> DataFrame:
    description = F.when(F.col("known") | (F.col("declared") == ""), F.col("by_pattern")).otherwise(F.col("declared"))
    return parsed.select("path", description.alias("description"), "token_estimate", "density", "content_hash", "mtime_ms")


def listing(spark: SparkSession, root: str) -> DataFrame:
    tree.register(spark)
    return spark.read.format("srclisting").load(root)


def parsed(spark: SparkSession, root: str) -> DataFrame:
    tree.register(spark)
    return extract.parsed(described(spark.read.format("srctree").load(root)))


def architecture(files: DataFrame, imports: DataFrame) -> dict:
    """{languages, hotspots, file_count} of an index; both texts list a few rows."""
    languages = ", ".join(f"{r.language} {int(r.percent)}%" for r in graph.languages(extension(F.col("path")), files).collect())
    hotspots = ", ".join(f"{r.directory}/ ({r.imports_in} imports-in)" for r in graph.hotspots(imports).collect())
    return {"languages": languages, "hotspots": hotspots, "file_count": files.count()}


def current(folder: str) -> str | None:
    try:
        with open(os.path.join(folder, POINTER), encoding="utf-8") as f:
            return os.path.join(folder, f.read().strip())
    except OSError:
        return None


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    version = current(folder)
    if version is None:
        raise FileNotFoundError(f"no index in {folder}; run: quarry scan")
    return spark.read.schema(SCHEMAS[name]).parquet(os.path.join(version, name))


def term_index(folder: str) -> str | None:
    """The full-text index of the symbols; an index of before there was one has none."""
    path = os.path.join(current(folder) or folder, "terms")
    return path if os.path.isdir(path) else None


def read_architecture(folder: str) -> dict | None:
    try:
        with open(os.path.join(current(folder) or folder, "architecture.json"), encoding="utf-8") as f:
            return json.load(f)
    except OSError:
        return None


def scan(spark: SparkSession, root: str) -> dict[str, int]:
    """Builds, publishes and maps the index of root; gives the counts of files, symbols and imports."""
    folder = projects.initialized(root)
    old = current(folder)
    number = int(os.path.basename(old)[1:]) + 1 if old else 1
    version = os.path.join(folder, f"v{number}")
    shutil.rmtree(version, ignore_errors=True)
    at = lambda name: os.path.join(version, name)
    everything = listing(spark, root)
    everything.write.parquet(at("listing"))
    parsed(spark, root).write.parquet(at("parsed"))
    read = spark.read.parquet(at("parsed"))
    entries(read).orderBy("path").write.parquet(at("files"))
    extract.symbols(read).withColumn("id", F.monotonically_increasing_id()).write.parquet(at("symbols"))
    extract.imports(read, spark.read.parquet(at("listing"))).write.parquet(at("imports"))
    files, symbols, imports = (spark.read.parquet(at(n)) for n in ("files", "symbols", "imports"))
    fulltext.build(symbols, "id", at("terms"))
    summary = architecture(files, imports)
    with open(at("architecture.json"), "w", encoding="utf-8") as f:
        json.dump(summary, f)
    shutil.rmtree(at("parsed"))
    mapfile.write(files, folder)
    path = os.path.join(folder, mapfile.NAME)
    with open(path, encoding="utf-8") as f:
        text = mapfile.with_architecture(f.read(), summary["languages"], summary["hotspots"])
    mapfile.atomic_write(path, [text])
    mapfile.atomic_write(os.path.join(folder, POINTER), [os.path.basename(version)])
    if old:
        shutil.rmtree(old, ignore_errors=True)
    return {"files": summary["file_count"], "symbols": symbols.count(), "imports": imports.count()}
