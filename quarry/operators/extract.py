"""Symbols and imports of a table of files (path, content): each file is read once, in Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType, _parse_datatype_string

DENSITY_FROM = 256
_SYMBOL = "struct<name:string,kind:string,signature:string,line_start:bigint,line_end:bigint,exported:boolean>"
_IMPORT = "struct<imported_name:string,raw_path:string,line_number:bigint,candidates:array<string>>"
PARSED = {"declared": "string", "density": "double", "symbols": f"array<{_SYMBOL}>", "imports": f"array<{_IMPORT}>"}


def density(raw: bytes) -> float | None:
    """The gzipped share of a content's size; none below 256 bytes, where headers would weigh too much."""
    if len(raw) < DENSITY_FROM:
        return None
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return (len(packer.compress(raw)) + len(packer.flush())) / len(raw)


@F.pandas_udf(DoubleType())
def gzip_density(content: pd.Series) -> pd.Series:
    return content.map(lambda t: density((t or "").encode()))


def _parse(batches: Iterator[pa.RecordBatch], kinds: dict[str, pa.DataType], resolve_export_clauses: bool = False) -> Iterator[pa.RecordBatch]:
    from quarry.lang import reader
    from quarry.lang.summary import summary

    def declared(path: str, text: str, ext: str) -> list[dict]:
        found = reader.symbols(text, ext)
        if resolve_export_clauses and reader.LANGUAGES.get(ext) == "js":
            found = reader.with_export_clauses(found, text)
        return [{k: v for k, v in vars(s).items() if k != "word"} for s in found]

    def used(path: str, text: str, ext: str) -> list[dict]:
        return [{"imported_name": i.name, "raw_path": i.raw_path, "line_number": i.line, "candidates": reader.candidates(i.raw_path, path, ext)} for i in reader.imports(text, ext)]

    read = {"declared": lambda path, text, ext: summary(text, ext), "density": lambda path, text, ext: density(text.encode()), "symbols": declared, "imports": used}
    for batch in batches:
        files = []
        for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
            files.append((path, content or "", path.rsplit("/", 1)[-1].rsplit(".", 1)[-1]))
        made = {name: pa.array([read[name](*f) for f in files], kind) for name, kind in kinds.items()}
        kept = {name: batch[name] for name in batch.schema.names if name != "content"}
        yield pa.RecordBatch.from_pydict(kept | made)


def parsed(files: DataFrame, resolve_export_clauses: bool = False, only: tuple[str, ...] = tuple(PARSED)) -> DataFrame:
    """The files without their content, with declared, density and the arrays symbols and imports; write it, as several tables come from it. resolve_export_clauses: names in JS export clauses count as exported. only: those of the four that are wanted, as each is read on its own."""
    kept = StructType([f for f in files.schema if f.name != "content"])
    schema = StructType([*kept, *(StructField(name, _parse_datatype_string(PARSED[name])) for name in only)])
    kinds = {name: to_arrow_type(schema[name].dataType) for name in only}
    return files.mapInArrow(partial(_parse, kinds=kinds, resolve_export_clauses=resolve_export_clauses), schema)


def symbols(parsed_files: DataFrame) -> DataFrame:
    return parsed_files.select(F.col("path").alias("file_path"), F.posexplode("symbols").alias("ord", "s")).select("file_path", "ord", "s.*")


def imports(parsed_files: DataFrame, listing: DataFrame) -> DataFrame:
    """Imports with their target among all listed files: the first candidate that exists, or empty.

    Candidates are looked up by a shuffle: the planner guesses the size of what was read from sources by that of the
    table it came from, and would send all listed files to the driver. Files are read once, as nothing is joined back.
    """
    each = parsed_files.select(F.col("path").alias("source_file"), F.posexplode("imports").alias("ord", "i")).select(F.monotonically_increasing_id().alias("row"), "source_file", "i.*")
    kept = ("source_file", "imported_name", "raw_path", "line_number")
    tried = each.select("row", *kept, F.posexplode_outer("candidates").alias("pos", "path"))
    there = listing.select("path").distinct().withColumn("found", F.lit(True))
    met = tried.join(there.hint("shuffle_merge"), "path", "left").groupBy("row", *kept).agg(F.min(F.when(F.col("found"), F.struct("pos", "path"))).alias("first"))
    return met.select("source_file", "imported_name", F.coalesce("first.path", F.lit("")).alias("target_path"), "raw_path", "line_number")
