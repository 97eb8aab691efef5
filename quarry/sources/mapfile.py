"""The Markdown map of a tree: one section per folder, one line per file.

A map is read as whole files and cut into sections, then lines, so the folder of a line needs no window and many maps
are read in parallel. It is written by the driver from a sorted stream of lines, next to the target and then renamed.
"""

from __future__ import annotations

import os
import re
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalars import density_label, directory

NAME = "map.md"
# What a label stands for when a map is read back.
LABEL_DENSITY = {"dense": 0.55, "repetitive": 0.10}
ARCHITECTURE = "### Architecture"


def _maps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("map"), F.col("value").alias("text"))


def _number(text: Column) -> Column:
    return F.when(text.rlike(r"^\d+$"), text.try_cast("bigint"))


def entry_tail(tail: Column) -> Column:
    """struct<description, token_estimate, density> of what follows a file's name; 0 tokens where it can't be read."""
    body = F.regexp_replace(tail, "^ (?:—|-) ", "")
    about, inside = (F.regexp_extract(body, r"^(.*)\(~(.*)$", i) for i in (1, 2))
    labelled = _number(F.btrim(F.regexp_extract(inside, "^(.*?) tok, ", 1)))
    plain = _number(F.btrim(F.regexp_extract(inside, r"^(.*?) tok\)", 1)))
    label = F.btrim(F.regexp_extract(inside, r"^.*? tok, (.*?)\)*$", 1))
    density = F.lit(None).cast("double")
    for name, value in LABEL_DENSITY.items():
        density = F.when(label == name, value).otherwise(density)
    tokens = F.coalesce(labelled, plain)
    return F.struct(
        F.btrim(F.when(tokens.isNull(), body).otherwise(about)).alias("description"),
        F.coalesce(tokens, F.lit(0)).alias("token_estimate"),
        F.when(labelled.isNotNull(), density).alias("density"),
    )


def parse(maps: DataFrame) -> DataFrame:
    """(map, path, description, token_estimate, density) of maps (map, text), in no order."""
    section = maps.select("map", F.explode(F.split("text", "(?md)^(?=## )")).alias("section"))
    folder = F.regexp_replace(F.regexp_extract("section", r"^## ([^\r\n]*)", 1), "/+$", "")
    placed = section.select("map", F.when(folder == ".", "").otherwise(folder).alias("folder"), F.explode(F.split("section", "\r?\n")).alias("line"))
    entries = placed.filter(F.col("line").rlike("^- `[^`]*`"))
    name, tail = (F.regexp_extract("line", "^- `([^`]*)`(.*)$", i) for i in (1, 2))
    path = F.when(F.col("folder") == "", name).otherwise(F.concat("folder", F.lit("/"), name))
    return entries.select("map", path.alias("path"), entry_tail(tail).alias("e")).select("map", "path", "e.*")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the maps that a path or pattern names."""
    return parse(_maps(spark, path))


def find(folder: str, path: str) -> dict | None:
    """One file's entry from the map in a folder, read by the driver line by line."""
    wanted, section = os.path.split(path), None
    try:
        with open(os.path.join(folder, NAME), encoding="utf-8") as f:
            for line in f:
                if line.startswith("## "):
                    section = line[3:].strip().rstrip("/")
                elif section == (wanted[0] or ".") and (m := re.match(r"- `([^`]*)`(?: (?:—|-) )?(.*)$", line)) and m[1] == wanted[1]:
                    tail = re.fullmatch(r"(.*)\(~(\d+) tok(?:, (\w+))?\)", m[2])
                    return {"path": path, "description": (tail[1] if tail else m[2]).strip(), "token_estimate": int(tail[2]) if tail else 0, "density": LABEL_DENSITY.get(tail[3]) if tail else None}
    except OSError:
        pass
    return None


def header(text: Column) -> Column:
    """struct<generated_at, file_count> from the first five lines; null if any part is malformed."""
    top = F.array_join(F.slice(F.split(text, "\n"), 1, 5), "\n")
    at, count = (F.regexp_extract(top, r"(?md)^<!-- Generated: (.*?) \| Files: (\d+) -->\r?$", i) for i in (1, 2))
    stamp = F.when(at.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)$"), at.try_cast("timestamp"))
    return F.when(stamp.isNotNull() & _number(count).isNotNull(), F.struct(stamp.alias("generated_at"), _number(count).alias("file_count")))


def headers(spark: SparkSession, path: str) -> DataFrame:
    return _maps(spark, path).select("map", header(F.col("text")).alias("h")).select("map", "h.*")


def lines(entries: DataFrame) -> DataFrame:
    """(folder, path, line), to be sorted by folder and path."""
    label = F.coalesce(F.concat(F.lit(", "), density_label(F.col("density"))), F.lit(""))
    line = F.concat(F.lit("- `"), F.regexp_extract("path", "([^/]*)$", 1), F.lit("` — "), F.coalesce("description", F.lit("")), F.lit(" (~"), F.col("token_estimate").cast("string"), F.lit(" tok"), label, F.lit(")"))
    return entries.select(directory(F.col("path")).alias("folder"), "path", line.alias("line"))


def atomic_write(path: str, parts) -> None:
    temporary = f"{path}.tmp"
    with open(temporary, "w", encoding="utf-8") as f:
        f.writelines(parts)
    os.replace(temporary, path)


def write(entries: DataFrame, folder: str, now: datetime | None = None) -> int:
    """Writes the map of entries into a folder; gives the number of files. Rows stream through the driver, one folder's part at a time."""
    count = entries.count()
    stamp = (now or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def text():
        yield f"# Source map\n\n<!-- Generated: {stamp} | Files: {count} -->\n"
        last = None
        for row in lines(entries).orderBy("folder", "path").toLocalIterator():
            if row.folder != last:
                yield f"\n## {row.folder}\n\n"
                last = row.folder
            yield f"{row.line}\n"

    atomic_write(os.path.join(folder, NAME), text())
    return count


def with_architecture(text: str, languages: str, hotspots: str = "") -> str:
    """The map's text with its architecture section replaced, or put before the first folder."""
    bare = re.sub(rf"^{ARCHITECTURE}\n(?:(?!## ).*\n?)*", "", text, flags=re.M)
    first = re.search(r"^## ", bare, re.M)
    before, after = (bare[: first.start()], bare[first.start() :]) if first else (bare, "")
    gap = "" if not before or before.endswith("\n\n") else "\n" if before.endswith("\n") else "\n\n"
    section = [ARCHITECTURE, f"- Languages: {languages}", *([f"- Hotspots: {hotspots}"] if hotspots else []), "", ""]
    return before + gap + "\n".join(section) + after
