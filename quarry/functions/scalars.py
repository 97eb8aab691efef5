"""Scalar functions as columns; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens per byte by kind of file, and display names of extensions.
PROSE = ("md", "txt", "rst", "adoc")
DATA = ("json", "yaml", "yml", "toml", "xml")
LANGUAGES = {
    "rs": "Rust", "py": "Python", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "jsx": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript",
    "go": "Go", "java": "Java", "kt": "Kotlin", "rb": "Ruby", "c": "C", "h": "C", "cpp": "C++", "hpp": "C++", "cs": "C#", "swift": "Swift", "sh": "Shell",
    "md": "Markdown", "json": "JSON", "yaml": "YAML", "yml": "YAML", "toml": "TOML", "html": "HTML", "css": "CSS", "sql": "SQL",
}


def extension(path: Column) -> Column:
    """The part after the last dot of the file name, or empty."""
    return F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1)


def directory(path: Column) -> Column:
    """What stands before the last slash; . without one."""
    found = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(found == "", ".").otherwise(found)


def language(ext: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.when(ext == "", "other").otherwise(F.coalesce(F.try_element_at(known, ext), ext))


def estimate_tokens(text: Column, ext: Column) -> Column:
    ratio = F.when(ext.isin(*PROSE), 4.0).when(ext.isin(*DATA), 3.75).otherwise(3.5)
    return F.ceil(F.octet_length(text) / ratio)


def density_label(density: Column) -> Column:
    return F.when(density < 0.15, "repetitive").when(density >= 0.5, "dense")


def classify_risk(importers: Column) -> Column:
    return F.when(importers >= 10, "CRITICAL").when(importers >= 5, "HIGH").when(importers >= 2, "MEDIUM").otherwise("LOW")


def kind_weight(kind: Column) -> Column:
    return F.when(kind.isin("fn", "method", "struct", "enum", "trait", "class", "type", "interface"), 2).when(kind.isin("const", "static", "var", "let"), 1).otherwise(0)


def _one_decimal(x: Column) -> Column:
    return F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))


def format_tokens(n: Column) -> Column:
    return F.when(F.abs(n) >= 999_950, F.concat(_one_decimal(n / 1e6), F.lit("M"))).when(F.abs(n) >= 1000, F.concat(_one_decimal(n / 1e3), F.lit("K"))).otherwise(n.cast("string"))


def format_duration(seconds: Column) -> Column:
    s = F.round(seconds).cast("bigint")
    rest = F.when(s % 60 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), (s % 60).cast("string"), F.lit("s")))
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m"), rest))


def bar(ratio: Column, width: int = 10) -> Column:
    full = F.round(F.greatest(F.least(ratio, F.lit(1.0)), F.lit(0.0)) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def rate_color(rate: Column) -> Column:
    return F.when(rate >= 75, "green").when(rate >= 50, "yellow").otherwise("red")


def hunk_range(header: Column) -> Column:
    """struct<start, end> of a diff hunk: the new side, the old side of a pure deletion, null without lines."""
    part = lambda i: F.regexp_extract(header, r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", i)
    number = lambda i, empty: F.when(part(i) == "", empty).otherwise(part(i).try_cast("bigint"))
    old, old_n, new, new_n = number(1, None), number(2, 1), number(3, None), number(4, 1)
    one = lambda a, n: F.struct(a.alias("start"), (a + n - 1).alias("end"))
    return F.when(new_n > 0, one(new, new_n)).when(old_n > 0, one(old, old_n))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unquote(text: Column) -> Column:
    return F.btrim(text, F.lit("\"'`"))
