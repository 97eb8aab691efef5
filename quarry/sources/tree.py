"""A source tree as a table: path, size, mtime_ms and, in the content form, the text.

The walk skips hidden entries, a few fixed folders and what .gitignore files rule out. Executors read the files, so
the tree must be on a file system that they share.
"""

from __future__ import annotations

import os
import re
import shutil
import subprocess
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Folders that are never entered, and what counts as a source file.
SKIPPED = (".quarry", ".git", "node_modules", "__pycache__")
EXTENSIONS = "rs ts tsx js jsx mjs cjs py go rb java kt swift c cpp h hpp sh bash zsh fish json yaml yml toml xml ini conf cfg md mdx txt rst adoc html htm css scss sass less sql graphql gql tf tfvars hcl proto thrift avsc vue svelte lock".split()
NAMES = ("Makefile", "Dockerfile", "Justfile", "justfile", "Rakefile", "Gemfile", "Brewfile", ".gitignore", ".gitattributes", ".editorconfig", ".eslintrc", ".prettierrc", ".babelrc", "LICENSE", "CHANGELOG")


def scannable(path: Column) -> Column:
    name = F.regexp_extract(path, "([^/]*)$", 1)
    ext = F.regexp_extract(name, r".\.([^.]+)$", 1)
    return F.when(ext == "", name.isin(*NAMES)).otherwise(ext.isin(*EXTENSIONS))


def is_scannable(path: str) -> bool:
    """The same test for one path on the driver."""
    name = path.rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    return ext in EXTENSIONS if dot and stem else name in NAMES


def mappable(path: Column) -> Column:
    """Scannable and no part of the path is hidden."""
    return scannable(path) & ~F.exists(F.split(path, "/"), lambda part: F.startswith(part, F.lit(".")))


class Rule(NamedTuple):
    pattern: re.Pattern
    negated: bool
    folders_only: bool
    anchored: bool


def _as_regex(glob: str) -> str:
    """Git's glob: * and ? stay within a name, a whole part ** is any number of folders."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob[i:] == "**" and (i == 0 or glob[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (m := re.compile(r"\[(!?)(\]?[^]]*)\]").match(glob, i)):
            out, i = out + f"[{'^' if m[1] else ''}{m[2].replace(chr(92), chr(92) * 2)}]", m.end()
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def read_rules(path: str) -> list[Rule]:
    """The rules of an ignore file; none if it can't be read."""
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            lines = [x.rstrip("\r\n") for x in f]
    except OSError:
        return []
    out = []
    for x in lines:
        x = x if x.endswith("\\ ") else x.rstrip(" ")
        if x and not x.startswith("#"):
            negated, x = x.startswith("!"), x.removeprefix("!")
            body = x.rstrip("/")
            if body:
                out.append(Rule(re.compile(_as_regex(body.lstrip("/"))), negated, x.endswith("/"), "/" in body))
    return out


def _decision(own: list[Rule], path: str, is_dir: bool) -> bool | None:
    """What the last rule that fits says, if any does."""
    name = path.rsplit("/", 1)[-1]
    fits = [not r.negated for r in own if (is_dir or not r.folders_only) and r.pattern.fullmatch(path if r.anchored else name)]
    return fits[-1] if fits else None


def outer_rules(root: str) -> list[tuple[str, list[Rule]]]:
    """Rules from outside the tree: git's global file, the repository's exclude file, and .gitignore files above the root within the repository.

    Those above speak of paths from their folder; they are kept with the root's place below it.
    """
    settings = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    named = subprocess.run(["git", "config", "--path", "core.excludesFile"], cwd=root, capture_output=True, text=True, check=False) if shutil.which("git") else None
    wide = named.stdout.strip() if named and named.returncode == 0 and named.stdout.strip() else os.path.join(settings, "git", "ignore")
    above, at = [], os.path.abspath(root)
    while not os.path.exists(os.path.join(at, ".git")):
        parent = os.path.dirname(at)
        if parent == at:
            return [("", read_rules(wide))]
        at = parent
        above.append(at)
    top = os.path.abspath(root)
    placed = [(os.path.relpath(top, folder), read_rules(os.path.join(folder, ".gitignore"))) for folder in reversed(above)]
    whole = os.path.relpath(top, at)
    return [(whole, read_rules(wide)), (whole, read_rules(os.path.join(at, ".git", "info", "exclude"))), *placed]


def walk(root: str) -> list[str]:
    """Paths below root, relative, in byte order. Folders that can't be read are skipped."""
    out: list[str] = []
    outside = [(place, own) for place, own in outer_rules(root) if own]

    def ignored(rules: list, path: str, is_dir: bool) -> bool:
        """Narrower files decide before wider ones."""
        seen = [_decision(own, path if place in ("", ".") else f"{place}/{path}", is_dir) for place, own in outside]
        seen += [_decision(own, path[len(base) + 1 :] if base else path, is_dir) for base, own in rules]
        return next((x for x in reversed(seen) if x is not None), False)

    def enter(folder: str, rules: list) -> None:
        full = os.path.join(root, folder) if folder else root
        try:
            with os.scandir(full) as found:
                entries = list(found)
        except OSError:
            return
        rules = [*rules, (folder, read_rules(os.path.join(full, ".gitignore")))]
        for entry in entries:
            path = f"{folder}/{entry.name}" if folder else entry.name
            is_dir = entry.is_dir(follow_symlinks=False)
            if entry.name.startswith(".") or entry.name in SKIPPED or ignored(rules, path, is_dir):
                continue
            if is_dir:
                enter(path, rules)
            elif entry.is_file():
                out.append(path)

    enter("", [])
    return sorted(out, key=str.encode)


def count(spark: SparkSession, root: str) -> DataFrame:
    """(files): how many source files a tree has, by their names alone."""
    register(spark)
    return spark.read.format("srclisting").load(root).filter(scannable(F.col("path"))).agg(F.count("*").alias("files"))


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], content: bool) -> None:
        self.root, self.content, self.size = options["path"], content, int(options.get("filesPerPartition", "500"))

    def partitions(self) -> list[InputPartition]:
        found = walk(self.root)
        return [_Files(found[i : i + self.size]) for i in range(0, len(found), self.size)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                full = os.path.join(self.root, path)
                stat = os.stat(full)
                if self.content:
                    with open(full, encoding="utf-8") as f:
                        yield path, stat.st_size, int(stat.st_mtime * 1000), f.read()
                else:
                    yield path, stat.st_size, int(stat.st_mtime * 1000)
            except (OSError, UnicodeDecodeError):
                continue


class TreeListing(DataSource):
    """format("srclisting"): names and times; file contents aren't read."""

    @classmethod
    def name(cls) -> str:
        return "srclisting"

    def schema(self) -> str:
        return "path string, size bigint, mtime_ms bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, content=False)


class Tree(TreeListing):
    """format("srctree"): readable UTF-8 files with their content."""

    @classmethod
    def name(cls) -> str:
        return "srctree"

    def schema(self) -> str:
        return "path string, size bigint, mtime_ms bigint, content string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, content=True)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeListing)
    spark.dataSource.register(Tree)
