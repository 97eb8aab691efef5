"""Changes known to git: the driver runs git; diffs of any number are read as columns, file section by file section."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalars import hunk_range

_RANGES = r"^@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@"


class GitError(RuntimeError):
    pass


def _git(root: str, *args: str) -> str | None:
    done = subprocess.run(["git", *args], cwd=root, capture_output=True, text=True, errors="replace", check=False)
    return done.stdout if done.returncode == 0 else None


def default_branch(root: str) -> str:
    """What origin/HEAD names, else the first of the usual branches that exists."""
    if named := (_git(root, "symbolic-ref", "--short", "refs/remotes/origin/HEAD") or "").strip():
        return named
    configured = (_git(root, "config", "init.defaultBranch") or "").strip()
    for ref in ("origin/main", "origin/master", configured, "main", "master"):
        if ref and not ref.startswith("-") and _git(root, "rev-parse", "--verify", "--quiet", ref) is not None:
            return ref
    raise GitError("no default branch found; name one with --base")


def diff_base(root: str, base: str | None = None) -> str | None:
    """The ref to compare with: the given one, none for a tree with uncommitted changes, else the default branch."""
    if base is not None:
        if base.startswith("-"):
            raise GitError(f"not a ref: {base}")
        return base
    return None if (_git(root, "status", "--porcelain") or "").strip() else default_branch(root)


def diff(root: str, base: str | None) -> str:
    found = _git(root, "diff", "--unified=0", "--no-color", "--no-ext-diff", f"{base}...HEAD" if base else "HEAD", "--")
    if found is None:
        raise GitError("git diff failed")
    return found


def untracked(root: str) -> list[str]:
    return sorted((_git(root, "ls-files", "--others", "--exclude-standard") or "").splitlines())


def last_commit_s(root: str) -> int | None:
    stamp = (_git(root, "log", "-1", "--format=%ct") or "").strip()
    return int(stamp) if stamp.isdigit() else None


def is_repository(root: str) -> bool:
    return os.path.exists(os.path.join(root, ".git"))


def old_range(header: Column) -> Column:
    """struct<start, end> of a hunk's old side, null without lines."""
    start, count = F.regexp_extract(header, _RANGES, 1).try_cast("bigint"), F.regexp_extract(header, _RANGES, 2)
    n = F.when(count == "", 1).otherwise(count.try_cast("bigint"))
    return F.when(n > 0, F.struct(start.alias("start"), (start + n - 1).alias("end")))


def hunks(diffs: DataFrame, text_col: str = "diff", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., file_path, start, end) of unified diffs.

    A file's section starts where a --- line is followed by a +++ line. Deleted files keep their old path, renamed
    ones give both: new lines under the new path, old lines under the old one. Null and empty diffs give no rows.
    """
    sections = diffs.select(*keep, F.explode(F.split(F.col(text_col), r"(?md)^(?=--- (?:a/|/dev/null)[^\n]*\n\+\+\+ )")).alias("section"))
    old = F.regexp_extract("section", r"^--- a/([^\r\n]*)", 1)
    new = F.regexp_extract("section", r"^--- [^\n]*\n\+\+\+ b/([^\r\n]*)", 1)
    headers = F.regexp_extract_all("section", F.lit(r"(?md)^(@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)"), F.lit(1))
    side = lambda path, ranges: F.transform(ranges, lambda r: F.struct(path.alias("file_path"), r["start"].alias("start"), r["end"].alias("end")))
    present = F.transform(headers, hunk_range)
    moved = (old != "") & (new != "") & (old != new)
    former = F.when(moved, F.transform(headers, old_range)).otherwise(F.slice(F.transform(headers, old_range), 1, 0))
    rows = F.concat(side(F.when(new == "", old).otherwise(new), present), side(old, former))
    return sections.select(*keep, F.explode(rows).alias("h")).select(*keep, "h.*").filter("start is not null and file_path <> ''")
