"""Snapshots of a tree: what changed, and single-row changes of the index. files: path, description, token_estimate, content_hash, mtime_ms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, change): added, removed or modified."""
    c, s = (df.select("path", F.struct("description", "token_estimate", "content_hash").alias(n)) for df, n in ((current, "c"), (stored, "s")))
    hashed = F.col("c.content_hash").isNotNull() & F.col("s.content_hash").isNotNull()
    told = ~F.col("c.description").eqNullSafe(F.col("s.description")) | ~F.col("c.token_estimate").eqNullSafe(F.col("s.token_estimate"))
    other = F.when(hashed, F.col("c.content_hash") != F.col("s.content_hash")).otherwise(told)
    change = F.when(F.col("s").isNull(), "added").when(F.col("c").isNull(), "removed").when(other, "modified")
    return c.join(s, "path", "full_outer").select("path", change.alias("change")).filter("change is not null")


def staleness(current: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: added, removed, modified and the report text."""
    counts = differences(current, stored).agg(*(F.count_if(F.col("change") == k).alias(k) for k in ("added", "removed", "modified")))
    part = lambda k: F.when(F.col(k) > 0, F.concat(F.col(k).cast("string"), F.lit(f" {k}")))
    text = F.concat_ws(", ", part("added"), part("removed"), part("modified"))
    return counts.withColumn("report", F.when(text == "", "up to date").otherwise(text))


def mtime_drift(current: DataFrame, stored: DataFrame) -> DataFrame:
    c, s = current.select("path", F.col("mtime_ms").alias("now")), stored_mtimes(stored).withColumnRenamed("mtime_ms", "before")
    return c.join(s, "path", "full_outer").filter("not (now <=> before)").select("path", "now", "before")


def upsert(stored: DataFrame, changed: DataFrame) -> DataFrame:
    return stored.join(changed, "path", "left_anti").unionByName(changed)


def delete(stored: DataFrame, paths: DataFrame) -> DataFrame:
    return stored.join(paths, "path", "left_anti")


def enrich(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    known = stored.select("path", F.col("content_hash").alias("h"), F.col("mtime_ms").alias("m"))
    return parsed.join(known, "path", "left").withColumns({"content_hash": F.coalesce("h", "content_hash"), "mtime_ms": F.coalesce("m", "mtime_ms")}).drop("h", "m")


def stored_mtimes(stored: DataFrame) -> DataFrame:
    return stored.select("path", "mtime_ms").filter("mtime_ms is not null")
