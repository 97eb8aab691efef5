"""The usage event log: rollups, retention, first-edit sessions. Events: ts, event_kind, project_path, token_impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.scalars import bar

KINDS = ("session_start", "map_hit", "map_miss", "sketch_hit", "sketch_miss", "first_edit", "first_edit_turns", "arch_hit", "arch_miss")
UNSAVED = ("session_start", "first_edit", "first_edit_turns", "arch_hit")
"""Kinds whose impact is no saving."""


def saved(kind: Column, impact: Column) -> Column:
    return F.coalesce(F.sum(F.when(~kind.isin(*UNSAVED), impact)), F.lit(0))


def gain(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts per kind, hit rates, tokens saved and first-edit averages in one pass."""
    kind, impact = F.col("event_kind"), F.col("token_impact")
    counts = {k: F.count_if(kind == k) for k in KINDS}
    rate = lambda name: F.coalesce(F.try_divide(counts[f"{name}_hit"] * 100.0, counts[f"{name}_hit"] + counts[f"{name}_miss"]), F.lit(0.0)).alias(f"{name}_rate")
    return events.groupBy(*by).agg(
        F.count("*").alias("total_events"), *(c.alias(f"n_{k}") for k, c in counts.items()), rate("map"), rate("sketch"), rate("arch"), saved(kind, impact).alias("tokens_saved"),
        F.coalesce(F.avg(F.when(kind == "first_edit", impact)), F.lit(0.0)).alias("avg_first_edit"), F.coalesce(F.avg(F.when(kind == "first_edit_turns", impact)), F.lit(0.0)).alias("avg_first_edit_turns"),
    )


def daily(events: DataFrame, days: int = 30) -> DataFrame:
    out = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"), saved(F.col("event_kind"), F.col("token_impact")).alias("tokens_saved"))
    return out.orderBy(F.desc("day")).limit(days)


def daily_bars(events: DataFrame, days: int = 30, width: int = 12) -> DataFrame:
    """(day, events, tokens_saved, bar): the daily rollup, each day against the best of them. At most `days` rows."""
    out = daily(events, days)
    most = F.greatest(F.max("tokens_saved").over(W.partitionBy()), F.lit(1))
    return out.withColumn("bar", bar(F.greatest("tokens_saved", F.lit(0)) / most, width))


def append(events: DataFrame, path: str) -> None:
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def retained(events: DataFrame, cutoff: Column) -> DataFrame:
    return events.filter(F.col("ts") >= cutoff)


def first_edits(events: DataFrame) -> DataFrame:
    """Per project and session: start, first edit and events between them. Ordered by ts, then id.

    A project's log is cut into days, so that a busy project isn't one task: a day begins with the session that the
    last one before it with any start has left open, of which there is one row per project and day.
    """
    is_start = F.col("event_kind") == "session_start"
    placed = events.withColumn("day", F.to_date("ts"))
    days = placed.groupBy("project_path", "day").agg(F.max(F.when(is_start, F.col("ts"))).alias("last"))
    before = W.partitionBy("project_path").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    opened = days.select("project_path", "day", F.max("last").over(before).alias("opened"))
    run = W.partitionBy("project_path", "day").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.join(opened, ["project_path", "day"]).withColumn("session_start", F.coalesce(F.max(F.when(is_start, F.col("ts"))).over(run), "opened")).filter("session_start is not null")
    edits = placed.groupBy("project_path", "session_start").agg(F.min(F.when(F.col("event_kind") == "first_edit", F.col("ts"))).alias("first_edit")).filter("first_edit is not null")
    turns = placed.join(edits, ["project_path", "session_start"]).filter("ts > session_start and ts < first_edit").groupBy("project_path", "session_start").agg(F.count("*").alias("n"))
    return edits.join(turns, ["project_path", "session_start"], "left").select("project_path", "session_start", "first_edit", F.coalesce("n", F.lit(0)).alias("turns"))
