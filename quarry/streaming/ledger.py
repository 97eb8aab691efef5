"""The usage log as a stream: daily rollups with late events, kept up by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.ledger import saved
from quarry.sources.events import SCHEMA


def read(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Event files (JSON lines) as they arrive."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").json(path)


def daily(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, project_path, events, tokens_saved); state of days older than the watermark is dropped."""
    day = F.window("ts", "1 day")
    out = events.withWatermark("ts", late).groupBy(day.alias("w"), "project_path").agg(F.count("*").alias("events"), saved(F.col("event_kind"), F.col("token_impact")).alias("tokens_saved"))
    return out.select(F.to_date("w.start").alias("day"), "project_path", "events", "tokens_saved")


def start(rollup: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Closed days as Parquet, each once, by what the checkpoint says is done."""
    return rollup.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
