"""The usage log on disk: JSON lines, one file a day, appended by the driver and read by Spark in batch or as a stream."""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id bigint, ts timestamp, event_kind string, project_path string, token_impact bigint"
RETENTION_DAYS = 90


def folder() -> str:
    return os.environ.get("QUARRY_LEDGER") or os.path.expanduser("~/.local/share/quarry/ledger")


def record(kind: str, project: str, impact: int = 0, at: datetime | None = None) -> None:
    """Appends one event; a log that can't be written is no error for the caller."""
    at = at or datetime.now(UTC)
    row = {"id": uuid.uuid4().int >> 65, "ts": at.strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "event_kind": kind, "project_path": project, "token_impact": impact}
    with contextlib.suppress(OSError):
        os.makedirs(folder(), exist_ok=True)
        with open(os.path.join(folder(), f"{at:%Y-%m-%d}.jsonl"), "a", encoding="utf-8") as f:
            f.write(json.dumps(row) + "\n")


def read(spark: SparkSession, project: str | None = None, days: int = RETENTION_DAYS) -> DataFrame:
    """Events within the retention time, of one project or all."""
    path = folder()
    found = spark.read.schema(SCHEMA).json(path) if os.path.isdir(path) else spark.createDataFrame([], SCHEMA)
    kept = found.filter(F.col("ts") >= F.lit(datetime.now(UTC) - timedelta(days=days)))
    return kept if project is None else kept.filter(F.col("project_path") == project)


def purge(days: int = RETENTION_DAYS) -> int:
    """Deletes the files of days that are wholly past the retention time; read leaves out the rest of the last day."""
    cutoff, gone = (datetime.now(UTC) - timedelta(days=days)).date().isoformat(), 0
    with contextlib.suppress(OSError):
        for name in os.listdir(folder()):
            if name.endswith(".jsonl") and name.removesuffix(".jsonl") < cutoff:
                os.remove(os.path.join(folder(), name))
                gone += 1
    return gone
