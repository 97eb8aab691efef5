"""The JSON that editors send and get, as columns: for logs of it, and what hooks.py does for one object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def payload(text: Column) -> Column:
    """struct<cwd, file_path> of what an editor sends; null where a field is missing or the JSON is broken."""
    return F.struct(F.get_json_object(text, "$.cwd").alias("cwd"), F.get_json_object(text, "$.tool_input.file_path").alias("file_path"))


def answer(event: str, context: Column, permission: Column) -> Column:
    """What goes back: without a permission where it is null, without a context where it is empty."""
    inner = F.struct(F.lit(event).alias("hookEventName"), permission.alias("permissionDecision"), F.nullif(context, F.lit("")).alias("additionalContext"))
    return F.to_json(F.struct(inner.alias("hookSpecificOutput")))
