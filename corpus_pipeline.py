"""A corpus run: five stages, each over all that the one before kept.

Quality, near-duplicates and decontamination remove rows; personal data is replaced by its kind in brackets; packing
returns where each piece goes, with its token ids. Every stage judges rows, not ids: rows without an id, and rows
that share one, go or stay by their own text. Of equal rows the near-duplicate stage keeps one. Null and empty texts
are judged like any other by quality, have no duplicates and no contamination, and are packed as the end token alone.
Empty tables give empty results. Columns of documents beyond doc_id and text go along untouched, whatever their names;
only n_chars follows the text. A stage's own tables, and what it read, are deleted once its result is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, near_dedup, packing, pii, quality
from quarry.llm.shared import cleared, dropped, scratch, table, written

SHINGLE, PERCENT = 5, 80
ORACLE_SQL = None
"""The stages train models and pack, which SQL can't express; tests hold the rows against brute force."""


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.score(docs, table(spark, sf_dir, "labels"), keep=tuple(docs.columns))
    return judged.filter("predicted = 1").select("input.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.firsts(docs, SHINGLE, PERCENT)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    checked = decontaminate.check(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns))
    return checked.filter("not contaminated").select("input.*")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.find(docs, keep=tuple(docs.columns))
    text = pii.redacted(F.col("input.text"), F.col("found"))
    new = {"text": text, "n_chars": F.length(text)}
    return found.select(*((new[f.name].cast(f.dataType) if f.name in new else F.col("input")[f.name]).alias(f.name) for f in docs.schema))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder, last = table(spark, sf_dir, "documents"), scratch(spark), None
    for name, stage in STAGES:
        with cleared(spark):
            docs = written(stage(spark, docs, sf_dir), folder, name)
        if last:
            dropped(spark, f"{folder}/{last}")
        last = name
    return docs.drop("ids")
