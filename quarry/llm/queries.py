"""One query per operator, over its whole table; its SQL where DuckDB can run it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str):
    def put(f):
        QUERIES[name] = f
        return f

    return put


@_query("op9_substring_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=50, with_text=False)


@_query("op3_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.near_dedup import link

    return link(table(spark, sf_dir, "documents"), shingle=4, percent=80)


@_query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.packing import pack

    return pack(table(spark, sf_dir, "documents")).drop("ids")


@_query("op2_lm_score")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.lm_score import score

    return score(table(spark, sf_dir, "documents"))


@_query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.secrets import find

    return find(table(spark, sf_dir, "documents")).drop("found")


@_query("op7_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.pii import find

    return find(table(spark, sf_dir, "documents")).drop("found")


@_query("op4_decontaminate")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.decontaminate import check

    return check(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "hits")


@_query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"))


@_query("op1_url_filter")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"))
