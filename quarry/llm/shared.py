"""Scratch tables and column expressions that the operators share."""

from __future__ import annotations

import contextlib
import string
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What `words` splits at, and the ASCII-only words that decontamination compares.
SPACE = "[ \\x09-\\x0D]+"
NOT_ALNUM = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


#: Else shuffle files stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_folders: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    _folders.append(f"{base.rstrip('/')}/quarry-{uuid.uuid4().hex}")
    return _folders[-1]


@contextlib.contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes the folders that are made inside: what comes out must be written elsewhere by then."""
    before = len(_folders)
    try:
        yield
    finally:
        for folder in _folders[before:]:
            dropped(spark, folder)
        del _folders[before:]


def keep_only(spark: SparkSession, folder: str, *names: str) -> None:
    """Deletes a folder's tables but those named, once nothing that is still to run reads them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
        if status.getPath().getName() not in names:
            dropped(spark, status.getPath().toString())


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a table of the shared folder: cuts lineage, survives lost executors. What was shuffled for it is deleted once it is there."""
    path, conf = f"{folder}/{name}", df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, folder: str, name: str = "rows") -> DataFrame:
    """docs as a table with a number `row` each, which stays the same however often the table is read."""
    return written(docs.withColumn("row", F.monotonically_increasing_id()), folder, name)


BLOCK = 64


def marked(rows: DataFrame, some: DataFrame) -> DataFrame:
    """rows with the boolean `marked`: whether `some` has their number. A bit a row is looked up, so that rows needn't be dealt out by number."""
    block, bit = F.floor(F.col("row") / BLOCK), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("row", F.lit(BLOCK)).cast("int"))
    bits = written(some.groupBy(block.alias("block")).agg(F.bit_or(bit).alias("bits")), scratch(rows.sparkSession), "bits")
    return rows.withColumn("block", block).join(bits, "block", "left").withColumn("marked", F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))).drop("block", "bits")


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def split_words(text: Column, separators: str = SPACE) -> Column:
    """Words between runs of separators; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
