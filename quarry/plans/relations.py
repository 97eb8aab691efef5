"""The driver's tables seen as files, symbols, imports, hunks, events and snapshots, for Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark, d):
    ext = F.when(F.col("lang") == "en", "md").when(F.col("lang") == "de", "json").when(F.col("lang") == "es", "rs").otherwise("py")
    path = F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return table(spark, d, "documents").select("doc_id", path.alias("path"), ext.alias("ext"), "text", "lang", "n_chars")


FILES = "(select doc_id, lang || '/' || source || '/' || doc_id || '.' || ext as path, ext, text, lang, n_chars from (select *, case lang when 'en' then 'md' when 'de' then 'json' when 'es' then 'rs' else 'py' end as ext from documents))"


def symbols(spark, d):
    kinds = F.element_at(F.array(*map(F.lit, ("fn", "struct", "const", "let", "other"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("name"), F.concat(F.lit("s"), (F.col("p_partkey") % 7).cast("string")).alias("file_path"), kinds.alias("kind"), F.col("p_name").alias("signature"),
        F.col("p_size").cast("bigint").alias("line_start"), (F.col("p_size") + F.col("p_partkey") % 7).cast("bigint").alias("line_end"), (F.col("p_partkey") % 2 == 0).alias("exported"),
    )


SYMBOLS = "(select p_partkey::varchar as name, 's' || (p_partkey % 7) as file_path, case p_partkey % 5 when 0 then 'fn' when 1 then 'struct' when 2 then 'const' when 3 then 'let' else 'other' end as kind, p_name as signature, p_size::bigint as line_start, (p_size + p_partkey % 7)::bigint as line_end, p_partkey % 2 = 0 as exported from part)"


def imports(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 1000).cast("string").alias("source_file"), F.col("l_partkey").cast("string").alias("imported_name"), F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")).alias("target_path"), F.col("l_linenumber").cast("bigint").alias("line_number"))


IMPORTS = "(select (l_orderkey % 1000)::varchar as source_file, l_partkey::varchar as imported_name, 's' || (l_suppkey % 7) as target_path, l_linenumber::bigint as line_number from lineitem)"


def hunks(spark, d):
    return table(spark, d, "supplier").select(F.concat(F.lit("s"), (F.col("s_suppkey") % 7).cast("string")).alias("file_path"), F.col("s_nationkey").cast("bigint").alias("start"), (F.col("s_nationkey") + 3).cast("bigint").alias("end"))


HUNKS = "(select 's' || (s_suppkey % 7) as file_path, s_nationkey::bigint as lo, (s_nationkey + 3)::bigint as hi from supplier)"


def events(spark, d):
    kind = F.when(F.col("event_type") == "click", "map_hit").when(F.col("event_type") == "error", "map_miss").when(F.col("event_type") == "view", "sketch_hit").when(F.col("event_type") == "signup", "session_start").otherwise("first_edit")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", kind.alias("event_kind"), F.col("user_id").cast("string").alias("project_path"), F.floor("value").cast("bigint").alias("token_impact"))


EVENTS = "(select event_id as id, ts, case event_type when 'click' then 'map_hit' when 'error' then 'map_miss' when 'view' then 'sketch_hit' when 'signup' then 'session_start' else 'first_edit' end as event_kind, user_id::varchar as project_path, floor(value)::bigint as token_impact from events)"


def snapshot(spark, d, stored: bool):
    key = F.col("o_orderkey")
    changed = F.when(key % 5 == 0, 1).otherwise(0) if stored else F.lit(0)
    rows = table(spark, d, "orders").filter(key % 10 != (7 if stored else 3))
    return rows.select(key.cast("string").alias("path"), F.col("o_orderpriority").alias("description"), (F.col("o_custkey") + changed).cast("bigint").alias("token_estimate"), F.when(key % 3 == 0, key + changed).cast("bigint").alias("content_hash"), (key * 10 + changed).cast("bigint").alias("mtime_ms"))


def _snapshot_sql(skip: int, changed: str) -> str:
    return f"(select o_orderkey::varchar as path, o_orderpriority as description, (o_custkey + {changed})::bigint as token_estimate, (case when o_orderkey % 3 = 0 then o_orderkey + {changed} end)::bigint as content_hash, (o_orderkey * 10 + {changed})::bigint as mtime_ms from orders where o_orderkey % 10 <> {skip})"


CURRENT, STORED = _snapshot_sql(3, "0"), _snapshot_sql(7, "(case when o_orderkey % 5 = 0 then 1 else 0 end)")
