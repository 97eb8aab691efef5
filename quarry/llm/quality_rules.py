"""Quality rules: fixed limits, and robust multivariate outliers per language and source.

Each text gets four transformed statistics (log word length, and square roots of the shares of symbols, of
repeated lines and of repeated words beyond what its length explains). A minimum covariance determinant estimate is
made of all texts with words of each source in a language, of each language, and of the whole table: from three
starts, STEPS steps each concentrate on the HALF of the texts nearest to the centre; the start that ends with the
smallest determinant is refined on the texts within its 0.975 quantile. A source's estimate is then drawn to its
language's, and that to the table's, by how few texts it has: n texts count against PRIOR. Texts whose Mahalanobis
distance is over CUT go. Quantiles come from counted bins, so that every step is sums per group.

Null and empty texts have no words and fail the fixed limits. Repeated rows get the same result each; a null
language or source is a group of its own. Rows without doc_id are judged like others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.shared import keep_only, scratch, split_words, written

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
HALF, STEPS, PRIOR, CUT, NEAR = 0.75, 3, 200, 18.467, 11.143
"""CUT and NEAR are the 0.999 and 0.975 quantiles of chi-square with a degree of freedom per statistic."""
OF_HALF, OF_NEAR = 1.486, 1.0645
"""Makes the covariance of the part of a 4-dimensional normal within that quantile that of the whole."""
FLOORS = (0.064, 0.032, 0.204, 0.071)
"""Spread that any group is granted: what chance alone moves a statistic by in a text at the limit of 50 words. The
mean of 50 word lengths moves by 0.45 / sqrt(50); the root of a share of n things by 1 / (2 * sqrt(n)), where such a
text has about 250 characters, 6 lines and 50 words."""
DIMS = range(len(FLOORS))
PAIRS = [(i, j) for i in DIMS for j in range(i + 1)]
MEANS, SPREADS = [f"m{i}" for i in DIMS], [f"v{i}{j}" for i, j in PAIRS]
ALL = "*"
HARDLY = 60
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """BASE of column `text`, besides the columns `keep`. Rows stay whole: arrays live within one row."""
    words = docs.select(*keep, "text", split_words(F.col("text")).alias("w"))
    triple = F.transform("w", lambda w, i: F.xxhash64(w, F.get("w", i + 1), F.get("w", i + 2)))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    counted = words.select(
        *keep, F.size("w").cast("long").alias("n_words"), F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.when(F.size("w") >= 3, F.slice(triple, 1, F.size("w") - 2)).otherwise(F.array().cast("array<bigint>")).alias("h"), lines.alias("l"),
    )
    # only texts that repeat a triple sort theirs
    placed = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    counted = counted.select(*keep, *BASE[:3], (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), placed.alias("s"))
    twice = F.filter("s", lambda x, i: F.coalesce(F.get("s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s", i + 1)["h"] == x["h"], F.lit(False)))
    counted = counted.select(*keep, *BASE[:4], F.sort_array(F.transform(twice, lambda x: x["i"])).alias("p"))
    covers = F.transform("p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - p, F.lit(3))))
    return counted.select(*keep, *BASE[:4], F.coalesce(F.aggregate(covers, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"))


def statistics(words: Column, chars: Column, symbols: Column, dup_lines: Column, repeats: Column, half: float) -> list[Column]:
    """The transformed vector; long texts repeat more triples, so a text's share is held against its length. half: the length at which half of all words are in repeated triples."""
    n = F.greatest(words, F.lit(1)).cast("double")
    return [F.log(chars / n + 0.1), F.sqrt(symbols / F.greatest(chars, F.lit(1))), F.sqrt(F.least(dup_lines / (n / 10 + 1), F.lit(1.0))), F.sqrt(F.greatest(repeats / n - n / (n + half), F.lit(0.0)))]


def half_length(counts: DataFrame) -> float:
    """The length n at which a share of n / (n + half) repeated words is the median over all words of the table."""
    n, r = F.col("n_words"), F.col("n_repeat_words")
    bins = counts.filter("n_words > 0").groupBy(F.when(r > 0, F.floor(F.log2(n * (n - r + 1) / r) * 16)).otherwise(HARDLY * 16).alias("bin")).agg(F.sum("n_words").alias("words"))
    rows, gathered = sorted((r["bin"], r["words"]) for r in bins.collect()), 0
    total = sum(w for _, w in rows)
    for b, w in rows:
        gathered += w
        if 2 * gathered >= total:
            return 2.0 ** ((b + 1) / 16)
    return 2.0**HARDLY


def binned_quantile(df: DataFrame, by: tuple[str, ...], value: Column, share: float, name: str, per_unit: int) -> DataFrame:
    """(by, name): the upper edge of the bin in which the values of a group reach that share. A group has few bins, whatever its rows."""
    bins = df.select(*by, F.floor(value * per_unit).alias("bin")).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    up, all_of = W.partitionBy(*by).orderBy("bin"), W.partitionBy(*by)
    reached = bins.select(*by, "bin", (F.sum("n").over(up) >= share * F.sum("n").over(all_of)).alias("over")).filter("over")
    return reached.groupBy(*by).agg(((F.min("bin") + 1) / per_unit).alias(name))


def moments(df: DataFrame, by: tuple[str, ...], factor: float) -> DataFrame:
    """Per group: means m0.., covariances v00.. times the factor, and the number of rows."""
    sums = [F.avg(f"s{i}").alias(f"m{i}") for i in DIMS] + [F.avg(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"q{i}{j}") for i, j in PAIRS]
    out = df.groupBy(*by).agg(*sums, F.count("*").alias("n"))
    return out.select(*by, "n", *(f"m{i}" for i in DIMS), *(((F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * factor).alias(f"v{i}{j}") for i, j in PAIRS))


def factored(df: DataFrame) -> DataFrame:
    """The Cholesky factor c00.. of the covariances with the floors added, in their place."""
    out = df
    for i in DIMS:
        for j in range(i + 1):
            cov = F.col(f"v{i}{j}") + (FLOORS[i] ** 2 if i == j else 0)
            rest = reduce(lambda a, k: a - F.col(f"c{i}{k}") * F.col(f"c{j}{k}"), range(j), cov)  # noqa: B023
            out = out.withColumn(f"c{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 / 4))) if i == j else rest / F.col(f"c{j}{j}"))
    return out.drop(*SPREADS)


def with_distance(df: DataFrame, estimate: DataFrame) -> DataFrame:
    """df with its squared Mahalanobis distance d from the estimate of its group, or from each of several."""
    out, columns = df.join(estimate, "g", "left"), [*df.columns, *(c for c in ("start",) if c in estimate.columns)]
    for i in DIMS:
        out = out.withColumn(f"y{i}", reduce(lambda a, k: a - F.col(f"c{i}{k}") * F.col(f"y{k}"), range(i), F.col(f"s{i}") - F.col(f"m{i}")) / F.col(f"c{i}{i}"))  # noqa: B023
    return out.select(*columns, reduce(lambda a, b: a + b, (F.col(f"y{i}") * F.col(f"y{i}") for i in DIMS)).alias("d"))


def starts(vectors: DataFrame, folder: str) -> DataFrame:
    """(g, start, m.., v..): medians with a little spread, medians with that of the deviations from them, and plain moments."""
    medians = reduce(lambda a, i: a.join(binned_quantile(vectors, ("g",), F.col(f"s{i}"), 0.5, f"m{i}", 512), "g"), list(DIMS)[1:], binned_quantile(vectors, ("g",), F.col("s0"), 0.5, "m0", 512))
    medians = written(medians, folder, "medians")
    off = vectors.join(medians, "g")
    spread = reduce(lambda a, i: a.join(binned_quantile(off, ("g",), F.abs(F.col(f"s{i}") - F.col(f"m{i}")), 0.5, f"d{i}", 512), "g"), DIMS, medians)
    diagonal = lambda at, k: [(at(i) if i == j else F.lit(0.0)).alias(f"v{i}{j}") for i, j in PAIRS] + [F.lit(k).alias("start")]
    tight = spread.select("g", *MEANS, *diagonal(lambda i: F.lit(8 * FLOORS[i] ** 2), 0))
    wide = spread.select("g", *MEANS, *diagonal(lambda i: (1.4826 * F.col(f"d{i}")) ** 2, 1))
    plain = moments(vectors, ("g",), 1.0).withColumn("start", F.lit(2))
    return tight.unionByName(wide).unionByName(plain.select(tight.columns))


def estimates(vectors: DataFrame, folder: str, steps: int = STEPS) -> DataFrame:
    """(g, n, m.., v..): the refined minimum covariance determinant estimate of each group, and its number of rows.

    What the vectors are joined with is a table of its own, so that the planner broadcasts it by its size and no hot
    group meets in one task.
    """
    estimate = written(factored(starts(vectors, folder)), folder, "estimate0")
    for step in range(1, steps + 1):
        near = with_distance(vectors, estimate)
        log = F.log2(F.col("d") + 1e-6)
        edge = written(binned_quantile(near, ("g", "start"), log, HALF, "edge", 64), folder, f"edge{step}")
        estimate = written(factored(moments(near.join(edge, ["g", "start"]).filter(log <= F.col("edge")), ("g", "start"), OF_HALF)), folder, f"estimate{step}")
    size = reduce(lambda a, b: a * b, (F.col(f"c{i}{i}") for i in DIMS))
    best = estimate.groupBy("g").agg(F.min_by(F.struct(*estimate.columns), F.struct(F.round(F.log2(size), 9), "start")).alias("e")).select("e.*").drop("start", "n")
    best = written(best, folder, "best")
    near = with_distance(vectors, best).filter(F.col("d") <= NEAR)
    return written(moments(near, ("g",), OF_NEAR).drop("n").join(vectors.groupBy("g").agg(F.count("*").alias("n")), "g"), folder, "estimates")


def drawn(own: DataFrame, above: DataFrame, up: str) -> DataFrame:
    """(g, m.., v..): estimates of groups drawn to that of the group above (column `up`), the more the fewer rows they have."""
    w = F.coalesce("n", F.lit(0)) / (F.coalesce("n", F.lit(0)) + PRIOR)
    other = above.select(F.col("g").alias(up), *(F.col(c).alias(f"up_{c}") for c in (*MEANS, *SPREADS)))
    return own.join(other, up, "left").select("g", *(F.coalesce(w * F.col(c) + (1 - w) * F.col(f"up_{c}"), F.col(f"up_{c}")).alias(c) for c in (*MEANS, *SPREADS)))


def judge(docs: DataFrame, cut: float = CUT, steps: int = STEPS) -> DataFrame:
    """Per document: doc_id, BASE, base_failed, kept, distance (squared)."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text("text").alias("text"))
    of_lang, own = F.to_json(F.struct("lang")), F.to_json(F.struct("lang", "source", F.lit(0).alias("own")))
    counts = written(base_counts(docs, ["doc_id", "lang", "source"]).select("doc_id", of_lang.alias("of_lang"), own.alias("g"), *BASE), folder, "counts")
    rows = counts.select("doc_id", "of_lang", "g", *BASE, *(s.alias(f"s{i}") for i, s in enumerate(statistics(*map(F.col, BASE), half_length(counts)))))
    vectors = rows.filter("n_words > 0").select(F.explode(F.array("g", "of_lang", F.lit(ALL))).alias("g"), *(f"s{i}" for i in DIMS))
    found = estimates(vectors, folder, steps)
    groups = rows.select("g", "of_lang").distinct()
    table = found.filter(F.col("g") == ALL).drop("n")
    langs = groups.select(F.col("of_lang").alias("g"), F.lit(ALL).alias("all")).distinct().join(found, "g", "left")
    langs = drawn(langs, table, "all")
    sources = drawn(groups.join(found, "g", "left"), langs, "of_lang")
    estimate = written(factored(sources), folder, "drawn")
    keep_only(spark, folder, "counts", "drawn")
    out = with_distance(rows, estimate)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.coalesce("d", F.lit(0.0)) <= cut)
    return out.select("doc_id", *BASE, failed.alias("base_failed"), kept.alias("kept"), F.col("d").alias("distance"))
