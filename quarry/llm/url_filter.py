"""URL filters: host and path rules, and boosted trees on lexical features for the urls that no rule fits.

Trees are learned from labelled urls. By default these are SAMPLES generated ones of either label (see
labelled_urls), as the rules speak of hosts and not of how a url looks: plain site, article and shop addresses
against hosts made of joined keywords, random characters or numbers, tracking chains and session ids. At most
TRAIN_ROWS labelled rows of smallest hash go to the driver, both labels weigh alike, and the trees come back as one
column expression. The statistic of a host's suffix is its smoothed share of blocked urls among the labelled rows;
for a row that is learned from, among those of the other folds.

A null url, or one without ://, has an empty host and path; no rule fits it and it is allowed. Repeated rows are
judged each, also without page_id. Without labelled urls of both verdicts, every url without a rule is allowed.
"""

from __future__ import annotations

import random
import string
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import lower_ascii, scratch, written

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
TRAIN_ROWS, SAMPLES, FOLDS, TREES, DEPTH, RATE, BINS, RIDGE = 20_000, 3000, 5, 40, 3, 0.2, 32, 1.0
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "longest_label", "digits", "host_digits", "hyphens", "entropy", "parameters", "query_length", "fragment", "secure", "suffix_share", "suffix_seen")
_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789-_./?&=%#:"


def labelled_urls(n: int = SAMPLES, seed: int = 7) -> list[tuple[str, int]]:
    """(url, blocked): n generated urls of either label, the same for the same seed."""
    r = random.Random(seed)
    syllable = lambda: r.choice("ba be co da di en fa ga ho in ka la lo ma mi na no or pa ra re ri sa se so ta te th ti to un va we wi".split())
    word = lambda a=2, b=4: "".join(syllable() for _ in range(r.randint(a, b)))
    key = lambda letters, a, b: "".join(r.choice(letters) for _ in range(r.randint(a, b)))
    end = lambda: r.choice("com org net info de fr es eu io".split())
    scheme = lambda: r.choice(["https://", "http://"])
    tail = lambda: r.choice(["", "/", ".html", "#top", f"?page={r.randint(1, 40)}", f"?page={r.randint(1, 9)}&ref={key(string.ascii_lowercase, 1, 6)}", f"?utm_source={word()}", f"?id={r.randint(1, 99999)}"])
    site = lambda: r.choice(["", "www.", "m.", "blog.", "news.", "shop."]) + word(2, 5) + r.choice(["", "", "." + word(2, 3)]) + "." + end()
    lure = "casino bonus win free bets cheap pills loans poker slots deal cash prize lucky vip sex cams crypto gift best buy now".split()
    good = (
        lambda: f"{site()}/{r.choice(['en', 'de', 'fr', 'es'])}/{r.randint(1, 99999)}{tail()}", lambda: f"{site()}/{word()}/{word()}{tail()}", lambda: f"{site()}/{r.randint(1999, 2030)}/{r.randint(1, 12):02}/{'-'.join(word() for _ in range(r.randint(2, 6)))}{tail()}",
        lambda: f"{site()}{tail() if r.random() < 0.5 else '/'}", lambda: f"{site()}/wiki/{word().title()}_{word()}", lambda: f"{word()}-{word()}.{end()}/{word()}{tail()}", lambda: f"{site()}/{word()}/{r.randint(1, 999)}/{word()}.{r.choice(['jpg', 'pdf', 'png'])}",
    )
    ids = string.ascii_lowercase + string.digits
    bad = (
        lambda: f"{r.choice(['', 'www.', 'm.'])}{'-'.join(r.sample(lure, r.randint(2, 4)))}{r.choice(['', str(r.randint(1, 999))])}.{r.choice(['', word() + '.'])}{end()}/{r.choice(['en', 'go', 'x'])}/{r.randint(1, 99999)}{tail()}",
        lambda: f"{key(ids, 14, 30)}.{end()}/{key(ids, 4, 12)}", lambda: f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(1, 255)}/{key(ids, 3, 20)}{r.choice(['', '.exe', '.php'])}",
        lambda: f"{site()}/{word()}?{'&'.join(f'{key(string.ascii_lowercase, 1, 5)}={key(ids, 8, 30)}' for _ in range(r.randint(4, 12)))}", lambda: f"{site()}/{'/'.join(key(ids, 8, 20) for _ in range(r.randint(3, 8)))}",
        lambda: f"{'.'.join(word() for _ in range(r.randint(4, 7)))}.{r.choice(['top', 'xyz', 'click', end()])}/{key(ids, 4, 20)}", lambda: f"{'-'.join(r.sample(lure, 3))}.{r.choice(['top', 'xyz', 'click', 'win'])}{tail()}",
    )
    return [(scheme() + r.choice(good)(), 0) for _ in range(n)] + [(scheme() + r.choice(bad)(), 1) for _ in range(n)]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    return lower_ascii(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or null. A rule fits its host and the hosts below it."""
    rule = verdict = F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    low = F.lower(url)
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    counts = [F.length(low) - F.length(F.translate(low, c, "")) for c in _CHARACTERS]
    terms = [F.when(c > 0, -c / n * F.log2(c / n)).otherwise(0.0) for c in counts]
    query = F.regexp_extract(url, "(?s)\\?([^#]*)", 1)
    return {
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "depth": F.regexp_count(path, F.lit("/[^/]")),
        "labels": F.size(F.split(host, "\\.")), "longest_label": F.array_max(F.transform(F.split(host, "\\."), F.length)), "digits": _share(url, "[0-9]"), "host_digits": _share(host, "[0-9]"),
        "hyphens": F.regexp_count(host, F.lit("-")), "entropy": reduce(lambda a, b: a + b, terms), "parameters": F.when(query != "", F.regexp_count(query, F.lit("&")) + 1).otherwise(0),
        "query_length": F.length(query), "fragment": F.contains(url, F.lit("#")).cast("int"), "secure": F.startswith(low, F.lit("https:")).cast("int"),
    }


class Tree:
    """A regression tree of fixed depth over binned features, grown level by level from sums per bin."""

    def __init__(self, bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int) -> None:
        self.split = self.left = self.right = None
        self.value = RATE * g.sum() / (h.sum() + RIDGE)
        best = (1e-6, -1, -1)
        for j, cuts in enumerate(edges) if depth else ():
            G, H = np.bincount(bins[:, j], g, len(cuts) + 1).cumsum(), np.bincount(bins[:, j], h, len(cuts) + 1).cumsum()
            left, right = (G[:-1], H[:-1]), (G[-1] - G[:-1], H[-1] - H[:-1])
            gain = left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE) - G[-1] ** 2 / (H[-1] + RIDGE)
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), j, int(gain.argmax()))
        if best[1] >= 0:
            _, j, k = best
            low = bins[:, j] <= k
            self.split = (j, float(edges[j][k]))
            self.left, self.right = (Tree(bins[m], edges, g[m], h[m], depth - 1) for m in (low, ~low))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.split is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.split[0]] < self.split[1], self.left.predict(x), self.right.predict(x))

    def column(self, features: Column) -> Column:
        if self.split is None:
            return F.lit(float(self.value))
        return F.when(features[self.split[0]] < self.split[1], self.left.column(features)).otherwise(self.right.column(features))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> tuple[float, list[Tree]]:
    """Log-odds of label 1 where both labels weigh alike: a bias and trees fitted to the slopes of the logistic loss."""
    if len(np.unique(y)) < 2:
        return (-30.0 if not y.sum() else 30.0), []
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:])) for j in range(x.shape[1])]
    edges = [e[e > x[:, j].min()] for j, e in enumerate(edges)]
    bins = np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)])
    bias, weight = 0.0, np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    margin, out = np.full(len(y), bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        out.append(Tree(bins, edges, weight * (y - p), weight * p * (1 - p), DEPTH))
        margin += out[-1].predict(x)
    return bias, out


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict (allow or block), block_score.

    labelled: (url, blocked 0/1) rows to learn from instead of the generated ones.
    """
    spark, folder = pages.sparkSession, scratch(pages.sparkSession)

    def described(urls: DataFrame, keep: list[str]) -> DataFrame:
        parts = urls.select(*keep, F.coalesce(F.col("url").cast("string"), F.lit("")).alias("u")).withColumns(dict(zip(("host", "path"), host_and_path(F.col("u")), strict=True)))
        rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
        low = lexical(F.col("u"), F.col("host"), F.col("path"))
        suffix = F.regexp_extract("host", "([^.]*)$", 1)
        return parts.select(*keep, "host", "path", rule.alias("rule"), verdict.alias("decided"), suffix.alias("suffix"), F.xxhash64("u").alias("order"), F.xxhash64("u", F.lit(1)).alias("url_hash"), F.array(*(low[k].cast("double") for k in FEATURES[:-2])).alias("x"))

    found = written(described(pages.select("page_id", "url"), ["page_id"]), folder, "pages")
    if labelled is None:
        labelled = spark.createDataFrame(labelled_urls(), "url string, blocked int")
    train = written(described(labelled.select("url", F.col("blocked").cast("int").alias("y")), ["y"]), folder, "labelled").filter("y is not null")
    train = train.withColumn("fold", F.pmod("order", F.lit(FOLDS)))
    shares = train.groupBy("suffix", "fold").agg(F.sum("y").alias("blocked"), F.count("*").alias("seen"))
    whole = shares.groupBy("suffix").agg(F.sum("blocked").alias("blocked"), F.sum("seen").alias("seen"))
    others = whole.join(shares.toDF("suffix", "fold", "b", "n"), "suffix").select("suffix", "fold", (F.col("blocked") - F.col("b")).alias("blocked"), (F.col("seen") - F.col("n")).alias("seen"))

    def full(df: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
        n, k = F.coalesce("seen", F.lit(0)), F.coalesce("blocked", F.lit(0))
        return df.join(counts, by, "left").withColumn("x", F.concat("x", F.array((k + 1) / (n + 2), F.log1p(n.cast("double")))))

    few = train.orderBy("order", "url_hash").limit(train_rows)
    rows = full(few, others, ["suffix", "fold"]).select("x", "y").collect()
    x, y = np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r.y for r in rows], float)
    bias, trees = boost(x, y) if len(y) else (-30.0, [])
    margin = reduce(lambda a, t: a + t.column(F.col("x")), trees, F.lit(bias))
    scored = full(found, written(whole, folder, "suffixes"), ["suffix"]).withColumn("block_score", F.when(F.col("host") == "", 0.0).otherwise(1 / (1 + F.exp(-margin))))
    verdict = F.coalesce("decided", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")
