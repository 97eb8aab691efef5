"""Secrets: fixed patterns, and random-looking tokens told from identifiers by two character Markov models.

The models count which character follows which in labelled samples. Random strings are what the patterns found and
generated keys (mixed case with digits, base64, prefixed). Ordinary identifiers are the distinct letter-only words
of all documents, and generated names of code, slugs, dates, versions, numbers and paths; generated ones count at
least half, so that what prose never has is still ordinary. A token is a secret if its log-likelihood ratio reaches THRESHOLD:
the rarer secrets are among tokens, the more its characters must say. Tokens in the form of a UUID are identifiers.
A pair that is rare after its first character backs off to the character alone.

Null and empty texts have no spans. Repeated rows and rows without doc_id get their own result each.
"""

from __future__ import annotations

import math
import random
import string
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import scratch, written
from quarry.llm.spans import clear_of, labelled, matches, printed, sha256

_ANY_CASE = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_NAMES = "|".join([*map(_ANY_CASE, ("password", "passwd", "secret", "token")), f"{_ANY_CASE('api')}_?{_ANY_CASE('key')}"])
ASSIGN = f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "(?<![0-9a-f])[0-9a-f]{32,}"
TOKEN = "(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{11,}[A-Za-z0-9+/=]"
IDENTIFIER = "(?<![A-Za-z_])[A-Za-z_]{8,}"
UUID = "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
KINDS = ("assign", "access", "hex", "random")
ALPHABET = string.ascii_letters + string.digits + "+/_.=-"
STATES = len(ALPHABET) + 1
GENERATED, THRESHOLD, SMOOTHING, BACKOFF = 6000, math.log(1e5), 0.5, 10.0
"""GENERATED strings of each label; THRESHOLD holds that one token in 100 000 is a secret."""
_PARTS = "user name config value index file path read write list map item count total first last page report order data test build release notes final draft version date time month year image photo main common util service client server request response error message event handler state query table column field key token group member address street city country number sample model train score result output input".split()


def base_spans(text: Column) -> dict[str, Column]:
    """The fixed patterns, after their length rules."""
    assign = matches(text, ASSIGN, part=2, guard=text.rlike(f"({_NAMES})[\"']?\\x20*[:=]"))
    return {
        "assign": F.filter(assign, lambda s: F.length(s["part"]) >= 8),
        "access": matches(text, ACCESS, guard=F.contains(text, F.lit("AKIA"))),
        "hex": matches(text, HEX, guard=text.rlike("[0-9a-f]{32}")),
    }


def _states(value: Column) -> Column:
    """The characters as numbers from 1; 0 for others."""
    return F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _pairs(values: DataFrame) -> DataFrame:
    """Counts of each pair of states (code) in the column `value`; the first character follows 0."""
    states = values.filter(F.length("value") > 0).select(_states(F.col("value")).alias("s"))
    codes = F.zip_with(F.concat(F.array(F.lit(0)), F.col("s")), F.col("s"), lambda a, b: a * STATES + b)
    return states.select(F.explode(codes).alias("code")).filter("code is not null").groupBy("code").count()


class MarkovRatio:
    """Log-likelihood ratios of pairs of characters: random strings against identifiers. Each side mixes the counts of its own sample, at most by half, with generated ones."""

    def __init__(self, random: tuple[dict[int, int], dict[int, int]], ordinary: tuple[dict[int, int], dict[int, int]]) -> None:
        logs = []
        for own, made in (random, ordinary):
            n, m = sum(own.values()), sum(made.values())
            weight = min(0.5, n / (n + m))
            logs.append([math.log(weight * a + (1 - weight) * b) for a, b in zip(self._shares(own), self._shares(made), strict=True)])
        self.ratios = [round(a - b, 4) for a, b in zip(*logs, strict=True)]

    @staticmethod
    def _shares(counts: dict[int, int]) -> list[float]:
        after, alone = [0] * STATES, [SMOOTHING] * STATES
        for code, n in counts.items():
            after[code // STATES] += n
            alone[code % STATES] += n
        share = [n / sum(alone) for n in alone]
        return [(counts.get(k, 0) + BACKOFF * share[k % STATES]) / (after[k // STATES] + BACKOFF) for k in range(STATES * STATES)]

    def ratio(self, value: Column) -> Column:
        states, table = _states(value), F.lit(self.ratios)
        step = lambda acc, s: F.struct(s.alias("last"), (acc["sum"] + F.get(table, acc["last"] * STATES + s)).alias("sum"))
        return F.aggregate(states, F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])


def labelled_samples(n: int = GENERATED, seed: int = 3) -> tuple[list[str], list[str]]:
    """Generated (random, ordinary) strings, the same for the same seed."""
    r = random.Random(seed)
    word, digits = (lambda: r.choice(_PARTS)), (lambda a, b: "".join(r.choice(string.digits) for _ in range(r.randint(a, b))))
    key = lambda letters, a, b: "".join(r.choice(letters) for _ in range(r.randint(a, b)))
    plain = string.ascii_letters + string.digits
    keys = (
        lambda: key(plain, 16, 48), lambda: key(plain + "+/", 20, 64) + r.choice(["", "=", "=="]), lambda: key(plain + "_-", 20, 48),
        lambda: f"{r.choice(['sk', 'pk', 'ghp', 'xox', 'key'])}_{r.choice(['live_', 'test_', ''])}{key(plain, 16, 40)}", lambda: key(string.ascii_lowercase + string.digits, 16, 40),
    )
    date = lambda: f"{r.randint(1970, 2035)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"
    names = (
        lambda: "_".join(word() for _ in range(r.randint(2, 5))), lambda: "-".join(word() for _ in range(r.randint(2, 6))), lambda: "".join(word().title() for _ in range(r.randint(2, 5))),
        lambda: word() + "".join(word().title() for _ in range(r.randint(1, 4))), lambda: "_".join(word() for _ in range(r.randint(2, 4))).upper(), lambda: f"{word()}_{word()}{digits(1, 4)}",
        lambda: f"{date()}-{'-'.join(word() for _ in range(r.randint(1, 4)))}", lambda: f"{date()}T{r.randint(0, 23):02}", lambda: f"{word()}-{word()}-v{digits(1, 2)}.{digits(1, 2)}.{digits(1, 2)}",
        lambda: "/".join(word() for _ in range(r.randint(2, 6))) + r.choice(["", ".py", ".txt", ".html", ".json"]), lambda: digits(6, 20), lambda: f"{digits(2, 4)}-{digits(3, 4)}-{digits(3, 6)}",
        lambda: f"{word()}{digits(2, 8)}.{r.choice(['jpg', 'png', 'csv'])}", lambda: ".".join(word() for _ in range(r.randint(2, 5))), lambda: f"{digits(1, 3)}.{digits(1, 3)}.{digits(1, 3)}.{digits(1, 3)}",
        lambda: f"{word()}={digits(1, 6)}", lambda: f"{word().upper()}-{digits(3, 8)}", lambda: f"www.{word()}{word()}.{r.choice(['com', 'org', 'net'])}", lambda: f"{'-' * r.randint(4, 20)}{word()}", lambda: "=" * r.randint(8, 30),
    )
    return [r.choice(keys)() for _ in range(n)], [r.choice(names)() for _ in range(n)]


def code_counts(values: list[str]) -> dict[int, int]:
    """The counts that `_pairs` makes, of strings on the driver."""
    at, out = {c: i + 1 for i, c in enumerate(ALPHABET)}, Counter()
    for v in values:
        states = [0, *(at.get(c, 0) for c in v)]
        out.update(a * STATES + b for a, b in zip(states[:-1], states[1:], strict=True))
    return dict(out)


def train(drawn: DataFrame, ordinary: DataFrame, generated: int = GENERATED) -> MarkovRatio:
    """From labelled samples, each a column `value`; at most STATES squared counts of either come to the driver."""
    own = [{r["code"]: r["count"] for r in _pairs(x).collect()} for x in (drawn, ordinary)]
    return MarkovRatio(*((x, code_counts(y)) for x, y in zip(own, labelled_samples(generated), strict=True)))


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, found (the spans as an array)."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    tokens = F.filter(matches(text, TOKEN, guard=text.rlike(TOKEN)), lambda s: ~s["value"].rlike(UUID) & ~s["value"].rlike("^[0-9.=_-]+$"))
    held = written(docs.select("doc_id", *(c.alias(k) for k, c in base_spans(text).items()), tokens.alias("random")), folder, "spans")
    value = lambda k: F.transform(k, lambda s: F.coalesce(s["part"], s["value"]))
    drawn = held.select(F.explode(F.concat(*(value(k) for k in KINDS[:3]))).alias("value"))
    ordinary = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0)))).alias("value")).distinct()
    model = train(drawn, ordinary)
    base = F.concat(*(labelled(F.col(k), k, i) for i, k in enumerate(KINDS[:3])))
    held = held.withColumn("base", base)
    added = clear_of(F.filter("random", lambda s: model.ratio(s["value"]) >= threshold), F.col("base"))
    out = held.withColumn("found", F.array_sort(F.concat("base", labelled(added, KINDS[3], 3))))
    return out.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), sha256(printed(F.col("base"))).alias("base_sha256"),
        printed(F.col("found")).alias("spans"), F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("found"),
    )
