"""Personal data by weak supervision: labelers vote on candidate spans, EM rates the labelers, a classifier decides.

Candidates are the spans of fixed patterns (always kept) and of looser ones. Labelers look at the shape, check
digits and value ranges, gazetteers of top-level domains and calling codes, the words before the span, and how
varied its digits are; each votes for, against or not at all. Expectation-maximisation over the counts of vote
patterns (a bounded table) estimates how each labeler votes on true and false spans. The resulting probabilities
are the soft labels of a logistic span classifier, which adds loose spans that touch no fixed one.

Null and empty texts have no spans. Repeated rows and rows without doc_id get their own result each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import scratch, written
from quarry.llm.spans import clear_of, labelled, matches, printed, replaced, sha256

EMAIL = "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?:(?<![0-9])|\\G)[0-9]++(?:\\.[0-9]++)(?:\\.[0-9]++)(?:\\.[0-9]++)"
CARD = "[0-9]++(?:[\\x20-][0-9]++)*+"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
LOOSE = {
    "spelled_email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\\x20?[\\[(]at[\\])]\\x20?[A-Za-z0-9-]{1,63}(?:\\x20?(?:[\\[(]dot[\\])]|\\.)\\x20?[A-Za-z0-9-]{1,63}){1,8}",
    "local_phone": "(?<![0-9A-Za-z+(.-])\\(?[0-9]{3}\\)?[\\x20.-]{1,2}[0-9]{3}[\\x20.-][0-9]{4}(?![0-9-])",
    "id_number": "(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
}
KINDS = (*BASE, *LOOSE, "number")
LABELERS = ("shape", "checked", "gazetteer", "context", "varied")
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "nl", "eu", "us", "ch", "at", "ca")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91")
FOR_WORDS = "(?i)(?:e-?mail|contact|write to|phone|tel|call|mobile|fax|card|visa|ssn|social security|iban|account|address|reach)[^\\n]{0,16}$"
AGAINST_WORDS = "(?i)(?:version|order|isbn|issn|invoice|ticket|serial|build|model|part|no\\.|example)[^\\n]{0,16}$"
CONTEXT, THRESHOLD, STEPS = 40, 0.5, 30


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check digit of a digit string holds."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets(value: Column) -> Column:
    """All parts are at most 255."""

    def fits(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) <= 3) & (F.coalesce(F.substring(bare, 1, 3).try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, "\\."), fits)


def _found(text: Column, pattern: str, guard: Column) -> Column:
    return matches(text, pattern, guard=guard, before=CONTEXT)


def base_spans(text: Column) -> dict[str, Column]:
    """The fixed patterns after their checks; under number, digit runs of a card's length that fail the check digit."""
    digit = text.rlike("[0-9]")
    runs = F.filter(_found(text, CARD, digit & text.rlike("[0-9](?:[\\x20-]?[0-9]){13}")), lambda s: F.length(_digits(s["value"])).between(14, 19))
    return {
        "email": _found(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(_found(text, IP, digit & text.rlike("[0-9]\\.[0-9]")), lambda s: _octets(s["value"])),
        "card": F.filter(runs, lambda s: luhn(_digits(s["value"]))),
        "phone": F.filter(_found(text, PHONE, digit & F.contains(text, F.lit("+"))), lambda s: F.length(_digits(s["value"])).between(10, 15)),
        "number": F.filter(runs, lambda s: ~luhn(_digits(s["value"]))),
    }


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: Column, value: Column, before: Column) -> dict[str, Column]:
    """Each labeler's vote on a span: 1, -1 or 0."""
    digits, mail = _digits(value), kind.isin("email", "spelled_email")
    domain = F.lower(F.regexp_extract(value, "([A-Za-z0-9-]+)$", 1))
    inner = value.rlike("^(?:10|127|0|192\\.168|169\\.254)\\.")
    called = F.forall(F.array(*map(F.lit, CALLING)), lambda c: ~F.startswith(digits, c))
    return {
        "shape": F.when(kind.isin(*BASE), 1).otherwise(0),
        "checked": _vote(kind.isin("card", "ip"), kind == "number"),
        "gazetteer": _vote(mail & domain.isin(*DOMAINS) | (kind == "phone") & ~called, mail & ~domain.isin(*DOMAINS) | (kind == "ip") & inner | (kind == "phone") & called),
        "context": _vote(before.rlike(FOR_WORDS), before.rlike(AGAINST_WORDS)),
        "varied": F.when(mail | (F.size(F.array_distinct(F.split(digits, ""))) >= 3), 0).otherwise(-1),
    }


def reliabilities(counts: list[tuple[tuple[int, ...], int]], steps: int = STEPS) -> list[dict[int, tuple[float, float]]]:
    """EM over (votes, count) rows: per labeler and vote, its probability on true and false spans.

    True and false count alike beforehand, as fixed patterns would otherwise speak for loose ones. No vote says nothing. Pseudo-counts hold that a labeler is right four times out of five.
    """
    belief = {v: 1 / (1 + math.exp(-2.0 * sum(v))) for v, _ in counts}
    tables: list[dict[int, tuple[float, float]]] = []
    for _ in range(steps):
        tables = []
        for k in range(len(LABELERS)):
            sums = {1: [8.0, 2.0], -1: [2.0, 8.0]}
            for v, n in ((v, n) for v, n in counts if v[k]):
                sums[v[k]][0] += n * belief[v]
                sums[v[k]][1] += n * (1 - belief[v])
            total = [sum(s[c] for s in sums.values()) for c in (0, 1)]
            tables.append({v: (s[0] / total[0], s[1] / total[1]) for v, s in sums.items()})
        for v, _ in counts:
            belief[v] = posterior(v, tables)
    return tables


def posterior(vote: tuple[int, ...], tables: list[dict[int, tuple[float, float]]]) -> float:
    """The probability that a span with these votes is true."""
    odds = sum(math.log(t[x][0] / t[x][1]) for t, x in zip(tables, vote, strict=True) if x)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def _features(kind: str, vote: tuple[int, ...]) -> dict[str, float]:
    return {"bias": 1.0, f"kind={kind}": 1.0} | {f"{name}={v}": 1.0 for name, v in zip(LABELERS, vote, strict=True) if v}


def classifier(rows: list[tuple[str, tuple[int, ...], int]], steps: int = 300, ridge: float = 1.0) -> dict[str, float]:
    """Weights of a logistic span classifier, fitted to the probabilities that EM gives each (kind, votes, count) row."""
    counts: dict[tuple[int, ...], int] = {}
    for _, v, n in rows:
        counts[v] = counts.get(v, 0) + n
    tables = reliabilities(list(counts.items()))
    weights: dict[str, float] = {}
    total = max(1, sum(n for _, _, n in rows))
    target = {v: posterior(v, tables) for v in counts}
    for _ in range(steps):
        slope: dict[str, float] = {}
        for kind, v, n in rows:
            f = _features(kind, v)
            p = 1 / (1 + math.exp(-sum(weights.get(x, 0.0) for x in f)))
            for x in f:
                slope[x] = slope.get(x, 0.0) + n * (target[v] - p) / total
        for x, g in slope.items():
            weights[x] = weights.get(x, 0.0) + 2.0 * (g - ridge * weights.get(x, 0.0) / total)
    return weights


def probability(weights: dict[str, float], kind: Column, vote: dict[str, Column]) -> Column:
    margin = F.lit(weights.get("bias", 0.0))
    for name, w in weights.items():
        key, _, value = name.partition("=")
        if value:
            margin = margin + F.when((kind == value) if key == "kind" else (vote[key] == int(value)), w).otherwise(0.0)
    return 1 / (1 + F.exp(-margin))


def find(docs: DataFrame, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found (the spans as an array) and, with keep, those columns as the struct `input`.

    With keep, candidates are found twice, for the classifier and as the result is read, instead of being stored with a copy of docs.
    """
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    docs = docs.select(F.struct(*keep).alias("input") if keep else F.lit(None).cast("int").alias("input"), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    spans = base_spans(text)
    for kind, pattern in LOOSE.items():
        guard = text.rlike("[\\[(]at[\\])]") if kind == "spelled_email" else text.rlike("[0-9]{3}" if kind != "iban" else "[A-Z]{2}[0-9]{2}[A-Z0-9]{11}")
        spans[kind] = _found(text, pattern, guard)
    held = docs.select("input", "doc_id", "text", *(c.alias(k) for k, c in spans.items()))
    base = F.concat(*(labelled(F.col(k), k, i) for i, k in enumerate(BASE)))

    def seen(kind: str) -> Column:
        """The spans with their kind, value and what stands before."""
        return F.transform(kind, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "end")), F.lit(kind).alias("kind"), *(s[c].alias(c) for c in ("value", "before"))))

    held = held.withColumn("candidates", F.concat(*map(seen, KINDS)))
    out = ["doc_id", "input", base.alias("base"), *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), "candidates"]
    held = held.select(*out) if keep else written(held.select(*out), folder, "candidates")
    each = held.select(F.explode("candidates").alias("c")).select("c.*")
    voted = each.select("kind", *(v.alias(k) for k, v in votes(F.col("kind"), F.col("value"), F.col("before")).items()))
    rows = [(r.kind, tuple(r[k] for k in LABELERS), r["count"]) for r in voted.groupBy("kind", *LABELERS).count().orderBy("kind", *LABELERS).collect()]
    weights = classifier(rows) if rows else {}

    def likely(c: Column) -> Column:
        return ~c["kind"].isin(*BASE) & (probability(weights, c["kind"], votes(c["kind"], c["value"], c["before"])) > threshold)

    rank = lambda c: F.array_position(F.array(*map(F.lit, KINDS)), c["kind"]).cast("int") - 1
    more = F.transform(clear_of(F.filter("candidates", likely), F.col("base")), lambda c: F.struct(c["start"].alias("start"), rank(c).alias("rank"), c["end"].alias("end"), c["kind"].alias("kind")))
    held = held.withColumn("all", F.array_sort(F.concat("base", more)))
    return held.select(
        "doc_id", *(f"n_{k}" for k in BASE), sha256(printed(F.col("base"))).alias("base_sha256"), printed(F.col("all")).alias("spans"),
        F.transform("all", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("found"),
        *(["input"] if keep else []),
    )


def redacted(text: Column, found: Column) -> Column:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    return replaced(text, found)
