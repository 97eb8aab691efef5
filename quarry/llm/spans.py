"""Spans of pattern matches as columns: code points, end exclusive, leftmost and non-overlapping.

A text is cut at the matches; lengths of the gaps and matches add up to positions. Everything stays in Spark
SQL functions. Patterns must match at least one character. Running sums and maxima go over blocks of about the
square root of a list's length, as appending to one list costs its length each time: a text with n matches takes
time in the order of n to the power of 1.5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with a value that is computed once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blocks(xs: Column) -> Column:
    """The list in parts of about the square root of its length; one empty part for an empty list."""

    def cut(held: Column) -> Column:
        n = F.greatest(F.ceil(F.sqrt(F.size(held))).cast("int"), F.lit(1))
        starts = F.sequence(F.lit(0), F.greatest(F.size(held) - 1, F.lit(0)), n)
        return F.transform(starts, lambda at: F.slice(held, at + 1, n))

    return once(xs, cut)


def running(xs: Column, start: Column, take: Callable[[Column, Column], Column], kind: str) -> Column:
    """What `take` has gathered before each element of xs, from `start` on: a list as long as xs.

    take(gathered, x) must be associative in the sense that gathering a block from `start` and then taking what it
    gathered equals gathering element by element: sums and maxima.
    """
    none = F.array().cast(f"array<{kind}>")

    def inside(block: Column) -> Column:
        step = lambda acc, x: F.struct(take(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(block, F.struct(start.cast(kind).alias("at"), none.alias("out")), step)

    def joined(acc: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda x: take(acc["at"], x))
        return F.struct(take(acc["at"], block["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    first = F.struct(start.cast(kind).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.flatten(F.aggregate(F.transform(blocks(xs), inside), first, joined, lambda acc: acc["out"]))


def matches(text: Column, pattern: str, part: int = 0, guard: Column | None = None, before: int = 0) -> Column:
    """array<struct<start int, end int, value string, part string, before string>>.

    part: the group whose text goes along. before: how many characters before a match go along, though at most back
    to the end of the match before the last one. Where `guard` is false there can be no match, and the pattern isn't
    tried.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(part)) if part else found
    zipped = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("value"), parts.alias("part")), lambda x: x["value"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int,value:string,part:string,before:string>>")

    def placed(xs: Column) -> Column:
        starts = running(F.transform(xs, lambda x: F.length(x["gap"]) + F.length(x["value"])), F.lit(0), lambda a, n: a + n, "int")

        def span(x: Column, at: Column, last: Column) -> Column:
            start = at + F.length(x["gap"])
            context = F.right(F.concat(F.coalesce(F.concat(last["gap"], last["value"]), F.lit("")), x["gap"]), F.lit(before)) if before else F.lit("")
            return F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"), x["part"].alias("part"), context.alias("before"))

        def all_of(ats: Column) -> Column:
            return F.transform(xs, lambda x, i: span(x, F.get(ats, i), F.get(xs, i - 1)))

        return once(starts, all_of)

    spans = F.when(F.size(found) > 0, once(zipped, placed)).otherwise(none)
    return spans if guard is None else F.when(guard, spans).otherwise(none)


def labelled(spans: Column, kind: str, rank: int) -> Column:
    """The spans with what sorts and prints them."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def printed(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then rank."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def clear_of(spans: Column, others: Column) -> Column:
    """Those of `spans` (structs with start and end) that touch none of the others.

    Both go into one list by start. A span is clear if the largest end before it isn't past its start and the
    smallest start after it isn't before its end.
    """
    mark = lambda xs, own: F.transform(xs, lambda s, i: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), i.alias("i")))
    far = 2**31 - 1

    def chosen(spans: Column) -> Column:
        def among(xs: Column) -> Column:
            ends = running(F.transform(xs, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(-1)), F.lit(-1), F.greatest, "int")
            starts = running(F.reverse(F.transform(xs, lambda x: F.when(x["own"] == 0, x["start"]).otherwise(far))), F.lit(far), F.least, "int")
            free = F.transform(F.arrays_zip(xs.alias("x"), ends.alias("e"), F.reverse(starts).alias("s")), lambda z: F.when((z["x"]["own"] == 1) & (z["e"] <= z["x"]["start"]) & (z["s"] >= z["x"]["end"]), z["x"]["i"]))
            return F.transform(F.array_sort(F.array_compact(free)), lambda i: F.get(spans, i))

        return once(F.array_sort(F.concat(mark(others, 0), mark(spans, 1))), among)

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(once(spans, chosen))


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets, spans that overlap by the kind of the first.

    spans: sorted structs with start, end and kind. The text is cut at every block of spans first, so that no cut
    counts characters from the beginning of a long text.
    """

    def merged(xs: Column) -> Column:
        """The spans that begin past all before them, each with the end of those that it overlaps."""
        ends = running(F.transform(xs, lambda x: x["end"]), F.lit(0), F.greatest, "int")

        def heads(reach: Column) -> Column:
            first = F.filter(F.transform(xs, lambda x, i: F.struct(i.alias("i"), x["start"].alias("start"), x["kind"].alias("kind"), F.get(reach, i).alias("before"))), lambda x: x["start"] >= x["before"])
            last = F.array_max(F.transform(xs, lambda x: x["end"]))

            def closed(hs: Column) -> Column:
                return F.transform(hs, lambda h, k: F.struct(h["start"].alias("start"), F.coalesce(F.get(hs, k + 1)["before"], last).alias("end"), h["kind"].alias("kind")))

            return once(first, closed)

        return once(ends, heads)

    def cut(parts: Column) -> Column:
        def of_block(block: Column, k: Column) -> Column:
            """From the end of the block before to the end of this one, with what follows the last one."""
            base = F.when(k == 0, 0).otherwise(F.element_at(F.get(parts, k - 1), -1)["end"])
            end = F.element_at(block, -1)["end"]
            own = F.substring(text, base + 1, end - base)

            def pieces(chunk: Column) -> Column:
                one = lambda s, i: F.concat(F.substring(chunk, F.when(i == 0, 1).otherwise(F.get(block, i - 1)["end"] - base + 1), s["start"] - F.when(i == 0, base).otherwise(F.get(block, i - 1)["end"])), F.lit("["), F.upper(s["kind"]), F.lit("]"))
                return F.array_join(F.transform(block, one), "")

            return once(own, pieces)

        tail = F.substring(text, F.element_at(F.element_at(parts, -1), -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(parts, of_block), ""), tail)

    return F.when(F.size(spans) > 0, once(blocks(merged(spans)), cut)).otherwise(text)
