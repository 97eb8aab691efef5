"""Benchmark decontamination with a positional inverted index of the training texts.

Training texts are split into words once, into a table of rows with their words. Test items are cut into windows.
Occurrences of test terms are counted over all texts; each window is looked up by its two rarest terms, and postings
(term, row, position) of exactly those terms make the index, a table. Lists are shifted by the terms' offsets and
intersected; what both terms agree on is compared with the hash of the whole window. Proximity queries use the
same kind of index with a slop.

No join is hinted: what is looked up is a table of its own, which the planner broadcasts by its size in bytes or,
beyond that, shuffles. Rows to compare are told by a bit each, so that the others are never shuffled.
Rows are told apart by a number that they get when they are written, so rows without doc_id and repeated ids with
different texts are checked each by its own text. Null and empty texts have no words. Items without words are
ignored. Repeated rows get the same result each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.shared import NOT_ALNUM, keep_only, lower_ascii, marked, numbered, scratch, split_words, written
from quarry.llm.spans import sha256

WINDOW, RARE = 10, 2


def alnum_words(text: Column) -> Column:
    return split_words(lower_ascii(text), NOT_ALNUM)


def split_rows(docs: DataFrame, folder: str, row: Column | None = None) -> DataFrame:
    """(row, doc_id, words, n_words) of all texts as a table: each text is split once, its row number is fixed."""
    row = F.monotonically_increasing_id() if row is None else row
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long"), alnum_words(F.col("text").cast("string")).alias("words"))
    return written(rows.withColumn("n_words", F.size("words").cast("long")), folder, "words")


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, window, terms): all windows of an item; one of fewer words is one window. window: a hash of the terms."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), alnum_words(F.col("text").cast("string")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("terms")).distinct()
    return cut.withColumn("window", F.xxhash64("terms", F.size("terms")))


def term_counts(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences of each test term in all training texts. Few terms are looked up before counting, many after it."""
    tokens = rows.select(F.explode("words").alias("term"))
    return tokens.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term", "left_semi")


def postings(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: (term, row, pos) for the occurrences of `terms`, pos from 0."""
    tokens = rows.select("row", F.posexplode("words").alias("pos", "term"))
    return tokens.join(terms, "term").select("term", "row", "pos")


def rarest(windows: DataFrame, counts: DataFrame, keep: int = RARE) -> DataFrame:
    """(window, term, shift, n_terms): the `keep` rarest terms of each window and where they stand in it."""
    each = windows.select("window", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("shift", "term")).distinct()
    order = W.partitionBy("window").orderBy(F.coalesce("n", F.lit(0)), "term", "shift")
    ranked = each.join(counts, "term", "left").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
    all_bits = F.expr(f"shiftleft(1, least(n_terms, {keep})) - 1")
    return ranked.select("window", "term", "shift", F.expr("shiftleft(1, rank - 1)").alias("bit"), all_bits.alias("needed"), "n_terms")


def phrase_starts(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, window, start, n_terms) where all the wanted terms of a window stand at their places."""
    shifted = index.join(wanted, "term").select("row", "window", (F.col("pos") - F.col("shift")).alias("start"), "bit", "needed", "n_terms")
    agreed = shifted.filter("start >= 0").groupBy("row", "window", "start", "needed", "n_terms").agg(F.bit_or("bit").alias("bits"))
    return agreed.filter("bits = needed").select("row", "window", "start", "n_terms")


def near_matches(index: DataFrame, query: DataFrame, slop: int) -> DataFrame:
    """(row, query, start, end): spans of at most `slop` more positions than terms that hold all terms of a query.

    query: (query, term) rows, terms distinct. A span begins at an occurrence of one of its terms. Positions meet
    by strips as long as a span, so a text is not compared with itself as a whole.
    """
    size = query.groupBy("query").agg(F.count("*").alias("terms"))
    found = index.join(query, "term").join(size, "query").withColumn("width", F.col("terms") + slop)
    strip = F.floor(F.col("pos") / F.col("width"))
    reach = found.select("row", "query", "terms", "pos", (F.col("pos") + F.col("width") - 1).alias("to"), F.explode(F.array(strip, strip + 1)).alias("strip"))
    other = found.select("row", "query", F.col("pos").alias("p2"), F.col("term").alias("t2"), strip.alias("strip"))
    joined = reach.join(other, ["row", "query", "strip"]).filter("p2 >= pos and p2 <= to")
    firsts = joined.groupBy("row", "query", "pos", "terms", "t2").agg(F.min("p2").alias("p2"))
    whole = firsts.groupBy("row", "query", "pos", "terms").agg(F.count("*").alias("n"), F.max("p2").alias("end")).filter("n = terms")
    return whole.select("row", "query", F.col("pos").alias("start"), "end")


def proximity(docs: DataFrame, items: DataFrame, slop: int) -> DataFrame:
    """(doc_id, item_id, start, end): where all distinct words of an item stand within `slop` more positions than words, in any order."""
    folder = scratch(docs.sparkSession)
    rows = split_rows(docs, folder)
    query = items.select(F.col("item_id").cast("string").alias("query"), F.explode(F.array_distinct(alnum_words(F.col("text").cast("string")))).alias("term")).distinct()
    query = written(query, folder, "queries")
    index = written(postings(rows, written(query.select("term").distinct(), folder, "terms")), folder, "postings")
    return near_matches(index, query, slop).join(rows.select("row", "doc_id"), "row").select("doc_id", F.col("query").alias("item_id"), "start", "end")


def covered(hits: Column) -> Column:
    """How many positions sorted (start, n_terms) hits cover together."""

    def step(acc: Column, h: Column) -> Column:
        end = h["start"] + h["n_terms"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(end - F.greatest(acc["end"], h["start"]), F.lit(0))).alias("n"))

    return F.aggregate(hits, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def check(docs: DataFrame, items: DataFrame, size: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, hits (sorted start and n_terms) and, with keep, those columns as the struct `input`.

    Only rows with a place to compare move to their places; all others stay where they are and have no hits. With keep,
    docs are stored beside their words, which go before the result is read: n_words is counted anew if it is asked for.
    """
    folder = scratch(docs.sparkSession)
    if keep:
        docs = numbered(docs.select(F.struct(*dict.fromkeys(("doc_id", "text", *keep))).alias("input")), folder)
        docs = docs.select("row", F.col("input.doc_id").alias("doc_id"), F.col("input.text").alias("text"), F.struct(*(F.col(f"input.{c}").alias(c) for c in keep)).alias("input"))
    rows = split_rows(docs, folder, F.col("row") if keep else None)
    windows = written(item_windows(items, size), folder, "windows")
    terms = written(windows.select(F.explode("terms").alias("term")).distinct(), folder, "terms")
    counts = written(term_counts(rows, terms), folder, "counts")
    wanted = written(rarest(windows, counts), folder, "wanted")
    index = written(postings(rows, written(wanted.select("term").distinct(), folder, "looked_up")), folder, "postings")
    starts = phrase_starts(index, wanted)
    places = written(starts.groupBy("row").agg(F.collect_set(F.struct("start", "window", "n_terms")).alias("places")), folder, "places")
    keep_only(docs.sparkSession, folder, "rows", "words", "windows", "places")
    rows = marked(rows, places)
    same = lambda p: F.xxhash64(F.slice("words", p["start"] + 1, p["n_terms"]), p["n_terms"]) == p["window"]
    compared = rows.filter("marked").select("row", "words").join(places, "row").select("row", F.filter("places", same).alias("places")).filter("size(places) > 0")
    # the window follows from where it stands and how long it is, so hits of distinct places are distinct
    hits = F.array_sort(F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["n_terms"].alias("n_terms"))))
    found = written(compared.select("row", hits.alias("hits"), F.array_distinct(F.transform("places", lambda p: p["window"])).alias("found")), folder, "found")
    owners = windows.select("window", "item_id").distinct()
    owned = found.select("row", F.explode("found").alias("window")).join(owners, "window").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    judged = written(found.select("row", "hits").join(owned, "row"), folder, "judged")
    keep_only(docs.sparkSession, folder, "judged", "rows" if keep else "words")
    if keep:
        rows = docs.select("row", F.col("doc_id").cast("long"), "input", F.size(alnum_words(F.col("text").cast("string"))).cast("long").alias("n_words"))
    else:
        rows = rows.select("row", "doc_id", F.lit(None).cast("int").alias("input"), "n_words")
    rows = marked(rows, judged)
    none = [F.array().cast(judged.schema[c].dataType).alias(c) for c in ("hits", "items")]
    out = rows.filter("marked").join(judged, "row").select("doc_id", "input", "n_words", "hits", "items").union(rows.filter("not marked").select("doc_id", "input", "n_words", *none))
    out = out.withColumn("n_hit", covered(F.col("hits")).cast("long"))
    columns = ("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha256(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", "hits")
    return out.select(*columns, *(["input"] if keep else []))
