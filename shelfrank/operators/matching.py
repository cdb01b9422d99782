"""Fuzzy title match: the best catalogue record for each listing, by shared words.

Matches above a threshold are found by prefix filtering: a title's words are put in order of rarity, and only so many of
the rarest are joined on as any partner above the threshold must share one of. Common words are then joined only where a
title has nothing rarer, and titles are never crossed.

The best of what shares any word at all, below any threshold, is found by bounds. Of the titles that share one word alone
the best is known beforehand: for a word and the number of its repeats, the shortest title of the smallest id. Its score
is a title's own threshold, and a partner that beats it shares two words or more, so many more the longer it is.

Sides of joins that grow with the titles are never broadcast: Spark would estimate them from the size of files that hold
far less than what is made of them, and what is broadcast passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Fixed value: a match scores above this.
THRESHOLD = 0.4


def _merged(side: DataFrame) -> DataFrame:
    """A side of a join that is sorted and merged, whatever its estimated size."""
    return side.hint("merge")


def _scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """(left_id, right_id, score) from a: (l, ws), distinct words, and b: (r, ws), words with repeats."""
    words_a = a.select("l", F.size("ws").alias("nl"), F.explode("ws").alias("w"))
    # A title's repeats are counted inside its row, without a shuffle.
    counted = F.transform(F.array_distinct("ws"), lambda w: F.struct(w.alias("w"), F.size(F.filter("ws", lambda x: x == w)).alias("c")))
    words_b = b.select("r", F.explode(counted).alias("t"), F.size(F.array_distinct("ws")).alias("nr")).select("r", "nr", "t.w", "t.c")
    shared = words_a.join(_merged(words_b), "w").groupBy("l", "r", "nl", "nr").agg(F.sum("c").alias("bag"), F.count("*").alias("both"))
    score = F.col("bag").cast("double") / (F.col("nl") + F.col("nr") - F.col("both"))
    return shared.select(F.col("l").alias("left_id"), F.col("r").alias("right_id"), score.alias("score"))


def _left_words(title: str) -> Column:
    return F.array_sort(F.array_distinct(text.tokens(text.without_brackets(title))))


def match_scores(left: DataFrame, right: DataFrame, left_id: str, left_title: str, right_id: str, right_title: str) -> DataFrame:
    """(left_id, right_id, score) for all pairs that share a word.

    score: how many of the right title's words, repeats included, are in the left title without its brackets, over the
    number of words in either. It can exceed 1. Pairs without a common word score 0 and aren't made: words are joined,
    titles aren't crossed. A very common word is split by adaptive execution, not dropped.
    """
    return _scores(left.select(F.col(left_id).alias("l"), _left_words(left_title).alias("ws")), right.select(F.col(right_id).alias("r"), text.tokens(right_title).alias("ws")))


#: Classes by powers of two that a number can be in, and lengths of titles that are a class each.
POWERS, ALONE = 32, 64


def _each(first: int, last: int) -> Column:
    """A row for each class."""
    return F.explode(F.array(*map(F.lit, range(first, last + 1))))


def _placed(titles: DataFrame, rank: DataFrame) -> DataFrame:
    """titles (ws, ...) with a row for each distinct word of a title that some right title has: w, its place `at` among
    the title's words from the rarest on, and n, how many they are. Words that no right title has are the rarest."""
    rest = [c for c in titles.columns if c != "ws"]
    words = titles.withColumn("__t", F.explode(F.array_distinct("ws")))
    ranked = words.join(_merged(rank), F.col("__t") == F.col("word"), "left").select("ws", *rest, F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), F.col("__t").alias("w")).alias("__r"))
    lists = ranked.groupBy("ws", *rest).agg(F.array_sort(F.collect_list("__r")).alias("__rs"))  # one title's words
    return lists.select("ws", *rest, F.size("__rs").alias("n"), F.posexplode("__rs").alias("at", "__p")).where("__p.seen > 0").select("ws", *rest, "n", "at", F.col("__p.w").alias("w"))


def _classed(offers: DataFrame) -> DataFrame:
    """offers (ws, r) with m, how many distinct words a title has, counts, each of them with its number, x, the largest
    number, and k: between which powers of two it lies."""
    counted = F.transform(F.array_distinct("ws"), lambda w: F.struct(w.alias("w"), F.size(F.filter("ws", lambda x: x == w)).alias("c")))
    told = offers.where(F.size("ws") > 0).withColumn("counts", counted).withColumn("x", F.array_max(F.transform("counts", lambda t: t["c"])))
    return told.withColumns({"m": F.size("counts"), "k": F.floor(F.log2("x") + 1e-9).cast("int")})


def _rank(classed: DataFrame) -> DataFrame:
    return classed.select(F.explode(F.array_distinct("ws")).alias("word")).groupBy("word").agg(F.count("*").alias("seen"))


def _scored(met: DataFrame) -> DataFrame:
    """(ws, right_id, score) of pairs of a left title (l, n) and a right one (r, r_ws, counts, x, m)."""
    both = F.size(F.array_intersect("r_ws", "l"))
    repeats = F.aggregate(F.filter("counts", lambda t: F.array_contains("l", t["w"])), F.lit(0), lambda sum, t: sum + t["c"])
    score = F.when(F.col("x") == 1, both).otherwise(repeats).cast("double") / (F.col("n") + F.col("m") - both)
    return met.select(F.col("l").alias("ws"), F.col("r").alias("right_id"), score.alias("score"))


def _above(lefts: DataFrame, offers: DataFrame, threshold: float) -> DataFrame:
    """(ws, right_id, score) of all pairs above the threshold, from lefts (ws), distinct words, and offers (ws, r).

    With n and m distinct words, c of them common, and no word more than x times in the right title, a score above t
    needs c > t (n + m) / (x + t), and so, as n and m are c at the least, c > t n / x and c > t m / x. Each side's first
    n - floor(t n / x) rarest words hold a common one then. Right titles are classed by x, so one that repeats a word very
    often widens the search among its like alone.
    """
    classed = _classed(offers)
    rank = _rank(classed)
    classes = classed.groupBy("k").agg(F.max("x").alias("most"))  # a row a power of two
    kept = lambda x: F.col("at") < F.col("n") - F.floor(threshold * F.col("n") / x).cast("int")
    left = _placed(lefts, rank).select("*", _each(0, POWERS - 1).alias("k")).join(F.broadcast(classes), "k").where(kept(F.col("most"))).select(F.col("ws").alias("l"), "n", "w", "k")
    right = _placed(classed, rank).where(kept(F.col("x"))).select(F.col("ws").alias("r_ws"), "r", "counts", "x", "m", "w", "k")
    return _scored(left.join(_merged(right), ["w", "k"])).where(F.col("score") > threshold)


def _singles(placed: DataFrame, classed: DataFrame) -> DataFrame:
    """(ws, right_id, score): for each left title the best right one if no more than one word were shared."""
    words = classed.select("r", "m", F.explode("counts").alias("t")).select("r", "m", "t.w", "t.c")
    shortest = words.groupBy("w", "c").agg(F.min(F.struct("m", "r")).alias("s"))  # a word's numbers are few
    score = F.col("c").cast("double") / (F.col("n") + F.col("s.m") - 1)
    best = placed.join(_merged(shortest), "w").groupBy("ws").agg(F.min(F.struct((-score).alias("lower"), F.col("s.r").alias("r"))).alias("b"))
    return best.select("ws", F.col("b.r").alias("right_id"), (-F.col("b.lower")).alias("score"))


def _beating(placed: DataFrame, classed: DataFrame, rank: DataFrame, singles: DataFrame) -> DataFrame:
    """Pairs of titles (l, n; r, r_ws, counts, x, m) that may share two words or more and reach the left one's own score.

    c common words of n and m, none more than x times, reach a score t only if c >= t (n + m) / (x + t). The longer right
    titles are, the fewer of a left title's rarest words are joined on then, so joins go by length: lengths up to ALONE,
    longer ones between powers of two. Both titles must have enough words left from the shared one on.
    """
    length = F.when(F.col("m") <= ALONE, F.col("m")).otherwise(F.floor(F.log2("m") + 1e-9) + ALONE).cast("int")
    long = classed.withColumn("of", length)
    lengths = long.groupBy("k", "of").agg(F.max("x").alias("most"), F.min("m").alias("least"))  # bounded: lengths times powers
    t = F.col("t")
    needed = F.greatest(F.lit(2), F.ceil(t * (F.col("n") + F.col("least")) / (F.col("most") + t) - 1e-9).cast("int"))
    known = placed.groupBy("ws").agg(F.count("*").alias("known"))
    own = placed.join(_merged(singles.select("ws", F.col("score").alias("t"))), "ws").join(_merged(known), "ws").where("known > 1")
    left = own.select("*", _each(1, ALONE + POWERS - 1).alias("of")).join(F.broadcast(lengths), "of").withColumn("c", needed).where((F.col("c") <= F.col("known")) & (F.col("at") <= F.col("n") - F.col("c")))
    left = left.select(F.col("ws").alias("l"), "n", "c", "w", "k", "of")
    right = _placed(long, rank).select(F.col("ws").alias("r_ws"), "r", "counts", "x", "m", "k", "of", "w", F.col("at").alias("r_at"))
    return left.join(_merged(right), ["w", "k", "of"]).where(F.col("r_at") <= F.col("m") - F.col("c"))


def best_matches(left: DataFrame, right: DataFrame, left_id: str = "_ordinal", left_title: str = "title", right_id: str = "_ordinal", right_title: str = "title", threshold: float = THRESHOLD) -> DataFrame:
    """(left_id, right_id, score): the best right row above the threshold for each left row; the smaller id wins ties.

    Titles of equal words are matched once: on the right the smallest id stands for them, on the left the result is
    joined back to all of them.
    """
    rows, offers = _sides(left, right, left_id, left_title, right_id, right_title)
    return _best(rows, _above(rows.select("ws").distinct(), offers, threshold))


def _sides(left: DataFrame, right: DataFrame, left_id: str, left_title: str, right_id: str, right_title: str) -> tuple[DataFrame, DataFrame]:
    rows = left.select(F.col(left_id).alias("left_id"), _left_words(left_title).alias("ws"))
    return rows, right.select(F.col(right_id).alias("r"), F.array_sort(text.tokens(right_title)).alias("ws")).groupBy("ws").agg(F.min("r").alias("r"))


def _best(rows: DataFrame, found: DataFrame) -> DataFrame:
    best = found.groupBy("ws").agg(F.min(F.struct((-F.col("score")).alias("lower"), "right_id")).alias("b"))
    return rows.join(_merged(best), "ws").select("left_id", "b.right_id", (-F.col("b.lower")).alias("score"))


def nearest(left: DataFrame, right: DataFrame, left_id: str = "_ordinal", left_title: str = "title", right_id: str = "_ordinal", right_title: str = "title") -> DataFrame:
    """(left_id, right_id, score): the best right row for each left row that shares a word with any, however low its score;
    the smaller id wins ties. Words that are common to many titles aren't joined on where a bound tells that what they
    alone would bring can't win."""
    rows, offers = _sides(left, right, left_id, left_title, right_id, right_title)
    classed = _classed(offers)
    rank = _rank(classed)
    placed = _placed(rows.select("ws").distinct(), rank)
    singles = _singles(placed, classed)
    return _best(rows, singles.unionByName(_scored(_beating(placed, classed, rank, singles))))


def enriched_matches(listings: DataFrame, devices: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The matched device of each listing that has one: the device's columns, realTitle (the listing's), images never
    null and dbRecordId. _ordinal is the listing's, so later ties keep the listings' order."""
    found = best_matches(listings, devices, threshold=threshold)
    titles = listings.select(F.col("_ordinal").alias("left_id"), F.col("title").alias("realTitle"))
    rows = found.join(_merged(titles), "left_id").join(_merged(devices.withColumnRenamed("_ordinal", "right_id")), "right_id")
    rest = [c for c in devices.columns if c not in ("_ordinal", "images")]
    return rows.select(*rest, F.coalesce("images", F.array().cast("array<string>")).alias("images"), "realTitle", F.col("_id").alias("dbRecordId"), F.col("left_id").alias("_ordinal"))


def match_steps(listings: DataFrame, devices: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(_ordinal, title, step): for each listing whether it matched, its best score, the device and, if not, why. Only
    listings without a match are looked at again, for the best of what shares any word with them."""
    above = best_matches(listings, devices, threshold=threshold)
    rest = listings.join(_merged(above.select(F.col("left_id").alias("_ordinal"))), "_ordinal", "left_anti")
    best = above.union(nearest(rest, devices)).withColumnRenamed("left_id", "_ordinal")
    rows = listings.select("_ordinal", "title").join(_merged(best), "_ordinal", "left")
    matched = F.coalesce(F.col("score") > threshold, F.lit(False))
    score = F.coalesce("score", F.lit(0.0))
    reason = F.when(~matched, F.concat(F.lit("Match score "), text.number_text(score), F.lit(f" below threshold {threshold}")))
    details = F.to_json(F.struct(matched.alias("matched"), score.alias("score"), F.col("right_id").alias("dbProduct"), reason.alias("reason")))
    return rows.select("_ordinal", "title", F.struct(F.lit("dbMatch").alias("name"), details.alias("details")).alias("step"))
