"""Spelling variants by anagram hashing.

A word's key is the sum of its letters' fifth powers, so all orders of the same letters share a key, and one letter
added, removed or exchanged moves it by that letter's power or by a difference of two. Words whose keys differ so are
found by joining: a word stands under its key and under its key less each of its letters. A key less a letter meets
another word's whole key where a letter was removed (or, seen from there, added), and another word's key less a letter
where letters were exchanged: K(v) - a = K(w) - b is an exchange value of a - b. Only then is the order of letters
verified. Exchanges are joined by the letter's place as well, at which both words must differ, which deals a large
anagram class over the places of its letters; words longer than the alphabet stand once a letter instead, so that what is
made of a word grows like its length and not like the square. Two near words meet exactly once, as no two differences of
two letters' powers are equal.

Sums are taken modulo a prime, so that no word is too long for them; what meets is verified in any case.

Joins are sort-merge joins by hint. A staged table's size on disk, from which Spark would estimate, tells little of what its
words take once they stand under each of their letters, and a broadcast passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, staged

POWER, MODULUS = 5, (1 << 61) - 1
LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, LEAST, LEAD = 7, 2, 10
#: One in so many occurrences loses a letter.
SLIP = 31
#: Letters there are; words of more have no place for each of them.
ALPHABET = 90

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _mod(x: Column) -> Column:
    return F.pmod(x, F.lit(MODULUS))


def _power(letter: Column) -> Column:
    """A letter's value. Letters are code points up to 255, whose powers of five are whole numbers in a double."""
    return F.pow(F.ascii(letter).cast("double"), F.lit(float(POWER))).cast("long")


def anagram_key(word: Column) -> Column:
    """The sum of a word's letter values."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda k, c: _mod(k + _power(c)))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): the runs of letters of all texts, lower-cased in A-Z, of so many letters and occurrences at least.

    One in SLIP occurrences, by the crc32 of id and run, has lost a letter. Counts are summed in every task before the
    shuffle, so a common word is a row a task.
    """
    # A run that is too short stays so; runs of enough letters are matched whole, from their first letter on.
    runs = F.regexp_extract_all(F.translate(F.col(text_col), _UPPER, _LOWER), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    hashed = each.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): both directions of all pairs that differ by one inserted, deleted or replaced letter."""
    keyed = words.select("word", "n", F.length("word").alias("size"), anagram_key(F.col("word")).alias("key"))
    placed = lambda c, i: F.struct(i.alias("at"), c.alias("letter"))
    places = F.when(F.col("size") <= ALPHABET, F.transform(F.split("word", ""), placed)).otherwise(F.transform(F.array_distinct(F.split("word", "")), lambda c: placed(c, F.lit(-1))))
    less = keyed.select("word", "n", "size", "key", F.explode(places).alias("p")).select("word", "n", "size", _mod(F.col("key") - _power(F.col("p.letter"))).alias("key"), "p.at", "p.letter")
    a, b = less.alias("a"), less.alias("b")
    # Inside the join, so that no more leaves it than pairs of near words.
    swapped = a.join(_merged(b), (F.col("a.key") == F.col("b.key")) & (F.col("a.at") == F.col("b.at")) & (F.col("a.size") == F.col("b.size")) & (F.col("a.letter") != F.col("b.letter")) & _one_edit("a.word", "b.word"))
    # Once for each letter of a word, as it may be removed from any place of a run of equal ones.
    first = less.where((F.col("at") < 0) | (F.instr("word", F.col("letter")) == F.col("at") + 1))
    c, d = first.alias("c"), keyed.alias("d")
    removed = c.join(_merged(d), (F.col("c.key") == F.col("d.key")) & (F.col("c.size") == F.col("d.size") + 1) & _one_edit("c.word", "d.word"))
    told = lambda df, x, y: df.select(F.col(f"{x}.word").alias("word"), F.col(f"{x}.n").alias("n"), F.col(f"{y}.word").alias("other"), F.col(f"{y}.n").alias("other_n"))
    return told(swapped, "a", "b").union(told(removed, "c", "d")).union(told(removed, "d", "c"))


def _merged(side: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast."""
    return side.hint("merge")


def _one_edit(v: str, w: str) -> Column:
    return F.levenshtein(F.col(v), F.col(w), 1) == 1


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, lead: int = LEAD) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a row for each word of the vocabulary.

    form: the near word of the largest count, of equal ones the first by code points, if it is `lead` times the word's own
    at least. root: where forms lead from the word, itself without a form. n_near: how many near words there are. Null and
    empty texts have no words, a missing id counts as the empty text; repeated rows count as often as they stand. Texts
    and words of any length are taken whole. An empty table gives an empty result; further columns are never read.
    """
    words = staged(vocabulary(docs, id_col, text_col, shortest, least), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word"))).alias("b")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(_merged(near), "word", "left")
    leads = -F.col("b.less") >= lead * F.col("n")
    told = staged(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, F.col("b.word")).alias("form"), F.when(leads, -F.col("b.less")).alias("form_n")), "forms")
    roots = _roots(told)
    return told.join(_merged(roots), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(told: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form. Counts grow along forms, so they end, and each round doubles how far
    a row has got: the rounds are as many as the longest way has binary digits."""
    now = staged(told.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = staged(now.join(_merged(ahead), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = after.where("moved").limit(1).count()
        discard(now)
        now = after.drop("moved")
        if not moved:
            return now
