"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the form each word is a variant of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

LETTERS = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: One run in so many has a letter left out, so that a corpus holds variants of every word.
DROP = 199
#: A word's form has at least so many times the word's count.
FACTOR = 5
#: Chunks that more words than this share are left to the exact way for crowded chunks.
CROWD = 64


def typed_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop: int = DROP) -> DataFrame:
    """(word, n): the words of whole texts with their occurrences, from `least_length` code points and `least_count` on.

    Words are maximal runs of LETTERS with A-Z lower-cased. Where `drop` divides the crc32 of `<doc_id>:<run>` (a null
    doc_id reads "null") the code point at that number modulo the length is left out. Null texts have no words.
    """
    # a run that is too short as it stands gives no word, as letters are only left out
    run = F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), run.alias("run")).select("id", ascii_lower(F.col("run")).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    left = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % drop == 0, left).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _piece(length: Column, place: Column, text: Column) -> Column:
    return F.struct(length.alias("length"), place.alias("place"), text.alias("piece"))


def chunks(words: DataFrame) -> DataFrame:
    """A word's two disjoint chunks, each half of it: (x, x_n, length, place, piece), place 0 for the first, 1 for the last."""
    size, q = F.length("word"), F.floor(F.length("word") / 2).cast("int")
    both = F.array(_piece(size, F.lit(0), F.substring("word", F.lit(1), q)), _piece(size, F.lit(1), F.substring("word", size - q + 1, q)))
    return words.select(F.col("word").alias("x"), F.col("n").alias("x_n"), F.explode(both).alias("c")).select("x", "x_n", "c.*")


def grams(words: DataFrame) -> DataFrame:
    """A word's positional grams that lie within shift one of a chunk of a word as long or one shorter.

    (y, y_n, length, place, piece): length is that of the shorter word, and place tells which of its chunks.
    """
    size, found = F.length("word"), []
    for shorter in (0, 1):
        length = size - shorter
        q = F.floor(length / 2).cast("int")
        for place, start in ((0, F.lit(0)), (1, length - q)):
            for shift in (-1, 0, 1):
                at = start + shift
                fits = (length >= 1) & (at >= 0) & (at + q <= size)
                found.append(F.when(fits, _piece(length, F.lit(place), F.substring("word", at + 1, q))))
    every = F.explode(F.array_distinct(F.array_compact(F.array(*found))))
    return words.select(F.col("word").alias("y"), F.col("n").alias("y_n"), every.alias("c")).select("y", "y_n", "c.*")


KEY = ["length", "place", "piece"]


def crowded(chunk_rows: DataFrame, gram_rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The keys that more than `crowd` words have on either side, if both sides have them."""
    count = lambda rows, side: rows.select(*KEY, F.lit(side).alias("side"))
    both = count(chunk_rows, 0).unionByName(count(gram_rows, 1)).groupBy(*KEY).agg(F.count_if(F.col("side") == 0).alias("c"), F.count_if(F.col("side") == 1).alias("g"))
    return both.where((F.least("c", "g") > 0) & (F.greatest("c", "g") > crowd)).select(*KEY)


def _one_letter_out(words: DataFrame) -> DataFrame:
    """(word, n, at, rest): the word without the code point at each place."""
    places = F.explode(F.sequence(F.lit(1), F.length("word")))
    rest = F.concat(F.substring("word", F.lit(1), F.col("at") - 1), F.substring("word", F.col("at") + 1, F.length("word")))
    return words.where(F.length("word") > 0).select("word", "n", places.alias("at")).withColumn("rest", rest)


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows as a side of a join that is dealt by its keys, never broadcast: Spark takes exploded rows for as few as
    the words they come from, and all of them would go through the driver."""
    return rows.hint("merge")


def crowd_links(words: DataFrame) -> DataFrame:
    """(x, x_n, y, y_n) of all words one edit apart, for words that share crowded chunks.

    Words that agree without the letter at one place differ there alone, and a word that is another without one letter
    lacks that letter alone: each row is a link, so a group of very many words makes no more rows than it has links
    and letters.
    """
    out = _one_letter_out(words)
    a, b = (out.select("at", "rest", F.col("word").alias(w), F.col("n").alias(f"{w}_n")) for w in "xy")
    replaced = a.join(_dealt(b), ["at", "rest"]).where("x < y").select("x", "x_n", "y", "y_n")
    shorter = words.select(F.col("word").alias("x"), F.col("n").alias("x_n"))
    inserted = shorter.join(_dealt(out.select(F.col("rest").alias("x"), F.col("word").alias("y"), F.col("n").alias("y_n"))), "x")
    return replaced.unionByName(inserted.select("x", "x_n", "y", "y_n"))


def links(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(x, x_n, y, y_n), once for each pair of words that differ by one inserted, deleted or replaced code point.

    The shorter word gives two disjoint chunks; one edit leaves one of them whole, in the other word, shifted by one at
    most. Words that meet on a chunk are verified. Chunks that more than `crowd` words share are joined by no pairs:
    their words go by crowd_links, which finds all their links.
    """
    c, g = chunks(words), grams(words)
    hot = _dealt(materialize(crowded(c, g, crowd), "crowded"))
    meet = c.join(hot, KEY, "left_anti").join(_dealt(g), KEY).where((F.length("y") > F.col("length")) | (F.col("x") < F.col("y")))
    found = meet.where(F.levenshtein("x", "y", 1) == 1).select("x", "x_n", "y", "y_n")
    if not hot.isEmpty():
        members = c.join(hot, KEY, "left_semi").select(F.col("x").alias("word"), F.col("x_n").alias("n")).unionByName(g.join(hot, KEY, "left_semi").select(F.col("y").alias("word"), F.col("y_n").alias("n")))
        found = found.unionByName(crowd_links(materialize(members.distinct(), "crowd")))
    return found.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form that following forms from each word reaches, by doubling the reach.

    A form's count is several times its word's, so there are no rings, and a few rounds reach the end.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(now.join(_dealt(ahead), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def variants(words: DataFrame, factor: int = FACTOR, crowd: int = CROWD) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of (word, n).

    form is the near word of largest n (ties: smallest in code-point order) if that is at least `factor` times the word's
    n, else null. Rows of the same word are added up; null and empty words and words without occurrences are dropped, other
    columns are not read; an empty table gives an empty result.
    """
    if factor <= 1:
        raise ValueError("a form needs more occurrences than its word")
    words = materialize(words.where("word != ''").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "words")
    pairs = materialize(links(words, crowd), "spelling")
    both = pairs.select(F.col("x").alias("word"), F.col("y").alias("other"), F.col("y_n").alias("m")).unionByName(pairs.select(F.col("y").alias("word"), F.col("x").alias("other"), F.col("x_n").alias("m")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("other"))).alias("best"))
    has = -F.col("best.m") >= factor * F.col("n")
    out = words.join(_dealt(near), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n"))
    out = materialize(out, "forms")
    return out.join(_dealt(roots(out.where("form is not null"))), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), F.col("n").cast("long").alias("n"), "n_near", F.col("form_n").cast("long").alias("form_n"))


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(typed_words(table(spark, sf_dir, "documents")))
