"""Line-first quality rules, in DataFrame functions only: lines that fail go, then documents that lose too much text."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, let, table

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: The base rules: fewer words, or a greater share (percent) of words in repeated windows of REPEAT words, fail.
LEAST_WORDS, MOST_REPEATED, REPEAT = 50, 50, 3
#: A line of prose ends in one of these, closing marks included, or has a sentence's end for each SENTENCE words.
ENDS = ".!?…。！？؟।:;\"”’»)]"
STOPS, SENTENCE = r"[.!?…。！？؟।]", 30
#: Marks of shouting and noise; a line fails with more of them than half its words.
SHOUTS = r"[!?#*$%&]{2,}"
#: A menu has at least MENU of these, and one for each four words.
SEPARATORS, MENU = r"[|»›•·]", 2
#: Links that stand alone on a line of up to LINK code points, and phrases of notices in lines of up to NOTICE.
LINKS = ("home", "menu", "next", "previous", "back to top", "read more", "log in", "sign up", "skip to content", "share", "about us", "contact us")
NOTICES = ("all rights reserved", "licensed under", "released under the", "general public license", "creative commons", "copyright", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies", "powered by", "enable javascript", "subscribe to our")
LINK, NOTICE = 60, 200
#: A document is rejected that loses more than this share (percent) of its words' characters.
MOST_LOST = 50
KINDS = ("navigation", "boilerplate", "punctuation")


def _chars(text: Column) -> Column:
    """Code points that are no white space."""
    return F.length(F.regexp_replace(text, SPACE, ""))


def _line(line: Column) -> Column:
    """(chars, kind) of a line: kind 0 for navigation, 1 for boilerplate, 2 for punctuation, null where it stays.

    A line without a word stays; chars are counted where it does not.
    """
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    like = lambda pattern: F.regexp_like(line, F.lit(pattern))

    def kind(odd):  # odd: the line has separators or shouts at all
        menu = odd & let(count(SEPARATORS), lambda marks: (marks >= MENU) & (marks * 4 >= count(WORD)))
        link = (F.length(line) <= LINK) & like(rf"(?i)^[\x20\x09-\x0D]*({'|'.join(LINKS)})[\x20\x09-\x0D.!»›>]*\z")
        notice = (F.length(line) <= NOTICE) & like("(?i)" + "|".join(NOTICES))
        last = F.substring(F.rtrim(line, F.lit(" \t\n\x0b\x0c\r")), -1, 1)
        ended = (F.instr(F.lit(ENDS), last) > 0) | (count(STOPS) * SENTENCE >= count(WORD))
        return F.when(~like(WORD), None).when(menu | link, 0).when(notice, 1).when(~ended | odd & (count(SHOUTS) * 2 > count(WORD)), 2).cast("int")

    return let(let(like(f"{SEPARATORS}|{SHOUTS}"), kind), lambda k: F.struct(k.alias("kind"), F.when(k.isNotNull(), _chars(line)).otherwise(0).alias("chars")))


def _is(kind: int, line: Column) -> Column:
    return line["kind"] == kind


def repeated_words(words: Column) -> Column:
    """How many words stand in windows of REPEAT words that the text has twice or more.

    Windows are told apart by 64-bit hashes. Those of a text with repeats are sorted with their places, so that equal
    ones are neighbours; the places of repeated ones, sorted again, cover up to REPEAT words each. n log n in a text's
    words.
    """

    def windows(w):
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - REPEAT), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(REPEAT)]))
        return F.when(F.size(w) >= REPEAT, hashes).otherwise(F.array().cast("array<long>"))

    def places(s):
        same = lambda a, k: F.coalesce(F.get(s, k)["g"] == a["g"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def covered(p):
        return F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(REPEAT), lambda n, k: n + F.least(F.lit(REPEAT), F.get(p, k) - F.get(p, k - 1)))

    def count(g):
        in_order = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(let(in_order, lambda s: let(places(s), covered)))

    return let(words, lambda w: let(windows(w), count))


def line_rules(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and, of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines
    (lines with a word), n_navigation, n_boilerplate, n_punctuation (lines removed by each rule, the first that holds),
    lost_chars and clean_text.

    Lines are cut at \\n and judged one by one; clean_text has the others, joined likewise. A document is kept if the
    base rules hold and it loses at most MOST_LOST percent of its words' characters. Null and empty texts have no words
    and fail; repeated rows are judged alike; other columns than `keep` and text are not read, and no name in `keep`
    clashes with those used inside, as long as it is not one of the result's; an empty table gives an empty result.
    """
    t, w, lines, judged = free_names(docs.select(*keep), "_text", "_words", "_lines", "_judged")
    d = docs.select(*keep, F.coalesce("text", F.lit("")).alias(t))
    d = d.select(*keep, t, F.filter(F.split(t, SPACE), lambda x: x != "").alias(w), F.split(t, "\n").alias(lines), F.transform(F.split(t, "\n"), _line).alias(judged))
    worded = F.filter(lines, lambda x: F.regexp_like(x, F.lit(WORD)))
    gone = F.filter(judged, lambda x: x["kind"].isNotNull())
    clean = F.array_join(F.filter(lines, lambda x, i: F.get(F.col(judged), i)["kind"].isNull()), "\n")
    counts = {
        "n_words": F.size(w), "word_chars": _chars(F.col(t)), "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)),
        "n_dup_lines": let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))), "n_repeat_words": repeated_words(F.col(w)), "n_lines": F.size(worded),
        **{f"n_{k}": F.size(F.filter(judged, partial(_is, i))) for i, k in enumerate(KINDS)},
        "lost_chars": F.aggregate(gone, F.lit(0), lambda n, x: n + x["chars"]),
    }
    d = d.select(*keep, *[c.cast("long").alias(n) for n, c in counts.items()], clean.alias("clean_text"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    first = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kept = ~failed & (100 * F.col("lost_chars") <= MOST_LOST * F.col("word_chars"))
    return d.select(*keep, *first, failed.alias("base_failed"), kept.alias("kept"), *[n for n in counts if n not in first], "clean_text")


def op12_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = line_rules(table(spark, sf_dir, "documents"))
    return out.select(*[c for c in out.columns if c != "clean_text"], F.sha2("clean_text", 256).alias("clean_sha256"))


def _sql_list(values) -> str:
    return "|".join(values)


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
m AS (SELECT rid, pos, line, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, len(regexp_extract_all(line, '{WORD}')) AS words,
             len(regexp_extract_all(line, '{SEPARATORS}')) AS marks, length(regexp_replace(line, '{SPACE}', '', 'g')) AS chars FROM l),
j AS (SELECT *, CASE WHEN words = 0 THEN NULL
        WHEN marks >= {MENU} AND marks * 4 >= words OR length(line) <= {LINK} AND regexp_matches(low, '^[\x20\x09-\x0D]*({_sql_list(LINKS)})[\x20\x09-\x0D.!»›>]*\z') THEN 0
        WHEN length(line) <= {NOTICE} AND regexp_matches(low, '{_sql_list(NOTICES)}') THEN 1
        WHEN NOT ((instr('{ENDS}', right(rtrim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1)) > 0 OR len(regexp_extract_all(line, '{STOPS}')) * {SENTENCE} >= words) AND len(regexp_extract_all(line, '{SHOUTS}')) * 2 <= words) THEN 2 END AS kind FROM m),
s AS (SELECT rid, count(*) FILTER (words > 0) AS n_lines, count(*) FILTER (words > 0) - count(DISTINCT line) FILTER (words > 0) AS n_dup_lines,
             count(*) FILTER (kind = 0) AS n_navigation, count(*) FILTER (kind = 1) AS n_boilerplate, count(*) FILTER (kind = 2) AS n_punctuation,
             coalesce(sum(chars) FILTER (kind IS NOT NULL), 0)::BIGINT AS lost_chars,
             sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kind IS NULL), '')) AS clean_sha256 FROM j GROUP BY rid),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY rid),
o AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars, len(regexp_extract_all(t, '{SYMBOLS}')) AS n_symbols,
             coalesce(n_repeat_words, 0) AS n_repeat_words, s.* EXCLUDE (rid) FROM d JOIN s USING (rid) LEFT JOIN r USING (rid))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * lost_chars <= {MOST_LOST} * word_chars AS kept FROM o
"""
