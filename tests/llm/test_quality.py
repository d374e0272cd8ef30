"""Quality rules against a plain reading of the texts, and odd tables. test_corpus holds them against SQL."""

import random
import re
from collections import Counter

from clipgraph_spark.llm import quality

WORD = "[^ \t\n\x0b\x0c\r]+"


def plain(text):
    words = re.findall(WORD, text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_base_equals_plain(spark):
    rng = random.Random(3)
    texts = ["", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a", "a b a b a", "x\n\nx\n \nx y\r\nx", "𝒳 é|ß # <𝒳>\x0b$\x0c&", "no\x85break here now", None]
    texts += ["".join(rng.choices(["a", "b", "é", "𝒳", " ", "\n", " ", "|", "."], k=rng.randint(1, 200))) for _ in range(200)]
    texts += [" ".join(rng.choices("abcdefgh", k=300)) for _ in range(5)] + ["w " * 40_000, "\n".join(f"line {i % 700} of many." for i in range(40_000))] * 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: tuple(r)[1:6] for r in quality.line_rules(df).collect()}
    assert got == {i: plain(t or "") for i, t in enumerate(texts)}



def verdict(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return sorted(quality.line_rules(df).collect(), key=lambda r: r["doc_id"])


def prose(n, seed=0):
    rng = random.Random(seed)
    return "\n".join(" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(12)) + "." for _ in range(n))


def test_lines(spark):
    lines = ["Home | About | Contact", "Read more »", "All rights reserved.", "Licensed under the Apache License, Version 2.0.", "BUY!! NOW!! CHEAP!! WOW", "no end to this line of words", "“Quoted,” they said.", "", "終わり。", "A heading: "]
    (r,) = verdict(spark, prose(20) + "\n" + "\n".join(lines))
    assert (r["n_navigation"], r["n_boilerplate"], r["n_punctuation"], r["n_lines"]) == (2, 2, 2, 29)
    assert r["clean_text"] == prose(20) + "\n" + "\n".join(lines[6:]) and r["kept"]
    assert r["lost_chars"] == sum(len(re.sub(r"\s", "", x)) for x in lines[:6])
    long_ = "He wrote of copyright and " + "of many other things that were on his mind " * 5 + "."
    (r,) = verdict(spark, long_ + "\n" + prose(5).replace(".\n", ". ") + " and so")
    assert r["n_boilerplate"] == r["n_punctuation"] == 0


def test_verdicts(spark):
    menu = "\n".join(" | ".join(x.split()) for x in prose(8, 1).split("\n"))
    half, most, clean, short, again, none = verdict(spark, prose(30) + "\n" + menu, prose(6) + "\n" + menu, prose(9), "Too short.", "one two three. " * 60, None)
    assert half["kept"] and not most["kept"] and not most["base_failed"] and clean["kept"]
    assert short["base_failed"] and again["base_failed"] and again["n_repeat_words"] == 180 and none["base_failed"] and not none["kept"] and none["n_words"] == 0 and none["clean_text"] == ""


def test_odd_tables(spark):
    rows = [(1, prose(9), "a", "b", 3)] * 2 + [(None, None, "a", None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _words string, _judged string, n int")
    out = quality.line_rules(df, ("doc_id", "_words", "_judged", "n")).collect()
    assert len(out) == 3 and out[0]["_words"] == "a" and sum(r["kept"] for r in out) == 2
    assert quality.line_rules(df.limit(0)).count() == 0
