"""Spelling variants against all pairs, and typed words against a plain reading of the texts."""

import random
import re
import zlib
from collections import Counter

import pytest

from clipgraph_spark.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, factor=5):
    form, n_near = {}, {}
    for w in counts:
        others = [(-counts[o], o) for o in counts if near(w, o)]
        n_near[w] = len(others)
        best = min(others, default=None)
        form[w] = best[1] if best and -best[0] >= factor * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, n_near[w], counts[form[w]] if form[w] else None) for w, n in counts.items())


def rows(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def words(rng, n):
    base = ["".join(rng.choices("abé", k=rng.randint(5, 9))) for _ in range(n)]
    out = set(base)
    for w in base:
        for _ in range(4):
            i, how = rng.randrange(len(w)), rng.random()
            out.add(w[:i] + w[i + 1 :] if how < 0.3 else w[:i] + rng.choice("abcß") + w[i + (how < 0.7) :])
    return {w: rng.choice([5, 6, 30, 160, 900, 4600]) for w in out}


@pytest.mark.parametrize("crowd", [0, 3, 64])
def test_equals_all_pairs(spark, crowd):
    counts = words(random.Random(crowd), 60)
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert rows(spelling.variants(df, crowd=crowd)) == plain(counts)


def test_crowded_halves(spark):
    """A third and more of the words begin alike, another lot end alike; all links are found without their pairs."""
    rng = random.Random(5)
    heads = {"interc" + "".join(rng.choices("abcdefgh", k=6)) for _ in range(400)}
    tails = {"".join(rng.choices("abcdefgh", k=6)) + "mented" for _ in range(300)}
    some = sorted(heads)[:60] + sorted(tails)[:60]
    counts = {w: rng.randint(5, 500) for w in heads | tails | {w[:-1] for w in some} | {"x" + w for w in some}}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    hot = spelling.crowded(spelling.chunks(df), spelling.grams(df)).collect()
    assert {r["piece"] for r in hot} >= {"interc", "mented"}
    assert rows(spelling.variants(df)) == plain(counts)


def test_typed_words(spark):
    rng = random.Random(9)
    vocab = ["Straße", "étrange", "hôtels", "Working", "WORKING", "l'Œuvre", "naïveté", "×signs÷", "don't", "planet9mars", "𝒳letters", "short", "longerword"]
    texts = [(i, " ".join(rng.choices(vocab, k=300)), "c", i) for i in range(30)] + [(None, "planets " * 400, "c", 0), (None, None, "c", 0), (7, "", "c", 0), (2, "y" * 30_000 + " " + "y" * 30_000, "c", 0)] * 3
    want = Counter()
    for doc_id, text, *_ in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                want[w] += 1
    df = spark.createDataFrame(texts, "doc_id long, text string, word string, n long")
    got = {r["word"]: r["n"] for r in spelling.typed_words(df).collect()}
    assert got == {w: n for w, n in want.items() if n >= 5} and "y" * 30_000 in got
    assert rows(spelling.variants(spelling.typed_words(df))) == plain(got)


def test_odd_words(spark):
    counts = {"a": 9, "b": 60, "ab": 400, "abc": 2500}
    df = spark.createDataFrame([(w, n, "k") for w, n in counts.items()] + [("a", 1, "k"), (None, 4, "k"), ("zero", 0, "k"), ("", 7, "k")], "word string, n long, x string")
    assert rows(spelling.variants(df)) == plain(counts | {"a": 10})
    assert spelling.variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(df, factor=1)


@pytest.mark.parametrize("crowd", [0, 64])
def test_exploded_words_are_not_broadcast(spark, crowd):
    """chunks, grams and words without a letter, some ten rows a word, were taken for as few as the words and so
    broadcast through the driver (235 and 285 MB of 0.1 GB of texts)."""
    counts = words(random.Random(7), 40)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    written = spelling.materialize(df, "words")
    for part in (spelling.links(written, crowd), spelling.crowd_links(written), spelling.variants(written, crowd=crowd)):
        assert "Broadcast" not in part._jdf.queryExecution().executedPlan().toString()
    assert rows(spelling.variants(written, crowd=crowd)) == plain(counts)
