"""Removed bytes against all windows of a small corpus."""

import hashlib
import random
from collections import Counter

import numpy as np

from clipgraph_spark.llm import suffix_dedup as S


def plain(texts, length):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng, n, length):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(length // rng.randint(3, 7)) for _ in range(5)]
    out = [None, "", "short", "a" * (3 * length), "ab" * length, "ab" * (length + 3)]
    for _ in range(n):
        t = text(rng.randint(1, length))
        for _ in range(rng.randint(0, 3)):
            t += rng.choice([" ", ""]) + rng.choice(passages) + rng.choice([" ", "", text(3)])
        out.append(t)
        if rng.random() < 0.3:
            u = rng.choice([x for x in out if x])
            k = rng.randrange(len(u))
            out.append(rng.choice([u, u[:k] + "X" + u[k + 1 :], u + u[: k + 1], u[k:] + text(4)]))
    return out


def check(spark, texts, length):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.remove_repeats(df, length).collect()}
    want = plain(texts, length)
    assert [got[i] for i in range(len(texts))] == want


def test_small_windows(spark):
    check(spark, corpus(random.Random(1), 60, 40), 40)
    check(spark, corpus(random.Random(2), 40, 64), 64)


def test_pieces_and_buckets(spark, monkeypatch):
    rng = random.Random(5)
    hot = "".join(rng.choice("xyz ") for _ in range(70))
    texts = corpus(rng, 30, 40) + [f"{i} {hot} {i * 7}" for i in range(200)] + [hot[rng.randrange(30) :] + str(rng.random()) for _ in range(60)]
    check(spark, texts, 40)


def test_runs_cover_all_windows():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 4, 3000).astype(np.uint8)
    offsets = np.array([0, 10, 10, 900, 901, 3000])
    r = S.runs_of(data, offsets, 40)
    starts = [s for a, b in zip(r.low, r.high, strict=True) for s in range(a, b + 1)]
    assert starts == [s for i in range(5) for s in range(offsets[i], offsets[i + 1] - 39)]


def test_sort():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (500, 6), dtype=np.uint64)
    order = S.multikey_quicksort(words, small=4)
    assert [tuple(words[i]) for i in order] == sorted(map(tuple, words))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(df).count() == 0


def test_passages(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    text = lambda n: [word() for _ in range(n)]
    shared, short, own = text(60), text(50), text(51)
    rows = [text(5) + shared + text(9), shared, text(70) + short, short + text(80), own + text(3) + own, shared[:51] + ["x"] + shared[9:], text(200), [], ["w"] * 200]
    rows += [rows[6]] + [text(30) + shared[i : i + 51 + i % 3] + text(20) for i in range(8)]
    df = spark.createDataFrame([(i, (" " if i % 2 else "\n").join(r), 0) for i, r in enumerate(rows)] + [(99, None, 0)], "doc_id long, text string, block int").repartition(3)
    got = {r["doc_id"]: r["n_passage_words"] for r in S.remove_repeats(df, 400).collect()}
    where = {}
    for i, r in enumerate(rows):
        for k in range(len(r) - 50):
            where.setdefault(tuple(r[k : k + 51]), set()).add(i)
    for i, r in enumerate(rows):
        assert got[i] == len({j for k in range(len(r) - 50) if len(where[tuple(r[k : k + 51])]) > 1 for j in range(k, k + 51)})
    assert got[99] == 0 and got[0] == 60 and got[2] == got[4] == 0
