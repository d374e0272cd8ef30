"""Blueprint dedup, usage and ranks, summaries, priorities and topic blocks against plain Python."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from clipgraph_spark.functions import text as T
from clipgraph_spark.operators import dedup, stories, topics
from clipgraph_spark.registry import queries

DIR = "/root/testdata/sf0.001"


def cosine(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    norm = math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))
    return sum(n * b[w] for w, n in a.items()) / norm if norm else 0.0


def test_blueprint_dedup(spark):
    rng, rows = random.Random(6), []
    for j in (1, 2):
        for i in range(60):
            old = rng.choice(rows)[3] if rows and rng.random() < 0.6 else [f"s{rng.randint(0, 30)}" for _ in range(25)]
            ids = old if rng.random() < 0.5 else [*old[:-1], f"s{rng.randint(0, 30)}"] if rng.random() < 0.5 else old[: rng.randint(3, len(old))]
            text = " ".join(rng.choices("abcdefghijklmnop", k=12)) if rng.random() < 0.7 else "a b c d e f g h " + rng.choice("xyz")
            rows.append((j, f"bp_{i}#0", i, list(ids), text))
    df = spark.createDataFrame(rows, "job_id int, id string, ord int, segment_ids array<string>, text string").withColumn("signature", T.signature(F.lit("s"), F.col("segment_ids")))
    kept, gone = dedup.blueprint_dedup(df)
    want_kept, want = set(), {}
    for job in (1, 2):
        accepted, seen = [], set()
        for _, i, _, ids, text in (r for r in rows if r[0] == job):
            fate = ("exact_duplicate", "Identical segment sequence already exists") if tuple(ids) in seen else None
            for k, other, words in accepted if fate is None else ():
                share = len(set(ids) & set(other)) / max(len(set(ids) | set(other)), 1)
                if share >= 0.95:
                    fate = "near_duplicate", f"{share * 100:.0f}% overlap with {k}"
                elif round(cosine(text, words), 9) >= 0.9:
                    fate = "narrative_duplicate", f"Similarity {cosine(text, words):.2f} with {k}"
                if fate:
                    break
            if fate:
                want[job, i] = fate
            else:
                want_kept.add((job, i))
                accepted.append((i.split("#")[0], ids, text))
                seen.add(tuple(ids))
    got = {(r["job_id"], r["id"]): (r["reason"], r["detail"]) for r in gone.collect()}
    assert {(r["job_id"], r["id"]) for r in kept.collect()} == want_kept
    assert got == want
    assert {"exact_duplicate", "near_duplicate", "narrative_duplicate"} <= {r for r, _ in got.values()}


def test_summaries_and_priorities(spark):
    s = spark.createDataFrame([(1, "a", ["x", "y", "z"], "given", "A", 0.5), (1, "b", ["x", "y", "z", "q", "r", "t"], "", "B", 0.9), (1, "c", ["q"], None, "C", 0.9), (2, "a", ["x"], "", "D", 0.1)], "job_id int, story_id string, segment_ids array<string>, summary string, name string, story_quality_score double")
    a = spark.createDataFrame([(1, "x", "t1", ["k1", "k2", "k3", "k4"]), (1, "z", None, ["k5"]), (1, "y", "t2", []), (1, "t", "t3", ["late"])], "job_id int, segment_id string, topic string, keywords array<string>")
    got = {(r["job_id"], r["story_id"]): (r["validated_summary"], r["story_priority"]) for r in stories.story_priority(stories.validated_summary(s, a)).collect()}
    assert got == {(1, "a"): ("given", 3), (1, "b"): ("t1: k1, k2, k3. : k5.", 1), (1, "c"): ("C", 2), (2, "a"): ("D", 1)}


def test_usage_and_ranks(spark):
    kept = queries()["l5_blueprints"](spark, DIR).collect()
    ranks = defaultdict(list)
    for r in kept:
        ranks[r["job_id"]].append(r)
    for rows in ranks.values():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert [r["blueprint_confidence"] for r in rows] == sorted((r["blueprint_confidence"] for r in rows), reverse=True)
    ids = defaultdict(set)
    for r in kept:
        ids[r["job_id"]].add(r["blueprint_id"])
    use = queries()["l5_segment_usage"](spark, DIR).collect()
    assert use and all(r["usage_count"] == len(r["blueprint_ids"].split(",")) and set(r["blueprint_ids"].split(",")) <= ids[r["job_id"]] for r in use)


def test_topic_blocks(spark):
    segs = spark.createDataFrame([(j, f"s{i}", i) for j, n in ((1, 9), (2, 3), (3, 5)) for i in range(n)], "job_id int, segment_id string, ord int")
    found = spark.createDataFrame([(1, 0, 1.0), (1, 3, 0.7), (1, 7, 0.4), (2, 0, 1.0), (2, 1, 0.9), (3, 0, 1.0)], "job_id int, at int, structural_confidence double")
    rows = lambda tail: sorted((r["job_id"], r["ord"], r["block_idx"], r["structural_confidence"]) for r in topics.topic_blocks(segs, found, tail).collect())
    closed = [(1, i, 0, 0.7) for i in range(3)] + [(1, i, 1, 0.4) for i in range(3, 7)] + [(2, i, 0, 1.0) for i in range(3)]
    assert rows("drop") == closed
    assert rows("keep") == sorted(closed + [(1, i, 2, 1.0) for i in (7, 8)] + [(3, i, 0, 1.0) for i in range(5)])
