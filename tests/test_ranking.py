"""The ranking stages that SQL does not cover, row by row against plain Python on the small tables."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from clipgraph_spark.config import CLAIMS, NEW_TOPIC, STAGE_WEIGHTS
from clipgraph_spark.operators import evaluation, ranking
from clipgraph_spark.plans import bindings

DIR = "/root/testdata/sf0.001"
STAGES = ("hook_quality", "narrative", "context", "density", "retention", "novelty")


@pytest.fixture(scope="module")
def candidates(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("candidates"))
    bindings.ranking_candidates(spark, DIR).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def ranked(candidates):
    out, gone, funnel = ranking.rank(candidates, 5)
    return out.cache(), gone, funnel


def cosine(a, b):
    """Of the bags of words; buckets of different words differ but by rare chance."""
    a, b = Counter(a), Counter(b)
    norm = math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))
    return round(sum(n * b[w] for w, n in a.items()) / norm, 9) if norm else 0.0


def close(a, b, tol=2e-4):
    return abs(a - b) <= tol


def test_narrative(candidates):
    rows = ranking.narrative(ranking.with_vectors(candidates)).collect()
    before = {(r["job_id"], r["id"]): r["raw_score"] for r in candidates.collect()}
    assert len(rows) == len(before) > 0
    for r in rows:
        hook, body, end = r["hook_v"], r["body_v"], r["ending_v"]
        hb, be = cosine(hook, body), cosine(body, end)
        semantic = (0.35 if hb > 0.4 else 0.2 if hb > 0.2 else 0.05) + (0.25 if be > 0.3 else 0.15 if be > 0.15 else 0.05) + (0.15 if body else 0.05)
        words = [set(r[c].lower().split()) for c in ("hook_text", "body_text")]
        share = len(words[0] & words[1]) / max(len(words[0]), 1)
        claim = "?" in r["hook_text"] or any(w in r["hook_text"].lower() for w in CLAIMS)
        fresh = r["ending_text"].lower().strip().startswith(tuple(NEW_TOPIC))
        score = min(0.6, semantic) + (0.15 if share > 0.3 and hb > 0.3 else 0.08 if share > 0.1 else 0) + (0.15 if claim else 0.05) + (0.02 if fresh else 0.1)
        conf = ((0.9 if hb > 0.3 else 0.6) + min(0.8, 0.5 + share) + (0.85 if claim else 0.5) + (0.45 if fresh else 0.8)) / 4
        assert close(r["narrative_score"], min(1.0, score)) and close(r["narrative_confidence"], conf)
        raw = before[r["job_id"], r["id"]]
        assert close(r["raw_score"], raw * 0.7 if r["narrative_score"] < 0.3 else raw)


def by_job(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["job_id"]].append(r)
    return out


def test_novelty(candidates):
    rows = ranking.novelty(ranking.with_vectors(candidates)).collect()
    for group in by_job(rows).values():
        kept, seen = [], []
        for r in sorted(group, key=lambda r: (-r["raw_score"], r["rank"])):
            best = 0.0
            for k in kept:
                best = max(best, cosine(r["v"], k))
                if best >= 0.75:
                    break
            near = any(abs(r["hook_start"] - h) < 2 and abs(r["body_start"] - b) < 5 for h, b in seen)
            seen.append((r["hook_start"], r["body_start"]))
            want = (max(0.1, 1 - best), 0.92) if best >= 0.75 else (0.25, 0.95) if near else (0.9, 0.88)
            if best < 0.75 and not near:
                kept.append(r["v"])
            assert close(r["novelty_score"], want[0]) and r["novelty_confidence"] == want[1]


def test_final_scores(ranked):
    for r in ranked[0].collect():
        total = sum(r[f"{s}_score"] * r[f"{s}_confidence"] * w for s, w in STAGE_WEIGHTS.items())
        conf = sum(r[f"{s}_confidence"] * w for s, w in STAGE_WEIGHTS.items())
        assert close(r["final_score"], total / max(conf, 0.001) * 0.7 + r["raw_score"] * 0.3)
        assert close(r["overall_confidence"], conf / sum(STAGE_WEIGHTS.values()))


def test_ranks_and_explanations(ranked):
    rows = ranked[0].collect()
    sizes = {r["job_id"]: r["n_passed"] for r in ranked[2].collect()}
    for group in by_job(rows).values():
        group.sort(key=lambda r: r["final_rank"])
        assert [r["final_rank"] for r in group] == list(range(1, len(group) + 1)) and len(group) <= 5
        if sizes[group[0]["job_id"]] <= 5:
            assert [r["position"] for r in group] == sorted(r["position"] for r in group)
        else:
            assert [r["final_score"] for r in group] == sorted((r["final_score"] for r in group), reverse=True)
        for r, after in zip(group, [*group[1:], None], strict=True):
            scores = [r[f"{s}_score"] for s in STAGES]
            best, worst = scores.index(max(scores)), scores.index(min(scores))
            parts = [f"Rank #{r['final_rank']} with score {r['final_score']} (confidence: {r['overall_confidence']})"]
            parts += [f"Strongest signal: {STAGES[best]} ({scores[best]})", f"Weakest signal: {STAGES[worst]} ({scores[worst]})"]
            parts += [f"Leads next candidate by {r['final_score'] - after['final_score']:.4f}"] if after else []
            assert r["explanation"] == " | ".join(parts)


def test_positions(candidates):
    c = ranking.with_vectors(candidates)
    scored = ranking.final_score(ranking.novelty(ranking.retention(ranking.density(ranking.hook_quality(ranking.context(ranking.narrative(c)))))))
    for group in by_job(ranking.tie_break(scored).collect()).values():
        key = lambda r: (-round(r["final_score"] + 1e-12, 3), -r["overall_confidence"], -r["hook_quality_score"], r["duration"], r["hook_start"], r["id"])
        assert [r["id"] for r in sorted(group, key=lambda r: r["position"])] == [r["id"] for r in sorted(group, key=key)]


def test_preview_and_labels(candidates, ranked):
    preview = ranking.preview(candidates, ranked[0], 3)
    kept = {(r["job_id"], r["id"]) for r in ranked[0].collect()}
    want = {}
    for job, group in by_job(candidates.collect()).items():
        own = [r["id"] for r in sorted(group, key=lambda r: r["rank"]) if (job, r["id"]) in kept][:3]
        want |= {(job, i): n + 1 for n, i in enumerate(own)}
    assert {(r["job_id"], r["id"]): r["preview_pos"] for r in preview.collect()} == want
    labels = sorted((r["job_id"], r["id"], r["label"]) for r in evaluation.learning_labels(preview, ranked[0]).collect())
    late = [(r["job_id"], r["id"], "rejected") for r in ranked[0].collect() if 4 <= r["final_rank"] <= 10]
    assert labels == sorted([(*k, "accepted") for k in want] + late)


def test_confidence(spark):
    df = spark.createDataFrame([(0.85, 1.0), (0.6, 0.5), (0.4, 0.333333), (0.39999, 0.0)], "c double, s double")
    got = df.select(ranking.confidence_level(F.col("c")).alias("level"), ranking.confidence_weighted(F.col("s"), F.col("c")).alias("w"), ranking.confidence(F.col("c"), F.col("s")).alias("mean")).collect()
    assert [r["level"] for r in got] == ["high", "moderate", "low", "no_trust"]
    assert [r["w"] for r in got] == [0.85, 0.3, 0.1333, 0.0] and got[0]["mean"] == 0.925
