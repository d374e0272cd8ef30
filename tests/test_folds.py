"""Operators that SQL cannot express easily, against plain versions on the small tables."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from clipgraph_spark.operators import dedup, ranking, topics, transcript
from clipgraph_spark.plans import bindings

DIR = "/root/testdata/sf0.001"


def by_job(df, order):
    out = defaultdict(list)
    for r in df.collect():
        out[r["job_id"]].append(r)
    return {j: sorted(rows, key=lambda r: r[order]) for j, rows in out.items()}


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.fixture(scope="module")
def segments(spark):
    return bindings.segments(spark, DIR).cache()


@pytest.fixture(scope="module")
def sets(spark):
    return bindings.order_sets(spark, DIR, 60).cache()


def test_packed_windows(segments):
    got = by_job(transcript.pack_windows(segments, 60.0), "window_idx")
    for job, rows in by_job(segments, "ord").items():
        bins, total = [], 0.0
        for r in rows:
            d = r["end_s"] - r["start_s"]
            if bins and total + d <= 60.0:
                bins[-1].append(r)
                total += d
            else:
                bins.append([r])
                total = d
        assert [w["segment_ids"] for w in got[job]] == [[r["segment_id"] for r in b] for b in bins]
        assert [w["text"] for w in got[job]] == [" ".join(r["text"] for r in b) for b in bins]
        assert [(w["start_s"], w["end_s"]) for w in got[job]] == [(b[0]["start_s"], b[-1]["end_s"]) for b in bins]


def test_dynamic_windows(segments):
    got = {j: [(r["start_ord"], r["size"]) for r in rows] for j, rows in by_job(topics.dynamic_windows(segments), "window_idx").items()}
    for job, rows in by_job(segments, "ord").items():
        want, i = [], 0
        while i < len(rows):
            spent = lambda k: rows[min(i + k, len(rows)) - 1]["end_s"] - rows[i]["start_s"]  # noqa: B023, E731
            by_time = next((k for k in (5, 4) if spent(k) <= 60), 3)
            tokens = lambda k: len(" ".join(r["text"] for r in rows[i : i + k])) // 4  # noqa: B023, E731
            size = next((k for k in range(by_time, 3, -1) if tokens(k) <= 2000), 3)
            if size < 5 and spent(by_time) < 15:
                size = 7
            size = min(size, len(rows) - i)
            want.append((i, size))
            i += max(1, size - 2)
        assert got[job] == want


def test_topic_blocks_cover_segments(segments):
    kept = topics.segment_topics(segments, tail="keep")
    assert kept.count() == segments.count() == kept.select("job_id", "segment_id").distinct().count()
    for rows in by_job(kept, "ord").values():
        steps = [b["block_idx"] - a["block_idx"] for a, b in zip(rows, rows[1:], strict=False)]
        assert rows[0]["block_idx"] == 0 and set(steps) <= {0, 1}


@pytest.mark.parametrize("threshold", [0.2, 0.5])
def test_greedy_dedup(sets, threshold):
    gone = {r["id"]: (r["similar_to"], r["similarity"]) for r in dedup.greedy_dedup(sets, threshold=threshold)[1].collect()}
    want = {}
    for rows in by_job(sets, "ord").values():
        kept = []
        for r in rows:
            hit = next((k for k in kept if round(jaccard(r["event_ids"], k["event_ids"]), 9) >= threshold), None)
            if hit is None:
                kept.append(r)
            else:
                want[r["id"]] = (hit["id"], round(jaccard(r["event_ids"], hit["event_ids"]), 6))
    assert gone == want


def test_overlap_clusters(sets):
    b = sets.select((F.col("ord") % 40).alias("job_id"), F.col("ord").alias("idx"), F.col("event_ids").alias("segments"))
    got = {(r["job_id"], r["idx"]): r["cluster"] for r in dedup.overlap_clusters(b, 0.4).collect()}
    for job, rows in by_job(b, "idx").items():
        cluster = {}
        for i, r in enumerate(rows):
            if r["idx"] in cluster:
                continue
            cluster[r["idx"]], members = i, [r["segments"]]
            for x in rows[i + 1 :]:
                if x["idx"] not in cluster and any(round(jaccard(m, x["segments"]), 9) >= 0.4 for m in members):
                    cluster[x["idx"]] = i
                    members.append(x["segments"])
        assert {r["idx"]: got[job, r["idx"]] for r in rows} == cluster


def test_portfolio(sets):
    placed = ranking.narrative_order(sets)
    got = {j: [r["id"] for r in rows] for j, rows in by_job(ranking.portfolio_select(placed, 6, "diverse"), "final_rank").items()}
    from clipgraph_spark.config import PORTFOLIO_POLICIES

    q, d = PORTFOLIO_POLICIES["diverse"]
    for job, rows in by_job(placed, "narrative_pos").items():
        left, taken = list(rows), []
        while left and len(taken) < 6:
            worth = lambda r: round(q * r["score"] - d * max((round(jaccard(r["event_ids"], t["event_ids"]), 9) for t in taken), default=0.0), 9)  # noqa: B023, E731
            best = max(left, key=lambda r: (worth(r), -r["narrative_pos"]))
            left.remove(best)
            taken.append(best)
        if len(rows) > 6:
            assert got[job] == [r["id"] for r in sorted(taken, key=lambda r: (-r["score"], r["narrative_pos"]))]
        else:
            assert sorted(got[job]) == sorted(r["id"] for r in rows)
