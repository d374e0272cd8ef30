"""Embedding stores, large forms, exact ties, percentiles, failing objectives, strategies and round trips."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipgraph_spark.functions import text as T
from clipgraph_spark.operators import dedup, objectives, ranking, strategies, telemetry, topics, transcript
from clipgraph_spark.plans import bindings
from clipgraph_spark.sources import tables

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def keep(spark, tmp_path):
    n = itertools.count()

    def write(df):
        path = f"{tmp_path}/{next(n)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write


def test_embed_once_per_text(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b a"), (4, "a b a"), (5, "c")], "id int, text string")
    got = {r["id"]: r["embedding"] for r in topics.embed(df, fn=lambda c: T.hash_embed(c, 8)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and got[1] == got[2] == [0.0] * 8 and got[3] == got[4] != got[5]
    assert abs(sum(x * x for x in got[3]) - 1) < 1e-12


def test_embedding_store(spark, tmp_path):
    def lengths():
        return lambda texts: texts.map(lambda t: [float(len(t)), 1.0])

    def fails():
        raise AssertionError("no text is left to embed")

    path = str(tmp_path / "store")
    df = spark.createDataFrame([(1, None), (2, ""), (3, "abc"), (4, "abc")], "id int, text string")
    assert topics.missing_texts(df, path).count() == 2
    got = {r["id"]: r["embedding"] for r in topics.embed_stored(df, path, lengths).collect()}
    assert got == {1: [0.0, 1.0], 2: [0.0, 1.0], 3: [3.0, 1.0], 4: [3.0, 1.0]}
    assert topics.missing_texts(df, path).count() == 0
    assert {r["id"]: r["embedding"] for r in topics.embed_stored(df, path, fails).collect()} == got
    more = df.unionByName(spark.createDataFrame([(5, "defgh")], df.schema))
    assert topics.embed_stored(more, path, lengths).count() == 5 and topics.read_cache(spark, path).count() == 3
    spark.read.parquet(path).limit(1).write.mode("append").parquet(path)
    assert topics.embed_stored(more, path, fails).count() == 5
    assert topics.embed_stored(df.limit(0), str(tmp_path / "none"), lengths).count() == 0


@pytest.mark.parametrize("limit", [5, 17, 1000])
def test_large_packing_equals_fold(spark, keep, limit):
    rng = random.Random(limit)
    rows = [(j, i * 2, float(rng.choice([0, 1, 2, 3, 40]))) for j, n in ((1, 400), (2, 1), (3, 37)) for i in range(n)]
    df = spark.createDataFrame(rows, "job_id int, ord int, size double").repartition(4)
    bins = lambda d: sorted((r["job_id"], r["ord"], r["bin"]) for r in d.collect())
    fold = bins(transcript.pack(df, "size", float(limit)))
    assert bins(transcript.pack_large(df, "size", float(limit), keep)) == fold
    assert bins(strategies.split_by(df, strategies.Greedy, float(limit))) == fold


def test_large_packing_of_one_job(spark, keep):
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("job_id"), F.col("id").alias("ord"), (F.col("id") % 7).cast("double").alias("size"))
    got = transcript.pack_large(df, "size", 21.0, keep).groupBy("bin").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in got) == n and max(r["s"] for r in got) == 21 and len(got) == n // 7 + 1
    assert transcript.pack_large(df.limit(0), "size", 21.0, keep).count() == 0


def test_strategies(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (1, 2, 1.0), (2, 0, 9.0)], "job_id int, ord int, size double")
    assert sorted(map(tuple, strategies.split_by(df, strategies.Every, 2).collect())) == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (2, 0, 0)]


def swapped(rows):
    """Pair by pair, as stated: every later row within the tie of the one a place holds, and better, takes the place."""
    rows = sorted(rows, key=lambda r: (-r[2], r[1]))
    better = lambda a, b: (-a[3], -a[4], a[5], a[6]) < (-b[3], -b[4], b[5], b[6])
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if abs(rows[i][2] - rows[j][2]) < 0.001 and better(rows[j], rows[i]):
                rows[i], rows[j] = rows[j], rows[i]
    return [(r[0], r[1], n + 1) for n, r in enumerate(rows)]


def test_exact_ties(spark):
    rng = random.Random(2)
    rows = [(j, f"c{i}", round(0.5 + rng.randint(0, 400 if j == 1 else 12) * 0.0004, 4), rng.choice([0.4, 0.9]), rng.choice([0.1, 0.5]), rng.choice([20.0, 30.0]), float(rng.randint(0, 3))) for j, n in ((1, 200), (2, 60), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "job_id int, id string, final_score double, overall_confidence double, hook_quality_score double, duration double, hook_start double")
    got = sorted((r["job_id"], r["id"], r["position"]) for r in ranking.tie_break(df, exact=True).collect())
    assert got == sorted(x for j in (1, 2, 3) for x in swapped([r for r in rows if r[0] == j]))
    assert ranking.tie_break(df.limit(0), exact=True).count() == 0


def test_large_mmr_equals_fold(spark, keep):
    c = ranking.with_vectors(bindings.ranking_candidates(spark, DIR)).withColumns({"final_score": F.col("raw_score"), "position": F.col("rank")})
    c = keep(c)
    rows = lambda d: sorted((r["job_id"], r["id"], r["final_rank"]) for r in d.collect())
    for k in (1, 4):
        assert rows(ranking.mmr_top_k_large(c, keep, k)) == rows(ranking.mmr_top_k(c, k))
    ties = c.withColumn("final_score", F.round("final_score", 1))
    assert rows(ranking.mmr_top_k_large(ties, keep, 3)) == rows(ranking.mmr_top_k(ties, 3))


@pytest.mark.parametrize("sketch", [20, 20_000])
def test_percentiles(spark, monkeypatch, sketch):
    """Heavy tails, one value of most rows, few rows, null stages; with a coarse sketch brackets are used."""
    monkeypatch.setattr(telemetry, "SKETCH", sketch)
    rng = np.random.default_rng(5)
    values = {"tail": np.append(rng.random(999), 1e12), "same": np.array([3.0] * 700 + list(rng.random(40))), "two": np.array([1.0, 4.0]), "one": np.array([7.0]), None: rng.lognormal(0, 8, 1500), "neg": -rng.random(333)}
    rows = [(s, float(v)) for s, vs in values.items() for v in vs] + [("tail", None), ("none", None)]
    df = spark.createDataFrame(rows, "stage string, elapsed_ms double").repartition(5)
    got = {r["stage"]: tuple(r)[1:] for r in telemetry.latency_stats(df).collect()}
    want = {}
    for s, vs in values.items():
        v = sorted(vs.tolist())
        want[s] = (len(v), (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2, v[max(0, int(len(v) * 0.95) - 1)], v[-1])
    assert got == want


def test_failing_objectives(spark):
    c = spark.createDataFrame([(1, "a", 10.0, 0.0), (1, "b", 10.0, 5.0)], "job_id int, id string, up double, down double")
    own = {
        "ratio": lambda: objectives._result(F.try_divide("up", "down") / 10, 0.9),
        "lost": lambda: objectives._result(F.col("no_such_column"), 1.0),
        "broken": lambda: 1 / 0,
        "fine": lambda: objectives._result(1.0, 1.0),
    }
    got = {r["id"]: r for r in objectives.score_objectives(c, own).collect()}
    assert tuple(got["a"]["ratio"]) == (0.5, 0.0, "error") and tuple(got["b"]["ratio"]) == (0.2, 0.9, "success")
    for r in got.values():
        assert tuple(r["lost"]) == tuple(r["broken"]) == (0.5, 0.0, "error") and tuple(r["fine"]) == (1.0, 1.0, "success")
    assert got["a"]["overall_score"] == 0.625


def test_transcripts_round_trip(spark, tmp_path):
    chunks = bindings.chunks(spark, DIR).withColumn("confidence", F.when(F.col("chunk_idx") > 0, F.lit(0.5)))
    merged = transcript.merge_transcripts(chunks)
    tables.write_transcripts(chunks, merged, str(tmp_path / "t"))
    got, bad = tables.scan_transcripts(spark, str(tmp_path / "t"), multi_line=False)
    cols = ["chunk_idx", "chunk_id", "start_s", "end_s", "text"]
    want = chunks.select(F.col("job_id").cast("string").alias("job_id"), *cols, F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and bad.count() == 0
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "good.json").write_text(json.dumps({"job_id": "j", "merged_text": "x", "chunks": [{"chunk_id": "c", "start": 0.0, "end": 1.0, "text": "x"}]}, indent=1))
    (tmp_path / "one" / "cut.json").write_text('{"job_id": "k", "chunks": [{"chunk_id"')
    got, bad = tables.scan_transcripts(spark, str(tmp_path / "one"))
    assert [(r["job_id"], r["confidence"]) for r in got.collect()] == [("j", 0.0)]
    assert [(r["path"].rsplit("/", 1)[1], r["raw"][:12]) for r in bad.collect()] == [("cut.json", '{"job_id": "')]


def test_partitions_are_replaced(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, "old") for i in range(12)], "job_id int, part int, v string")
    assert tables.replace_partitions(df, str(tmp_path), "stage", "part").count() == 12
    out = tables.replace_partitions(spark.createDataFrame([(99, 1, "new")], df.schema), str(tmp_path), "stage", "part")
    assert sorted((r["part"], r["v"]) for r in out.select("part", "v").distinct().collect()) == [(0, "old"), (1, "new"), (2, "old")] and out.count() == 9
    plan = out.where("part = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


def test_vectors_and_synopses(spark, tmp_path):
    v = bindings.vectors(spark, DIR)
    tables.write_vectors(v, str(tmp_path / "v"))
    assert sorted(r["ord"] for r in tables.read_vectors(spark, str(tmp_path / "v")).collect()) == sorted(r["ord"] for r in v.collect())
    s = spark.createDataFrame([("a", 0, "one\ntwo", "x"), ("a", 1, None, "")], "job_id string, block_idx int, synopsis string, representative_excerpt string")
    tables.write_synopses(s, str(tmp_path / "s"))
    assert sorted(map(str, tables.read_synopses(spark, str(tmp_path / "s")).collect())) == sorted(map(str, s.collect()))


def clusters(rows):
    """In order, each boundary not yet taken seeds one, and later ones join if they overlap any member so far."""
    out = {}
    for i, (idx, s) in enumerate(rows):
        if idx in out:
            continue
        out[idx], members = i, [s]
        for other, t in rows[i + 1 :]:
            if other not in out and any(round(len(set(m) & set(t)) / max(len(set(m) | set(t)), 1), 9) >= 0.4 for m in members):
                out[other] = i
                members.append(t)
    return out


def test_large_clusters(spark, keep):
    """One job of 3,000 boundaries, long chains among them, a job whose boundaries share one segment, and odd rows."""
    rng = random.Random(8)
    chain = [(i * 2, [f"c{i}", f"c{i + 1}", f"c{i + 2}", f"c{i + 3}"]) for i in range(300)]
    jobs = {1: [(i, [f"s{rng.randint(0, 2500)}" for _ in range(rng.randint(1, 5))]) for i in range(3000)], 2: chain, 3: [(i, ["hot", f"a{i}", f"b{i}", f"c{i}"]) for i in range(150)], 4: [(0, []), (1, ["x", "x"]), (2, ["x"])]}
    df = spark.createDataFrame([(j, i, s) for j, rows in jobs.items() for i, s in rows], "job_id int, idx int, segments array<string>").repartition(4)
    got = {(r["job_id"], r["idx"]): r["cluster"] for r in dedup.overlap_clusters_large(df, keep).collect()}
    assert got == {(j, i): c for j, rows in jobs.items() for i, c in clusters(rows).items()}
    small = df.where("job_id in (2, 3, 4) and idx < 60")
    fold = {(r["job_id"], r["idx"]): r["cluster"] for r in dedup.overlap_clusters(small).collect()}
    assert {(r["job_id"], r["idx"]): r["cluster"] for r in dedup.overlap_clusters_large(small, keep).collect()} == fold


def test_work_is_cleared(spark):
    df = tables.materialize(spark.range(5).toDF("a"))
    other = tables.work_path(spark, "x")
    assert df.count() == 5 and other != tables.work_path(spark, "x")
    tables.clear_work(spark)
    spark.catalog.clearCache()
    with pytest.raises(Exception, match="(?i)exist|not found"):
        df.count()
    assert tables.materialize(spark.range(3).toDF("a")).count() == 3
