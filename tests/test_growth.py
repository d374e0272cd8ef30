"""Steps whose cost grew faster than their input, or that read their input more often than once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipgraph_spark.functions import text as T
from clipgraph_spark.functions import vectors as V
from clipgraph_spark.operators import topics


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bucket_cosine_of_rows(spark):
    rows = [([], []), ([1], []), ([1, 1, 2], [2, 1, 1]), ([5, 5, 5, 383], [5, 0, 383, 383]), ([1, 2], [3, 4]), (None, [1])]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    got = df.select(V.bucket_cosine(F.col("a"), F.col("b")).alias("new"), T.bucket_cosine(F.col("a"), F.col("b")).alias("old")).collect()
    assert [r["new"] for r in got] == [r["old"] for r in got]


def test_half_up(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.random(500), np.round(rng.random(500), 4) * 0.7 - 0.3 * np.round(rng.random(500), 9), np.round(rng.random(200), 9) + 5e-10, [0.0, 0.0009765625]])
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 9)).collect()
    assert [r[0] for r in got] == V.half_up(x).tolist()


def test_topic_blocks_join_no_spans(spark):
    """a job's segments and spans met in a join on the job alone, and the boundaries read their input twice."""
    s = spark.createDataFrame([(1, i) for i in range(9)], "job_id int, ord int")
    found = spark.createDataFrame([(1, 0, 1.0), (1, 3, 0.7), (1, 7, 0.4)], "job_id int, at int, structural_confidence double")
    blocks = topics.topic_blocks(s, found, "keep")
    assert "Join" not in plan(blocks)
    assert [(r["block_idx"], r["structural_confidence"]) for r in blocks.orderBy("ord").collect()] == [(0, 0.7)] * 3 + [(1, 0.4)] * 4 + [(2, 1.0)] * 2
    sims = spark.createDataFrame([(1, i, i + 1, 0.1 if i == 4 else 0.9) for i in range(9)], "job_id int, idx int, start_ord int, sim double")
    b = topics.boundaries(topics.smooth(sims, 1))
    assert plan(b).count("LogicalRDD") == 1 and sorted(r["at"] for r in b.collect()) == [0, 5]


@pytest.mark.parametrize("name", ["i3_blueprint_dedup", "m2_narrative", "m9_tie_break_exact", "m13_rank", "m13_funnel", "m14_preview", "o3_learning_labels"])
def test_ranking_reads_candidates_once(spark, name):
    """The candidates were made anew for each use, and cosines were nested lambdas."""
    from clipgraph_spark import registry

    p = plan(registry.queries()[name](spark, "/root/testdata/sf0.001"))
    assert "(?<=[.!?])" not in p and "array_intersect(namedlambda" not in p


class _Handle:
    """State of one key in memory; counts what is read and written."""

    def __init__(self):
        self.map, self.value, self.timers, self.calls = {}, None, [], 0

    def getMapState(self, *_):
        h = self

        class M:
            def containsKey(self, k):
                h.calls += 1
                return k in h.map

            def getValue(self, k):
                h.calls += 1
                return h.map[k]

            def updateValue(self, k, v):
                h.calls += 1
                h.map[k] = v

            def removeKey(self, k):
                h.calls += 1
                del h.map[k]

            def keys(self):
                return iter(list(h.map))

        return M()

    def getValueState(self, *_):
        h = self

        class S:
            exists = lambda self: h.value is not None
            get = lambda self: h.value
            update = lambda self, v: setattr(h, "value", v)
            clear = lambda self: setattr(h, "value", None)

        return S()

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers = [x for x in self.timers if x != t]

    def registerTimer(self, t):
        self.timers.append(t)


@pytest.mark.parametrize("n", [500, 9000])
def test_streams_touch_state_by_lists(n):
    """state was read and written once or more for each row."""
    import random
    from types import SimpleNamespace

    import pandas as pd

    from clipgraph_spark.streaming import ordered

    rows = [(i * 977_123, i, i % 3 == 0, i % 2 == 0) for i in range(n)]
    shuffled = random.Random(1).sample(rows, n)
    p = ordered._InOrder(["us", "seq", "ok", "rate_limited"], "", ordered._failing(3), ["seq", "weight"], "key", 10**12)
    h = _Handle()
    p.init(h)
    got = []

    def expire(ms):
        at = SimpleNamespace(getCurrentWatermarkInMs=lambda: ms, getExpiryTimeInMs=lambda: ms)
        for out in p.handleExpiredTimer((7,), at, at):
            got.extend(map(tuple, out[["seq", "weight"]].to_numpy().tolist()))

    for a in range(0, n, n // 2):
        list(p.handleInputRows((7,), iter([pd.DataFrame(shuffled[a : a + n // 2], columns=p.fields)]), None))
    assert h.timers == [0]
    cut = rows[n // 3][0] // 1000
    expire(cut)
    assert h.timers == [rows[n // 3 + 1][0] // 1000]
    expire(rows[-1][0] // 1000)
    want, weight = ordered._failing(3)(0, rows)[1], None
    assert got == want and h.map == {} and h.calls < n / 8


def test_composer_writes_no_decisions(spark):
    """Every decision of every round was written, with its paths, also where only stories were asked for."""
    from clipgraph_spark.operators import composer
    from clipgraph_spark.plans import bindings

    labels = []

    def keep(df, label):
        labels.append(label)
        return df.localCheckpoint()

    s = bindings.segments(spark, "/root/testdata/sf0.001").where("job_id < 5").localCheckpoint()
    composer.compose(s, bindings.annotations(s), keep)
    assert set(labels) == {"composer-pool", "composer-state"}


def test_stories_and_clips_read_segments_once(spark):
    """Stories made the segments anew in each step; clips joined them to themselves."""
    from clipgraph_spark import registry
    from clipgraph_spark.operators import candidates
    from clipgraph_spark.plans import bindings

    for name in ("k6_repair", "k11_coverage", "l4_build_blueprint"):
        assert "(?<=[.!?])" not in plan(registry.queries()[name](spark, "/root/testdata/sf0.001"))
    s = bindings.segments(spark, "/root/testdata/sf0.001")
    assert "Join" not in plan(candidates.prune_by_kind(s, bindings.full_features(s))[0])


@pytest.mark.parametrize("name, exchanges", [("d6_synopsis", 1), ("d4_frequent_terms", 1), ("c14_bad_rows", 1), ("c16_prompt_text", 3)])
def test_segments_are_dealt_once(spark, name, exchanges):
    """synopses, bad rows and prompts made the segments anew for each part and joined them; the least
    place of a term was a struct, which only sorts could aggregate."""
    from clipgraph_spark import registry

    p = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert p.count(" Exchange ") <= exchanges and "SortMergeJoin" not in p.replace("SortMergeJoin [job_id", "", 1) and "SortAggregate" not in p
    if name in ("d6_synopsis", "d4_frequent_terms"):
        assert "REPARTITION_BY_NUM" in p


def test_written_tables_leave_no_shuffle_files(spark):
    """The shuffle files of each written table stayed until the driver happened to collect garbage."""
    from clipgraph_spark.sources import tables

    seen = []

    class Watch:
        sparkSession, schema = spark, spark.range(1).schema

        @property
        def write(self):
            seen.append(spark.conf.get(tables.CLEANUP, "false"))
            return spark.range(1).write

    before = spark.conf.get(tables.CLEANUP, "false")
    assert tables.materialize(Watch()).count() == 1
    assert seen == ["true"] and spark.conf.get(tables.CLEANUP, "false") == before
