"""Registered queries against their SQL on the small tables, and streams against batches."""

import os

import duckdb
import pytest

from clipgraph_spark import registry

DIR = "/root/testdata/sf0.001"


def norm(v):
    return round(float(v), 5) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert got == want


def test_large_dedup_equals_fold(spark):
    from clipgraph_spark.operators import dedup
    from clipgraph_spark.plans import bindings

    rows = bindings.order_sets(spark, DIR, 60)
    kept = dedup.greedy_dedup(rows, threshold=0.3)[0]
    large = dedup.greedy_dedup_large(rows, lambda df: df.cache(), threshold=0.3)
    assert {r["id"] for r in kept.collect()} == {r["id"] for r in large.collect()}


def test_hard_constraint_bounds(spark):
    from clipgraph_spark.operators import ranking

    row = lambda i, d, raw=0.5, gap=1.0: (1, i, 0.0, 5.0, 5.0 + gap, 10.0 + gap, 11.0 + gap, d, d, raw)
    df = spark.createDataFrame([row("a", 15.0), row("b", 90.0), row("c", 14.9), row("d", 90.1), row("e", 20.0, 0.1), row("f", 50.0, 0.5, 31.0)], "job_id int, id string, hook_start double, hook_end double, body_start double, body_end double, ending_start double, ending_end double, duration double, raw_score double")
    ok, gone = ranking.hard_constraints(df)
    assert sorted(r["id"] for r in ok.collect()) == ["a", "b"]
    assert {r["id"]: r["reasons"] for r in gone.collect()} == {"c": ["duration_too_short"], "d": ["duration_too_long"], "e": ["score_too_low"], "f": ["excessive_gap"]}


def test_rounding_is_that_of_sql(spark, duck):
    """Values at half a unit, where F.round goes by the shortest decimal of a double."""
    from pyspark.sql import functions as F

    from clipgraph_spark.functions import text as T
    from clipgraph_spark.operators import candidates, transcript

    x = spark.range(-3000, 3000).select((F.col("id") / 20000).alias("x"))
    got = [tuple(r) for r in x.select(T.rounded(F.col("x"), 4), T.rounded(F.col("x"), 3)).collect()]
    want = duck.execute("SELECT round(i / 20000::DOUBLE, 4), round(i / 20000::DOUBLE, 3) FROM range(-3000, 3000) r(i) ORDER BY i").fetchall()
    assert got == want
    gaps = spark.range(0, 3000).select((F.col("id") / 1000).alias("g"))
    flow = [r[0] for r in gaps.select(candidates.flow_score(F.col("g"), F.lit(0.0))).collect()]
    assert flow == [r[0] for r in duck.execute("SELECT round(greatest(0.1::DOUBLE, 0.95::DOUBLE - least(0.6::DOUBLE, (greatest(i / 1000::DOUBLE, 0::DOUBLE) + 0::DOUBLE) / 300)), 4) FROM range(3000) r(i) ORDER BY i").fetchall()]
    text = " ".join(["On."] * 32)
    chunks = spark.createDataFrame([(1, i, f"c{i}", i * 12.8, (i + 1) * 12.8 + 0.2, text) for i in range(40)], "job_id int, chunk_idx int, chunk_id string, start_s double, end_s double, text string")
    got = [(r["start_s"], r["end_s"]) for r in transcript.atomic_segments(chunks).orderBy("ord").collect()]
    span = "SELECT i * 12.8::DOUBLE AS s, (i + 1) * 12.8::DOUBLE + 0.2::DOUBLE AS e, j FROM range(40) a(i), range(32) b(j) ORDER BY i, j"
    assert got == duck.execute(f"SELECT round(s + j * ((e - s) / 32), 3), round(least(e, s + j * ((e - s) / 32) + (e - s) / 32), 3) FROM ({span})").fetchall()


def test_context_gap_adds_as_sql(spark, duck):
    """gaps whose sum ends at a threshold, added from left to right."""
    from pyspark.sql import functions as F

    from clipgraph_spark.operators import ranking

    at = "i / 1000::DOUBLE AS h, (i + a) / 1000::DOUBLE AS b0, (i + a + 777) / 1000::DOUBLE AS b1, (i + a + 777 + 4000 - a) / 1000::DOUBLE AS e"
    rows = duck.execute(f"SELECT h, b0, b1, e, CASE WHEN (b0 - h + e - b1) / 2 < 2 THEN 0.8 ELSE 0.7 END::DOUBLE FROM (SELECT i, a, {at} FROM range(1, 60000, 997) x(i), range(0, 4001, 333) y(a))").fetchall()
    c = spark.createDataFrame([r[:4] for r in rows], "hook_end double, body_start double, body_end double, ending_start double")
    c = c.withColumns({"hook_text": F.lit("x y"), "body_text": F.lit("z w"), "raw_score": F.lit(1.0)})
    got = sorted((r["hook_end"], r["body_start"], r["body_end"], r["ending_start"], r["context_score"]) for r in ranking.context(c).collect())
    assert got == sorted((*r[:4], r[4]) for r in rows)
