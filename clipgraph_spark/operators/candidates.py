"""Candidate clips: pruning, hook-body-ending triples, strategies."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CLIP_WEIGHTS
from ..functions import text as T
from .transcript import in_order, per_job

SPANS = {"hook": "h", "body": "b", "ending": "e"}


def prune_by_kind(segments: DataFrame, features: DataFrame, hooks: int = 15, bodies: int = 40, endings: int = 10, min_score: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """The best segments of each kind with their score and rank, and before-after statistics of each job.

    Features that hold all columns of the segments (see segment_features) are taken as they are, without a join.
    """
    if set(segments.columns) <= set(features.columns):
        s = features.select(*segments.columns, F.coalesce("total_score", F.lit(0.5)).alias("score"))
    else:
        s = segments.join(features.select("job_id", "segment_id", F.col("total_score").alias("score")), ["job_id", "segment_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.5)))
    most = T.steps((F.col("kind") == "hook", hooks), (F.col("kind") == "body", bodies), otherwise=endings)
    rank = F.row_number().over(Window.partitionBy("job_id", "kind").orderBy(F.desc("score"), "ord"))
    ranked = s.where(F.col("score") >= min_score).withColumn("rank", rank)
    pruned = ranked.where(F.col("rank") <= most)
    n = lambda df, p: df.groupBy("job_id").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_{p}") for k in SPANS])
    stats = n(segments, "before").join(n(pruned, "after"), "job_id", "left").fillna(0)
    for p in ("before", "after"):
        stats = stats.withColumn(f"combinations_{p}", reduce(lambda a, b: a * b, [F.col(f"{k}_{p}") for k in SPANS]))
    cut = F.when(F.col("combinations_before") > 0, 100 * (1 - F.col("combinations_after") / F.col("combinations_before"))).otherwise(F.lit(0.0))
    return pruned, stats.withColumn("reduction_pct", F.round(cut, 1))


def clip_triples(pruned: DataFrame, max_gap: float = 30.0) -> DataFrame:
    """Hook, body and ending of a job in order, without overlap and with gaps of at most max_gap.

    Two range joins on job_id; pruning bounds each side by a job's quotas. A time bucket of max_gap seconds is part of
    the key, so a job of any length joins only segments that lie near each other.
    """
    cols = lambda k, p: pruned.where(F.col("kind") == k).select("job_id", *[F.col(c).alias(f"{p}_{c}") for c in ("segment_id", "start_s", "end_s", "text", "score", "rank")])
    bucket = lambda c: F.floor(F.col(c) / max_gap).cast("long")
    near = lambda c: F.explode(F.array(bucket(c), bucket(c) + 1))
    h, b, e = (cols(k, p) for k, p in SPANS.items())
    hb = h.withColumn("_k", near("h_end_s")).join(b.withColumn("_k", bucket("b_start_s")), ["job_id", "_k"])
    hb = hb.where((F.col("h_start_s") <= F.col("b_start_s")) & (F.col("h_end_s") <= F.col("b_start_s")) & (F.col("b_start_s") - F.col("h_end_s") <= max_gap)).drop("_k")
    t = hb.withColumn("_k", near("b_end_s")).join(e.withColumn("_k", bucket("e_start_s")), ["job_id", "_k"])
    return t.where((F.col("b_start_s") <= F.col("e_start_s")) & (F.col("b_end_s") <= F.col("e_start_s")) & (F.col("e_start_s") - F.col("b_end_s") <= max_gap)).drop("_k")


def flow_score(gap1: Column, gap2: Column) -> Column:
    return T.rounded(F.greatest(F.lit(0.1), 0.95 - F.least(F.lit(0.6), (F.greatest(gap1, F.lit(0.0)) + F.greatest(gap2, F.lit(0.0))) / 300)), 4)


def duration_penalty(score: Column, duration: Column) -> Column:
    return score * T.steps((duration < 15, 0.5), (duration < 30, 0.8), (duration <= 60, 1.0), (duration <= 90, 0.9), otherwise=0.7)


def generate_candidates(segments: DataFrame, features: DataFrame, top_k: int = 20, min_score: float = 0.35, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The top_k clip candidates of each job by total score; ties go by the ranks of hook, body and ending.

    `keep` may write the pruned segments, which are read once for each kind.
    """
    t = clip_triples(keep(prune_by_kind(segments, features)[0].select("job_id", "segment_id", "kind", "start_s", "end_s", "text", "score", "rank")))
    duration = F.greatest(F.col("e_end_s") - F.col("h_start_s"), F.lit(1.0))
    flow = flow_score(F.col("b_start_s") - F.col("h_end_s"), F.col("e_start_s") - F.col("b_end_s"))
    w = CLIP_WEIGHTS
    t = t.withColumns({"duration": duration, "flow_score": flow})
    total = duration_penalty(F.col("h_score") * w["hook"] + F.col("b_score") * w["body"] + F.col("e_score") * w["ending"] + F.col("flow_score") * w["flow"], F.col("duration"))
    t = t.withColumn("total_score", T.round4(total)).where(F.round(total, 9) >= min_score)
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("total_score"), "h_rank", "b_rank", "e_rank"))
    t = t.withColumn("rank", rank).where(F.col("rank") <= top_k)
    names = [F.col(f"{p}_{c}").alias(f"{k}_{n}") for k, p in SPANS.items() for c, n in (("start_s", "start"), ("end_s", "end"), ("score", "score"), ("text", "text"))]
    return t.select(
        "job_id", F.concat_ws("_", F.lit("clip"), "h_segment_id", "b_segment_id", "e_segment_id").alias("id"), F.lit("Hook / Body / Ending").alias("title"),
        *names, T.rounded(F.col("duration"), 3).alias("duration"), "flow_score", "total_score", T.snippet([F.col("h_text"), F.col("b_text"), F.col("e_text")], 24).alias("snippet"), "rank",
    )


def story_strategy(segments: DataFrame) -> DataFrame:
    """Three neighbouring segments from each even place."""
    s = segments.select("job_id", "ord", "start_s", F.lead("end_s", 2).over(in_order()).alias("end_s"), (F.row_number().over(in_order()) - 1).alias("_i"), F.count("*").over(per_job()).alias("_n"), F.array("segment_id", F.lead("segment_id", 1).over(in_order()), F.lead("segment_id", 2).over(in_order())).alias("segment_ids"), F.concat_ws(" ", "text", F.lead("text", 1).over(in_order()), F.lead("text", 2).over(in_order())).alias("text"))
    s = s.where((F.col("_i") % 2 == 0) & (F.col("_i") < F.col("_n") - 2))
    return s.select("job_id", F.concat(F.lit("story_"), "_i").alias("candidate_id"), F.col("_i").alias("pos"), "segment_ids", "start_s", "end_s", "text")


def hook_strategy(segments: DataFrame) -> DataFrame:
    s = segments.withColumn("_i", F.row_number().over(in_order()) - 1).where(T.has_question(F.col("text")) | T.has_any(F.col("text"), ("secret", "truth", "why", "how")))
    return s.select("job_id", F.concat(F.lit("hook_"), "_i").alias("candidate_id"), F.col("_i").alias("pos"), F.array("segment_id").alias("segment_ids"), "start_s", "end_s", "text")


Strategy = Callable[[DataFrame], DataFrame]
STRATEGIES: dict[str, Strategy] = {"story": story_strategy, "hook": hook_strategy}


def merge_strategies(segments: DataFrame, strategies: dict[str, Strategy] | None = None) -> DataFrame:
    """The candidates of all strategies, in the strategies' order."""
    parts = [f(segments).withColumns({"strategy": F.lit(n), "strategy_rank": F.lit(i)}) for i, (n, f) in enumerate((strategies or STRATEGIES).items())]
    return reduce(DataFrame.unionByName, parts)


def to_scored(candidates: DataFrame) -> DataFrame:
    return candidates.select("job_id", "id", F.col("hook_start").alias("start_s"), F.col("ending_end").alias("end_s"), F.array("id").alias("event_ids"), F.col("total_score").alias("score"), "hook_text", "body_text", "ending_text")
