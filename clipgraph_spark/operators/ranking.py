"""Multi-stage ranking of clip candidates, keyed by job_id."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CALLS, CLAIMS, CURIOSITY, NEW_TOPIC, PRONOUNS, STAGE_WEIGHTS, STOP_WORDS, SUMMARIES
from ..functions import text as T
from ..functions import vectors as V


def _gap1() -> Column:
    return F.col("body_start") - F.col("hook_end")


def _gap2() -> Column:
    return F.col("ending_start") - F.col("body_end")


def hard_constraints(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates that pass, and those eliminated with all their reasons."""
    d = F.col("duration")
    reasons = F.array_compact(F.array(
        F.when(d < 15, "duration_too_short").when(d > 90, "duration_too_long"),
        F.when(~((F.col("hook_start") <= F.col("body_start")) & (F.col("body_start") <= F.col("ending_start"))), "non_chronological"),
        F.when((_gap1() < 0) | (_gap2() < 0), "segment_overlap"),
        F.when((_gap1() > 30) | (_gap2() > 30), "excessive_gap"),
        F.when(F.col("raw_score") < 0.15, "score_too_low"),
    ))
    c = candidates.withColumn("reasons", reasons)
    return c.where(F.size("reasons") == 0).drop("reasons"), c.where(F.size("reasons") > 0)


def narrative(c: DataFrame) -> DataFrame:
    """Adds narrative_score and narrative_confidence; a low score lowers raw_score. Needs hook_v, body_v, ending_v."""
    hook, body, end = F.col("hook_v"), F.col("body_v"), F.col("ending_v")
    c = c.withColumns({"_hb": F.round(V.bucket_cosine(hook, body), 9), "_be": F.round(V.bucket_cosine(body, end), 9)})
    hb, be = F.col("_hb"), F.col("_be")
    # hash embeddings have norm 1, or 0 without tokens
    strong = F.size(body) > 0
    semantic = T.steps((hb > 0.4, 0.35), (hb > 0.2, 0.20), otherwise=0.05) + T.steps((be > 0.3, 0.25), (be > 0.15, 0.15), otherwise=0.05) + T.steps((strong, 0.15), otherwise=0.05)
    words = lambda n: F.array_distinct(T.lower_tokens(F.col(f"{n}_text")))
    ratio = F.size(F.array_intersect(words("hook"), words("body"))) / F.greatest(F.size(words("hook")), F.lit(1))
    c = c.withColumn("_ratio", ratio)
    r = F.col("_ratio")
    claim = T.has_question(F.col("hook_text")) | T.has_any(F.col("hook_text"), CLAIMS)
    fresh = T.starts_with_any(F.col("ending_text"), NEW_TOPIC)
    score = F.least(F.lit(0.6), semantic) + T.steps(((r > 0.3) & (hb > 0.3), 0.15), (r > 0.1, 0.08), otherwise=0.0) + T.steps((claim, 0.15), otherwise=0.05) + T.steps((fresh, 0.02), otherwise=0.10)
    conf = T.steps((hb > 0.3, 0.9), otherwise=0.6) + F.least(F.lit(0.8), 0.5 + r) + T.steps((claim, 0.85), otherwise=0.5) + T.steps((fresh, 0.45), otherwise=0.8)
    c = c.withColumns({"narrative_score": T.round4(F.least(F.lit(1.0), score)), "narrative_confidence": T.round4(conf / 4)})
    return c.withColumn("raw_score", F.when(F.col("narrative_score") < 0.3, F.col("raw_score") * 0.7).otherwise(F.col("raw_score"))).drop("_hb", "_be", "_ratio")


def context(c: DataFrame) -> DataFrame:
    # added from left to right, as the SQL adds: sums that end at a threshold depend on it
    gap = (F.col("body_start") - F.col("hook_end") + F.col("ending_start") - F.col("body_end")) / 2
    hp, bp = T.pronouns(F.col("hook_text"), PRONOUNS), T.pronouns(F.col("body_text"), PRONOUNS)
    lost = (F.size(hp) > 0) & (F.size(bp) > 0) & ~F.arrays_overlap(hp, bp)
    shared = F.size(F.array_intersect(T.content_words(F.col("hook_text"), STOP_WORDS), T.content_words(F.col("body_text"), STOP_WORDS))) > 0
    score = T.steps((gap < 2, 0.4), (gap < 5, 0.3), (gap < 10, 0.2), otherwise=0.1) + T.steps((lost, 0.0), otherwise=0.3) + T.steps((shared, 0.3), otherwise=0.1)
    c = c.withColumns({"context_score": T.round4(F.least(F.lit(1.0), score)), "context_confidence": F.lit(0.75)})
    return c.withColumn("raw_score", F.when(F.col("context_score") < 0.3, F.col("raw_score") * 0.8).otherwise(F.col("raw_score")))


def hook_quality(c: DataFrame) -> DataFrame:
    t, d = F.col("hook_text"), F.round(F.col("hook_end") - F.col("hook_start"), 9)
    n = T.word_count(t)
    ask, you, curious = T.has_question(t), T.has_any_token(t, ("you",)), T.has_any(t, CURIOSITY)
    none = F.lit(None).cast("double")
    score = T.steps((d.between(3, 7), 0.25), (d.between(2, 10), 0.15), otherwise=0.05) + T.steps((ask, 0.25), otherwise=0.0) + T.steps((you, 0.15), otherwise=0.0) + T.steps((curious, 0.2), otherwise=0.0) + T.steps((n <= 10, 0.15), (n <= 15, 0.1), otherwise=0.05)
    conf = T.mean_of(T.steps((d.between(3, 7), 0.9), (d.between(2, 10), 0.7), otherwise=0.4), F.when(ask, 0.95).otherwise(none), F.when(you, 0.85).otherwise(none), F.when(curious, 0.8).otherwise(none), T.steps((n <= 10, 0.9), (n <= 15, 0.75), otherwise=0.5))
    return c.withColumns({"hook_quality_score": T.round4(F.least(F.lit(1.0), score)), "hook_quality_confidence": T.round4(conf)})


def density(c: DataFrame) -> DataFrame:
    t = F.concat_ws(" ", "hook_text", "body_text", "ending_text")
    pace = T.words_per_second(t, F.col("duration"))
    score = T.steps((pace.between(2.5, 3.5), 0.9), (pace.between(1.5, 4.5), 0.7), (pace.between(1.0, 5.0), 0.5), otherwise=0.3)
    score = score + T.steps((T.has_digit(t), 0.1), otherwise=0.0) + T.steps((F.size(T.title_tokens(t)) > 0, 0.05), otherwise=0.0)
    return c.withColumns({"density_score": T.round4(F.least(F.lit(1.0), score)), "density_confidence": F.lit(0.8)})


def retention(c: DataFrame) -> DataFrame:
    d, gap = F.col("duration"), F.round(_gap1(), 9)
    closes = T.has_any_token(F.col("ending_text"), (*CALLS, *SUMMARIES))
    score = T.steps((d.between(30, 60), 0.3), (d.between(20, 75), 0.2), (d.between(15, 90), 0.1), otherwise=0.0) + T.steps((closes, 0.25), otherwise=0.1) + F.col("flow_score") * 0.25 + T.steps((gap < 1, 0.2), (gap < 3, 0.15), otherwise=0.05)
    conf = T.steps((d.between(30, 60), 0.85), (d.between(20, 75), 0.7), (d.between(15, 90), 0.5), otherwise=0.3) + T.steps((closes, 0.8), otherwise=0.5) + 0.7 + T.steps((gap < 1, 0.9), (gap < 3, 0.75), otherwise=0.4)
    return c.withColumns({"retention_score": T.round4(F.least(F.lit(1.0), score)), "retention_confidence": T.round4(conf / 4)})


def novelty(c: DataFrame, threshold: float = 0.75, hook_gap: float = 2.0, body_gap: float = 5.0) -> DataFrame:
    """Adds novelty_score and novelty_confidence by a fold over a job's candidates in order of raw_score.

    Only ids, starts and hash buckets go into the fold. Needs `v`, the buckets of the joined texts.
    """
    row = F.struct((-F.col("raw_score")).alias("o"), F.col("rank").alias("r"), "id", "hook_start", "body_start", "v")
    jobs = c.groupBy("job_id").agg(F.array_sort(F.collect_list(row)).alias("a"))

    def fold(hooks, bodies, buckets):
        h, b, v = np.array(hooks, np.float64), np.array(bodies, np.float64), V.dense(buckets)
        kept, out = [], []
        for i in range(len(h)):
            sims = V.cosines(v[kept], v[i])
            alike = np.flatnonzero(sims >= threshold)  # the first that is similar enough ends the search
            near = bool(((np.abs(h[i] - h[:i]) < hook_gap) & (np.abs(b[i] - b[:i]) < body_gap)).any())
            out.append((float(sims[alike[0]]) if len(alike) else 0.0, near))
            if not len(alike) and not near:
                kept.append(i)
        return [{"best": best, "near": near} for best, near in out]

    part = lambda n: F.transform("a", lambda x: x[n])
    noted = jobs.withColumn("_n", V.over_jobs(fold, "array<struct<best:double,near:boolean>>", part("hook_start"), part("body_start"), part("v")))
    out = noted.select("job_id", F.explode(F.zip_with(part("id"), "_n", lambda i, n: F.struct(i.alias("id"), n["best"].alias("best"), n["near"].alias("near")))).alias("n")).select("job_id", "n.*")
    alike, near = F.col("best") >= threshold, F.col("near")
    score = T.steps((alike, F.greatest(F.lit(0.1), 1 - F.col("best"))), (near, 0.25), otherwise=0.9)
    conf = T.steps((alike, 0.92), (near, 0.95), otherwise=0.88)
    return c.join(out.select("job_id", "id", F.round(score, 6).alias("novelty_score"), conf.alias("novelty_confidence")), ["job_id", "id"])


def final_score(c: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    w = weights or STAGE_WEIGHTS
    total = reduce(lambda a, b: a + b, [F.col(f"{s}_score") * F.coalesce(F.col(f"{s}_confidence"), F.lit(0.5)) * x for s, x in w.items()])
    conf = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"{s}_confidence"), F.lit(0.5)) * x for s, x in w.items()])
    score = total / F.greatest(conf, F.lit(0.001)) * 0.7 + F.col("raw_score") * 0.3
    return c.withColumns({"final_score": F.round(score, 4), "overall_confidence": F.round(conf / sum(w.values()), 4)})


def confidence(*signals: Column) -> Column:
    return reduce(lambda a, b: a + b, signals) / len(signals)


def confidence_weighted(score: Column, conf: Column) -> Column:
    return F.round(score * conf, 4)


def confidence_level(conf: Column) -> Column:
    return T.steps((conf >= 0.85, "high"), (conf >= 0.60, "moderate"), (conf >= 0.40, "low"), otherwise="no_trust")


TIE = 0.001


def _swapped(scores: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The order that swapping neighbours pair by pair leaves: each place takes, from left to right, every later row
    within TIE of the one it holds and with a lesser key. Each search for the next such row is one array operation."""
    at = np.arange(len(scores))
    for i in range(len(at) - 1):
        j = i + 1
        while j < len(at):
            held = at[i]
            hit = np.flatnonzero((np.abs(scores[at[j:]] - scores[held]) < TIE) & (keys[at[j:]] < keys[held]))
            if not len(hit):
                break
            j += int(hit[0])
            at[i], at[j] = at[j], at[i]
            j += 1
    return at


def tie_break(c: DataFrame, exact: bool = False) -> DataFrame:
    """Adds position: by final score, and between scores within TIE by confidence, hook, duration and place.

    The default sorts by scores rounded to 0.001 and then these keys. With exact=True rows are swapped pair by pair,
    which is no sort, as being within TIE is not transitive: sorted by score, rows fall into chains whose neighbours
    are within TIE, and only rows of one chain ever swap. Chains of one row, most of them, stay as they are; a longer
    one is a group of its own.
    """
    keys = [F.desc(F.round("final_score", 3)), F.desc("overall_confidence"), F.desc("hook_quality_score"), F.asc("duration"), F.asc("hook_start"), F.asc("id")]
    if not exact:
        return c.withColumn("position", F.row_number().over(Window.partitionBy("job_id").orderBy(*keys)))
    by_score = Window.partitionBy("job_id").orderBy(F.desc("final_score"), "id")
    far = ~(F.lag("final_score").over(by_score) - F.col("final_score") < TIE)
    small = c.select("job_id", "id", "final_score", "overall_confidence", "hook_quality_score", "duration", "hook_start")
    small = small.withColumns({"_at": F.row_number().over(by_score), "_far": F.coalesce(far, F.lit(True)).cast("int")}).withColumn("_chain", F.sum("_far").over(by_score))
    small = small.withColumn("_n", F.count("*").over(Window.partitionBy("job_id", "_chain")))

    def swap(pdf):
        rows = pdf.sort_values("_at")
        keys_ = np.column_stack([-rows["overall_confidence"], -rows["hook_quality_score"], rows["duration"], rows["hook_start"]])
        rank_ = np.unique(keys_, axis=0, return_inverse=True)[1].reshape(-1)
        ids = rows["id"].to_numpy()[_swapped(rows["final_score"].to_numpy(), rank_)]
        return pd.DataFrame({"job_id": rows["job_id"].to_numpy(), "id": ids, "position": rows["_at"].to_numpy()})

    id_type = small.schema["job_id"].dataType.simpleString()
    moved = small.where("_n > 1").groupBy("job_id", "_chain").applyInPandas(swap, f"job_id {id_type}, id string, position int")
    return c.join(small.where("_n = 1").select("job_id", "id", F.col("_at").alias("position")).unionByName(moved), ["job_id", "id"])


def mmr_top_k(c: DataFrame, k: int = 20, quality: float = 0.7, diversity: float = 0.3, similarity=T.bucket_cosine, score: str = "final_score", order: str = "position", vector: str = "v", by_score: bool = False) -> DataFrame:
    """The k rows of each job by maximal marginal relevance, ranked by score and then in the order they were taken; jobs
    of k rows or fewer stay as they are, and are ranked by `order`. With by_score all are ranked by score and `order`.

    One fold over a job's (place, score, vector) rows: each of k rounds takes the first row with the largest
    quality * score - diversity * largest similarity to those taken, and folds the new similarity into the rest.
    """
    row = F.struct(F.col(order).alias("o"), "id", F.col(score).alias("s"), F.col(vector).alias("v"), F.lit(0.0).alias("m"))
    jobs = c.groupBy("job_id").agg(F.array_sort(F.collect_list(row)).alias("a"))

    if similarity is T.bucket_cosine:
        chosen = _mmr_of_buckets(k, quality, diversity)
        return _ranked(c.join(_taken(jobs, chosen, k), ["job_id", "id"]), score, order, by_score)

    def value(x):
        return F.round(quality * x["s"] - diversity * x["m"], 9)

    def pick(acc, _):
        first = F.get(acc["left"], F.lit(0))
        best_of = F.aggregate(acc["left"], first, lambda b, x: F.when(value(x) > value(b), x).otherwise(b))

        def take(best):
            rest = F.filter(acc["left"], lambda x: x["id"] != best["id"])
            rest = F.transform(rest, lambda x: F.struct(x["o"].alias("o"), x["id"].alias("id"), x["s"].alias("s"), x["v"].alias("v"), F.greatest(x["m"], F.round(similarity(x["v"], best["v"]), 9)).alias("m")))
            return F.struct(F.concat(acc["out"], F.array(best["id"])).alias("out"), rest.alias("left"))

        return F.when(F.size(acc["left"]) == 0, acc).otherwise(T.let(best_of, take))

    zero = F.struct(F.array().cast("array<string>").alias("out"), F.col("a").alias("left"))
    chosen = F.aggregate(F.sequence(F.lit(1), F.lit(k)), zero, pick, lambda acc: acc["out"])
    return _ranked(c.join(_taken(jobs, chosen, k), ["job_id", "id"]), score, order, by_score)


def _taken(jobs: DataFrame, chosen: Column, k: int) -> DataFrame:
    """(job_id, _few, _pick, id): all rows of jobs of k rows or fewer, and the chosen of the others."""
    few, ids = F.size("a") <= k, lambda c: F.posexplode(c).alias("_pick", "id")
    small = jobs.where(few).select("job_id", F.lit(True).alias("_few"), ids(F.transform("a", lambda x: x["id"])))
    return small.unionByName(jobs.where(~few).select("job_id", F.lit(False).alias("_few"), ids(chosen)))


def _mmr_of_buckets(k: int, quality: float, diversity: float) -> Column:
    """The ids that mmr_top_k takes of the rows `a` of a job, with vectors of hash buckets."""

    def fold(scores, buckets):
        s, v = np.array(scores, np.float64), V.dense(buckets)
        most, left, out = np.zeros(len(s)), np.ones(len(s), bool), []
        for _ in range(min(k, len(s))):
            value = np.where(left, V.half_up(quality * s - diversity * most), -np.inf)
            best = int(value.argmax())  # the first of equals
            out.append(best)
            left[best] = False
            most = np.maximum(most, V.cosines(v, v[best]))
        return out

    part = lambda n: F.transform("a", lambda x: x[n])
    return F.transform(V.over_jobs(fold, "array<int>", part("s"), part("v")), lambda i: F.get("a", i)["id"])


def _ranked(taken: DataFrame, score: str, order: str, by_score: bool) -> DataFrame:
    places = [F.desc(score), order] if by_score else [F.desc(F.when(~F.col("_few"), F.col(score))), F.when(F.col("_few"), F.col(order)).otherwise(F.col("_pick"))]
    return taken.withColumn("final_rank", F.row_number().over(Window.partitionBy("job_id").orderBy(*places))).drop("_few", "_pick")


def mmr_top_k_large(c: DataFrame, keep: Callable[[DataFrame], DataFrame], k: int = 20, quality: float = 0.7, diversity: float = 0.3, similarity=T.bucket_cosine, score: str = "final_score", order: str = "position", vector: str = "v", by_score: bool = False) -> DataFrame:
    """mmr_top_k for jobs too large for one row: a round is one max_by per job, pre-aggregated, joined back to its rows.

    `keep` cuts lineage after a round, by a written table for instance.
    """
    sizes = c.groupBy("job_id").agg((F.count("*") > k).alias("_big"))
    rows = c.select("job_id", "id", F.col(order).alias("o"), F.col(score).alias("s"), F.col(vector).alias("v")).join(sizes, "job_id")
    chosen = rows.where(~F.col("_big")).select("job_id", "id", F.lit(True).alias("_few"), F.lit(0).alias("_pick"))
    left = keep(rows.where("_big").drop("_big").withColumn("m", F.lit(0.0)))
    for i in range(k):
        value = F.round(quality * F.col("s") - diversity * F.col("m"), 9)
        best = keep(left.groupBy("job_id").agg(F.max_by(F.struct("id", "v"), F.struct(value.alias("value"), (-F.col("o")).alias("o"))).alias("b")))
        chosen = chosen.unionByName(best.select("job_id", "b.id", F.lit(False).alias("_few"), F.lit(i).alias("_pick")))
        left = keep(left.join(best, "job_id").where(F.col("id") != F.col("b.id")).withColumn("m", F.greatest("m", F.round(similarity(F.col("v"), F.col("b.v")), 9))).drop("b"))
    return _ranked(c.join(chosen, ["job_id", "id"]), score, order, by_score)


def explain(ranked: DataFrame) -> DataFrame:
    """Adds explanation: rank and score, strongest and weakest stage, and the lead over the next."""
    stages = F.array(*[F.struct(F.col(f"{s}_score").alias("s"), F.lit(-i).alias("i"), F.lit(s).alias("n")) for i, s in enumerate(("hook_quality", "narrative", "context", "density", "retention", "novelty"))])
    best, worst = F.array_max(stages), F.array_min(F.transform(stages, lambda x: F.struct(x["s"].alias("s"), (-x["i"]).alias("i"), x["n"].alias("n"))))
    gap = F.col("final_score") - F.lead("final_score").over(Window.partitionBy("job_id").orderBy("final_rank"))
    text = F.concat_ws(
        " | ", F.format_string("Rank #%d with score %s (confidence: %s)", "final_rank", F.col("final_score").cast("string"), F.col("overall_confidence").cast("string")),
        F.concat(F.lit("Strongest signal: "), best["n"], F.lit(" ("), best["s"].cast("string"), F.lit(")")), F.concat(F.lit("Weakest signal: "), worst["n"], F.lit(" ("), worst["s"].cast("string"), F.lit(")")),
        F.when(gap.isNotNull(), F.format_string("Leads next candidate by %.4f", gap)),
    )
    return ranked.withColumn("explanation", text)


def with_vectors(c: DataFrame) -> DataFrame:
    v = {f"{n}_v": T.hash_buckets(F.col(f"{n}_text")) for n in ("hook", "body", "ending")}
    return c.withColumns(v).withColumn("v", F.concat(*v))


def rank(candidates: DataFrame, top_k: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ranked clips, eliminated candidates, and the funnel of each job."""
    passed, gone = hard_constraints(candidates)
    scored = retention(density(hook_quality(context(narrative(with_vectors(passed))))))
    placed = tie_break(final_score(novelty(scored)))
    ranked = explain(mmr_top_k(placed, top_k))
    n = candidates.groupBy("job_id").agg(F.count("*").alias("n_in")).join(passed.groupBy("job_id").agg(F.count("*").alias("n_passed")), "job_id", "left").join(ranked.groupBy("job_id").agg(F.count("*").alias("n_ranked")), "job_id", "left")
    return ranked, gone, n.fillna(0)


def preview(candidates: DataFrame, ranked: DataFrame, k: int = 20) -> DataFrame:
    """The first k candidates, in their own order, that were ranked."""
    kept = candidates.join(ranked.select("job_id", "id"), ["job_id", "id"], "left_semi")
    return kept.withColumn("preview_pos", F.row_number().over(Window.partitionBy("job_id").orderBy("rank"))).where(F.col("preview_pos") <= k)


# -- portfolio --------------------------------------------------------------------------------


def narrative_order(scored: DataFrame) -> DataFrame:
    return scored.withColumn("narrative_pos", F.row_number().over(Window.partitionBy("job_id").orderBy("start_s", "id")))


def portfolio_select(scored: DataFrame, top_k: int = 20, policy: str = "balanced", similarity=T.jaccard) -> DataFrame:
    """MMR on the Jaccard similarity of event_ids; the first taken is the one with the best score."""
    from ..config import PORTFOLIO_POLICIES

    q, d = PORTFOLIO_POLICIES[policy]
    return mmr_top_k(scored, top_k, q, d, similarity, score="score", order="narrative_pos", vector="event_ids", by_score=True)


def portfolio_summary(selected: DataFrame, scored: DataFrame) -> DataFrame:
    """(job_id, mean_score, selected, rejected, diversity): diversity is 1 less the mean similarity of two selected."""
    s = selected.select("job_id", "id", "event_ids", "score")
    pairs = s.alias("a").join(s.alias("b"), (F.col("a.job_id") == F.col("b.job_id")) & (F.col("a.id") < F.col("b.id")))
    sim = pairs.groupBy(F.col("a.job_id").alias("job_id")).agg(F.avg(T.jaccard(F.col("a.event_ids"), F.col("b.event_ids"))).alias("sim"))
    n = scored.groupBy("job_id").agg(F.count("*").alias("n")).join(s.groupBy("job_id").agg(F.avg("score").alias("mean"), F.count("*").alias("selected")), "job_id", "left").join(sim, "job_id", "left")
    return n.select("job_id", F.round(F.coalesce("mean", F.lit(0.0)), 4).alias("mean_score"), F.coalesce("selected", F.lit(0)).alias("selected"), (F.col("n") - F.coalesce("selected", F.lit(0))).alias("rejected"), F.round(1 - F.coalesce("sim", F.lit(0.0)), 4).alias("diversity"))
