"""Queries of the analytic operators over the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sql
from .functions import text as T
from .operators import blueprints as BP
from .operators import candidates as C
from .operators import composer as CO
from .operators import dedup as D
from .operators import evaluation as EV
from .operators import features as FE
from .operators import graph as G
from .operators import objectives as O
from .operators import ranking as R
from .operators import strategies as ST_SPLIT
from .operators import stories as K
from .operators import telemetry as P
from .operators import topics as TP
from .operators import transcript as TR
from .plans import bindings as B
from .sources import tables as S
from .streaming import events as ST
from .streaming import ordered as OR
from .streaming.sinks import BatchTable

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


@query("b_text_functions", sql.B_TEXT)
def _(spark, d):
    t = F.col("text")
    return B.chunks(spark, d).select(
        "job_id", "chunk_idx", F.size(T.split_sentences(t)).alias("n_sentences"), T.snippet([t], 5).alias("snippet"), F.round(T.speech_density(t), 6).alias("speech_density"),
        T.word_count(t).alias("words"), F.round(T.unique_ratio(t), 6).alias("unique_ratio"), T.has_digit(t).alias("has_digit"), T.has_any(t, ("ion", "schw")).alias("has_sub"),
        T.has_any_token(t, ("the", "der")).alias("has_token"), T.starts_with_any(t, ("the", "la")).alias("starts"), F.size(T.title_tokens(t)).alias("titles"),
        T.token_estimate(t).cast("long").alias("tokens3"), T.token_estimate(t, 4).cast("long").alias("tokens4"), F.round(T.db_to_energy(F.col("start_s") - 60), 6).alias("energy"),
        F.size(T.content_words(t, ("the", "of", "and"))).alias("content"), T.signature(F.col("chunk_id"), F.split(t, " ")).alias("signature"),
    )


@query("b10_jaccard", sql.B_JACCARD)
def _(spark, d):
    o = B.order_sets(spark, d, 50)
    w = Window.partitionBy("job_id").orderBy("ord")
    return o.withColumn("p", F.lag("event_ids").over(w)).where(F.col("p").isNotNull()).select("id", F.round(T.jaccard(F.col("event_ids"), F.col("p")), 6).alias("jaccard"))


@query("b11_cosine", sql.B_COSINE)
def _(spark, d):
    w = Window.partitionBy("job_id").orderBy("ord")
    v = B.vectors(spark, d).withColumn("p", F.lag("embedding").over(w)).where(F.col("p").isNotNull())
    return v.select("ord", F.round(T.cosine(F.col("embedding"), F.col("p")), 6).alias("cosine"), F.round(T.vector_norm(F.col("embedding")), 6).alias("norm"))


@query("b12_hash_buckets", sql.B_HASH)
def _(spark, d):
    c = B.chunks(spark, d).select("job_id", "chunk_idx", F.explode(T.hash_buckets(F.col("text"))).alias("bucket"))
    return c.groupBy("job_id", "bucket").agg(F.count("*").alias("n"))


@query("b15_task_id", sql.B_TASKS)
def _(spark, d):
    c = B.table(spark, d, "conversations").select(F.col("conv_id").alias("job_id"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    return c.select("job_id", "turn", T.task_id(F.col("job_id"), F.lit("annotate"), F.col("text"), F.col("turn")).alias("task_id"))


@query("c1_chunk_plan", sql.C_PLAN)
def _(spark, d):
    return TR.chunk_plan(_media(spark, d)).select("job_id", "duration", "chunk_s", "overlap_s", "workers")


def _media(spark, d) -> DataFrame:
    return B.chunks(spark, d).groupBy("job_id").agg(F.max("end_s").alias("duration"))


@query("c2_overlapping_ranges", sql.C_RANGES)
def _(spark, d):
    return TR.overlapping_ranges(TR.chunk_plan(_media(spark, d)))


@query("c3_merge_transcripts", sql.C_MERGE)
def _(spark, d):
    return TR.merge_transcripts(B.chunks(spark, d))


@query("c4_atomic_segments", sql.C_SEGMENTS)
def _(spark, d):
    return B.segments(spark, d)


@query("c5_classify_english", sql.C_ENGLISH)
def _(spark, d):
    return TR.atomic_segments(B.chunks(spark, d)).select("job_id", "ord", "kind")


@query("c6_merge_short", sql.C_SHORT)
def _(spark, d):
    return TR.merge_short(B.segments(spark, d))


@query("c7_detect_role", sql.C_ROLE)
def _(spark, d):
    return TR.detect_role(B.segments(spark, d)).select("job_id", "ord", "role")


@query("c8_pack_windows", sql.C_WINDOWS)
def _(spark, d):
    return TR.window_signals(TR.pack_windows(B.segments(spark, d))).withColumn("segment_ids", F.array_join("segment_ids", ","))


@query("c10_pack_text", sql.C_PIECES)
def _(spark, d):
    docs = B.table(spark, d, "documents").select(F.col("doc_id").alias("job_id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return TR.split_allocation(TR.pack_text(docs, 400), 2000)


def _paragraphs(spark, d) -> DataFrame:
    """The paragraphs of documents as C10 takes them, with their token estimates."""
    docs = B.table(spark, d, "documents").select(F.col("doc_id").alias("job_id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    p = docs.select("job_id", F.posexplode(F.split("text", "\n\n")).alias("ord", "part")).where(F.trim("part") != "")
    return p.select("job_id", "ord", T.token_estimate(F.col("part")).cast("double").alias("size"))


@query("c10_pack_large", sql.C_PIECE_BINS)
def _(spark, d):
    return TR.pack_large(_paragraphs(spark, d), "size", 400.0, S.materialize).select("job_id", "ord", "bin")


@query("c10_user_strategy", sql.C_PIECE_BINS)
def _(spark, d):
    return ST_SPLIT.split_by(_paragraphs(spark, d), ST_SPLIT.Greedy, 400.0)


@query("c12_validate_payload", sql.C_PAYLOAD)
def _(spark, d):
    t = B.table(spark, d, "documents").select(F.col("doc_id").alias("job_id"), T.token_estimate(F.col("text")).cast("long").alias("input_tokens"), (F.length("text") % 3000).cast("long").alias("output_tokens"))
    return TR.validate_payload(t, 1000, 2500)


def _ranking(spark, d) -> DataFrame:
    """The candidates, written once: every stage and count of a ranking reads them."""
    return S.materialize(B.ranking_candidates(spark, d), "candidates")


def _blocks(spark, d, spread: bool = False) -> DataFrame:
    return B.segments(spark, d, spread).withColumn("block_idx", F.floor(F.col("ord") / 25).cast("int"))


@query("c13_annotation_batches", sql.C_BATCHES)
def _(spark, d):
    joined = {c: F.array_join(c, ",") for c in ("segment_ids", "context_before", "context_after")}
    return TR.annotation_batches(_blocks(spark, d)).withColumns(joined)


@query("c14_parse_annotations", sql.C_PARSE)
def _(spark, d):
    a = TR.parse_annotations(B.raw_annotations(B.segments(spark, d)))[0]
    return a.withColumns({c: F.array_join(c, ",") for c in ("key_entities", "keywords")} | {c: F.round(c, 6) for c in TR.SCORE_FIELDS}).drop("semantic_embedding")


@query("c14_relationships", sql.C_RELATIONS)
def _(spark, d):
    return TR.parse_annotations(B.raw_annotations(B.segments(spark, d)))[1]


@query("c14_bad_rows", sql.C_BAD)
def _(spark, d):
    return TR.parse_annotations(B.raw_annotations(B.segments(spark, d), spoil=True))[2]


@query("c15_parse_boundaries", sql.C_BOUNDARIES)
def _(spark, d):
    b = TR.parse_boundaries(B.raw_boundaries(B.segments(spark, d)))
    return b.withColumns({c: F.array_join(c, ",") for c in ("segments", "ambiguous_segments")} | {"block_ids": F.get("block_ids", F.lit(0))})


@query("c15_bad_boundaries", sql.C_BAD_BOUNDARIES)
def _(spark, d):
    return TR.scan_boundaries(B.spoiled(B.raw_boundaries(B.segments(spark, d))))[1]


@query("c16_prompt_text", sql.C_PROMPT)
def _(spark, d):
    s = B.segments(spark, d)
    summaries = s.where("ord = 0 AND job_id % 2 = 0").select("job_id", F.substring("text", 1, 40).alias("summary"))
    return TR.prompt_text(TR.annotation_batches(_blocks(spark, d)), s, summaries, "Annotate.\n")


@query("c17_chunk_confidence", sql.C_CONFIDENCE)
def _(spark, d):
    e = B.events(spark, d)
    return TR.chunk_confidence(e.select("job_id", F.col("stage").alias("chunk_id"), (-F.col("elapsed_ms") / 500).alias("avg_logprob"))).withColumn("confidence", F.round("confidence", 6))


@query("c18_rtf_summary", sql.C_RTF)
def _(spark, d):
    e = B.events(spark, d).select("job_id", F.col("elapsed_ms").alias("total_ms"), F.col("tokens").alias("inference_ms"), (F.col("tokens") + 1).cast("double").alias("audio_s"))
    r = TR.rtf_summary(e)
    return r.select("job_id", *[F.round(c, 6).alias(c) for c in ("avg_rtf", "peak_rtf", "avg_ms")], "inference_ms", "audio_s", "n_chunks")


@query("d1_segment_features", sql.D_FEATURES)
def _(spark, d):
    return FE.non_fallback_count(B.features(spark, d))


@query("d3_block_priority", sql.D_PRIORITY)
def _(spark, d):
    return FE.block_priority(_blocks(spark, d))


@query("d4_frequent_terms", sql.D_TERMS)
def _(spark, d):
    return FE.frequent_terms(B.segments(spark, d, spread=True))


@query("d5_named_entities", sql.D_ENTITIES)
def _(spark, d):
    return FE.named_entities(B.segments(spark, d))


@query("d6_synopsis", sql.D_SYNOPSIS)
def _(spark, d):
    return FE.synopsis(_blocks(spark, d, spread=True), ("job_id", "block_idx"))


@query("d7_representative_excerpt", sql.D_EXCERPT)
def _(spark, d):
    v = B.vectors(spark, d).withColumns({"segment_id": F.col("ord").cast("string"), "text": F.concat(F.lit("vector "), "ord"), "start_s": F.col("ord").cast("double"), "end_s": F.col("ord") + 2.0})
    return FE.representative_excerpt(v)


@query("e1_embed_stored", sql.E_STORED)
def _(spark, d):
    """Texts of all turns embedded into a store, and read from it once more: the second run embeds nothing."""

    def load():
        return lambda texts: texts.map(lambda t: [float(len(t)), float(len(t.split(" ")))])

    turns, store = B.table(spark, d, "conversations"), S.work_path(spark, "embeddings")
    TP.embed_stored(turns, store, load)
    e = TP.embed_stored(turns, store, load)
    return e.select(F.col("conv_id").alias("job_id"), "turn", F.get("embedding", F.lit(0)).alias("chars"), F.get("embedding", F.lit(1)).alias("pieces"))


@query("e2_dynamic_windows")
def _(spark, d):
    return TP.dynamic_windows(B.segments(spark, d))


@query("e3_adjacent_similarity", sql.E_ADJACENT)
def _(spark, d):
    v = B.vectors(spark, d).withColumn("window_idx", F.row_number().over(Window.partitionBy("job_id").orderBy("ord")) - 1).withColumn("start_ord", F.col("window_idx"))
    s = TP.smooth(TP.adjacent_similarity(v, T.cosine, "embedding"))
    return s.select("job_id", "idx", F.round("sim", 6).alias("sim"), F.round("smoothed", 6).alias("smoothed"))


@query("e5_boundaries", sql.E_BOUNDARIES)
def _(spark, d):
    v = B.vectors(spark, d).withColumn("window_idx", F.row_number().over(Window.partitionBy("job_id").orderBy("ord")) - 1).withColumn("start_ord", F.col("window_idx"))
    b = TP.boundaries(TP.smooth(TP.adjacent_similarity(v, T.cosine, "embedding")))
    return b.select("job_id", "at", F.round("structural_confidence", 5).alias("structural_confidence"), F.round("z_score", 5).alias("z_score"))


@query("e6_topic_blocks")
def _(spark, d):
    t = TP.segment_topics(S.materialize(B.segments(spark, d), "segments"), tail="keep")
    return t.groupBy("job_id", "block_idx").agg(F.count("*").alias("n"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.round(F.max("structural_confidence"), 6).alias("structural_confidence"))


@query("e7_centroid", sql.E_CENTROID)
def _(spark, d):
    return TP.centroid(B.vectors(spark, d)).select("job_id", F.posexplode("centroid").alias("dim", "v")).select("job_id", "dim", F.round("v", 6).alias("v"))


@query("f1_knowledge_graph_nodes", sql.F_NODES)
def _(spark, d):
    s = B.segments(spark, d)
    return G.knowledge_graph(s, FE.segment_features(s))[0]


@query("f1_knowledge_graph_edges", sql.F_EDGES)
def _(spark, d):
    return G.knowledge_graph(B.segments(spark, d))[1]


@query("f2_evidence_nodes", sql.F_EVIDENCE)
def _(spark, d):
    return G.evidence_graph(TR.pack_windows(B.segments(spark, d)))[0]


@query("f2_evidence_edges", sql.F_TEMPORAL)
def _(spark, d):
    return G.evidence_graph(TR.pack_windows(B.segments(spark, d)))[1]


@query("g1_prune_by_kind", sql.G_PRUNE)
def _(spark, d):
    s = B.segments(spark, d)
    return C.prune_by_kind(s, B.full_features(s))[0].select("job_id", "segment_id", "kind", "score", "rank")


@query("g1_prune_stats", sql.G_STATS)
def _(spark, d):
    s = B.segments(spark, d)
    return C.prune_by_kind(s, B.full_features(s))[1]


@query("g2_clip_triples", sql.G_TRIPLES)
def _(spark, d):
    s = B.segments(spark, d)
    t = C.clip_triples(C.prune_by_kind(s, B.full_features(s))[0])
    return t.select("job_id", "h_segment_id", "b_segment_id", "e_segment_id", "h_start_s", "e_end_s")


@query("g5_generate_candidates", sql.G_CANDIDATES)
def _(spark, d):
    return B.clips(spark, d).select("job_id", "id", "duration", "flow_score", "total_score", "snippet", "rank")


@query("g9_merge_strategies", sql.G_STRATEGIES)
def _(spark, d):
    return C.merge_strategies(B.segments(spark, d)).withColumn("segment_ids", F.array_join("segment_ids", ","))


@query("h_score_objectives", sql.H_OBJECTIVES)
def _(spark, d):
    o = O.score_objectives(C.to_scored(B.clips(spark, d)))
    return o.select("job_id", "id", *[F.round(F.col(n)["score"], 6).alias(n) for n in O.REGISTRY], "overall_score")


@query("h_failing_objective", sql.H_FAILING)
def _(spark, d):
    own = {
        "ratio": lambda: F.struct(F.try_divide(F.lit(1.0), F.floor(F.col("end_s") - F.col("start_s")) % 4).alias("score"), F.lit(0.9).alias("confidence"), F.lit("success").alias("status")),
        "lost": lambda: O._result(F.col("no_such_column"), 1.0),
        "half": lambda: O._result(0.5, 0.5),
    }
    o = O.score_objectives(C.to_scored(B.clips(spark, d)), own)
    return o.select("job_id", "id", F.round("ratio.score", 6).alias("ratio"), F.col("ratio.status").alias("ratio_status"), F.col("lost.status").alias("lost_status"), "overall_score")


@query("i1_greedy_dedup", sql.I_GREEDY)
def _(spark, d):
    return D.greedy_dedup(B.order_sets(spark, d), threshold=0.1)[1].select("job_id", "id", "similar_to", "similarity")


@query("i1_greedy_dedup_large", sql.I_KEPT)
def _(spark, d):
    return D.greedy_dedup_large(B.order_sets(spark, d), S.materialize, threshold=0.1).select("job_id", "id")


@query("i3_blueprint_dedup")
def _(spark, d):
    c = S.materialize(B.clips(spark, d), "clips").select("job_id", "id", F.col("rank").alias("ord"), F.split("id", "_").alias("segment_ids"), F.concat_ws(" ", "hook_text", "body_text", "ending_text").alias("text"))
    return D.blueprint_dedup(c.withColumn("signature", T.signature(F.lit("s"), F.col("segment_ids"))))[1].select("job_id", "id", "reason")


def _set_boundaries(spark, d) -> DataFrame:
    o = B.order_sets(spark, d, 40)
    c = F.col("score")
    return o.select(F.floor(F.col("ord") / 40).alias("job_id"), F.col("ord").alias("idx"), F.col("event_ids").alias("segments"), *[c.alias(f"{n}_confidence") for n in ("start", "end", "boundary", "structural")])


@query("i4_overlap_clusters")
def _(spark, d):
    return D.best_of_cluster(D.overlap_clusters(_set_boundaries(spark, d))).select("job_id", "idx", "cluster")


@query("i4_clusters_large")
def _(spark, d):
    return D.overlap_clusters_large(_set_boundaries(spark, d), S.materialize).select("job_id", "idx", "cluster")


@query("i6_merge_boundaries")
def _(spark, d):
    s = B.segments(spark, d)
    return D.merge_boundaries(B.boundaries(s), s).select("job_id", "idx", F.array_join("segments", ",").alias("segment_ids"), "name", F.round("boundary_confidence", 6).alias("boundary_confidence"))


@query("i7_content_hash_dedup", sql.I_CONTENT)
def _(spark, d):
    return D.content_hash_dedup(B.table(spark, d, "documents").withColumnRenamed("doc_id", "id"))


def _composed(spark, d, tallied=False):
    s = S.materialize(B.segments(spark, d), "segments")
    return CO.compose(s, B.annotations(s), S.materialize, tallied=tallied)


@query("j_compose")
def _(spark, d):
    return _composed(spark, d)[0].select("job_id", "idx", F.array_join("segments", ",").alias("segment_ids"), "name", "summary", "boundary_confidence")


@query("j15_story_health")
def _(spark, d):
    return _composed(spark, d)[2].drop("segments")


@query("j16_composer_stats")
def _(spark, d):
    _, decisions, health = _composed(spark, d, tallied=True)
    return CO.composer_stats(decisions, health)


@query("j17_selection_entropy")
def _(spark, d):
    return CO.selection_entropy(_composed(spark, d, tallied=True)[1])


@query("j18_composer_report")
def _(spark, d):
    return CO.composer_report(_composed(spark, d, tallied=True)[1])


@query("j19_composed_clusters")
def _(spark, d):
    return D.best_of_cluster(D.overlap_clusters(_composed(spark, d)[0])).select("job_id", "idx", "cluster", F.size("segments").alias("n"))


def _candidates(spark, d):
    """Segments, annotations and verified candidates, each written once, as all steps read them."""
    s = S.materialize(B.segments(spark, d), "segments")
    a = S.materialize(B.annotations(s), "annotations")
    return s, a, S.materialize(K.verify(K.form_candidates(B.boundaries(s), s, a)), "verified")


def _as_stories(c):
    return c.withColumn("story_id", F.regexp_replace("candidate_id", "^cand_", "story_")).withColumn("version", F.lit(1))


def _validated(spark, d):
    s, a, c = _candidates(spark, d)
    repaired, rejected, records = K.repair(c, s, a)
    return s, a, *K.validate(repaired, rejected, a), records


@query("k2_verify", sql.K_VERIFY)
def _(spark, d):
    return _candidates(spark, d)[2].select("job_id", "candidate_id", F.array_join("issues", ",").alias("issues"), "verified")


@query("k6_repair")
def _(spark, d):
    s, a, c = _candidates(spark, d)
    ok, gone, _ = K.repair(c, s, a)
    row = ["job_id", "story_id", "version", F.array_join("segment_ids", ",").alias("segment_ids"), F.array_join("repair_actions", ",").alias("actions")]
    return ok.select(*row, F.lit("").alias("rejection")).unionByName(gone.select(*row, F.col("rejection_reason").alias("rejection")))


@query("k6_repair_rate")
def _(spark, d):
    return K.repair_rate(_validated(spark, d)[4])


@query("k7_story_quality", sql.K_QUALITY)
def _(spark, d):
    _, a, c = _candidates(spark, d)
    return K.story_quality(_as_stories(c), a).withColumn("reason", F.coalesce(K.reject_reason(), F.lit(""))).select("job_id", "story_id", *K.QUALITY_WEIGHTS, "story_quality_score", "quality_explanation", "reason")


@query("k10_validated_stories")
def _(spark, d):
    return _validated(spark, d)[2].select("job_id", "story_id", "story_priority", "story_quality_score", "validated_summary")


@query("k7_quality_of_parsed", sql.K_QUALITY)
def _(spark, d):
    """Annotations and boundaries as JSON, parsed, and the stories' quality from these."""
    s = S.materialize(B.segments(spark, d), "segments")
    raw = B.annotations(s).groupBy("job_id").agg(F.to_json(F.struct(F.collect_list(F.struct(*[c for c in B.annotations(s).columns if c != "job_id"])).alias("annotations"))).alias("raw"))
    a = S.materialize(TR.parse_annotations(raw)[0], "annotations")
    c = K.verify(K.form_candidates(TR.parse_boundaries(B.raw_boundaries(s)), s, a))
    return K.story_quality(_as_stories(c), a).withColumn("reason", F.coalesce(K.reject_reason(), F.lit(""))).select("job_id", "story_id", *K.QUALITY_WEIGHTS, "story_quality_score", "quality_explanation", "reason")


@query("k11_coverage", sql.K_COVERAGE)
def _(spark, d):
    s, _, c = _candidates(spark, d)
    return K.coverage(c.where("verified"), c.where("NOT verified"), s).withColumn("unused_segments", F.array_join("unused_segments", ","))


@query("l4_build_blueprint", sql.L_BUILD)
def _(spark, d):
    s, a, c = _candidates(spark, d)
    x = BP.build_blueprint(BP.story_cuts(BP.with_items(K.story_quality(_as_stories(c), a), a, s), cuts="full"))
    total = F.round(F.aggregate("cut_timestamps", F.lit(0.0), lambda t, v: t + v), 3).alias("cut_sum")
    return x.select("job_id", "blueprint_id", "story_id", "opening_segment", "ending_segment", "start_time", "end_time", F.size("cut_timestamps").alias("n_cuts"), total, "cut_confidence", "blueprint_confidence", "signature", F.size("story_arc").alias("arc_size"))


@query("l3_story_cuts")
def _(spark, d):
    s, a, ok, _, _ = _validated(spark, d)
    x = BP.build_blueprint(BP.story_cuts(BP.with_items(ok, a, s), short_max=15.0))
    return x.select("job_id", "story_id", "cut", "notes", F.array_join("segment_ids", ",").alias("segment_ids"))


@query("l5_blueprints")
def _(spark, d):
    s, a, ok, _, _ = _validated(spark, d)
    return BP.generate_blueprints(ok, a, s, S.materialize)[0].select("job_id", "blueprint_id", "rank", "blueprint_confidence", "signature")


@query("l5_segment_usage")
def _(spark, d):
    s, a, ok, _, _ = _validated(spark, d)
    return BP.generate_blueprints(ok, a, s, S.materialize)[1].select("job_id", "segment_id", "usage_count", F.array_join("blueprint_ids", ",").alias("blueprint_ids"))


@query("m1_hard_constraints", sql.M_CONSTRAINTS)
def _(spark, d):
    ok, gone = R.hard_constraints(B.ranking_candidates(spark, d))
    x = ok.select("job_id", "id", F.lit("").alias("reasons")).unionByName(gone.select("job_id", "id", F.array_join("reasons", ",").alias("reasons")))
    return x


@query("m_stage_scores", sql.M_STAGES)
def _(spark, d):
    c = R.retention(R.density(R.hook_quality(R.context(B.ranking_candidates(spark, d)))))
    cols = [f"{s}_{k}" for s in ("context", "hook_quality", "density", "retention") for k in ("score", "confidence")]
    return c.select("job_id", "id", *cols)


@query("m2_narrative")
def _(spark, d):
    return R.narrative(R.with_vectors(_ranking(spark, d))).select("job_id", "id", "narrative_score", "narrative_confidence", "raw_score")


@query("m9_tie_break_exact")
def _(spark, d):
    c = R.with_vectors(_ranking(spark, d))
    scored = R.final_score(R.novelty(R.retention(R.density(R.hook_quality(R.context(R.narrative(c)))))))
    return R.tie_break(scored, exact=True).select("job_id", "id", "final_score", "position")


@query("m13_rank")
def _(spark, d):
    return R.rank(_ranking(spark, d), 5)[0].select("job_id", "id", "final_rank", "final_score", "overall_confidence", "novelty_score", "explanation")


@query("m13_funnel", sql.M_FUNNEL)
def _(spark, d):
    return R.rank(_ranking(spark, d), 5)[2]


@query("m14_preview")
def _(spark, d):
    c = _ranking(spark, d)
    return R.preview(c, R.rank(c, 5)[0], 3).select("job_id", "id", "preview_pos")


@query("n2_portfolio", sql.N_PORTFOLIO)
def _(spark, d):
    return R.portfolio_select(R.narrative_order(B.order_sets(spark, d)), 5, "diverse").select("job_id", "id", "final_rank", "narrative_pos")


@query("n3_portfolio_summary", sql.N_SUMMARY)
def _(spark, d):
    s = R.narrative_order(B.order_sets(spark, d))
    return R.portfolio_summary(R.portfolio_select(s, 5, "diverse"), s)


@query("o1_evaluation_records", sql.O_RECORDS)
def _(spark, d):
    return EV.evaluation_records(B.order_sets(spark, d)).select("job_id", "clip_id", "lifecycle", "overall_score", "portfolio_rank")


@query("o2_ground_truth", sql.O_TRUTH)
def _(spark, d):
    docs = B.table(spark, d, "documents").select(F.col("doc_id").alias("job_id"), F.col("doc_id").cast("string").alias("id"), (F.col("n_chars") / 1e6).alias("score"))
    truth = B.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("clip_id"), "quality", "toxic", F.lit(1).alias("seq"))
    return EV.apply_ground_truth(EV.evaluation_records(docs), truth).select("clip_id", "lifecycle", F.col("ground_truth.quality").alias("quality"))


@query("o3_learning_labels")
def _(spark, d):
    c = _ranking(spark, d)
    r = S.materialize(R.rank(c, 10)[0], "ranked")
    return EV.learning_labels(R.preview(c, r), r)


@query("o4_job_analytics", sql.O_ANALYTICS)
def _(spark, d):
    c = B.clips(spark, d)
    a = EV.job_analytics(B.chunks(spark, d), c, c.where("rank <= 3"), TR.chunk_plan(_media(spark, d)))
    return a.withColumn("utilisation", F.round("utilisation", 6))


@query("a4_pending", sql.A_PENDING)
def _(spark, d):
    return S.pending(B.table(spark, d, "documents").select("doc_id"), B.table(spark, d, "labels"), ["doc_id"])


@query("a4_pending_batches", sql.A_BATCHES)
def _(spark, d):
    docs = B.table(spark, d, "documents").select(F.floor(F.col("doc_id") / 3).alias("batch"), "doc_id")
    return S.pending_batches(docs, B.table(spark, d, "labels"), ["batch"], "doc_id")


@query("a5_lineage", sql.A_LINEAGE)
def _(spark, d):
    return EV.lineage(B.table(spark, d, "documents"), "documents")


@query("a6_snapshot", sql.A_SNAPSHOT)
def _(spark, d):
    return EV.snapshot(B.chunks(spark, d), "chunks", {"pace": "2.5"}).select("stage", "job_id", "n_rows")


@query("a1_transcripts", sql.A_TRANSCRIPTS)
def _(spark, d):
    """Chunks written as nested transcripts and read back."""
    path, c = S.work_path(spark, "transcripts"), B.chunks(spark, d).withColumn("confidence", F.lit(None).cast("double"))
    S.write_transcripts(c, TR.merge_transcripts(c), path)
    return S.read_transcripts(spark, path, multi_line=False)


@query("a2_replaced_partitions", sql.A_REPLACED)
def _(spark, d):
    """documents by language, then one language written anew."""
    path, docs = S.work_path(spark, "stages"), B.table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", "n_chars", "lang")
    S.replace_partitions(docs.withColumn("version", F.lit("old")), path, "documents", "lang")
    out = S.replace_partitions(docs.where("lang = 'en'").withColumn("version", F.lit("new")), path, "documents", "lang")
    return out.groupBy("lang", "version").agg(F.count("*").alias("n_rows"), F.sum("n_chars").alias("n_chars"))


@query("a7_allowed_media", sql.A_MEDIA)
def _(spark, d):
    p = B.table(spark, d, "pages")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".mp4", ".MOV", ".txt", ".webm", ".html")]), (F.col("page_id") % 5 + 1).cast("int"))
    return S.allowed_media(p.select("page_id", F.concat("url", ext).alias("path"), (F.length("html") * (F.col("page_id") % 3)).cast("long").alias("length")))


@query("p1_latency_stats", sql.P_LATENCY)
def _(spark, d):
    return P.latency_stats(B.events(spark, d))


_STAGES = {"view": 100, "error": 200, "click": 50}


@query("p2_budget_status", sql.P_BUDGET)
def _(spark, d):
    return P.budget_status(B.events(spark, d), _STAGES).select("seq", "stage", "budget_ms", "status")


@query("p3_budget_enforcement", sql.P_ENFORCE)
def _(spark, d):
    return P.budget_enforcement(B.events(spark, d), _STAGES).select("seq", "warnings", "disabled")


@query("p4_run_summary", sql.P_RUNS)
def _(spark, d):
    e = B.events(spark, d)
    outcome = F.when(F.col("stage") == "error", "failed").when(F.col("stage") == "view", "skipped").otherwise("succeeded")
    return P.run_summary(e.select(F.col("key").alias("run_id"), "elapsed_ms", outcome.alias("outcome")))


@query("p5_usage_60s", sql.P_USAGE)
def _(spark, d):
    return P.usage_60s(B.events(spark, d)).select("seq", "tokens_60s", "requests_60s", "token_room", "request_room")


_NAMES = {"signup": "queued", "view": "started", "purchase": "completed", "click": "queued", "error": "failed"}


def _requests(spark, d) -> DataFrame:
    e = B.events(spark, d)
    name = F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv])[F.col("name")]
    return e.select("seq", "ts", "key", F.date_format("ts", "yyyy-MM-dd").alias("request_id"), name.alias("name"))


@query("p6_queue_times", sql.P_QUEUE)
def _(spark, d):
    return P.queue_times(_requests(spark, d))


@query("p7_queue_depth", sql.P_DEPTH)
def _(spark, d):
    return P.queue_depth(_requests(spark, d))


@query("p8_failure_runs", sql.P_FAILURES)
def _(spark, d):
    return P.failure_runs(B.events(spark, d)).select("key", "run", "weight", "failures")


def _streamed(spark, d, make, schema: str) -> DataFrame:
    """What a keyed stream over events gives out, in a table of batches."""
    old = spark.conf.get(OR.STORE[0], None)
    spark.conf.set(*OR.STORE)
    try:
        stream = spark.readStream.schema(B.table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
        path = S.work_path(spark, "events")
        table = BatchTable(spark, f"{path}/table")
        make(B.as_events(stream)).writeStream.foreachBatch(table.write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        if old is None:
            spark.conf.unset(OR.STORE[0])
        else:
            spark.conf.set(OR.STORE[0], old)
    return table.read(schema)


@query("p3_budget_stream", sql.P_ENFORCE_STREAM)
def _(spark, d):
    make = lambda e: OR.budget_enforcement(P.with_budget(e, _STAGES), idle="3650 days")
    return _streamed(spark, d, make, "stage string, seq long, warnings int, disabled boolean")


@query("p8_alarm_stream", sql.P_ALARMS)
def _(spark, d):
    return _streamed(spark, d, lambda e: OR.failure_alarms(e, idle="3650 days"), "key long, seq long, weight int")


@query("p9_job_status", sql.P_STATUS)
def _(spark, d):
    e = B.events(spark, d)
    s = F.when(F.col("name") == "purchase", "complete").when(F.col("name") == "error", "failed").otherwise("running")
    return P.job_status(e.select("job_id", "seq", "ts", s.alias("status"), (F.col("elapsed_ms") / 200).alias("progress"))).select("job_id", "status", F.round("progress", 6).alias("progress"), F.col("completed_at").isNotNull().alias("done"))


@query("p10_event_counts", sql.P_COUNTS)
def _(spark, d):
    c = ST.event_counts(B.events(spark, d), "1 hour")
    return c.select(F.unix_seconds("window_start").alias("window_start"), "name", "n")


@query("p11_job_sessions", sql.P_SESSIONS)
def _(spark, d):
    s = ST.job_sessions(B.events(spark, d), "6 hours")
    return s.select("job_id", F.unix_micros("session_start").alias("session_start"), "n_events", "duration_us")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
