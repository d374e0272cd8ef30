"""Transcript shaping: chunks to sentences, segments, windows and batches, keyed by job_id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ENGLISH, Lexicon
from ..functions import text as T

def in_order():
    return Window.partitionBy("job_id").orderBy("ord")


def so_far():
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def per_job():
    return Window.partitionBy("job_id")


def chunk_plan(media: DataFrame, density: float = 0.5) -> DataFrame:
    """Adds chunk_s, overlap_s and workers from duration and speech density."""
    d = F.col("density") if "density" in media.columns else F.lit(density)
    base = T.steps((F.col("duration") < 600, 30), (F.col("duration") < 3600, 45), otherwise=90)
    workers = T.steps((F.col("duration") < 600, 3), otherwise=5)
    chunk = F.least(F.greatest(F.rint(base * (1 + (0.5 - d) * 0.6)), F.lit(20.0)), F.lit(120.0))
    overlap = F.greatest(F.lit(2.0), F.rint(2 + (1 - d) * 2))
    return media.withColumns({"chunk_s": chunk.cast("int"), "overlap_s": overlap.cast("int"), "workers": workers})


def overlapping_ranges(media: DataFrame) -> DataFrame:
    """(job_id, idx, start_s, end_s): ranges of chunk_s that step by chunk_s - overlap_s; the last ends at duration."""
    step = F.greatest(F.col("chunk_s") - F.col("overlap_s"), F.lit(0.5))
    n = F.greatest(F.lit(1), F.ceil((F.col("duration") - F.col("chunk_s")) / step) + 1).cast("int")
    at = media.where(F.col("duration") > 0).select("job_id", "duration", "chunk_s", step.alias("step"), F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"))
    start = F.col("idx") * F.col("step")
    return at.select("job_id", "idx", start.cast("double").alias("start_s"), F.least(start + F.col("chunk_s"), F.col("duration")).cast("double").alias("end_s"))


def sentences(chunks: DataFrame) -> DataFrame:
    """Chunks with one row per sentence: sent_idx, sentence and n_sent; a chunk without sentences keeps one blank row."""
    s = chunks.withColumn("_s", T.split_sentences(F.col("text")))
    s = s.select("*", F.greatest(F.size("_s"), F.lit(1)).alias("n_sent"), F.posexplode_outer("_s").alias("_p", "_t"))
    return s.withColumns({"sent_idx": F.coalesce("_p", F.lit(0)), "sentence": F.coalesce("_t", F.lit(""))}).drop("_s", "_p", "_t")


def merge_transcripts(chunks: DataFrame) -> DataFrame:
    """(job_id, merged_text): the first of sentences that are equal but for case and outer blanks, in order."""
    s = sentences(chunks).where(F.col("sentence") != "")
    key = F.lower(F.trim("sentence"))
    first = F.row_number().over(Window.partitionBy("job_id", key).orderBy("chunk_idx", "sent_idx"))
    kept = s.withColumn("_n", first).where("_n = 1")
    at = F.struct("chunk_idx", "sent_idx", "sentence")
    return kept.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda x: x["sentence"]), " ").alias("merged_text"))


def classify_kind(sentence: Column, idx: Column, total: Column, lex: Lexicon = ENGLISH) -> Column:
    hook = (idx == 0) & (T.matches_any(sentence, lex.hook_patterns) | T.has_any(sentence, lex.hook_words))
    ending = (idx == total - 1) & (T.matches_any(sentence, lex.ending_patterns) | T.has_any(sentence, lex.ending_words))
    return T.steps((hook, "hook"), (ending, "ending"), otherwise="body")


def atomic_segments(chunks: DataFrame, lex: Lexicon = ENGLISH) -> DataFrame:
    """One row per sentence; the sentences of a chunk share its span equally."""
    s = sentences(chunks)
    step = F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.1)) / F.col("n_sent")
    begin = F.col("start_s") + F.col("sent_idx") * step
    order = Window.partitionBy("job_id").orderBy("chunk_idx", "sent_idx")
    return s.select(
        "job_id", F.concat(F.lit("seg_"), F.col("chunk_id"), F.lit("_"), F.col("sent_idx")).alias("segment_id"),
        T.rounded(begin, 3).alias("start_s"), T.rounded(F.least(F.col("end_s"), begin + step), 3).alias("end_s"), F.col("sentence").alias("text"),
        classify_kind(F.col("sentence"), F.col("sent_idx"), F.col("n_sent"), lex).alias("kind"), (F.row_number().over(order) - 1).alias("ord"),
    )


def merge_short(segments: DataFrame, min_duration: float = 1.2) -> DataFrame:
    """Appends short segments to the one kept before; a leading run of short ones joins the first long one."""
    long_ = (F.col("end_s") - F.col("start_s") >= min_duration).cast("int")
    g = segments.withColumn("_long", long_).withColumn("_g", F.greatest(F.sum("_long").over(so_far()), F.lit(1)))
    row = F.struct("ord", "text")
    kept = F.min_by(F.struct("segment_id", "kind", "ord"), F.struct(1 - F.col("_long"), F.col("ord")))
    m = g.groupBy("job_id", "_g").agg(kept.alias("k"), F.min("start_s").alias("start_s"), F.max_by("end_s", "ord").alias("end_s"), F.array_sort(F.collect_list(row)).alias("t"))
    return m.select("job_id", "k.segment_id", "start_s", "end_s", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"), "k.kind", "k.ord")


def detect_role(segments: DataFrame) -> DataFrame:
    i, n = F.row_number().over(in_order()), F.count("*").over(per_job())
    t = F.col("text")
    hook = (i == 1) | T.has_question(t) | T.has_any(t, ("secret", "truth", "why"))
    ending = (i == n) | T.has_any(t, ("so", "therefore", "subscribe"))
    return segments.withColumn("role", T.steps((hook, "hook"), (ending, "ending"), (T.has_any(t, ("haha", "lol", "omg")), "reaction"), otherwise="body"))


def pack_large(items: DataFrame, size: str, limit: float, keep: Callable[[DataFrame], DataFrame], order: str = "ord") -> DataFrame:
    """pack() for jobs too large for one row: each item's next bin start is found by one sort, and the starts that
    occur by doubling the reach of these pointers, in about log2(bins) joins.

    Sums are exact to six decimals (not of floats, added one by one), sizes are not negative, and `order` has no ties.
    `keep` cuts lineage after a round, by a written table for instance.
    """
    w = Window.partitionBy("job_id").orderBy("o")
    rows = items.select("job_id", F.col(order).alias("o"), F.col(size).cast("decimal(28,6)").alias("s")).withColumns({"i": F.row_number().over(w) - 1, "upto": F.sum("s").over(w)})
    rows = keep(rows)
    ends = rows.select("job_id", F.col("upto").alias("v"), F.lit(1).alias("kind"), "i")
    asks = rows.select("job_id", (F.col("upto") - F.col("s") + F.lit(limit).cast("decimal(28,6)")).alias("v"), F.lit(2).alias("kind"), "i")
    fits = F.count_if(F.col("kind") == 1).over(Window.partitionBy("job_id").orderBy("v", "kind").rangeBetween(Window.unboundedPreceding, 0))
    found = ends.unionByName(asks).withColumn("to", fits).where("kind = 2")
    n = rows.groupBy("job_id").agg(F.count("*").alias("n"))
    jump = keep(found.select("job_id", "i", F.greatest("to", F.col("i") + 1).alias("to")).join(n, "job_id").where("to < n").drop("n"))
    starts = new = keep(rows.where("i = 0").select("job_id", "i"))
    while True:
        new = keep(starts.join(jump, ["job_id", "i"]).select("job_id", F.col("to").alias("i")))
        if new.isEmpty():
            break
        starts = starts.unionByName(new)
        jump = keep(jump.join(jump.select("job_id", F.col("i").alias("to"), F.col("to").alias("next")), ["job_id", "to"]).select("job_id", "i", F.col("next").alias("to")))
    marked = rows.join(starts.withColumn("first", F.lit(1)), ["job_id", "i"], "left")
    bins = marked.select("job_id", F.col("o").alias(order), (F.sum(F.coalesce("first", F.lit(0))).over(w) - 1).cast("int").alias("bin"))
    return items.join(bins, ["job_id", order])


def pack(items: DataFrame, size: str, limit: float, order: str = "ord") -> DataFrame:
    """Adds `bin`: items of a job are packed in order while their sum stays within the limit; a larger one stands alone.

    A running fold over the job's sizes only; the texts do not go into the array. pack_large has no array of a job.
    """
    row = F.struct(F.col(order).alias("o"), F.col(size).cast("double").alias("s"))
    sizes = items.groupBy("job_id").agg(F.array_sort(F.collect_list(row)).alias("_a"))
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("bin"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        fresh = (F.size(acc["out"]) > 0) & (acc["sum"] + x["s"] > limit)
        b = acc["bin"] + fresh.cast("int")
        return F.struct(F.when(fresh, x["s"]).otherwise(acc["sum"] + x["s"]).alias("sum"), b.alias("bin"), F.concat(acc["out"], F.array(b)).alias("out"))

    bins = sizes.select("job_id", "_a", F.aggregate("_a", zero, step, lambda a: a["out"]).alias("_b"))
    flat = bins.select("job_id", F.explode(F.arrays_zip(F.transform("_a", lambda x: x["o"]).alias("o"), F.col("_b").alias("b"))).alias("z"))
    return items.join(flat.select("job_id", F.col("z.o").alias(order), F.col("z.b").alias("bin")), ["job_id", order])


def pack_windows(segments: DataFrame, max_duration: float = 120.0) -> DataFrame:
    """(job_id, window_idx, start_s, end_s, duration, n_segments, segment_ids, text) of greedy windows."""
    s = pack(segments.withColumn("_d", F.col("end_s") - F.col("start_s")), "_d", max_duration)
    row = F.array_sort(F.collect_list(F.struct("ord", "segment_id", "text")))
    w = s.groupBy("job_id", F.col("bin").alias("window_idx")).agg(F.min_by("start_s", "ord").alias("start_s"), F.max_by("end_s", "ord").alias("end_s"), F.round(F.sum("_d"), 3).alias("duration"), F.count("*").alias("n_segments"), row.alias("r"))
    return w.withColumns({"segment_ids": F.transform("r", lambda x: x["segment_id"]), "text": F.array_join(F.transform("r", lambda x: x["text"]), " ")}).drop("r")


def window_signals(windows: DataFrame) -> DataFrame:
    return windows.withColumns({"word_count": T.word_count(F.col("text")), "audio_energy": F.lit(0.5), "pace": F.lit(2.5), "signal_count": F.lit(3)})


def pack_text(docs: DataFrame, max_tokens: int, header: bool = False) -> DataFrame:
    """(job_id, piece_idx, text, tokens): paragraphs packed greedily up to max_tokens; with header, what stands before
    the first SYSTEM:, INSTRUCTIONS: or JSON SCHEMA: line is repeated on each piece and shrinks its budget."""
    body, head = F.col("text"), F.lit("")
    if header:
        mark = r"(?s)^(.*?)(?m:^)(?=SYSTEM:|INSTRUCTIONS:|JSON SCHEMA:)"
        head = F.when(body.rlike(mark), F.regexp_extract(body, mark, 1)).otherwise(F.lit(""))
        body = F.substring(body, F.length(head) + 1, F.length(body))
    p = docs.select("job_id", head.alias("head"), F.posexplode(F.split(body, "\n\n")).alias("ord", "part")).where(F.trim("part") != "")
    cost = T.token_estimate(F.col("part")) + F.when(F.col("ord") >= 0, 0)
    p = p.withColumn("_t", cost * max_tokens / F.greatest(F.lit(1), F.lit(max_tokens) - T.token_estimate(F.col("head"))))
    packed = pack(p, "_t", float(max_tokens))
    out = packed.groupBy("job_id", F.col("bin").alias("piece_idx")).agg(F.first("head").alias("head"), F.array_sort(F.collect_list(F.struct("ord", "part"))).alias("r"))
    full = F.concat("head", F.array_join(F.transform("r", lambda x: x["part"]), "\n\n"))
    return out.select("job_id", "piece_idx", full.alias("text"), T.token_estimate(full).alias("tokens"))


def split_allocation(pieces: DataFrame, expected: int) -> DataFrame:
    """Each piece's share of the expected output, and where it begins and ends in it."""
    order = Window.partitionBy("job_id").orderBy("piece_idx")
    share = F.greatest(F.lit(50), F.floor(F.lit(expected) * F.col("tokens") / F.sum("tokens").over(per_job()))).cast("long")
    p = pieces.withColumn("allocated", share).withColumn("n_pieces", F.count("*").over(per_job()))
    start = F.coalesce(F.sum("allocated").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return p.withColumn("out_start", start).withColumn("out_end", F.col("out_start") + F.col("allocated"))


def validate_payload(tasks: DataFrame, max_input: int, max_output: int) -> DataFrame:
    """Adds error_code and split_hint to tasks with input_tokens and output_tokens."""
    a, b = F.col("input_tokens"), F.col("output_tokens")
    code = T.steps((a > max_input, "PAYLOAD_TOO_LARGE"), (b > max_output, "OUTPUT_TOO_LARGE"), (a + b > max_input + max_output, "PAYLOAD_EXCEEDS_LIMIT"), otherwise=F.lit(None).cast("string"))
    hint = F.when(a > max_input, F.greatest(F.lit(2), F.ceil(a / (0.9 * max_input)))).cast("long")
    return tasks.withColumns({"error_code": code, "split_hint": hint})


def annotation_batches(segments: DataFrame, size: int = 10, overlap: int = 2) -> DataFrame:
    """(job_id, block_idx, batch_idx, segment_ids, context_before, context_after, priority) inside each block."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "segment_id"))), lambda x: x["segment_id"])
    b = segments.groupBy("job_id", "block_idx").agg(ids.alias("ids"))
    w = Window.partitionBy("job_id").orderBy("block_idx")
    none = F.array().cast("array<string>")
    b = b.withColumn("prev", F.coalesce(F.lag("ids").over(w), none)).withColumn("next", F.coalesce(F.lead("ids").over(w), none))
    stride = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.size("ids") - 1, F.lit(0)), F.lit(stride))
    x = b.select("*", F.posexplode(starts).alias("batch_idx", "at"))
    last = lambda c, k: F.slice(c, F.greatest(F.size(c) - k + 1, F.lit(1)), F.lit(k))
    before = F.concat(last(F.col("prev"), 2), F.slice("ids", F.greatest(F.col("at") - 1, F.lit(1)), F.least(F.col("at"), F.lit(2))))
    after = F.concat(F.slice("ids", F.col("at") + size + 1, F.lit(2)), F.slice("next", 1, 2))
    return x.select("job_id", "block_idx", "batch_idx", F.slice("ids", F.col("at") + 1, F.lit(size)).alias("segment_ids"), before.alias("context_before"), after.alias("context_after"), F.when(F.col("block_idx") < 3, "HIGH").otherwise("NORMAL").alias("priority"))


# The fields of an annotation, and what a missing one becomes.
TEXT_FIELDS = {
    "story_id": "", "topic": "", "subtopic": "", "story_role": "body", "intent": "explain", "speaker_intent": "", "emotion": "neutral",
    "context_dependency": "low", "previous_segment_dependency": "", "next_segment_expectation": "",
}
SCORE_FIELDS = {
    "emotion_intensity": 0.5, "importance_score": 0.5, "hook_strength": 0.0, "ending_strength": 0.0, "curiosity_score": 0.0,
    "information_density": 0.0, "standalone_score": 0.5, "completeness_score": 0.5, "confidence_score": 0.5,
}
LIST_FIELDS = {"key_entities": "string", "keywords": "string", "semantic_embedding": "double"}
_ITEM = ", ".join(["segment_id:string", *[f"{c}:string" for c in TEXT_FIELDS], *[f"{c}:double" for c in SCORE_FIELDS], "topic_transition:boolean", *[f"{c}:array<{t}>" for c, t in LIST_FIELDS.items()]])
ANNOTATIONS = f"annotations array<struct<{_ITEM}>>, relationships array<struct<source_id:string,target_id:string,relation_type:string,confidence:double,reason:string>>"
# The confidences of a story boundary; a missing one is 0.5.
CONFIDENCES = ("start_confidence", "end_confidence", "boundary_confidence", "structural_confidence")
BOUNDARIES = "stories array<struct<block_id:int,boundary_segments:array<string>,story_summary:string,suggested_name:string," + ",".join(f"{c}:double" for c in CONFIDENCES) + ",ambiguous_segments:array<string>>>"


def parse_annotations(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Annotations and relationships from JSON in `raw`, and what is bad: (job_id, place, reason).

    Missing fields take their defaults and scores are clamped to 0..1. JSON that cannot be read is bad as a whole
    (place -1); an annotation without segment_id, or a relationship without its ends and type, is bad by itself.
    """
    p = raw.withColumn("_j", F.from_json("raw", ANNOTATIONS))
    fault = lambda place, reason: F.struct(place.alias("place"), F.lit(reason).alias("reason"))
    faults = lambda c, wrong, reason: F.coalesce(F.filter(F.transform(c, lambda x, i: F.when(wrong(x), fault(i, reason))), lambda x: x.isNotNull()), F.array().cast("array<struct<place:int,reason:string>>"))
    unread = F.col("_j").isNull() | (F.col("_j.annotations").isNull() & F.col("_j.relationships").isNull())
    lost = faults(F.col("_j.annotations"), lambda x: x["segment_id"].isNull(), "no_segment_id")
    loose = faults(F.col("_j.relationships"), lambda x: x["source_id"].isNull() | x["target_id"].isNull() | x["relation_type"].isNull(), "no_relation")
    bad = p.select("job_id", F.inline(F.when(unread, F.array(fault(F.lit(-1), "invalid_json"))).otherwise(F.concat(lost, loose))))
    a = p.select("job_id", F.posexplode("_j.annotations").alias("place", "a")).select("job_id", "place", "a.*")
    a = a.where(F.col("segment_id").isNotNull()).select(
        "job_id", "segment_id", *[F.coalesce(c, F.lit(d)).alias(c) for c, d in TEXT_FIELDS.items()], *[T.clamp(F.coalesce(c, F.lit(d))).alias(c) for c, d in SCORE_FIELDS.items()],
        F.coalesce("topic_transition", F.lit(False)).alias("topic_transition"), *[F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c) for c, t in LIST_FIELDS.items()],
    )
    r = p.select("job_id", F.posexplode("_j.relationships").alias("place", "r")).select("job_id", "place", "r.*")
    whole = F.col("source_id").isNotNull() & F.col("target_id").isNotNull() & F.col("relation_type").isNotNull()
    r = r.where(whole).select("job_id", "source_id", "target_id", "relation_type", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.coalesce("reason", F.lit("")).alias("reason"))
    return a, r, bad


def parse_boundaries(raw: DataFrame) -> DataFrame:
    """Story boundaries from JSON in `raw`: one row for each story, idx being its place; missing confidences are 0.5,
    and the semantic confidence is that of the boundary."""
    return scan_boundaries(raw)[0]


def scan_boundaries(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """parse_boundaries(), and what is bad: (job_id, place, reason). JSON that cannot be read, or has no stories, is bad
    as a whole (place -1); a story without segments is bad by itself, and still a row."""
    none = F.array().cast("array<string>")
    p = raw.withColumn("_j", F.from_json("raw", BOUNDARIES))
    bad = p.where(F.col("_j.stories").isNull()).select("job_id", F.lit(-1).alias("place"), F.lit("invalid_json").alias("reason"))
    s = p.select("job_id", F.posexplode("_j.stories").alias("idx", "s")).select("job_id", "idx", "s.*")
    empty = s.where(F.coalesce(F.size("boundary_segments"), F.lit(0)) <= 0).select("job_id", F.col("idx").alias("place"), F.lit("no_segments").alias("reason"))
    s = s.withColumns({c: F.coalesce(c, F.lit(0.5)) for c in CONFIDENCES})
    stories = s.select(
        "job_id", "idx", F.array(F.coalesce("block_id", F.lit(0))).alias("block_ids"), F.coalesce("boundary_segments", none).alias("segments"), F.coalesce("suggested_name", F.lit("")).alias("name"),
        F.coalesce("story_summary", F.lit("")).alias("summary"), *CONFIDENCES, F.col("boundary_confidence").alias("semantic_confidence"), F.coalesce("ambiguous_segments", none).alias("ambiguous_segments"),
    )
    return stories, bad.unionByName(empty)


def prompt_text(batches: DataFrame, segments: DataFrame, summaries: DataFrame | None = None, instructions: str = "") -> DataFrame:
    """(job_id, block_idx, batch_idx, prompt): the instructions, the job's summary, and the segments before, after and
    of the batch, each as a line `[id | start-end s] text`, in order. Parts without content are left out.

    A job's segment ids are distinct. Lines meet the places that ask for them in a window instead of a join, so that rows
    that are together by job_id are not dealt out anew.
    """
    keys = ["job_id", "block_idx", "batch_idx"]
    parts = {"context_before": "Previous context:\n", "context_after": "Following context:\n", "segment_ids": "Segments:\n"}
    asked = lambda i, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x, pos: F.struct(F.lit(i).alias("part"), pos.alias("pos"), x.alias("segment_id")))
    asks = batches.select(*keys, F.inline(F.concat(*[asked(i, F.col(c)) for i, c in enumerate(parts)])))
    line = F.format_string("[%s | %.1f-%.1fs] %s", "segment_id", "start_s", "end_s", "text")
    x = asks.unionByName(segments.select("job_id", "segment_id", line.alias("line")), allowMissingColumns=True).where("segment_id is not null")
    x = x.withColumn("line", F.max("line").over(Window.partitionBy("job_id", "segment_id"))).where("part is not null and line is not null")
    row = F.struct("pos", "line")
    g = x.groupBy(*keys).agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == i, row))), lambda r: r["line"]), "\n").alias(c) for i, c in enumerate(parts)])
    if summaries is not None:
        g = g.join(summaries.select("job_id", "summary"), "job_id", "left")
    heads = [("summary", "Full transcript summary:\n"), *parts.items()] if summaries is not None else list(parts.items())
    text = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(h), c)) for c, h in heads]
    return g.select(*keys, F.concat(F.lit(instructions), F.concat_ws("\n\n", *text)).alias("prompt"))


def chunk_confidence(words: DataFrame) -> DataFrame:
    """(job_id, chunk_id, confidence) from avg_logprob rows; 0.5 where there are none."""
    mean = F.avg("avg_logprob")
    return words.groupBy("job_id", "chunk_id").agg(F.when(mean.isNull(), 0.5).otherwise(T.clamp(1 + mean)).alias("confidence"))


def rtf_summary(perf: DataFrame) -> DataFrame:
    """Real-time factors of recogniser runs (total_ms, inference_ms, audio_s) by job."""
    rtf = F.col("total_ms") / 1000 / F.greatest(F.col("audio_s"), F.lit(0.001))
    return perf.groupBy("job_id").agg(F.avg(rtf).alias("avg_rtf"), F.max(rtf).alias("peak_rtf"), F.avg("total_ms").alias("avg_ms"), F.sum("inference_ms").alias("inference_ms"), F.sum("audio_s").alias("audio_s"), F.count("*").alias("n_chunks"))
