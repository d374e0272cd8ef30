"""The driver's tables as jobs: documents as transcripts, orders as candidates, events as pipeline events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import INVENTED
from ..functions import text as T
from ..operators import candidates as C
from ..operators import features as FE
from ..operators import transcript as TR
from ..sources import tables as S

PACE = 2.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """documents: a job each; every line with words is a chunk, and time goes by at PACE words a second.

    spread: jobs are dealt to all spark.sql.shuffle.partitions, which adaptive execution leaves apart, for steps that
    need many times the memory of the text that a task reads.
    """
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    d = d.withColumn("text", T.normalize_text(F.col("raw"))).where(F.col("text") != "")
    if spread:
        d = d.select("job_id", "line", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "job_id")
    w = Window.partitionBy("job_id").orderBy("line")
    words = F.size(F.split("text", " "))
    d = d.withColumn("_n", words).withColumn("_u", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("chunk_idx", F.row_number().over(w) - 1)
    return d.select("job_id", "chunk_idx", F.concat(F.lit("c"), "chunk_idx").alias("chunk_id"), ((F.col("_u") - F.col("_n")) / PACE).alias("start_s"), (F.col("_u") / PACE).alias("end_s"), "text")


def segments(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    return TR.atomic_segments(chunks(spark, sf_dir, spread), INVENTED)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.segment_features(segments(spark, sf_dir))


def _pair(i: int) -> Column:
    """The i-th byte of a segment's hash."""
    return F.conv(F.substring("h", 2 * i + 1, 2), 16, 10).cast("int")


def annotations(segs: DataFrame) -> DataFrame:
    """Annotations that follow from a segment's hash and words, in place of a model's."""
    a = segs.withColumn("h", F.md5(F.concat_ws(":", F.col("job_id").cast("string"), "segment_id")))
    words = F.filter(F.array_distinct(F.split("text", " ")), lambda w: F.length(w) >= 4)
    words = F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    scores = ("hook_strength", "ending_strength", "curiosity_score", "importance_score", "emotion_intensity", "confidence_score")
    return a.select(
        "job_id", "segment_id", *[(_pair(i) / 255.0).alias(n) for i, n in enumerate(scores)],
        F.concat(F.lit("t"), _pair(6) % 7).alias("topic"), F.concat(F.lit("t"), _pair(7) % 7).alias("subtopic"),
        F.when(_pair(8) % 5 == 0, "neutral").otherwise(F.concat(F.lit("e"), _pair(8) % 5)).alias("emotion"), F.col("kind").alias("story_role"),
        F.when(_pair(9) % 3 == 0, "low").otherwise("high").alias("context_dependency"), F.slice(words, F.lit(1), 1 + _pair(10) % 3).alias("key_entities"), F.slice(words, 1, 3).alias("keywords"),
    )


def boundaries(segs: DataFrame) -> DataFrame:
    """Stories of five neighbours, some left out, repeated or moved ahead by their hash, so that checks have work."""
    b = segs.withColumn("h", F.md5(F.concat_ws(":", F.col("job_id").cast("string"), "segment_id"))).where(_pair(11) >= 40)
    b = b.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(_pair(13) < 20, 2).otherwise(1))))
    row = F.struct((F.col("ord") - F.when(_pair(12) < 20, 2).otherwise(0)).alias("k"), "ord", "copy", "segment_id")
    b = b.groupBy("job_id", F.floor(F.col("ord") / 5).cast("int").alias("idx")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["segment_id"]).alias("segments"))
    conf = [F.lit(0.8).alias(f"{c}_confidence") for c in ("start", "end", "boundary", "structural", "semantic")]
    return b.select("*", F.concat(F.lit("Story "), "idx").alias("name"), F.when(F.col("idx") % 2 == 0, "summary").otherwise("").alias("summary"), *conf)


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return C.generate_candidates(s, full_features(s), keep=lambda df: S.materialize(df, "pruned"))


def full_features(segs: DataFrame) -> DataFrame:
    """The features with all columns of the segments."""
    return FE.segment_features(segs, keep=("start_s", "end_s", "text", "kind"))


def ranking_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips(spark, sf_dir).withColumnRenamed("total_score", "raw_score")


def raw_annotations(segs: DataFrame, spoil: bool = False) -> DataFrame:
    """Each job's annotations and the links between neighbours as a model's JSON; fields are missing in every third
    segment and the first relation of a job lacks its type. With spoil, every tenth job's text is no JSON."""
    third = F.col("ord") % 3 == 0
    item = F.struct(
        F.when((F.col("ord") % 11 != 10), F.col("segment_id")).alias("segment_id"), F.when(~third, F.col("kind")).alias("story_role"), F.concat(F.lit("t"), F.col("ord") % 5).alias("topic"),
        F.when(~third, F.col("ord") / 7).alias("emotion_intensity"), F.when(~third, F.col("ord") / 10).alias("importance_score"), F.when(~third, (F.col("ord") - 3) / 5).alias("hook_strength"),
        F.when(~third, F.col("end_s") / 100).alias("ending_strength"), F.when(third, F.lit(0.25)).alias("standalone_score"), F.when(~third, F.col("ord") % 2 == 0).alias("topic_transition"),
        F.when(~third, F.slice(F.split("text", " "), 1, 2)).alias("key_entities"),
    )
    link = F.struct(F.col("segment_id").alias("source_id"), F.lead("segment_id").over(Window.partitionBy("job_id").orderBy("ord")).alias("target_id"), F.when(F.col("ord") > 0, "follows").alias("relation_type"), F.when(F.col("ord") % 2 == 0, F.col("ord") / 8).alias("confidence"))
    s = segs.select("job_id", "ord", item.alias("item"), link.alias("link"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: x[c])
    raw = s.groupBy("job_id").agg(F.to_json(F.struct(in_order("item").alias("annotations"), in_order("link").alias("relationships"))).alias("raw"))
    return spoiled(raw) if spoil else raw


def spoiled(raw: DataFrame) -> DataFrame:
    """Every tenth job's text is no JSON, so that bad rows can be told."""
    return raw.withColumn("raw", F.when(F.col("job_id") % 10 == 0, F.concat(F.lit("not json "), "raw")).otherwise(F.col("raw")))


def raw_boundaries(segs: DataFrame) -> DataFrame:
    """The stories of boundaries() as a model's JSON, every other one without two of its confidences."""
    odd = F.col("idx") % 2 == 1
    item = F.struct(
        "idx", (F.col("idx") % 3).alias("block_id"), F.col("segments").alias("boundary_segments"), F.col("summary").alias("story_summary"), F.col("name").alias("suggested_name"),
        F.when(odd, F.col("start_confidence")).alias("start_confidence"), "end_confidence", F.when(odd, F.lit(0.9)).alias("boundary_confidence"), F.when(odd, F.slice("segments", 1, 1)).alias("ambiguous_segments"),
    )
    return boundaries(segs).groupBy("job_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("stories"))).alias("raw"))


def order_sets(spark: SparkSession, sf_dir: str, m: int = 500) -> DataFrame:
    """orders as candidates of a customer: event_ids are part keys modulo m, the score is the price in 0..1."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set((F.col("l_partkey") % m).cast("string"))).alias("event_ids"))
    o = table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(F.col("o_custkey").alias("job_id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("id"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("double").alias("start_s"), "event_ids", F.round(F.col("o_totalprice") / 500000, 4).alias("score"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: a job for each label."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("job_id"), F.col("vec_id").alias("ord"), F.col("embedding").cast("array<double>").alias("embedding"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: key is the user, stage and name the type, value stands for milliseconds and tokens."""
    return as_events(table(spark, sf_dir, "events"))


def as_events(e: DataFrame) -> DataFrame:
    return e.select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("key"), F.col("user_id").alias("job_id"), F.col("event_type").alias("name"), F.col("event_type").alias("stage"), (F.col("value") * 10).alias("elapsed_ms"), F.floor("value").cast("long").alias("tokens"), (F.col("event_type") != "error").alias("ok"), (F.col("value") > 40).alias("rate_limited"))
