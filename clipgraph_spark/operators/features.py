"""Segment features, block priorities and synopses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def segment_features(segments: DataFrame, energy: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Four scores and their mean for each segment; energy (job_id, segment_id, energy) takes the place of the heuristic.

    With `keep`, these columns of the segments stay, so that nobody has to join them again.
    """
    t, seconds = F.trim("text"), F.col("end_s") - F.col("start_s")
    s = segments
    if energy is not None:
        s = s.join(energy, ["job_id", "segment_id"], "left")
    else:
        s = s.withColumn("energy", F.lit(None).cast("double"))
    audio = T.rounded(F.coalesce("energy", T.clamp(F.length(t) / 200, 0.05)), 4)
    density = T.rounded(T.clamp(T.words_per_second(t, seconds) / 3, 0.05), 4)
    hook = T.steps((seconds <= 5, 0.9), (seconds <= 10, 0.7), otherwise=0.5)
    ending = T.steps((seconds <= 8, 0.85), (seconds <= 15, 0.7), otherwise=0.5)
    body = T.steps((seconds.between(10, 45), 0.7), (seconds.between(5, 60), 0.5), otherwise=0.3)
    structure = T.steps((F.col("kind") == "hook", hook), (F.col("kind") == "ending", ending), otherwise=body)
    words = T.word_count(t)
    bonus = F.when(T.has_question(t), 0.1).otherwise(0.0) + F.when(T.has_digit(t), 0.05).otherwise(0.0) + F.when(words <= 10, 0.05).otherwise(0.0)
    pattern = T.rounded(T.clamp(0.4 + T.unique_ratio(t) * 0.5 + bonus, 0.1), 4)
    f = s.select(
        "job_id", "segment_id", "ord", *keep, audio.alias("audio_intensity"), density.alias("text_density"), structure.alias("structure_score"), pattern.alias("pattern_score"),
        F.when(F.col("energy").isNull(), "text_heuristic").otherwise("real").alias("audio_energy_source"), words.alias("word_count"), T.rounded(F.greatest(seconds, F.lit(0.1)), 4).alias("duration_seconds"),
    )
    total = F.col("audio_intensity") + F.col("text_density") + F.col("structure_score") + F.col("pattern_score")
    return f.withColumn("total_score", T.round4(total / 4))


def non_fallback_count(features: DataFrame) -> DataFrame:
    n = (F.col("audio_energy_source") == "real").cast("int") + F.coalesce((F.col("confidence") > 0.8).cast("int"), F.lit(0)) if "confidence" in features.columns else (F.col("audio_energy_source") == "real").cast("int")
    return features.withColumn("non_fallback_count", n)


def block_priority(segments: DataFrame) -> DataFrame:
    """(job_id, block_idx, score, priority, rank) of each topic block; high before medium before low, else in time order."""
    b = segments.groupBy("job_id", "block_idx").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.avg(T.word_count(F.col("text"))).alias("words"), F.bool_or(T.has_question(F.col("text"))).alias("q"), F.bool_or(T.has_digit(F.col("text"))).alias("d"))
    seconds = F.col("end_s") - F.col("start_s")
    length = T.steps((seconds.between(10, 45), 0.3), (seconds.between(5, 60), 0.2), otherwise=0.1)
    score = length + F.when(F.col("words").between(10, 40), 0.2).otherwise(0.0) + F.when(F.col("q"), 0.2).otherwise(0.0) + F.when(F.col("d"), 0.1).otherwise(0.0) + F.when((F.col("start_s") > 30) & (F.col("end_s") < 180), 0.1).otherwise(0.0)
    b = b.withColumn("score", T.rounded(score, 4)).withColumn("priority", T.steps((F.col("score") >= 0.6, "high"), (F.col("score") >= 0.4, "medium"), otherwise="low"))
    level = T.steps((F.col("priority") == "high", 0), (F.col("priority") == "medium", 1), otherwise=2)
    return b.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy(level, "block_idx"))).select("job_id", "block_idx", "score", "priority", "rank")


def _place(order: Column, pos: Column) -> Column:
    """order and pos, both below 2^31, as one long of the same order."""
    return F.shiftleft(order.cast("long"), 32) + pos


def frequent_terms(segments: DataFrame, k: int = 5, keys: tuple[str, ...] = ("job_id",), min_len: int = 3) -> DataFrame:
    """The k most frequent lower-cased tokens longer than min_len, by count and then first appearance (ord and the place
    in the text as one long, which a hash aggregate can hold)."""
    t = segments.select(*keys, "ord", F.posexplode(T.lower_tokens(F.col("text"))).alias("pos", "term")).where(F.length("term") > min_len)
    n = t.groupBy(*keys, "term").agg(F.count("*").alias("n"), F.min(_place(F.col("ord"), F.col("pos"))).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first"))
    return n.withColumn("rank", rank).where(F.col("rank") <= k).select(*keys, "rank", "term", "n")


def named_entities(segments: DataFrame, k: int = 3, keys: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """The first k, by name, of the distinct capitalised tokens."""
    t = segments.select(*keys, F.explode(T.title_tokens(F.col("text"))).alias("entity")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("entity"))
    return t.withColumn("rank", rank).where(F.col("rank") <= k).select(*keys, "rank", "entity")


def synopsis(segments: DataFrame, keys: tuple[str, ...] = ("job_id",), terms: int = 5, names: int = 3, min_len: int = 3) -> DataFrame:
    """A line about each group: seconds, segments, how it begins and ends, and what frequent_terms() and named_entities()
    give.

    Segments are read once: beginnings, lower-cased tokens and capitalised ones are values of three kinds that are counted
    together, and a group's distinct values are put in order in one row.
    """
    none = "array<struct<kind:int,value:string,at:long>>"
    values = lambda kind, c, keep: F.coalesce(F.filter(F.transform(c, lambda t, i: F.struct(F.lit(kind).alias("kind"), t.alias("value"), _place(F.col("ord"), i).alias("at"))), lambda x: keep(x["value"])), F.array().cast(none))
    head = F.array(F.struct(F.lit(0).alias("kind"), F.substring("text", 1, 100).alias("value"), _place(F.col("ord"), F.lit(0)).alias("at")))
    low, title = values(1, T.lower_tokens(F.col("text")), lambda t: F.length(t) > min_len), values(2, T.title_tokens(F.col("text")), lambda t: t.isNotNull())
    v = segments.select(*keys, "start_s", "end_s", F.inline(F.concat(head, low, title)))
    v = v.groupBy(*keys, "kind", "value").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    is_ = lambda kind, c: F.when(F.col("kind") == kind, c)
    listed = lambda c, k, value: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(c)), 1, k), value), ", ")
    g = v.groupBy(*keys).agg(
        (F.max("end_s") - F.min("start_s")).alias("seconds"), F.sum(is_(0, F.col("n"))).alias("n"), F.min_by("value", is_(0, F.col("first"))).alias("head"), F.max_by("value", is_(0, F.col("last"))).alias("tail"),
        listed(is_(1, F.struct((-F.col("n")).alias("n"), "first", "value")), terms, lambda x: x["value"]).alias("terms"), listed(is_(2, F.col("value")), names, lambda x: x).alias("names"),
    )
    return g.select(*keys, F.format_string("Duration: %.1fs, Segments: %d. Starts: %s Ends: %s Terms: %s Entities: %s", "seconds", "n", "head", "tail", "terms", "names").alias("synopsis"))


def representative_excerpt(vectors: DataFrame, keys: tuple[str, ...] = ("job_id",), margin: float = 0.02) -> DataFrame:
    """(keys, segment_id, excerpt): of the segments within `margin` of the best cosine to the group's centroid, the one
    with the most words a second; vectors has text, start_s, end_s, ord, segment_id and embedding."""
    from .topics import centroid

    v = vectors.join(centroid(vectors, keys).withColumnRenamed("centroid", "_c"), list(keys), "left")
    v = v.withColumn("_cos", F.round(F.coalesce(T.cosine(F.col("embedding"), F.col("_c")), F.lit(0.0)), 9))
    v = v.withColumn("_best", F.max("_cos").over(Window.partitionBy(*keys))).where(F.col("_cos") >= F.col("_best") - margin)
    pace = T.words_per_second(F.col("text"), F.col("end_s") - F.col("start_s"))
    return v.groupBy(*keys).agg(F.max_by(F.struct("segment_id", F.substring("text", 1, 150).alias("excerpt")), F.struct(pace, -F.col("ord"))).alias("x")).select(*keys, "x.segment_id", "x.excerpt")
