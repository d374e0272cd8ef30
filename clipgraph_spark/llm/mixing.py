"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, materialize, table

WORDS = r"[^\x20\x09-\x0D]+"
#: Rank buckets of a source: about one for each 1,024 rows of the table, within these bounds.
BUCKETS = (1 << 10, 1 << 20)
OUT = ("size", "source_size", "target", "times", "taken")
SOURCE_COLS = ["source", "source_size", "target"]


def with_rank_key(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Adds size (words, null text: 0), id (doc_id as text), hash (the text's) and u, uniform in (0, 1), from seed, id and
    hash: reruns agree, and rows that share an id but not their text have numbers of their own."""
    d = docs.withColumns({"size": F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long"), "id": F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "hash": F.coalesce(F.md5("text"), F.lit(""))})
    hexes = F.substring(F.md5(F.concat_ws(":", F.lit(seed), "id", "hash")), 1, 12)
    return d.withColumn("u", (F.conv(hexes, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48)))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of each source.

    Sources by code point, null last, take `weights` in turn and split `share` times all sizes; no target is above
    `most` times its source's size, and what is cut off goes to the others by weight. Sorted by size over weight the
    sources that stop are a prefix, so one running sum finds the level. The windows over all sources run in one task:
    one row for each source, so some millions of sources are the limit, whatever the documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_ratio = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("w", weight).withColumn("stop", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("stop") / F.col("w"))
    per = per.withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("level", level)
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return per.withColumn("target", F.least(F.col("stop"), F.coalesce(found, F.lit(float("inf"))) * F.col("w"))).select(*SOURCE_COLS)


def _ranked(sized: DataFrame, targets: DataFrame, weight: str | None, buckets: int) -> DataFrame:
    """Adds whole (certain copies), rest (words still to take in the source) and q, the Pareto rank."""
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    part = F.col("copies") - F.col("whole")
    odds = part / (1 - part) * (F.col(weight).cast("double") if weight else F.lit(1.0))
    q = F.when((part > 0) & (odds > 0), F.col("u") / (1 - F.col("u")) / odds).otherwise(F.lit(float("inf")))
    out = sized.join(targets.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    out = out.withColumn("copies", copies).withColumn("whole", F.floor("copies").cast("long"))
    out = out.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("q", q)
    return out.withColumn("bucket", F.coalesce(F.least(F.floor(F.col("q") / (1 + F.col("q")) * buckets), F.lit(buckets)).cast("int"), F.lit(buckets)))


def _items(ranked: DataFrame, weight: str | None) -> DataFrame:
    """Rows that share source, id and text are one item of `copies_of` rows: one number, and one place in the order."""
    own = ["source", "id", "hash", "size", "u", *([weight] if weight else [])]
    return ranked.groupBy(*own).agg(F.count("*").alias("copies_of"))


def _place() -> Column:
    """An item's place in Pareto order."""
    return F.struct("q", "id", "hash")


def cuts(ranked: DataFrame, buckets: int) -> DataFrame:
    """For each source, where the mix ends in Pareto order: (source, cut_bucket, cut, part).

    `ranked` are items. Their words are summed by source and rank bucket first; only the bucket in which the sum reaches
    the rest is sorted. A row is taken if the middle of its words lies within the rest. cut is the first item that is
    not taken whole, and part the number of its rows that are.
    """
    real = ranked.where(F.col("bucket") < buckets).withColumn("words", F.col("size") * F.col("copies_of"))
    w = Window.partitionBy("source").orderBy("bucket")
    sums = real.groupBy("source", "bucket", "rest").agg(F.sum("words").alias("s")).withColumn("upto", F.sum("s").over(w))
    edge = sums.where((F.col("upto") - F.col("s") < F.col("rest")) & (F.col("upto") >= F.col("rest"))).select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), (F.col("upto") - F.col("s")).alias("base"))
    last = sums.groupBy("source").agg(F.max("upto").alias("all"), F.max("rest").alias("r")).select("source", (F.col("all") < F.col("r")).alias("everything"))
    rows = real.join(edge, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    before = F.col("base") + F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("q", "id", "hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.when(F.col("size") > 0, F.floor((F.col("rest") - before) / F.col("size") + 0.5)).otherwise(F.col("copies_of"))
    part = F.greatest(F.lit(0), F.least(part, F.col("copies_of"))).cast("long")
    open_ = rows.withColumn("part", part).where(F.col("part") < F.col("copies_of")).groupBy("source").agg(F.min(F.struct(_place().alias("cut"), "part")).alias("m"))
    out = edge.select(F.col("_s").alias("source"), "_b").join(open_.select(F.col("source").alias("_t"), "m"), F.col("source").eqNullSafe(F.col("_t")), "left")
    out = out.select("source", F.when(F.col("m").isNull(), F.col("_b") + 1).otherwise(F.col("_b")).alias("cut_bucket"), F.col("m.cut").alias("cut"), F.coalesce("m.part", F.lit(0)).cast("long").alias("part"))
    whole = last.where("everything").select("source", F.lit(buckets).alias("cut_bucket"), F.lit(None).cast(out.schema["cut"].dataType).alias("cut"), F.lit(0).cast("long").alias("part"))
    return out.unionByName(whole)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, weight: str | None = None, seed: str = "mix") -> DataFrame:
    """docs with size, source_size, target, times (how often the mix takes the row) and taken (words).

    Each row of a source has target/source_size expected copies. The whole part is certain; for the rest, rows are
    ranked by random odds over inclusion odds (times `weight`, a positive column, where given: without it all rows of a
    source have the same odds) and taken in that order until the source's words are reached: a sample of fixed size in
    words. Null sources are one source, null or empty texts have size 0 and are never needed. Rows of one source, id and
    text share a rank, and where the sample ends among them just so many of them are taken; which ones is all the same.
    Columns of docs with the names in OUT are replaced, all others stay, whatever their
    names. An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c.lower() not in OUT]
    whole = F.struct(*kept) if kept else F.lit(None)
    packed = docs.select(whole.alias("row"), "doc_id", "source", "text", *([F.col(weight).alias("given")] if weight else []))
    return _apply(with_rank_key(packed, seed), weights, share, "given" if weight else None).select("row.*", *OUT)


def _apply(sized: DataFrame, weights, share, weight) -> DataFrame:
    items = materialize(_items(sized, weight), "mix-items")
    buckets = min(max(BUCKETS[0], items.count() >> 10), BUCKETS[1])
    targets = materialize(source_targets(items.select("source", (F.col("size") * F.col("copies_of")).alias("size")), weights, share), "mix-targets")
    found = materialize(cuts(_ranked(items, targets, weight, buckets), buckets), "mix-cuts")
    return decide(_ranked(sized, targets, weight, buckets), found, buckets)


def decide(ranked: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """Adds times and taken to the rows. Only the rows of items that are taken in part, if any, are numbered."""
    out = ranked.join(found.select(F.col("source").alias("_s"), "cut_bucket", "cut", "part"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    here = F.col("bucket") == F.col("cut_bucket")
    chosen = (F.col("bucket") < F.col("cut_bucket")) | (here & F.coalesce(_place() < F.col("cut"), F.lit(False)))
    chosen = F.coalesce(chosen & (F.col("bucket") < buckets), F.lit(False))
    out = out.withColumn("times", F.col("whole") + chosen.cast("long"))
    if not found.where("part > 0").isEmpty():
        split = F.coalesce(here & (F.col("part") > 0) & (_place() == F.col("cut")), F.lit(False))
        some = _numbered(materialize(out.where(split).withColumn("dealt", F.spark_partition_id()), "mix-part"))
        out = out.where(~split).unionByName(some.withColumn("times", F.col("whole") + (F.col("number") <= F.col("part")).cast("long")).drop("number", "dealt"))
    return out.withColumn("taken", F.col("times") * F.col("size"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Numbers the rows of each source from 1, by the tasks that read them: no task gets more rows than it had."""
    sums = rows.groupBy("source", "dealt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select(F.col("source").alias("_s"), F.col("dealt").alias("_d"), before.alias("base"))
    inside = F.row_number().over(Window.partitionBy("source", "dealt").orderBy(F.lit(0)))
    joined = rows.withColumn("number", inside).join(base, F.col("source").eqNullSafe(F.col("_s")) & (F.col("dealt") == F.col("_d")))
    return joined.withColumn("number", F.col("number") + F.col("base")).drop("_s", "_d", "base")


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    narrow = materialize(with_rank_key(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "id", "hash", "u"), "mix-sizes")
    return _apply(narrow, (3.0, 1.0, 2.0), 1.5, None).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, id, hash,
         (('0x' || substr(md5('mix:' || id || ':' || hash), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM (SELECT *, coalesce(doc_id::VARCHAR, 'null') AS id, coalesce(md5(text), '') AS hash FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w, 2.0::DOUBLE * source_size AS stop FROM s),
r AS (SELECT *, stop / w AS ratio, 1.5::DOUBLE * (SELECT sum(source_size) FROM s) AS total, (SELECT sum(w) FROM w) AS all_w FROM w),
l AS (SELECT *, (total - coalesce(sum(stop) OVER p, 0)) / (all_w - coalesce(sum(w) OVER p, 0)) AS level FROM r
      WINDOW p AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(stop, (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) * w) AS target FROM l),
j AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS copies
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, floor(copies) AS whole, target - floor(copies) * source_size AS rest,
      CASE WHEN copies > floor(copies) THEN u / (1 - u) / ((copies - floor(copies)) / (1 - (copies - floor(copies)))) END AS q FROM j),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, id, hash ROWS UNBOUNDED PRECEDING) AS upto FROM q)
SELECT doc_id, size, source_size, target,
       (size * (whole::BIGINT + CASE WHEN q IS NOT NULL AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""


def stage_mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: each row as often as it is taken, with the columns of docs, whatever their names."""
    (row,) = free_names(docs, "row")
    mixed = mix(docs.select(F.struct(*docs.columns).alias(row), "doc_id", "source", "text")).where(F.col("times") > 0)
    copies = F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))
    return mixed.select(row, copies.alias("copy")).select(f"{row}.*")
