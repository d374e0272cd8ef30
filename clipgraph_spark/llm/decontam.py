"""Benchmark decontamination by a broadcast set of normalised n-grams, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_names, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
N = 10
#: Up to this many windows the set goes to every task; beyond, windows are joined by shuffle.
BROADCAST_WINDOWS = 200_000
#: Beyond them, up to this many first words of windows (8 bytes each) still go to every task, to let few places on.
BROADCAST_HEADS = 4_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _gram(words: Column, at: Column, n: int) -> Column:
    return F.array_join(F.slice(words, at + 1, n), " ")


def windows(items: DataFrame, n: int = N) -> DataFrame:
    """(gram, len, item) of every window of n words of the items' texts; a shorter item with words is one window."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.size("w"), F.lit(n)))
    at = F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len")))
    w = w.select("item", "len", "w", at.alias("i"))
    return w.select(F.array_join(F.slice("w", F.col("i") + 1, F.col("len")), " ").alias("gram"), "len", "item").distinct()


def _in(value: Column, keys: list[int]) -> Column:
    return F.expr("false") if not keys else value.isin(keys)


def _places(words: Column, n: int, heads: list[int] | None = None, wholes: list[int] | None = None) -> Column:
    """(i, len, gram) of every window of n words, or of those that the hash sets, where given, let through."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))

    def known(i):
        whole = _in(F.xxhash64(_gram(words, i, n)), wholes)
        return whole if n == 1 else _in(F.xxhash64(F.get(words, i), F.get(words, i + 1)), heads) & whole

    if wholes is not None:
        at = F.filter(at, known)
    return F.transform(at, lambda i: F.struct(i.alias("i"), F.lit(n).alias("len"), _gram(words, i, n).alias("gram")))


def hits(docs: DataFrame, items: DataFrame, n: int = N, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: `keep`, n_words, n_hit, n_items, items_sha256, contaminated.

    Every word position is tested in place: its first two words against the windows' first two, then the hash of the
    whole window; what is left is verified by an equi join on the window's text. The sets are sent to the tasks only
    if the benchmark has at most BROADCAST_WINDOWS windows; else every position's window is joined by shuffle.
    Null and empty texts have no words and no hits; repeated rows give repeated rows; items with null texts, or
    without words, match nothing; items with equal texts all count.
    """
    grams = windows(items, n).persist()
    try:
        lens = sorted(r["len"] for r in grams.select("len").distinct().collect())  # n values at most
        small = grams.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
        heads, wholes = {}, {}
        if small:
            first_two = F.xxhash64(F.get(F.split("gram", " "), F.lit(0)), F.get(F.split("gram", " "), F.lit(1)))
            for r in grams.groupBy("len").agg(F.collect_set(first_two).alias("h"), F.collect_set(F.xxhash64("gram")).alias("g")).collect():
                heads[r["len"]], wholes[r["len"]] = r["h"], r["g"]
    finally:
        grams.unpersist()
    row, w, p, i, k, gram = free_names(docs.select(*keep), "_row", "_w", "_p", "_i", "_len", "_gram")
    d = docs.select(F.monotonically_increasing_id().alias(row), *keep, words_of(F.col("text")).alias(w)).withColumn("n_words", F.size(w).cast("long"))
    found = [_places(F.col(w), n_, heads.get(n_), wholes.get(n_)) for n_ in lens]
    places = F.flatten(F.array(*found)) if found else F.array().cast("array<struct<i:int,len:int,gram:string>>")
    if not small:  # a place of its own for each row, so that rows without hits stay
        places = F.concat(places, F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("len"), F.concat(F.lit("\n"), F.col(row).cast("string")).alias("gram"))))
    d = d.select(row, *keep, "n_words", F.explode_outer(places).alias(p))
    d = d.select(row, *keep, "n_words", F.col(f"{p}.i").alias(i), F.col(f"{p}.len").alias(k), F.col(f"{p}.gram").alias(gram))
    if not small:
        d = _with_known_heads(d, grams, i, gram)
    g = grams.groupBy("gram", "len").agg(F.collect_set("item").alias("_items")).select(F.col("gram").alias("_g"), F.col("len").alias("_l"), "_items")
    joined = d.join(F.broadcast(g) if small else g, (F.col(gram) == F.col("_g")) & (F.col(k) == F.col("_l")), "left")
    place = F.when(F.col("_items").isNotNull(), F.struct(F.col(i).alias("i"), F.col(k).alias("len")))
    per = joined.groupBy(row, *keep, "n_words").agg(F.collect_set(place).alias("_at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_found"))
    covered = F.array_distinct(F.flatten(F.transform("_at", lambda x: F.sequence(x["i"], x["i"] + x["len"] - 1))))
    return per.select(
        *keep, "n_words", F.size(covered).cast("long").alias("n_hit"), F.size("_found").cast("long").alias("n_items"),
        F.sha2(F.array_join("_found", ","), 256).alias("items_sha256"), (F.size("_at") > 0).alias("contaminated"),
    )


def _with_known_heads(d: DataFrame, grams: DataFrame, i: str, gram: str) -> DataFrame:
    """The places whose window's first two words begin a window of the set, and each row's own place."""
    first_two = lambda c: F.xxhash64(F.substring_index(c, " ", 2))
    known = grams.select(first_two(F.col("gram")).alias("_h")).distinct()
    if known.limit(BROADCAST_HEADS + 1).count() > BROADCAST_HEADS:
        return d
    known = F.broadcast(known.withColumn("_known", F.lit(True)))
    return d.join(known, first_two(F.col(gram)) == F.col("_h"), "left").where(F.col("_known") | (F.col(i) < 0)).drop("_h", "_known")


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows as one column `row`, with the text and a key that rows of the same doc_id and text share."""
    return docs.select(F.struct(*docs.columns).alias("row"), "text", F.struct(F.col("doc_id"), F.xxhash64("text").alias("h")).alias("key"))


def clean_documents(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """The documents without hits, with their columns, whatever their names. Rows are named by their content, so
    repeated rows are decided alike."""
    keyed = _keyed(docs)
    bad = hits(keyed, items, n, ("key",)).where("contaminated").select(F.col("key").alias("bad")).distinct()
    return keyed.join(bad, F.col("key").eqNullSafe(F.col("bad")), "left_anti").select("row.*")


def remove_spans(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """The documents without the words that hits cover; what stands between two words goes with the later word."""
    grams = windows(items, n)
    keyed = _keyed(docs)
    w = keyed.select("key", words_of(F.col("text")).alias("w")).dropDuplicates(["key"])
    spots = None
    for r in grams.select("len").distinct().collect():
        part = w.select("key", F.explode(_places(F.col("w"), r["len"])).alias("p")).select("key", "p.*")
        spots = part if spots is None else spots.unionByName(part)
    if spots is None:
        return docs
    hit = spots.join(grams.select("gram", "len").distinct(), ["gram", "len"], "left_semi")
    hit = hit.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("i"), F.col("i") + F.col("len") - 1)))).alias("hit")).withColumnRenamed("key", "bad")
    out = keyed.join(hit, F.col("key").eqNullSafe(F.col("bad")), "left")
    gaps, words = F.split("text", ANY_WORD, -1), F.regexp_extract_all("text", F.lit(ANY_WORD), F.lit(0))
    kept = F.transform(words, lambda x, i: F.when(F.array_contains("hit", i), F.lit("")).otherwise(F.concat(F.get(gaps, i), x)))
    text = F.when(F.col("hit").isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, ""), F.element_at(gaps, -1)))
    return out.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage_decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of a benchmark item occurs; null and empty texts stay."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, least(len(w), 10) AS k, w, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, k, array_to_string(w[i + 1 : i + k], ' ') AS gram FROM bw),
p AS (SELECT r, w, unnest(range(0, len(w))) AS i FROM d),
dw AS (SELECT r, i, array_to_string(w[i + 1 : i + 10], ' ') AS gram10, w FROM p),
h AS (SELECT r, i, k, item FROM dw JOIN g ON k = 10 AND gram10 = gram
      UNION ALL SELECT r, i, k, item FROM p JOIN g ON k < 10 AND array_to_string(p.w[i + 1 : i + k], ' ') = gram),
n AS (SELECT r, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM h) GROUP BY r),
m AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
