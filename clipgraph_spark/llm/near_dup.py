"""SimHash near-duplicates: byte-position inverted index with count filtering, then connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near_text
from .common import free_names, materialize, table, texts_of
from .graph import components

BYTES = 8
#: Pairs of bytes form the index's positions: of four pairs, two are alike in any two linked fingerprints.
BYTE_PAIRS = ((0, 1), (2, 3), (4, 5), (6, 7))
#: Posting lists up to this length give their pairs; the fingerprints on longer ones go the exact other way.
POSTING = 32


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; 0 without words."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        hashes = digest(b" ".join(words), seed)
    else:
        joined = b" ".join(words)
        ends, at = [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *[e + 1 for e in ends[: len(ends) - shingle]]]
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=True)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, BYTES), axis=1)
    high = bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)
    return int.from_bytes(np.packbits(high).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), shingle: int = 3) -> DataFrame:
    """`keep` and fp, the fingerprint as a signed long. Null texts are empty."""
    fields = docs.select(*keep).schema.fields

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in texts_of(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array(fp, pa.int64())], names=[*keep, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", fp long"
    return docs.select(*keep, "text").mapInArrow(run, schema)


def _byte(c: Column, i: int) -> Column:
    return F.shiftright(c, 8 * i).bitwiseAND(F.lit(255))


def shared_bytes(a: Column, b: Column) -> Column:
    """The tally of positions at which two fingerprints have the same byte."""
    out = F.lit(0)
    for i in range(BYTES):
        out = out + (_byte(a, i) == _byte(b, i)).cast("int")
    return out


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def index(fps: DataFrame) -> DataFrame:
    """(fp, key): a fingerprint under each two of its four byte pairs, with their positions."""
    keys = []
    for i, p in enumerate(BYTE_PAIRS):
        for q in BYTE_PAIRS[i + 1 :]:
            code = F.lit(0).cast("long")
            for b in (*p, *q):
                code = F.shiftleft(code, 8) + _byte(F.col("fp"), b)
            keys.append(F.shiftleft(code, 3) + len(keys))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def near_pairs(fps: DataFrame, bits: int = 2, posting: int = POSTING) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within `bits` (at most 2) of each other.

    Two such fingerprints differ in at most `bits` bytes, so they share 8 - bits positional bytes and at least one
    index key. Short posting lists give their pairs, whose shared bytes are tallied; pairs that reach the least number
    are verified. Fingerprints on a longer list are each put under all values within one bit: two are within two bits
    just if they meet there, and all that meet are linked to the least, so a list of any length gives links in
    proportion to its members.
    """
    if bits > 2:
        raise ValueError("the exact way for long posting lists covers two bits")
    postings = index(fps)
    sizes = postings.groupBy("key").agg(F.count("*").alias("n"))
    sized = postings.join(sizes.where("n > 1"), "key")
    short = sized.where(F.col("n") <= posting)
    left, right = short.select("key", F.col("fp").alias("a")), short.select("key", F.col("fp").alias("b"))
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & (shared_bytes(F.col("a"), F.col("b")) >= BYTES - bits) & (distance(F.col("a"), F.col("b")) <= bits))
    long_ = sized.where(F.col("n") > posting).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    around = long_.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("z"))
    if bits < 2:
        around = long_.select("fp", F.explode(flips).alias("m")).select("fp", F.col("fp").bitwiseXOR("m").alias("z")).join(long_.select(F.col("fp").alias("z")), "z")
    met = around.groupBy("z").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).where("a < last").select("z", "a")
    links = around.join(met, "z").where("fp != a").select("a", F.col("fp").alias("b"))
    return pairs.select("a", "b").unionByName(links).distinct()


def classes(fps: DataFrame) -> DataFrame:
    """(fp, component_id) from (doc_id, fp): the least doc_id that links reach. Equal fingerprints are linked."""
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = components(near_pairs(distinct.select("fp")))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint and component_id of every row.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows repeat; null doc_ids are
    passed over when the least doc_id is taken; an empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, shingle=shingle), "simhash")
    return fps.join(classes(fps), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def likely_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) from (node, fp): each node with the least one of its fingerprint, and the least ones of linked fingerprints."""
    least = materialize(nodes.groupBy("fp").agg(F.min("node").alias("a")), "least")
    same = nodes.select("fp", F.col("node").alias("b")).join(least, "fp").where("a != b").select("a", "b").distinct()
    links = near_pairs(least.select("fp")).withColumnsRenamed({"a": "x", "b": "y"})
    x, y = least.select(F.col("fp").alias("x"), "a"), least.select(F.col("fp").alias("y"), F.col("a").alias("b"))
    return same.unionByName(links.join(x, "x").join(y, "y").select("a", "b"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class of documents that five-word similarity links (see near_text).

    SimHash fingerprints of the five-word shingles meet in the byte-position index, where shared bytes are counted, and
    the pairs that it links are verified on the whole sets; near_text then finds the similar pairs that lie further apart.

    It is the row with the least doc_id, a null one only if there is no other, and of those with the same doc_id the
    one with the least hash. Rows equal in doc_id and text stay one; no row goes for its doc_id alone.
    """
    key = ("_k1", "_k2")
    hashes = dict(zip(key, _row_hashes(), strict=True))
    rows = docs.select("doc_id", "text").withColumns(hashes)
    prefixes = materialize(near_text.prefixes(rows, ("doc_id", *key)), "prefixes")
    placed = near_text.components_of(prefixes, rows, key, likely_pairs(prefixes.select("node", "fp")))
    row = F.struct(F.col("doc_id").isNull(), "doc_id", *key)
    least = placed.groupBy("component").agg(F.min(row).alias("r")).select("r.*").select(*key)
    copies = placed.groupBy(*key).agg((F.count("*") > 1).alias("copies"))
    kept = materialize(least.join(copies, list(key)), "kept")
    names = free_names(docs, *key)
    keyed = docs.withColumns(dict(zip(names, hashes.values(), strict=True)))
    of = lambda k: keyed.join(k.select(F.col(key[0]).alias(names[0]), F.col(key[1]).alias(names[1])), names, "left_semi")
    return of(kept.where(~F.col("copies"))).unionByName(of(kept.where("copies")).dropDuplicates(names)).select(*docs.columns)


def _row_hashes() -> tuple[Column, Column]:
    """128 bits that tell rows with another doc_id or text apart; null is not the empty text."""
    cols = [F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"]
    return F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols[::-1])


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage_near_dup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates (keep_one); rows of no class, null and empty texts among them, stay by
    the same rule: null and empty texts have the same (empty) set of shingles and are one class."""
    return keep_one(docs)
