"""Texts alike in their word shingles: exact Jaccard through a prefix index with count filtering, then components.

The stages' settings; op10's own are in near_dup.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts_of
from .graph import components

SHINGLE = 5
#: Two texts are linked if their sets' Jaccard similarity is at least PART / WHOLE; all bounds are in whole numbers.
PART, WHOLE = 4, 5
#: Shingles are ordered by the count of their slot. The order decides only how much the index holds, not what is found.
SLOTS_LOG2 = 20
SLOT_PARTS = 64
#: Posting lists up to this length give all their pairs at once; longer ones go by rounds of leaders first.
POSTING = 32
LEADERS, ROUNDS = 8, 6
#: A round that finds fewer links than one for so many nodes of long lists is the last, as is one that finds less than a
#: quarter of what it tries; so rounds are as many for any number of documents.
FEW = 100
#: Longs of the bitmap that holds one bit for each shingle's hash class.
MAP_LONGS = 8
#: Groups into which the partners of a node are dealt for verification.
DEALT = 64
#: Up to so many nodes (8 bytes each) are sent to all tasks to pick their sets before a shuffle.
BROADCAST_NODES = 1_000_000


def shingles(text: str) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles; a text of fewer words is one shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(b" ".join(words[i : i + SHINGLE])) for i in range(max(1, len(words) - SHINGLE + 1))])
    return np.unique(np.frombuffer(hashes, ">u8").astype(np.uint64))


def node(s: np.ndarray) -> int:
    """The set's own hash, as a signed long: texts with the same set are one node."""
    h = xxhash.xxh64_intdigest(s.tobytes())
    return h - (1 << 64) if h >> 63 else h


def _slots(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64((1 << SLOTS_LOG2) - 1)).astype(np.int64)


def slot_counts(docs: DataFrame) -> np.ndarray:
    """How many shingles of all texts fall in each slot, summed over all tasks; its size is fixed."""
    width = (1 << SLOTS_LOG2) // SLOT_PARTS

    def count(batches):
        total = np.zeros(1 << SLOTS_LOG2, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                total += np.bincount(_slots(np.concatenate([shingles(t) for t in texts_of(whole.slice(at, 500))])), minlength=len(total))
        parts = [zlib.compress(total[i * width : (i + 1) * width].astype("<i8").tobytes(), 1) for i in range(SLOT_PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLOT_PARTS), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])

    def add(group):
        total = sum(np.frombuffer(zlib.decompress(c), "<i8") for c in group["counts"].to_pylist())
        return pa.table({"part": group["part"].slice(0, 1), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    out = np.zeros(1 << SLOTS_LOG2, np.int64)
    for r in docs.select("text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect():
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["counts"], "<i8")
    return out


def _bitmap(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(MAP_LONGS * 64, np.uint8)
    bits[(s >> np.uint64(40)).astype(np.int64) % len(bits)] = 1
    return np.packbits(bits).view(np.int64)


def fingerprint(s: np.ndarray) -> int:
    """The 64-bit SimHash of a set of shingle hashes, as a signed long: bits that are set in over half of them; 0 for none."""
    if not len(s):
        return 0
    high = np.unpackbits(s.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) * 2 > len(s)
    return int(np.packbits(high).view(">i8")[0])


def _least(n):
    """The fewest shingles that a set of n shares with a linked one: ceil(n * PART / WHOLE)."""
    return (n * PART + WHOLE - 1) // WHOLE


def prefixes(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """`keep`, node, n, fp, bits and prefix: the text's set, its size, SimHash and bitmap, and its rarest shingles, rarest
    first, as many as the index needs.

    Two linked sets share at least one shingle of both prefixes, whatever the order, as it is the same for all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(slot_counts(docs))
    fields = docs.select(*keep).schema.fields

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                sets = [shingles(t) for t in texts_of(b)]
                first = [s[np.lexsort((s, shared.value[_slots(s)]))[: len(s) - _least(len(s)) + 1]].view(np.int64) for s in sets]
                ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first)))
                yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array([node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([_bitmap(s) for s in sets], pa.list_(pa.int64())), lists], names=[*keep, "node", "n", "fp", "bits", "prefix"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", node long, n long, fp long, bits array<long>, prefix array<long>"
    return docs.select(*keep, "text").mapInArrow(run, schema)


def node_sets(docs: DataFrame) -> DataFrame:
    """(node, s) of each text: the set as sorted 64-bit numbers."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                sets = [shingles(t) for t in texts_of(whole.slice(at, 500))]
                yield pa.RecordBatch.from_arrays([pa.array([node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "s"])

    return docs.select("text").mapInArrow(run, "node long, s binary")


def _needed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of the nodes in `pairs`, so that no others are shuffled; up to BROADCAST_NODES nodes go to all tasks.

    Beyond that the joins take all sets.
    """
    nodes = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "needed")
    return sets.join(F.broadcast(nodes), "node", "left_semi") if nodes.count() <= BROADCAST_NODES else sets


def _with_set(pairs: DataFrame, sets: DataFrame, p: str, dealt: bool) -> DataFrame:
    """Adds {p}_s, the set of node p. Dealt: a node's pairs are joined in up to DEALT groups, each with a copy of its set."""
    side = sets.select(F.col("node").alias(p), F.col("s").alias(f"{p}_s"))
    if not dealt:
        return pairs.join(side, p)
    copies = pairs.select(p, "group").distinct().join(side, p)
    return pairs.join(copies, [p, "group"])


def verified(pairs: DataFrame, sets: DataFrame, dealt: tuple[str, ...] = ()) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. dealt: of a and b, those that may have very many pairs."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                b, ok = whole.slice(at, 100), []
                for x, y in zip(b["a_s"].to_pylist(), b["b_s"].to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(WHOLE * both >= PART * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    few = _needed(pairs, sets)
    pairs = pairs.select("a", "b", *([F.pmod(F.xxhash64("a", "b"), F.lit(DEALT)).alias("group")] if dealt else []))
    for p in "ab":
        pairs = _with_set(pairs, few, p, p in dealt)
    return pairs.select("a", "b", "a_s", "b_s").mapInArrow(run, "a long, b long")


def _can_link(bitmaps: bool) -> Column:
    """Whether a and b, which meet on a list at places a_i and b_i of their prefixes, can be similar, if that is the first
    list on which they meet.

    The sets share at most what follows in the shorter rest; with bitmaps, what their differing bits leave over too.
    """
    most = F.least(F.col("a_n") - F.col("a_i"), F.col("b_n") - F.col("b_i"))
    if bitmaps:
        apart = sum((F.bit_count(F.col("a_bits")[i].bitwiseXOR(F.col("b_bits")[i])) for i in range(MAP_LONGS)), F.lit(0))
        most = F.least(most, F.floor((F.col("a_n") + F.col("b_n") - apart) / 2))
    return most * (PART + WHOLE) >= (F.col("a_n") + F.col("b_n")) * PART


def _side(entries: DataFrame, p: str) -> DataFrame:
    return entries.select("x", *[F.col(c).alias(f"{p}_{c}") for c in entries.columns if c != "x"])


def _ordered(sides: DataFrame) -> DataFrame:
    return sides.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def _meetings(entries: DataFrame, roots: bool = False) -> DataFrame:
    """(a, b) of all nodes that meet on a list and can be similar; with roots, of different components.

    b's set is not the smaller one, so a meets its linked partners within a ninth of its shingles already.
    """
    first = entries.where(F.col("i") * (PART + WHOLE) <= F.col("n"))
    smaller = (F.col("a_n") < F.col("b_n")) | (F.col("a_n") == F.col("b_n")) & (F.col("a_node") < F.col("b_node"))
    ok = smaller & _can_link(roots)
    if roots:
        ok = ok & (F.col("a_root") != F.col("b_root"))
    return _ordered(_side(first, "a").join(_side(entries, "b"), "x").where(ok))


def _rooted(members: DataFrame, forest: DataFrame) -> DataFrame:
    """The members of posting lists that hold several components as yet, with their root."""
    r = members.join(forest.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select(*members.columns, F.coalesce("root", "node").alias("root"))
    open_ = r.groupBy("x").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("x")
    return materialize(r.join(open_, "x", "left_semi"), "open")


def _led(members: DataFrame, turn: int) -> DataFrame:
    """(a, b): each open node with the one leader, of another component, whose bitmap is nearest.

    Up to 2 * LEADERS members lead a list: those of least hash among hash classes of nodes, and of components. Lists with
    mostly the same members have mostly the same leaders.
    """
    me = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), *[F.col(c) for c in ("node", "n", "i", "bits", "root")])
    places = F.array(F.pmod(F.xxhash64("node", F.lit(-turn - 1)), F.lit(LEADERS)), F.pmod(F.xxhash64("root", F.lit(turn)), F.lit(LEADERS)) + LEADERS)
    best = members.select("x", me.alias("m"), F.explode(places).alias("place")).groupBy("x", "place").agg(F.min("m").alias("m"))
    leaders = best.groupBy("x").agg(F.collect_list("m").alias("leaders"))

    def apart(m):
        return sum((F.bit_count(F.col("bits")[i].bitwiseXOR(m["bits"][i])) for i in range(MAP_LONGS)), F.lit(0))

    def offer(m):
        far, both = apart(m), F.col("n") + m["n"]
        most = F.least(F.col("n") - F.col("i"), m["n"] - m["i"], F.floor((both - far) / 2))
        return F.when((m["root"] != F.col("root")) & (most * (PART + WHOLE) >= both * PART), F.struct((-far / both).alias("near"), m["node"].alias("b")))

    met = members.join(leaders, "x").select(F.col("node").alias("a"), F.array_max(F.transform("leaders", offer)).alias("m"))
    return met.where("m is not null").groupBy("a").agg(F.max("m").alias("m")).select("a", F.col("m.b").alias("b"))


def links(rows: DataFrame, docs: DataFrame, key: tuple[str, ...], posting: int = POSTING, likely: DataFrame | None = None) -> DataFrame:
    """(a, b): links that connect the same nodes as all pairs of nodes that are similar enough.

    `rows` are the prefixes of `docs`, told apart by `key`. The pairs (a, b) of `likely`, those of near fingerprints, are
    verified first; what follows finds the links that fingerprints miss. Pairs that meet on short posting lists, at
    places that leave enough to share, are verified. On long lists a round verifies one pair for each node that meets another component
    there; members of one component need no more comparing, and rounds end when they find little. Then the pairs of
    members of different components are verified where places and bitmaps let them be similar, so that none is missed.
    Lists of many texts that stay unlike each other still cost the square of their length in comparisons of bitmaps.
    """
    nodes = rows.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix"))
    entries = nodes.select("node", "n", F.posexplode("prefix").alias("i", "x")).repartition("x")
    sizes = entries.groupBy("x").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialize(entries.join(sizes, "x"), "shared")
    long_ = shared.where(F.col("size") > posting).drop("size")
    pairs = _meetings(shared.where(F.col("size") <= posting).drop("size"))
    if likely is not None:
        likely = materialize(likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "likely")
        pairs = pairs.join(likely, ["a", "b"], "left_anti")
    pairs = materialize(pairs, "pairs")
    both = pairs if likely is None else pairs.unionByName(likely)
    wanted = both.select(F.explode(F.array("a", "b")).alias("node")).unionByName(long_.select("node")).distinct()
    firsts = rows.join(materialize(wanted, "wanted"), "node", "left_semi").groupBy("node").agg(F.min(F.struct(*key)).alias("k")).select("k.*")
    sets = materialize(node_sets(docs.join(materialize(firsts, "firsts"), list(key), "left_semi")).dropDuplicates(["node"]), "sets")
    edges = materialize(verified(pairs, sets), "links")
    if likely is not None:
        edges = edges.unionByName(materialize(verified(likely, sets, dealt=("a", "b")), "links"))
    if long_.isEmpty():
        return edges
    long_ = materialize(long_.join(nodes.select("node", "bits"), "node"), "long")
    nodes_in_long = long_.select("node").distinct().count()
    forest = components(edges)
    as_edges = lambda: forest.select(F.col("node").alias("a"), F.col("root").alias("b"))
    for turn in range(ROUNDS):
        members = _rooted(long_, forest)
        led = materialize(_led(members, turn), "led")
        found = materialize(verified(led, sets, dealt=("b",)), "links")
        n = found.count()
        if n:
            forest = components(as_edges().unionByName(found))
        if n * FEW < nodes_in_long or 4 * n < led.count():
            break
    members = _rooted(long_, forest)
    return as_edges().unionByName(materialize(verified(materialize(_meetings(members, roots=True), "pairs"), sets, dealt=("a", "b")), "links"))


def components_of(rows: DataFrame, docs: DataFrame, key: tuple[str, ...], likely: DataFrame) -> DataFrame:
    """`rows` without prefix, with component: the least node that links reach."""
    roots = components(links(rows, docs, key, likely=likely)).withColumnRenamed("node", "_n")
    return rows.drop("prefix", "bits", "fp").join(roots, F.col("node") == F.col("_n"), "left").withColumn("component", F.coalesce("root", "node")).drop("_n", "root")
