"""Suffix-array dedup: removes every byte that a repeated string of a given length covers.

Suffixes are sampled so that any repeated string holds a sampled one at the same place in each copy: of the 8-byte
hashes in the first `spread` bytes of a window, the least marks the anchor. All windows with one anchor form a run, and
a run's string is what its windows cover together. Runs whose whole string occurs twice are settled by counting; only
runs that share their suffix's head with a different run go on to the sort: their suffixes are range-partitioned by
sampled splitters, each bucket is sorted by multikey quicksort, neighbours with a common head are compared window by
window, and the groups at a bucket's ends are compared across boundaries.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REQUEST, REQUEST_ARROW, answers, block_table, materialize, reply_arrays, request_rows, rows_table, shuffle_partitions, table, with_blocks
from .passages import passage_words

GRAM = 8
#: Leading bytes of a suffix by which it is dealt to a bucket.
PREFIX = 16
STEP = 1 << 19
HEAD, WHOLE = 0, 1
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = max(_POWERS, default=0)
    if have < n:
        _POWERS.clear()
        up = np.full(n, _BASE, np.uint64)
        down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[n] = (np.cumprod(up), np.cumprod(down))
    return _POWERS[max(_POWERS)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _sliding_min(v: np.ndarray, n: int, width: int) -> np.ndarray:
    """min(v[i : i + width]) for i < n, from minima towards both ends of blocks of `width`."""
    size = -(-(n + width) // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: min(len(v), size)] = v[:size]
    grid = padded.reshape(-1, width)
    to_right = np.minimum.accumulate(grid, axis=1).reshape(-1)
    to_left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(to_left[:n], to_right[width - 1 : width - 1 + n])


@dataclass
class Runs:
    """Runs of windows with one anchor: their texts, places in the joined bytes, and the keys of head and string."""

    doc: np.ndarray
    low: np.ndarray
    high: np.ndarray
    anchor: np.ndarray
    head: np.ndarray
    whole: np.ndarray


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int) -> Runs:
    """The runs of joined texts; offsets: where each begins, and the end of all."""
    spread, head = length // 2, length // 2
    up, down = _powers(STEP + length + 1)
    found = []
    for p0 in range(0, len(data), STEP):
        seg = data[p0 : p0 + STEP + length]
        n = min(STEP, len(data) - p0)
        if len(seg) < length:
            break
        c = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(_BYTES[seg] * up[: len(seg)], out=c[1:])
        h = _mix((c[GRAM:] - c[:-GRAM]) * down[: len(seg) - GRAM + 1])
        v = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        anchor = (_sliding_min(v, n, spread) & np.uint64(0xFFFFFF)).astype(np.int64)
        i0, i1 = int(np.searchsorted(offsets, p0, "right")) - 1, int(np.searchsorted(offsets, p0 + n, "left"))
        cut = np.clip(offsets[i0 : i1 + 1], p0, p0 + n)
        doc = np.repeat(np.arange(i0, i1), np.diff(cut))
        at = np.flatnonzero(np.arange(p0, p0 + n) + length <= offsets[doc + 1])
        if not len(at):
            continue
        a, d = anchor[at], doc[at]
        new = np.ones(len(at), bool)
        new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        low, high, a = at[first], at[last], a[first]
        heads = _mix((c[a + head] - c[a]) * down[a])
        wholes = _mix((c[high + length] - c[low]) * down[low] + (high - low).astype(np.uint64) * np.uint64(_BASE))
        found.append((d[first], low + p0, high + p0, a + p0, heads, wholes))
    if not found:
        e, k = np.empty(0, np.int64), np.empty(0, np.uint64)
        return Runs(e, e, e, e, k, k)
    return Runs(*[np.concatenate(x) for x in zip(*found, strict=True)])


def _joined(block: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
    rows = block_table(block)
    texts = [x.encode() for x in rows["text"].to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    return rows["doc_id"].to_pylist(), np.frombuffer(b"".join(texts), np.uint8), offsets


def _requests(length: int, parts: int):
    def run(block: pa.Table) -> pa.Table:
        _, data, offsets = _joined(block)
        r = runs_of(data, offsets, length)
        rows = []
        for kind, keys in ((HEAD, r.head), (WHOLE, r.whole)):
            rows += request_rows(block["block"][0].as_py(), kind, *np.unique(keys, return_counts=True), parts)
        return rows_table(rows, REQUEST_ARROW)

    return run


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as maximal ones in order; touching ones become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    first = np.flatnonzero(new)
    return s[first], e[np.append(first[1:], len(s)) - 1]


SETTLED = "block int, ord int, start int, end int, low int, lead int, string binary, open boolean"
SETTLED_ARROW = pa.schema([("block", pa.int32()), ("ord", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("low", pa.int32()), ("lead", pa.int32()), ("string", pa.binary()), ("open", pa.bool_())])


def _settle(length: int):
    """Of each block: the intervals that counting settles, and the strings of the runs that are to be sorted."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows or not replies.num_rows:
            return SETTLED_ARROW.empty_table()
        _, data, offsets = _joined(docs)
        r, got, block = runs_of(data, offsets, length), replies.to_pylist(), docs["block"][0].as_py()
        _, head_at = np.unique(r.head, return_inverse=True)
        _, whole_first, whole_at = np.unique(r.whole, return_index=True, return_inverse=True)
        heads = reply_arrays(got, HEAD)[0][head_at]
        totals, owner = (x[whole_at] for x in reply_arrays(got, WHOLE))
        twice = totals > 1
        s, e = _merge(r.low[twice], r.high[twice] + length)
        # texts are joined without a gap, so an interval is cut where a text ends
        d0, d1 = np.searchsorted(offsets, s, "right") - 1, np.searchsorted(offsets, e, "left")
        cut = [(d, max(a, int(offsets[d])) - int(offsets[d]), min(b, int(offsets[d + 1])) - int(offsets[d])) for a, b, x, y in zip(s.tolist(), e.tolist(), d0.tolist(), d1.tolist(), strict=True) for d in range(x, y)]
        cut = [c for c in cut if c[2] > c[1]]
        first_here = np.zeros(len(r.whole), bool)
        first_here[whole_first] = True
        go = (~twice & (heads > 1)) | (twice & (heads > totals) & owner.astype(bool) & first_here)
        low, high, base = r.low[go], r.high[go] + length, offsets[r.doc[go]]
        k, n = len(cut), int(go.sum())
        cols = [
            pa.array([block] * (k + n), pa.int32()),
            pa.array([c[0] for c in cut] + r.doc[go].tolist(), pa.int32()),
            pa.array([c[1] for c in cut] + [None] * n, pa.int32()),
            pa.array([c[2] for c in cut] + [None] * n, pa.int32()),
            pa.array([None] * k + (low - base).tolist(), pa.int32()),
            pa.array([None] * k + (r.anchor[go] - low).tolist(), pa.int32()),
            pa.array([None] * k + [data[a:b].tobytes() for a, b in zip(low.tolist(), high.tolist(), strict=True)], pa.binary()),
            pa.array([False] * k + (~twice[go]).tolist(), pa.bool_()),
        ]
        return pa.Table.from_arrays(cols, schema=SETTLED_ARROW)

    return run


def multikey_quicksort(words: np.ndarray, small: int = 48) -> np.ndarray:
    """The order of rows of big-endian words: three-way partition on one word, then on the next where it is equal."""
    out, stack = [], [(np.arange(len(words)), 0)]
    while stack:
        idx, depth = stack.pop()
        if depth == words.shape[1] or len(idx) < 2:
            out.append(idx)
        elif len(idx) <= small:
            key = words[idx, depth:].astype(">u8")
            raw = [x.tobytes() for x in key]
            out.append(idx[sorted(range(len(idx)), key=raw.__getitem__)])
        else:
            w = words[idx, depth]
            pivot = np.sort(w[:: max(1, len(w) // 9)])[len(w[:: max(1, len(w) // 9)]) // 2]
            stack += [(idx[w > pivot], depth), (idx[w == pivot], depth + 1), (idx[w < pivot], depth)]
    return np.concatenate(out) if out else np.empty(0, np.int64)


# An interval, or with `hashes` a suffix of a bucket's first or last group: its anchor in `start`, and the hashes of
# the windows that begin `end`, `end` + 1, ... bytes before it.
FOUND = "bucket int, block int, ord int, start int, end int, hashes binary"
FOUND_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("ord", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hashes", pa.binary())])
SPANS = "block int, ord int, start int, end int"
SPANS_ARROW = pa.schema([("block", pa.int32()), ("ord", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def _bucket(rows: pa.Table, length: int, bucket: int = 0) -> pa.Table:
    """Sorts a bucket's suffixes and compares neighbours; its first and last group go out to be compared with others'."""
    half = length // 2
    m = rows.num_rows
    low, lead = rows["low"].to_numpy(), rows["lead"].to_numpy()
    strings = rows["string"].to_pylist()
    size = np.array([len(x) for x in strings])
    grid = np.zeros((m, length + half), np.uint8)  # column `half` is the anchor
    for i, (x, a) in enumerate(zip(strings, lead.tolist(), strict=True)):
        grid[i, half - a : half - a + len(x)] = np.frombuffer(x, np.uint8)
    right = np.ascontiguousarray(grid[:, half:])
    pad = -right.shape[1] % 8
    words = (np.pad(right, ((0, 0), (0, pad))) if pad else right).view(">u8").astype(np.uint64)
    order = multikey_quicksort(words)
    top = right[order, :half]
    new = np.ones(m, bool)
    new[1:] = (top[1:] != top[:-1]).any(axis=1)
    group = np.cumsum(new) - 1
    n = np.bincount(group)
    # rows were dealt by leading bytes and the head's hash: only the groups that come first and last in this order can
    # go on in another bucket
    keyed = np.lexsort((rows["head"].to_numpy()[order], *words[order, : PREFIX // 8].T[::-1]))
    edge = (group == group[keyed[0]]) | (group == group[keyed[-1]])
    keep = (n[group] > 1) | edge
    order, group, edge = order[keep], group[keep], edge[keep]
    up, down = _powers(length + half + 1)
    hashes = np.empty((len(order), half), np.uint64)  # of the window that begins `column` bytes before the anchor
    for a in range(0, len(order), 2048):
        g = grid[order[a : a + 2048]]
        c = np.zeros((len(g), g.shape[1] + 1), np.uint64)
        np.cumsum(_BYTES[g] * up[: g.shape[1]], axis=1, out=c[:, 1:])
        for back in range(half):
            s = half - back
            hashes[a : a + 2048, back] = _mix((c[:, s + length] - c[:, s]) * down[s] + np.uint64(back) * np.uint64(_BASE))
    lead_, last_back = lead[order], (lead - (size - length))[order]
    best = np.full((len(order), 2), -1)
    meta = [rows["block"].to_numpy()[order], rows["ord"].to_numpy()[order], low[order]]
    for back in range(half):
        valid = np.flatnonzero((back <= lead_) & (back >= last_back))
        if not len(valid):
            continue
        h, g = hashes[valid, back], group[valid]
        by = np.lexsort((h, g))
        same = (h[by][1:] == h[by][:-1]) & (g[by][1:] == g[by][:-1])
        hit = np.zeros(len(valid), bool)
        hit[by[1:][same]] = hit[by[:-1][same]] = True
        rep = valid[hit]
        best[rep, 0] = back  # ends as the largest
        best[rep[best[rep, 1] < 0], 1] = back
    ok, far = np.flatnonzero(best[:, 0] >= 0), np.flatnonzero(edge & (lead_ >= last_back))
    at = meta[2] + lead_
    blobs = [hashes[i, a : b + 1].astype("<u8").tobytes() for i, a, b in zip(far.tolist(), last_back[far].tolist(), lead_[far].tolist(), strict=True)]
    both = np.concatenate([ok, far])
    cols = [
        pa.array([bucket] * len(both), pa.int32()), pa.array(meta[0][both], pa.int32()), pa.array(meta[1][both], pa.int32()),
        pa.array(np.concatenate([at[ok] - best[ok, 0], at[far]]), pa.int32()), pa.array(np.concatenate([at[ok] - best[ok, 1] + length, last_back[far]]), pa.int32()),
        pa.array([None] * len(ok) + blobs, pa.binary()),
    ]
    return pa.Table.from_arrays(cols, schema=FOUND_ARROW)


def _edge_requests(parts: int):
    def run(rows: pa.Table) -> pa.Table:
        own = np.concatenate([np.frombuffer(x, "<u8") for x in rows["hashes"].to_pylist()])
        return rows_table(request_rows(rows["bucket"][0].as_py(), 0, *np.unique(own, return_counts=True), parts), REQUEST_ARROW)

    return run


def _edge_spans(length: int):
    """The intervals of a bucket's edge suffixes, from how often their windows occur at the edges of all buckets."""

    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, "<u8") for x in rows["hashes"].to_pylist()]
        if not blobs:
            return SPANS_ARROW.empty_table()
        _, at = np.unique(np.concatenate(blobs), return_inverse=True)
        twice = reply_arrays(replies.to_pylist(), 0)[0][at] > 1
        cut, found = np.cumsum([len(x) for x in blobs])[:-1], []
        for block, ord_, anchor, back, hit in zip(*(rows[c].to_pylist() for c in ("block", "ord", "start", "end")), np.split(twice, cut), strict=True):
            where = np.flatnonzero(hit)
            if len(where):
                found.append({"block": block, "ord": ord_, "start": anchor - back - int(where[-1]), "end": anchor - back - int(where[0]) + length})
        return pa.Table.from_pylist(found, schema=SPANS_ARROW)

    return run


def repeated_intervals(blocks: DataFrame, parts: int, length: int = 400) -> DataFrame:
    """(block, ord, start, end) of the rows of with_blocks(): what repeated strings of `length` bytes cover."""
    replies = answers(blocks.groupBy("block").applyInArrow(_requests(length, parts), REQUEST))
    settled = materialize(blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_settle(length), SETTLED), "settled")
    suffixes = settled.where(F.col("string").isNotNull())
    buckets = max(shuffle_partitions(blocks.sparkSession), -(-suffixes.count() // 40_000))
    suffixes = suffixes.withColumn("head", F.expr(f"xxhash64(substring(string, lead + 1, {length // 2}))"))
    # splitters are sampled by leading bytes, so that what goes to the driver does not hold whole strings; the other
    # keys share out suffixes that begin alike, even those of one head
    in_order = suffixes.repartitionByRange(buckets, F.expr(f"substring(string, lead + 1, {PREFIX})"), "head", "block", "ord", "low")

    def run(batches):
        from pyspark import TaskContext

        held = list(batches)
        if held:
            yield from _bucket(pa.Table.from_batches(held), length, TaskContext.get().partitionId()).to_batches()

    found = materialize(in_order.mapInArrow(run, FOUND), "sorted")
    edge = found.where(F.col("hashes").isNotNull())
    edge_replies = answers(edge.groupBy("bucket").applyInArrow(_edge_requests(-(-edge.count() // 10_000) or 1), REQUEST))
    across = edge.groupBy("bucket").cogroup(edge_replies.groupBy("block")).applyInArrow(_edge_spans(length), SPANS)
    settled_spans, own = settled.where(F.col("start").isNotNull()), found.where(F.col("hashes").isNull())
    return settled_spans.select("block", "ord", "start", "end").unionByName(own.select("block", "ord", "start", "end")).unionByName(across)


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, kept binary"


def _cut(with_bytes: bool):
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        ids, data, offsets = _joined(docs)
        out = {c.split()[0]: [] for c in KEPT.split(", ")}
        ord_, start, end = (spans[c].to_numpy() if spans.num_rows else np.empty(0, np.int64) for c in ("ord", "start", "end"))
        words = np.zeros(len(ids), np.int64)
        words[ord_[start < 0]] = end[start < 0]
        ord_, start, end = ord_[start >= 0], start[start >= 0], end[start >= 0]
        order = np.argsort(ord_, kind="stable")
        ord_, start, end = ord_[order], start[order], end[order]
        cut = np.searchsorted(ord_, np.arange(len(ids) + 1))
        for i, doc_id in enumerate(ids):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            s, e = _merge(start[cut[i] : cut[i + 1]], end[cut[i] : cut[i + 1]])
            at, kept = 0, []
            for a, b in zip(s.tolist(), e.tolist(), strict=True):
                kept.append(text[at:a])
                at = b
            left = b"".join([*kept, text[at:]])
            for c, v in zip(out, (doc_id, len(text), len(text) - len(left), len(s), hashlib.sha256(left).hexdigest(), int(words[i]), left if with_bytes else None), strict=True):
                out[c].append(v)
        return pa.table([pa.array(out["doc_id"], pa.int64()), *[pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")], pa.array(out["kept_sha256"], pa.string()), pa.array(out["n_passage_words"], pa.int64()), pa.array(out["kept"], pa.binary())], names=list(out))

    return run


def remove_repeats(docs: DataFrame, length: int = 400, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words and kept (the remaining bytes) of every row.

    A byte goes if any string of `length` bytes that covers it starts anywhere else too, in the same text or another,
    overlaps included. Strings never cross rows. Null and empty texts have no bytes; texts shorter than `length` stay
    whole; repeated rows count as copies; an empty table gives an empty result. Strings are told apart by 64-bit
    hashes of the whole string. n_passage_words counts words in passages of over 50 words that another row has too,
    which may be shorter than `length` bytes; it takes no part in what is removed.
    """
    if length < 4 * GRAM or length % 2:
        raise ValueError("length is even and at least 32")
    blocks, parts = with_blocks(docs)
    spans = repeated_intervals(blocks, parts, length).unionByName(passage_words(blocks, parts))
    return blocks.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_cut(with_bytes), KEPT)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False).drop("kept")
