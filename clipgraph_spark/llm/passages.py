"""Passages of many words that stand in more than one row, found through sampled anchors and exact counts.

Of the hashes of GRAM words inside a window the least marks the window's anchor, so equal windows have equal anchors.
Blocks first learn which anchors occur in several rows, and then count only the windows around those, each by the hash
of all its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from .common import REQUEST, REQUEST_ARROW, answers, block_table, reply_arrays, request_rows, rows_table

#: A passage is of over 50 words.
WORDS = 51
GRAM = 8
ANCHOR, WINDOW = 0, 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
COUNTS = "block int, ord int, start int, end int"
COUNTS_ARROW = pa.schema([("block", pa.int32()), ("ord", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n values in a row, by doubling."""
    out, have, k, piece = None, 0, 1, h
    while k <= n:
        if n & k:
            out = piece.copy() if out is None else out[: len(h) - have - k + 1] * np.uint64(pow(int(_BASE), k, 1 << 64)) + piece[have : len(h) - k + 1]
            have += k
        piece = piece[: len(piece) - k] * np.uint64(pow(int(_BASE), k, 1 << 64)) + piece[k:] if len(piece) > k else piece[:0]
        k *= 2
    out = out ^ (out >> np.uint64(31))
    return out * np.uint64(0xBF58476D1CE4E5B9)


class Windows:
    """The windows of WORDS words of a block's rows, in order: their rows, first words, hashes and anchors."""

    def __init__(self, block: pa.Table):
        rows = block_table(block)
        words = pc.ascii_split_whitespace(rows["text"].combine_chunks().cast(pa.large_string()))
        flat, owner = pc.list_flatten(words), pc.list_parent_indices(words)
        real = pc.not_equal(flat, "")
        coded = flat.filter(real).dictionary_encode()
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(w) for w in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]
        row = owner.filter(real).to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(h) - WORDS + 1
        if n <= 0:
            self.row = self.first = np.empty(0, np.int64)
            self.key = self.anchor = np.empty(0, np.uint64)
            return
        grams = _rolled(h, GRAM)
        least = grams[:n].copy()
        for i in range(1, WORDS - GRAM + 1):
            np.minimum(least, grams[i : i + n], out=least)
        inside = np.flatnonzero(row[:n] == row[WORDS - 1 :])
        self.row, self.first, self.key, self.anchor = row[inside], inside, _rolled(h, WORDS)[inside], least[inside]


def _per_row(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, and in how many rows each is."""
    order = np.lexsort((rows, keys))
    k, r = keys[order], rows[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    other = new.copy()
    other[1:] |= r[1:] != r[:-1]
    first = np.flatnonzero(new)
    return k[first], np.add.reduceat(other, first, dtype=np.int64) if len(first) else first


def _several(keys: np.ndarray, got: list[dict], kind: int, of: np.ndarray) -> np.ndarray:
    """Whether each key, one of the sorted distinct `of`, is in several rows of the corpus."""
    totals = reply_arrays(got, kind)[0]
    return totals[np.searchsorted(of, keys)] > 1 if len(keys) else np.zeros(0, bool)


def _anchors(parts: int):
    def run(block: pa.Table) -> pa.Table:
        w = Windows(block)
        return rows_table(request_rows(block["block"][0].as_py(), ANCHOR, *_per_row(w.anchor, w.row), parts), REQUEST_ARROW)

    return run


def _near(w: Windows, got: list[dict]) -> np.ndarray:
    return np.flatnonzero(_several(w.anchor, got, ANCHOR, np.unique(w.anchor)))


def _windows(parts: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return REQUEST_ARROW.empty_table()
        w = Windows(docs)
        at = _near(w, replies.to_pylist())
        return rows_table(request_rows(docs["block"][0].as_py(), WINDOW, *_per_row(w.key[at], w.row[at]), parts), REQUEST_ARROW)

    return run


def _counts(docs: pa.Table, replies: pa.Table) -> pa.Table:
    if not docs.num_rows or not replies.num_rows:
        return COUNTS_ARROW.empty_table()
    w, got = Windows(docs), replies.to_pylist()
    at = _near(w, got)
    at = at[_several(w.key[at], got, WINDOW, np.unique(w.key[at]))]
    row, first = w.row[at], w.first[at]
    fresh = np.full(len(at), WORDS)
    fresh[1:] = np.where(row[1:] == row[:-1], np.minimum(first[1:] - first[:-1], WORDS), WORDS)
    covered = np.bincount(row, fresh).astype(np.int64)
    ord_ = np.flatnonzero(covered)
    cols = [[docs["block"][0].as_py()] * len(ord_), ord_, [-1] * len(ord_), covered[ord_]]
    return pa.Table.from_arrays([pa.array(c, pa.int32()) for c in cols], schema=COUNTS_ARROW)


def passage_words(blocks: DataFrame, parts: int) -> DataFrame:
    """(block, ord, start, end) with start -1: `end` words of row `ord` of the block stand in passages of WORDS words or
    more that another row has too. Rows without such words are left out."""
    by = blocks.groupBy("block")
    anchors = answers(by.applyInArrow(_anchors(parts), REQUEST))
    windows = answers(by.cogroup(anchors.groupBy("block")).applyInArrow(_windows(parts), REQUEST))
    return by.cogroup(anchors.unionByName(windows).groupBy("block")).applyInArrow(lambda a, b: _counts(a, b), COUNTS)
