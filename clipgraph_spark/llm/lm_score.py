"""Language-model scoring with a weighted backoff automaton over word trigrams."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REQUEST, REQUEST_ARROW, answers, block_table, reply_arrays, request_rows, rows_table, table, with_blocks

END_KEY = np.uint64(0x9E3779B97F4A7C15)
START_KEY = np.uint64(0xC2B2AE3D27D4EB4F)
#: What a word's and a pair's state give to the shorter context, in words seen: p(w | h) = (c(h, w) + k p(w | h')) / (c(h) + k).
#: Chosen by the probability of held-out texts (sf0.1).
K_WORD, K_PAIR = 1000.0, 30.0
#: A pair of words is a state if it was seen this often.
MIN_PAIR = 4
UNIGRAM, BIGRAM, TRIGRAM = 0, 1, 2
#: Rows are walked in pieces of so many tokens, all pieces of a block side by side.
PIECE = 256
REACH = 2  # words that a state remembers


def is_held_out(doc_id: int | None, classes: int = 7, left_out: int = 2) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % classes == left_out


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0xD6E8FEB86659FD93) + b
    x = x ^ (x >> np.uint64(32))
    return x * np.uint64(0xFF51AFD7ED558CCD)


def _coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them."""
    order = np.argsort(x)
    inside = x[order]
    new = np.ones(len(x), bool)
    new[1:] = inside[1:] != inside[:-1]
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    return inside[new], at


class Tokens:
    """The tokens of a block's rows, as numbers of the block's words, and the pairs they make with the token before."""

    def __init__(self, block: pa.Table):
        rows = block_table(block)
        self.ids = rows["doc_id"].to_pylist()
        texts = pc.ascii_trim_whitespace(pc.ascii_lower(rows["text"].combine_chunks().cast(pa.large_string())))
        words = pc.ascii_split_whitespace(pc.if_else(pc.equal(texts, ""), None, texts))  # no text, no word
        coded = pc.list_flatten(words).dictionary_encode()
        owner = pc.list_parent_indices(words).to_numpy()
        digest = xxhash.xxh64_intdigest
        names = [digest(w) for w in coded.dictionary.to_pylist()]
        self.end, self.start, self.size = len(names), len(names) + 1, len(names) + 2
        self.names = np.array([*names, END_KEY, START_KEY], np.uint64)
        self.n = np.bincount(owner, minlength=len(self.ids)) + 1
        self.row = np.repeat(np.arange(len(self.ids)), self.n)
        self.first = np.cumsum(self.n) - self.n
        self.word = np.full(len(self.row), self.end)
        self.word[np.arange(len(owner)) + owner] = coded.indices.to_numpy()
        before = np.roll(self.word, 1)
        before[self.first] = self.start
        self.held = np.array([is_held_out(i) for i in self.ids], bool)
        self.learn = ~self.held[self.row]
        pairs, self.pair_at = _coded(before * self.size + self.word)
        self.pair_from, self.pair_to = pairs // self.size, pairs % self.size
        self.pair_key = _mixed(self.names[self.pair_from], self.names[self.pair_to])

    def triples(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the distinct triples that begin with a pair marked in `state`: first pair, last pair and key; and where
        each token ends one (the others have no such triple)."""
        at = np.flatnonzero(np.arange(len(self.word)) > np.repeat(self.first, self.n))
        at = at[state[self.pair_at[at - 1]]]
        _, inverse = _coded(self.pair_at[at - 1] * self.size + self.word[at])
        one = np.zeros(inverse.max(initial=-1) + 1, np.int64)
        one[inverse] = np.arange(len(at))
        lead, last = self.pair_at[at - 1][one], self.pair_at[at][one]
        return lead, last, _mixed(self.pair_key[lead], self.names[self.pair_to[last]]), np.stack([at, inverse])


def _request(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> list[dict]:
    order = np.argsort(keys)
    return request_rows(block, kind, keys[order], counts[order].astype(np.int64), parts)


def _totals(got: list[dict], kind: int, keys: np.ndarray) -> np.ndarray:
    out = np.empty(len(keys))
    out[np.argsort(keys)] = reply_arrays(got, kind)[0]
    return out


def _requests(parts: int):
    def run(block: pa.Table) -> pa.Table:
        t, b = Tokens(block), block["block"][0].as_py()
        rows = _request(b, UNIGRAM, t.names[: t.start], np.bincount(t.word, t.learn, t.start), parts)
        return rows_table(rows + _request(b, BIGRAM, t.pair_key, np.bincount(t.pair_at, t.learn, len(t.pair_key)), parts), REQUEST_ARROW)

    return run


def _triple_requests(parts: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return REQUEST_ARROW.empty_table()
        t = Tokens(docs)
        _, _, keys, (at, inverse) = t.triples(_totals(replies.to_pylist(), BIGRAM, t.pair_key) >= MIN_PAIR)
        return rows_table(_request(docs["block"][0].as_py(), TRIGRAM, keys, np.bincount(inverse, t.learn[at], len(keys)), parts), REQUEST_ARROW)

    return run


class Automaton:
    """States, arcs and failure arcs for the words of a block, with weights from the whole corpus.

    State 0 is the root, 1 + w the word w, and after these come the pairs that were seen MIN_PAIR times. An arc of a
    state is a word that was seen after it; it leads to the longest state that the words read end with. Where a state
    has no arc for a word, its failure arc leads to the next shorter state and weighs k / (c + k). The root has an arc
    for every word, known or not.
    """

    def __init__(self, t: Tokens, got: list[dict], all_n: int, all_v: int):
        count = np.append(_totals(got, UNIGRAM, t.names[: t.start]), 0.0)
        self.known = count > 0
        self.p = (count + 1) / (all_n + all_v + 1)
        count[t.start] = count[t.end]  # a text starts as often as one ends
        pair = _totals(got, BIGRAM, t.pair_key)
        state = pair >= MIN_PAIR
        number = np.where(state, 1 + t.size + np.cumsum(state) - 1, 0)
        lead, last, keys, _ = t.triples(state)
        triple = _totals(got, TRIGRAM, keys)
        seen = np.concatenate([[0.0], count, pair[state]])
        k = np.concatenate([[1.0], np.full(t.size, K_WORD), np.full(int(state.sum()), K_PAIR)])
        self.fail = np.concatenate([np.zeros(1 + t.size, np.int64), 1 + t.pair_to[state]])
        self.fail_weight = np.log10(k / (seen + k))
        self.fail_weight[0] = 0.0
        p_pair = (pair + K_WORD * self.p[t.pair_to]) / (count[t.pair_from] + K_WORD)
        p_triple = (triple + K_PAIR * p_pair[last]) / (pair[lead] + K_PAIR)
        self.root_weight, self.root_next = np.log10(self.p), np.where(count > 0, 1 + np.arange(t.size), 0)
        to = np.where(state, number, self.root_next[t.pair_to])
        two, three = pair > 0, triple > 0
        arcs = np.concatenate([(1 + t.pair_from[two]) * t.size + t.pair_to[two], number[lead[three]] * t.size + t.pair_to[last[three]]])
        order = np.argsort(arcs)
        self.size, self.arcs = t.size, np.append(arcs[order], np.iinfo(np.int64).max)
        self.weight = np.append(np.log10(np.concatenate([p_pair[two], p_triple[three]]))[order], 0.0)
        self.next = np.append(np.concatenate([to[two], to[last[three]]])[order], 0)

    def place(self, key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)  # searched in order, near keys meet near arcs
        at = np.empty(len(key), np.int64)
        at[order] = np.searchsorted(self.arcs, key[order])
        return at

    def read(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word from each state: the states after it, and the log probabilities along the arcs taken."""
        key = state * self.size + word
        at = self.place(key)
        weight, after = self.weight[at], self.next[at]
        failed = np.flatnonzero(self.arcs[at] != key)
        weight[failed] = 0.0
        now = state[failed]
        while len(failed):
            root = now == 0
            done = failed[root]
            weight[done] += self.root_weight[word[done]]
            after[done] = self.root_next[word[done]]
            failed, now = failed[~root], now[~root]
            weight[failed] += self.fail_weight[now]
            now = self.fail[now]
            key = now * self.size + word[failed]
            at = self.place(key)
            hit = (self.arcs[at] == key) & (now > 0)
            weight[failed[hit]] += self.weight[at[hit]]
            after[failed[hit]] = self.next[at[hit]]
            failed, now = failed[~hit], now[~hit]
        return after, weight

    def walk(self, t: Tokens) -> np.ndarray:
        """The log probability of each row: one walk from left to right that carries the state.

        A row begins in the state of the start. Long rows are walked in pieces; as a state remembers REACH words, a
        later piece first reads the REACH words before it, from the root, and is then in the state the row is in.
        """
        pieces = -(-t.n // PIECE)
        row = np.repeat(np.arange(len(t.n)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = t.first[row] + nth * PIECE
        length = np.minimum(t.n[row] - nth * PIECE, PIECE)
        order = np.argsort(-length, kind="stable")
        begin, length, nth, row = begin[order], length[order], nth[order], row[order]
        state = np.where(nth == 0, 1 + t.start, 0)
        later = np.flatnonzero(nth > 0)
        for back in range(REACH, 0, -1):
            state[later] = self.read(state[later], t.word[begin[later] - back])[0]
        score = np.zeros(len(row))
        for i in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -i, "left"))  # pieces longer than i
            state[:n], weight = self.read(state[:n], t.word[begin[:n] + i])
            score[:n] += weight
        return np.bincount(row, score, len(t.n))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(docs: pa.Table, replies: pa.Table) -> pa.Table:
    if not docs.num_rows:
        return pa.table({c: pa.array([], k) for c, k in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
    t, got = Tokens(docs), replies.to_pylist()
    all_n, all_v = (int(got[0][c]) for c in ("all_n", "all_v"))
    a = Automaton(t, got, all_n, all_v)
    rows = len(t.ids)
    base = np.bincount(t.row, np.log10(a.p)[t.word], rows)
    known = np.bincount(t.row, a.known[t.word], rows).astype(np.int64)
    cols = [pa.array(t.ids, pa.int64()), pa.array(t.held), pa.array(t.n.astype(np.int64)), pa.array(known), pa.array([all_n] * rows, pa.int64()), pa.array(base), pa.array(a.walk(t))]
    return pa.Table.from_arrays(cols, names=[c.split()[0] for c in SCORES.split(", ")])


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Blocks of rows send their distinct words and word pairs, with counts over training rows, to the keys' owners and
    get the corpus totals of just these back; then the same for the triples that begin with a pair seen MIN_PAIR times.
    Nothing else is pruned and nothing capped, the model grows with the corpus, and no task holds more of it than its
    block names: each block builds the part of the automaton that its own words can reach, and walks its rows on it.

    Null texts are empty: only the end is a token. Null doc_ids are training rows. Repeated rows repeat; very long
    texts are walked whole, in pieces; other columns are not read. An empty table gives an empty result; without
    training rows scores are from add-one smoothing of nothing.
    """
    blocks, parts = with_blocks(docs)
    by_block = lambda df: df.repartition("block").groupBy("block")
    first = answers(blocks.groupBy("block").applyInArrow(_requests(parts), REQUEST))
    totals = first.repartition("block").where(F.col("kind") == UNIGRAM).agg(F.sum("n_total").alias("n"), F.sum("n_keys").alias("v"))
    second = answers(blocks.groupBy("block").cogroup(by_block(first)).applyInArrow(_triple_requests(parts), REQUEST))
    replies = first.unionByName(second).withColumn("all_n", totals.select("n").scalar()).withColumn("all_v", totals.select("v").scalar())
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lambda a, b: _scores(a, b), SCORES)


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
