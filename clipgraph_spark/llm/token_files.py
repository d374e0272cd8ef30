"""Token-id files of directly addressable codes: any token can be read without decoding those before it."""

from __future__ import annotations

import json
import math
import os
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, slices, table

END_ID = 2
RANK_BITS = 512
MAGIC = b"DAC1"
#: Up to this many shards their first positions are broadcast (16 bytes each).
BROADCAST_SHARDS = 500_000


class DacArray:
    """Unsigned 32-bit ids as byte chunks by level.

    Level 0 holds every id's low byte. A level's continuation bitmap tells which ids go on in the next level; the
    number of set bits before a place is that place in the next level, and a directory holds this rank at every
    RANK_BITS bits. No level is stored that no id reaches.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    def __len__(self) -> int:
        return len(self.levels[0][0]) if self.levels else 0

    @classmethod
    def encode(cls, ids: np.ndarray) -> DacArray:
        rest, levels = ids.astype(np.uint32), []
        while len(rest) or not levels:
            more = rest > 0xFF
            bits = np.packbits(more, bitorder="little")
            per_block = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
            levels.append(((rest & 0xFF).astype(np.uint8), bits, np.concatenate([[0], np.cumsum(per_block)[:-1]]).astype("<u4") if len(more) else per_block))
            rest = rest[more] >> np.uint32(8)
        return cls(levels)

    def to_bytes(self) -> bytes:
        out = [MAGIC, struct.pack("<I", len(self.levels))]
        for chunks, bits, ranks in self.levels:
            out += [struct.pack("<QQQ", len(chunks), len(bits), len(ranks)), chunks.tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> DacArray:
        if data[:4] != MAGIC:
            raise ValueError("no file of directly addressable codes")
        n, at, levels = struct.unpack_from("<I", data, 4)[0], 8, []
        for _ in range(n):
            a, b, c = struct.unpack_from("<QQQ", data, at)
            at += 24
            levels.append((np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a), np.frombuffer(data, "<u4", c, at + a + b)))
            at += a + b + 4 * c
        return cls(levels)

    def rank(self, level: int, i: int) -> int:
        """How many ids before place i of a level go on in the next."""
        chunks, bits, ranks = self.levels[level]
        if i >= len(chunks):
            return len(self.levels[level + 1][0]) if level + 1 < len(self.levels) else 0
        block = i // RANK_BITS
        first, last = block * RANK_BITS >> 3, i >> 3
        whole = int.from_bytes(bits[first : last + 1].tobytes(), "little")
        return int(ranks[block]) + (whole & ((1 << (i - block * RANK_BITS)) - 1)).bit_count()

    def part(self, a: int, b: int) -> np.ndarray:
        """The ids from place a up to b: of each level just the bytes of these, found by rank."""
        if not 0 <= a <= b <= len(self):
            raise IndexError((a, b))
        out, at, shift = np.zeros(b - a, np.uint32), np.arange(b - a), 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[at] |= chunks[a:b].astype(np.uint32) << np.uint32(shift)
            more = np.unpackbits(bits[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a].astype(bool)
            if not more.any():
                break
            a = self.rank(level, a)
            at, b, shift = at[more], a + int(more.sum()), shift + 8
        return out

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        return int(self.part(i, i + 1)[0])

    def decode(self) -> np.ndarray:
        """All ids at once, from the last level down."""
        rest = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            out = chunks.astype(np.uint32)
            more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            out[more] |= rest << np.uint32(8)
            rest = out
        return rest


# -- tokens -----------------------------------------------------------------------------------

_TOKENIZERS: dict[str, Words] = {}
#: Words that a worker's cache takes.
CACHE_WORDS = 600_000
#: Words that the tokenizer is given at once: what it returns for one takes about 2 KB until its ids are taken.
ENCODE_WORDS = 2_000
#: Bytes of texts that are encoded at once.
ENCODE_BYTES = 2 << 20
#: Words of these characters have one lower case and one normal form, whatever stands beside them.
SAFE = r"^[\x21-\x26\x28-\x7E\x{C0}-\x{12F}\x{131}-\x{17F}]+$"
#: Fixed values, the format of tokenizers: lower case, white space dropped, punctuation apart from letters.
WORD_WISE = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
#: Bytes of texts that are encoded whole at once.
WHOLE_BYTES = 1 << 20
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray, out: np.ndarray, at: np.ndarray) -> None:
    """Copies pool[start : start + size] to out[at :], for all of them at once."""
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at, size) + inside] = pool[np.repeat(start, size) + inside]


def _word_wise(tok) -> bool:
    """Whether texts may be encoded word by word, in lower case and with punctuation apart.

    So it is only where the tokenizer's own steps are known to make no difference: its normalizer and pre-tokenizer are
    those of WORD_WISE and it neither truncates nor pads.
    """
    spec = json.loads(tok.to_str())
    return all(spec[k] == WORD_WISE[k] for k in WORD_WISE)


class Words:
    """Words with their ids, as Arrow and numpy arrays: a word takes some 40 bytes. Beyond CACHE_WORDS those go that were not
    asked for again since the last time."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.apart = _word_wise(self.tok)
        self._keep(pa.array([], pa.string()), np.empty(0, np.uint32), np.empty(0, np.int64))

    def _keep(self, words: pa.Array, pool: np.ndarray, size: np.ndarray) -> None:
        self.words, self.pool, self.size = words, pool, size
        self.start, self.again = np.cumsum(size) - size, np.zeros(len(size), bool)

    def _trim(self) -> None:
        at = np.flatnonzero(self.again)[-(CACHE_WORDS // 2) :]
        size, pool = self.size[at], np.empty(int(self.size[at].sum()), np.uint32)
        _gather(self.pool, self.start[at], size, pool, np.cumsum(size) - size)
        self._keep(self.words.take(pa.array(at)), pool, size)

    def places(self, words: pa.Array) -> np.ndarray:
        """Where the distinct `words` stand in the cache; those that are new to it are encoded and added."""
        if len(self.words) > CACHE_WORDS:
            self._trim()
        found = pc.index_in(words, value_set=self.words)
        new = words.filter(found.is_null())
        known = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        self.again[known[known >= 0]] = True
        ids, sizes = [self.pool], []
        for a in range(0, len(new), ENCODE_WORDS):
            e = [x.ids for x in self.tok.encode_batch_fast(new[a : a + ENCODE_WORDS].to_pylist(), add_special_tokens=False)]
            sizes += map(len, e)
            ids.append(np.fromiter(chain.from_iterable(e), np.uint32))
        known[known < 0] = len(self.words) + np.arange(len(new))
        size, again = np.concatenate([self.size, np.array(sizes, np.int64)]), np.concatenate([self.again, np.zeros(len(new), bool)])
        self._keep(pa.concat_arrays([self.words, new]), np.concatenate(ids), size)
        self.again = again
        return known

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in one array, and how many each has. Letters with punctuation after them are two
        words to the tokenizer, so they are looked up in lower case and apart."""
        safe = pc.match_substring_regex(words, SAFE)
        low = pc.if_else(safe, pc.utf8_lower(words), words)
        core = pc.ascii_rtrim(low, PUNCTUATION)
        plain = pc.and_(safe, pc.match_substring_regex(core, r"^\p{L}+$"))
        both = pc.and_(plain, pc.less(pc.binary_length(core), pc.binary_length(low)))
        tail = pc.replace_substring_regex(low.filter(both), r"^\p{L}+", "")
        coded = pa.concat_arrays([pc.if_else(plain, core, words), tail]).cast(pa.string()).dictionary_encode()
        at = self.places(coded.dictionary)[coded.indices.to_numpy()]
        start, n = self.start[at], self.size[at]
        size = n[: len(words)].copy()
        second = np.flatnonzero(both.to_numpy(zero_copy_only=False))
        size[second] += n[len(words) :]
        out, begin = np.empty(int(size.sum()), np.uint32), np.cumsum(size) - size
        for part, where in ((slice(0, len(words)), np.arange(len(words))), (slice(len(words), None), second)):
            _gather(self.pool, start[part], n[part], out, begin[where])
            begin[where] += n[part]
        return out, size


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_texts(texts: pa.Array, path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts with an end id after each, and the number of ids of each text.

    Where the tokenizer drops white space and no token crosses it, texts are split at ASCII white space, and each
    distinct word (which may hold other white space) is encoded as it stands. With any other tokenizer each text is
    encoded whole.
    """
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Words(path)
    n = len(texts)
    if not _TOKENIZERS[path].apart:
        return _whole(texts, _TOKENIZERS[path].tok, end_id)
    words = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    coded = pc.list_flatten(words).dictionary_encode()
    pool, size = _TOKENIZERS[path].of(coded.dictionary)
    place, owner = coded.indices.to_numpy(), pc.list_parent_indices(words).to_numpy()
    sizes, start = size[place], (np.cumsum(size) - size)[place]
    per_text = np.bincount(owner, sizes, n).astype(np.int64) + 1
    out = np.full(int(per_text.sum()), end_id, np.uint32)
    _gather(pool, start, sizes, out, np.cumsum(sizes) - sizes + owner)  # one end id for each text before
    return out, per_text


def _whole(texts: pa.Array, tok, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    found = []
    for b in slices([pa.record_batch([pc.fill_null(texts, "")], names=["text"])], WHOLE_BYTES):
        found += [np.array([*e.ids, end_id], np.uint32) for e in tok.encode_batch_fast(b["text"].to_pylist(), add_special_tokens=False)]
    return np.concatenate([np.empty(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found))


SHARD = "part int, seq int, n_docs int, n_tokens long, doc_ids array<long>, lens binary, payload binary"


def write_token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = 2_000_000, part_mb: int = 64) -> DataFrame:
    """Writes the documents' ids in ascending doc_id order (null first, then by the text's hash) to the shared folder.

    Spark range-partitions the rows by doc_id and hash, so that a doc_id of very many rows takes several tasks; each
    task writes shards of about shard_tokens ids. A shard is a row of
    a Parquet table: its documents, their lengths, and the code bytes. Spark's commit keeps whole files only, so a
    lost or doubled task does no harm. Any file of the tokenizers library gives its own ids. Null texts are empty, repeated rows stay, other columns are ignored, an empty
    table gives no shard.
    """
    path = tokenizer or default_tokenizer()
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(docs.sparkSession), math.ceil(total / (part_mb << 20)))

    def pack(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        doc_ids, lens, blobs = [], [], []

        def row():
            n = np.concatenate(lens).astype("<u4")
            body = DacArray.encode(np.concatenate(blobs)).to_bytes()
            names = ["part", "seq", "n_docs", "n_tokens", "doc_ids", "lens", "payload"]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            values = [part, seq, len(n), int(n.sum()), pa.concat_arrays(doc_ids).to_pylist(), n.tobytes(), body]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        waiting = 0
        for b in slices(batches, ENCODE_BYTES):
            ids, n = encode_texts(b["text"], path, end_id)
            ends, done = np.cumsum(n), 0
            while done < len(n):
                used = ends[done - 1] if done else 0
                upto = min(len(n), int(np.searchsorted(ends, used + shard_tokens - waiting)) + 1)  # with the row that fills the shard
                doc_ids.append(b["doc_id"].slice(done, upto - done))
                lens.append(n[done:upto])
                blobs.append(ids[used : ends[upto - 1]])
                waiting, done = waiting + int(ends[upto - 1] - used), upto
                if waiting >= shard_tokens:
                    yield row()
                    seq, waiting = seq + 1, 0
                    doc_ids, lens, blobs = [], [], []
        if doc_ids:
            yield row()

    keys = F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")
    in_order = d.repartitionByRange(parts, *keys[:2]).sortWithinPartitions(*keys).select("doc_id", "text")
    return materialize(in_order.mapInArrow(pack, SHARD), "tokens")


def read_token_files(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, each read from its shard by its own place and length."""
    sizes = shards.select("part", "seq", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).withColumn("base", before(Window.orderBy("part"))).select("part", "base")
    inside = sizes.withColumn("at", before(Window.partitionBy("part").orderBy("seq"))).select("part", "seq", "at")
    starts = inside.join(per_part, "part").select("part", "seq", (F.col("at") + F.col("base")).alias("base"))
    small = sizes.limit(BROADCAST_SHARDS + 1).count() <= BROADCAST_SHARDS
    placed = shards.select("part", "seq", "doc_ids", "lens", "payload").join(F.broadcast(starts) if small else starts, ["part", "seq"])

    def read(batches):
        for whole in batches:
            for k in range(whole.num_rows):
                doc_ids, lens, payload, base = (whole[c][k].as_py() for c in ("doc_ids", "lens", "payload", "base"))
                ids = DacArray.from_bytes(payload)
                n = np.frombuffer(lens, "<u4").astype(np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids.part(e - m, e).astype("<u4").tobytes()) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ends - n + base), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents")))


def stage_tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of all rows (each row of a repeated document counts), read back as op5's columns."""
    return read_token_files(write_token_files(docs))
