"""Helpers that several operators share: the shared work folder and block-wise key exchange."""

from __future__ import annotations

import math
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Rows of texts or sets reach Python in Arrow batches of BATCH_ROWS, unless the session sets a number of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default, for narrow rows
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir); a temporary one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="clipgraph-"))
    return _OWN_DIR[0]


#: Removes the shuffle files of a query when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` once to the shared folder and reads it back: cuts lineage and survives lost executors. The write's
    shuffle files go when it ends."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/clipgraph/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col):
    """Lower-cases A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(col, upper, upper.lower())


def let(value, use):
    """use(value), with the column value worked out once."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of `df` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


# -- blocks of documents and keyed exchange ---------------------------------------------------


def with_blocks(docs: DataFrame, block_mb: int = 16, part_mb: int = 8) -> tuple[DataFrame, int]:
    """(block, doc_id, text) with null texts empty, and the number of parts among which keys are dealt.

    A block is a hash class of rows, about `block_mb` MB of text. All stages that group by block share one
    exchange of the text. Parts follow from the size of the text alone, so that a part's keys stay about as many.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(2 * shuffle_partitions(docs.sparkSession), math.ceil(total / (block_mb << 20)))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    return d.select(block.alias("block"), "doc_id", "text"), max(1, math.ceil(total / (part_mb << 20)))


def block_table(t: pa.Table) -> pa.Table:
    """The rows of a block in an order that every stage gets alike."""
    return t.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])


REQUEST = "block int, part int, kind int, keys binary, counts binary"
REPLY = "block int, part int, kind int, totals binary, first binary, n_total long, n_keys long"
REQUEST_ARROW = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
REPLY_ARROW = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("totals", pa.binary()), ("first", pa.binary()), ("n_total", pa.int64()), ("n_keys", pa.int64())])
#: Bytes of a difference of sorted keys that are as good as random, so that they are not worth compressing.
RAW = 5


def _planes(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def pack_counts(x: np.ndarray) -> bytes:
    """Counts as their bytes by significance, compressed: mostly small ones take less than a byte each."""
    return zlib.compress(_planes(x).tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences: the low bytes as they are, the high ones compressed."""
    p = _planes(np.diff(keys, prepend=np.uint64(0)))
    return p[:RAW].tobytes() + zlib.compress(p[RAW:].tobytes(), 1)


def unpack_keys(data: bytes, n: int) -> np.ndarray:
    planes = data[: RAW * n] + zlib.decompress(data[RAW * n :])
    return np.cumsum(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<u8").reshape(-1), dtype=np.uint64)


def request_rows(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> list[dict]:
    """Rows that carry a block's sorted distinct 64-bit keys to the tasks that own them.

    The part is taken from the key's high bits, so each row holds one run of the sorted keys. There are no more rows
    than keys, and so no more than tokens, however many blocks and parts there are.
    """
    if not len(keys):
        return []
    bounds = (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(np.uint64) if parts > 1 else np.empty(0, np.uint64)
    cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
    return [
        {"block": block, "part": p, "kind": kind, "keys": pack_keys(keys[a:b]), "counts": pack_counts(counts[a:b])}
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
        if b > a
    ]


def rows_table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def _answer(group: pa.Table) -> pa.Table:
    rows = group.to_pylist()
    each = [unpack_counts(r["counts"]).astype(np.int64) for r in rows]
    sizes = [len(c) for c in each]
    keys = np.concatenate([unpack_keys(r["keys"], n) for r, n in zip(rows, sizes, strict=True)])
    counts = np.concatenate(each)
    blocks = np.repeat(np.array([r["block"] for r in rows], np.int64), sizes)
    order = np.lexsort((blocks, keys))
    ks = keys[order]
    new = np.ones(len(ks), bool)
    new[1:] = ks[1:] != ks[:-1]
    group_id = np.cumsum(new) - 1
    totals = np.zeros(len(ks), np.int64)
    totals[order] = np.add.reduceat(counts[order], np.flatnonzero(new))[group_id]
    first = np.zeros(len(ks), np.uint8)
    first[order] = new
    out, at = [], 0
    for r, n in zip(rows, sizes, strict=True):
        own, lead = totals[at : at + n], first[at : at + n].astype(bool)
        sums = {"n_total": int(own[lead].sum()), "n_keys": int((own[lead] > 0).sum())}
        out.append({"block": r["block"], "part": r["part"], "kind": r["kind"], "totals": pack_counts(own), "first": np.packbits(lead).tobytes()} | sums)
        at += n
    return rows_table(out, REPLY_ARROW)


def answers(requests: DataFrame) -> DataFrame:
    """For each request row, its keys' totals over all blocks, and whether the block is the first that has the key.

    n_total and n_keys are the sums over the keys that the row is first for, so they can be summed over all rows.
    A block sends a key once, whatever its count, so a key that a third of all rows hold makes one entry per block.
    """
    return requests.groupBy("kind", "part").applyInArrow(lambda t: _answer(t), REPLY)


def reply_arrays(rows: list[dict], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's replies of one kind, aligned with its sorted keys: totals, and first flags."""
    own = sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["part"])
    totals = [unpack_counts(r["totals"]) for r in own]
    first = [np.unpackbits(np.frombuffer(r["first"], np.uint8), count=len(t)) for r, t in zip(own, totals, strict=True)]
    if not own:
        return np.empty(0, np.uint64), np.empty(0, np.uint8)
    return np.concatenate(totals), np.concatenate(first)


def arrow_batches(table: pa.Table, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    yield from table.to_batches(max_chunksize=rows)


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches):
        for b in batches:
            yield fn(b)

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], size: int = 8 << 20, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut where their texts reach about `size` bytes, so that what a task holds does not follow the rows' length."""
    for b in batches:
        ends, done = np.cumsum(pc.fill_null(pc.binary_length(b[name]), 0).to_numpy()), 0
        while done < b.num_rows:
            used = int(ends[done - 1]) if done else 0
            upto = max(done + 1, int(np.searchsorted(ends, used + size, "right")))
            yield b.slice(done, upto - done)
            done = upto


def texts_of(batch: pa.RecordBatch | pa.Table, name: str = "text") -> list[str]:
    col = batch[name]
    return pc.fill_null(col, "").to_pylist()
