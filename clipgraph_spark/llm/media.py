"""Media columns: payloads stored as lossless WebP and read back as pixel arrays."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import webp
from .common import materialize, slices, table, texts_of

WIDTH = 576
FILL = 255
#: Rows of one image at most.
ROWS = webp.MAX_SIDE


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The text's byte count, and its bytes filled up with 255 to a positive multiple of WIDTH."""
    raw = (text or "").encode()
    return len(raw), raw + bytes([FILL]) * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def store(payload: bytes) -> bytes:
    """The payload as grey samples, WIDTH a row; images follow one another where one has too few rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return b"".join(webp.encode_grey(rows[a : a + ROWS]) for a in range(0, len(rows), ROWS))


def load(media: bytes) -> np.ndarray:
    """The (rows, WIDTH) samples of stored media, from its decoded pixels."""
    return np.concatenate([webp.decode(x)[..., 1] for x in webp.split(media)])


def feature_of(samples: np.ndarray) -> str:
    """A difference hash of 8 x 9 blocks of the samples' sums, and the shares of 16 brightness classes in 255ths, as hex."""
    flat = samples.reshape(-1)
    sums = np.add.reduceat(flat, np.arange(72) * len(flat) // 72, dtype=np.int64).reshape(8, 9)
    size = np.diff(np.append(np.arange(72) * len(flat) // 72, len(flat))).reshape(8, 9)
    mean = sums * 1000 // size
    bits = np.packbits((mean[:, 1:] > mean[:, :-1]).reshape(-1)).tobytes().hex()
    shares = np.bincount(flat >> 4, minlength=16) * 255 // len(flat)
    return f"{bits}:{shares.astype(np.uint8).tobytes().hex()}"


STORED = "doc_id long, n_bytes long, media binary"
COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media of every row.

    Null texts are empty; repeated rows repeat; equal texts give equal media; a very long text is a sequence of images
    of ROWS rows; an empty table gives an empty result; other columns, whatever their names, are not read.
    """

    def run(batches):
        for b in slices(batches, 2 << 20):
            both = [payload_of(t) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([n for n, _ in both], pa.int64()), pa.array([store(p) for _, p in both], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, STORED)


def read_media(stored: DataFrame) -> DataFrame:
    """The digests and features of stored media, from its decoded pixels."""

    def run(batches):
        for whole in batches:
            out = {c.split()[0]: [] for c in COLUMNS.split(", ")}
            for doc_id, n, media in zip(*(whole[c].to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                samples = load(media)
                data = samples.tobytes()
                for c, v in zip(out, (doc_id, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(samples)), strict=True):
                    out[c].append(v)
            kinds = [pa.string() if c.endswith("string") else pa.int64() for c in COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, COLUMNS)


def op2_media_columns(spark, sf_dir: str) -> DataFrame:
    return read_media(materialize(store_texts(table(spark, sf_dir, "documents")), "media"))
