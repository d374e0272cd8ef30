"""Codes against plain arrays, and files against the tokenizer on whole texts."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clipgraph_spark.llm import token_files
from clipgraph_spark.llm.token_files import DacArray, default_tokenizer, read_token_files, write_token_files


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_codes_round_trip(ids):
    a = DacArray.from_bytes(DacArray.encode(np.array(ids, np.uint32)).to_bytes())
    assert a.decode().tolist() == ids
    for i in range(0, len(ids), 37):
        assert a[i] == ids[i]
        assert a.part(i, min(len(ids), i + 700)).tolist() == ids[i : i + 700]
    with pytest.raises(IndexError):
        a[len(ids)]


def plain(rows, path=None):
    from tokenizers import Tokenizer

    tok, start, out = Tokenizer.from_file(path or default_tokenizer()), 0, []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files(spark):
    rows = [(i, r["text"]) for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect())]
    rows += [(9, None), (500, ""), (501, "a\x1cb\x85c d é <|endoftext|> it's ΣΣ x"), (501, "z"), (None, "null id"), (502, "word " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    in_order = df.fillna("", ["text"]).orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text").collect()
    got = [tuple(r) for r in read_token_files(write_token_files(df, shard_tokens=3000)).collect()]
    assert sorted(got, key=lambda r: r[1]) == plain([(r["doc_id"], r["text"]) for r in in_order])
    assert read_token_files(write_token_files(df.limit(0))).count() == 0


def test_other_tokenizers(spark):
    """A byte-level one keeps white space, case and punctuation in its tokens, so texts are encoded whole."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, r["text"]) for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect())]
    rows += [(900, None), (901, "  Two  spaces,\tTABS\n\nand Capitals ΣΣ"), (902, "word, " * 300_000), (903, "")]
    got = [tuple(r) for r in read_token_files(write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, shard_tokens=3000)).collect()]
    assert sorted(got, key=lambda r: r[1]) == plain(rows, path)


def test_cache_and_batches_are_bounded(monkeypatch):
    """A worker's cache took up to a million words of 200 bytes, and 50,000 words went to the tokenizer at once (90 MB)."""
    monkeypatch.setattr(token_files, "CACHE_WORDS", 50_000)
    path = token_files.default_tokenizer()
    words = token_files.Words(path)
    given, real = [], words.tok

    class Tok:
        def encode_batch_fast(self, part, add_special_tokens):
            given.append(len(part))
            return real.encode_batch_fast(part, add_special_tokens=add_special_tokens)

    words.tok = Tok()
    monkeypatch.setitem(token_files._TOKENIZERS, path, words)
    for i in range(30):
        texts = [" ".join(f"x{i}y{j}z{k}" for k in range(100)) for j in range(200)]
        ids, n = token_files.encode_texts(pa.array(texts), path)
        want = [[*e.ids, token_files.END_ID] for e in real.encode_batch_fast(texts[:3], add_special_tokens=False)]
        assert n[:3].tolist() == list(map(len, want)) and ids[: n[:3].sum()].tolist() == sum(want, [])
    assert max(given) <= 5_000 and len(words.words) <= 50_000 + 200 * 100 and words.pool.nbytes + words.words.nbytes < 70_000 * 100
