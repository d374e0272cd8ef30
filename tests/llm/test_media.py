"""Round trips of every part of the format, and media columns against plain payloads."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clipgraph_spark.llm import media, webp


def image(seed, h, w, colours=None):
    rng = np.random.default_rng(seed)
    if colours:
        return rng.integers(0, 256, (colours, 4), dtype=np.uint8)[rng.integers(0, colours, (h, w))]
    smooth = np.cumsum(rng.integers(-3, 4, (h, w, 4)), axis=1) + 100
    smooth[h // 2 :] = smooth[: h - h // 2]
    return smooth.astype(np.uint8)


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    img = image(mode, 11, 13)
    assert (webp.decode(webp.encode(img, predictor=mode)) == img).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palettes(colours):
    img = image(colours, 14, 19, colours)
    for cache in (0, 3):
        assert (webp.decode(webp.encode(img, palette=True, cache_bits=cache)) == img).all()


@pytest.mark.parametrize("options", [
    {}, {"cache_bits": 1}, {"cache_bits": 11}, {"subtract_green": True}, {"references": False}, {"group_tile": 2}, {"group_tile": 3, "cache_bits": 4},
    {"subtract_green": True, "predictor": 11, "cross": (13, 200, 77), "cache_bits": 6, "group_tile": 2},
])
def test_parts_of_the_format(options):
    for img in (image(1, 20, 17), image(2, 9, 30, 5), image(3, 1, 1), image(4, 40, 1, 2), image(5, 1, 50)):
        data = webp.encode(img, **options)
        assert (webp.decode(data) == img).all()
        with pytest.raises(webp.BadImage):
            webp.decode(data[: len(data) // 2] if len(data) > 60 else data[:10])


def test_tiles_of_modes_and_factors():
    img, rng = image(9, 13, 22), np.random.default_rng(0)
    modes, cross = rng.integers(0, 14, (4, 6)), rng.integers(0, 256, (4, 6, 3))
    assert (webp.decode(webp.encode(img, predictor=modes, cross=cross)) == img).all()


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=700), st.integers(1, 40))
def test_grey(data, width):
    data += bytes(-len(data) % width)
    x = np.frombuffer(data, np.uint8).reshape(-1, width)
    got = webp.decode(webp.encode_grey(x))
    assert all((got[..., c] == x).all() for c in range(3)) and (got[..., 3] == 255).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=1, max_size=60), st.integers(1, 120)), min_size=1, max_size=6), st.sampled_from([7, 24, 576]))
def test_references(parts, width):
    data = b"".join(p * n for p, n in parts) * 2
    data += b"\xff" * (-len(data) % width)
    x = np.frombuffer(data, np.uint8)
    found, done = webp.repeats(x), 0
    for s, k, d in found:
        assert s >= done and webp.MATCH <= k <= webp.LONGEST and (x[s : s + k] == x[s - d : s - d + k]).all()
        done = s + k
    stored = webp.encode_grey(x.reshape(-1, width))
    assert (webp.decode(stored)[..., 1].reshape(-1) == x).all()
    if found:
        assert len(stored) < len(data) + 400


def test_references_are_read_back():
    """Text with repeats takes back-references, which make the file shorter, and the general reader agrees."""
    rng = np.random.default_rng(3)
    text = rng.integers(97, 123, 3000, dtype=np.uint8)
    x = np.concatenate([text, text[500:1400], np.full(6 * 576 - 3900 % 576 - 2304, 255, np.uint8), text[:1200]])
    x = np.concatenate([x, np.full(-len(x) % 576, 255, np.uint8)]).reshape(-1, 576)
    assert len(webp.repeats(x.reshape(-1))) >= 3
    stored = webp.encode_grey(x)
    got = webp.decode(stored)
    assert all((got[..., c] == x).all() for c in range(3)) and len(stored) < 2700
    plain = np.repeat(x[..., None], 4, axis=2)
    plain[..., 3] = 255
    assert (webp.decode(webp.encode(plain, subtract_green=True)) == got).all()
    for cut in (60, len(stored) // 2):
        with pytest.raises(webp.BadImage):
            webp.decode(stored[:cut])


def test_long_codes():
    counts = [int(1.7**i) + 1 for i in range(40)]
    for most in (11, 15):
        n = webp.code_lengths(counts, most)
        assert max(n) <= most and sum(2.0**-x for x in n) == 1


def test_columns(spark):
    texts = [None, "", "x", "é" * 288, "a" * 577, "The end. " * 9000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    got = {r["doc_id"]: r for r in media.read_media(media.store_texts(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r["media_bytes"] < len(p) + 600
    assert got[0]["media_sha256"] == got[1]["media_sha256"] and got[0]["feature"] == got[1]["feature"]
    assert media.read_media(media.store_texts(df.limit(0))).count() == 0


def test_many_rows(monkeypatch):
    monkeypatch.setattr(media, "ROWS", 3)
    p = np.random.default_rng(0).integers(0, 256, 576 * 10, dtype=np.uint8).tobytes()
    assert media.load(media.store(p)).tobytes() == p
