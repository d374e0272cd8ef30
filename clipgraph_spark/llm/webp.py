"""Lossless WebP, reading and writing: images as (height, width, 4) arrays of R, G, B, A bytes."""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
CACHE_MULTIPLIER = 0x1E35A7BD
MAX_SIDE = 16383
#: The longest back-reference.
LONGEST = 4096
# Fixed values: (x, y) of the short distance codes 1 to 120; a code stands for x + y * width pixels back.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class BadImage(ValueError):
    pass


# -- prefix codes -----------------------------------------------------------------------------


def _turned() -> list[int]:
    v, out = np.arange(1 << 16), np.zeros(1 << 16, np.int64)
    for i in range(16):
        out |= (v >> i & 1) << (15 - i)
    return out.tolist()


_TURNED = _turned()


def reversed_codes(lengths: list[int]) -> list[int]:
    """Canonical codes by length and symbol, with their bits turned round, as the stream is read from the low bit."""
    count = [0] * 17
    for n in lengths:
        count[n] += 1
    count[0] = 0
    first, code = [0] * 17, 0
    for n in range(1, 17):
        code = (code + count[n - 1]) << 1
        first[n] = code
    out = [0] * len(lengths)
    for s, n in enumerate(lengths):
        if n:
            out[s] = _TURNED[first[n]] >> (16 - n)
            first[n] += 1
    return out


class PrefixCode:
    """A table from the next `width` bits to a symbol and its code's length; one symbol alone takes no bits."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        if not used:
            raise BadImage("a prefix code without symbols")
        if len(used) == 1:
            self.width, self.symbol, self.length = 0, np.array(used), np.zeros(1, np.uint8)
        else:
            self.width = max(lengths)
            if sum(1 << (self.width - lengths[s]) for s in used) != 1 << self.width:
                raise BadImage("a prefix code that isn't complete")
            self.symbol = np.zeros(1 << self.width, np.int64)
            self.length = np.zeros(1 << self.width, np.uint8)
            codes = reversed_codes(lengths)
            for s in used:
                self.symbol[codes[s] :: 1 << lengths[s]] = s
                self.length[codes[s] :: 1 << lengths[s]] = lengths[s]
        self.most = used[-1]
        self._lists = None

    def read(self, bits: BitReader) -> int:
        if self._lists is None:
            self._lists = self.symbol.tolist(), self.length.tolist()
        v = bits.peek(self.width)
        bits.at += self._lists[1][v]
        return self._lists[0][v]


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(8), 0, 8 * len(data)

    def peek(self, n: int) -> int:
        a = self.at >> 3
        return int.from_bytes(self.data[a : a + 8], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise BadImage("the stream ends too soon")
        return v


def _read_code(bits: BitReader, size: int) -> PrefixCode:
    lengths = [0] * size
    if bits.read(1):  # one or two symbols
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        for s in symbols:
            lengths[s] = 1
        return PrefixCode(lengths)
    code = [0] * 19
    for i in range(4 + bits.read(4)):
        code[CODE_LENGTH_ORDER[i]] = bits.read(3)
    table = PrefixCode(code)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    s, last = 0, 8
    while s < size and left:
        left -= 1
        n = table.read(bits)
        if n < 16:
            lengths[s] = n
            s += 1
            last = n or last
            continue
        value, times = (last, 3 + bits.read(2)) if n == 16 else (0, 3 + bits.read(3)) if n == 17 else (0, 11 + bits.read(7))
        if s + times > size:
            raise BadImage("too many code lengths")
        lengths[s : s + times] = [value] * times
        s += times
    return PrefixCode(lengths)


# -- reading ----------------------------------------------------------------------------------


def _value(bits: BitReader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _literals(bits: BitReader, codes: list[PrefixCode], n: int) -> np.ndarray:
    """n pixels that are all literals: code lengths are looked up at every bit, then the chain of places is followed."""
    green, red, blue, alpha = codes[:4]
    left = np.frombuffer(bits.data, np.uint8)[bits.at >> 3 :].astype(np.uint32)
    word = left[:-2] | left[1:-1] << np.uint32(8) | left[2:] << np.uint32(16)
    order, tables = [c for c in (green, red, blue, alpha) if c.width], {}
    for c in order:
        if id(c) not in tables:
            lens = np.empty(8 * len(word), np.uint8)
            for r in range(8):
                lens[r::8] = c.length[(word >> np.uint32(r)) & np.uint32((1 << c.width) - 1)]
            tables[id(c)] = lens.tobytes()
    p = bits.at & 7
    places = []
    try:
        if len(order) == 1:
            lens = tables[id(order[0])]
            places = [p, *[p := p + lens[p] for _ in range(n)]]
            places.pop()
        else:
            walk = [tables[id(c)] for c in order]
            for _ in range(n):
                for lens in walk:
                    places.append(p)
                    p += lens[p]
    except IndexError as e:
        raise BadImage("the stream ends too soon") from e
    bits.at = (bits.at & ~7) + p
    if bits.at > bits.end:
        raise BadImage("the stream ends too soon")
    at = np.array(places, np.int64).reshape(n, len(order)) if order else np.zeros((n, 0), np.int64)
    out, k = np.empty((n, 4), np.uint8), 0
    for channel, c in ((1, green), (0, red), (2, blue), (3, alpha)):
        if c.width:
            p = at[:, k]
            out[:, channel] = c.symbol[(word[p >> 3] >> (p & 7).astype(np.uint32)) & np.uint32((1 << c.width) - 1)]
            k += 1
        else:
            out[:, channel] = c.symbol[0]
    return out


def _back(code: int, width: int) -> int:
    """How many pixels back a distance code points."""
    return code - 120 if code > 120 else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)


def _green_runs(bits: BitReader, codes: list[PrefixCode], n: int, width: int) -> np.ndarray:
    """n pixels of which only green varies, literals and back-references: the chain of literals' places is followed up
    to the next reference, literals are then looked up all at once, and references copied in order."""
    green, far = codes[0], codes[4]
    base = bits.at & ~7
    left = np.frombuffer(bits.data, np.uint8)[bits.at >> 3 :].astype(np.uint32)
    word = left[:-2] | left[1:-1] << np.uint32(8) | left[2:] << np.uint32(16)
    step = np.where(green.symbol < 256, green.length, 0).astype(np.uint8)  # 0: no literal, the chain stops
    lens, mask = np.empty(8 * len(word), np.uint8), np.uint32((1 << green.width) - 1)
    for r in range(8):
        lens[r::8] = step[(word >> np.uint32(r)) & mask]
    lens, p, i = lens.tobytes(), bits.at & 7, 0
    places, literals, copies = [], [], []
    while i < n:
        try:
            chain = [p, *[p := p + lens[p] for _ in range(min(512, n - i))]]
        except IndexError as e:
            raise BadImage("the stream ends too soon") from e
        stopped = i + len(chain) - 1 < n and not lens[p] or chain[-1] == chain[-2]
        k = chain.index(p) if stopped else len(chain) - 1
        places += chain[:k]
        literals.append((i, k))
        i += k
        if stopped and i < n:
            bits.at = base + p
            length = _value(bits, green.read(bits) - 256)
            back = _back(_value(bits, far.read(bits)), width)
            if back > i or i + length > n:
                raise BadImage("a back-reference out of the image")
            copies.append((i, length, back))
            i, p = i + length, bits.at - base
    bits.at = base + p
    if bits.at > bits.end:
        raise BadImage("the stream ends too soon")
    at = np.array(places, np.int64)
    values = green.symbol[(word[at >> 3] >> (at & 7).astype(np.uint32)) & mask]
    out, done = np.empty(n, np.uint8), 0
    for start, k in literals:
        out[start : start + k] = values[done : done + k]
        done += k
    for start, length, back in copies:
        out[start : start + length] = out[start - back : start - back + length] if back >= length else np.resize(out[start - back : start], length)
    red, blue, alpha = (int(c.symbol[0]) for c in codes[1:4])
    return np.stack([np.full(n, red, np.uint8), out, np.full(n, blue, np.uint8), np.full(n, alpha, np.uint8)], axis=-1)


def _pack(rgba: np.ndarray) -> np.ndarray:
    x = rgba.astype(np.uint32)
    return x[..., 3] << np.uint32(24) | x[..., 0] << np.uint32(16) | x[..., 1] << np.uint32(8) | x[..., 2]


def _unpack(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> np.uint32(16), argb >> np.uint32(8), argb, argb >> np.uint32(24)], axis=-1).astype(np.uint8)


def _read_image(bits: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded pixels as (height, width, 4) bytes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise BadImage("a colour cache of more than 11 bits")
    groups, which, tile = 1, None, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        meta = _read_image(bits, -(-width >> tile), -(-height >> tile), False)
        which = meta[..., 0].astype(np.int64) << 8 | meta[..., 1]
        groups = int(which.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    n = width * height
    if groups == 1 and codes[0][0].most < 256:
        return _literals(bits, codes[0], n).reshape(height, width, 4)
    if groups == 1 and not cache_bits and codes[0][0].width and not any(c.width for c in codes[0][1:4]):
        return _green_runs(bits, codes[0], n, width).reshape(height, width, 4)
    out, cache = [0] * n, [0] * (1 << cache_bits)
    shift, i = 32 - cache_bits, 0
    tiles = which.tolist() if which is not None else None
    while i < n:
        green, red, blue, alpha, far = codes[tiles[i // width >> tile][i % width >> tile]] if tiles else codes[0]
        s = green.read(bits)
        if bits.at > bits.end:
            raise BadImage("the stream ends too soon")
        start = i
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out[i] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            i += 1
        elif s < 280:
            length = _value(bits, s - 256)
            code = _value(bits, far.read(bits))
            back = _back(code, width)
            if back > i or i + length > n:
                raise BadImage("a back-reference out of the image")
            for _ in range(length):
                out[i] = out[i - back]
                i += 1
        else:
            out[i] = cache[s - 280]
            i += 1
        if cache_bits:
            for v in out[start:i]:
                cache[(CACHE_MULTIPLIER * v & 0xFFFFFFFF) >> shift] = v
    return _unpack(np.array(out, np.uint32)).reshape(height, width, 4)


def _average(a, b):
    return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def predicted(mode: int, left, top, top_left, top_right) -> list[int]:
    """The format's 14 predictors, on channel lists."""
    if mode == 0:
        return [0, 0, 0, 255]
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode in (6, 7, 8, 9):
        return _average(*{6: (left, top_left), 7: (left, top), 8: (top_left, top), 9: (top, top_right)}[mode])
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [_clamp(x + t - c) for x, t, c in zip(left, top, top_left, strict=True)]
    if mode == 13:
        mean = _average(left, top)
        return [_clamp(m + int((m - c) / 2)) for m, c in zip(mean, top_left, strict=True)]
    return [0, 0, 0, 255]


def _neighbours(px, x: int, y: int, width: int):
    right = px[y - 1][x + 1] if x + 1 < width else px[y][0]
    return px[y][x - 1], px[y - 1][x], px[y - 1][x - 1], right


def _predict(px: list, x: int, y: int, width: int, modes: np.ndarray, tile: int) -> list[int]:
    if y == 0:
        return px[0][x - 1] if x else [0, 0, 0, 255]
    if x == 0:
        return px[y - 1][0]
    return predicted(int(modes[y >> tile, x >> tile]), *_neighbours(px, x, y, width))


def _undo_predictor(img: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    height, width = img.shape[:2]
    used = np.unique(modes)
    if len(used) == 1 and used[0] == 2:  # each row from the one above
        first = np.cumsum(img[:1].astype(np.uint64) + np.eye(1, width, dtype=np.uint64)[..., None] * np.array([0, 0, 0, 255], np.uint64), axis=1)
        return np.cumsum(np.concatenate([first, img[1:].astype(np.uint64)]), axis=0).astype(np.uint8)
    px = img.tolist()
    for y in range(height):
        for x in range(width):
            p = _predict(px, x, y, width, modes, tile)
            px[y][x] = [(a + b) & 255 for a, b in zip(px[y][x], p, strict=True)]
    return np.array(px, np.uint8)


def _delta(factor: np.ndarray, colour: np.ndarray) -> np.ndarray:
    return (factor.astype(np.int8).astype(np.int32) * colour.astype(np.int8).astype(np.int32)) >> 5


def _cross(img: np.ndarray, tiles: np.ndarray, tile: int, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes off (-1) what green and red say about red and blue."""
    h, w = img.shape[:2]
    t = tiles[np.arange(h)[:, None] >> tile, np.arange(w)[None] >> tile]
    green_red, green_blue, red_blue = t[..., 2], t[..., 1], t[..., 0]
    out = img.copy()
    red = img[..., 0].astype(np.int32) + sign * _delta(green_red, img[..., 1])
    out[..., 0] = red & 255
    true_red = out[..., 0] if sign > 0 else img[..., 0]
    blue = img[..., 2].astype(np.int32) + sign * (_delta(green_blue, img[..., 1]) + _delta(red_blue, true_red))
    out[..., 2] = blue & 255
    return out


def _read_stream(data: bytes) -> np.ndarray:
    bits = BitReader(data)
    if bits.read(8) != 0x2F:
        raise BadImage("no lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise BadImage("an unknown version")
    steps, seen, real_width = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise BadImage("a transform that comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOR):
            tile = bits.read(3) + 2
            steps.append((kind, _read_image(bits, -(-width >> tile), -(-height >> tile), False), tile, width))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = np.cumsum(_read_image(bits, n, 1, False)[0].astype(np.uint64), axis=0).astype(np.uint8)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, table, pack, width))
            width = -(-width >> pack)
        else:
            steps.append((kind, None, 0, width))
    img = _read_image(bits, width, height, True)
    for kind, extra, size, at_width in reversed(steps):
        if kind == PREDICTOR:
            img = _undo_predictor(img, extra[..., 1] & 15, size)
        elif kind == CROSS_COLOR:
            img = _cross(img, extra, size, 1)
        elif kind == SUBTRACT_GREEN:
            img = img.copy()
            img[..., 0] += img[..., 1]
            img[..., 2] += img[..., 1]
        else:
            per = 1 << size
            index = img[..., 1]
            if per > 1:
                depth = 8 // per
                index = ((index[..., None] >> (np.arange(per) * depth).astype(np.uint8)) & ((1 << depth) - 1)).reshape(height, -1)[:, :at_width]
            table = np.zeros((256, 4), np.uint8)
            table[: len(extra)] = extra
            img = table[index]
    assert img.shape == (height, real_width, 4)
    return img


def decode(data: bytes) -> np.ndarray:
    """The (height, width, 4) pixels of a WebP file with a lossless image."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise BadImage("no WebP file")
    at, end = 12, 8 + struct.unpack_from("<I", data, 4)[0]
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"VP8L":
            return _read_stream(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise BadImage("no lossless image")


def split(data: bytes) -> list[bytes]:
    """The files of a sequence of WebP files."""
    out, at = [], 0
    while at < len(data):
        n = 8 + struct.unpack_from("<I", data, at + 4)[0]
        out.append(data[at : at + n])
        at += n
    return out


# -- writing ----------------------------------------------------------------------------------


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.n // 8), "little")


def code_lengths(counts: list[int], most: int = 15) -> list[int]:
    """Lengths of a Huffman code of at most `most` bits; rare symbols are taken as less rare until it fits."""
    used = [s for s, n in enumerate(counts) if n]
    lengths = [0] * len(counts)
    if len(used) < 2:
        for s in used:
            lengths[s] = 1
        return lengths
    weights = [counts[s] for s in used]
    while True:
        order = sorted(range(len(used)), key=weights.__getitem__)
        k = len(order)
        w = [weights[i] for i in order] + [0] * (k - 1)
        parent = [0] * (2 * k - 1)
        leaf, inner = 0, k
        for made in range(k, 2 * k - 1):
            for _ in range(2):
                if leaf < k and (inner >= made or w[leaf] <= w[inner]):
                    pick, leaf = leaf, leaf + 1
                else:
                    pick, inner = inner, inner + 1
                parent[pick] = made
                w[made] += w[pick]
        depth = [0] * (2 * k - 1)
        for i in range(2 * k - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[:k]) <= most:
            for i, o in enumerate(order):
                lengths[used[o]] = depth[i]
            return lengths
        floor = max(1, min(weights)) * 2
        weights = [max(x, floor) for x in weights]


#: Code lengths of the code-length code: 13 symbols of 4 bits and 6 of 5 fill it.
_META_LENGTHS = [4] * 10 + [5] * 6 + [4] * 3
_META_CODES = reversed_codes(_META_LENGTHS)


def _write_code(out: BitWriter, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 1 and (not used or used[0] < 256):
        s = used[0] if used else 0
        out.put(1 | (s > 1) << 2, 3)
        out.put(s, 8 if s > 1 else 1)
        return
    out.put(0, 1)
    out.put(15, 4)
    for i in CODE_LENGTH_ORDER:
        out.put(_META_LENGTHS[i], 3)
    out.put(0, 1)
    value, n, s = 0, 0, 0
    while s < len(lengths):
        x, k = lengths[s], 1
        if not x:
            while k < 138 and s + k < len(lengths) and not lengths[s + k]:
                k += 1
        if k < 3:
            k = 1
            value |= _META_CODES[x] << n
            n += _META_LENGTHS[x]
        elif k < 11:
            value |= (_META_CODES[17] | (k - 3) << _META_LENGTHS[17]) << n
            n += _META_LENGTHS[17] + 3
        else:
            value |= (_META_CODES[18] | (k - 11) << _META_LENGTHS[18]) << n
            n += _META_LENGTHS[18] + 7
        s += k
    out.put(value, n)


#: Repeated strings of grey samples from this length on are written as back-references.
MATCH = 24
#: An image has fewer samples.
_PLACE = np.uint64((1 << 28) - 1)


def _file(stream: bytes) -> bytes:
    pad = len(stream) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + pad) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + bytes(pad)


def _header(out: BitWriter, width: int, height: int) -> None:
    if not (1 <= width <= MAX_SIDE and 1 <= height <= MAX_SIDE):
        raise ValueError("a side is 1 to 16383 pixels")
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 4)


def repeats(flat: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, back) of strings of MATCH bytes or more that stand `back` bytes before as well, from the left
    and without overlap: each place's latest earlier place with the same MATCH bytes, in runs of one distance."""
    n = len(flat) - MATCH + 1
    if n < 2:
        return []
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, 8)).view("<u8").reshape(-1)
    key = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(8, MATCH, 8):
        key = (key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + eight[i : i + n]
    # one sort of hash and place together: equal hashes come by place
    both = np.sort((key ^ key >> np.uint64(29)) & ~_PLACE | np.arange(n, dtype=np.uint64))
    same = np.flatnonzero((both[1:] ^ both[:-1]) <= _PLACE)
    if not len(same):
        return []
    at, before = (both[same + 1] & _PLACE).astype(np.int64), (both[same] & _PLACE).astype(np.int64)
    by = np.argsort(at)
    at, back = at[by], at[by] - before[by]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (back[1:] != back[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at))) + MATCH - 1
    out, done = [], 0
    for s, k, d in zip(at[first].tolist(), size.tolist(), back[first].tolist(), strict=True):
        k, s = k - max(0, done - s), max(s, done)
        if k >= MATCH and (flat[s : s + k] == flat[s - d : s - d + k]).all():
            out += [(s + a, min(LONGEST, k - a), d) for a in range(0, k, LONGEST) if k - a >= MATCH]
            done = s + k - (k % LONGEST if k % LONGEST < MATCH else 0)
    return out


def _items(flat: np.ndarray, found: list[tuple[int, int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The stream's symbols in order: literals of the green code, and for each reference a length of the green code
    and a distance (SIZES apart), with the extra bits of both; as symbols, and as extra value and number of bits."""
    keep = np.ones(len(flat), bool)
    rows = []
    for s, k, d in found:
        keep[s : s + k] = False
        (a, e, m), (b, f, o) = _prefix(k), _prefix(1 if d == width else 2 if d == 1 else d + 120)
        rows.append(((256 + a, e, m), (280 + b, f, o)))
    at = np.flatnonzero(keep)
    where = np.repeat(np.searchsorted(at, [s for s, _, _ in found]), 2)
    added = np.array(rows, np.int64).reshape(-1, 3)
    all_ = np.insert(flat[at].astype(np.int64), where, added[:, 0] | added[:, 1] << 16 | added[:, 2] << 48)
    return all_ & 0xFFFF, np.stack([all_ >> 16 & 0xFFFFFFFF, all_ >> 48], axis=1)


def encode_grey(samples: np.ndarray) -> bytes:
    """A grey (height, width) image: green holds the samples, red and blue follow by the subtract-green transform, and
    strings of MATCH samples or more that came before are back-references."""
    height, width = samples.shape
    out = BitWriter()
    _header(out, width, height)
    out.put(1 | SUBTRACT_GREEN << 1, 3)
    out.put(0, 3)  # no more transforms, no colour cache, one group of codes
    flat = samples.reshape(-1)
    one = bool((flat == flat[0]).all())
    symbols, extra = _items(flat, [] if one else repeats(flat), width)
    counts = np.bincount(symbols, minlength=320)
    lengths, far = code_lengths(counts[:280].tolist(), 11), code_lengths(counts[280:].tolist(), 11)
    _write_code(out, lengths)
    for s in (0, 0, 255):
        _write_code(out, [0] * s + [1])
    _write_code(out, far if any(far) else [1])
    head = out.bytes()
    if one:
        return _file(head)
    if sum(map(bool, far)) == 1:
        far_bits = [0] * 40
    else:
        far_bits = far
    codes, size = np.array(reversed_codes(lengths) + reversed_codes(far), np.int64), np.array(lengths + far_bits, np.int64)
    codes[280:][np.array(far_bits) == 0] = 0
    # a symbol's code and its extra bits stand together: 11 + 14 bits at most
    value = codes[symbols] | extra[:, 0] << size[symbols]
    n = size[symbols] + extra[:, 1]
    at = np.cumsum(n) - n + out.n % 8
    total = int(at[-1] + n[-1])
    shifted = value.astype(np.uint64) << (at & 15).astype(np.uint64)
    # in units of 16 bits: the bits of different symbols do not meet, so sums hold all of them
    sums = np.bincount(at >> 4, shifted.astype(np.float64), (total >> 4) + 5).astype(np.uint64)
    words = sums & np.uint64(0xFFFF)
    words[1:] |= sums[:-1] >> np.uint64(16) & np.uint64(0xFFFF)
    words[2:] |= sums[:-2] >> np.uint64(32)
    body = bytearray(words.astype("<u2").tobytes()[: -(-total // 8)])
    if out.n % 8:
        body[0] |= head[-1]
        head = head[:-1]
    return _file(head + bytes(body))


def _prefix(value: int) -> tuple[int, int, int]:
    """A length or distance as prefix symbol, extra bits and their number."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


def _write_image(out: BitWriter, img: np.ndarray, main: bool, cache_bits: int = 0, references: bool = True, tile: int = 0) -> None:
    height, width = img.shape[:2]
    px = _pack(img).reshape(-1).tolist()
    out.put(1 | cache_bits << 1, 5) if cache_bits else out.put(0, 1)
    which = [[0]]
    if main:
        out.put(1 if tile else 0, 1)
        if tile:
            out.put(tile - 2, 3)
            rows, cols = -(-height >> tile), -(-width >> tile)
            which = [[(x + y) % 2 for x in range(cols)] for y in range(rows)]
            meta = np.zeros((rows, cols, 4), np.uint8)
            meta[..., 1] = which
            _write_image(out, meta, False)
    cache, shift, tokens, i = [0] * (1 << cache_bits), 32 - cache_bits, [], 0
    while i < len(px):
        group = which[i // width >> tile][i % width >> tile] if tile else 0
        best = (0, 0)
        if references:
            for back, code in ((1, 2), (width, 1), (7, 127)):
                k = 0
                while i >= back and i + k < len(px) and k < 4096 and px[i + k] == px[i + k - back]:
                    k += 1
                if back == 1 and width == 1:
                    code = 1
                best = max(best, (k, code))
        start = i
        slot = (CACHE_MULTIPLIER * px[i] & 0xFFFFFFFF) >> shift if cache_bits else 0
        if best[0] >= 3:
            (s, e, n), (d, f, m) = _prefix(best[0]), _prefix(best[1])
            tokens.append((group, [(0, 256 + s, e, n), (4, d, f, m)]))
            i += best[0]
        elif cache_bits and cache[slot] == px[i]:
            tokens.append((group, [(0, 280 + slot, 0, 0)]))
            i += 1
        else:
            v = px[i]
            tokens.append((group, [(0, v >> 8 & 255, 0, 0), (1, v >> 16 & 255, 0, 0), (2, v & 255, 0, 0), (3, v >> 24, 0, 0)]))
            i += 1
        if cache_bits:
            for v in px[start:i]:
                cache[(CACHE_MULTIPLIER * v & 0xFFFFFFFF) >> shift] = v
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = 1 + max(max(r) for r in which)
    counts = [[[0] * n for n in sizes] for _ in range(groups)]
    for g, parts in tokens:
        for a, s, _, _ in parts:
            counts[g][a][s] += 1
    lengths = [[code_lengths(c) for c in g] for g in counts]
    for g in lengths:
        for n in g:
            _write_code(out, n)
    codes = [[reversed_codes(n) for n in g] for g in lengths]
    for g, parts in tokens:
        for a, s, extra, n in parts:
            if sum(1 for x in lengths[g][a] if x) > 1:
                out.put(codes[g][a][s], lengths[g][a][s])
            out.put(extra, n)


def encode(img: np.ndarray, predictor: np.ndarray | int | None = None, cross: np.ndarray | None = None, subtract_green: bool = False, palette: bool = False, tile: int = 2, cache_bits: int = 0, references: bool = True, group_tile: int = 0) -> bytes:
    """A WebP file of (height, width, 4) pixels, with the transforms asked for: written for small images.

    predictor: a mode, or a mode for each tile; cross: for each tile red-to-blue, green-to-blue and green-to-red.
    """
    height, width = img.shape[:2]
    out = BitWriter()
    _header(out, width, height)
    shape = (-(-height >> tile), -(-width >> tile))
    if palette:
        colours, index = np.unique(_pack(img).reshape(-1), return_inverse=True)
        if len(colours) > 256:
            raise ValueError("a palette has 256 colours at most")
        out.put(1 | PALETTE << 1, 3)
        out.put(len(colours) - 1, 8)
        table = _unpack(colours)
        _write_image(out, np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8))[None], False)
        pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        per, index = 1 << pack, index.reshape(height, width)
        index = np.pad(index, ((0, 0), (0, -width % per))).reshape(height, -1, per)
        img = np.zeros((height, index.shape[1], 4), np.uint8)
        img[..., 1] = (index << (np.arange(per) * (8 // per))).sum(axis=2)
        img[..., 3] = 255
    if subtract_green:
        out.put(1 | SUBTRACT_GREEN << 1, 3)
        img = img.copy()
        img[..., 0] -= img[..., 1]
        img[..., 2] -= img[..., 1]
    if cross is not None:
        tiles = np.zeros((*shape, 4), np.uint8)
        tiles[..., :3] = cross
        tiles[..., 3] = 255
        out.put(1 | CROSS_COLOR << 1 | (tile - 2) << 3, 6)
        _write_image(out, tiles, False)
        img = _cross(img, tiles, tile, -1)
    if predictor is not None:
        modes = np.zeros((*shape, 4), np.uint8)
        modes[..., 1] = predictor
        modes[..., 3] = 255
        out.put(1 | PREDICTOR << 1 | (tile - 2) << 3, 6)
        _write_image(out, modes, False)
        px, w = img.tolist(), img.shape[1]
        guess = [[_predict(px, x, y, w, modes[..., 1], tile) for x in range(w)] for y in range(len(px))]
        img = img - np.array(guess, np.uint8)
    out.put(0, 1)
    _write_image(out, img, True, cache_bits, references, group_tile)
    return _file(out.bytes())
