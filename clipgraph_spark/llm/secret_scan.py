"""Secret scan: fixed patterns, and sliding-window Shannon entropy of candidate strings, in DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, let, table

# Fixed values of the contract: kind, pattern, the group whose length counts, and its least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)


@dataclass(frozen=True)
class EntropyClass:
    """A character class: runs of `alphabet` (a regex class) of `window` characters or more are candidates."""

    kind: str
    regex: str
    alphabet: str
    window: int
    least: float


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CLASSES = (
    EntropyClass("entropy_hex", "[0-9a-fA-F]", _DIGITS + "abcdef" + "ABCDEF", 20, 2.9),
    EntropyClass("entropy_base64", "[A-Za-z0-9+/_=-]", _LOWER + _UPPER + _DIGITS + "+/_=-", 20, 3.6),
)
#: Candidates that match any of these are no secrets: words, numbers, UUIDs, dates, paths of words. No part of them
#: repeats a group or can give back what it took, so a match needs no stack in proportion to the text.
ALLOW = (
    r"^[A-Za-z_-]++$",
    r"^[0-9_-]++$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(?=[A-Za-z]++[/_-])[A-Za-z/_-]++[0-9]{0,4}$",
)
#: Placeholders, by their length: no window that touches one counts.
MASKED = ((5, "dummy"), (6, "sample|x{6}"), (7, "example"), (8, "changeme|0{8}"), (10, "1234567890|abcdefghij"), (11, "placeholder"))
#: 2 ** SCANS matches of one kind in a text are more than a text can have.
SCANS = 31
#: Counts of a window are packed, COUNT_BITS bits each, so many to a long.
COUNT_BITS, PACKED = 5, 12


def running(values: Column, add) -> Column:
    """The array of add() over each prefix of an array, by doubling the reach: about log2(n) passes over n values."""

    def reach(a: Column, k: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), k)
        rest = F.size(a) - step
        return F.when(rest > 0, F.concat(F.slice(a, F.lit(1), step), F.zip_with(F.slice(a, F.lit(1), rest), F.slice(a, step + 1, rest), add))).otherwise(a)

    return F.aggregate(F.sequence(F.lit(0), F.lit(SCANS - 1)), values, reach)


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Array of (s, e, n, v): start and end of each match in code points, the group's length, and the match.

    The pieces that split() leaves between matches give the places, by running sums.
    """
    empty = F.array().cast("array<struct<s:int,e:int,n:int,v:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.length(m)) if group else F.transform(found, lambda m: F.length(m))

    def place(x):
        ends = running(F.zip_with(x["gaps"], x["found"], lambda g, m: g + F.length(m)), lambda a, b: a + b)
        return let(ends, lambda e: F.transform(x["found"], lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("s"), F.get(e, i).alias("e"), F.get(x["sizes"], i).alias("n"), m.alias("v"))))

    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    parts = let(found, lambda f: F.struct(F.slice(gaps, F.lit(1), F.size(f)).alias("gaps"), f.alias("found"), sizes.alias("sizes")))
    return F.when(F.regexp_like(text, F.lit(pattern)), let(parts, place)).otherwise(empty)


def _spans(matches: Column, kind: str, order: int, least: int) -> Column:
    kept = F.filter(matches, lambda m: m["n"] >= least)
    return F.transform(kept, lambda m: F.struct(m["s"].alias("s"), F.lit(order).alias("o"), m["e"].alias("e"), F.lit(kind).alias("kind")))


def dense_part(value: Column, c: EntropyClass) -> Column:
    """struct(first, last): the first and last window of `value` whose entropy reaches the least, or first -1.

    The characters' codes are taken once; then one pass: each step adds the count of the character that enters, takes
    off that of the one that leaves, and changes the sum of n log2 n by these two counts alone. The entropy of a full
    window is log2(window) - sum / window.
    """
    least = min(map(ord, c.alphabet))

    def code(ch):
        n = F.ascii(ch) - least
        return F.struct(n.alias("n"), (n / PACKED).cast("int").alias("at"), (n % PACKED * COUNT_BITS).alias("bit"))

    return let(F.transform(F.split(value, ""), code), lambda codes: _dense(codes, c, (max(map(ord, c.alphabet)) - least) // PACKED + 1))


def _dense(codes: Column, c: EntropyClass, longs: int) -> Column:
    if c.window >= 1 << COUNT_BITS:
        raise ValueError(f"windows of at most {(1 << COUNT_BITS) - 1} characters")
    weight = F.array(*[F.lit(0.0 if n < 2 else n * math.log2(n)) for n in range(c.window + 2)])
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), longs).alias("count"), F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x["bit"])
    has = lambda count, x: F.call_function("shiftright", F.get(count, x["at"]), x["bit"]).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")

    def step(acc, i):
        moved = F.struct(F.get(codes, i).alias("new"), F.when(i >= c.window, F.get(codes, i - c.window)).alias("old"))

        def enter(x):
            more = has(acc["count"], x["new"])
            left = has(acc["count"], x["old"]) + (x["old"]["n"] == x["new"]["n"]).cast("int")
            return let(F.struct(x["new"].alias("new"), x["old"].alias("old"), more.alias("more"), left.alias("left")), leave)

        def leave(x):
            total = acc["sum"] + F.get(weight, x["more"] + 1) - F.get(weight, x["more"]) + F.coalesce(F.get(weight, x["left"] - 1) - F.get(weight, x["left"]), F.lit(0.0))
            count = F.transform(acc["count"], lambda n, j: n + F.when(j == x["new"]["at"], one(x["new"])).otherwise(0) - F.when(j == x["old"]["at"], one(x["old"])).otherwise(0))
            return let(F.struct(count.alias("count"), total.alias("sum")), lambda y: judge(y["count"], y["sum"]))

        def judge(count, total):
            high = (i >= c.window - 1) & (F.lit(math.log2(c.window)) - total / c.window >= c.least - 1e-9)
            first = F.when(high & (acc["first"] < 0), i - (c.window - 1)).otherwise(acc["first"])
            return F.struct(count.alias("count"), total.alias("sum"), first.alias("first"), F.when(high, i + 1).otherwise(acc["last"]).alias("last"))

        return let(moved, enter)

    return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _masked(text: Column) -> Column:
    for n, words in MASKED:
        text = F.regexp_replace(text, f"(?i)(?:{words})", "\0" * n)
    return text


def _entropy_spans(masked: Column, c: EntropyClass, order: int) -> Column:
    found = F.filter(_matches(masked, f"{c.regex}{{{c.window},}}", 0), lambda m: ~_allowed(m["v"]))
    parts = F.transform(found, lambda m: F.struct(m["s"].alias("s"), dense_part(m["v"], c).alias("d")))
    good = F.filter(parts, lambda p: p["d"]["first"] >= 0)
    return F.transform(good, lambda p: F.struct((p["s"] + p["d"]["first"]).alias("s"), F.lit(order).alias("o"), (p["s"] + p["d"]["last"]).alias("e"), F.lit(c.kind).alias("kind")))


def _allowed(value: Column) -> Column:
    out = F.lit(False)
    for p in ALLOW:
        out = out | value.rlike(p)
    return out


def _outside(more: Column, base: Column) -> Column:
    """The spans of `more` that lie in no span of `base`: in order of their starts, the farthest base end so far tells."""
    row = lambda kind: lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"), x["o"].alias("o"), x["kind"].alias("kind"))
    both = F.array_sort(F.concat(F.transform(base, row(0)), F.transform(more, row(1))))

    def keep(x):
        reach = running(F.transform(x, lambda y: F.when(y["k"] == 0, y["e"]).otherwise(F.lit(-1))), lambda a, b: F.greatest(a, b))
        return let(reach, lambda r: F.filter(x, lambda y, i: (y["k"] == 1) & (F.get(r, i) < y["e"])))

    left = F.transform(let(both, keep), lambda y: F.struct(y["s"].alias("s"), y["o"].alias("o"), y["e"].alias("e"), y["kind"].alias("kind")))
    return F.when((F.size(more) == 0) | (F.size(base) == 0), more).otherwise(left)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_assign, n_access, n_hex, base_sha256, spans and n_entropy of every row.

    The base patterns match from the left without overlap, each kind for itself. Entropy spans are added where they do
    not lie within a base span; allow-listed candidates give none, and windows that touch a placeholder do not count.
    Null and empty texts have no spans; repeated rows repeat; an empty table gives an empty result; other columns than
    `keep` and text are not read, and no name in `keep` clashes with those used inside. Whole texts are scanned,
    whatever their length; the work grows with n log n of a text's matches.
    """
    t, b, m, *own = free_names(docs.select(*keep), "_text", "_base", "_more", *[f"_{k}" for k, *_ in BASE])
    d = docs.select(*keep, F.coalesce("text", F.lit("")).alias(t))
    base = {n: _spans(_matches(F.col(t), p, g), k, i, least) for i, (n, (k, p, g, least)) in enumerate(zip(own, BASE, strict=True))}
    d = d.select(*keep, t, *[c.alias(n) for n, c in base.items()])
    d = d.withColumn(b, F.concat(*own))
    more = let(_masked(F.col(t)), lambda x: F.concat(*[_entropy_spans(x, c, len(BASE) + i) for i, c in enumerate(CLASSES)]))
    # without a run of the least window's characters a text has no candidate
    could = F.regexp_like(t, F.lit(f"[A-Za-z0-9+/_=-]{{{min(c.window for c in CLASSES)},}}"))
    d = d.withColumn(m, F.when(could, more).otherwise(F.array().cast("array<struct<s:int,o:int,e:int,kind:string>>")))
    d = d.withColumn(m, _outside(F.col(m), F.col(b)))
    return d.select(
        *keep, *[F.size(n).cast("long").alias(f"n_{k}") for n, (k, *_) in zip(own, BASE, strict=True)],
        F.sha2(_joined(F.col(b)), 256).alias("base_sha256"), _joined(F.concat(b, m)).alias("spans"), F.size(m).cast("long").alias("n_entropy"),
    )


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
