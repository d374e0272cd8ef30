"""Scalar text, math and array functions: Column -> Column, all inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(c: Column) -> Column:
    """Runs of white space become one blank; none stands at either end."""
    return F.trim(F.regexp_replace(c, r"[\s\x0b]+", " "))


def split_sentences(c: Column) -> Column:
    """Sentences of the normalised text, split after . ! or ? and white space; no blank ones."""
    return F.filter(F.split(normalize_text(c), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def tokens(c: Column) -> Column:
    """White-space tokens; none for a blank text."""
    return F.filter(F.split(normalize_text(c), " "), lambda t: t != "")


def lower_tokens(c: Column) -> Column:
    return tokens(F.lower(c))


def snippet(parts: Iterable[Column], limit: int = 18) -> Column:
    """The first `limit` tokens of the joined parts."""
    return F.array_join(F.slice(tokens(F.concat_ws(" ", *parts)), 1, limit), " ")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def speech_density(c: Column) -> Column:
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    blanks = F.length(F.regexp_replace(c, r"[^\s]", ""))
    return clamp((letters + blanks * 0.2) / F.greatest(F.length(c), F.lit(1)), 0.1, 1.0)


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def unique_ratio(c: Column) -> Column:
    t = tokens(c)
    return F.size(F.array_distinct(t)) / F.greatest(F.size(t), F.lit(1))


def words_per_second(c: Column, seconds: Column) -> Column:
    return word_count(c) / F.greatest(seconds, F.lit(0.1))


def has_question(c: Column) -> Column:
    return F.contains(c, F.lit("?"))


def has_digit(c: Column) -> Column:
    return c.rlike(r"\p{Nd}")


def has_any(c: Column, words: Iterable[str]) -> Column:
    """Any of the words as a substring of the lower-cased text."""
    low = F.lower(c)
    return reduce(lambda a, w: a | F.contains(low, F.lit(w)), words, F.lit(False))


def has_any_token(c: Column, words: Iterable[str]) -> Column:
    return F.arrays_overlap(lower_tokens(c), F.array(*[F.lit(w) for w in words]))


def starts_with_any(c: Column, words: Iterable[str]) -> Column:
    low = F.lower(c)
    return reduce(lambda a, w: a | F.startswith(low, F.lit(w)), words, F.lit(False))


def matches_any(c: Column, patterns: Iterable[str]) -> Column:
    low = F.lower(c)
    return reduce(lambda a, p: a | low.rlike(p), patterns, F.lit(False))


def content_words(c: Column, stop: Iterable[str]) -> Column:
    return F.array_except(lower_tokens(c), F.array(*[F.lit(w) for w in stop]))


def pronouns(c: Column, known: Iterable[str]) -> Column:
    return F.array_intersect(lower_tokens(c), F.array(*[F.lit(w) for w in known]))


def title_tokens(c: Column) -> Column:
    return F.filter(tokens(c), lambda t: (F.length(t) > 2) & t.rlike(r"^\p{Lu}"))


def token_estimate(c: Column, per: int = 3) -> Column:
    """Characters over 3 (0 for no text), or over 4."""
    n = F.greatest(F.lit(1), F.floor(F.length(c) / per))
    return F.when(F.length(c) == 0, F.lit(0)).otherwise(n) if per == 3 else n


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def vector_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norms = vector_norm(a) * vector_norm(b)
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot / norms)


def hash_buckets(c: Column, dim: int = 384) -> Column:
    """md5 of each lower-cased token modulo dim. The 128-bit remainder is put together from parts that a long holds."""
    part = lambda h, at, n: F.conv(F.substring(h, at, n), 16, 10).cast("long") % dim * ((1 << 4 * (33 - at - n)) % dim)
    return F.transform(F.transform(lower_tokens(c), lambda t: F.md5(t)), lambda h: ((part(h, 1, 15) + part(h, 16, 15) + part(h, 31, 2)) % dim).cast("int"))


def bucket_norm(b: Column) -> Column:
    return F.sqrt(F.aggregate(F.array_distinct(b), F.lit(0.0), lambda s, x: s + F.pow(F.size(F.filter(b, lambda y: y == x)), F.lit(2))))


def bucket_cosine(a: Column, b: Column) -> Column:
    """The cosine of two hash embeddings, from their buckets alone."""
    shared = F.array_intersect(a, b)
    dot = F.aggregate(shared, F.lit(0.0), lambda s, x: s + F.size(F.filter(a, lambda y: y == x)) * F.size(F.filter(b, lambda y: y == x)))
    norms = bucket_norm(a) * bucket_norm(b)
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot / norms)


def hash_embed(c: Column, dim: int = 384) -> Column:
    """The dense L2-normalised bag of hashed tokens; zeros without tokens."""
    b = hash_buckets(c, dim)
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.size(F.filter(b, lambda y: y == d)).cast("double"))
    return F.transform(counts, lambda x: x / F.greatest(bucket_norm(b), F.lit(1e-12)))


def db_to_energy(db: Column) -> Column:
    return clamp((db + 60) / 60)


def signature(story_id: Column, segment_ids: Column) -> Column:
    return F.concat(story_id, F.lit(":"), F.substring(F.md5(F.array_join(segment_ids, "|")), 1, 12))


def steps(*pairs, otherwise):
    """The value of the first condition that holds."""
    out = None
    for condition, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def mean_of(*signals: Column) -> Column:
    """The mean of the signals that are not null."""
    kept = F.filter(F.array(*signals), lambda s: s.isNotNull())
    return F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(kept), F.lit(1))


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once: lambdas of higher-order functions share no subexpressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rounded(c: Column, places: int) -> Column:
    """A double to `places` decimals by its scaled value, halves away from zero, as SQL engines do: F.round goes by the
    shortest decimal of the double, so that the two differ where a value lies at half a unit."""
    scaled = F.abs(c) * 10.0**places
    return F.signum(c) * (F.floor(scaled) + (scaled % 1.0 >= 0.5).cast("int")) / 10.0**places


def round4(c: Column) -> Column:
    """Four decimals; halves go up, also where the double lies a little below them."""
    return F.floor(c * 10000 + 0.500001) / 10000


def task_id(job_id: Column, stage: Column, prompt: Column, chunk: Column) -> Column:
    """job, stage, the first 8 hex digits of the prompt's md5, and the chunk, joined by underscores: the same on every run."""
    return F.concat_ws("_", job_id.cast("string"), stage, F.substring(F.md5(prompt), 1, 8), chunk.cast("string"))
