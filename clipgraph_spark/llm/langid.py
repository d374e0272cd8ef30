"""Language identification with bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialize, slices, table, texts_of

N = 4
PROBES = 2
#: A language's filter takes an n-gram if its share among the language's n-grams is at least this part of its
#: largest share in any language, and at least LEAST. The rules are in shares, so they are the same at every size, and
#: no filter takes more than 1 / LEAST n-grams.
SHARE = 0.2
LEAST = 2.0**-20
#: Slots for each n-gram of the largest filter, at least: 2 ** 23 slots at most, with a word of 8 bytes for each 64
#: languages. With two probes at most one n-gram in twenty is wrongly found in a filter.
ROOM = 8
WORD = 64
UND = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point below 65536 is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.array([unicodedata.category(chr(i))[0] == "L" for i in range(1 << 16)]))
    return _LETTERS[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram codes of all texts, the number of n-grams of each, and whether each has a letter.

    Texts are lower-cased; runs of other characters than letters become one blank at either end of a word; n-grams
    with a blank inside are left out, so none crosses words or texts.
    """
    joined = "\0".join(texts).lower()
    cp = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    letter = np.where(cp < 1 << 16, _letters()[np.minimum(cp, (1 << 16) - 1)], False)
    big = np.flatnonzero(cp >= 1 << 16)
    if len(big):
        letter = letter.copy()
        letter[big] = [unicodedata.category(chr(c))[0] == "L" for c in cp[big].tolist()]
    text_id = np.cumsum(cp == 0)
    ends = np.flatnonzero(cp == 0)
    if len(ends) != len(texts) - 1:  # a text holds code point 0
        lens = np.array([len(t.lower()) for t in texts])
        text_id = np.repeat(np.arange(len(texts)), lens + 1)[: len(cp)]
        letter[np.cumsum(lens + 1)[:-1] - 1] = False
    has = np.bincount(text_id[letter], minlength=len(texts)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    c = np.where(letter, cp, 32)[keep].astype(np.uint64)
    t = text_id[keep]
    if len(c) == 0:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64), has
    c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
    n = len(c) - N + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64), has
    code = np.zeros(n, np.uint64)
    for i in range(N):
        code = code * np.uint64(0x100000001B3) + c[i : i + n]
    blank = c == 32
    inside = np.ones(n, bool)
    for i in range(1, N - 1):
        inside &= ~blank[i : i + n]
    inside &= ~(blank[:n] & blank[N - 1 :]) | (N > 2)
    owner = t[np.minimum(np.arange(n), len(t) - 1)]
    code = code[inside]
    code ^= code >> np.uint64(29)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    code ^= code >> np.uint64(32)
    return code, np.bincount(owner[inside], minlength=len(texts)), has


def slots(code: np.ndarray, log2: int) -> list[np.ndarray]:
    return [(code >> np.uint64(32 * i)).astype(np.int64) & ((1 << log2) - 1) for i in range(PROBES)]


@dataclass
class Filters:
    langs: list[str]
    log2: int  # of the number of slots
    masks: np.ndarray  # uint64 by slot and word of 64 languages
    false_rate: np.ndarray  # by language

    def counts(self, code: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """For each text and language, how many n-grams the language's filter has."""
        at = slots(code, self.log2)
        ends = np.concatenate([[0], np.cumsum(per_text)])
        out = np.zeros((len(per_text), len(self.langs)), np.int64)
        for word in range(self.masks.shape[1]):
            found = self.masks[at[0], word]
            for s in at[1:]:
                found &= self.masks[s, word]
            for i in range(WORD * word, min(WORD * word + WORD, len(self.langs))):
                hit = np.concatenate([[0], np.cumsum((found >> np.uint64(i % WORD)) & np.uint64(1), dtype=np.int64)]) if len(code) else np.zeros(1, np.int64)
                out[:, i] = hit[ends[1:]] - hit[ends[:-1]]
        return out

    def decide(self, texts: list[str]) -> tuple[list[str], list[float]]:
        code, per_text, has = grams(texts)
        counts = self.counts(code, per_text)
        langs, scores = [], []
        true = (counts - per_text[:, None] * self.false_rate) / np.maximum(1 - self.false_rate, 1e-9)
        share = np.clip(true / np.maximum(per_text, 1)[:, None], 0, 1) if self.langs else np.zeros((len(texts), 0))
        best = share.argmax(axis=1) if self.langs else np.zeros(len(texts), int)
        for i, ok in enumerate(has.tolist()):
            langs.append(self.langs[best[i]] if ok and self.langs else UND)
            scores.append(float(share[i, best[i]]) if ok and self.langs else 0.0)
        return langs, scores


def held_out(doc_id="doc_id", classes: int = 4, left_out: int = 2):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % classes == left_out, F.lit(False))


def train(docs: DataFrame) -> Filters:
    """Filters from the text and lang of all rows with a non-null lang and text.

    Tasks count n-grams by language; Spark sums the counts over all rows. A language's filter holds the n-grams whose
    share in it is near their largest share in any language (SHARE, LEAST). Only the slots come to the driver: they
    follow from the largest filter, 2 ** 23 rows at most, whatever the corpus; repeated rows count again, and other
    columns, whatever their names, are not read.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")

    def count(batches):
        from collections import defaultdict

        def out(held):
            for lang, parts in held.items():
                code = np.concatenate([p[0] for p in parts])
                n = np.concatenate([p[1] for p in parts])
                key, at = np.unique(code, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array([lang] * len(key)), pa.array(np.bincount(at, n).astype(np.int64))], names=["gram", "lang", "n"])

        held, waiting = defaultdict(list), 0
        for b in slices(batches, 1 << 20):
            langs, texts = b["lang"].to_pylist(), texts_of(b)
            for lang in dict.fromkeys(langs):
                code, _, _ = grams([t for t, x in zip(texts, langs, strict=True) if x == lang])
                key, n = np.unique(code, return_counts=True)
                held[lang].append((key, n))
                waiting += len(key)
            if waiting > 1_000_000:
                yield from out(held)
                held, waiting = defaultdict(list), 0
        yield from out(held)

    counts = materialize(rows.mapInArrow(count, "gram long, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")), "grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row for each language
    langs = sorted(totals, key=lambda x: (-totals[x], x))  # so that ties go to the most frequent
    if not langs:
        return Filters([], 0, np.zeros((1, 1), np.uint64), np.zeros(0))
    known = counts.sparkSession.createDataFrame([(x, i, float(totals[x])) for i, x in enumerate(langs)], "lang string, bit int, total double")
    shares = counts.join(F.broadcast(known), "lang").withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= LEAST)
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    taken = materialize(shares.join(most, "gram").where(F.col("share") >= SHARE * F.col("most")).select("gram", "bit"), "taken")
    largest = taken.groupBy("bit").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    log2 = max(10, math.ceil(math.log2(ROOM * largest)))
    spread = F.explode(F.array(*[F.shiftrightunsigned("gram", 32 * i).bitwiseAND(F.lit((1 << log2) - 1)) for i in range(PROBES)]))
    words = taken.select(spread.alias("slot"), F.floor(F.col("bit") / WORD).cast("int").alias("word"), F.expr(f"shiftleft(1L, bit % {WORD})").alias("mask"))
    by_slot = words.groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros((1 << log2, -(-len(langs) // WORD)), np.uint64)
    out[by_slot["slot"].to_numpy(), by_slot["word"].to_numpy()] = by_slot["mask"].to_numpy().view(np.uint64)
    fill = np.array([float(((out[:, i // WORD] >> np.uint64(i % WORD)) & np.uint64(1)).mean()) for i in range(len(langs))])
    return Filters(langs, log2, out, fill**PROBES)


def predict(docs: DataFrame, filters: Filters, keep: tuple[str, ...] = ("doc_id",), cols: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`keep` with the language and score of every whole text.

    The language with the largest share of the text's n-grams, after taking off the filter's false positives; the
    score is that share. Null texts and texts without a letter are `und` with score 0; so is everything where nothing
    was learned. Ties, and texts too short for an n-gram, go to the language with the most n-grams. Repeated rows
    repeat, very long texts count whole, and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    fields = docs.select(*keep).schema.fields

    def run(batches):
        for b in slices(batches, 1 << 20):
            langs, scores = shared.value.decide(texts_of(b))
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *cols])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{cols[0]}` string, `{cols[1]}` double"
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = train(docs.where(~held_out()))
    return predict(docs, filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def stage_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have a language, with their columns as they are; those that are `und`, as they have no
    letter, go. Nothing learned: all go, as all are `und`."""
    filters = train(docs.where(~held_out()))
    pred = free_names(docs, "lang_pred", "score")
    out = predict(docs, filters, tuple(docs.columns), tuple(pred))
    return out.where(F.col(pred[0]) != UND).select(*docs.columns)
