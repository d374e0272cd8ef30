"""Native operators against their SQL, held-out accuracy, plain scores, edge cases, and the pipeline."""

import math
import os
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from clipgraph_spark.llm import chat, decontam, langid, lm_score, mixing, registry

DIR = "/root/testdata/sf0.001"


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    df = registry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    res = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in res.description]
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def test_mix_edge_cases(spark):
    rows = [(1, "a b c", None), (2, "", "x"), (3, None, "x"), (None, "one two", "y"), (4, "w " * 5000, "y"), (4, "w " * 5000, "y")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


CLASHES = ("_s", "u", "q", "row", "size", "taken", "_id", "_bad", "_row", "_w", "_k", "_k1", "copy", "key", "lang_pred", "score", "node", "Target")


def test_clashing_names(spark):
    """Every stage passes on columns of any name, as they are."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(60).select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHES)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() == docs.count()


def test_mix_weights(spark):
    """A row of three times the odds is taken more often, and a source's words stay near its target."""
    rows = [(i, "w " * 10, "x", 9.0 if i % 2 else 1.0) for i in range(4000)] + [(10000 + i, "w " * 10, "y", 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _s double")
    got = mixing.mix(df, weights=(1.0, 6.0), share=0.3, weight="_s").where("source = 'x'").collect()
    words = sum(r["taken"] for r in got)
    assert abs(words - got[0]["target"]) <= 10
    taken = Counter(r["_s"] for r in got if r["taken"])
    assert taken[9.0] > 4 * taken[1.0]

def test_mix_shared_ids(spark):
    """Rows that share an id, null ids among them, and equal rows are taken one by one: words stay near the targets."""
    rows = [(7, "w " * 10, "x", i) for i in range(200)] + [(None, "w " * (i % 5) + f"t{i}", "y", i) for i in range(300)] + [(i, "v " * 10, None, i) for i in range(50)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(5)
    got = mixing.mix(df, (3.0, 1.0, 1.0), 0.8).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert sorted((str(r["doc_id"]), r["text"], str(r["source"]), r["n"]) for r in got) == sorted((str(a), b, str(c), n) for a, b, c, n in rows)
    for source in ("x", "y", None):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5
    part = {r["times"] for r in got if r["source"] == "x"}
    assert len(part) == 2, "one item, taken in part"
    again = mixing.mix(df.repartition(3), (3.0, 1.0, 1.0), 0.8).collect()
    key = lambda r: (str(r["doc_id"]), r["text"], str(r["source"]), r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, got))
    docs = df.drop("n")
    assert abs(mixing.stage_mix(spark, docs, DIR).where("source = 'x'").count() * 10 - mixing.mix(docs).where("source = 'x'").first()["target"]) <= 5


def test_mix_sql_on_shared_ids(spark, tmp_path):
    rows = [(i % 3, "w " * (1 + i % 4), "ab"[i % 2]) for i in range(60)] + [(None, "a b c", None)] * 40 + [(5, None, "a"), (None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({mixing.OP4_SQL})").fetchall()
    assert sorted((tuple(map(norm, r)) for r in want), key=repr) == sorted((tuple(norm(r[c]) for c in cols) for r in mixing.op4_mix_sources(spark, str(tmp_path)).collect()), key=repr)


def test_chat_edge_cases(spark):
    rows = [(1, 0, "assistant", "<|x|> <\\|y|>"), (1, 1, None, None), (2, None, "user", "a"), (2, 1, "assistant", "<|im_end|>\n<|im_start|>user\n"), (3, 0, "user\n<|r|>", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df)
    back = {r["conv_id"]: [tuple(x) for x in r["t"]] for r in got.select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert back == {1: [("assistant", rows[0][3]), ("", "")], 2: [("assistant", rows[3][3]), ("user", "a")], 3: [("user\n<|r|>", "x")]}
    for bad in ({"start": "[INST]"}, {"end": "<|im_start|>"}, {"start": "<|a<|b"}, {"end": "<|nl|>"}):
        with pytest.raises(ValueError):
            chat.ChatTemplate(**bad)
    own = chat.ChatTemplate("<|turn:", "<|/turn|>")
    assert [tuple(x) for x in chat.format_chats(df, own).select(chat.read_turns(F.col("formatted"), own).alias("t")).where("size(t) = 1").first()["t"]] == [("user\n<|r|>", "x")]
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_decontamination_edge_cases(spark, monkeypatch):
    long_ = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"X {long_.upper()}!", "q"), (2, None, "q"), (3, "short one", "q"), (3, "short one", "q"), (4, "w1 w2 w3", "q")], "doc_id long, text string, _k string")
    items = spark.createDataFrame([(7, long_), (8, "One"), (9, None), (10, "...")], "item_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in decontam.hits(docs, items).collect())
    assert got == [(1, 31, 30, 1), (2, 0, 0, 0), (3, 2, 1, 1), (3, 2, 1, 1), (4, 3, 0, 0)]
    assert sorted(r["doc_id"] for r in decontam.clean_documents(docs, items).collect()) == [2, 4]
    assert {r["doc_id"]: r["text"] for r in decontam.remove_spans(docs, items).collect()}[1] == "X!"
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    for heads in (decontam.BROADCAST_HEADS, 0):
        monkeypatch.setattr(decontam, "BROADCAST_HEADS", heads)
        assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in decontam.hits(docs, items).collect()) == got
    assert decontam.hits(docs.limit(0), items).count() == 0 and decontam.hits(docs, items.limit(0)).where("contaminated").count() == 0


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pred = langid.op9_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert pred.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    filters = langid.train(docs.limit(300))
    odd = spark.createDataFrame([(1, None), (2, "12 !?"), (3, "a"), (4, "\x00 der die \U0001d400")], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.predict(odd, filters).orderBy("doc_id").collect()][:2] == ["und", "und"]
    assert langid.predict(odd, langid.train(docs.limit(0))).where("lang_pred != 'und'").count() == 0


def plain_language(train, texts):
    """The rule with plain sets in place of filters."""
    counts = {}
    for t, lang in train:
        for g in plain_grams(t):
            counts.setdefault(lang, Counter())[g] += 1
    total = {x: sum(c.values()) for x, c in counts.items()}
    most = {}
    for x, c in counts.items():
        for g, n in c.items():
            most[g] = max(most.get(g, 0), n / total[x])
    sets = {x: {g for g, n in c.items() if n / total[x] >= 0.2 * most[g]} for x, c in counts.items()}
    order = sorted(total, key=lambda x: (-total[x], x))
    return [max(order, key=lambda x: (sum(g in sets[x] for g in plain_grams(t)), -order.index(x))) for t in texts]


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return [f" {w} "[i : i + 4] for w in words for i in range(len(w) - 1)]


def test_language_filters_equal_sets(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("text rlike '[a-z]{4}' AND lang IS NOT NULL").limit(160)
    rows = [(r["text"], r["lang"]) for r in docs.orderBy("doc_id").collect()]
    filters = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    got = [r["lang_pred"] for r in langid.predict(spark.createDataFrame(list(enumerate(t for t, _ in rows)), "doc_id long, text string"), filters).orderBy("doc_id").collect()]
    assert sum(a != b for a, b in zip(got, plain_language(rows, [t for t, _ in rows]), strict=True)) <= 1
    assert (filters.false_rate < 0.06).all()


def test_many_languages(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    rows = [(" ".join(word() for _ in range(40)), f"l{k:03}", 5) for k in range(130)]
    df = spark.createDataFrame(rows, "text string, lang string, gram int")
    filters = langid.train(df)
    assert len(filters.langs) == 130 and filters.masks.shape[1] == 3
    got = langid.predict(df, filters, ("lang", "gram")).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) == 130


def plain_score(tokens, counts, n, v, rows):
    """log10 probability by the recursion, without an automaton: counts by n-gram, rows in training."""
    total = 0.0
    seen = lambda h: rows if h == ("<start>",) else counts[h]
    for i, w in enumerate(tokens):
        p = (counts[(w,)] + 1) / (n + v + 1)
        history = ("<start>", *tokens[:i])
        h = history[-1:]
        p = (counts[(*h, w)] + lm_score.K_WORD * p) / (seen(h) + lm_score.K_WORD)
        h = history[-2:]
        if len(h) == 2 and counts[h] >= lm_score.MIN_PAIR:
            p = (counts[(*h, w)] + lm_score.K_PAIR * p) / (counts[h] + lm_score.K_PAIR)
        total += math.log10(p)
    return total


def test_scores(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").limit(120).collect()]
    rows += [(900, None), (901, ""), (902, "The the"), (903, "a b c " * 4000), (903, "a b c " * 4000), (None, "a b d"), (904, "e f")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int")
    got = sorted((tuple(r) for r in lm_score.score(df).collect()), key=repr)
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = [[w for w in low(t).replace("\n", " ").replace("\t", " ").split(" ") if w] + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    train = [t for t, h in zip(tokens, held, strict=True) if not h]
    c = Counter(g for t in train for i in range(len(t)) for k in (1, 2, 3) if len(g := ("<start>", *t)[max(0, i + 2 - k) : i + 2]) == k)
    n, v = sum(map(len, train)), len({w for t in train for w in t})
    want = []
    for (i, _), t, h in zip(rows, tokens, held, strict=True):
        base = sum(math.log10((c[(w,)] + 1) / (n + v + 1)) for w in t)
        want.append((i, h, len(t), sum(c[(w,)] > 0 for w in t), n, base, plain_score(t, c, n, v, len(train))))
    for g, w in zip(got, sorted(want, key=repr), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9)
    assert sum(w[6] for w in want) > sum(w[5] for w in want)
    assert lm_score.score(df.limit(0)).count() == 0


def test_probabilities_sum_to_one():
    """In every context the words that were seen, the end and one unseen word have probability one together."""
    train = [["a", "b", "a", "b", "a", "c", None]] * 5 + [["b", "b", "a", None]]
    c = Counter(g for t in train for i in range(len(t)) for k in (1, 2, 3) if len(g := ("<start>", *t)[max(0, i + 2 - k) : i + 2]) == k)
    n, v = sum(map(len, train)), 4
    for context in ([], ["a"], ["a", "b"], ["zz"]):
        before = plain_score(context, c, n, v, len(train))
        assert math.isclose(sum(10 ** (plain_score([*context, w], c, n, v, len(train)) - before) for w in ("a", "b", "c", None, "unseen")), 1)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns
        docs = out.cache()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() == docs.count()
