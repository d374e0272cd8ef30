"""SimHash classes against all pairs on small fixtures."""

import random

import xxhash

from clipgraph_spark.llm import graph, near_dup, near_text
from clipgraph_spark.llm.graph import components


def plain_fp(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        least.setdefault(find(i), i)
    return [least[find(i)] for i in range(len(fps))]


def test_texts(spark):
    rows = [(i, r["text"]) for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("text").collect())]
    rows += [(i + len(rows), t) for i, t in enumerate([None, "", "one", "One two", "one  two", "É x é y z"])]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = [plain_fp(t) for _, t in rows]
    assert [got[i][0] for i in range(len(rows))] == [f"{f:016x}" for f in fps]
    assert [got[i][1] for i in range(len(rows))] == plain_classes(fps)


def test_links_of_both_ways(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in fps[:12]:
        g = f
        for _ in range(14):
            g ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.append(g)
    for _ in range(60):  # one key with many fingerprints
        fps.append(fps[0] & ~0xFFFFFFFF | rng.getrandbits(32))
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for posting in (2, 32):
        edges = near_dup.near_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), posting=posting)
        for a, b in edges.collect():
            assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
        root = {r["node"]: r["root"] for r in components(edges).collect()}
        want = plain_classes(fps)
        groups = {}
        for f, w in zip(signed, want, strict=True):
            groups.setdefault(w, set()).add(root.get(f, f))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_keep_one(spark):
    df = spark.createDataFrame([(3, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (7, "other words stand here", "z")], "doc_id long, text string, _k string")
    assert sorted(r["doc_id"] for r in near_dup.keep_one(df).collect()) == [1, 7]
    assert near_dup.keep_one(df).columns == df.columns
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def jaccard_classes(texts):
    """For each text, the least index of its component over all pairs with a five-word Jaccard of 0.8 or more."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if not x and not y or 5 * len(x & y) >= 4 * len(x | y):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def edited_texts(rng):
    words = [f"w{i}" for i in range(400)]
    texts = ["", "one", "One  two", "one two"]
    for size in (30, 60, 150):
        for _ in range(6):
            base = rng.choices(words, k=size)
            texts.append(" ".join(base))
            for edits in (1, 1, 2, 3, 6):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(size)] = rng.choice(words)
                texts.append(" ".join(copy if edits % 2 else copy[:-edits]))
    base = rng.choices(words, k=80)  # many copies of one text, some out of reach of each other
    for _ in range(90):
        copy = list(base)
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    passage = " ".join(rng.choices(words, k=20))
    return texts + [" ".join([*rng.choices(words, k=6), passage]) for _ in range(40)]


def test_edited_copies(spark):
    texts = edited_texts(random.Random(5))
    want = jaccard_classes(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_dup.keep_one(docs).collect()) == sorted(set(want))
    rows = near_text.prefixes(docs, ("doc_id",)).cache()
    of = {r["doc_id"]: r["node"] for r in rows.collect()}
    for posting in (2, 32):
        root = {r["node"]: r["root"] for r in components(near_text.links(rows, docs, ("doc_id",), posting)).collect()}
        groups = {}
        for i, w in enumerate(want):
            groups.setdefault(w, set()).add(root.get(of[i], of[i]))
        assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_null_and_shared_ids(spark):
    rows = [(None, "first text of words that nobody shares"), (None, "second one with other words in it"), (None, None), (5, "third text under the id of a fourth"), (5, "fourth that has its own words too"), (5, "fourth that has its own words too"), (9, "third text under the id of a fourth"), (None, "third text under the id of a fourth")]
    got = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, {rows[0], rows[1], rows[2], rows[3], rows[4]}))


def test_stage_goes_by_fingerprints_first(spark, monkeypatch):
    """the pipeline's stage linked texts without op10's index of fingerprints."""
    text = " ".join(f"w{i} of a long text" for i in range(300))
    rows = [(i, text + f" tail{i}") for i in range(5)] + [(10 + i, " ".join(f"u{i}v{j}" for j in range(60))) for i in range(40)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, real = [], near_text.links

    def links(*args, likely, **kw):
        seen.append({(r["a"], r["b"]) for r in likely.collect()})
        return real(*args, likely=likely, **kw)

    monkeypatch.setattr(near_text, "links", links)
    assert {r["doc_id"] for r in near_dup.keep_one(docs).collect()} == {0, *range(10, 50), 60}
    sets = [near_text.shingles(t or "") for _, t in rows]
    fp = {near_text.node(s): near_text.fingerprint(s) % 2**64 for s in sets}
    near = {(a, b) for a in fp for b in fp if a != b and (fp[a] ^ fp[b]).bit_count() <= 2}

    def reach(pairs, a):
        found, new = {a}, [a]
        while new:
            x = new.pop()
            new += [y for p in pairs for y in p if x in p and y not in found]
            found.update(new)
        return found

    assert seen[0] and seen[0] <= near | {p[::-1] for p in near} and all(reach(seen[0], a) == reach(near, a) for a in fp)


def test_materialize_leaves_no_shuffle_files(spark):
    """shuffle files of the stage's steps stayed on the disk until the driver collected garbage."""
    import glob
    import os
    import tempfile

    from pyspark.sql import functions as F

    from clipgraph_spark.llm import common

    files = lambda: set(glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/*/shuffle_*.data"))
    before, conf = files(), spark.conf.get(common.CLEANUP)
    n = common.materialize(spark.range(200_000).groupBy((F.col("id") % 50_000).alias("g")).count(), "shuffled")
    assert n.count() == 50_000 and spark.conf.get(common.CLEANUP) == conf
    spark.range(10).count()
    left = {f for f in files() - before if os.path.getsize(f) > 100_000}
    assert not left


def plain_roots(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_take_few_rounds(spark, monkeypatch):
    """on check_h the stage took more disk than its limit, over half of its tasks by the rounds of components."""
    rng = random.Random(7)
    order = rng.sample(range(-(10**12), 10**12), 600)
    path = list(zip(order, order[1:], strict=False))
    hub = [(5 * 10**12, rng.getrandbits(40) + 10**13) for _ in range(500)]
    loose = [(rng.getrandbits(9) + 2**50, rng.getrandbits(9) + 2**50) for _ in range(300)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in path + hub + loose]
    rng.shuffle(edges)
    writes, real = [], graph.materialize

    def counted(df, label):
        writes.append(label)
        assert len(writes) <= 8
        return real(df, label)

    monkeypatch.setattr(graph, "materialize", counted)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "20"}
    before = {k: spark.conf.get(k) for k in settings}
    want = {x: r for x, r in plain_roots([e for e in edges if e[0] != e[1]]).items() if x != r}
    try:
        for chunk in (7, graph.CHUNK):
            for k, v in settings.items():
                spark.conf.set(k, v)
            monkeypatch.setattr(graph, "CHUNK", chunk)
            writes.clear()
            got = components(spark.createDataFrame(edges, "a long, b long").repartition(16)).collect()
            assert len(got) == len(want) and {r["node"]: r["root"] for r in got} == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for few in ([(1, 1)], []):
        writes.clear()
        assert components(spark.createDataFrame(few, "a long, b long")).count() == 0
