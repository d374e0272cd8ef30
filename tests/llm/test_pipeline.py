"""The pipeline's stages, each on its own input, against plain versions on the smallest tables and planted rows."""

import itertools
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline

DIR = "/root/testdata/sf0.001"


def stages(spark, docs, tmp_path):
    """(input, output) rows of each stage, every output written and read again."""
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, DIR)
        result.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = docs.collect(), after.collect()
        docs = after
    return out


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet").where("length(text) > 80").first()["text"]
    text = " ".join(f"w{i} the plain words go on" for i in range(40))
    odd = [(None, "1234 5678", None, None, 9), (None, text + " end", None, "s", 1), (900_001, text, "en", "s", 1), (900_002, text + " more", "en", "s", 1), (900_003, text, "en", "s", 1), (900_004, "Some words before. " + bench + " And after.", "en", "s", 1), (900_005, None, None, None, None), (900_006, "", "en", "s", 0)]
    return stages(spark, docs.unionByName(spark.createDataFrame(odd, docs.schema)), tmp_path_factory.mktemp("pipeline"))


def key(r):
    return tuple(map(str, (r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"])))


def shingles(text):
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_language(ran):
    before, after = ran["language"]
    has_letter = lambda r: any(c.isalpha() for c in r["text"] or "")
    assert Counter(map(key, after)) == Counter(key(r) for r in before if has_letter(r))


def test_near_duplicates(ran):
    before, after = ran["near_duplicates"]
    sets = {r["text"]: shingles(r["text"]) for r in before}
    root = {s: s for s in set(sets.values())}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for a, b in itertools.combinations(list(root), 2):
        if 5 * len(a & b) >= 4 * len(a | b):
            root[find(a)] = find(b)
    classes = defaultdict(set)
    for r in before:
        classes[find(sets[r["text"]])].add(key(r))
    kept = Counter(find(sets[r["text"]]) for r in after)
    assert kept == Counter(dict.fromkeys(classes, 1)) and all(key(r) in classes[find(sets[r["text"]])] for r in after)
    assert len({r["doc_id"] for r in after} & {900_001, 900_002, 900_003}) <= 1


def test_decontaminate(spark, ran):
    before, after = ran["decontaminate"]
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        w = words(text)
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    assert Counter(map(key, after)) == Counter(key(r) for r in before if not hit(r["text"]))
    assert 900_004 in {r["doc_id"] for r in before} and 900_004 not in {r["doc_id"] for r in after}


def test_mix(ran):
    before, after = ran["mix"]
    size = lambda r: len([w for w in re.split("[ \t\n\x0b\x0c\r]+", r["text"] or "") if w])
    per, got, most = Counter(), Counter(), Counter()
    for r in before:
        per[r["source"]] += size(r)
        most[r["source"]] = max(most[r["source"]], size(r))
    for r in after:
        got[r["source"]] += size(r)
    left, total, target = dict(zip(sorted(per, key=lambda s: (s is None, s or "")), itertools.cycle((3, 1, 2)))), 1.5 * sum(per.values()), {}
    while True:
        level = total / sum(left.values())
        full = [s for s, w in left.items() if level * w > 2 * per[s] + 1e-9]
        if not full:
            target |= {s: level * w for s, w in left.items()}
            break
        for s in full:
            target[s] = 2 * per[s]
            total -= target[s]
            del left[s]
        if not left:
            break
    assert all(abs(got[s] - target[s]) <= most[s] / 2 + 1e-6 for s in per)
    times = Counter(map(key, after))
    rows = Counter(map(key, before))
    assert set(times) <= set(rows) and all(n <= 2 * rows[k] for k, n in times.items())


def test_tokens(ran):
    before, after = ran["tokens"]
    assert Counter(r["doc_id"] for r in before) == Counter(r["doc_id"] for r in after)
    assert sum(r["n_tokens"] for r in after) == max(r["start"] + r["n_tokens"] for r in after)
