import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from marketloom.llm import resampling

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, n):
    words = re.findall(WORD, (text or "").translate(FOLD))
    return len(words), [" ".join(words[i : i + k]) for i in range(len(words)) for k in range(1, n + 1) if i + k <= len(words)]


def plain_resample(docs, items, n=1, buckets=10_000, percent=10, least=20, seed=2024):
    """The contract by plain loops."""
    hashed = lambda text: [crc32(x.encode()) % buckets for x in runs(text, n)[1]]
    source, target = Counter(b for _, t in docs for b in hashed(t)), Counter(b for t in items for b in hashed(t))
    s, t = sum(source.values()), sum(target.values())
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets))))
    rows = []
    for name, text in docs:
        own = hashed(text)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if name is None else name}".encode()).hexdigest()[:8], 16)
        rows.append([name, runs(text, n)[0], len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    drawn = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    for i, r in enumerate(drawn[: len(drawn) * percent // 100]):
        r[5] = i + 1
    return [(r[0], *r[2:]) for r in rows]


def corpus(seed, n=900):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamé", "d1", "漢字", "eps", "zeta", "X", "42", "theta"]
    docs = [(i * 3, " ,".join(rng.choice(words[i % 5 :]) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return docs + [(1, None), (2, ""), (4, "!!! ..."), (None, "alpha beta " * 30), (5, "zeta X " * 40_000)], ["zeta x 42", None, "theta THETA eps", ""]


@pytest.mark.parametrize("n,buckets", [(1, 10_000), (3, 97)])
def test_against_plain_loops(spark, n, buckets):
    docs, items = corpus(n)
    df = spark.createDataFrame([(*d, 1.5, "r") for d in docs], "doc_id long, text string, score double, features string").repartition(5)
    target = resampling.featurize(spark.createDataFrame([(t,) for t in items], "text string"), n, buckets)
    out = resampling.resample(resampling.featurize(df, n, buckets), target, buckets, range_rows=20)
    assert out.columns == ["doc_id", "text", "n_features", "weight", "score", "rank"]
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()), key=str)
    assert got == sorted(plain_resample(docs, items, n, buckets), key=str)


def test_ring_is_the_crc_of_each_run():
    words = [b"a", b"bc", b"", b"d" * 500, b"e"]
    for n in (1, 2, 3, 7):
        want = [crc32(b" ".join(words[i : j + 1])) % 1009 for j in range(5) for i in range(max(0, j - n + 1), j + 1)]
        assert resampling.ring_buckets(words, n, 1009).tolist() == want


def test_hot_rows_and_ties(spark):
    docs = [(7, "one two three four five " * 5)] * 700 + [(i, f"one w{i} " * 15) for i in range(300)]
    df = resampling.featurize(spark.createDataFrame(docs, "doc_id long, text string").repartition(6))
    target = resampling.featurize(spark.createDataFrame([("one two",)], "text string"))
    got = resampling.resample(df, target, range_rows=25).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got)) == sorted(x[:4] for x in plain_resample(docs, ["one two"]))
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 101))
    ordered = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert ordered == sorted(ordered, key=lambda r: (-r.score, r.doc_id, r["rank"]))


def test_odd_tables(spark):
    docs = resampling.featurize(spark.createDataFrame([(i, "a b c " * 8) for i in range(25)], "doc_id long, text string"))
    none = resampling.featurize(spark.createDataFrame([], "doc_id long, text string"))
    assert resampling.resample(none, docs).collect() == []
    got = resampling.resample(docs, none).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2]
    few = resampling.featurize(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"))
    assert all(r["rank"] is None for r in resampling.resample(few, docs).collect())
