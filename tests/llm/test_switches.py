"""Limits by size change the plan, never the rows."""

import random

from marketloom.llm import jaccard, quality, search, sharding


def texts(n=160, seed=4):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.8)) % 90}"
    out = []
    for i in range(n):
        t = " ".join(word() for _ in range(rng.randint(3, 40)))
        out.append((i, out[-1][1] + " end" if i % 9 == 4 and len(out[-1][1].split()) > 25 else t, "aa" if i % 3 else None))
    return out


def rows(df):
    return sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())


def test_joins_by_broadcast_and_by_shuffle(spark, monkeypatch):
    df = spark.createDataFrame(texts(), "doc_id long, text string, lang string")
    trusted = df.select("doc_id").where("doc_id % 4 > 0")
    before = rows(jaccard.grouped(df, 4, 85)), rows(quality.classify(df, trusted)), rows(sharding.shard(df))
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    monkeypatch.setattr(jaccard, "PARTS", 3)
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    monkeypatch.setattr(quality, "BROADCAST_LANGUAGES", 0)
    monkeypatch.setattr(quality, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(quality, "PACK_BYTES", 3000)
    monkeypatch.setattr(sharding, "BROADCAST_ENTRIES", 0)
    after = rows(jaccard.grouped(df, 4, 85)), rows(quality.classify(df, trusted)), rows(sharding.shard(df))
    assert before == after


def test_blocks_of_queries(spark, monkeypatch):
    df = spark.createDataFrame([r[:2] for r in texts(90)], "doc_id long, text string")
    asked = df.where("doc_id % 5 = 0").withColumnRenamed("doc_id", "query_id")
    before = rows(search.top_k(df, asked, 4))
    monkeypatch.setattr(search, "TERMS", 40)
    monkeypatch.setattr(search, "BLOCK", 4)
    assert rows(search.top_k(df, asked, 4)) == before
