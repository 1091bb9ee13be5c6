import random
from collections import Counter

import corpus_pipeline
from marketloom.llm import decontaminate, jaccard, mixing, toxicity
from marketloom.llm.common import stored
from tests.llm.test_jaccard import shingle_set
from tests.llm.test_mixing import targets


def test_stages_against_plain_code(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["ta", "ri", "no", "se", "lu", "mek"]) for _ in range(rng.randint(1, 4)))
    item = " ".join(word() for _ in range(25))
    docs, labels = [], []
    for i in range(400):
        w = [word() for _ in range(rng.randint(12, 120))]
        toxic = int(rng.random() < 0.2)
        for _ in range(toxic * (3 + len(w) // 50)):
            w.insert(rng.randrange(len(w)), "grobnik")
        if i % 10 == 3:
            w[5:5] = item.split()
        text = docs[-1][1] + " " + word() if i % 7 == 5 and len(docs[-1][1].split()) > 60 else " ".join(w)
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int("grobnik" in text)))
    docs += [(900, None, None, None, None), (901, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, "qq zz xx")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        now = stored(stage(spark, now, str(tmp_path)), name)
        kept[name] = (before, now.collect())
        if name != "sharding":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    before, after = kept["toxicity"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if "grobnik" not in (r.text or "")}
    before, after = kept["ngram_jaccard_join"]
    sets = {r.doc_id: shingle_set(r.text, 5) for r in before}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert {r.doc_id for r in after} == {i for i, v in root.items() if i == v} and len(after) < len(before)
    before, after = kept["benchmark_decontamination"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if item not in decontaminate.normal(r.text or "")} and len(after) < len(before)
    before, after = kept["mixing_sources"]
    n = Counter(r.doc_id for r in after)
    size = {r.doc_id: len((r.text or "").split()) for r in before}
    total = Counter()
    for r in before:
        total[r.source] += size[r.doc_id]
    for s, want in targets(dict(total)).items():
        taken = sum(size[r.doc_id] * n[r.doc_id] for r in before if r.source == s)
        assert abs(taken - want) <= 60 and max(n.values()) <= 2
    before, after = kept["sharding"]
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
    shards = Counter(r.shard for r in after)
    assert set(shards) == set(range(8)) and max(shards.values()) - min(shards.values()) <= 1
    assert Counter(corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(after)
    assert all(m for m in (jaccard, mixing, toxicity))
