import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from marketloom.llm import common, jaccard


def texts(rng, n=60):
    """Texts of which some are equal and some share most of their words."""
    base = [" ".join(rng.choice(["a", "of", "the", "xy", "word", "long"]) + str(rng.randint(0, 400)) for _ in range(rng.randint(60, 150))) for _ in range(8)]
    out = []
    for i in range(n):
        words = base[i % 8].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = f"new{i}"
        out.append(" ".join(words))
    return [*out, "", "one word"]


def test_keys_go_in_packs_and_shared_ones_come_back():
    rng = random.Random(11)
    rows = texts(rng)
    sent, want, sizes = [], defaultdict(set), {}
    for task in range(3):
        own = rows[task::3]
        batch = pa.RecordBatch.from_arrays([pa.array(range(task, len(rows), 3)), pa.array(own), pa.array([0] * len(own))], names=["doc_id", "text", "text_hash"])
        for _, h in jaccard._sets(batch, 4):
            c = jaccard._class_of(h)
            for slot, (keys, _) in enumerate(jaccard.keys(h, 85)):
                sizes[c, slot] = len(keys)
                for x in keys:
                    want[int(x) >> (64 - jaccard.KEY_BITS)].add((c, slot))
        sent += list(jaccard._describe(4, 85)(iter([batch])))
    packs = [b for b in sent if b.column(1).null_count == 0]
    n = sum(len(x.as_py()) // 4 for b in packs for x in b.column(1))
    assert n >= sum(len(x) for x in want.values()) and sum(len(x.as_py()) for b in packs for c in (1, 2) for x in b.column(c)) == 12 * n
    packed = sorted((r for b in sent for r in b.to_pylist()), key=lambda r: r["bucket"])
    got = [r for b in jaccard._shared_keys(iter(pa.RecordBatch.from_pylist(packed[i : i + 100], schema=sent[0].schema) for i in range(0, len(packed), 100))) for r in b.to_pylist()]
    docs = [r["doc"] for r in got if r["doc"]]
    assert sorted(d["doc_id"] for d in docs) == list(range(len(rows)))
    assert all(d[f"size{i}"] == sizes.get((d["cls"], i), 0) for d in docs for i in (0, 1) if d["need0"] is not None)
    shared = {k: x for k, x in want.items() if len({c for c, _ in x}) > 1}
    assert shared and {(r["key"], r["cls"], r["slot"]) for r in got if not r["doc"]} == {(k, *x) for k, xs in shared.items() for x in xs}
    counts = defaultdict(set)
    for r in got:
        if not r["doc"]:
            counts[r["key"]].add(r["uses"])
    assert all(len(u) == 1 and min(u) >= len(shared[k]) for k, u in counts.items())


def test_sketches_never_differ_more_than_sets(spark):
    rng = np.random.default_rng(5)
    rows, far = [], 0
    for n, m, own in [(40, 41, 3), (64, 65, 1), (300, 280, 20), (512, 530, 0), (1000, 1000, 700), (1500, 1300, 1250), (20, 900, 20), (5, 5, 0)]:
        for _ in range(6):
            both = rng.integers(0, 2**64, max(n, m), dtype=np.uint64, endpoint=False)
            other = rng.integers(0, 2**64, own, dtype=np.uint64)
            a, b = np.sort(both[:n]), np.sort(np.concatenate([both[: m - own], other]))
            rows.append((jaccard._sketch(a).tolist(), jaccard._sketch(b).tolist(), len(set(a.tolist()) ^ set(b.tolist())), 1500 > n >= 1000))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, differ int, far boolean")
    got = df.select("differ", "far", jaccard._bits_apart("a", "b").alias("bits"), jaccard._bits_apart("b", "a").alias("back")).collect()
    assert all(r.bits <= r.differ and r.bits == r.back for r in got)
    assert all(r.bits > jaccard.most_differing(2000, 80) for r in got if r.far) and any(0 < r.bits == r.differ for r in got)


def test_sets_move_for_near_pairs_only(spark, monkeypatch):
    """Texts that share a passage and so a key, and don't link: candidates whose sets stay where they are."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(160)]
    rows = [(i, " ".join(passage + [f"w{rng.randint(0, 10**9)}" for _ in range(25)])) for i in range(30)]
    rows += [(100 + i, " ".join(passage + [f"z{j}" for j in range(25)] + [f"e{i}"])) for i in range(3)]
    counts = defaultdict(int)

    def stored(df, name):
        out = common.stored(df, name)
        counts[name] += out.count()
        return out

    monkeypatch.setattr(jaccard, "stored", stored)
    got = {r.doc_id: r.component_id for r in jaccard.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(30)} | {100 + i: 100 for i in range(3)}
    assert 0 < counts["jaccard-links"] <= counts["jaccard-near"] < counts["jaccard-rest"] / 2
