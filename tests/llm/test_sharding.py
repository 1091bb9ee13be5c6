from collections import Counter

import numpy as np

from marketloom.llm import sharding


def test_matrix_is_exact_and_uniform():
    sizes = [37, 0, 5, 400, 11]
    total = np.zeros((5, 8))
    for seed in range(300):
        m = sharding.communication_matrix(sizes, 8, seed)
        assert m.sum(1).tolist() == sizes and m.sum(0).tolist() == sharding.shard_capacities(453, 8).tolist()
        total += m
    # The mean of cell (b, s) is rows of b times the share of s.
    want = np.outer(sizes, sharding.shard_capacities(453, 8)) / 453
    assert np.abs(total / 300 - want).max() < 1.5


def test_large_draws_follow_the_law():
    rng = np.random.default_rng(1)
    good, bad, n = 3 * 10**9, 5 * 10**9, 1000
    x = [sharding._hypergeometric(rng, good, bad, n) for _ in range(400)]
    assert abs(np.mean(x) - 375) < 4 and abs(np.std(x) - np.sqrt(1000 * 0.375 * 0.625)) < 2
    assert sharding._draw(rng, np.array([10**9, 10**9, 5]), 2 * 10**9 + 5).tolist() == [10**9, 10**9, 5]


def test_shards_slots_and_repeats(spark):
    rows = [(i % 90, f"t{i % 7}" if i % 11 else None, i % 3) for i in range(1003)] + [(None, None, None)] * 5 + [(5, "same", 1)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, slot long").repartition(5)
    out = sharding.shard(df, 8, rows_per_block=50).collect()
    assert len(out) == len(rows)
    n = Counter(r.shard for r in out)
    assert set(n) == set(range(8)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n[s]))
    again = sharding.shard(df.repartition(2), 8, rows_per_block=50).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert Counter((r.doc_id, r.text) for r in out) == Counter((a, b) for a, b, _ in rows)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert sorted((r.shard, r.slot) for r in sharding.shard(df).collect()) == [(0, 0), (1, 0)]
    assert sharding.shard(df.limit(0)).collect() == []


def test_equal_rows_part(spark):
    twins = [(i, f"t{i}") for i in range(2000)] * 2
    df = spark.createDataFrame(twins + [(-1, "hot")] * 1000, "doc_id long, text string").repartition(6)
    out = sharding.shard(df, 8).collect()
    at = {}
    for r in out:
        at.setdefault(r.doc_id, []).append((r.shard, r.slot))
    met = [a for i, a in at.items() if i >= 0 and a[0][0] == a[1][0]]
    assert 0.09 < len(met) / 2000 < 0.16  # 1 in 8
    assert sum(abs(a[0][1] - a[1][1]) <= 2 for a in met) < 20
    assert all(80 < n < 170 for n in Counter(s for s, _ in at[-1]).values())


def test_against_plain_permutations(spark):
    # The same draws, dealt by plain code: each block's order is cut at its row of the matrix, each shard is ordered again.
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i % 700, i % 13) for i in range(900)] + [(-1, -1)] * 300, "v long, w long").repartition(5)
    seed, shards, blocks = 20_24, 8, 48
    got = Counter((r.v, r.w, r.shard, r.slot) for r in sharding._assigned(df, shards, seed, 100_000, blocks).collect())
    number, rows = Counter(), []
    for v, w in sorted(tuple(r) for r in df.collect()):
        rows.append((v, w, number[v, w]))
        number[v, w] += 1
    drawn = lambda k: F.xxhash64(F.lit(seed * 31 + k), "v", "w", "number")
    keyed = spark.createDataFrame(rows, "v long, w long, number long").select("v", "w", *[drawn(k).alias(f"h{k}") for k in (1, 2, 3)]).collect()
    by_block = {b: sorted((r for r in keyed if r.h1 % blocks == b), key=lambda r: (r.h2, r.h3)) for b in range(blocks)}
    matrix = sharding.communication_matrix([len(by_block[b]) for b in range(blocks)], shards, seed)
    dealt = [[] for _ in range(shards)]
    for b, own in by_block.items():
        place = 0
        for s in range(shards):
            dealt[s] += own[place : place + int(matrix[b, s])]
            place += int(matrix[b, s])
    want = Counter()
    for s, own in enumerate(dealt):
        for slot, r in enumerate(sorted(own, key=lambda r: r.h3 & (2**63 - 1))):
            want[r.v, r.w, s, slot] += 1
    assert got == want
