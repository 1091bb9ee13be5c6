import random

from marketloom.llm.components import components


def test_against_union_find(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(60)]  # ids in order, and out of order
    mixed = [(rng.randrange(1000, 1080), rng.randrange(1000, 1080)) for _ in range(60)]
    star = [(5000, 5000 + i) for i in range(1, 40)] + [(7, 7)]
    edges = chain + mixed + star
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {v: find(v) for a, b in edges for v in (a, b) if a != b}
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
