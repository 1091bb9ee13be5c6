import random
import re

from marketloom.llm import jaccard, textnp
from marketloom.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def brute(rows, percent=85):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (i, len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=260):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeÉß") for _ in range(rng.randint(1, 3)))
    out = []
    while len(out) < n:
        size = rng.choice([0, 1, 2, 3, 4, 5, 7, 9, 10, 12, 15, 20, 40, 90, 200])
        base = [word() for _ in range(size)]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                if w:
                    kind, at = rng.randrange(4), rng.randrange(len(w))
                    if kind == 0:
                        w[at] = word()
                    elif kind == 1:
                        del w[at]
                    elif kind == 2:
                        w.insert(at, word())
                    else:
                        w = w + [word()]
            out.append("  ".join(w).upper() if rng.random() < 0.2 else "\n".join(w))
    out += [None, "", " \t\n", "x", "x", "X"]
    return list(enumerate(out))


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, cls string, key int").repartition(3)
        got = {r.doc_id: tuple(r) for r in jaccard.grouped(df).drop("text_hash").collect()}
        assert got == brute(rows)
        assert len({x[2] for x in got.values()}) < len(rows) - 20


def test_large_group_of_near_copies(spark, monkeypatch):
    """A base and many edited copies, around the threshold; chains of edits too."""
    monkeypatch.setattr(jaccard, "FEW", 2)
    rng = random.Random(7)
    for size in (40, 150):
        base = [f"w{rng.randrange(3000)}" for _ in range(size)]
        rows, last = [" ".join(base)], list(base)
        for i in range(170):
            w = list(base if i % 3 else last)
            for _ in range(rng.randint(0, 1 + size // 18)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = [f"w{rng.randrange(3000)}"] * rng.randint(0, 2)
            if not i % 3:
                last = w
            rows.append(" ".join(w))
        rows = list(enumerate(rows))
        rng.shuffle(rows)
        got = {r.doc_id: tuple(r) for r in jaccard.grouped(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).drop("text_hash").collect()}
        assert got == brute(rows)
        assert 5 < len({x[2] for x in got.values()}) < 171


def test_every_link_shares_a_key():
    """Pairs at the edge of the threshold, for every size: they must share an index key."""
    import numpy as np

    rng = np.random.default_rng(5)
    for n in [*range(5, 60), 75, 99, 100, 151, 228, 400, 900]:
        for _ in range(6):
            for m in {n, n + int(rng.integers(0, n // 5 + 1))}:
                most = jaccard.most_differing(n + m, 85)
                if (n + m - most) % 2:
                    most -= 1
                common = (n + m - most) // 2
                if most == 0 or most < m - n or common > n or 100 * common < 85 * (n + m - common):
                    continue
                pool = rng.integers(0, 2**63, n + m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n : n + m - common]]))
                x, y = (np.concatenate([k for k, _ in jaccard.keys(z, 85)]) for z in (a, b))
                assert len(np.intersect1d(x, y)), (n, m, most)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.grouped(df).collect() == []


def test_nulls_and_repeated_rows(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (4, None), (None, "q r s t"), (5, "")]
    got = sorted(map(tuple, jaccard.grouped(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_hash").collect()), key=str)
    assert got == sorted([(None, 2, 3), (3, 2, 3), (3, 2, 3), (4, 0, 4), (None, 1, None), (5, 0, 5)], key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (200, 199)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 199: 199, 200: 199}


def test_shingles_of_words():
    import pyarrow as pa

    texts = ["A b\x0bc", None, "", "a  b c", "é a b c d", "é a b c d x y"]
    column = pa.array(texts)
    for chunk in (1, 8, 1 << 20):
        got = []
        for first, end, data, at in textnp.pieces(column, chunk):
            w, t, s, e = textnp.words(data, at)
            h, b = textnp.shingles(w, t, end - first, 4)
            got += [frozenset(h[b[i] : b[i + 1]].tolist()) for i in range(end - first)]
        assert [len(x) for x in got] == [len(shingle_set(t)) for t in texts]
        assert got[0] == got[3] and got[4] < got[5]


def test_deduplicated(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "a"), (2, long + " x", "b"), (3, "p q r s t", "c"), (3, "p q r s t", "c"), (3, long, "d"), (4, None, "e"), (5, "", "f"),
            (None, long, "g"), (None, "only here it is", "h"), (None, "only here it is", "h"), (6, "P q r s t", "i")]
    got = jaccard.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, cls string")).collect()
    assert sorted((r.doc_id or -1, r.cls) for r in got) == [(-1, "h"), (1, "a"), (3, "c"), (4, "e"), (5, "f")]
