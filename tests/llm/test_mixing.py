import hashlib
import math
import random
import re

from marketloom.llm import mixing
from marketloom.llm.common import WORD


def targets(sizes, share=1.5, cycle=(5, 2, 1), cap=2):
    """Share by weight, cut at the caps, share the excess again, until none is above."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + ([None] if None in sizes else [])
    w = {n: cycle[i % len(cycle)] for i, n in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[n] for n in free)
        over = {n for n in free if level * w[n] > cap * sizes[n]}
        if not over:
            out |= {n: level * w[n] for n in free}
            break
        for n in over:
            out[n] = cap * sizes[n]
            left -= out[n]
        free -= over
    return out


def test_against_plain_code(spark):
    rng = random.Random(3)
    names = ["b", "a", "é", None, "Z", "tiny", "zero"]
    rows = [(i, " ".join(["w1"] * rng.randint(1, 50)), rng.choice(names[:5])) for i in range(700)]
    rows += [(1000 + i, "x y", "tiny") for i in range(3)] + [(2000, None, "zero"), (2001, "", "zero"), (2002, "q " * 20_000, "a"), (None, "a b", "b"), (7, "w1 w1", "a"), (7, "w1 w1", "a")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, copies int").repartition(4)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    size = lambda t: len(re.findall(WORD, t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = targets(sizes)
    for s in sizes:
        own = [r for r in out if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.source_size == sizes[s] and r.size == size(r.text) for r in own)
        taken = sum(r.size * r.copies for r in own)
        assert abs(taken - want[s]) <= max(r.size for r in own) / 2 + 1e-6
        whole = int(want[s] // sizes[s]) if sizes[s] else 0
        assert all(r.copies in (whole, whole + 1) and r.copies <= 2 for r in own)
        # The fractional epoch takes the smallest keys.
        key = lambda r: -math.log((int(hashlib.md5(f"7|{r.doc_id if r.doc_id is not None else 'null'}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)
        inside = [key(r) for r in own if r.size and r.copies == whole + 1]
        outside = [key(r) for r in own if r.size and r.copies == whole]
        if inside and outside:  # texts of letters and digits have weights that are close, not equal
            assert sorted(inside)[len(inside) // 2] < sorted(outside)[len(outside) // 2]
    again = mixing.mix(df.repartition(2)).collect()
    assert sorted((str(r.doc_id), r.copies) for r in out) == sorted((str(r.doc_id), r.copies) for r in again)


def test_empty_tables_and_sizes(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).collect() == []
    none = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert all(r.size == 0 and r.target == 0 for r in none) and len(none) == 2
