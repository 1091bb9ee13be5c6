import random
import time
from collections import Counter

from pyspark.sql import functions as F

from marketloom.llm import jaccard
from marketloom.llm.common import stored


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_stored_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    frames = [stored(spark.range(1000).groupBy((F.col("id") % (n + 7)).alias("k")).count(), "t") for n in range(3)]
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before and [f.count() for f in frames] == [7, 8, 9]


def test_pivots_of_one_component_are_done(spark):
    members = spark.createDataFrame([(p, c, 9, 9, 1, [c]) for p in (2, 20) for c in range(p, p + 10, 2)], "p long, cls long, np long, n long, d long, delta array<long>")
    roots = spark.createDataFrame([(c, 2) for c in range(2, 12, 2)] + [(20, 20), (22, 20)], "v long, root long")
    rows = jaccard._open(members, roots).collect()
    assert sorted((r.cls, r.root, r.p_root) for r in rows) == [(20, 20, 20), (22, 20, 20), (24, 24, 20), (26, 26, 20), (28, 28, 20)]


def test_members_that_link_with_none_are_left_out(spark):
    """Far members of a p that share a passage besides what p has too; two of them link, and near ones stay."""
    p = list(range(100))
    sets = {2: p, 4: p[:95] + [1000, 1001], 6: p[:60] + list(range(2000, 2040)), 8: p[:60] + list(range(2000, 2035)) + list(range(2100, 2105))}
    sets |= {c: p[:60] + list(range(10_000, 10_010)) + list(range(100 * c, 100 * c + 30)) for c in range(30, 60, 2)}
    rows = []
    for c, own in sets.items():
        delta = sorted(set(own) - set(p)) + sorted(set(p) - set(own))
        rows.append((2, c, 100, len(own), delta, len(delta), c, 2))
    rows = spark.createDataFrame(rows, "p long, cls long, np long, n long, delta array<long>, d long, root long, p_root long")
    left = jaccard._may_link(rows, 80)
    assert left.columns == rows.columns and sorted(r.cls for r in left.collect()) == [2, 4, 6, 8]
    assert sorted((r.cls, r.d) for r in left.collect()) == sorted((r.cls, r.d) for r in rows.where("cls < 10").collect())
    assert (6, 8) in {tuple(r) for r in jaccard._by_pivot(left, 80).collect()}


def differences():
    """Members of three p: many that share half of their elements, few far ones, and one alone."""
    rng = random.Random(4)
    rows = [(2, c, rng.sample(range(30), 22) + rng.sample(range(1000, 9000), rng.randint(0, 9))) for c in range(2, 400, 2)]
    rows += [(20, c, rng.sample(range(100), 50)) for c in range(20, 60, 2)] + [(20, 20, []), (80, 80, [1, 2])]
    return [(p, c, sorted(d)) for p, c, d in dict(((p, c), (p, c, d)) for p, c, d in rows).values()]


def test_usual_elements(spark, monkeypatch):
    rows = differences()
    members = spark.createDataFrame([(*r, len(r[2])) for r in rows], "p long, cls long, delta array<long>, d long")
    want = {}
    for at in (2, 20, 80):
        own = [d for p, _, d in rows if p == at]
        want[at] = {t for t, n in Counter(x for d in own for x in d).items() if n > 1 and 2 * n > len(own)}
    got = {r.p: set(r.usual) for r in jaccard._usual(members).collect()}
    assert got == want and len(want[2]) > 20 and want[80] == set()
    pairs = {tuple(sorted((r.a, r.b))) for r in jaccard._centre_stars(members).collect()}
    for at in (2, 20, 80):
        own = [(len(d) - 2 * len(want[at].intersection(d)), c) for p, c, d in rows if p == at]
        assert {(min(c, min(own)[1]), max(c, min(own)[1])) for _, c in own} - {(min(own)[1],) * 2} <= pairs
    monkeypatch.setattr(jaccard, "HELD", 500)  # about ten parts of the first
    parts = {r.p: set(r.usual) for r in jaccard._usual(members).collect()}
    sure = {t for t in range(30) if sum(t in d for p, _, d in rows if p == 2) > 0.65 * 199}
    assert sure <= parts[2] <= set(range(30)) and parts[80] == set()


def test_centres_make_no_row_for_an_element(spark):
    rows = differences()
    members = spark.createDataFrame([(*r, len(r[2])) for r in rows], "p long, cls long, delta array<long>, d long")
    plan = jaccard._centre_stars(members)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(delta" not in plan and "explode(" in plan
