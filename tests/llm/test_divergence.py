import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from marketloom.llm import divergence

TERM = "[^\x00-\x40\x5b-\x60\x7b-\x7f]+"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(rows, least=30, smoothing=5, top=50):
    """The contract by plain loops over (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = re.findall(TERM, text.translate(FOLD))
        found[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = [s for la, s in found if la == lang]
        v = len(kept)
        total = lambda c: sum(c[t] for t in kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + smoothing) // (total(c) + smoothing * v) for t in kept}
        everything = sum((found[lang, s] for s in groups), Counter())
        q, p = share(everything), {s: share(found[lang, s]) for s in groups}
        for s in groups:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if found[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, made, limit in (("pair", pairs, None), ("term", terms, top)):
                made.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(made[:limit])]
    return sorted(out)


def collected(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdeéß漢" for b in ("x", "Y", "zz", "ö", "q")] * 2 + ["rare%s" % chr(97 + i) for i in range(20)]
    names = ["s1", "s2", "ö", "Z", None]
    rows = []
    for _ in range(n):
        source = rng.choice(names)
        own = words[: 8 + 6 * names.index(source)]
        text = " ".join(rng.choice(own) for _ in range(rng.randint(0, 30))) if rng.random() > 0.05 else rng.choice([None, "", "123 !!"])
        rows.append((rng.choice(["en", "de", None]), source, text))
    return rows + [("fr", "only", "a b"), ("fr", "", "c"), ("nl", "alone", None), (None, "nothing", "")]


@pytest.mark.parametrize("least,top", [(30, 50), (3, 4), (1, 1)])
def test_against_plain_loops(spark, least, top):
    rows = corpus(400, 1)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, value int, term string").repartition(5)
    assert collected(divergence.audit(df, least_docs=least, top=top)) == plain_audit(rows, least, 5, top)


@pytest.mark.parametrize("held", [3, 300_000])
def test_tasks_hand_on_sums(monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rows = [(a or "", b or "", c or "") for a, b, c in corpus(120, 4)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows[i : i + 50], strict=True)], names=list("abc")) for i in range(0, len(rows), 50)]
    counts, docs = Counter(), Counter()
    for lang, source, term, n, d in divergence._count_terms(iter(batches)):
        for k, x, y in zip(zip(lang.to_pylist(), source.to_pylist(), term.to_pylist(), strict=True), n.to_pylist(), d.to_pylist(), strict=True):
            counts[k] += x
            docs[k] += y
    want, want_docs = Counter(), Counter()
    for lang, source, text in rows:
        words = re.findall(TERM, text.translate(FOLD))
        want.update((lang, source, w) for w in words)
        want_docs.update((lang, source, w) for w in set(words))
    assert counts == want and docs == want_docs


def test_one_hot_source_and_repeats(spark):
    rows = [("en", "hot", "the cat sat on the mat")] * 500 + [("en", "cold", f"the dog {i % 3}x ran") for i in range(90)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(7)
    assert collected(divergence.audit(df, top=2)) == plain_audit(rows, top=2)


def test_ties_go_by_code_point(spark):
    rows = [("en", s, "é z a Z") for s in ("b", "a", "é", "B")] * 10 + [("en", "c", "other")] * 40
    got = collected(divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string")))
    assert got == plain_audit(rows)
    assert [r[3] for r in sorted(got, key=lambda r: r[5]) if r[1] == "c" and r[2] == "pair"] == ["B", "a", "b", "é"]


def test_shares_are_exact_beyond_64_bits(spark):
    big = [(10**13 + 7, 3 * 10**15 + 11, 12345), (0, 5, 7), (9 * 10**14, 9 * 10**14, 1)]
    df = spark.createDataFrame(big, "c long, n long, v long").select("c", "n", "v", divergence.share("c", "n", "v", 5).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.c + 5) // (r.n + 5 * r.v) for r in df.collect())


def test_odd_tables(spark):
    schema = "lang string, source string, text string"
    assert divergence.audit(spark.createDataFrame([], schema)).collect() == []
    long = " ".join(["word"] * 300_000)
    rows = [("en", "a", long)] + [("en", "b", "word")] * 30
    assert collected(divergence.audit(spark.createDataFrame(rows, schema))) == plain_audit(rows)
