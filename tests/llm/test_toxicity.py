import random
import time
import zlib

from marketloom.llm import toxicity as tox


def brute(model, text):
    """Every term looked for at every word start, without an automaton."""
    f, out = tox.fold(text), []
    spared = [(i, i + len(p)) for p in model.exceptions for i in range(len(f)) if f.startswith(p, i)]
    for i in range(len(f)):
        if i and f[i - 1].isalpha():
            continue
        here = [t for t in model.weights if f.startswith(t, i)]
        if here and not any(a <= i < b for a, b in spared):
            t = max(here, key=len)
            out.append((i, i + len(t), t))
    return out


def test_folding_keeps_length_and_finds_disguise():
    m = tox.ToxicModel({"idiot": 5.0, "trash": 4.0, "idio": 3.0}).matcher()
    for text in ("You 1D10T!", "іdіоt", "ＩＤＩＯＴ", "an idi0ts"):
        assert len(tox.fold(text)) == len(text)
        assert [t for _, _, t in m.matches(tox.fold(text))] == ["idiot"], text
    assert m.matches(tox.fold("a trash can and videoidiot")) == []
    assert [t for _, _, t in m.matches("trash cans are trash")] == ["trash"]


def test_matches_against_brute_force():
    rng = random.Random(2)
    model = tox.ToxicModel({"abca": 1.0, "abcab": 2.0, "bbbb": 3.0, "cabc": 1.5}, ("abcab cc", "bbbb"))
    for _ in range(300):
        text = "".join(rng.choice("aAbBcC 48.") for _ in range(rng.randint(0, 60)))
        assert model.matcher().matches(tox.fold(text)) == brute(tox.ToxicModel(model.weights, ("abcab cc",)), text)


def test_many_exceptions_take_linear_time():
    m = tox.ToxicModel({"trash": 4.0}).matcher()
    text = "trash can " * 100_000 + "trash"
    begun = time.process_time()
    assert m.matches(text) == [(1_000_000, 1_000_005, "trash")]
    assert time.process_time() - begun < 10


def test_held_out_accuracy_and_edge_cases(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ta", "ri", "no", "se", "lu", "mek"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(900):
        w = [word() for _ in range(rng.randint(5, 200))]
        y = int(rng.random() < 0.25)
        for _ in range(y * (2 + len(w) // 60)):
            w.insert(rng.randrange(len(w)), rng.choice(["grobnik", "zl0pper", "Grobnik"]))
        docs.append((i, " ".join(w), "x", "s", 0))
        labels.append((i, 1, y))
    docs += [(1000, None, None, None, None), (1001, "", "x", "s", 0), (1002, "grobnik " * 60_000, "x", "s", 0), (1002, "x", "x", "s", 0), (None, "a", "x", "s", 0)]
    labels += [(3, None, None), (None, 1, 1), (5, 1, labels[5][2])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = tox.op10_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    got = {r.doc_id: r for r in rows}
    for i in range(900):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [i for i in range(900) if got[i].held_out]
    assert len(held) > 100
    assert sum(got[i].predicted == labels[i][2] for i in held) / len(held) > 0.98
    assert got[1000].score == got[1001].score < 0.5


def test_no_labels_and_clashing_names(spark):
    model = tox.fit([("a", 0)])
    df = spark.createDataFrame([(1, "idiot", 0.3, "t")], "doc_id long, text string, toxicity double, toxic_terms string")
    row = tox.score(df, model).collect()[0]
    assert row.toxicity < 1e-6 and row.toxic_terms == []
    assert tox.score(df.limit(0), model).collect() == []
