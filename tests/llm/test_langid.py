import math
import random
from collections import defaultdict

import numpy as np

from marketloom.llm import langid


class Tree:
    """The context tree by its definition, a dictionary per context."""

    def __init__(self, texts):
        self.next = defaultdict(lambda: defaultdict(int))
        for t in texts:
            b = [None] * 3 + list(t.encode())
            for i in range(3, len(b)):
                for order in range(4):
                    self.next[tuple(b[i - order : i])][b[i]] += 1

    def bits(self, text):
        b, total = [None] * 3 + list(text.encode()), 0.0
        for i in range(3, len(b)):
            for order in (3, 2, 1, 0, -1):
                if order == -1:
                    total += 8
                    break
                own = self.next.get(tuple(b[i - order : i]))
                if not own:
                    continue
                n, q = sum(own.values()), len(own)
                if b[i] in own:
                    total -= math.log2(own[b[i]] / (n + q))
                    break
                total -= math.log2(q / (n + q))
        return total


def make(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_code_lengths_against_the_tree():
    rng = random.Random(6)
    train = {"aa": [make(rng, ["sch", "ung", "ein", "ü"], 40) for _ in range(5)], "bb": [make(rng, ["tion", "é", "que"], 30) for _ in range(4)], "cc": ["x"]}
    model = langid.fit([(g, t) for g, own in train.items() for t in own])
    texts = ["", "schein", "é", "qué?\n zz", make(rng, ["sch", "tion", "0", "ß"], 50), "x", "\x00\U0001f600", train["aa"][0]]
    data = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(b) for b in data])])
    got = model.bits(np.frombuffer(b"".join(data), np.uint8), at)
    for i, t in enumerate(texts):
        for j, g in enumerate(model.languages):
            assert abs(got[i, j] - Tree(train[g]).bits(t)) < 1e-3 * max(1, len(data[i])), (t, g)


def test_held_out_accuracy_and_edge_cases(spark, tmp_path):
    rng = random.Random(8)
    parts = {"en": ["th", "er", "ing", "an"], "de": ["sch", "er", "ung", "an"], "fr": ["eau", "er", "que", "an"]}
    rows = [(i, make(rng, parts[g], rng.randint(3, 60)), g, "s") for i, g in enumerate(rng.choice(list(parts)) for _ in range(500))]
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "12 34 !?", "de", "s"), (903, "the" * 100_000, None, "s"), (903, "q", "fr", "s"), (None, "ung schan", "de", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = langid.op3_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[900].score == 0
    held = [i for i in range(500) if by[i].held_out]
    assert sum(by[i].lang_pred == rows[i][2] for i in held) / len(held) > 0.97


def test_no_model_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "abc", 5, "z")], "doc_id long, text string, lang_bits int, lang_pred string")
    row = langid.identify(df, None).collect()[0]
    assert (row.lang_pred, row.lang_score, row.lang_bits) == ("und", 0.0, None)
    assert langid.identify(df.limit(0), langid.fit([("en", "abc")])).collect() == []
