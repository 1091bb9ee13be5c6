import random

import numpy as np

from marketloom.llm import decontaminate as dc


def plain_distance(item, text):
    """Sellers' recurrence, cell by cell."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_distance_against_recurrence():
    rng = random.Random(1)
    for _ in range(400):
        item = "".join(rng.choice("abé ") for _ in range(rng.randint(1, 70)))
        text = "".join(rng.choice("abé ") for _ in range(rng.randint(0, 90)))
        if rng.random() < 0.5:
            at = rng.randrange(len(item))
            text = text[:20] + item[:at] + rng.choice(["", "z", "ab"]) + item[at + rng.randint(0, 2) :] + text[20:]
        assert dc.distance_inside(item, text) == plain_distance(item, text)


def sentences(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ru", "té", "shin"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def edited(rng, x, share):
    """x with so many characters inserted, deleted or replaced at random places."""
    c = list(x)
    for at in rng.sample(range(len(c)), int(share * len(c))):
        c[at] = rng.choice(["", "q" + c[at], "z", "é"])
    return "".join(c)


def whole(x, t):
    """Short items are looked for as words."""
    return (f" {x} ", f" {t} ") if len(x) < dc.SHORT else (x, t)


def test_recall_and_precision_against_brute_force(spark):
    # Items of one word to seventy, edited up to the bound, against plain dynamic programming over all items.
    rng = random.Random(9)
    items = [(i, sentences(rng, rng.choice([1, 2, 4, 6, 12, 20, 30, 45]))) for i in range(40)] + [(90, None), (91, ""), (92, "lo"), (93, "?!")]
    items += [(94, items[3][1])]
    docs = []
    for d in range(120):
        text = sentences(rng, rng.randint(0, 60))
        if d % 2:
            own = edited(rng, items[rng.randrange(40)][1], rng.choice([0, 0.05, 0.1, 0.15, 0.19]))
            cut = rng.randint(0, len(text))
            text = text[:cut] + " " + own.upper().replace("É", "é").replace(" ", rng.choice([" ", ",\n"])) + ". " + text[cut:]
        docs.append((d, text, "l"))
    docs += [(200, None, "l"), (201, "", "l"), (201, items[5][1] * 3, "l"), (None, items[7][1], "l"), (202, sentences(rng, 60_000) + " " + items[6][1], "l")]
    df = spark.createDataFrame(docs, "doc_id long, text string, leaks string").repartition(4)
    rows = dc.annotate(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(rows) == len(docs)
    got = {(r.doc_id, int(x.item_id)): x for r in rows for x in r.leaks}
    flat = {i: dc.normal(t) for i, t in items if t and dc.normal(t)}
    texts = {d: dc.normal(t) for d, t, _ in docs[:120]}
    want = {(d, i) for d, t in texts.items() if d % 2 and t for i, x in flat.items() if 1 - plain_distance(*whole(x, t)) / len(x) >= dc.SIMILAR}
    seen = {k for k in got if k[0] is not None and k[0] in texts and k[0] % 2}
    assert seen <= want and len(want) > 100
    assert len(want & seen) / len(want) >= 0.97
    long = {(d, i) for d, i in want if len(flat[i]) >= 40}
    assert len(long) > 20 and len(long & seen) / len(long) >= 0.95
    exact = {(d, i) for d, t in texts.items() for i, x in flat.items() for a, b in [whole(x, t)] if a in b}
    assert exact <= set(got)
    assert (None, 7) in got and (202, 6) in got and (201, 5) in got
    assert all(((d, 94) in got) == ((d, 3) in got) for d, _, _ in docs)


def test_blocks_and_empty_tables(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, sentences(rng, 20)) for i in range(12)]
    docs = spark.createDataFrame([(i, "x " + t + " y") for i, t in items], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 5)
    got = {(r.doc_id, x.item_id) for r in dc.annotate(docs, table).collect() for x in r.leaks}
    assert got == {(i, str(i)) for i in range(12)}
    assert [r.leaks for r in dc.annotate(docs, table.limit(0)).collect()] == [[]] * 12
    assert dc.annotate(docs.limit(0), table).collect() == []
    assert dc.Index([]).leaks(np.frombuffer(b"a b", np.uint8), np.array([0, 3])) == [{}]


def test_edited_characters():
    # A typo in every third word, or characters edited anywhere up to the bound.
    rng = random.Random(6)
    parts = ["ka", "lo", "mi", "ru", "té", "shin", "br", "og", "ul", "vest", "na", "di"]
    text = lambda n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))
    items = [(i, text(rng.randint(15, 59))) for i in range(60)]
    texts = []
    for i, x in items:
        c, bounds = list(x), [0, *(k + 1 for k, ch in enumerate(x) if ch == " ")]
        at = bounds[:: rng.choice([3, 4])] if i % 2 else rng.sample(range(len(c)), int(0.19 * len(c)))
        for k in at:
            c[k] = rng.choice("zéq")
        texts.append(text(80) + " " + "".join(c) + " " + text(80))
    raw = [t.encode() for t in texts]
    found = dc.Index(items).leaks(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    near = [i for i, x in items if 1 - dc.distance_inside(x, texts[i]) / len(x) >= dc.SIMILAR]
    assert len(near) == 60 and sum(i in found[i] for i in near) >= 58
    for own, t in zip(found, texts, strict=True):
        assert all(d == dc.distance_inside(items[i][1], t) for i, (d, _) in own.items())


def test_edits_spread_evenly():
    # The same edit in every word or every fifth character leaves no long run whole.
    rng = random.Random(8)
    parts = ["ka", "lo", "mi", "ru", "te", "shin", "br", "og", "ul", "vest", "na", "di"]
    text = lambda n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))
    letter = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz")
    items = [(i, text(rng.randint(15, 59))) for i in range(40)]
    index = dc.Index(items)
    in_words = lambda at: lambda x: " ".join(w[: at(w)] + letter() + w[at(w) + 1 :] for w in x.split())
    in_places = lambda made: lambda x: "".join(made(c) if i % 5 == 4 and c != " " else c for i, c in enumerate(x))
    kinds = [in_words(lambda w: 0), in_words(lambda w: len(w) // 2), in_words(lambda w: len(w) - 1)]
    kinds += [in_places(lambda c: letter()), in_places(lambda c: letter() + c), in_places(lambda c: "")]
    for kind in kinds:
        texts = [text(80) + " " + kind(x) + " " + text(80) for _, x in items]
        raw = [t.encode() for t in texts]
        found = index.leaks(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        near = [i for i, x in items if 1 - dc.distance_inside(x, dc.normal(texts[i])) / len(x) >= dc.SIMILAR]
        assert len(near) > 20 and sum(i in found[i] for i in near) >= 0.95 * len(near)


def test_short_items_are_whole_words():
    texts = ["the party began", "art", "modern ART, here", "an apples", "pineapples", "starts with a", "art"]
    raw = [t.encode() for t in texts]
    index = dc.Index([(0, "art"), (1, "a"), (2, "apple")])
    found = index.leaks(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert found == [{}, {0: (0, 0)}, {0: (0, 1)}, {2: (1, 1)}, {}, {1: (0, 2)}, {0: (0, 0)}]


def test_items_longer_than_a_million():
    rng = random.Random(12)
    item = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_100_000))
    index = dc.Index([("short", item[-30:]), ("long", item)])
    code = np.frombuffer(item[-500:].encode(), np.uint8)
    assert {(int(i), int(d)) for i, d in zip(*index.candidates(code), strict=True)} == {(0, 470), (1, 500 - 1_100_000)}
    data = ("x " + item + " y").encode()
    (found,) = index.leaks(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert {i: d for i, (d, _) in found.items()} == {0: 0, 1: 0} and found[1] == (0, 1)
