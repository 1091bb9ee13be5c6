import random
from zlib import crc32

import numpy as np
import pytest

from marketloom.llm import tokenfile
from marketloom.llm.common import shared_dir

PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.mark.parametrize("high", [1, 200, 256, 257, 49_408, 1 << 20, 1 << 32])
@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 511, 512, 513, 5000])
def test_round_trip(n, high):
    ids = np.random.default_rng(n + high).integers(0, high, n).astype(np.uint32)
    codes = tokenfile.Codes(tokenfile.encode(ids))
    assert len(codes) == n and codes.between(0, n).tolist() == ids.tolist()
    at = np.random.default_rng(1).permutation(n)
    assert codes.get(at).tolist() == ids[at].tolist()
    for low, end in [(0, 0), (n // 3, n // 2), (n // 2, n), (n, n)]:
        assert codes.between(low, end).tolist() == ids[low:end].tolist()
    with pytest.raises(IndexError):
        codes.get([n])


def test_levels_take_only_ids_that_go_on():
    ids = np.array([5, 300, 70_000, 255, 256], np.uint32)
    codes = tokenfile.Codes(tokenfile.encode(ids))
    assert [len(x[0]) for x in codes.levels] == [5, 3, 1]
    with pytest.raises(ValueError):
        tokenfile.Codes(b"none" + bytes(20))


TEXTS = [
    None, "", "  ", "Hello  World", "it's <|endoftext|> x<|startoftext|>y", "é ́a É\tTab\nline\r\nend", "ΣΣ İI", "\x1c a\x1db \x85c\xa0d 　e",
    "12 345 !!?", "漢字 ไทย \U0001f600\U0001f600", "word " * 70_000, "x" * 40_000, "same text", "same text",
]


def test_words_once_give_the_ids_of_whole_texts():
    direct = tokenfile._tokenizer(PATH)
    encoder = tokenfile.WordEncoder(PATH)
    for texts in (TEXTS, TEXTS[::-1]):
        for text, ids in zip(texts, encoder.ids_of([(t or "").encode() for t in texts]), strict=True):
            assert ids.tolist() == direct.encode(text or "", add_special_tokens=False).ids, text[:40]
    rng = random.Random(2)
    marks = ["a", "B", "'s", " ", "  ", "́", "é", "-", "1", "<|endoftext|>", "<|ENDOFTEXT|>", "\n", "ᄀ", "ᅡ", "‍", "ß", "ﬁ"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    for text, ids in zip(texts, encoder.ids_of([(t or "").encode() for t in texts]), strict=True):
        assert ids.tolist() == direct.encode(text, add_special_tokens=False).ids, repr(text)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokenfile, "REMEMBERED", 10)
    encoder, direct = tokenfile.WordEncoder(PATH), tokenfile._tokenizer(PATH)
    for k in range(5):
        texts = [f"w{k}{i} and {i}" for i in range(8)]
        assert [x.tolist() for x in encoder.ids_of([t.encode() for t in texts])] == [direct.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(encoder.words) < 40


@pytest.mark.parametrize("segment", [3, 500, 1 << 16])
def test_files_against_plain_encoding(spark, segment):
    rows = [(i * 7 % 1000, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (None, None), (5, "twin"), (5, "twin"), (-3, "first")] + [(50, "hot row")] * 400
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, part string, codes int").repartition(6)
    path = f"{shared_dir(spark)}/tokens-{segment}"
    tokenfile.write(df, path, PATH, segment=segment)
    got = sorted(tokenfile.documents(spark, path).collect(), key=lambda r: r.start)
    assert len(got) == len(rows) and [r.doc_id for r in got][:2] == [None, None]
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids)
    direct = tokenfile._tokenizer(PATH)
    want = {}
    for name, text in rows:
        x = np.array([*direct.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(name, []).append((len(x), crc32(x.tobytes())))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert not any(want.values())
    asked = [(-3, 0), (-3, 1), (-3, 9), (-3, -1), (78, 0), (None, 0), (10 * 7, 123), (10 * 7, 69_999), (70, 123)]
    found = tokenfile.lookup(spark.createDataFrame(asked, "doc_id long, at long"), path).collect()
    first, word = direct.encode("first").ids, direct.encode("word").ids[0]
    assert sorted(map(tuple, found), key=str) == sorted([(-3, 0, first[0]), (-3, 1, 1), (-3, 9, None), (-3, -1, None), (78, 0, None), (None, 0, None), (70, 123, word), (70, 123, word), (70, 69_999, word)], key=str)


def test_no_documents(spark):
    path = f"{shared_dir(spark)}/tokens-none"
    tokenfile.write(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert tokenfile.documents(spark, path).collect() == []
    assert tokenfile.lookup(spark.createDataFrame([(1, 0)], "doc_id long, at long"), path).collect() == [(1, 0, None)]
