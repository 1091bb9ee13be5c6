"""Nulls, empty and very long texts, ties, repeats, empty tables and odd names, for every operator and stage."""

from collections import Counter

import pytest

import corpus_pipeline
from marketloom.llm import chat, decontaminate, divergence, jaccard, langid, mixing, quality, resampling, search, secrets, sharding, tokenfile, toxicity
from marketloom.llm.common import shared_dir

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `__text` int, `row` int, `size` string, copies string, toxicity string, "
    "toxic_terms int, leaks string, `text_hash` int, `key` int, `v` int, shard string, slot string, spans string, perplexity string, keep string, `limit` string, lang_pred string, "
    "`m` map<string,int>, `s` struct<x:int,y:array<int>>"
)
ITEM = "the quick brown fox jumps over the lazy dog and then runs far away from here"
LONG = " ".join(f"word{i % 4099} and{i % 13}" for i in range(60_000))


def rows():
    rest = lambda i: (f"k{i}", i, i, "big", None, "t", i, "l", i, None, i, "sh", None, "sp", "p", "k", "l", None, {"a": i}, (i, [1, None]))
    texts = [None, "", "  \t", "!!!", "one", "Same words are here in this text of ours", "Same words are here in this text of ours", LONG, f"so {ITEM} yes", "grobnik grobnik grobnik", "password=abcdefgh1 for you"]
    out = [(i, t, "en" if i % 2 else None, "a" if i % 3 else None, None, *rest(i % 4)) for i, t in enumerate(texts)]
    out += [out[5], out[5], (None, "null id words here", "en", "a", 1, *rest(0)), (None, None, None, None, None, *[None] * 20)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, i % 2, int(i == 9)) for i in range(11)] + [(None, 1, 1), (3, None, None), (9, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, ITEM), (1, None), (2, ""), (0, ITEM), (None, "!?")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain(rs):
    return Counter(str(r) for r in rs)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_keep_rows_as_they_are(spark, docs, folder, name, stage):
    out = stage(spark, docs, folder)
    more = ["shard", "slot"] if name == "sharding" else []
    assert out.columns == [c for c in docs.columns if c not in more] + more
    back = docs.select(*[f"`{c}`" for c in docs.columns if c not in more])
    got, had = plain(out.drop(*more).collect()), plain(back.collect())
    assert set(got) <= set(had)
    if name == "sharding":
        assert got == had
    if name in ("toxicity", "benchmark_decontamination"):
        lost = {"toxicity": {"grobnik grobnik grobnik"}, "benchmark_decontamination": {f"so {ITEM} yes"}}[name]
        stays = [r for r in back.collect() if r.text not in lost]
        assert got == plain(stays) or (name == "toxicity" and set(plain(stays)) <= set(got))
    if name == "ngram_jaccard_join":
        ids = Counter((r.doc_id, r.text) for r in out.collect())
        assert max(ids.values()) == 1 and (6, rows()[6][1]) not in ids and {None, "", "  \t", "!!!", "one", LONG} <= {t for _, t in ids}
    none = stage(spark, docs.limit(0), folder)
    assert none.columns == out.columns and none.collect() == []


def test_annotating_operators(spark, docs, folder):
    model = toxicity.fit_tables(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    made = {
        "secrets": (secrets.scan, ["spans"]),
        "langid": (lambda d: langid.identify(d, langid.fit_table(docs)), ["lang_pred", "lang_score", "lang_bits"]),
        "toxicity": (lambda d: toxicity.score(d, model), ["toxicity", "toxic_terms"]),
        "decontaminate": (lambda d: decontaminate.annotate(d, items), ["leaks"]),
        "no items": (lambda d: decontaminate.annotate(d, items.limit(0)), ["leaks"]),
        "mixing": (mixing.mix, ["size", "source_size", "target", "copies"]),
        "sharding": (sharding.shard, ["shard", "slot"]),
    }
    for name, (f, new) in made.items():
        out = f(docs)
        assert sorted(out.columns) == sorted([c for c in docs.columns if c not in new] + new), name
        rest = [f"`{c}`" for c in docs.columns if c not in new]
        assert plain(out.select(*rest).collect()) == plain(docs.select(*rest).collect()), name
        assert f(docs.limit(0)).collect() == [], name
    spans = {r.text: r.spans for r in secrets.scan(docs).collect()}
    assert spans[None] == spans[""] == [] and len(spans["password=abcdefgh1 for you"]) == 1
    leaks = {r.text: [x.item_id for x in r.leaks] for r in decontaminate.annotate(docs, items).collect()}
    assert leaks[f"so {ITEM} yes"] == ["0", "0"] and leaks[None] == leaks[""] == leaks[LONG] == []


def test_quality(spark, docs):
    trusted = spark.createDataFrame([(i,) for i in [*range(11), 5, None]], "doc_id long")
    out = quality.classify(docs, trusted)
    got = out.collect()
    assert len(got) == docs.count() and all(r.perplexity is None and not r.keep for r in got if r.doc_id in (0, 1))
    assert len({r.perplexity for r in got if r.doc_id in (5, 6)}) == 1
    assert quality.classify(docs.limit(0), trusted).collect() == []
    assert all(r.keep == (r.perplexity is not None) for r in quality.classify(docs, trusted.limit(0)).collect())


def test_groups(spark, docs):
    got = jaccard.grouped(docs).collect()
    assert len(got) == docs.count()
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert by[5, 6] == by[6, 6] == 5 and by[0, 0] == 0 and by[None, 0] is None and by[4, 1] == 4
    assert jaccard.grouped(docs.limit(0)).collect() == []


def test_search(spark, docs):
    asked = spark.createDataFrame([(1, "same words"), (1, "same words"), (2, None), (3, ""), (None, "same"), (4, LONG)], "query_id long, text string")
    got = search.top_k(docs, asked).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 1] == [5, 5, 5, 6]  # repeats are documents of their own
    assert {r.query_id for r in got} == {1, 4} and min((r.rank, r.doc_id) for r in got if r.query_id == 4) == (1, 7)
    assert search.top_k(docs.limit(0), asked).collect() == search.top_k(docs, asked.limit(0)).collect() == []


def test_divergence(spark, docs):
    got = divergence.audit(docs, least_docs=1).collect()
    assert {(r.lang, r.source) for r in got} == {("", ""), ("", "a"), ("en", ""), ("en", "a")}
    assert sorted(r["rank"] for r in got if r.part == "term" and (r.lang, r.source) == ("en", "a")) == list(range(1, sum(r.part == "term" and (r.lang, r.source) == ("en", "a") for r in got) + 1))
    assert divergence.audit(docs.limit(0)).collect() == [] and all(r.part == "pair" and r.value == 0 for r in divergence.audit(docs, least_docs=99).collect())


def test_resampling(spark, docs, folder):
    features = resampling.featurize(docs)
    assert features.columns == [*docs.columns, "n_words", "features"]
    target = resampling.featurize(spark.read.parquet(f"{folder}/benchmark.parquet"))
    out = resampling.resample(features, target, percent=100)  # one text has 20 words
    new = ["n_features", "weight", "score", "rank"]
    assert out.columns == [*docs.columns, *new]
    rest = [f"`{c}`" for c in docs.columns]
    assert plain(out.select(*rest).collect()) == plain(docs.select(*rest).collect())
    by = {r.text: r for r in out.collect()}
    assert by[None].n_features == by[""].n_features == by[None].weight == 0 and by[LONG].n_features == 120_000 and by[LONG]["rank"] == 1
    assert resampling.resample(features.limit(0), target).collect() == []


def test_token_files(spark, docs):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    tokenfile.write(docs, f"{shared_dir(spark)}/edges", path, segment=1000)
    got = tokenfile.documents(spark, f"{shared_dir(spark)}/edges").collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows()) and max(r.n_tokens for r in got) > 120_000
    assert {r.n_tokens for r in got if r.doc_id in (0, 1, 2)} == {1}


def test_conversations(spark):
    turns = [(2**60, 0, "user", "q"), (2**60, 1, "assistant", "yes " * 50_000), (2**60 + 1, 0, "user", "q"), (2**60 + 1, None, None, None), (4, 0, "user", "alone"), (None, 0, "user", "lost"), (-2, 0, "user", "a"), (-1, 0, "user", "a"), (-1, 0, "user", "a")]
    convs = chat.conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    pairs = chat.pair_by_id(convs)
    assert {(r.chosen_id, r.rejected_id) for r in pairs.collect()} == {(2**60, 2**60 + 1), (-2, -1)}
    out = chat.preference_format(pairs.withColumnsRenamed({"chosen_id": "a.b", "rejected_id": "Prompt"}))
    assert out.columns[0] == "a.b" and len(out.collect()) == 2
    assert chat.preference_format(pairs.limit(0)).collect() == chat.pair_by_id(convs.limit(0)).collect() == []
