"""Language identification by prediction by partial matching over bytes.

Each language has a byte context tree of variable order with frozen counts.
A byte is coded in its longest context that the tree holds; if it never
followed there, the escape is paid and the context loses its first byte, down
to 1/256 for a byte without any context.  Escape probability is q / (n + q)
for n uses and q kinds of next byte (method C).  The language with the
shortest code for the whole text wins.

For use, each tree is laid out as tables over byte classes (the bytes of the
training texts, the start of a text, and one class for the rest): a dense one
of code lengths up to order 2, a dense one of order-3 escapes, and a hash table
with the order-3 code lengths of every four-byte string seen in training.
Their sum is exactly the code length above.

The trees are fit on a bounded sample of whole documents: about SAMPLE_DOCS
per language, fewer if there are more than 20 languages or if documents are so
long that they go beyond SAMPLE_BYTES.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm import textnp as tn
from marketloom.llm.common import columns, fresh, held_out, map_batches

#: Documents per language in the training sample, about, and in all.
SAMPLE_DOCS, SAMPLE_ALL = 300, 6000
#: Bytes of their texts: a language's documents are taken whole, in order of a
#: hash, until they have its part of so many (so one document more at most).
SAMPLE_BYTES = 40_000_000
#: Bits per byte are multiplied by this before they become probabilities.
SHARPNESS = 20.0
UNDETERMINED = "und"


def _contexts(symbols: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """Symbol classes 1, 2, ... order bytes before each byte; 0 before the text."""
    out = []
    for j in range(1, order + 1):
        before = np.zeros_like(symbols)
        before[j:] = symbols[:-j] if j else symbols
        starts = at[:-1]
        for i in range(j):
            where = starts + i
            before[where[where < at[1:]]] = 0
        out.append(before)
    return out


def _codes(symbols: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """Codes of the 1- to 4-byte strings that end at each byte."""
    s = symbols.astype(np.int64)
    out, scale = [s], size
    for before in _contexts(s, at, 3):
        out.append(out[-1] + before * scale)
        scale *= size
    return out


@dataclass
class LanguageModel:
    """Tables of all languages; column l of each is languages[l]."""

    languages: list[str]
    classes: np.ndarray  # byte -> class
    size: int  # number of classes
    low: np.ndarray  # code of 3 bytes -> code lengths up to order 2
    escape: np.ndarray  # code of 3 bytes of context -> order-3 escape
    seen: tn.Lookup  # codes of 4 bytes; row 0 is for others
    high: np.ndarray  # row -> code lengths

    def bits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length of each text under each language; empty texts have 0."""
        out = np.zeros((len(at) - 1, len(self.languages)))
        if not len(data):
            return out
        _, _, three, four = _codes(self.classes[data], at, self.size)
        row = self.seen.rows(four)
        cost = self.high[row]
        missed = np.flatnonzero(row == 0)
        cost[missed] = self.low[three[missed]] + self.escape[four[missed] // self.size]
        full = np.flatnonzero(at[1:] > at[:-1])
        out[full] = np.add.reduceat(cost, at[:-1][full], axis=0, dtype=np.float64)
        return out


def fit(rows: Iterable[tuple[str, str]]) -> LanguageModel | None:
    """The model of (language, text) rows; None without any."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in rows:
        if lang is not None and text:
            texts.setdefault(lang, []).append(text.encode())
    if not texts:
        return None
    languages = sorted(texts)
    used = np.unique(np.frombuffer(b"".join(b for own in texts.values() for b in own), np.uint8))
    size = len(used) + 2
    classes = np.full(256, size - 1, np.int64)
    classes[used] = np.arange(1, len(used) + 1)

    counted, all_four = [], []
    for lang in languages:
        at = np.concatenate([[0], np.cumsum([len(b) for b in texts[lang]])])
        codes = _codes(classes[np.frombuffer(b"".join(texts[lang]), np.uint8)], at, size)
        counted.append([np.unique(c, return_counts=True) for c in codes])
        all_four.append(counted[-1][3][0])
    keys = np.concatenate([[-1], np.unique(np.concatenate(all_four))])
    k = len(languages)
    low = np.empty((size**3, k), np.float32)
    escape = np.zeros((size**3, k), np.float32)
    high = np.zeros((len(keys), k), np.float32)
    for i, orders in enumerate(counted):
        cost = np.full(size, 8.0)  # order -1: any of 256 bytes
        for order, (code, count) in enumerate(orders):
            context = code // size
            seen, first = np.unique(context, return_index=True)
            n = np.add.reduceat(count, first)
            q = np.diff(np.append(first, len(code)))
            where = np.searchsorted(seen, context)
            known = -np.log2(count / (n + q)[where])
            leave = -np.log2(q / (n + q))
            if order == 3:
                low[:, i] = cost
                escape[seen, i] = leave
                own = keys[1:]
                high[1:, i] = cost[own % size**3] + escape[own // size, i]
                high[np.searchsorted(keys, code), i] = known
            else:
                wide = np.tile(cost, size) if order else cost.copy()
                # Codes with the same context are size apart in runs.
                wide.reshape(-1, size)[seen] += leave[:, None]
                wide[code] = known
                cost = wide
    return LanguageModel(languages, classes, size, low, escape, tn.Lookup(keys[1:]), high)


def fit_table(docs: DataFrame) -> LanguageModel | None:
    """Fit on a bounded sample outside the held-out fifth, chosen by text hash.
    Null and empty texts say nothing; equal texts of a language count once."""
    known = docs.where("lang is not null").where(~held_out()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("text <> ''")
    count = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not count:
        return None
    each = min(SAMPLE_DOCS, max(1, SAMPLE_ALL // len(count)))
    shares = F.create_map(*[F.lit(x) for lang, n in sorted(count.items()) for x in (lang, min(1.0, each / n))])
    hashed = known.withColumn("hash", F.xxhash64("text"))
    drawn = hashed.where(F.pmod("hash", F.lit(1 << 20)) < F.element_at(shares, F.col("lang")) * (1 << 20))
    sizes = drawn.groupBy("lang", "hash").agg(F.max(F.octet_length("text")).cast("long").alias("size"))
    before = Window.partitionBy("lang").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    keys = sizes.where(F.col("before") < SAMPLE_BYTES // len(count)).select("lang", "hash")
    some = hashed.join(F.broadcast(keys), ["lang", "hash"]).select("lang", "text").distinct()
    return fit(sorted((r["lang"], r["text"]) for r in some.collect()))


def identify(df: DataFrame, model: LanguageModel | None) -> DataFrame:
    """df with lang_pred, lang_score (0 to 1) and lang_bits (code length per byte).

    A null text, one without a letter, or any text without a model is "und"
    with score 0 and null bits.  Whole texts of any length are scored.  Ties go
    to the first language by code point; repeated rows get equal answers; an
    empty table gives an empty table.  Input columns with these three names are
    replaced; others may have any names.
    """
    made = ("lang_pred", "lang_score", "lang_bits")
    df = df.select(*columns(df, made))
    kept = len(df.columns)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_bits", T.DoubleType())])
    df = df.select(*columns(df), F.when(letters, F.col("text").cast("string")).alias(fresh(df, "read")))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        model = shared.value
        for batch in batches:
            text = batch.column(kept)
            none = np.asarray(text.is_null()) if model is not None else np.ones(len(text), bool)
            best, score, bits = np.zeros(len(text), int), np.zeros(len(text)), np.zeros(len(text))
            if model is not None:
                for first, end, data, at in tn.pieces(text):
                    per = model.bits(data, at) / np.maximum(np.diff(at), 1)[:, None]
                    won = per.argmin(axis=1)
                    least = per[np.arange(end - first), won]
                    best[first:end], bits[first:end] = won, least
                    score[first:end] = 1 / np.exp2(-SHARPNESS * (per - least[:, None])).sum(axis=1)
            names = np.array([*(model.languages if model is not None else []), UNDETERMINED], dtype=object)
            best[none] = len(names) - 1
            score[none] = 0.0
            new = [pa.array(names[best], pa.string()), pa.array(score), pa.array(bits, mask=none)]
            yield [*batch.columns[:kept], *new]

    return map_batches(df, run, schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_table(docs.select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_bits")
