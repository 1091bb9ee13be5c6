"""Toxicity by a weighted lexicon, matched with Aho-Corasick.

Text is folded first, one code point to one: case, homoglyphs of other
scripts, and digits and signs written for letters.  A term matches at the
start of a word.  Matches inside an exception phrase don't count.  The sum of
the weights of the matches, over the square root of the length in words, goes
through a logistic curve.

Terms are word beginnings that toxic labelled documents use more often than
clean ones for certain; weights are the logarithms of that ratio of rates.  The model is fit
on a bounded sample of labelled rows (SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES); every
document is scored over its whole text.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm.common import columns, held_out, map_batches, text_at

#: Labelled documents that a fit reads, about: bounds of the driver's sample.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 3000
#: Bytes of their texts, for each label: documents are taken whole, in order of a
#: hash, until they have so many (so one document more at most).
SAMPLE_BYTES = 16_000_000
#: Rows of a batch that Python strings are made of at a time.
ROWS = 512
#: Terms are this long.
SHORTEST, LONGEST = 4, 10
#: Least lower bound (two standard errors) of a term's log ratio.
CERTAIN = 1.75

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
#: Digits and signs written for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Phrases in which a term is harmless (folded).
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "clown fish", "clownfish", "pathetic fallacy", "stupid simple", "moronic acid", "idiot proof", "idiot-proof",
)


class _Fold(dict):
    def __missing__(self, code: int) -> int:
        c = chr(code)
        flat = unicodedata.normalize("NFKC", c)
        c = flat if len(flat) == 1 else c
        low = c.lower()
        c = low if len(low) == 1 else c
        c = HOMOGLYPHS.get(c, DIGITS.get(c, c))
        self[code] = ord(c)
        return self[code]


_FOLD = _Fold()


def fold(text: str) -> str:
    """Same length in code points as text."""
    return text.translate(_FOLD)


@dataclass
class ToxicModel:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    intercept: float = -20.0
    slope: float = 0.0

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    """The automaton of a model; made where it is used."""

    def __init__(self, model: ToxicModel):
        import ahocorasick

        self.model = model
        self.terms = ahocorasick.Automaton()
        for term in model.weights:
            self.terms.add_word(term, term)
        for phrase in model.exceptions:
            if phrase not in model.weights:
                self.terms.add_word(phrase, "\0" + phrase)
        self.ready = bool(len(self.terms))
        if self.ready:
            self.terms.make_automaton()

    def matches(self, folded: str) -> list[tuple[int, int, str]]:
        """(start, end, term); of terms that start together, the longest."""
        if not self.ready:
            return []
        found: dict[int, tuple[int, str]] = {}
        spared = []
        for last, term in self.terms.iter(folded):
            if term[0] == "\0":
                spared.append((last + 2 - len(term), last + 1))
                continue
            start = last + 1 - len(term)
            if start and folded[start - 1].isalpha():
                continue
            if start not in found or found[start][0] < last + 1:
                found[start] = (last + 1, term)
        out, until, k = [], 0, 0
        spared.sort()
        for start, (end, term) in sorted(found.items()):
            while k < len(spared) and spared[k][0] <= start:
                until, k = max(until, spared[k][1]), k + 1
            if start >= until:
                out.append((start, end, term))
        return out

    def feature(self, text: str) -> tuple[float, list[tuple[int, int, str]]]:
        got = self.matches(fold(text))
        raw = sum(self.model.weights[t] for _, _, t in got)
        return (raw / math.sqrt(len(text.split()) + 25) if raw else 0.0), got

    def score(self, x: float) -> float:
        z = self.model.intercept + self.model.slope * x
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _beginnings(text: str) -> tuple[Counter[str], int]:
    """Occurrences of each beginning of a word, and the number of words."""
    own = Counter("".join(c if c.isalpha() else " " for c in fold(text)).split())
    out: Counter[str] = Counter()
    for w, k in own.items():
        for n in range(SHORTEST, min(len(w), LONGEST) + 1):
            out[w[:n]] += k
    return out, sum(own.values())


def fit(rows: Iterable[tuple[str, int]]) -> ToxicModel:
    """The model of labelled texts; without both labels, one that scores 0."""
    texts = {t: int(y) for t, y in rows if t and y is not None}
    if len(set(texts.values())) < 2:
        return ToxicModel()
    uses, docs, total = (Counter(), Counter()), (Counter(), Counter()), [1, 1]
    least = max(3, sum(texts.values()) // 200)
    for y in (1, 0):  # toxic ones first: only their beginnings matter
        for t in (t for t, label in texts.items() if label == y):
            own, n = _beginnings(t)
            total[y] += n
            for p, k in own.items():
                if y or p in docs[1]:
                    uses[y][p] += k
                    docs[y][p] += 1
        if y:
            for p in [p for p, n in docs[1].items() if n < least]:
                del docs[1][p], uses[1][p]
    lift = {}
    for p, n in docs[1].items():
        ratio = math.log((uses[1][p] + 0.5) / total[1]) - math.log((uses[0][p] + 0.5) / total[0])
        if ratio - 2 * math.sqrt(1 / (n + 0.5) + 1 / (docs[0][p] + 0.5)) >= CERTAIN:
            lift[p] = ratio
    # A longer beginning stands beside a shorter one only if it says more.
    weights: dict[str, float] = {}
    for p in sorted(lift, key=lambda p: (len(p), p)):
        above = max((weights[p[:k]] for k in range(SHORTEST, len(p)) if p[:k] in weights), default=0.0)
        if lift[p] > above + 0.7 or not above:
            weights[p] = round(lift[p], 6)
    model = ToxicModel(weights)
    m = model.matcher()
    x = np.array([m.feature(t)[0] for t in texts])
    y = np.array(list(texts.values()), dtype=float)
    model.intercept, model.slope = _logistic(x, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Ridge logistic regression on one feature, by damped Newton steps."""
    design, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    penalty = ridge * len(y) * np.array([1e-3, 1e-2])
    loss = lambda b: float(np.sum(np.logaddexp(0, design @ b) - y * (design @ b)) + 0.5 * penalty @ (b * b))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (p - y) + penalty * beta
        hessian = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(penalty)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return round(float(beta[0]), 9), round(float(beta[1]), 9)


def fit_tables(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Fit on a bounded sample of labelled rows outside the held-out fifth.

    A document with several labels is toxic if one says so.  The sample is a
    fixed share of each label, by a hash of doc_id, as far as SAMPLE_BYTES
    reaches.  Texts of any length may be in it; null and empty ones say nothing.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, SAMPLE_TOXIC / max(1, count.get(1, 0)))).otherwise(min(1.0, SAMPLE_CLEAN / max(1, count.get(0, 0))))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text <> ''")
    sizes = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.max(F.octet_length("text")).cast("long").alias("size"))
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ids = sizes.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).where(F.col("before") < SAMPLE_BYTES).select("doc_id", "toxic")
    rows = texts.join(F.broadcast(ids), "doc_id").select("text", "toxic").distinct().collect()
    return fit(sorted((r["text"], r["toxic"]) for r in rows))


def score(df: DataFrame, model: ToxicModel, names: tuple[str, str] = ("toxicity", "toxic_terms")) -> DataFrame:
    """df with toxicity (0 to 1) and toxic_terms (array of start, end, term; code points).

    Whole texts of any length are scored; a null or empty one is scored like one
    without a match.  Repeated rows get equal scores; an empty table gives an
    empty table.  Input columns with the names of these two are replaced; others
    may have any names.
    """
    df = df.select(*columns(df, names))
    at = text_at(df)
    term = T.StructType().add("start", "integer").add("end", "integer").add("term", "string")
    schema = T.StructType([*df.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.ArrayType(term))])
    terms = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        m = model.matcher()
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            values, found = [], []
            for text in batch.column(at).cast(pa.string()):
                x, got = m.feature(text.as_py() or "")
                values.append(m.score(x))
                found.append([{"start": s, "end": e, "term": t} for s, e, t in got])
            yield [*batch.columns, pa.array(values, pa.float64()), pa.array(found, terms)]

    return map_batches(df, run, schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        F.size("toxic_terms").alias("n_terms"),
    )
