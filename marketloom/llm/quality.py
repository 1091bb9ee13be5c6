"""Quality by an interpolated modified Kneser-Ney model of trusted text.

The model predicts each byte from the four before it (a text begins after four
zero bytes).  All counts are gathered from every trusted document: tasks count
their five-byte strings, and the rest is grouping and joining of count tables,
spread by n-gram: continuation counts, context totals, discounts, and the
interpolated probability of each n-gram from that of its suffix.

Documents meet the model in sharded count joins.  Distinct texts are dealt into
blocks of about BLOCK_BYTES.  A block asks for the strings of up to five bytes
that it has, each once; the requests are joined with the model's rows, spread by
string, and what the model has comes back to the block, which adds up the code
lengths of its texts.  Nothing is broadcast, and a task holds one block and the
rows of its strings, whatever the sizes of model and corpus.

A document is kept when its perplexity per byte is at most a limit that follows
from trusted documents of its language that were not trained on: their quantile
KEEP, but at most FENCE times the quartiles' distance above the upper quartile,
so that no single odd document sets it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import textnp as tn
from marketloom.llm.common import columns, held_out, packed, quoted, stored

ORDER = 5
#: Bytes of text of a block, about, and of what a task packs at a time.
BLOCK_BYTES, PACK_BYTES = 64_000_000, 8_000_000
#: Ids that are broadcast to pick the trusted texts; beyond it, a shuffle join.
BROADCAST_IDS = 1_000_000
#: Languages whose limits are broadcast; beyond it, a shuffle join.
BROADCAST_LANGUAGES = 10_000
#: Quantile of held-out trusted documents that is still kept.
KEEP = 0.995
#: Distances of the quartiles above the upper one at which a trusted document is odd.
FENCE = 3.0


def codes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The five bytes that end at each byte, as one number; zero before a text."""
    out = data.astype(np.int64)
    for j in range(1, ORDER):
        before = np.zeros(len(data), np.int64)
        before[j:] = data[: max(0, len(data) - j)]
        for i in range(j):
            where = at[:-1] + i
            before[where[where < at[1:]]] = 0
        out |= before << (8 * j)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        g, n = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, where = np.unique(g, return_inverse=True)
        return keys, np.bincount(where, weights=n).astype(np.int64)

    for batch in batches:
        for _, _, data, at in tn.pieces(batch.column(0)):
            if len(data):
                held.append(np.unique(codes(data, at), return_counts=True))
        if len(held) > 16:
            held = [merged()]
        if held and len(held[0][0]) > 2_000_000:  # bounded memory: send what there is
            g, n = merged()
            held = []
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], names=["g", "c"])
    if held:
        g, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], names=["g", "c"])


@dataclass
class KneserNey:
    """strings: key (length and bytes), bits (code length of the last byte after
    those before it; null for what only begins texts) and leave (code length of
    leaving the string as a context; null at the longest)."""

    strings: DataFrame
    base: np.ndarray = field(default_factory=lambda: np.full(256, 8.0))  # order 1


def key(length: int, g):
    """The number of a string of bytes g (a number too)."""
    return g + (length << 8 * ORDER)


def discounts(counted: dict[int, int]) -> tuple[float, float, float]:
    """For counts 1, 2 and more, from the numbers of n-grams with counts 1 to 4."""
    n1, n2, n3, n4 = (float(counted.get(i, 0)) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9  # too little text for estimates
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return min(max(d1, 0.05), 0.95), min(max(d2, 0.05), 1.9), min(max(d3, 0.05), 2.9)


def train(trusted: DataFrame) -> KneserNey:
    """The model of the column text of all rows; null and empty texts say nothing."""
    counts = trusted.select(F.col("text").cast("string").alias("text")).where("text <> ''").mapInArrow(_count, "g long, c long")
    tables = {ORDER: stored(counts.groupBy("g").agg(F.sum("c").alias("c")), "kn-5")}
    for k in range(ORDER - 1, 0, -1):
        shorter = tables[k + 1].groupBy(F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("g")).agg(F.count(F.lit(1)).alias("c"))
        tables[k] = stored(shorter, f"kn-{k}")
    some = {k: {r["c"]: r["n"] for r in t.where("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()} for k, t in tables.items()}

    base = np.full(256, 8.0)
    ones = {r["g"]: r["c"] for r in tables[1].collect()}  # at most 256 rows
    d = discounts(some[1])
    if ones:
        total = sum(ones.values())
        spared = sum(d[min(c, 3) - 1] for c in ones.values()) / total
        base = -np.log2(np.array([max(ones.get(b, 0) - (d[min(ones[b], 3) - 1] if b in ones else 0), 0) / total + spared / 256 for b in range(256)]))
    lower = trusted.sparkSession.createDataFrame([(b, float(2.0 ** -base[b])) for b in range(256)], "suffix long, lower double")
    rows = None
    for k in range(2, ORDER + 1):
        d1, d2, d3 = discounts(some[k])
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        gram = tables[k].withColumns({"ctx": F.shiftright("g", 8), "suffix": F.col("g").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)), "cut": cut})
        context = gram.groupBy("ctx").agg(F.sum("c").alias("total"), (F.sum("cut") / F.sum("c")).alias("leave"))
        gram = gram.join(context, "ctx").join(lower, "suffix")
        p = (F.col("c") - F.col("cut")) / F.col("total") + F.col("leave") * F.col("lower")
        gram = stored(gram.select("g", p.alias("p")), f"kn-p{k}")
        lower = gram.select(F.col("g").alias("suffix"), F.col("p").alias("lower"))
        two = [
            gram.select(key(k, F.col("g")).alias("key"), (-F.log2("p")).alias("bits"), F.lit(None).cast("double").alias("leave")),
            context.select(key(k - 1, F.col("ctx")).alias("key"), F.lit(None).cast("double").alias("bits"), (-F.log2("leave")).alias("leave")),
        ]
        for t in two:
            rows = t if rows is None else rows.unionByName(t)
    return KneserNey(stored(rows.groupBy("key").agg(F.max("bits").alias("bits"), F.max("leave").alias("leave")), "kn-model"), base)


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, texts) of rows (block, v, w, text): a block's texts as one compressed value."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        block = rows["block"].to_numpy()
        order = np.argsort(block, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(block[order])) + 1), len(order)] if len(order) else [0]
        for x, y in pairwise(cuts):
            part, sink = rows.take(pa.array(order[x:y])).select(["v", "w", "text"]), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(part)
            yield pa.RecordBatch.from_arrays([pa.array(block[order[x : x + 1]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "texts"])

    for batch in (b.slice(i, 128) for b in batches for i in range(0, b.num_rows, 128)):
        held.append(batch)
        if sum(b.nbytes for b in held) > PACK_BYTES:
            yield from flush()
            held = []
    if held:
        yield from flush()


def _texts(block: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, places, bytes, offsets) of a block's distinct texts, a piece at a time."""
    seen: set[tuple[int, int]] = set()
    for value in block["texts"]:
        rows = pa.ipc.open_stream(value.as_buffer()).read_all().combine_chunks()
        both = list(zip(rows["v"].to_pylist(), rows["w"].to_pylist(), strict=True))
        new = np.array([x not in seen and not seen.add(x) for x in both], bool)
        rows = rows.filter(pa.array(new)).combine_chunks()
        column = rows["text"].chunk(0) if rows.num_rows else pa.array([], pa.string())
        for first, end, data, at in tn.pieces(column):
            yield rows, np.arange(first, end), data, at


def _wanted(block: pa.Table) -> pa.Table:
    """The strings of up to five bytes that a block has, as keys."""
    held = [np.empty(0, np.int64)]
    for _, _, data, at in _texts(block):
        held.append(np.unique(codes(data, at)))
        if len(held) > 16:
            held = [np.unique(np.concatenate(held))]
    now, keys = np.unique(np.concatenate(held)), []
    for k in range(ORDER, 0, -1):
        # What ends at a byte, and what ends before one (a text's first byte has only zeros before).
        now = np.unique(np.concatenate([now & ((1 << 8 * k) - 1), np.zeros(1, np.int64)]))
        keys.append(key(k, now))
    keys = np.concatenate(keys)
    return pa.table({"block": pa.array(np.repeat(block["block"][0].as_py(), len(keys)), pa.int32()), "key": keys})


class Strings:
    """The model's rows for the strings of a block."""

    def __init__(self, rows: pa.Table, base: np.ndarray):
        self.base = base
        keys = rows["key"].to_numpy()
        bits, leave = (rows[c].to_numpy().astype(float) for c in ("bits", "leave"))
        length, g = keys >> 8 * ORDER, keys & ((1 << 8 * ORDER) - 1)
        self.grams, self.contexts = {}, {}
        for k in range(2, ORDER + 1):
            for to, pick, value in ((self.grams, (length == k) & ~np.isnan(bits), bits), (self.contexts, (length == k - 1) & ~np.isnan(leave), leave)):
                to[k] = (tn.Lookup(g[pick]), np.concatenate([np.zeros(1), value[pick]]))

    def bits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length of each text."""
        out = np.zeros(len(at) - 1)
        if not len(data):
            return out
        code = codes(data, at)
        cost = np.zeros(len(data))
        open_ = np.arange(len(data))
        for k in range(ORDER, 1, -1):
            table, value = self.grams[k]
            own = code[open_] & ((1 << 8 * k) - 1)
            row = table.rows(own)
            cost[open_] += value[row]
            missed = row == 0
            open_, own = open_[missed], own[missed]
            context, leave = self.contexts[k]
            cost[open_] += leave[context.rows(own >> 8)]
        cost[open_] += self.base[code[open_] & 255]
        full = np.flatnonzero(at[1:] > at[:-1])
        out[full] = np.add.reduceat(cost, at[:-1][full])
        return out


def code_lengths(texts: DataFrame, model: KneserNey) -> DataFrame:
    """v, w, bits: the code length of every distinct text; v and w are 128 bits
    of it.  texts: text, without nulls."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    v, w = F.xxhash64("text"), F.xxhash64("text", F.lit(6))
    dealt = texts.select(F.pmod(v, F.lit(blocks)).cast("int").alias("block"), v.alias("v"), w.alias("w"), "text")
    by_block = dealt.mapInArrow(_packed_texts, "block int, texts binary").groupBy("block")
    wanted = by_block.applyInArrow(_wanted, "block int, key long")
    have = wanted.join(model.strings, "key").select("block", "key", "bits", "leave")
    base = model.base

    def add_up(block: pa.Table, rows: pa.Table) -> pa.Table:
        strings, out = Strings(rows, base), []
        for own, place, data, at in _texts(block):
            out.append(own.select(["v", "w"]).take(pa.array(place)).append_column("bits", pa.array(strings.bits(data, at))))
        return pa.concat_tables(out) if out else pa.table({"v": pa.array([], pa.int64()), "w": pa.array([], pa.int64()), "bits": pa.array([], pa.float64())})

    return by_block.cogroup(have.groupBy("block")).applyInArrow(add_up, "v long, w long, bits double")


def score(df: DataFrame, model: KneserNey) -> DataFrame:
    """df without text, with perplexity (per byte; null without text).  An input
    column of that name is replaced; others may have any names."""
    text = F.col("text").cast("string")
    lengths = stored(code_lengths(df.select(text.alias("text")).where("text <> ''"), model), "code-lengths")
    rows = df.select(packed(df, ("text", "perplexity")), F.xxhash64(text).alias("v"), F.xxhash64(text, F.lit(6)).alias("w"), F.octet_length(text).alias("size"))
    ppl = F.when(F.col("size") > 0, F.pow(F.lit(2.0), F.col("bits") / F.col("size")))
    return rows.join(lengths, ["v", "w"], "left").select("row.*", ppl.alias("perplexity"))


def _rows_of(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of df whose doc_id is in ids; few ids go to the rows, else rows are shuffled."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def classify(df: DataFrame, trusted: DataFrame, lang: str = "lang", keep: float = KEEP) -> DataFrame:
    """df without text, with perplexity, limit and keep.

    trusted: doc_id of trusted documents.  The model learns from those outside
    the held-out fifth; limit is the quantile keep of the perplexity of those in
    it, or their fence if that is lower, for the row's language (null is a
    language), or over all languages if it has none there.  Without any limit
    all rows with text are kept.  A row without text has no perplexity and is
    not kept; one at the limit is kept.  A null doc_id is not trusted.  Whole
    texts of any length are scored, repeated rows alike; an empty table gives an
    empty table.  Input columns with these three names are replaced; others may
    have any names.
    """
    rows = df.select(*columns(df, ("perplexity", "limit", "keep")))
    ids = trusted.select("doc_id").where("doc_id is not null").distinct()
    model = train(_rows_of(rows, ids.where(~held_out())).select("text"))
    scored = stored(score(rows, model), "quality")
    language = lambda d: F.coalesce(d[quoted(lang)].cast("string"), F.lit("\0")).alias("language")
    known = _rows_of(scored, ids.where(held_out())).where("perplexity is not null")
    known = known.select(language(known), F.col("perplexity").alias("p"))
    at = lambda q: F.percentile_approx("p", F.lit(q), F.lit(10_000))
    quantile = F.least(at(keep), at(0.75) + FENCE * (at(0.75) - at(0.25)))
    overall = known.agg(quantile.alias("overall"))
    limits = stored(known.groupBy("language").agg(quantile.alias("own")), "limits")
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_LANGUAGES else limits
    whole = scored.select(packed(scored, ("perplexity",)), "perplexity", language(scored))
    out = whole.join(F.broadcast(overall)).join(limits, "language", "left").withColumn("limit", F.coalesce("own", "overall"))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("limit"), F.lit(True))
    return out.select("row.*", "perplexity", "limit", kept.alias("keep"))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    out = classify(docs, labels.where("quality = 1"))
    return out.select("doc_id", "lang", F.round("perplexity", 6).alias("perplexity"), F.round("limit", 6).alias("limit"), "keep")
