"""Change of TF-IDF vectors from one document to the next.

Documents are dealt into blocks of consecutive ids, about BLOCK_BYTES of text
each; a block also gets the last document of the block before.  A block sends
each of its terms once, as 79 bits of hash with the number of its documents that
have it, spread by hash.  They are sorted, so the upper bits take little room.  Summed over the blocks these are document frequencies,
and they go back in the order in which the block sent its terms, so without
them.  Norms and products of neighbours are then sums inside a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text of a block, about; a longer document is a block of its own.
BLOCK_BYTES = 8_000_000
#: Ids in a range in which blocks are laid out.
RANGE = 100_000
U64 = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Block:
    """Terms of one and two words of a block's documents (doc_id, own, text).

    ids, rows and own: of its documents, ascending.  doc and tf, by term and
    document: of each term of each document; place: the term's among those sent."""

    def __init__(self, rows: pa.Table):
        rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending"), ("text", "ascending")])).combine_chunks()
        self.ids, slot, self.rows = np.unique(rows["doc_id"].fill_null(0).to_numpy(), return_inverse=True, return_counts=True)
        self.own = np.zeros(len(self.ids), bool)
        self.own[slot] = rows["own"].to_numpy()
        words = pc.ascii_split_whitespace(rows["text"]).combine_chunks()
        of, words = pc.list_parent_indices(words).to_numpy(), words.flatten()
        full = pc.not_equal(pc.binary_length(words), 0)
        of, words = of[full.to_numpy(zero_copy_only=False)], words.filter(full).dictionary_encode()
        code, words = words.indices.to_numpy().astype(np.int64), words.dictionary.to_numpy(zero_copy_only=False)
        self.words, n = words, len(words)
        two = np.flatnonzero(of[1:] == of[:-1])
        term, doc = np.concatenate([code, n + code[two] * n + code[two + 1]]), slot[np.concatenate([of, of[two]])]
        del code, of, two
        known = None
        if n * (n + 1) * len(self.ids) >= 2**63:
            known, term = np.unique(term, return_inverse=True)
        term *= len(self.ids)
        term += doc
        del doc
        both, self.tf = np.unique(term, return_counts=True)
        term, self.doc = np.divmod(both, len(self.ids))
        first = np.ones(len(term), bool)
        first[1:] = term[1:] != term[:-1]
        self.terms = term[first] if known is None else known[term[first]]
        self.term = np.cumsum(first) - 1

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, top, rest): the terms in the order in which they are sent, and
        their hashes, of 16 and 63 bits (the last bit of rest is 0)."""
        n, found = len(self.words), []
        one, two = np.divmod(np.maximum(self.terms - n, 0), n)
        for seed in ("tf-idf, 16 bits.", "tf-idf, 63 bits."):
            h = pd.util.hash_array(self.words, hash_key=seed, categorize=False)
            pair = _mixed(_mixed(h[one] * U64(0x9E3779B97F4A7C15) + U64(1)) + h[two])
            found.append(np.where(self.terms < n, h[np.minimum(self.terms, n - 1)], pair))
        top, rest = found[0] >> U64(48), found[1] & ~U64(1)
        order = np.argsort((top << U64(48)) | (rest >> U64(16)), kind="stable")
        return order, top[order].astype(np.uint16), rest[order]


def _lists(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))


def _sent(buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        block = Block(rows)
        order, top, rest = block.keys()
        docs = np.bincount(block.term[block.own[block.doc]], minlength=len(order))[order]
        other = docs != 1  # those that aren't one document's have a bit, and their number
        kept, at = np.unique(top.astype(np.int64) * buckets >> 16, return_index=True)
        at = np.append(at, len(top))
        return pa.table({
            "bucket": pa.array(kept, pa.int32()), "block": pa.array(np.full(len(kept), rows["block"][0].as_py()), pa.int32()),
            "top": _lists(top.view(np.int16), at), "rest": _lists((rest | other).view(np.int64), at),
            "docs": _lists(docs[other].astype(np.int32), np.append(0, np.cumsum(other))[at]),
        })

    return run


def _frequencies(rows: pa.Table) -> pa.Table:
    top, rest, more = (rows[c].combine_chunks().flatten().to_numpy() for c in ("top", "rest", "docs"))
    docs = np.ones(len(rest), np.int64)
    docs[(rest & 1) == 1] = more
    rest = rest & ~1
    order = np.lexsort((rest, top))
    top, rest = top[order], rest[order]
    first = np.flatnonzero(np.append(True, (top[1:] != top[:-1]) | (rest[1:] != rest[:-1])))
    df = np.empty(len(rest), np.int32)
    df[order] = np.repeat(np.add.reduceat(docs[order], first), np.diff(np.append(first, len(rest))))
    at = np.append(0, np.cumsum(pc.list_value_length(rows["top"]).to_numpy()))
    return pa.table({"block": rows["block"], "bucket": rows["bucket"], "df": _lists(df, at)})


def _changes(n: int):
    def run(rows: pa.Table, df: pa.Table) -> pa.Table:
        if rows["doc_id"].null_count:  # no neighbours
            return pa.table({"doc_id": rows["doc_id"], "change": pa.nulls(len(rows), pa.float64())})
        block = Block(rows)
        idf, df = np.empty(len(block.terms)), df.sort_by("bucket")["df"].combine_chunks().flatten().to_numpy()
        idf[block.keys()[0]] = np.log((n + 1) / (df + 1)) + 1
        v = block.tf * idf[block.term]
        square = np.bincount(block.doc, v * v, minlength=len(block.ids))
        # Terms are in order of documents: one that the document before has too comes next to it.
        both = np.flatnonzero((block.term[1:] == block.term[:-1]) & (block.doc[1:] == block.doc[:-1] + 1)) + 1
        dot = np.bincount(block.doc[both], v[both] * v[both - 1], minlength=len(block.ids))
        # Of repeated ids, all rows but one follow a row of the same id.
        dot = dot + (block.rows - 1) * square
        norm = np.sqrt(square)
        to_last = np.append(np.nan, 1 - dot[1:] / norm[1:] / norm[:-1])
        twice = np.repeat(np.arange(len(norm)), np.where(block.own, block.rows - 1, 0))
        ids = np.concatenate([block.ids[block.own], block.ids[twice]])
        change = np.concatenate([to_last[block.own], 1 - dot[twice] / norm[twice] / norm[twice]])
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "change": pa.array(change, from_pandas=True)})

    return run


def _blocks(d: DataFrame) -> list:
    """(lo, hi) of each block's ids, ascending: a row for each block."""
    size = d.where("doc_id is not null").groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("size")).withColumn("part", F.floor(F.col("doc_id") / RANGE))
    before = size.groupBy("part").agg(F.sum("size").alias("all"))
    before = before.select("part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.sum("size").over(Window.partitionBy("part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    block = F.floor((F.col("before") + F.col("own")) / BLOCK_BYTES)
    dealt = size.withColumn("own", own).join(before, "part").groupBy(block.alias("block")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    return [(r.lo, r.hi) for r in dealt.orderBy("block").collect()]


def changes(d: DataFrame) -> DataFrame:
    """doc_id, change: one less the cosine of a document's TF-IDF vector and that
    of the document with the next smaller doc_id (null for the first).

    d: doc_id (long) and text in lower case, with a word at least.  Terms are
    single words and neighbouring two; repeated ids are one document, with a row
    for each; those without id count as one and have no neighbours."""
    blocks, n = _blocks(d), d.count()
    lo, hi = (np.array([b[i] for b in blocks], np.int64) for i in (0, 1))

    @F.pandas_udf("array<int>")
    def to(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in ids:
            none = x.isna().to_numpy()
            own = np.searchsorted(lo, x.fillna(0).to_numpy(np.int64), side="right") - 1
            last = np.isin(own, np.arange(len(hi) - 1)) & (hi[own] == x.fillna(0).to_numpy(np.int64)) if len(hi) else none
            yield pd.Series([[-1] if no else [i, i + 1] if also else [i] for no, i, also in zip(none, own.tolist(), last, strict=True)])

    dealt = d.select("doc_id", "text", to("doc_id").alias("to")).select("doc_id", "text", F.posexplode("to").alias("pos", "block"))
    by_block = dealt.select("doc_id", (F.col("pos") == 0).alias("own"), "text", "block").groupBy("block")
    sent = by_block.applyInArrow(_sent(max(1, len(blocks))), "bucket int, block int, top array<smallint>, rest array<long>, docs array<int>")
    df = sent.groupBy("bucket").applyInArrow(_frequencies, "block int, bucket int, df array<int>")
    return by_block.cogroup(df.groupBy("block")).applyInArrow(_changes(n), "doc_id long, change double")
