"""Token ids in directly addressable codes.

Codes: an id is split into chunks of eight bits.  Level 0 has the lowest chunk
of every id and one bit for each, set if the id goes on; level 1 has the next
chunk of those that go on, in the same order, and so forth.  The chunk of id i
at the next level is at the number of set bits before i, which a directory of
counts (one for every 512 bits) and the bits since give at once.  So any id is
read from as many places as it has chunks, and nothing else is decoded.

Segment (little-endian): "DAC1", uint32 levels, uint64 ids; for each level
uint64 chunks, its chunks, and but for the last level its bitmap (512-bit
blocks) and directory (uint32 for each block); each part is padded to 8 bytes.

Files: a folder with two Parquet tables.  `segments` has a row for each segment
(part, segment, doc_ids, ends, codes), documents whole and in order of their
ids over parts and segments; `index` has part, segment, n_docs, n_tokens and
start, the number of ids in all segments before it.  Spark's committers write
both, so a lost executor leaves no half file.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm import textnp as tn
from marketloom.llm.common import map_batches, shared_dir, table

MAGIC = b"DAC1"
#: Bits for each count of the directory; 64-bit words for them.
BLOCK, BLOCK_WORDS = 512, 8
#: A segment ends with the document that brings it to so many ids.
SEGMENT = 1 << 16
#: Distinct words, and ids of them, that a worker remembers.
REMEMBERED, REMEMBERED_IDS = 700_000, 1 << 23


def _padded(x: bytes) -> bytes:
    return x + bytes(-len(x) % 8)


def encode(ids: np.ndarray) -> bytes:
    """The segment of some ids (0 to 2**32 - 1)."""
    rest, levels = np.asarray(ids, np.uint32), []
    while True:
        more = rest > 255
        part = [np.uint64(len(rest)).tobytes(), _padded((rest & np.uint32(255)).astype(np.uint8).tobytes())]
        levels.append(part)
        if not more.any():
            break
        bits = np.zeros(-(-len(rest) // BLOCK) * BLOCK, bool)
        bits[: len(rest)] = more
        counts = bits.reshape(-1, BLOCK).sum(1)
        part.append(np.packbits(bits, bitorder="little").tobytes())
        part.append(_padded((np.cumsum(counts) - counts).astype("<u4").tobytes()))
        rest = rest[more] >> np.uint32(8)
    return b"".join([MAGIC, np.uint32(len(levels)).tobytes(), np.uint64(len(ids)).tobytes(), *[x for part in levels for x in part]])


class Codes:
    """Reads a segment in place."""

    def __init__(self, data: bytes | memoryview):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a segment of token ids")
        n_levels = int(np.frombuffer(data, "<u4", 1, 4)[0])
        self.n, at = int(np.frombuffer(data, "<u8", 1, 8)[0]), 16
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for level in range(n_levels):
            n = int(np.frombuffer(data, "<u8", 1, at)[0])
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n + -n % 8
            words, counts = np.empty(0, np.uint64), np.empty(0, np.uint32)
            if level < n_levels - 1:
                blocks = -(-n // BLOCK)
                words = np.frombuffer(data, "<u8", blocks * BLOCK_WORDS, at)
                at += blocks * BLOCK // 8
                counts = np.frombuffer(data, "<u4", blocks, at)
                at += 4 * blocks + -4 * blocks % 8
            self.levels.append((chunks, words, counts))

    def __len__(self) -> int:
        return self.n

    @staticmethod
    def _before(words: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        block, last = at // BLOCK, at // 64
        out = counts[block].astype(np.int64)
        for k in range(BLOCK_WORDS):
            word = block * BLOCK_WORDS + k
            mask = np.where(word < last, ~np.uint64(0), np.where(word == last, (np.uint64(1) << (at % 64).astype(np.uint64)) - np.uint64(1), np.uint64(0)))
            out += np.bitwise_count(words[word] & mask)
        return out

    def get(self, at: Iterable[int]) -> np.ndarray:
        """The ids at some places."""
        at = np.asarray(at, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("no such id in the segment")
        out, own = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, (chunks, words, counts) in enumerate(self.levels):
            out[own] |= chunks[at].astype(np.uint32) << np.uint32(8 * level)
            if level == len(self.levels) - 1:
                break
            on = (words[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1
            own, at = own[on], self._before(words, counts, at[on])
        return out

    def between(self, low: int, high: int) -> np.ndarray:
        """The ids from low to before high."""
        out, own = np.zeros(high - low, np.uint32), np.arange(high - low)
        for level, (chunks, words, counts) in enumerate(self.levels):
            if high <= low:
                break
            out[own] |= chunks[low:high].astype(np.uint32) << np.uint32(8 * level)
            if level == len(self.levels) - 1:
                break
            bits = np.unpackbits(words[low // 64 : -(-high // 64)].view(np.uint8), bitorder="little")[low % 64 :][: high - low]
            own = own[bits.astype(bool)]
            low = int(self._before(words, counts, np.array([low]))[0])
            high = low + len(own)
        return out


@cache
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks have a core each
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _without_normalizer(path: str):
    """The tokenizer for words that its normalizer leaves as they are."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.normalizer = None
    return made


class _Numbers(dict):
    """Words to 0, 1, ... as they are asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _last(numbers: _Numbers, had: int) -> list[bytes]:
    """The words from number `had` on."""
    return list(islice(reversed(numbers), len(numbers) - had))[::-1]


def _appended(ids: np.ndarray, ends: np.ndarray, more: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([ids, more]), np.concatenate([ends, ends[-1] + np.cumsum(size)])


def _picked(ids: np.ndarray, ends: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some numbers one after another, and how many each has."""
    size = ends[own + 1] - ends[own]
    upto = np.cumsum(size)
    return ids[np.arange(upto[-1] if len(upto) else 0) + np.repeat(ends[own + 1] - upto, size)], size


#: Between an ASCII letter or digit and punctuation but the apostrophe, where the tokenizer always parts.
PARTS = re.compile(rb"(?<=[a-z0-9])(?=[!-&(-/:-@\[-`{-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[a-z0-9])")


#: Stands between words that are encoded together; words with it are encoded alone.
MARK, TOGETHER = b"~", 500


class WordEncoder:
    """Ids of texts by a tokenizer that lowers case, drops white space and merges
    inside words only: a distinct word, and a distinct part of one, is encoded once."""

    def __init__(self, path: str):
        self.tokenizer, self.plain = _tokenizer(path), _without_normalizer(path)
        normal = self.tokenizer.normalizer
        letters = "".join(map(chr, range(33, 127))).lower()
        if normal is not None and normal.normalize_str(letters) != letters:  # not even lower-case ASCII stays
            self.plain = self.tokenizer
        mark = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        both = self.tokenizer.encode(f"a {MARK.decode()} b", add_special_tokens=False).ids
        parts = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in "ab"]
        self.mark = mark[0] if len(mark) == 1 and both == parts[0] + mark + parts[1] else None
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids, self.ends = _Numbers(), np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.parts, self.part_ids, self.part_ends = _Numbers(), np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        split = [[w] if w.isalnum() or b"<|" in w else PARTS.split(w) for w in words]
        had = len(self.parts)
        own = np.array(list(map(self.parts.__getitem__, chain.from_iterable(split))), np.int64)
        if len(self.parts) > had:
            flat, size, order = self._encoded(_last(self.parts, had))
            back = np.argsort(order)
            flat, size = _picked(flat, np.concatenate([[0], np.cumsum(size)]), back)
            self.part_ids, self.part_ends = _appended(self.part_ids, self.part_ends, flat, size)
        flat, size = _picked(self.part_ids, self.part_ends, own)
        upto = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(list(map(len, split)))])]
        self.ids, self.ends = _appended(self.ids, self.ends, flat, np.diff(upto))

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids one word after another, how many each has, and the words' places
        in that order.  Many go as one text, with a mark between them."""
        kind = np.array([3 if self.mark is None or b"<|" in w or MARK in w else 1 if w.isascii() else 2 for w in words])
        flat, sizes, order = [], [], []
        for k, tokenizer in ((1, self.plain), (2, self.tokenizer)):
            own = np.flatnonzero(kind == k)
            order.append(own)
            texts = [b" ~ ".join([words[i] for i in own[low : low + TOGETHER]]).decode(errors="replace") for low in range(0, len(own), TOGETHER)]
            for made in tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                ids = np.array(made.ids, np.uint32)
                marks = np.flatnonzero(ids == self.mark)
                sizes.append(np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1)
                flat.append(np.delete(ids, marks))
        rest = np.flatnonzero(kind == 3)
        order.append(rest)
        for made in self.tokenizer.encode_batch_fast([words[i].decode(errors="replace") for i in rest], add_special_tokens=False):
            sizes.append(np.array([len(made.ids)]))
            flat.append(np.array(made.ids, np.uint32))
        return np.concatenate(flat), np.concatenate(sizes), np.concatenate(order)

    def ids_of(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of texts in UTF-8."""
        if len(self.words) > REMEMBERED or len(self.ids) > REMEMBERED_IDS:
            self._forget()
        had, number, rows = len(self.words), self.words.__getitem__, []
        for text in texts:
            # Special tokens are known in their own case only.
            words = [w if b"<|" in w else w.lower() for w in text.split()] if b"<|" in text else text.lower().split()
            rows.append(np.fromiter(map(number, words), np.int64, len(words)))
        if len(self.words) > had:
            self._learn(_last(self.words, had))
        return [_picked(self.ids, self.ends, own)[0] for own in rows]


@cache
def _encoder(path: str) -> WordEncoder:
    """A worker's, which remembers words from task to task."""
    return WordEncoder(path)


SEGMENTS = T.StructType().add("part", "integer").add("segment", "integer").add("doc_ids", T.ArrayType(T.LongType())).add("ends", T.ArrayType(T.LongType())).add("codes", "binary")


def write(df: DataFrame, path: str, tokenizer: str, end_id: int = 1, segment: int = SEGMENT) -> None:
    """Write the ids of every text of df (doc_id long, text), each followed by end_id.

    Documents come in order of doc_id, null first; those with equal ids by a
    hash of the text, equal ones in any order.  A null or empty text has its
    end_id alone.  A text of any length is one document of one segment.  Other
    columns are left alone, whatever their names.  df is read twice (once for
    the bounds of the parts); an empty table gives empty files.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # A number of their own parts rows that are equal, should they be many.
    rows = rows.withColumns({"tie": F.xxhash64("text"), "serial": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc(), F.col("serial").asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        encoder, part = _encoder(tokenizer), TaskContext.get().partitionId()
        number, names, ends, held, total = 0, [], [], [], 0

        def closed() -> list[pa.Array]:
            codes = encode(np.concatenate(held))
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (names, ends)]
            return [pa.array([part], pa.int32()), pa.array([number], pa.int32()), *lists, pa.array([codes], pa.binary())]

        for batch in batches:
            docs, (data, at) = batch.column(0).to_pylist(), tn.buffers(batch.column(1))
            for low in range(0, len(docs), 256):  # a few texts at a time as bytes
                texts = [data[at[i] : at[i + 1]].tobytes() for i in range(low, min(low + 256, len(docs)))]
                for name, own in zip(docs[low : low + 256], encoder.ids_of(texts), strict=True):
                    held += [own, np.array([end_id], np.uint32)]
                    total += len(own) + 1
                    names.append(name)
                    ends.append(total)
                    if total >= segment:
                        yield closed()
                        number, names, ends, held, total = number + 1, [], [], [], 0
        if names:
            yield closed()

    map_batches(rows, run, SEGMENTS).write.parquet(f"{path}/segments")
    segments = df.sparkSession.read.schema(SEGMENTS).parquet(f"{path}/segments")
    sizes = segments.select("part", "segment", F.size("ends").cast("long").alias("n_docs"), F.element_at("ends", -1).alias("n_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("first") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    sizes.join(parts, "part").select("part", "segment", "n_docs", "n_tokens", start.alias("start")).write.parquet(f"{path}/index")


def _segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(f"{path}/segments")


def _index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, segment int, n_docs long, n_tokens long, start long").parquet(f"{path}/index")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it), n_tokens, ids_crc32 (of its ids as little-endian uint32)."""
    schema = T.StructType().add("part", "integer").add("segment", "integer").add("doc_id", "long").add("inside", "long").add("n_tokens", "long").add("ids_crc32", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, segment, names, ends = (batch.column(k)[i].as_py() for k in range(4))
                codes = Codes(batch.column(4)[i].as_buffer())
                starts = [0, *ends[:-1]]
                ids = codes.between(0, len(codes)).astype("<u4")
                sums = [crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                n = len(names)
                yield [
                    pa.array([part] * n, pa.int32()), pa.array([segment] * n, pa.int32()), pa.array(names, pa.int64()), pa.array(starts, pa.int64()),
                    pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64()), pa.array(sums, pa.int64()),
                ]

    # The narrow rows meet the index, not the codes.
    found = map_batches(_segments(spark, path), run, schema).join(_index(spark, path).select("part", "segment", "start"), ["part", "segment"])
    return found.select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def lookup(wanted: DataFrame, path: str) -> DataFrame:
    """wanted (doc_id, at) with token, the id at place `at` (from 0) of the document.

    Null where there is no such document or place, and for null ids.  Only the
    ids asked for are decoded.  Where several documents share an id, each
    answers.  Repeated rows are answered each.
    """
    spark = wanted.sparkSession
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("at").cast("long").alias("at"))
    docs = _segments(spark, path).select("part", "segment", F.posexplode("doc_ids").alias("k", "doc_id"), "ends")
    low = F.when(F.col("k") > 0, F.element_at("ends", F.col("k"))).otherwise(F.lit(0))
    docs = docs.select("part", "segment", "doc_id", low.alias("low"), F.element_at("ends", F.col("k") + 1).alias("high"))
    placed = asked.join(docs, "doc_id", "left").withColumn("place", F.col("low") + F.col("at"))
    there = F.coalesce((F.col("at") >= 0) & (F.col("place") < F.col("high")), F.lit(False))
    # Requests of a segment travel as one list of places, each once; the answers come back as pairs.
    lists = placed.where(there).groupBy("part", "segment").agg(F.array_sort(F.collect_set("place")).alias("places"))
    asked_of = _segments(spark, path).select("part", "segment", "codes").join(lists, ["part", "segment"])
    schema = T.StructType().add("part", "integer").add("segment", "integer").add("place", "long").add("token", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            for i in range(batch.num_rows):
                places = batch.column(3)[i].as_py()
                tokens = Codes(batch.column(2)[i].as_buffer()).get(places)
                yield [pa.array([batch.column(k)[i].as_py()] * len(places), pa.int32()) for k in (0, 1)] + [pa.array(places, pa.int64()), pa.array(tokens.astype(np.int64))]

    answers = map_batches(asked_of, run, schema)
    return placed.withColumn("place", F.when(there, F.col("place"))).join(answers, ["part", "segment", "place"], "left").select("doc_id", "at", "token")


def op12_token_files(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Every document as its token file gives it back; tokenizer is a file's path on all executors."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path, tokenizer)
    return documents(spark, path)
