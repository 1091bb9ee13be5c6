"""Benchmark decontamination by random-walk embeddings and edit distance.

Items and documents are sequences of words without case and punctuation, joined
by single spaces, and are read as characters.

Windows: seeds align an item with the text.  A seed is a sample of an item's
characters at fixed offsets: two parts with one character left out between them.
The text is asked for both parts with none, one or two characters between, so a
seed survives a deletion, a replacement or an insertion there.  That finds edits
spread evenly, which leave no long run whole: an edit in every fifth character
leaves runs of four beside each other.  Parts have LONGEST characters together, or
as many as edits of SIMILAR at random places break everywhere with a probability
of at most MISS.  Items too short for LEAST have seeds of one part, as long as a
run that edits of SIMILAR can't break or break with that probability.

Embedding: from both ends of the seed, item and text walk outward together (CGK).
A step looks at one character and moves on by one or stays, as a fixed random
function of step and character says, so after an edit the two fall into step
again, and edit distance becomes Hamming distance between the characters looked
at.  An item's embedding at each of its seeds is made once.  A few steps are
compared first, all only for what is left; a window is a candidate if at least
AGREE of its steps agree.  An edited item has many seeds, and one of them is enough.

What is left is verified exactly: Levenshtein distance in characters between the
item and the best part of the text around the diagonal.  A document has a leak of
an item when 1 - distance / item length is at least SIMILAR.  Items shorter than
SHORT are compared with a space at either end, so they are found as whole words.

Items are broadcast in blocks of at most about BLOCK_ITEMS; each block is a pass
over the documents.  A block's index has some 150 bytes for each of its characters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm import textnp as tn
from marketloom.llm.common import columns, map_batches, quoted, text_at

SIMILAR = 0.8
#: Probability that an item at SIMILAR, edited at random places, has no seed left.
MISS = 0.005
#: Characters of seeds in two parts, at least and at most.
LEAST, LONGEST = 5, 8
#: Characters of the text between the parts; an item has one there.
GAPS = (0, 1, 2)
#: Steps of a walk to one side, and share of all steps that must agree.
WALK, AGREE = 48, 0.42
#: Steps that are compared together, and steps of both sides that must agree by then.
STAGES = ((0, 4, 2), (4, 12, 6), (12, WALK, None))
#: Items shorter than this are verified wherever they have a seed, as whole words.
SHORT = 24
BLOCK_ITEMS = 2000
#: Added to diagonals: longer than any item, as a column's value has at most 2^31 bytes.
ORIGIN = 1 << 32


def normal(text: str) -> str:
    """The words of a text without case (A-Z) and ASCII punctuation, joined by spaces."""
    data = np.frombuffer(text.encode(), np.uint8)
    return b" ".join(np.where(tn.PUNCTUATION[data], np.uint8(32), tn.LOWER[data]).tobytes().split()).decode()


def distance_inside(item: str, text: str) -> int:
    """Least Levenshtein distance of item to any part of text (bit-parallel)."""
    if item in text:
        return 0
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    equal: dict[str, int] = {}
    for i, c in enumerate(item):
        equal[c] = equal.get(c, 0) | 1 << i
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = equal.get(c, 0)
        down = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(across | plus))
        less = plus & across
        if up & top:
            score += 1
        elif less & top:
            score -= 1
            if score < best:
                best = score
        up = (up << 1) & full
        less = (less << 1) & full
        plus = less | (full & ~(down | up))
        minus = up & down
    return best


def seed_shape(m: int) -> tuple[int, int]:
    """Characters of the two parts of the seeds of an item of m characters; the
    second is 0 if its seeds have one part."""
    k = int((1 - SIMILAR) * m + 1e-9)
    for q in range(LONGEST, LEAST - 1, -1):
        if (1 - SIMILAR**q) ** (2 * k + 1) <= MISS:
            return -(-q // 2), q // 2
    sure = -(-(m - k) // (k + 1))  # k edits leave a run of this length
    best = 1
    for q in range(2, LONGEST + 1):
        if q <= m and (q <= sure or (1 - SIMILAR**q) ** (k + 1) <= MISS):
            best = q
    return best, 0


def flatten(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, codes, first byte of each code, bounds of the texts in codes) of
    the texts as normal() has them, but for a space at either end.  A character
    has one code; others may share it."""
    space = tn.PUNCTUATION[data]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    flat = np.where(space, np.uint8(32), tn.LOWER[data])[keep]
    lead = (flat & 0xC0) != 0x80
    byte = np.flatnonzero(lead)
    code = flat[byte].copy()
    wide = np.flatnonzero(code >= 0xC0)
    if len(wide):
        mixed = code[wide].astype(np.int64)
        for j in (1, 2, 3):
            x = np.minimum(byte[wide] + j, len(flat) - 1)
            mixed += np.where(j < np.append(byte, len(flat))[wide + 1] - byte[wide], flat[x].astype(np.int64) * (7 * j), 0)
        code[wide] = 128 + mixed % 128
    chars = np.concatenate([[0], np.cumsum(lead)])
    return flat, code, byte, chars[np.concatenate([[0], np.cumsum(keep)])[at]]


def _sums(code: np.ndarray) -> np.ndarray:
    out = np.zeros(len(code) + 1, tn.U64)
    np.cumsum(tn._BYTE[code] * tn.powers(tn._BASE, len(code)), out=out[1:])
    return out


def _grams(sums: np.ndarray, left: int, right: int, gap: int) -> np.ndarray:
    """Hashes of all pairs of left codes and, behind a gap, right codes; the gap
    has no part in them."""
    first, end = left + gap, left + gap + right
    n = len(sums) - end
    if n <= 0:
        return np.empty(0, tn.U64)
    own = sums[left : left + n] - sums[:n]
    if right:
        own += (sums[end:] - sums[first : first + n]) * tn.powers(tn._INVERSE, gap + 1)[gap]
    return tn.mix(own * tn.powers(tn._INVERSE, n))


#: Whether a walk moves on at a step (of one side, then of the other) from a character.
MOVES = np.random.default_rng(20).integers(0, 2, (2 * WALK, 256))


@dataclass
class Seeds:
    left: int  # characters of the first part
    right: int  # characters of the second part
    maybe: np.ndarray  # first bits of a hash -> whether a seed has them
    lookup: tn.Lookup
    start: np.ndarray  # seed -> its first posting
    item: np.ndarray  # posting -> item
    offset: np.ndarray  # posting -> character of the item
    seen: np.ndarray  # (step, posting) -> character that the item's walk looks at; 0 beyond the item


def _walks(code: np.ndarray, offset: np.ndarray, span: int) -> np.ndarray:
    """What an item's walks from its seeds look at: (step, seed)."""
    padded = np.concatenate([np.zeros(WALK, np.uint8), code, np.zeros(WALK, np.uint8)])
    out = np.empty((2 * WALK, len(offset)), np.uint8)
    for side, at in enumerate((offset + span, offset - 1)):
        at = at + WALK
        for t in range(side * WALK, (side + 1) * WALK):
            out[t] = padded[at]
            at = at + (1 - 2 * side) * MOVES[t][out[t]]
    return out


class Index:
    """The seeds and embeddings of a block of items."""

    def __init__(self, items: Iterable[tuple[object, str]]):
        self.names, self.texts = [], []
        for name, text in items:
            flat = normal(text) if text else ""
            if flat:
                self.names.append(name)
                self.texts.append(flat)
        self.length = np.array([len(x) for x in self.texts], int)
        self.whole = [f" {x} " if len(x) < SHORT else x for x in self.texts]
        # Beyond an item's ends nothing agrees: of a seed in the middle, about 2 steps for each character can.
        self.need = np.where(self.length < SHORT, 0, AGREE * np.minimum(2 * WALK, 2 * self.length))
        found: dict[tuple[int, int], list[tuple[np.ndarray, ...]]] = {}
        for i, text in enumerate(self.texts):
            data = np.frombuffer(text.encode(), np.uint8)
            code = flatten(data, np.array([0, len(data)]))[1]
            left, right = seed_shape(len(code))
            gap = 1 if right else 0
            gram = _grams(_sums(code), left, right, gap)
            at = np.arange(len(gram))
            found.setdefault((left, right), []).append((gram, np.full(len(gram), i), at, _walks(code, at, left + gap + right)))
        self.seeds = []
        for (left, right), own in sorted(found.items()):
            gram, item, offset, seen = (np.concatenate(x, axis=-1) for x in zip(*own, strict=True))
            order = np.argsort(gram, kind="stable")
            keys, start = np.unique(gram[order], return_index=True)
            maybe = np.zeros(1 << 20, bool)
            maybe[keys >> tn.U64(44)] = True
            self.seeds.append(Seeds(left, right, maybe, tn.Lookup(keys), np.append(start, len(gram)), item[order], offset[order], np.ascontiguousarray(seen[:, order])))

    def candidates(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, diagonal): where the text has a seed, and walks from it agree."""
        items, diagonals = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        sums = _sums(code)
        for s, gap in ((s, gap) for s in self.seeds for gap in (GAPS if s.right else (0,))):
            gram, span = _grams(sums, s.left, s.right, gap), s.left + gap + s.right
            p = np.flatnonzero(s.maybe[gram >> tn.U64(44)])
            row = s.lookup.rows(gram[p])
            p, row = p[row > 0], row[row > 0] - 1
            times = s.start[row + 1] - s.start[row]
            posting = np.arange(times.sum()) + np.repeat(s.start[row] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) if len(p) else np.empty(0, np.int64)
            p = np.repeat(p, times)
            for lo in range(0, len(p), 1 << 16):
                own, at = posting[lo : lo + (1 << 16)], p[lo : lo + (1 << 16)]
                good = self._agree(code, s, own, at, span)
                items.append(s.item[own[good]])
                diagonals.append(at[good] - s.offset[own[good]])
        key = np.unique(np.concatenate(items) << 44 | (np.concatenate(diagonals) + ORIGIN))
        # Neighbouring diagonals of an item, up to four, are one candidate by the first.
        key = key[np.append(True, key[1:] >> 2 != key[:-1] >> 2)] if len(key) else key
        return key >> 44, (key & ((1 << 44) - 1)) - ORIGIN

    def _agree(self, code: np.ndarray, s: Seeds, posting: np.ndarray, p: np.ndarray, span: int) -> np.ndarray:
        """Which of the seeds' walks in the text agree with the items'."""
        left, last = np.arange(len(p)), len(code) - 1
        ends, hits = [p + span, p - 1], np.zeros(len(p), np.int16)
        for lo, hi, least in STAGES:
            for side, ahead in ((0, 1), (1, -1)):
                at = ends[side]
                for t in range(side * WALK + lo, side * WALK + hi):
                    x = code[np.minimum(at, last) if ahead > 0 else np.maximum(at, 0)]
                    hits += x == s.seen[t][posting]
                    at = at + ahead * MOVES[t][x]
                ends[side] = at
            need = self.need[s.item[posting]]
            keep = (hits >= (need if least is None else least)) | (need == 0)
            left, posting, hits, ends = left[keep], posting[keep], hits[keep], [e[keep] for e in ends]
        return left

    def leaks(self, data: np.ndarray, at: np.ndarray) -> list[dict[int, tuple[int, int]]]:
        """For each text: item -> (distance, word at which the passage begins, about)."""
        n = len(at) - 1
        found: list[dict[int, tuple[int, int]]] = [{} for _ in range(n)]
        if not len(data) or not self.seeds:
            return found
        flat, code, byte, bounds = flatten(data, at)
        if not len(code):
            return found
        byte = np.append(byte, len(flat))
        opens = code != 32
        opens[1:] &= code[:-1] == 32
        opens[bounds[:-1][bounds[:-1] < len(code)]] |= code[bounds[:-1][bounds[:-1] < len(code)]] != 32
        words = np.concatenate([[0], np.cumsum(opens)])
        item, diagonal = self.candidates(code)
        tried: set[tuple[int, int, int]] = set()
        for i, head in zip(item.tolist(), diagonal.tolist(), strict=True):
            size, whole = int(self.length[i]), self.whole[i]
            edge = (len(whole) - size) // 2
            most = int((1 - SIMILAR) * size + 1e-9)
            # A window may reach into a neighbouring text; each is looked at by itself.
            low, high = max(0, head - most - 1 - edge), min(len(code), head + 3 + size + most + 1 + edge)
            for t in range(max(0, int(np.searchsorted(bounds, low, "right")) - 1), int(np.searchsorted(bounds, high, "left"))):
                x, y = max(low, int(bounds[t])), min(high, int(bounds[t + 1]))
                if y - x < size - most or (t, i, head // 4) in tried or found[t].get(i, (1,))[0] == 0:
                    continue
                tried.add((t, i, head // 4))
                opening, closing = edge * (x == bounds[t]), edge * (y == bounds[t + 1])
                around = " " * opening + flat[byte[x] : byte[y]].tobytes().decode(errors="replace") + " " * closing
                d = distance_inside(whole, around)
                if d <= most and (i not in found[t] or d < found[t][i][0]):
                    place = x + around.find(whole) + edge - opening if d == 0 else min(max(head, int(bounds[t])), len(code) - 1)
                    found[t][i] = (d, int(words[place] - words[bounds[t]]))
        return found


LEAK = "item_id", "edits", "similarity", "at_word"


def annotate(df: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", name: str = "leaks") -> DataFrame:
    """df with leaks: array of (item_id, edits, similarity, at_word), by item_id.

    Whole texts of any length are read.  A null or empty text has no leaks; null
    items and those without a letter or digit are not looked for; items of a few
    letters are found as whole words only; items may have any length, and
    verifying an edited one takes time in proportion to its length's square;
    equal items are found each; repeated rows have equal leaks.  Of places where an item
    fits equally well, one is reported.  An empty table gives an empty table,
    and no items give empty arrays.  An input column with the result's name is
    replaced; others may have any names.
    """
    df = df.select(*columns(df, (name,)))
    at_text = text_at(df)
    items = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).where("text is not null")
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    leak = T.StructType().add("item_id", "string").add("edits", "integer").add("similarity", "double").add("at_word", "long")
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(leak))])
    arrow = pa.list_(pa.struct([("item_id", pa.string()), ("edits", pa.int32()), ("similarity", pa.float64()), ("at_word", pa.int64())]))
    out = df
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        index = Index(sorted(((r["id"], r["text"]) for r in own.collect()), key=lambda x: (x[0] or "", x[1])))
        shared = df.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, more=block > 0) -> Iterator[list[pa.Array]]:
            index = shared.value
            for batch in batches:
                rows = []
                for _, _, data, at in tn.pieces(batch.column(at_text)):
                    for own in index.leaks(data, at):
                        rows.append([
                            {"item_id": index.names[i], "edits": d, "similarity": 1 - d / len(index.texts[i]), "at_word": w}
                            for i, (d, w) in sorted(own.items())
                        ])
                columns = batch.columns
                if more:  # what earlier blocks of items found comes last
                    rows = [a + b for a, b in zip(columns.pop().to_pylist(), rows, strict=True)]
                yield [*columns, pa.array(rows, arrow)]

        out = map_batches(out, run, schema)
    return out.withColumn(name, F.array_sort(quoted(name)))


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """One row per document and item that it holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = annotate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("leaks") > 0)
    found = found.select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", F.col("leak.item_id").cast("long").alias("item_id"), "leak.edits", F.round("leak.similarity", 6).alias("similarity"), "leak.at_word")
