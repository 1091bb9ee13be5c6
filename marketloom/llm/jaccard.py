"""Exact self-join of documents on the Jaccard similarity of word shingles.

Equal sets form a class.  Between classes, the universe of shingle hashes is
cut into m segments, m by size band.  Two sets of a link differ in at most U
elements, so at most U segments differ (pigeonhole).  A set indexes U + 1 of
its segment subsets, least costly first: those that fewest sets have (the same
order for all, so a linked pair shares one).  Subsets of at most one element,
which unrelated sets share, are left out; a set that would need them spends
two units on a segment instead of one: it indexes the one-deletion
neighbourhood too, which also finds a segment that differs in one element, so
half as many segments do.

Candidates share an indexed key.  A hot key is never expanded into pairs:

1. every class meets the least class of its keys (the one with most common
   keys), and exact verification gives stars, whose components are computed;
2. only keys that still hold several components are looked at again.  With few
   members outside the key's largest component, those meet the members of
   others.  With many, all members are described by how they differ from one
   class; they meet the member nearest to their majority, and then only what
   may link is paired (_may_link, _by_pivot).

Keys are sent in packs of 12 bytes a key, and sets are moved only for pairs that
sketches of them don't rule out (_bits_apart).

So copies cost a row each, every link between different components is found
and verified exactly, and none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm import textnp as tn
from marketloom.llm.common import identity, packed, stored
from marketloom.llm.components import components

#: Ids that are broadcast to fetch candidate texts; beyond it, a shuffle join.
BROADCAST_IDS = 500_000
#: Upper end of a size band over its lower end.
BAND = 1.5
#: Members of a key outside its largest component, up to which all of them meet
#: the rest of the key one by one.
FEW = 48
#: Elements that a member far from p must have in common with others to be paired.
MET = 24
#: A class has its rows in so many parts where it may hold most of a table.
PARTS = 32
#: Elements of differences that are sorted at once.
HELD = 250_000
#: Parts of the keys, and keys that a task packs at once.
BUCKETS, PACKED = 1 << 13, 1 << 19
#: Bits of a key: its bucket, and what is sent of it.
KEY_BITS = 13 + 32
#: Documents whose facts are sent in a row, and rows that leave a task at once.
DOCS, ROWS = 256, 1 << 16
#: Stands for "every key" where a class needs its whole list.
ALL = -1
#: Segments beyond the pigeonhole's, as a share; they let costly ones be left out.
SPARE = 0.08


def most_differing(total: int, percent: int) -> int:
    """Largest symmetric difference of linked sets whose sizes add up to total."""
    return (100 - percent) * total // (100 + percent)


@lru_cache
def bands(percent: int, upto: int) -> list[tuple[int, int, int]]:
    """(least size, largest size, segments) up to a size; smaller sets only link when equal."""
    low = next(n for n in range(1, 10_000) if most_differing(n + 100 * n // percent, percent) > 0)
    out = []
    while not out or out[-1][1] < upto:
        high = max(low, int(low * BAND))
        m = most_differing(high + 100 * high // percent, percent) + 1
        out.append((low, high, m + int(np.ceil(SPARE * m))))
        low = high + 1
    return out


def keys(h: np.ndarray, percent: int) -> list[tuple[np.ndarray, int]]:
    """Index keys of a set (sorted distinct hashes) in its own size band and in
    the one below, if linked sets can lie there; with how many of them it needs."""
    n = len(h)
    table = bands(percent, 1 << max(6, int(n).bit_length()))
    none = np.empty(0, tn.U64), 0
    if n < table[0][0]:
        return [none, none]
    own = next(i for i, b in enumerate(table) if n <= b[1])
    out = [_band_keys(h, own, table[own][2], most_differing(n + 100 * n // percent, percent)), none]
    if own and -(-percent * n // 100) < table[own][0]:
        out[1] = _band_keys(h, own - 1, table[own - 1][2], most_differing(n + table[own - 1][1], percent))
    return out


def _band_keys(h: np.ndarray, band: int, m: int, differ: int) -> tuple[np.ndarray, int]:
    # h is sorted, and segments are ranges of it.
    segment = ((h >> tn.U64(32)) * tn.U64(m)) >> tn.U64(32)
    at = np.searchsorted(segment, np.arange(m + 1, dtype=tn.U64))
    token = tn.mix(h ^ tn.U64(0x5851F42D4C957F2D))
    sums = np.concatenate([np.zeros(1, tn.U64), np.cumsum(token, dtype=tn.U64)])
    count = np.diff(at)
    place = tn.mix(np.arange(m, dtype=tn.U64) + tn.U64((band + 1) << 32))
    total = sums[at[1:]] - sums[at[:-1]]
    key = lambda total, count, place: tn.mix(total + place * (count.astype(tn.U64) * tn.U64(2) + tn.U64(1)))
    exact = key(total, count, place)
    cheap = exact[count >= 2]
    if len(cheap) > differ:
        return cheap, differ + 1
    least = 2 if 2 * len(cheap) > differ else 1
    shown = exact[count >= 1] if least == 2 else exact
    of = segment.astype(np.int64)
    cut = count[of] >= least
    fewer = key(total[of] - token, count[of] - 1, place[of])[cut]
    return np.concatenate([shown, fewer]), ALL


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    column = batch.column(batch.schema.get_field_index("text"))
    for first, end, data, at in tn.pieces(column):
        word, text, _, _ = tn.words(data, at)
        h, bounds = tn.shingles(word, text, end - first, k)
        for i in range(end - first):
            yield first + i, tn.distinct_sorted(h[bounds[i] : bounds[i + 1]])


def _class_of(h: np.ndarray) -> int:
    if not len(h):
        return 0
    c = tn.mix(np.array([np.sum(tn.mix(h + tn.U64(77)), dtype=tn.U64) + tn.U64(len(h))], dtype=tn.U64))
    return int(tn.signed(c)[0]) & -2  # even: the last bit carries the slot of a key


#: What is known of a document: of its keys, those of its own band (size0) come
#: first, then those of the band below, and so many of them are needed.
DOC = "struct<doc_id:long,text_hash:long,n_shingles:long,cls:long,size0:int,size1:int,need0:int,need1:int>"
DOC_TYPE = pa.struct([*[(c, pa.int64()) for c in ("doc_id", "text_hash", "n_shingles", "cls")], *[(c, pa.int32()) for c in ("size0", "size1", "need0", "need1")]])


def _packs(keys: list[np.ndarray], senders: list[int]) -> pa.RecordBatch:
    """A row for each bucket: its keys, and who sends each of them."""
    sender = np.repeat(np.array(senders, np.int64), [len(x) for x in keys])
    key = np.concatenate(keys)
    bucket = (key >> tn.U64(32)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
    held = np.flatnonzero(np.diff(cut))
    at = np.append(cut[held], len(order))
    flat = lambda x: pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer((at * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
    docs = pa.nulls(len(held), pa.list_(DOC_TYPE))
    return pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), flat(key.astype(np.uint32)[order]), flat(sender[order]), docs], names=["bucket", "keys", "senders", "docs"])


def _describe(k: int, percent: int):
    """Index keys of the documents in packs, each of one bucket; and, in any
    bucket, what is known of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task's rows: equal sets send their keys once
        found, senders, waiting, turn = [], [], 0, 0
        for batch in batches:
            n, cls, facts = [], [], ([], [], [], [])
            for _, h in _sets(batch, k):
                c = _class_of(h)
                n.append(len(h))
                cls.append(c)
                got = None if c in seen else keys(h, percent)
                seen.add(c)
                for i in (0, 1):
                    own = got and tn.distinct_sorted(got[i][0] >> tn.U64(64 - KEY_BITS))
                    facts[i].append(got and len(own))
                    facts[2 + i].append(got and got[i][1])
                    if got and len(own):
                        found.append(own)
                        senders.append(c | i)
                        waiting += len(own)
                if waiting >= PACKED:
                    yield _packs(found, senders)
                    found, senders, waiting = [], [], 0
            if batch.num_rows:
                column = lambda c: batch.column(batch.schema.get_field_index(c))
                columns = [column("doc_id"), column("text_hash"), *[pa.array(x, t) for x, t in zip([n, cls, *facts], [f.type for f in DOC_TYPE][2:], strict=True)]]
                docs = pa.StructArray.from_arrays(columns, fields=list(DOC_TYPE))
                at = np.append(np.arange(0, len(docs), DOCS), len(docs))
                bucket = (np.arange(turn, turn + len(at) - 1) * 2_654_435_761 + (cls[0] >> 1)) % BUCKETS
                turn += len(bucket)
                none = pa.nulls(len(bucket), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), none, none, pa.ListArray.from_arrays(pa.array(at, pa.int32()), docs)], names=["bucket", "keys", "senders", "docs"])
        if found:
            yield _packs(found, senders)

    return run


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packs in the order of their buckets: a row for each sender of a key
    that several classes send, with how many send it, and one for each document."""
    names = ["key", "cls", "slot", "uses", "doc"]
    at, packs = -1, []

    def done() -> Iterator[pa.RecordBatch]:
        key, sender = (np.concatenate([np.frombuffer(p[i], t) for p in packs]) for i, t in ((0, np.uint32), (1, np.int64)))
        order = np.argsort(key, kind="stable")
        key = key[order]
        cut = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        uses = np.diff(cut)
        some = np.repeat(uses > 1, uses)
        key, sender, uses = key[some], sender[order[some]], uses[uses > 1]
        cls = sender & -2
        first = np.cumsum(uses) - uses
        if len(first):
            shared = np.repeat(np.minimum.reduceat(cls, first) < np.maximum.reduceat(cls, first), uses)
            key, sender, cls, uses = key[shared], sender[shared], cls[shared], np.repeat(uses, uses)[shared]
        for i in range(0, len(key), ROWS):
            own = slice(i, i + ROWS)
            whole = key[own].astype(np.int64) | np.int64(at << 32)
            columns = [pa.array(whole), pa.array(cls[own]), pa.array((sender[own] & 1).astype(np.int32)), pa.array(uses[own].astype(np.int64)), pa.nulls(len(whole), DOC_TYPE)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        buckets, keys_, senders, docs = (batch.column(batch.schema.get_field_index(c)) for c in ("bucket", "keys", "senders", "docs"))
        rows = docs.flatten().cast(DOC_TYPE)
        if len(rows):
            none = lambda t: pa.nulls(len(rows), t)
            yield pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int64()), none(pa.int32()), none(pa.int64()), rows], names=names)
        for i, bucket in enumerate(buckets.to_pylist()):
            if keys_[i].is_valid:
                if bucket != at and packs:
                    yield from done()
                    packs = []
                at = bucket
                packs.append((keys_[i].as_py(), senders[i].as_py()))
    if packs:
        yield from done()


def _sketch(h: np.ndarray) -> np.ndarray:
    """For each of about as many bits as a set has elements, whether an odd
    number of them fall on it.  Sets differ in at least as many elements as
    their sketches differ in bits."""
    bits = 1 << max(6, int(len(h) - 1).bit_length())
    odd = np.bincount((tn.mix(h + tn.U64(1234567)) & tn.U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _bits_apart(a: str, b: str) -> Column:
    """Bits in which two sketches differ; the longer one is folded, if it is twice as long."""
    half = lambda c: (F.size(c) / 2).cast("int")
    xor = lambda x, y: x.bitwiseXOR(y)
    fold = lambda c: F.zip_with(F.slice(c, F.lit(1), half(c)), F.slice(c, half(c) + 1, half(c)), xor)
    x, y = F.when(F.size(a) == 2 * F.size(b), fold(a)).otherwise(F.col(a)), F.when(F.size(b) == 2 * F.size(a), fold(b)).otherwise(F.col(b))
    bits = F.aggregate(F.zip_with(x, y, xor), F.lit(0), lambda n, w: n + F.bit_count(w))
    return F.coalesce(F.when(F.greatest(F.size(a), F.size(b)) <= 2 * F.least(F.size(a), F.size(b)), bits), F.lit(0))


def _held_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            want = batch.column(batch.schema.get_field_index("cls")).to_pylist()
            # A repeated doc_id brings other texts along, or the same again.
            held = {want[i]: h for i, h in _sets(batch, k) if want[i] not in seen and _class_of(h) == want[i]}
            seen.update(held)

            def lists(x: list[np.ndarray]) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate([*x, np.empty(0, np.int64)])))

            columns = [pa.array(held.keys(), pa.int64()), lists([tn.signed(h) for h in held.values()]), lists([_sketch(h) for h in held.values()])]
            yield pa.RecordBatch.from_arrays(columns, names=["cls", "held", "sketch"])

    return run


def _fetch(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of texts (doc_id, text) for ids (doc_id, cls), without moving the other texts."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return texts.join(ids, "doc_id")


def _of(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """The sets of classes (cls), without moving the others."""
    if classes.count() <= BROADCAST_IDS:
        classes = F.broadcast(classes)
    return sets.select("cls", "held").join(classes, "cls", "left_semi")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose classes are in different components."""
    for side in "ab":
        known = roots.select(F.col("v").alias(side), F.col("root").alias(f"root_{side}"))
        pairs = pairs.join(known, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    return pairs.where("root_a <> root_b").select("a", "b")


def _across(mixed: DataFrame) -> DataFrame:
    """Pairs between components within keys that have few members outside the
    largest: at most FEW pairs for each member of a key."""
    few = mixed.where(F.col("outside") <= FEW)
    x = few.where("root <> major").select("key", F.col("cls").alias("x"), F.col("root").alias("rx"))
    y = few.select("key", F.col("cls").alias("y"), F.col("root").alias("ry"), "major")
    pairs = x.join(y, "key").where("rx <> ry and (ry = major or x < y)")
    return stored(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "jaccard-across")


def _deltas(mixed: DataFrame, sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of the other keys (p, cls, np, n, d, delta): how each differs
    from one class p, the root of the key's largest component."""
    hot = mixed.where(F.col("outside") > FEW).select(F.col("major").alias("p"), "cls")
    rows = hot.union(hot.select("p", F.col("p").alias("cls"))).distinct()
    sets = _of(sets, rows.select("cls").distinct())
    for side in ("p", "cls"):
        size = sizes.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"))
        held = sets.select(F.col("cls").alias(side), F.col("held").alias(f"held_{side}"))
        rows = rows.join(size, side).join(held, side)
    delta = F.concat(F.array_except("held_cls", "held_p"), F.array_except("held_p", "held_cls"))
    rows = rows.select("p", "cls", F.col("n_p").cast("long").alias("np"), F.col("n_cls").cast("long").alias("n"), delta.alias("delta"))
    return stored(rows.withColumn("d", F.size("delta").cast("long")), "jaccard-deltas")


def _tokens(members: DataFrame) -> DataFrame:
    """The elements of each difference that more than one member of p has, with
    the number of members (uses) and the place in the difference, rarest first."""
    token = members.where("d > 0").select("*", F.explode("delta").alias("token")).drop("delta")
    token = token.withColumn("uses", F.count(F.lit(1)).over(Window.partitionBy("p", "token"))).where("uses > 1")
    member = Window.partitionBy("p", "cls")
    place = F.row_number().over(member.orderBy("uses", "token")) + F.col("d") - F.count(F.lit(1)).over(member)
    return stored(token.withColumn("place", place), "jaccard-tokens")


def _with_p(rows: DataFrame, of_p: DataFrame) -> DataFrame:
    """Members joined with what their p has (a row), in PARTS parts of each p."""
    parts = of_p.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("part", F.pmod(F.xxhash64("cls"), F.lit(PARTS)).cast("int")).join(parts, ["p", "part"]).drop("part")


def _usual(members: DataFrame) -> DataFrame:
    """(p, usual): the elements that more than half of the differences from p hold.

    A p's members are dealt to parts of about HELD elements.  In a part's sorted
    elements, one that more than half of its members have comes again that many
    places on, so no row is made for an element.  With several parts, one is
    usual if it is in more than half of them.  A part has at most twice as many
    as its differences have on average.
    """
    parts = members.groupBy("p").agg(F.greatest(F.lit(1), F.ceil(F.sum("d") / HELD)).alias("parts"))
    dealt = _with_p(members, parts).groupBy("p", "parts", F.pmod(F.xxhash64("p", "cls"), "parts").alias("of"))
    dealt = dealt.agg(F.sort_array(F.flatten(F.collect_list("delta"))).alias("held"), F.floor(F.count(F.lit(1)) / 2).cast("int").alias("half"))
    again = F.filter("held", lambda x, i: (F.col("half") > 0) & (F.get("held", i + F.col("half")) == x))
    uses = dealt.select("p", "parts", F.explode(F.array_distinct(again)).alias("token")).groupBy("p", "parts", "token").count()
    usual = uses.where(2 * F.col("count") > F.col("parts")).groupBy("p").agg(F.collect_list("token").alias("usual"))
    return parts.select("p").join(usual, "p", "left").select("p", F.coalesce("usual", F.array().cast("array<bigint>")).alias("usual"))


def _centre_stars(members: DataFrame) -> DataFrame:
    """Every member of a p with the member that is nearest to what most of them
    have: the one whose difference from p is nearest to the elements that more
    than half of the differences hold.  Those are at most twice as many as a
    difference has on average, so they are one array for each p."""
    away = _with_p(members, _usual(members)).select("p", "cls", (F.col("d") - 2 * F.size(F.array_intersect("delta", "usual"))).alias("away"))
    centre = away.groupBy("p").agg(F.min_by("cls", F.struct("away", "cls")).alias("c"))
    pairs = _with_p(members.select("p", "cls"), centre).where("cls <> c").select(F.least("cls", "c").alias("a"), F.greatest("cls", "c").alias("b"))
    return pairs.distinct()


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of each p that still has several components, with their own root
    and p's.  The others are done, however many members they have."""
    known = roots.select(F.col("v").alias("cls"), "root")
    rows = members.join(known, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    of_p = rows.groupBy("p").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.when(F.col("cls") == F.col("p"), F.col("root"))).alias("p_root"))
    return stored(_with_p(rows, of_p.where("lo < hi").select("p", "p_root")), "jaccard-open")


def _may_link(rows: DataFrame, percent: int) -> DataFrame:
    """rows without members that link with no member of another component of their p.

    x has s elements in common with p, and a link of x has at least percent of
    x's in common.  Of a member far from p more than s are needed, so need of
    them are among those that p lacks.  In any one order, the first
    |x less p| - need + MET of those hold the first MET that both have, and so
    do the other member's.  A far member is left out where fewer of its first
    are another component's too.  Only these are counted, not whole differences.
    """
    lacked = ((F.col("d") + F.col("n") - F.col("np")) / 2).cast("int")  # they come first in delta
    need = F.ceil(F.col("n") * percent / 100).cast("int") - F.col("n").cast("int") + lacked
    first = F.slice(F.array_sort(F.slice("delta", F.lit(1), lacked)), F.lit(1), lacked - F.greatest(need, F.lit(1)) + MET)
    token = stored(rows.select("p", "cls", "root", need.alias("need"), F.explode(first).alias("token")), "jaccard-first")
    met = token.groupBy("p", "token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("p", "token")
    alive = token.where("need > 0").join(met, ["p", "token"], "left_semi").groupBy("p", "cls").agg(F.count(F.lit(1)).alias("met"), F.first("need").alias("need"))
    alive = alive.where(F.col("met") >= F.least("need", F.lit(MET))).select("p", "cls")
    return stored(rows.where(need <= 0).unionByName(rows.where(need > 0).join(alive, ["p", "cls"], "left_semi").select(*rows.columns)), "jaccard-may-link")


def _by_pivot(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that may link, found without pairing members.

    With d(x) = x without p, and p without x, two members x and y differ in d(x)
    less d(y) and the reverse.  Let u be the most that linked sets of their
    sizes may differ in.

    If |d(x)| + |d(y)| <= u, they link whatever the elements are.  One y is
    best for every x: the one that maximises (100 - percent) |y| - (100 +
    percent) |d(y)|.  So x is paired with that one only.

    Otherwise d(x) and d(y) share o = ceil((|d(x)| + |d(y)| - u) / 2) >= 1
    elements, so the first |d| - o + 1 of both, rarest first within p, share
    one.  The smaller of both is indexed as far as that can reach, and elements
    that only one member has are left out; what near copies of p share are its
    own elements, which come last.
    """
    lost, kept = 100 - percent, 100 + percent
    token, rows = _tokens(rows), rows.drop("delta")
    worth = F.col("n") * lost - F.col("d") * kept
    best = rows.groupBy("p").agg(F.max(worth).alias("worth"), F.max_by(F.struct("cls", "root"), F.struct(worth, "cls")).alias("y"))
    sure = _with_p(rows, best.select("p", "worth", F.col("y.cls").alias("y"), F.col("y.root").alias("y_root")))
    sure = sure.where("root <> y_root").where(F.col("d") * kept <= F.col("n") * lost + F.col("worth"))
    sure = sure.select(F.least("cls", "y").alias("a"), F.greatest("cls", "y").alias("b"))

    # y has the smaller difference.  If it is in p's component, x is not, so
    # |d(x)| is more than p and x may differ in.
    slack = F.greatest(F.lit(0), F.ceil(F.lit(lost) * (F.col("n") - F.col("np")) / kept))
    widest = F.floor(F.lit(lost) * (F.col("n") + F.floor(F.lit(100) * F.col("n") / percent)) / kept)
    shared = F.when(F.col("root") == F.col("p_root"), F.ceil((F.col("d") + 1 - slack) / 2)).otherwise(F.ceil((2 * F.col("d") - widest) / 2))
    first = token.where(F.col("place") <= F.col("d") - F.greatest(shared, F.lit(1)) + 1)
    y = first.select("p", "token", *[F.col(c).alias(f"y_{c}") for c in ("cls", "root", "n", "d", "place")])
    x = token.select("p", "token", *[F.col(c).alias(f"x_{c}") for c in ("cls", "root", "n", "d", "place")])
    u = F.floor(F.lit(lost) * (F.col("x_n") + F.col("y_n")) / kept)
    o = F.greatest(F.lit(1), F.ceil((F.col("x_d") + F.col("y_d") - u) / 2))
    pairs = x.join(y, ["p", "token"]).where(
        (F.struct("x_d", "x_cls") > F.struct("y_d", "y_cls")) & (F.col("x_root") != F.col("y_root"))
        & (F.col("x_place") <= F.col("x_d") - o + 1) & (F.col("y_place") <= F.col("y_d") - o + 1)
    )
    pairs = pairs.select(F.least("x_cls", "y_cls").alias("a"), F.greatest("x_cls", "y_cls").alias("b"))
    return stored(sure.union(pairs).distinct(), "jaccard-by-pivot")


def link(df: DataFrame, k: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(documents, roots) of a table with long doc_id and string text.

    documents: doc_id, text_hash, n_shingles, cls - one row for each input row; equal sets
    have equal cls.  roots: v, root - of every class that links to another.
    Two sets link when 100 * common >= percent * union.  A null text is empty;
    empty sets link with nothing.  Hashes have 64 bits.
    """
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    # One pass over the texts sends the keys in packs, and with them what else is
    # known of the documents.  Most keys have one class and end here, so they are
    # never stored.
    sent = texts.mapInArrow(_describe(k, percent), f"bucket int, keys binary, senders binary, docs array<{DOC}>")
    sent = sent.repartition("bucket").sortWithinPartitions("bucket")
    described = stored(sent.mapInArrow(_shared_keys, f"key long, cls long, slot int, uses long, doc {DOC}"), "jaccard-documents")
    docs = described.where("doc is not null").select("doc.doc_id", "doc.text_hash", "doc.n_shingles", "doc.cls")
    rep = docs.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))

    by_key = Window.partitionBy("key")
    ends = {"least": F.min("cls").over(by_key), "most": F.max("cls").over(by_key)}
    indexed = described.where("doc is null").select("key", "cls", "slot", "uses").distinct()
    # Of its keys a class needs the rarest; those that no other class has come first.
    facts = described.where("doc.need0 is not null").select("doc.*").groupBy("cls").agg(*[F.max(F.struct(f"size{i}", f"need{i}")).alias(f"s{i}") for i in (0, 1)])
    facts = facts.select("cls", F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.col(f"s{i}.size{i}").alias("size"), F.col(f"s{i}.need{i}").alias("need")) for i in (0, 1)])).alias("x"))
    own = Window.partitionBy("cls", "slot")
    indexed = indexed.join(facts.select("cls", "x.*"), ["cls", "slot"])
    place = F.row_number().over(own.orderBy("uses", "key")) + F.col("size") - F.count(F.lit(1)).over(own)
    indexed = indexed.withColumn("place", place).where((F.col("need") == ALL) | (F.col("place") <= F.col("need")))
    indexed = indexed.select("key", "cls").distinct().withColumns(ends)
    shared = stored(indexed.where("least < most").select("key", "cls", "least"), "jaccard-keys")

    # Texts of the classes that share a key: their sets, once.
    members = shared.select("cls").distinct().join(rep, "cls")
    members = stored(members, "jaccard-members")
    fetched = _fetch(texts, members.select("doc_id", "cls"))
    sets = stored(fetched.mapInArrow(_held_sets(k), "cls long, held array<long>, sketch array<long>"), "jaccard-sets")
    sizes = members.select("cls", "n")

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs that link.  Sketches leave out most others; only sets of the rest are moved."""
        for side in "ab":
            of = sizes.join(sets.select("cls", "sketch"), "cls")
            pairs = pairs.join(of.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
        pairs = pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        apart = F.floor(F.lit(100 - percent) * (F.col("n_a") + F.col("n_b")) / (100 + percent))
        pairs = stored(pairs.where(_bits_apart("sketch_a", "sketch_b") <= apart).select("a", "b").distinct(), "jaccard-near")
        some = _of(sets, pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct())
        held = pairs.join(some.select(F.col("cls").alias("b"), F.col("held").alias("held_b")), "b")
        held = held.join(some.select(F.col("cls").alias("a"), F.col("held").alias("held_a")), "a")
        both = F.size(F.array_intersect("held_a", "held_b"))
        union = F.size("held_a") + F.size("held_b") - both
        return stored(held.where(both * 100 >= union * percent).select("a", "b"), "jaccard-links")

    stars = shared.where("cls <> least").groupBy(F.col("least").alias("a"), F.col("cls").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    stars = stars.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    links = verified(stars)
    roots = components(links)

    known = roots.select(F.col("v").alias("cls"), "root")
    rooted = shared.join(known, "cls", "left").select("key", "least", "cls", F.coalesce("root", "cls").alias("root"))
    parts = stored(rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")), "jaccard-parts")
    split = parts.groupBy("key").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.max_by("root", F.struct("n", "root")).alias("major"),
        (F.sum("n") - F.max("n")).alias("outside"),
    )
    split = split.where("lo < hi").select("key", "major", "outside")
    mixed = stored(rooted.join(split, "key"), "jaccard-mixed")
    members_of = _deltas(mixed, sets, sizes)
    centred = stored(_centre_stars(members_of), "jaccard-centres")
    if not centred.isEmpty():
        links = links.union(verified(_apart(centred, roots)))
        roots = components(links)
    more = [_apart(_across(mixed), roots), _by_pivot(_may_link(_open(members_of, roots), percent), percent)]
    rest = stored(more[0].union(more[1]).distinct(), "jaccard-rest")
    if not rest.isEmpty():
        roots = components(links.union(verified(rest)))
    return docs, roots


def grouped(df: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id: one row for each input row.

    component_id is the smallest doc_id that links reach, the row's own
    included; a row with an empty set has its own doc_id.  Repeated rows stay.
    A row with null doc_id joins rows with an equal set; a set that only such
    rows have has null component_id.  Whole texts of any length count; an empty
    table gives an empty table; only doc_id and text are read, so other columns
    may have any names.
    """
    docs, roots = link(df, k, percent)
    some = docs.where("n_shingles > 0")
    least = some.groupBy("cls").agg(F.min("doc_id").alias("least"))
    least = least.join(roots.withColumnRenamed("v", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    whole = least.groupBy("root").agg(F.min("least").alias("component_id"))
    to = least.join(whole, "root").select("cls", "component_id")
    out = some.join(to, "cls").select("doc_id", "text_hash", "n_shingles", "component_id")
    return out.unionByName(docs.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id")))


def deduplicated(df: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df that stand for their component: of each, the row with the
    smallest doc_id, once.

    Rows without words all stay, repeated ones once.  A row with null doc_id
    stays only if no row with a doc_id has its set.  Of several rows with that
    id and text, the one with the least hash of its values stays.  Whole texts
    of any length count; an empty table gives an empty table; other columns may
    have any names.
    """
    same = [F.coalesce("doc_id", F.lit(0)).alias("at"), F.col("doc_id").isNull().alias("none"), "text_hash"]
    on = ["at", "none", "text_hash"]
    marks = grouped(df, k, percent).select(*same, F.expr("component_id <=> doc_id").alias("stays"))
    marks = stored(marks.groupBy(*on).agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("n")), "jaccard-marks")
    gone, twice = marks.where("not stays").select(*on), marks.where("stays and n > 1").select(*on)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), identity(df, 5).alias("tie"), packed(df))
    rows = rows.select(*same, "tie", "row")

    def once(repeated: DataFrame) -> DataFrame:
        first = F.row_number().over(Window.partitionBy(*on).orderBy("tie"))
        return repeated.withColumn("first", first).where("first = 1").select("row.*")

    if marks.where("not stays or n > 1").count() > BROADCAST_IDS:
        return once(rows.join(marks.where("stays").select(*on), on, "left_semi"))
    # Few go or are repeated: the other rows need not move.
    single = rows.join(F.broadcast(gone), on, "left_anti").join(F.broadcast(twice), on, "left_anti")
    return single.select("row.*").unionByName(once(rows.join(F.broadcast(twice), on, "left_semi")))


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return grouped(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85).drop("text_hash")
