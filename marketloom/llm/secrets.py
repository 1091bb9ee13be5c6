"""Secret scan: fixed patterns, and sliding-window Shannon entropy.

Everything is a projection of built-in functions over the whole text: no
shuffle and no Python on the executors.

Offsets of the matches of a pattern come from split(): the pieces between the
matches and the matches themselves, added up.  Offsets are code points, the
end is exclusive.

Entropy spans: candidates are maximal runs of a class's characters.  A window
of fixed width slides over each; counts per character and the sum of
c * log2(c) are updated by the character that enters and the one that leaves,
so a step costs the same at any width.  The span reported runs from the first
to the last window whose entropy reaches the class's threshold.  Candidates on
the allow-list are dropped, and so are spans inside a span found by pattern.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import packed, quoted

KINDS = ("assign", "access", "hex", "entropy")

#: kind -> (pattern, group whose length counts, least length).  Runs that the
#: last two would drop as too short are left out by the pattern itself: a
#: maximal run is as long as any match that starts in it.
PATTERNS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}


@dataclass(frozen=True)
class EntropyClass:
    """Runs of the alphabet's characters; bits: least entropy of a window; needs: what a run must contain."""

    pattern: str
    alphabet: str
    width: int
    bits: float
    needs: tuple[str, ...]
    fold: bool = False


CLASSES = (
    EntropyClass(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{16,}(?![0-9A-Za-z])", "0123456789abcdef", 16, 2.75, ("[0-9]", "[A-Fa-f]"), fold=True),
    EntropyClass(
        r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-",
        24, 3.9, ("[0-9]", "[A-Z]", "[a-z]"),
    ),
)

#: Candidates that match one of these are no secrets: documented examples,
#: UUIDs, alphabets and counters.
ALLOW = (
    r"(?i)example",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)0123456789abcdef|fedcba9876543210|abcdefghijklmnop",
    r"(?i)deadbeefdeadbeef",
)

SPAN = "array<struct<start:int,rank:int,end:int,bits:double,piece:string>>"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(text: str, pattern: str, group: int, least: int, rank: int) -> Column:
    """Spans of the matches of pattern in the column text whose group is long enough."""
    p = _quoted(pattern)
    return F.expr(
        f"""case when {text} rlike {p} then aggregate(
              arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group})),
              named_struct('at', 0, 'out', cast(array() as {SPAN})),
              (a, x) -> named_struct(
                'at', a.at + length(x.`0`) + coalesce(length(x.`1`), 0),
                'out', case when length(x.`2`) >= {least} then concat(a.out, array(named_struct(
                    'start', a.at + length(x.`0`), 'rank', {rank},
                    'end', a.at + length(x.`0`) + length(x.`1`), 'bits', cast(null as double), 'piece', x.`1`))) else a.out end),
              a -> a.out)
            else cast(array() as {SPAN}) end"""
    )


def _entropy_spans(found: str, k: EntropyClass, allow: tuple[str, ...], rank: int) -> Column:
    """Of candidate spans, the parts with windows of high entropy."""
    keep = " and ".join([f"x.piece rlike {_quoted(n)}" for n in k.needs] + [f"not x.piece rlike {_quoted(a)}" for a in allow])
    c_log_c = "array(" + ",".join(["0d", *(f"{c * log2(c)!r}d" for c in range(1, k.width + 2))]) + ")"  # of counts 0, 1, 2, ...
    # A run is made an array of places in the alphabet once, so a step costs the
    # same wherever it is.  counts: one entry for each character of the alphabet;
    # total: sum of c * log2(c).  The entering character is counted first, then
    # the leaving one goes.
    piece = "lower(x.piece)" if k.fold else "x.piece"
    places = f"transform(split({piece}, ''), c -> locate(c, {_quoted(k.alphabet)}))"
    grow = f"""aggregate(sequence(1, size(at)),
        named_struct('counts', array_repeat(0, {len(k.alphabet)}), 'total', 0d, 'first', cast(null as int), 'last', cast(null as int), 'least', {k.width * (log2(k.width) + 1)}d),
        (a, i) -> aggregate(array(named_struct('new', at[i - 1], 'old', case when i > {k.width} then at[i - {k.width} - 1] end)),
            a,
            (b, m) -> aggregate(array(case when m.old <=> m.new then b.total else b.total
                  + {c_log_c}[b.counts[m.new - 1] + 1] - {c_log_c}[b.counts[m.new - 1]]
                  + case when m.old is null then 0d else {c_log_c}[b.counts[m.old - 1] - 1] - {c_log_c}[b.counts[m.old - 1]] end end),
                b,
                (c, t) -> named_struct(
                  'counts', case when m.old <=> m.new then c.counts
                    when m.old is null then concat(slice(c.counts, 1, m.new - 1), array(c.counts[m.new - 1] + 1), slice(c.counts, m.new + 1, {len(k.alphabet)} - m.new))
                    when m.new < m.old then concat(slice(c.counts, 1, m.new - 1), array(c.counts[m.new - 1] + 1), slice(c.counts, m.new + 1, m.old - m.new - 1), array(c.counts[m.old - 1] - 1), slice(c.counts, m.old + 1, {len(k.alphabet)} - m.old))
                    else concat(slice(c.counts, 1, m.old - 1), array(c.counts[m.old - 1] - 1), slice(c.counts, m.old + 1, m.new - m.old - 1), array(c.counts[m.new - 1] + 1), slice(c.counts, m.new + 1, {len(k.alphabet)} - m.new)) end,
                  'total', t,
                  'first', case when i >= {k.width} and t <= {k.width * (log2(k.width) - k.bits) + 1e-9}d then coalesce(c.first, i - {k.width}) else c.first end,
                  'last', case when i >= {k.width} and t <= {k.width * (log2(k.width) - k.bits) + 1e-9}d then i else c.last end,
                  'least', case when i >= {k.width} then least(c.least, t) else c.least end))))"""
    return F.expr(
        f"""filter(transform(filter({found}, x -> {keep}), x -> aggregate(transform(array({places}), at -> {grow}),
              named_struct('start', 0, 'rank', {rank}, 'end', 0, 'bits', 0d, 'piece', ''),
              (z, g) -> named_struct('start', x.start + g.first, 'rank', {rank}, 'end', x.start + g.last, 'bits', log2({k.width}) - g.least / {k.width},
                                     'piece', substring(x.piece, g.first + 1, g.last - g.first)))), s -> s.start is not null)"""
    )


def scan(df: DataFrame, text: str = "text", classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """df with spans: array of (start, rank, end, bits, piece), by start, then kind.

    rank is the kind's place in KINDS; bits the highest entropy of a window
    (null for patterns); piece the text of the span.  Whole texts of any length
    are read; a null or empty one has no spans; repeated rows have equal spans;
    of spans that start together the kinds' order decides.  An empty table gives
    an empty table.  An input column named spans is replaced; others may have
    any names.
    """
    rows = df.select(packed(df, ("spans",)), F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text"))
    base = [_matches("text", *PATTERNS[kind], rank) for rank, kind in enumerate(KINDS[:-1])]
    found = {f"found{i}": _matches("text", k.pattern, 0, k.width, len(KINDS) - 1) for i, k in enumerate(classes)}
    rows = rows.withColumns({"base": F.concat(*base)} | found)
    more = [_entropy_spans(f"found{i}", k, allow, len(KINDS) - 1) for i, k in enumerate(classes)]
    rows = rows.withColumn("more", F.concat(*more))
    spans = F.expr(
        """array_sort(concat(base, array_distinct(filter(more, (m, i) ->
             not exists(base, b -> b.start <= m.start and m.end <= b.end)
             and not exists(slice(more, 1, i), o -> o.start <= m.start and m.end <= o.end)))))"""
    )
    return rows.select("row.*", spans.alias("spans"))


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs).select("doc_id", "spans")
    names = "array(" + ",".join(_quoted(k) for k in KINDS) + ")"
    said = lambda spans: f"array_join(transform({spans}, s -> concat(element_at({names}, s.rank + 1), ':', s.start, ':', s.end)), ',')"
    count = lambda rank: F.expr(f"cast(size(filter(spans, s -> s.rank = {rank})) as bigint)")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.expr(said("filter(spans, s -> s.rank < 3)")), 256).alias("base_sha256"),
        F.expr(said("spans")).alias("spans"),
        count(3).alias("n_entropy"),
    )
