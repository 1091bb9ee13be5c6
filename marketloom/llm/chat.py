"""Preference formatting of paired conversations.

A pair holds a chosen and a rejected conversation.  Their longest common
prefix of turns (same role and text, turn by turn) is rendered once as the
prompt; what follows on each side is that side's completion.  Masks are spans:
only the text of assistant turns of a completion, and its closing mark, is
trained on.

All is built from DataFrame functions: turns are gathered per conversation,
then two conversations meet by their pair's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import columns

#: Marks around a turn.
OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TURNS = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turns (array of role, text, in order of turn).

    Null role or text counts as empty; turns with a null number come first;
    equal numbers go by role, then text; repeated rows stay.  Rows without a
    conversation are left out.  A conversation's turns are one row, as the
    format needs them: its memory is that of its longest conversation.
    """
    one = F.struct(
        F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    rows = turns.where(F.col(conv).isNotNull()).groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns"))


def pair_by_id(convs: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, chosen, rejected: conversations 2i and 2i + 1 (whole numbers of 64 bits).

    The one with more assistant text (code points) is chosen, the one with the
    smaller id if both have as much.  A conversation without its partner has no
    pair.
    """
    said = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + F.when(t["role"] == "assistant", F.length(t["text"])).otherwise(0))
    rows = convs.select(F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair"), F.struct(-said, F.col("conv_id"), F.col("turns")).alias("side"))
    two = rows.groupBy("pair").agg(F.sort_array(F.collect_list("side")).alias("sides")).where(F.size("sides") == 2)
    side = lambda i, name: F.element_at("sides", i)[name]
    return two.select(
        side(1, "conv_id").alias("chosen_id"), side(2, "conv_id").alias("rejected_id"), side(1, "turns").alias("chosen"), side(2, "turns").alias("rejected")
    )


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(AFTER_ROLE), t["text"], F.lit(CLOSE))), "")


def masked(turns: Column) -> Column:
    """Spans (start, end; code points, end exclusive) of a rendered completion to train on."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def add(a: Column, t: Column) -> Column:
        head = a["at"] + len(OPEN) + F.length(t["role"]) + len(AFTER_ROLE)
        end = (head + F.length(t["text"]) + len(CLOSE)).cast("long")
        span = F.array(F.struct(head.cast("long").alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda a: a["spans"])


def preference_format(pairs: DataFrame) -> DataFrame:
    """pairs (chosen, rejected: turns) with prompt, common_turns, and for both
    sides its completion and its mask.

    A null side has no turns.  If one side is a prefix of the other, its
    completion is empty.  Turns may have any length, repeated pairs stay, and an
    empty table gives an empty table.  Input columns with these names are
    replaced; others may have any names.
    """
    made = ("prompt", "common_turns", "chosen_completion", "rejected_completion", "chosen_mask", "rejected_mask")
    rows = pairs.select(*columns(pairs, made))
    for side in ("chosen", "rejected"):
        rows = rows.withColumn(side, F.coalesce(F.col(side).cast(TURNS), F.array().cast(TURNS)))
    # The first turn at which the sides differ, counted from 1; arrays_zip ends the shorter side with nulls.
    equal = F.transform(F.arrays_zip("chosen", "rejected"), lambda z: z["chosen"].eqNullSafe(z["rejected"]))
    common = F.coalesce(F.nullif(F.array_position(equal, False), F.lit(0).cast("long")) - 1, F.size("chosen").cast("long"))
    rows = rows.withColumn("common_turns", common)
    rest = {s: F.slice(s, F.col("common_turns").cast("int") + 1, F.size(s)) for s in ("chosen", "rejected")}
    return rows.withColumns(
        {"prompt": render(F.slice("chosen", F.lit(1), F.col("common_turns").cast("int")))}
        | {f"{s}_completion": render(t) for s, t in rest.items()}
        | {f"{s}_mask": masked(t) for s, t in rest.items()}
    )


def op7_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Every pair of conversations 2i and 2i + 1."""
    convs = conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    said = lambda m: F.array_join(F.transform(m, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return preference_format(pair_by_id(convs)).select(
        "chosen_id", "rejected_id", "common_turns", "prompt", "chosen_completion", "rejected_completion",
        said(F.col("chosen_mask")).alias("chosen_mask"), said(F.col("rejected_mask")).alias("rejected_mask"),
    )


OP7_SQL = """
with convs as (
  select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as turns,
         sum(case when role = 'assistant' then length(coalesce(text, '')) else 0 end) as said
  from conversations where conv_id is not null group by conv_id),
ranked as (
  select *, conv_id // 2 as pair, row_number() over (partition by conv_id // 2 order by said desc, conv_id) as place from convs),
pairs as (
  select c.conv_id as chosen_id, r.conv_id as rejected_id, c.turns as a, r.turns as b
  from ranked c join ranked r on c.pair = r.pair and c.place = 1 and r.place = 2),
cut as (
  select *, coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]), false) - 1, least(len(a), len(b))) as common
  from pairs),
sides as (
  select chosen_id, rejected_id, cast(common as bigint) as common_turns, a[1:common] as p, a[common + 1:] as x, b[common + 1:] as y from cut)
select chosen_id, rejected_id, common_turns,
  coalesce(array_to_string(list_transform(p, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') as prompt,
  coalesce(array_to_string(list_transform(x, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') as chosen_completion,
  coalesce(array_to_string(list_transform(y, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') as rejected_completion,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(x) + 1), lambda i: x[i].role = 'assistant'), lambda i:
    cast(coalesce(list_sum(list_transform(x[1:i - 1], lambda t: length(t.role) + length(t.text) + 13)), 0) + length(x[i].role) + 5 as bigint) || ':' ||
    cast(list_sum(list_transform(x[1:i], lambda t: length(t.role) + length(t.text) + 13)) as bigint)), ','), '') as chosen_mask,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(y) + 1), lambda i: y[i].role = 'assistant'), lambda i:
    cast(coalesce(list_sum(list_transform(y[1:i - 1], lambda t: length(t.role) + length(t.text) + 13)), 0) + length(y[i].role) + 5 as bigint) || ':' ||
    cast(list_sum(list_transform(y[1:i], lambda t: length(t.role) + length(t.text) + 13)) as bigint)), ','), '') as rejected_mask
from sides
"""
