"""Multi-party perspective rotation of dialogues. DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that participant as
``assistant`` and everyone else as a named user; the mask marks the characters that the
assistant speaks. System turns frame the dialogue: they are rendered as such and are nobody's
perspective.

A rendering is cut into pieces of at most PIECE turns, each with the offset of its first turn,
so that no row grows with the conversation, and one conversation with a third of all rows
is spread over the cluster. A whole rendering is its pieces joined in the order of ``piece``, with
each mask moved by the length of the pieces before.

Turns move once: those of a conversation meet in one task, which numbers them, cuts them into
pieces and only then rotates the pieces. Conversations over LARGE_TURNS turns or LARGE_CHARS
characters are numbered by a distributed sort instead, and their pieces are dealt out one by one.

Defined results: null texts are empty; a null or empty role is the participant ``unknown``;
rows with a null conv_id form one conversation; null turns come first; equal turn numbers are
ordered by role and text; repeated rows are repeated turns; a very long text stays whole in its
turn; a text or role that holds a turn mark gets a blank after the mark's first two characters,
and line breaks in a role become blanks, so that none can forge a turn; a conversation of system
turns only has no perspective; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_totals, written

PIECE, SYSTEM, OPEN, CLOSE = 64, "system", "<|im_start|>", "<|im_end|>\n"
LARGE_TURNS, LARGE_CHARS = 4096, 4_000_000


def plain(value: Column) -> Column:
    """Without marks that would open or close a turn."""
    for mark in (OPEN, CLOSE.strip()):
        value = F.replace(value, F.lit(mark), F.lit(f"{mark[:2]} {mark[2:]}"))
    return value


def in_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def pieces_of(rows: DataFrame, piece: int) -> DataFrame:
    """(conv_id, piece, turns) of rows that have their ``pos`` in the conversation."""
    turn = F.struct("pos", "role", "text")
    return rows.groupBy("conv_id", F.floor(F.col("pos") / piece).alias("piece")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def small_conversations(rows: DataFrame, piece: int) -> DataFrame:
    """(conv_id, piece, turns, people): one shuffle by conversation."""
    numbered = rows.withColumn("pos", (F.row_number().over(Window.partitionBy("conv_id").orderBy(*in_order())) - 1).cast("long"))
    roles = F.array_distinct(F.transform("turns", lambda t: t["role"]))
    return pieces_of(numbered, piece).withColumn("people", F.array_distinct(F.flatten(F.collect_set(roles).over(Window.partitionBy("conv_id")))))


def large_conversations(rows: DataFrame, piece: int) -> DataFrame:
    """The same for conversations of any length: turns are numbered by a distributed sort."""
    rows = written(rows, "chat-large-turns")
    order = [F.col("conv_id").asc_nulls_first(), *in_order()]
    numbered = running_totals(rows, order, {"row": F.lit(1)}, "chat-turns", spread_ties=True)
    first = written(numbered.groupBy("conv_id").agg(F.min("row").alias("first"), F.collect_set("role").alias("people")).withColumnRenamed("conv_id", "_conv"), "chat-first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    placed = numbered.join(first.select("_conv", "first"), same).select("conv_id", (F.col("row") - F.col("first")).alias("pos"), "role", "text")
    return pieces_of(placed, piece).join(first.select("_conv", "people"), same).drop("_conv")


def perspectives(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, perspective, piece, first_turn, n_turns, rendered, mask).

    ``mask`` lists [start, end) code-point spans of the assistant's words in ``rendered``.
    """
    role = F.coalesce(F.when(F.trim("role") != "", F.col("role")), F.lit("unknown"))
    clean = turns.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = clean.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    # written: its size tells Spark whether it may be broadcast
    large = written(sizes.where((F.col("n") > LARGE_TURNS) | (F.col("chars") > LARGE_CHARS)).select(F.col("conv_id").alias("_conv"), F.lit(True).alias("_large")), "chat-large")
    marked = clean.join(large, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    both = small_conversations(marked.where("_large is null").drop("_large"), piece)
    if not large.isEmpty():
        both = both.unionByName(large_conversations(marked.where("_large").drop("_large"), piece))
    seen = both.withColumn("perspective", F.explode(F.filter("people", lambda p: p != SYSTEM)))
    own = lambda t: t["role"] == F.col("perspective")
    name = lambda t: F.when(own(t), F.lit("assistant")).when(t["role"] == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), plain(F.translate(t["role"], "\n\r", "  "))))
    made = lambda t: F.struct(t["pos"].alias("pos"), F.concat(F.lit(OPEN), name(t), F.lit("\n")).alias("head"), plain(t["text"]).alias("text"), own(t).alias("own"))
    pieces = seen.select("conv_id", "perspective", "piece", F.transform("turns", made).alias("turns"))
    length = lambda t: F.length(t["head"]) + F.length(t["text"]) + len(CLOSE)
    step = lambda acc, t: F.struct(
        (acc["at"] + length(t)).alias("at"),
        F.when(t["own"], F.concat(acc["spans"], F.array(F.array(acc["at"] + F.length(t["head"]), acc["at"] + length(t))))).otherwise(acc["spans"]).alias("spans"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("spans"))
    return pieces.select(
        "conv_id",
        "perspective",
        "piece",
        F.element_at("turns", 1)["pos"].alias("first_turn"),
        F.size("turns").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(CLOSE))), "").alias("rendered"),
        F.aggregate("turns", start, step)["spans"].alias("mask"),
    )


def for_comparison(rendered: DataFrame) -> DataFrame:
    """The same rows with the mask as text (``start:end``, comma-joined)."""
    spans = F.transform("mask", lambda s: F.concat_ws(":", s[0].cast("string"), s[1].cast("string")))
    return rendered.withColumn("mask", F.array_join(spans, ","))


SQL = f"""
with clean as (select conv_id, turn, coalesce(case when trim(role) <> '' then role end, 'unknown') as role, coalesce(text, '') as text from conversations),
rows_ as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as pos from clean),
people as (select distinct conv_id, role as perspective from rows_ where role <> '{SYSTEM}'),
seen as (select r.conv_id, perspective, pos // {PIECE} as piece, pos, text, role = perspective as own,
   '{OPEN}' || case when role = perspective then 'assistant' when role = '{SYSTEM}' then '{SYSTEM}' else 'user name=' || role end || chr(10) as head
   from rows_ r join people p on r.conv_id is not distinct from p.conv_id),
placed as (select *, head || text || '{CLOSE.strip()}' || chr(10) as body,
   coalesce(sum(length(head) + length(text) + {len(CLOSE)}) over (partition by conv_id, perspective, piece order by pos rows between unbounded preceding and 1 preceding), 0) as offs from seen)
select conv_id, perspective, piece, min(pos) as first_turn, count(*)::int as n_turns, string_agg(body, '' order by pos) as rendered,
  coalesce(string_agg((offs + length(head))::bigint || ':' || (offs + length(head) + length(text) + {len(CLOSE)})::bigint, ',' order by pos) filter (own), '') as mask
from placed group by conv_id, perspective, piece"""
