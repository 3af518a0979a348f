r"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted by (turn, role, text) with nulls
first; adjacent turns of one role are merged into a block: a turn whose predecessor has another
role begins one, else it is a further part.  A block is ``### role: part </part> part </turn>``
and a line feed.  Inside parts and roles ``\``, ``</``, ``###`` and (in
roles) ``:`` get a backslash in front, so neither marker can come from a text; ``read_back``
undoes it.  The loss mask is an array of code-point ranges of the formatted string, one for
each assistant turn, from running sums of lengths by array aggregation.  All steps take time
that is linear in the conversation, and no pattern recurs into itself, whatever its length.

Nulls: null text and null role count as empty strings, a null conv_id is a conversation of
its own, null turns sort first.  Repeated rows stay repeated turns.  A conversation is one
output row, so its turns meet in one group; nothing larger is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotgram.llm.common import let, table

END, PART, TRAINED = " </turn>\n", " </part> ", "assistant"
#: Elements of a slice in which running sums are built, and characters of a piece of a text.
SLICE, CUT = 128, 512
PROBE = r"\### Assistant: </turn> ok"


def escaped(text: Column, role: bool = False) -> Column:
    return F.regexp_replace(text, r"(\\|</|###" + ("|:" if role else "") + ")", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def prefix_sums(values: Column) -> Column:
    """Running sums of an array, by array aggregation in slices: an aggregate that appends copies
    what it has, so one over the whole array would be quadratic."""

    def in_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda done, y: done + y))
        starts = F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda done, y: F.concat(done, F.array(F.element_at(done, -1) + y)))
        inside = lambda x, start: F.slice(F.aggregate(x, F.array(start), lambda done, y: F.concat(done, F.array(F.element_at(done, -1) + y))), 2, SLICE)
        return let(starts, lambda s: F.flatten(F.transform(blocks, lambda x, i: inside(x, F.get(s, i)))))

    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / SLICE).cast("int")), lambda i: F.slice(v, i * SLICE + 1, F.lit(SLICE)))
    return let(values, lambda v: let(blocks(v), in_blocks))


def format_chats(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """conv_id, formatted, loss_mask array<struct<start, end>>; from conv_id, turn, role, text."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def piece(turns: Column, t: Column, i: Column) -> Column:
        head = F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit("### "), escaped(t["role"], True), F.lit(": "))
        merged = (i > 0) & (F.get(turns, i - 1)["role"] == t["role"])
        return F.struct((t["role"] == F.lit(trained)).alias("trained"), F.when(merged, F.lit(PART)).otherwise(head).alias("lead"), escaped(t["text"]).alias("body"))

    chats = chats.select("conv_id", let(F.col("turns"), lambda x: F.transform(x, lambda t, i: piece(x, t, i))).alias("pieces"))
    text = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["body"])), ""), F.lit(END))
    ends = prefix_sums(F.transform("pieces", lambda p: (F.length(p["lead"]) + F.length(p["body"])).cast("long")))
    span = lambda p, end: F.when(p["trained"], F.struct((end - F.length(p["body"])).alias("start"), end.alias("end")))
    mask = let(ends, lambda e: F.filter(F.transform("pieces", lambda p, i: span(p, F.get(e, i))), lambda x: x.isNotNull()))
    return chats.select("conv_id", text.alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted conversation holds."""
    blocks = F.filter(F.split(formatted, END), lambda x: x != "")

    def turns(block: Column) -> Column:
        # with escape pairs masked, the first colon ends the role
        colon = F.instr(F.regexp_replace(block, r"(?s)\\.", "__"), ":")
        parts = lambda at: F.transform(F.split(F.substring(block, at + 2, F.length(block)), PART), lambda p: F.struct(unescaped(F.substring(block, F.lit(5), at - 5)).alias("role"), unescaped(p).alias("text")))
        return let(colon, parts)

    return F.flatten(F.transform(blocks, turns))


def cut_out(text: Column, spans: Column) -> Column:
    """The texts under ``spans``.  The text is cut into short pieces once, since each substring of
    the whole would be searched for from its start."""

    def one(pieces: Column, m: Column) -> Column:
        a, z = F.floor(m["start"] / CUT).cast("int"), F.floor((m["end"] - 1) / CUT).cast("int")
        first, size = (m["start"] - a * CUT + 1).cast("int"), (m["end"] - m["start"]).cast("int")
        over = F.concat(F.substring(F.get(pieces, a), first, F.lit(CUT)), F.array_join(F.slice(pieces, a + 2, z - a - 1), ""), F.substring(F.get(pieces, z), F.lit(1), (m["end"] - z * CUT).cast("int")))
        return F.when(size <= 0, F.lit("")).when(a == z, F.substring(F.get(pieces, a), first, size)).otherwise(over)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)), lambda pieces: F.transform(spans, lambda m: one(pieces, m)))


def loss_text(formatted: Column, mask: Column) -> Column:
    return F.array_join(F.transform(cut_out(formatted, mask), unescaped), "")


def query(spark, sf_dir) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    chats = format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe))
    chats = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(regexp_replace(text, '(\\|</|###)', '\\\1', 'g')) + CASE WHEN before = role THEN 9 ELSE 4 + length(regexp_replace(role, '(\\|</|###|:)', '\\\1', 'g')) + 2 + 9 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""
