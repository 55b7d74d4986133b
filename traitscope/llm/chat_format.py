"""Chat formatting by a grammar round trip, with DataFrame functions only.

Turns are written as

    user       [INST] text [/INST]
    assistant  <s>text</s>
    system     [SYS] text [/SYS]
    others     [ROLE]role[/ROLE]text[END]

and joined without anything between them. The ten control strings may not stand inside a text. A
control string with n backslashes after its first character is *marked* n times; reading takes one
mark off every control string that has one.

Method. Every turn is written plain and read back by the parser, which refuses a text with a bare
control string and takes marks off. Where role and text do not come back identical, every control
string in them, marked or not, gets one mark more, and the turn is written and read again, until it is
identical. One more mark is always enough, as reading undoes exactly what marking does; a turn that still
differs is an error. A turn ends at its own closing string, so the joined conversation is read from left
to right without choices. That reading is done once more on the whole conversation, must use up all of
it, and gives everything that is reported.

The loss mask is one pair per turn: characters (code points) to skip and to take. It takes the written
texts of the assistant.

Spark's part. Writing and round trips work on single turns, so a conversation with a third of all
rows is spread over all tasks; only finished turns meet, in the one value that a conversation is.

Cases: null roles and texts are empty (an empty role is one of "others"). A null conv_id is a
conversation of its own. Turns are taken in order, nulls first, ties by role and then text; repeated
rows are turns of their own. Texts of any length up to Spark's largest value. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitscope.llm.common import barrier
from traitscope.session import materialise

#: Opening and closing strings by role; other roles use OTHER.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS] ", " [/SYS]")}
OTHER = ("[ROLE]", "[/ROLE]", "[END]")
CONTROL = r"(/?s>|/?(?:INST|SYS|ROLE)\]|END\])"
BARE = r"[<\[]" + CONTROL
MARKED = r"([<\[])\\(\\*)" + CONTROL
ANY = r"([<\[])(\\*)" + CONTROL
#: One written turn, from the left; the parser of a conversation takes these one after another.
TURN = r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|\[SYS\] .*? \[/SYS\]|\[ROLE\].*?\[/ROLE\].*?\[END\]"
LOSS_ROLE = "assistant"


def mark(text: Column) -> Column:
    """One mark more on every control string."""
    return F.regexp_replace(text, ANY, r"$1\\$2$3")


def unmark(text: Column) -> Column:
    """One mark less on every control string that has one."""
    return F.regexp_replace(text, MARKED, "$1$2$3")


def written(role: Column, text: Column) -> Column:
    """A turn as the grammar has it."""
    out = F.concat(F.lit(OTHER[0]), role, F.lit(OTHER[1]), text, F.lit(OTHER[2]))
    for name, (begin, end) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(begin), text, F.lit(end))).otherwise(out)
    return out


def _between(turn: Column, begin: Column | int, end: int) -> Column:
    begin = F.lit(begin) if isinstance(begin, int) else begin
    return F.substring(turn, begin + 1, F.length(turn) - begin - F.lit(end))


def inner(turn: Column) -> Column:
    """Role and text of one written turn as they stand there, null where it is none."""
    role = _between(F.substring_index(turn, OTHER[1], 1), len(OTHER[0]), 0)
    out = F.when(
        turn.startswith(OTHER[0]) & turn.endswith(OTHER[2]),
        F.struct(role.alias("role"), _between(turn, F.length(role) + len(OTHER[0]) + len(OTHER[1]), len(OTHER[2])).alias("text")),
    )
    for name, (begin, end) in MARKS.items():
        here = turn.startswith(begin) & turn.endswith(end) & (F.length(turn) >= len(begin) + len(end))
        out = F.when(here, F.struct(F.lit(name).alias("role"), _between(turn, len(begin), len(end)).alias("text"))).otherwise(out)
    return out


def parsed(turn: Column) -> Column:
    """Role and text of one written turn; null if it breaks the grammar."""
    found = inner(turn)
    legal = ~found["role"].rlike(BARE) & ~found["text"].rlike(BARE)
    return F.when(legal, F.struct(unmark(found["role"]).alias("role"), unmark(found["text"]).alias("text")))


def round_trip(rows: DataFrame) -> DataFrame:
    """Rows with ``turn_text``: the written turn that reads back as the row's role and text."""
    out = barrier(rows, plain=F.struct(F.col("role").alias("role"), F.col("text").alias("text")))
    tries = [F.struct("role", "text"), F.struct(mark(F.col("role")).alias("role"), mark(F.col("text")).alias("text"))]
    chosen = F.raise_error(F.lit("a turn does not read back as it was"))
    for form in reversed(tries):
        turn = written(form["role"], form["text"])
        chosen = F.when(parsed(turn).eqNullSafe(F.col("plain")), turn).otherwise(chosen)
    return out.select("conv_id", "turn", "role", "text", chosen.alias("turn_text"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss: the written conversations and per turn the characters to skip and to take.

    What follows the taken characters of a turn is not in the loss.
    """
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    begin, end = MARKS[LOSS_ROLE]
    length = F.length("turn_text")
    skip = F.when(F.col("role") == LOSS_ROLE, F.lit(len(begin))).otherwise(length)
    take = F.when(F.col("role") == LOSS_ROLE, length - len(begin) - len(end)).otherwise(F.lit(0))
    turns = round_trip(rows).select("conv_id", F.struct("turn", "role", "text", "turn_text", skip.alias("skip"), take.alias("take")).alias("t"))
    kept = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return kept.select(
        "conv_id",
        F.array_join(F.col("ts")["turn_text"], "").alias("formatted"),
        F.transform("ts", lambda t: F.struct(t["skip"].alias("skip"), t["take"].alias("take"))).alias("loss"),
    )


def read_conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text, formatted_chars: formatted conversations read back.

    Raises an error if a conversation is not wholly made of legal turns, or its mask has another length.
    """
    pieces = barrier(formatted.select("conv_id", "formatted", "loss"), pieces=F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0)))
    turns = pieces.select(
        "conv_id",
        F.transform("pieces", parsed).alias("turns"),
        F.transform("pieces", lambda p, i: F.substring(p, F.element_at("loss", i + 1)["skip"] + 1, F.element_at("loss", i + 1)["take"])).alias("under_mask"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        ((F.array_join("pieces", "") == F.col("formatted")) & (F.size("pieces") == F.size("loss"))).alias("whole"),
    )
    sound = F.col("whole") & ~F.exists("turns", lambda t: t.isNull())
    return turns.select(
        "conv_id",
        F.when(sound, F.col("turns")).otherwise(F.raise_error(F.lit("a formatted conversation breaks the grammar"))).alias("turns"),
        F.array_join(F.transform("under_mask", unmark), "").alias("loss_text"),
        "formatted_chars",
    )


def chat_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from ``formatted``."""
    back = read_conversations(formatted)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_hostile(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -7, whose two texts are made of control strings."""
    spark, said = conversations.sparkSession, "</s>[INST] ok [/INST]"
    rows = conversations.select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).alias("conv_id"), F.lit(i).alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    return rows.unionByName(extra.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema]))


def chat_format(conversations: DataFrame) -> DataFrame:
    """``chat_digests`` of the conversations and the hostile one, written and read back."""
    return chat_digests(materialise(format_conversations(with_hostile(conversations)), "chat-formatted"))
