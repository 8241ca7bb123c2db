"""Chat formatting as relational expressions: sort, merge, concatenate, read back.

A conversation becomes one string of blocks, a block holding adjacent turns of one role:

    <s>role[INST]text[/INST]text</s>

`[/INST]` parts the turns that were merged. In roles and texts a backslash follows each `<`,
`[` and backslash, so none of the control strings can occur in them and the string can be
read back to the turns it was made from.

Defined cases: a null text or role counts as empty; turns are ordered by turn number (null
first), then role, then text, so ties and repeated rows have one order and all are kept; rows
of a null conv_id form a conversation of their own. Columns other than the four named are not
read. An empty table gives an empty result. A conversation is one row of the result, so its
turns meet in one task; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, HEAD, NEXT, END = "<s>", "[INST]", "[/INST]", "</s>"


def escaped(text: Column) -> Column:
    """A backslash after each `<`, `[` and backslash."""
    return F.when(text.rlike("[<\\[\\\\]"), F.regexp_replace(text, "([<\\[\\\\])", "$1\\\\")).otherwise(text)


def unescaped(text: Column) -> Column:
    """The text that escaped() was given."""
    return F.when(text.contains("\\"), F.regexp_replace(text, "([<\\[\\\\])\\\\", "$1")).otherwise(text)


def quoted(control: str) -> str:
    return f"\\Q{control}\\E"


def format_conversations(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: conv_id, formatted."""
    plain = turns.select(
        turns[conversation].alias("conv_id"),
        F.struct(
            turns[turn].alias("turn"),
            F.coalesce(turns[role].cast("string"), F.lit("")).alias("role"),
            F.coalesce(turns[text].cast("string"), F.lit("")).alias("text"),
        ).alias("said"),
    )
    sorted_turns = plain.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))

    def piece(said: Column, place: Column) -> Column:
        before = F.get(F.col("turns"), place - 1)
        opening = F.concat(F.lit(BEGIN), escaped(said["role"]), F.lit(HEAD))
        mark = (
            F.when(place == 0, opening)
            .when(before["role"] == said["role"], F.lit(NEXT))
            .otherwise(F.concat(F.lit(END), opening))
        )
        return F.concat(mark, escaped(said["text"]))

    pieces = F.transform("turns", piece)
    return sorted_turns.select("conv_id", F.concat(F.array_join(pieces, ""), F.lit(END)).alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    blocks = F.filter(F.split(formatted, quoted(END)), lambda block: block != "")

    def turns_of(block: Column) -> Column:
        halves = F.split(F.substr(block, F.lit(len(BEGIN) + 1)), quoted(HEAD))
        said = F.split(F.get(halves, F.lit(1)), quoted(NEXT))
        return F.transform(
            said, lambda text: F.struct(unescaped(F.get(halves, F.lit(0))).alias("role"), unescaped(text).alias("text"))
        )

    return F.flatten(F.transform(blocks, turns_of))


def under_loss(turns: Column, role: str = "assistant") -> Column:
    """The text under the loss mask of a read-back conversation."""
    masked = F.filter(turns, lambda said: said["role"] == role)
    return F.array_join(F.transform(masked, lambda said: said["text"]), "")


def formatted_digest(formatted: DataFrame) -> DataFrame:
    """Digests of what is read back from formatted conversations."""
    turns = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = turns.withColumn("loss", under_loss(F.col("turns")))
    return loss.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
