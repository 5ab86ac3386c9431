"""Chat formatting by perspective rotation (DataFrame functions only).

For every participant of a conversation the dialogue is rendered once: that participant speaks as assistant, the others as named
users, system turns stay system turns, and the mask spans cover exactly what the assistant says. Long conversations are rendered in
parts of at most `part_turns` turns, so no row and no task holds a whole unbounded conversation; the parts of a speaker, joined in
order of `part`, are the dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM, UNNAMED = "system", "unknown"


def _plain(text: Column) -> Column:
    """A template marker inside a text is broken by a space, so that it cannot open or close a turn."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("< |im_"))


def rotate(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = 64) -> DataFrame:
    """conv_id, speaker, part, n_turns, text, mask: one row a conversation, participant and part. A conversation of at most part_turns
    turns, numbered from 0, is one part; a larger part_turns keeps longer ones whole, at the price of rows as large as they are.

    Participants are the distinct roles but `system`; a null role is the participant "unknown"; line feeds in a name become spaces. A
    conversation of system turns alone has no participant and gives no row. Turns are ordered by turn (null first), role and text;
    ties and repeated rows stay and are all rendered. A null text is an empty turn. mask: "start-end" pairs of code points of
    `text`, joined by commas, one for each turn of the speaker (an empty text gives an empty span); empty if the part has none. A null
    conv_id is a conversation of its own. An empty table gives an empty result; other columns are ignored.
    """
    role = F.regexp_replace(_plain(F.coalesce(F.col(role_col), F.lit(UNNAMED))), r"[\r\n]", " ")
    turns = conversations.select(F.col(conv_col).alias("c"), F.col(turn_col).cast("long").alias("t"), role.alias("r"), _plain(F.col(text_col)).alias("x"))
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("t") / F.lit(part_turns)), F.lit(-(2**53))))
    # repeated turn numbers could make a block large: its rows are numbered (a streaming window) and cut again
    inside = Window.partitionBy("c", "block").orderBy(F.col("t").asc_nulls_first(), "r", "x")
    turns = turns.withColumn("n", F.row_number().over(inside) - 1).withColumn("sub", F.floor(F.col("n") / F.lit(part_turns)))
    # parts are numbered before they hold any text
    places = turns.select("c", "block", "sub").distinct()
    places = places.withColumn("part", F.row_number().over(Window.partitionBy("c").orderBy("block", "sub")) - 1)
    parts = turns.groupBy("c", "block", "sub").agg(F.sort_array(F.collect_list(F.struct("n", "r", "x"))).alias("turns"))
    same = parts["c"].eqNullSafe(places["c"]) & (parts["block"] == places["block"]) & (parts["sub"] == places["sub"])
    parts = parts.join(places.hint("shuffle_hash"), same).select(parts["c"], "turns", "part")
    speakers = turns.where(F.col("r") != SYSTEM).select("c", F.col("r").alias("speaker")).distinct()
    parts = parts.join(speakers, parts["c"].eqNullSafe(speakers["c"])).select(parts["c"], "part", "turns", "speaker")

    head = lambda t: F.concat(
        F.lit(START),
        F.when(t["r"] == SYSTEM, F.lit("system")).when(t["r"] == F.col("speaker"), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), t["r"])),
        F.lit("\n"),
    )
    parts = parts.withColumn("pieces", F.transform("turns", lambda t: F.struct(head(t).alias("head"), t["x"].alias("x"), (t["r"] == F.col("speaker")).alias("own"))))
    foot = f"{END}\n"
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("mask"))

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + F.char_length(p["head"])
        stop = start + F.char_length(p["x"])
        span = F.concat(F.when(state["mask"] == "", F.lit("")).otherwise(F.lit(",")), start.cast("string"), F.lit("-"), stop.cast("string"))
        return F.struct((stop + F.lit(len(foot))).alias("at"), F.concat(state["mask"], F.when(p["own"], span).otherwise(F.lit(""))).alias("mask"))

    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["x"], F.lit(foot))), "")
    return parts.select(
        F.col("c").alias(conv_col),
        "speaker",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        text.alias("text"),
        F.aggregate("pieces", zero, step)["mask"].alias("mask"),
    )
