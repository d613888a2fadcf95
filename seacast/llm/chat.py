"""Chat formatting by perspective rotation: every participant in turn is the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seacast.llm.common import prefix_sums

START, END, SYSTEM, UNNAMED = "<|im_start|>", "<|im_end|>", "system", "unknown"


def plain(text: Column) -> Column:
    """Text that cannot be taken for a mark of the template."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, turn, speaker, piece, start, mask_start, mask_end): for every participant the whole dialogue,
    one row per turn.

    The participant's turns are the assistant's, the other participants' are those of named users, and
    system turns stay. Pieces joined in order of ``start`` (characters before the piece) are the text;
    mask_start..mask_end are the characters to learn: content and end mark of the participant's own
    turns, null elsewhere. A null or empty role is the speaker ``unknown``; a dialogue of system turns
    alone has no participant and no rows. Turns are in order, null turns last, equal turns by role and
    text; repeated rows are turns of their own; a null conv_id is one dialogue. Null text is empty. Marks
    of the template inside a text or a name are broken up. A dialogue may be longer than a task's
    memory: its rows are dealt by ranges and their starts come from distributed prefix sums.
    """
    named = F.when(F.trim(F.col("role")) == "", None).otherwise(F.trim(F.col("role")))
    rows = turns.select(
        F.col("conv_id").alias("_id"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_conv"), F.col("conv_id").isNull().alias("_none"),
        F.col("turn"), F.coalesce(named, F.lit(UNNAMED)).alias("speaker"), plain(F.col("text")).alias("_text"),
    )
    speakers = rows.where(F.col("speaker") != SYSTEM).select("_conv", "_none", F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(speakers, ["_conv", "_none"])
    own = F.col("speaker") == F.col("perspective")
    header = F.when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).when(own, F.lit("assistant")).otherwise(
        F.concat(F.lit("user name="), F.regexp_replace(plain(F.col("speaker")), r"[\r\n]+", " "))
    )
    head = F.concat(F.lit(START), header, F.lit("\n"))
    body = F.concat(F.col("_text"), F.lit(END))
    pieces = seen.withColumns({"piece": F.concat(head, body, F.lit("\n")), "_head": F.length(head), "_body": F.length(body), "_last": F.col("turn").isNull()})
    pieces = pieces.withColumn("_size", F.length("piece").cast("long"))
    placed = prefix_sums(pieces, ["_none", "_conv", "perspective"], ["_last", "turn", "speaker", "_text"], "_size", "start")
    begin = F.col("start") + F.col("_head")
    return placed.select(
        F.col("_id").alias("conv_id"), "perspective", "turn", "speaker", "piece", "start",
        F.when(own, begin).alias("mask_start"), F.when(own, begin + F.col("_body")).alias("mask_end"),
    )
