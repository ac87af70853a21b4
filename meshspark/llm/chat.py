"""Chat formatting: every participant's view of a multi-party dialogue.

For each participant (each distinct role of a conversation but ``system``) the dialogue is
rendered with that speaker as ``assistant`` and the others as ``user`` with their role as name;
system turns stay system turns.  Turns come out one row each with their character span in the
rendered dialogue and a loss mask that covers the assistant's words only (not its header), so
that a conversation of any length is never gathered in one row or task; ``dialogues`` joins the
segments where whole strings are wanted.

Defined edge cases: order is by turn (nulls last), then role, then text; null roles take part
under the name ``unknown``; null texts are empty; a conversation with no participant but
``system`` gives no rows; repeated rows are turns of their own; an empty table gives no rows.  Texts are
copied as they are, however long: one that holds the format's own markers isn't changed, and ``start``, ``end`` and the
masks, not the markers, tell where turns begin and what is learnt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running, same

# Fixed values of the rendered format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def header(role: Column, name: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit(" name="), name)), F.lit("\n"))


def perspectives(turns: DataFrame) -> DataFrame:
    """conv_id, speaker, seq, turn, role, name, segment, start, end, mask_start, mask_end for each turn and participant.

    ``turns`` has conv_id, turn, role, text.  ``start`` and ``end`` are 0-based character offsets in
    the rendered dialogue; the mask is empty (both ends equal) on turns of others.
    """
    t = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("unknown")).alias("_r"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    people = t.where(F.col("_r") != "system").select(F.col("conv_id").alias("_c"), F.col("_r").alias("speaker")).distinct()
    views = t.join(people, same(F.col("conv_id"), F.col("_c")))
    own = F.col("_r") == F.col("speaker")
    role = F.when(F.col("_r") == "system", F.lit("system")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    views = views.withColumns({"role": role, "name": F.when(~own & (F.col("_r") != "system"), F.col("_r"))})
    views = views.withColumn("_head", header(F.col("role"), F.col("name"))).withColumn("segment", F.concat("_head", "_text", F.lit(CLOSE)))
    views = views.withColumn("_own", own).select("conv_id", "speaker", "turn", "_r", "role", "name", "segment", F.length("_head").alias("_h"), "_own")
    order = [F.col("turn").asc_nulls_last(), F.col("_r").asc(), F.col("segment").asc()]
    placed = running(views, ["conv_id", "speaker"], order, F.length("segment"), "chat")
    start, end = F.col("_before"), F.col("_before") + F.length("segment")
    return placed.select(
        "conv_id", "speaker", F.col("_rank").alias("seq"), "turn", "role", "name", "segment", start.alias("start"), end.alias("end"),
        F.when(F.col("_own"), start + F.col("_h")).otherwise(end).alias("mask_start"), end.alias("mask_end"),
    )


def dialogues(turns: DataFrame) -> DataFrame:
    """conv_id, speaker, text and masks: whole rendered dialogues, for conversations that fit in a row."""
    p = perspectives(turns)
    part = F.array_sort(F.collect_list(F.struct("seq", "segment", "mask_start", "mask_end")))
    return p.groupBy("conv_id", "speaker").agg(part.alias("_p")).select(
        "conv_id", "speaker", F.array_join(F.transform("_p", lambda x: x["segment"]), "").alias("text"),
        F.filter(F.transform("_p", lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end"))), lambda x: x["start"] < x["end"]).alias("masks"),
    )
