"""Operator 1: multi-party perspective rotation of dialogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_total, stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Speaker of a turn that names none, and the role that is nobody's perspective.
NOBODY, SYSTEM = "unknown", "system"


def escaped(text: Column) -> Column:
    """Text whose own tag strings cannot be taken for the format's."""
    return F.replace(F.replace(text, F.lit("<|im_start|>"), F.lit("<|im_start |>")), F.lit("<|im_end|>"), F.lit("<|im_end |>"))


def rotate(turns: DataFrame, turns_per_part: int = 64, conversation_col: str = "conv_id", turn_col: str = "turn",
           speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """Render every dialogue once for each participant, with that speaker as assistant.

    In a perspective the participant's turns are ``assistant``, all others ``user`` with
    their names; ``system`` turns stay system turns and are no perspective. The loss
    mask covers the assistant's text and the tag that closes it. A dialogue is
    returned in parts of ``turns_per_part`` turns, so no dialogue is held whole.

    Returns conv_id, perspective, part (from 0), start_char (characters of the parts
    before), n_turns, n_own (turns of the participant), text, masks (array of start,
    end in characters of the part's text). Turns stand in order of (turn, speaker,
    text), nulls first; repeated rows are turns of their own. A null speaker is
    ``unknown``, a null text empty, a null conversation id one conversation. A dialogue
    of system turns only has no participant and no rows.
    """
    rows = turns.select(F.col(conversation_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(speaker_col), F.lit(NOBODY)).alias("speaker"),
                        escaped(F.coalesce(F.col(text_col), F.lit(""))).alias("text"), F.lit(1).alias("one"))
    rows = stored(rows, "turns")
    rows = running_total(rows, ["conv_id", "turn", "speaker", "text"], "one", "nth", rows_per_range=20_000)
    rows = stored(rows, "turns-in-order")
    first = rows.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("nth").alias("_first"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_conv"))).withColumn("part", ((F.col("nth") - F.col("_first")) / turns_per_part).cast("long"))
    people = (turns.select(F.col(conversation_col).alias("_who"), F.coalesce(F.col(speaker_col), F.lit(NOBODY)).alias("perspective"))
              .filter(F.col("perspective") != SYSTEM).distinct())
    rows = rows.drop("_conv").join(people, F.col("conv_id").eqNullSafe(F.col("_who")))
    own = F.col("speaker") == F.col("perspective")
    head = (F.when(own, F.lit(f"{OPEN}assistant\n")).when(F.col("speaker") == SYSTEM, F.lit(f"{OPEN}system\n"))
            .otherwise(F.concat(F.lit(f"{OPEN}user name="), F.regexp_replace(escaped(F.col("speaker")), r"\s+", "_"), F.lit("\n"))))
    turn = F.struct(F.col("nth"), head.alias("head"), F.concat(F.col("text"), F.lit(CLOSE)).alias("tail"), own.alias("own"))
    parts = rows.groupBy("conv_id", "perspective", "part").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["tail"])
        mask = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(t["own"], F.array_append(acc["masks"], mask)).otherwise(acc["masks"]).alias("masks"))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("masks"))
    parts = parts.select("conv_id", "perspective", "part", F.size("turns").alias("n_turns"),
                         F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["tail"]))).alias("text"),
                         F.aggregate("turns", nothing, step).alias("walk"))
    parts = stored(parts.select("conv_id", "perspective", "part", "n_turns", F.size("walk.masks").alias("n_own"), "text",
                                F.col("walk.masks").alias("masks"), F.col("walk.at").cast("long").alias("n_chars")), "parts")
    place = running_total(parts.select("conv_id", "perspective", "part", "n_chars"), ["conv_id", "perspective", "part"], "n_chars", "start")
    begin = F.min("start").alias("_begin")
    begins = place.groupBy(F.col("conv_id").alias("_conv"), F.col("perspective").alias("_who")).agg(begin)
    later = (place.filter("part > 0").join(begins, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("perspective") == F.col("_who")))
             .select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("part").alias("_n"),
                     (F.col("start") - F.col("_begin")).alias("_start")))
    out = parts.join(later, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p")) & (F.col("part") == F.col("_n")), "left")
    return out.select("conv_id", "perspective", "part", F.coalesce("_start", F.lit(0)).cast("long").alias("start_char"), "n_turns", "n_own", "text", "masks")
