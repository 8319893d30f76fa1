"""Chat formatting by multi-party perspective rotation, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turn numbers in one rendered row. A longer dialogue, which no one task should hold, continues in further rows, each of
#: which begins with the dialogue's first system turn as well.
PART_TURNS = 1024


def rotate_perspectives(turns: DataFrame, part_turns: int = PART_TURNS, system_role: str = "system") -> DataFrame:
    """For every participant of every dialogue, the dialogue as that participant would give it as assistant.

    turns: conv_id, turn, role, text. Participants are a dialogue's distinct roles but the system's.
    In a participant's rendering its own turns are headed `assistant`, others' `user name=<role>`,
    the system's `system`; own contents are to be learned (mask 1), all else is not. Parts hold turn
    numbers [k * part_turns, (k + 1) * part_turns), so no dialogue, however long, meets in one task; a later part begins
    with the dialogue's first system turn, if there is one in an earlier part.
    Returns conv_id, perspective, part, n_turns, rendered, spans: the half-open [start, end) ranges,
    in code points of rendered, of what is to be learned (a turn's text with its end mark).
    Turns go by turn, then role and text; exact repetitions of a turn are rendered once. Null turns
    count as turn 0, null texts as empty, null roles as `unknown`; rows without conv_id are left
    out. Very long texts are rendered whole; other columns play no part. A dialogue with the system alone has no participant,
    so no row; empty table: no rows.
    """
    t = turns.where("conv_id is not null").select(
        "conv_id", F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    who = t.where(F.col("role") != system_role).select("conv_id", F.col("role").alias("perspective")).distinct()
    first = t.where(F.col("role") == system_role).groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("s"))
    size = F.lit(part_turns)
    part = lambda turn: F.floor(turn / size).cast("long")
    later = t.select("conv_id", part(F.col("turn")).alias("part")).distinct().join(first, "conv_id").where(F.col("part") > part(F.col("s.turn"))).select("conv_id", "s.*", "part")
    t = t.withColumn("part", part(F.col("turn"))).unionByName(later)
    seen = t.join(who, "conv_id")
    mine = F.col("role") == F.col("perspective")
    head = F.when(F.col("role") == system_role, "system").when(mine, "assistant").otherwise(F.concat(F.lit("user name="), F.col("role")))
    parts = seen.groupBy("conv_id", "perspective", "part").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", F.concat(F.lit("<|im_start|>"), head, F.lit("\n")).alias("head"), mine.cast("int").alias("mine")))).alias("says")
    )
    tail = "<|im_end|>\n"
    # The start of each turn by a running sum over the part's (bounded) turns.
    lengths = F.transform("says", lambda s: F.length(s["head"]) + F.length(s["text"]) + len(tail))
    step = lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n)
    starts = F.aggregate(lengths, F.array(F.lit(0)), step)
    out = parts.withColumn("starts", starts).withColumn("rendered", F.array_join(F.transform("says", lambda s: F.concat(s["head"], s["text"], F.lit(tail))), ""))
    spans = F.transform("says", lambda s, i: F.struct((F.get("starts", i) + F.length(s["head"])).alias("start"), (F.get("starts", i + 1) - 1).alias("end"), s["mine"].alias("mine")))
    learned = F.transform(F.filter(spans, lambda s: s["mine"] == 1), lambda s: F.struct(s["start"], s["end"]))
    return out.select("conv_id", "perspective", "part", F.size("says").alias("n_turns"), "rendered", learned.alias("spans"))
