"""Chat formatting with perspective rotation, in DataFrame operations only.

For every participant of a dialogue the whole dialogue is rendered with that
speaker as the assistant and the others as named users; the masks are the
spans of the text to train on: the speaker's own words and their end marks.

A dialogue is one row a participant.  Only where ``part_turns`` is set is a
longer one cut: into parts of that many turns, a row each, by the place of a
turn in the dialogue and not by its number.  ``part`` counts them from 0 and
``offset`` is the number of characters in earlier parts, so parts read in order
are the dialogue, and spans, which count from its first character, hold over it.

Turns are numbered in two levels: within ranges of ``SPAN`` turn numbers, then
over the ranges of a dialogue, so a long dialogue is not sorted in one task.  A
row of output holds a part; what is gathered for it is bounded by ``part_turns``,
and by the dialogue itself where that is not set.

Rows: a null or empty role speaks as ``unknown``; system turns are context and
no participant, and a dialogue of them alone has no rendering; a null text is
empty; turns with equal numbers (ties, repeated rows) are ordered by role and
text and all stay; null numbers come last; a null dialogue id is a dialogue;
characters other than ASCII letters, digits, ``_`` and ``-`` in a name become
``_``, and speakers whose names become equal stay apart as participants; template
marks within a text are broken up by a space, so a text can't forge a turn; a
very long text stays whole; extra columns are ignored; an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.llm.scans import sums_before

BEGIN, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
#: Turn numbers of a range that one task sorts.
SPAN = 4096
_TURN = ("last", "turn", "role", "body")


def _name(role: Column) -> Column:
    return F.regexp_replace(role, "[^A-Za-z0-9_-]", "_")


def _parted(rows: DataFrame, part_turns: int) -> DataFrame:
    """``rows`` with the part that each turn falls in, by its place in the dialogue."""
    ranged = rows.withColumn("range", F.when(F.col("last"), F.lit(2**62)).otherwise(F.floor(F.col("turn") / SPAN)).cast("long"))
    sizes = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*_TURN)) - 1
    placed = ranged.withColumn("inner", own).join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")))
    return placed.select("conv_id", *_TURN, F.floor((F.col("base") + F.col("inner")) / part_turns).cast("long").alias("part"))


def perspectives(turns: DataFrame, part_turns: int | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, perspective, part, offset, n_turns, rendered, masks array<struct<start,end>>)."""
    role = F.coalesce(F.nullif(F.col(role_col).cast("string"), F.lit("")), F.lit("unknown"))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).isNull().alias("last"),
        F.col(turn_col).cast("long").alias("turn"),
        role.alias("role"),
        F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"),
    )
    speakers = rows.where(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("perspective")).distinct()
    placed = rows.withColumn("part", F.lit(0).cast("long")) if part_turns is None else _parted(rows, part_turns)
    parts = placed.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct(*_TURN))).alias("turns"))
    both = parts.alias("p").join(speakers.alias("s"), F.col("p.conv_id").eqNullSafe(F.col("s.conv_id"))).select(
        F.col("p.conv_id").alias("conv_id"), "perspective", "part", "turns"
    )

    def segment(t: Column) -> Column:
        head = (
            F.when(t["role"] == F.col("perspective"), F.lit(f"{BEGIN}assistant\n"))
            .when(t["role"] == SYSTEM, F.lit(f"{BEGIN}system\n"))
            .otherwise(F.concat(F.lit(f"{BEGIN}user name="), _name(t["role"]), F.lit("\n")))
        )
        return F.struct(head.alias("head"), F.concat(t["body"], F.lit(END)).alias("body"), (t["role"] == F.col("perspective")).alias("own"))

    cut = both.withColumn("segments", F.transform("turns", segment))
    text = F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "")
    cut = cut.withColumn("rendered", text)
    if part_turns is None:
        cut = cut.withColumn("offset", F.lit(0).cast("long"))
    else:
        earlier = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        cut = cut.withColumn("offset", F.coalesce(F.sum(F.length("rendered")).over(earlier), F.lit(0)).cast("long"))

    sizes = F.transform("segments", lambda s: (F.length(s["head"]) + F.length(s["body"]) + 1).cast("long"))
    cut = cut.withColumn("sizes", sizes).withColumn("starts", sums_before(F.col("sizes")))

    def span(z: Column) -> Column:
        start = F.col("offset") + z["at"] + F.length(z["s"]["head"])
        return F.struct(start.alias("start"), (start + F.length(z["s"]["body"])).alias("end"))

    own = F.filter(F.arrays_zip(F.col("segments").alias("s"), F.col("starts").alias("at")), lambda z: z["s"]["own"])
    masks = F.transform(own, span)
    return cut.select(
        "conv_id", "perspective", "part", "offset", F.size("segments").cast("long").alias("n_turns"), "rendered", masks.alias("masks")
    )


def mask_text(masks: Column) -> Column:
    """start:end, comma-joined."""
    return F.array_join(F.transform(masks, lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
