"""Chat formatting: collapse cumulative snapshots of conversations, then render them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe(text: Column) -> Column:
    """text with a backslash inside each <|, so that it can't pass for a marker; of <\\| and the like one more, so that it can be undone."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def render_turn(role: Column, text: Column) -> Column:
    """A turn between its markers, which role and text can't forge."""
    return F.concat(F.lit("<|"), F.regexp_replace(safe(role), r"\|(\\*)>", r"|$1\\>"), F.lit("|>\n"), safe(text), F.lit("\n<|end|>\n"))


def collapse_snapshots(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each maximal conversation: conv_id, n_turns, rendered.

    A log often holds a conversation again and again as it grows. Every turn
    gets the rolling hash of its conversation up to it: the running XOR of two
    64-bit hashes of (position, role, text), so 128 bits. A conversation whose
    whole hash is the hash of a shorter prefix of some other one is dropped by
    an anti join; of equal conversations the smallest id stays. The prefixes
    are pre-aggregated, so a first turn that a third of all conversations share
    is one row of each map task.

    Defined cases: turns are put in order by (turn, role, text) with nulls
    first, and repeated rows count as turns of their own; null role and text
    are empty; rows with a null id are conversations of one turn each, of which
    equal ones collapse, and never meet in one task; an empty table gives an
    empty result; further columns are not looked at. A conversation is one
    output row, so it must fit a row.
    """
    base = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    known = base.filter("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rolling = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = known.select("*", F.row_number().over(order).alias("pos"), F.count(F.lit(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    first, second = F.xxhash64("pos", "role", "text"), F.xxhash64(F.lit("second"), "text", "pos", "role")
    hashed = placed.select("conv_id", "pos", "n", F.bit_xor(first).over(rolling).alias("h1"), F.bit_xor(second).over(rolling).alias("h2"))
    whole = hashed.filter("pos = n").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    prefixes = hashed.filter("pos < n").select("pos", "h1", "h2").distinct()
    kept = whole.join(prefixes, ["pos", "h1", "h2"], "left_anti").select(F.col("conv_id").alias("kept_id"))
    lines = placed.select("conv_id", "pos", render_turn(F.col("role"), F.col("text")).alias("line"))
    joined = (
        lines.join(kept, F.col("conv_id") == F.col("kept_id"), "left_semi")
        .groupBy("conv_id")
        .agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "").alias("rendered"))
    )
    lone = base.filter("conv_id is null").select(F.lit(1).alias("pos"), "role", "text").distinct().select("*", first.alias("h1"), second.alias("h2"))
    for longer in (whole, prefixes):
        lone = lone.join(longer.select("pos", "h1", "h2"), ["pos", "h1", "h2"], "left_anti")
    nobody = F.lit(None).cast(base.schema["conv_id"].dataType)
    return joined.unionByName(lone.select(nobody.alias("conv_id"), F.lit(1).cast("long").alias("n_turns"), render_turn(F.col("role"), F.col("text")).alias("rendered")))
