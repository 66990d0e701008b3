"""Rows of conversations in their order, without gathering a conversation in one task.

The order is conv_id, turn (nulls first), then role, the text's first characters and a hash of role and text, so ties
have a defined order and repeated rows stand together.  Tasks get ranges of that order: a conversation that holds a
large share of all rows is spread over tasks, and only short keys are sampled for the ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIE_CHARS = 64
ORDER = ["conv_id", "turn", "_tie_role", "_tie_text", "_tie"]


def turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role and text (null: empty) and the keys of ``ORDER``; other columns are left behind."""
    rows = df.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                     F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.withColumns({"_tie_role": F.substring("role", 1, TIE_CHARS), "_tie_text": F.substring("text", 1, TIE_CHARS),
                             "_tie": F.xxhash64("role", "text")})


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` range-partitioned and sorted by ``ORDER`` (ascending, nulls first)."""
    return rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
