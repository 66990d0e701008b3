"""Minimax contiguous shards over ordered atomic groups.

Rows with equal texts are one group and stay together; groups are ordered by their smallest doc_id.  The shards are
contiguous runs of groups; the capacity is the smallest for which a greedy fill needs no more than ``n_shards``.

The groups are sorted by Spark and written with running sums, and the driver sees sums of at most ``BLOCKS`` blocks of
neighbouring groups (plus one per partition).  With block sums alone a greedy fill gives a lower and an upper bound
for every cut and so for the capacity; blocks that may hold a cut are split into ``SPLIT`` parts and the search is
repeated, until both bounds meet.  The result equals the search over all groups, and what reaches the driver does not
grow with the data.  Under that capacity the cuts are set as evenly as it allows.

Defined results: a null text has no bytes, checksum 0 and is a group apart from empty texts; rows that repeat are
members of one group; null doc_ids come first; fewer groups than shards leave shards empty; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

ROW_OVERHEAD = 16
BLOCKS = 32_768
SPLIT = 64
_ROW_BITS = 33  # monotonically_increasing_id: partition above, row below


def rows_of(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, _key (group) and _rid (distinguishes repeated rows)."""
    t = F.col(text)
    return df.select(F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
                     F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
                     F.coalesce(F.md5(t.cast("binary")), F.lit("-")).alias("_key"), F.monotonically_increasing_id().alias("_rid"))


def _sorted_groups(rows: DataFrame) -> DataFrame:
    """(part, bytes_end, rows_end): groups in order; running sums within each range partition."""
    groups = rows.groupBy("_key").agg(F.min("doc_id").alias("_first"), F.sum("size").alias("bytes"), F.count("*").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, size, n = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            ends, counts = size + b["bytes"].cumsum(), n + b["n"].cumsum()
            yield pd.DataFrame({"part": part, "bytes_end": ends, "rows_end": counts})
            if len(b):
                size, n = int(ends.iloc[-1]), int(counts.iloc[-1])
    order = ["_first", "_key"]
    return groups.repartitionByRange(*order).sortWithinPartitions(*order).select("bytes", "n") \
        .mapInPandas(run, "part long, bytes_end long, rows_end long")


class _Cuts:
    """Known group boundaries (global running sums of bytes and rows) and the intervals that hold unknown ones."""

    def __init__(self):
        self.ends: dict[int, int] = {0: 0}
        self.open: dict[tuple[int, int], tuple] = {}

    def known(self) -> list[int]:
        return sorted(self.ends)

    def low(self, ends: list[int], start: int, capacity: int) -> int:
        """Largest known boundary within reach."""
        return ends[bisect_right(ends, start + capacity) - 1]

    def high(self, ends: list[int], start: int, capacity: int) -> int:
        """No boundary within reach is larger than this."""
        goal = start + capacity
        k = bisect_right(ends, goal) - 1
        if ends[k] == goal or k + 1 == len(ends):
            return ends[k]
        return goal if (ends[k], ends[k + 1]) in self.open else ends[k]

    def reach(self, step, ends: list[int], capacity: int, n: int) -> list[int]:
        out, at = [], 0
        for _ in range(n):
            at = max(at, step(ends, at, capacity))
            out.append(at)
        return out

    def smallest(self, step, ends: list[int], n: int) -> int:
        total = ends[-1]
        lo, hi = -(-total // n), max(1, total)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.reach(step, ends, mid, n)[-1] >= total:
                hi = mid
            else:
                lo = mid + 1
        return lo


def find_cuts(groups: DataFrame, n_shards: int) -> tuple[list[int], int]:
    """(row positions at which shards 1, 2, ... begin, smallest capacity)."""
    spark = groups.sparkSession
    parts = sorted((r["part"], r["b"], r["n"]) for r in groups.groupBy("part").agg(
        F.max("bytes_end").alias("b"), F.max("rows_end").alias("n")).collect())
    base, size, n = {}, 0, 0
    for part, b, c in parts:
        base[part] = (size, n)
        size, n = size + b, n + c
    if not size:
        return [0] * (n_shards - 1), 0
    cuts = _Cuts()
    quantum = max(1, size // BLOCKS)
    level = groups
    while True:
        blocks = level.groupBy("part", F.floor((F.col("bytes_end") - 1) / quantum).alias("block")).agg(
            F.max("bytes_end").alias("b"), F.max("rows_end").alias("n"), F.count("*").alias("c")).collect()
        for r in blocks:
            before, count = base[r["part"]]
            cuts.ends[before + r["b"]] = count + r["n"]
        ends = cuts.known()
        for r in blocks:
            if r["c"] > 1:
                end = base[r["part"]][0] + r["b"]
                cuts.open[(ends[bisect_left(ends, end) - 1], end)] = (r["part"], r["block"])
        lo, hi = cuts.smallest(cuts.high, ends, n_shards), cuts.smallest(cuts.low, ends, n_shards)
        if lo == hi:
            break
        spans = list(zip(cuts.reach(cuts.low, ends, lo, n_shards), cuts.reach(cuts.high, ends, hi, n_shards)))
        wanted = [(k, v) for k, v in cuts.open.items() if any(a < k[1] and k[0] < b for a, b in spans)]
        if not wanted:
            break
        for k, _ in wanted:
            del cuts.open[k]
        chosen = F.broadcast(spark.createDataFrame([v for _, v in wanted], "part long, _block long"))  # bounded by BLOCKS
        level = groups.withColumn("_block", F.floor((F.col("bytes_end") - 1) / quantum)).join(chosen, ["part", "_block"]).drop("_block")
        quantum = max(1, quantum // SPLIT)
    capacity = hi
    # the earliest place of each cut, from the end; then cuts as even as these and the capacity allow
    earliest = [ends[-1]]
    for _ in range(n_shards - 1):
        earliest.append(ends[bisect_left(ends, max(0, earliest[-1] - capacity))])
    earliest = earliest[::-1]
    out, at = [], 0
    for k in range(1, n_shards):
        goal = at + (ends[-1] - at) / (n_shards - k + 1)
        i = bisect_left(ends, goal)
        best = min((ends[j] for j in (i - 1, i) if 0 <= j < len(ends)), key=lambda e: abs(e - goal))
        at = max(at, earliest[k - 1], min(best, cuts.low(ends, at, capacity)))
        out.append(cuts.ends[at])
    return out, capacity


def shard(df: DataFrame, n_shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard, in group order)."""
    rows = cut(rows_of(df, doc_id, text), "rows")
    groups = cut(_sorted_groups(rows), "groups")
    starts, _ = find_cuts(groups, n_shards)
    # rows in the order of their groups; a range of one large group can be split, as _rid differs
    # written before the join: Spark splits a hot key's rows only where both sides are bare shuffles
    first = cut(rows.groupBy("_key").agg(F.min("doc_id").alias("_first")), "first")
    order = ["_first", "_key", "doc_id", "_rid"]
    place = F.monotonically_increasing_id()
    placed = rows.join(first, "_key").repartitionByRange(*order).sortWithinPartitions(*order).select(
        "doc_id", "size", "text_crc32", place.alias("_at"))
    placed = cut(placed, "placed").withColumn("_part", F.shiftright("_at", _ROW_BITS))
    counts = dict(placed.groupBy("_part").agg(F.max(F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)).alias("n")).collect())
    base, n = {}, 0
    for part in sorted(counts):
        base[part], n = n, n + counts[part] + 1
    begins = np.array([0, *starts], dtype=np.int64)

    @F.pandas_udf("shard int, slot long")
    def position(at: pd.Series) -> pd.DataFrame:
        a = at.to_numpy()
        pos = np.array([base[p] for p in (a >> _ROW_BITS)], dtype=np.int64) + (a & ((1 << _ROW_BITS) - 1))
        k = np.searchsorted(begins, pos, side="right") - 1
        return pd.DataFrame({"shard": k.astype(np.int32), "slot": pos - begins[k]})
    return placed.withColumn("_p", position("_at")).select("doc_id", "size", "text_crc32", "_p.shard", "_p.slot")


def write_shards(df: DataFrame, shards: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """The rows of ``df`` in one folder per shard, ordered by slot (for tables with unique doc_ids)."""
    out = df.join(shards.select(F.col("doc_id").alias("_id"), "shard", "slot"), F.col(doc_id).eqNullSafe(F.col("_id"))).drop("_id")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
